"""Leak search: runs equal brute force, passages survive their settings, and near misses are none."""

import random

import numpy as np
import pytest

from siltstone.llm import leakage

WORDS = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
KIND = "doc_id long, text string, words string, item_id int"


def find(spark, documents, items):
    docs = spark.createDataFrame([(d, t, "x", 0) for d, t in documents], KIND)
    tests = spark.createDataFrame(items, "item_id long, text string")
    return {(r["doc_id"], r["item_id"]): r for r in leakage.find_leaks(docs, tests).collect()}


@pytest.fixture(scope="module")
def item():
    return " ".join(random.Random(5).choices(WORDS, k=60))


def text_with(passage):
    return "Some words of a judgment stand before it. " + passage + " And others after it, of another matter."


def shard(test, texts, min_words=leakage.MIN_WORDS):
    return leakage._Shard(test, [test.number(t) for t in texts], min_words)


def test_runs_equal_brute_force():
    rng = random.Random(2)
    words = ["a", "b", "c", "d", "e"]
    items = [(i, " ".join(rng.choices(words, k=25))) for i in range(4)]
    test = leakage.TestIndex(items)
    tokens = rng.choices([*words, "zz"], k=300)
    doc = test.number(tokens)
    s = shard(test, [tokens])
    s.least = 0
    got = {r for _, runs in s.runs(np.arange((len(s.edges) - 1) * 4)) for r in runs}
    wanted = set()
    for i in range(len(doc)):
        for j in range(len(test.ids)):
            length = 0
            while i + length < len(doc) and j + length < len(test.ids) and doc[i + length] == test.ids[j + length] > 0:
                length += 1
            starts = not (i and j and doc[i - 1] == test.ids[j - 1] > 0)
            if length >= leakage.SEED and starts:
                wanted.add((i, j, length))
    assert got == wanted and wanted


def test_common_openings_pair_nothing_and_rare_words_find_all():
    rng = random.Random(4)
    opening = [f"o{i}" for i in range(12)]
    item = lambda k: [f"i{k}x{j}" for j in range(30)]
    test = leakage.TestIndex([(k, " ".join(opening + item(k))) for k in range(2000)])
    texts = [opening + [f"d{k}y{j}" for j in range(30)] for k in range(800)]
    assert not len(shard(test, texts).pairs())
    # with a passage after the opening, or one that begins within it, only the documents that hold it are paired with its item
    texts[7] = opening + item(70)[:10]
    texts[8] = opening[6:] + item(80)[:12]
    texts[9] = opening + ["x"] + item(90)[1:8]
    found = shard(test, texts)
    assert len(found.pairs()) == 3
    assert {(d, i) for d, i, *_ in found.leaks(18)} == {(7, 70), (8, 80), (9, 90)}
    # against comparing everything with everything, where texts are put together from common phrases
    phrases = [[f"p{i}w{j}" for j in range(rng.randrange(3, 9))] for i in range(30)]
    items = [(k, " ".join(w for p in rng.choices(phrases, k=6) for w in p)) for k in range(60)]
    texts = [[w if rng.random() > 0.05 else "other" for p in rng.choices(phrases, k=12) for w in p] for _ in range(60)]
    texts += [[w if rng.random() > 0.05 else "other" for w in t.split()] for _, t in items]
    s = shard(leakage.TestIndex(items), texts)
    every = {}
    for pair, runs in s.runs(np.arange((len(s.edges) - 1) * 60)):
        doc, i = int(s.doc[s.edges[pair // 60]]), pair % 60
        every.setdefault((doc, i), []).extend((p - int(s.starts[doc]), q - int(s.test.first[i]), n) for p, q, n in runs)
    wanted = {(d, i) for (d, i), runs in every.items() if leakage._passages(runs, 18, s.test.ids[s.test.first[i] :], s.texts[d])}
    assert {(d, i) for d, i, *_ in s.leaks(18)} == wanted and len(wanted) > 50


def test_settings_of_a_passage(spark, item):
    w = item.split()
    part = w[10:34]
    cases = {
        1: " ".join(part), 2: " ".join(part).upper(), 3: "\n".join(part), 4: ", ".join(part) + "!",
        5: " ".join(part[:12]) + "\n\n— 2 —\nHC 24-C-70469  Some Party v Another Party\n\n" + " ".join(part[12:]),
        6: " ".join(part[:11] + ["altered"] + part[12:]), 7: " ".join(part[:11] + part[12:]), 8: " ".join([part[0][:2] + "-\n" + part[0][2:], *part[1:]]),
        9: " ".join(w[10:27]), 10: " ".join(w[10:28]), 11: " ".join(x if i % 4 else "other" for i, x in enumerate(part)), 12: " ".join(part[:9]) + " gap" * 60 + " " + " ".join(part[9:]),
    }
    found = find(spark, [(d, text_with(t)) for d, t in cases.items()] + [(20, None), (21, ""), (22, " ".join(part)), (None, " ".join(part))], [(1, item), (2, None), (3, ""), (4, "too short")])
    assert {d for d, _ in found} == {1, 2, 3, 4, 5, 6, 7, 8, 10, 22} and {i for _, i in found} == {1}
    assert found[1, 1]["words"] == 24 and found[1, 1]["longest_run"] == 24 and found[1, 1]["item_start"] == 10 and found[6, 1]["words"] == 24


def test_long_texts_repeats_and_nothing(spark, item):
    long = " ".join(random.Random(1).choices(WORDS, k=200_000)) + " " + " ".join(item.split()[:30])
    found = find(spark, [(1, long), (1, long), (2, item)], [(1, item), (7, item)])
    assert set(found) == {(1, 1), (1, 7), (2, 1), (2, 7)}
    assert find(spark, [], [(1, item)]) == {} and find(spark, [(1, item)], []) == {}


def test_blocks_of_items(spark, item, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 50)
    other = " ".join(random.Random(6).choices(WORDS, k=60))
    assert set(find(spark, [(1, item), (2, other)], [(1, item), (2, other), (3, "x")])) == {(1, 1), (2, 2)}


def test_removal(spark, item):
    docs = spark.createDataFrame([(1, item, "", 0), (2, "clean text", "a", 5), (None, item, "", 0), (None, "free", "", 0), (3, None, "", 0), (4, "", "", 0)], KIND)
    left = leakage.remove_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and sorted((tuple(r) for r in left.collect()), key=str) == sorted([(2, "clean text", "a", 5), (None, "free", "", 0), (3, None, "", 0), (4, "", "", 0)], key=str)
    assert leakage.remove_leaks(docs, spark.createDataFrame([], "item_id long, text string")).count() == 6


def test_leaks_of_the_tables(spark, data):
    """Against a plain search of word sequences, for passages that stand there verbatim."""
    docs = spark.read.parquet(f"{data}/documents.parquet").toPandas()
    items = spark.read.parquet(f"{data}/eval_items.parquet").toPandas()
    grams = {}
    for i, t in zip(items.item_id, items.text, strict=True):
        w = leakage.words_of(t)
        for k in range(len(w) - 17):
            grams.setdefault(tuple(w[k : k + 18]), set()).add(i)
    plain = set()
    for d, t in zip(docs.doc_id, docs.text, strict=True):
        w = leakage.words_of(t)
        for k in range(len(w) - 17):
            plain |= {(d, i) for i in grams.get(tuple(w[k : k + 18]), ())}
    found = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")).collect()}
    assert plain <= found and len(found) < 2 * len(plain) + 5


def test_a_run_alone_and_gaps_filled_word_by_word():
    # 34 of 42 words in all
    runs = [(a, a, n) for a, n in ((0, 4), (6, 4), (12, 4), (18, 4), (24, 18))]
    found = leakage._passages(runs, 18)
    assert found is not None and found[0] >= 18 and found[1] >= leakage.MIN_SHARE * found[0]
    corpus = [0 if w in (11, 13) else w for w in range(1, 31)]  # one word between two altered ones
    assert leakage._passages([(0, 0, 10), (13, 13, 17)], 28, list(range(1, 31)), corpus) == (30, 28, 0, 0, 17)
    corpus = [0 if w in (11, 12, 13) else w for w in range(1, 31)]
    assert leakage._passages([(0, 0, 10), (13, 13, 17)], 28, list(range(1, 31)), corpus) is None
