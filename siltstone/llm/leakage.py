"""Evaluation texts leaking into training text: longest verbatim matches by suffix arrays.

The corpus is cut into shards. Of each shard, places where words of the items stand so close together that a passage is
possible at all get a suffix array; every suffix of every item is looked up in it by binary search. A word sequence that stands in many
items says little of any: it is not looked up wherever a passage must also hold a rarer one, so common turns of phrase
do not pair all documents with all items. Documents and items that were brought together are then compared in full: their
verbatim runs are chained over what the corpus put between them. The items are read by the tasks from a shared table, block by
block; the corpus is read once and never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import filesystem, materialize

#: Consecutive words of an item that make a passage.
MIN_WORDS = 18
#: Words of a seed: what a binary search must match.
SEED = 4
#: Words of an item that may be altered or missing between two runs, and foreign words the corpus may have there.
MAX_ALTERED, MAX_BETWEEN = 2, 40
#: Share of a passage's words that must be there verbatim.
MIN_SHARE = 0.85
#: Words of items a task holds at once.
BLOCK_WORDS = 2_000_000
#: Pairs of places looked at in one step.
STEP_PAIRS = 2_000_000
#: Words in one shard's suffix array.
SHARD_WORDS = 4_000_000

_TOKEN = re.compile(r"[^\W_]+(?:(?:[-‐‑­'’]\s?\n?|[.,](?=\d))[^\W_]+)*")
_INNER = re.compile(r"[\W_]+")


def _plain(token: str) -> str:
    """A word without its form: case, accents, hyphens, apostrophes and digit separators do not count."""
    bare = unicodedata.normalize("NFKD", token)
    return _INNER.sub("", "".join(c for c in bare if not unicodedata.combining(c))).casefold()


def words_of(text: str) -> list[str]:
    """The plain words of a text; a word hyphenated at a line end is one word."""
    return [_plain(t) for t in _TOKEN.findall(text)]


class _Numbers(dict):
    """The number of each corpus token in a vocabulary of plain words, found once; 0 for others."""

    def __init__(self, vocabulary: dict[str, int]):
        self.vocabulary = vocabulary

    def __missing__(self, token: str) -> int:
        n = self.vocabulary.get(_plain(token), 0)
        if len(self) < 1_000_000:
            self[token] = n
        return n


class TestIndex:
    """The items of one block as arrays: words numbered by vocabulary, 0 for any other word."""

    def __init__(self, items: list[tuple[int, str]], width: int = MIN_WORDS):
        self.vocabulary: dict[str, int] = {}
        ids, owner, firsts = [], [], []
        self.keys = np.array([key for key, _ in items], np.int64)
        for i, (_, text) in enumerate(items):
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text or "")]
            firsts.append(len(ids))
            ids += [*own, -1]
            owner += [i] * (len(own) + 1)
        self.numbers = _Numbers(self.vocabulary)
        self.width = max(width, SEED)
        self.ids, self.owner, self.first = np.array(ids, np.int32), np.array(owner, np.int64), np.array(firsts, np.int64)
        self.padded = np.concatenate([self.ids, np.full(self.width, -1, np.int32)])
        #: Where a suffix begins with SEED words; the number of these in ``grams``, and how many items' suffixes begin so.
        self.starts = np.flatnonzero(np.lib.stride_tricks.sliding_window_view(self.padded, SEED).min(axis=1)[: len(self.ids)] > 0) if len(ids) else np.empty(0, np.int64)
        self.grams, self.gram_of, self.counts = np.unique(_gram(self.padded, self.starts), return_inverse=True, return_counts=True)
        self.item_starts = np.searchsorted(self.starts, [*self.first, len(self.ids)])

    def number(self, tokens: list[str]) -> np.ndarray:
        """The tokens of a corpus text as numbers."""
        return np.fromiter(map(self.numbers.__getitem__, tokens), np.int32, len(tokens))


def _gram(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the SEED words at each position."""
    h = np.zeros(len(at), np.uint64)
    for i in range(SEED):
        h = (h ^ ids[at + i].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _keys(padded: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The first ``width`` words of each suffix as bytes that sort like the words."""
    window = np.lib.stride_tricks.sliding_window_view(padded, width)[at] + 1
    return np.ascontiguousarray(window.astype(">u4")).view(f"S{4 * width}").ravel()


def suffix_array(padded: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The positions ``at`` in order of the ``width`` words from there: of a passage's least length, beyond which order doesn't matter."""
    return at[np.argsort(_keys(padded, at, width), kind="stable")]


class _Shard:
    """Some documents' words, and the places of item words among them.

    ``at``: positions where SEED words of some item stand, ``gram`` their number there. Places at most MAX_BETWEEN words
    apart form a cluster; a passage lies within one.
    """

    def __init__(self, test: TestIndex, texts: list[np.ndarray], min_words: int):
        self.test, self.texts = test, texts
        lengths = np.array([len(t) + 1 for t in texts])
        self.starts = np.concatenate([[0], np.cumsum(lengths)])
        words = np.full(lengths.sum(), -1, np.int32)
        for s, t in zip(self.starts, texts, strict=False):
            words[s : s + len(t)] = t
        self.words, self.padded = words, np.concatenate([words, np.full(test.width, -1, np.int32)])
        at = np.flatnonzero(words > 0)
        for i in range(1, SEED):
            at = at[self.padded[at + i] > 0]
        if len(test.grams):
            found = _gram(self.padded, at)
            gram = np.minimum(np.searchsorted(test.grams, found), len(test.grams) - 1)
            same = test.grams[gram] == found
            at, gram = at[same], gram[same]
        else:
            at = gram = np.empty(0, np.int64)
        self.at, self.gram = at, gram
        self.doc = np.searchsorted(self.starts, at, side="right") - 1
        edge = np.ones(len(at), bool)
        edge[1:] = (np.diff(at) > SEED + MAX_BETWEEN) | (np.diff(self.doc) != 0)
        self.cluster = np.cumsum(edge) - 1
        self.edges = np.append(np.flatnonzero(edge), len(at))
        self.known = np.concatenate([[0], np.cumsum(words > 0)])
        self.need = int(np.ceil(MIN_SHARE * min_words))  # words of an item that a passage holds at least
        self.least = MIN_SHARE * min_words - 2 * SEED  # words of these in runs; the others fill gaps

    def _holds_passage(self, at: np.ndarray) -> bool:
        """Whether places ``at``, in order, could make a passage by themselves: whether enough words of items stand from the first to the last of some that are close together."""
        edge = np.flatnonzero(np.diff(at) > SEED + MAX_BETWEEN)
        first, last = at[np.concatenate([[0], edge + 1])], at[np.append(edge, len(at) - 1)] + SEED
        return bool((self.known[last] - self.known[first] >= self.need).any())

    def looked_up(self) -> np.ndarray:
        """Which places are looked up: of the clusters that could hold a passage, all but the most common word sequences that can't make one without a rarer one."""
        chosen = np.zeros(len(self.at), bool)
        first, last = self.at[self.edges[:-1]], self.at[self.edges[1:] - 1] + SEED
        for c in np.flatnonzero(self.known[last] - self.known[first] >= self.need) if len(self.at) else ():
            own = slice(self.edges[c], self.edges[c + 1])
            counts = self.test.counts[self.gram[own]]
            steps = np.unique(counts)
            low, high = 0, len(steps)  # the places with a count of at least steps[high] are left out
            while low < high:
                middle = (low + high) // 2
                if self._holds_passage(self.at[own][counts >= steps[middle]]):
                    low = middle + 1
                else:
                    high = middle
            chosen[own] = counts < steps[high] if high < len(steps) else True
        return chosen

    def pairs(self) -> np.ndarray:
        """The clusters and items to be compared, as cluster * items + item: every suffix of an item is searched in the suffix array of the places looked up."""
        test, chosen = self.test, self.looked_up()
        if not chosen.any():
            return np.empty(0, np.int64)
        here = np.zeros(len(test.grams), bool)
        here[self.gram[chosen]] = True
        queries = test.starts[here[test.gram_of]]
        array = suffix_array(self.padded, self.at[chosen], test.width)
        prefix, wanted = _keys(self.padded, array, SEED), _keys(test.padded, queries, SEED)
        low, high = np.searchsorted(prefix, wanted, "left"), np.searchsorted(prefix, wanted, "right")
        clusters = self.cluster[np.searchsorted(self.at, array)]
        out, done, total = [], 0, np.cumsum(high - low)
        while done < len(queries):
            stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + STEP_PAIRS, "right")))
            count = (high - low)[done:stop]
            places = np.repeat(low[done:stop] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            out.append(np.unique(clusters[places] * len(test.keys) + np.repeat(test.owner[queries[done:stop]], count)))
            done = stop
        return np.unique(np.concatenate(out))

    def runs(self, pairs: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """Of each pair of cluster and item its maximal verbatim runs of at least SEED words: (pair, [(position in the shard, position in the items, length)])."""
        test, wide = self.test, len(self.test.grams)
        code = self.cluster * wide + self.gram
        order = np.argsort(code, kind="stable")
        code, places = code[order], self.at[order]
        first = test.item_starts[pairs % len(test.keys)]
        sizes = test.item_starts[pairs % len(test.keys) + 1] - first
        done, total = 0, np.cumsum(sizes)
        while done < len(pairs):
            stop = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + STEP_PAIRS, "right")))
            n = sizes[done:stop]
            suffix = np.repeat(first[done:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            wanted = np.repeat(pairs[done:stop] // len(test.keys), n) * wide + test.gram_of[suffix]
            low, high = np.searchsorted(code, wanted, "left"), np.searchsorted(code, wanted, "right")
            count = high - low
            pair = np.repeat(np.repeat(np.arange(done, stop), n), count)
            q = np.repeat(test.starts[suffix], count)
            p = places[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
            order = np.lexsort((p, p - q, pair))
            pair, p, q = pair[order], p[order], q[order]
            edge = np.ones(len(p), bool)
            edge[1:] = (np.diff(pair) != 0) | (np.diff(p - q) != 0) | (np.diff(p) != 1)
            start = np.flatnonzero(edge)
            length = np.diff(np.append(start, len(p))) + SEED - 1
            pair, p, q = pair[start], p[start], q[start]
            edges = np.append(np.flatnonzero(np.diff(pair, prepend=-1)), len(pair))
            words = np.add.reduceat(length, edges[:-1]) if len(pair) else length
            for e in np.flatnonzero(words >= self.least):
                own = slice(edges[e], edges[e + 1])
                yield int(pairs[pair[edges[e]]]), list(zip(p[own].tolist(), q[own].tolist(), length[own].tolist(), strict=True))
            done = stop

    def leaks(self, min_words: int) -> list[tuple[int, ...]]:
        """(document, item, words, verbatim, longest run, item start, document start) of each document and item with a passage."""
        n, best = len(self.test.keys), {}
        for pair, runs in self.runs(self.pairs()):
            doc, item = int(self.doc[self.edges[pair // n]]), pair % n
            start, first = int(self.starts[doc]), int(self.test.first[item])
            hit = _passages([(p - start, q - first, length) for p, q, length in runs], min_words, self.test.ids[first:], self.texts[doc])
            if hit and hit[0] > best.get((doc, item), (0,))[0]:
                best[doc, item] = hit
        return [(*key, span, verbatim, longest, item_start, doc_start) for key, (span, verbatim, item_start, doc_start, longest) in best.items()]


def _filled(item: list[int], corpus: list[int]) -> int | None:
    """How many words of a gap of the item stand in order in the gap of the corpus (the longest common subsequence), or None if more than MAX_ALTERED in a row don't."""
    if 3 * len(set(item) & set(corpus)) < len(item) - MAX_ALTERED and 3 * sum(w in corpus for w in item) < len(item) - MAX_ALTERED:
        return None
    # the most words matched, by the place reached in the corpus and the item's altered words in a row
    states = {(0, 0): 0}
    for w in item:
        then: dict[tuple[int, int], int] = {}
        for (at, altered), n in states.items():
            if altered < MAX_ALTERED:
                then[at, altered + 1] = max(n, then.get((at, altered + 1), 0))
            if w > 0 and w in corpus[at:]:
                to = corpus.index(w, at) + 1
                then[to, 0] = max(n + 1, then.get((to, 0), 0))
        states = then
    return max(states.values()) if states else None


def _passages(runs: list[tuple[int, int, int]], min_words: int, item: np.ndarray | list[int] | None = None, corpus: np.ndarray | list[int] | None = None) -> tuple[int, int, int, int, int] | None:
    """The longest passage in the runs (corpus position, item position, length) of one document and item.

    Runs are chained where the item leaves out at most MAX_ALTERED words and the corpus has at most MAX_BETWEEN others; with the words of the
    ``item`` and the ``corpus``, wider gaps are filled word by word. Of the chains that end in a run, the run alone among them, all are kept of which no other
    is at least as long with as many words to spare over MIN_SHARE. (item words spanned, of these verbatim, item start, corpus start, longest run), or None.
    """
    runs = sorted(runs)
    longest_run = max((n for _, _, n in runs), default=0)
    chains: list[list[tuple[int, int, int, int]]] = []  # (item start, verbatim, corpus start, longest run) of the chains that end here
    found = None
    for j, (p, q, n) in enumerate(runs):
        mine = [(q, n, p, n)]
        for i in range(j - 1, -1, -1):
            pi, qi, ni = runs[i]
            if pi + longest_run < p - MAX_BETWEEN:
                break
            lap = max(0, qi + ni - q, pi + ni - p)  # a word repeated at the seam stands in both runs
            if lap > 3 or n - lap < 2:
                continue
            skipped, between = q + lap - (qi + ni), p + lap - (pi + ni)
            filled: int | None = 0
            if not (0 <= skipped and 0 <= between <= MAX_BETWEEN):
                continue
            if skipped > MAX_ALTERED:
                if item is None or corpus is None or skipped > MAX_BETWEEN:
                    continue
                filled = _filled(list(item[qi + ni : q + lap]), list(corpus[pi + ni : p + lap]))
            if filled is not None:
                mine += [(start, verbatim + filled + n - lap, at, max(longest, n)) for start, verbatim, at, longest in chains[i]]
        best, spare = [], None
        for chain in sorted(mine, key=lambda c: (c[0], -c[1])):  # the longest first
            over = chain[1] - MIN_SHARE * (q + n - chain[0])
            if spare is None or over > spare:
                best.append(chain)
                spare = over
        chains.append(best)
        for start, verbatim, at, longest in best:
            span = q + n - start
            if span >= min_words and verbatim >= MIN_SHARE * span and (found is None or span > found[0]):
                found = (span, verbatim, start, at, longest)
    return found


_RESULT = "doc_id long, item_id long, words long, verbatim long, longest_run long, item_start long, doc_start long"

_loaded: dict[str, TestIndex] = {}


def _index(path: str, width: int) -> TestIndex:
    """The block of items in a file, the last one of each worker kept."""
    if path not in _loaded:
        system, at = filesystem(path)
        with system.open_input_file(at) as f:
            rows = pq.read_table(f, columns=["item_id", "text"])
        _loaded.clear()
        _loaded[path] = TestIndex(list(zip(rows["item_id"].to_pylist(), rows["text"].to_pylist(), strict=True)), width)
    return _loaded[path]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[pa.RecordBatch], list[list[str]]]]:
    """Batches, with the tokens of their texts (column 1), together of about SHARD_WORDS."""
    held, tokens, n = [], [], 0
    for batch in batches:
        held.append(batch)
        for text in batch.column(1).to_pylist():
            tokens.append(_TOKEN.findall(text or ""))
            n += len(tokens[-1])
        if n >= SHARD_WORDS:
            yield held, tokens
            held, tokens, n = [], [], 0
    if held:
        yield held, tokens


def _item_blocks(items: DataFrame) -> list[str]:
    """The items written to the shared folder in files of about BLOCK_WORDS words; the files."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null").distinct()
    words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    return materialize(rows.repartition(-(-words // BLOCK_WORDS) or 1, "item_id"), "items").inputFiles()


def find_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Each document and item of which the document holds a passage: doc_id, item_id, words, verbatim, longest_run, item_start, doc_start.

    ``documents``: doc_id, text; ``items``: item_id, text; other columns are ignored. A passage is at least ``min_words`` consecutive words of the item. Case,
    accents, punctuation and hyphenation do not count; altered or missing words may
    stand between verbatim runs, and up to MAX_BETWEEN foreign words (headers, paragraph numbers).
    ``words`` is the length of the longest passage, item_start and doc_start count words.
    Null or empty texts and rows without id match nothing; repeated documents give a row each, as do repeated items with different ids.
    The items are written to the shared folder in blocks of at most about BLOCK_WORDS words, each read by the tasks and compared with every shard of the documents.
    """
    blocks = _item_blocks(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, tokens in _shards(batches):
            keys = [k for b in held for k in b.column(0).to_pylist()]
            out = []
            for path in blocks:
                test = _index(path, min_words)
                found = _Shard(test, [test.number(t) if k is not None else np.empty(0, np.int32) for k, t in zip(keys, tokens, strict=True)], min_words).leaks(min_words)
                out += [(keys[doc], int(test.keys[item]), *rest) for doc, item, *rest in found]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "words", "verbatim", "longest_run", "item_start", "doc_start"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _RESULT)


def remove_leaks(documents: DataFrame, items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents, with all their columns, without those that hold a passage of an item (see :func:`find_leaks`).

    Documents are searched and dropped in one pass, without a join; rows without id are judged like others. Null and empty texts stay.
    """
    blocks = _item_blocks(items)
    order = ["doc_id", "text", *[c for c in documents.columns if c not in ("doc_id", "text")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, tokens in _shards(batches):
            clean = np.ones(len(tokens), bool)
            for path in blocks:
                test = _index(path, min_words)
                clean[[doc for doc, *_ in _Shard(test, [test.number(t) for t in tokens], min_words).leaks(min_words)]] = False
            at = 0
            for batch in held:
                yield batch.filter(pa.array(clean[at : at + batch.num_rows]))
                at += batch.num_rows

    rows = documents.select(*[F.col(f"`{c}`") for c in order])
    return rows.mapInArrow(run, rows.schema).select(*[F.col(f"`{c}`") for c in documents.columns])
