"""Packing: every token once, nothing above capacity, little room left, texts whole."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import packing

CAPACITIES = [("short", 64), ("long", 256)]


@pytest.mark.parametrize("sizes", [[], [1], [100], [60, 40, 60, 40], [51] * 9, [100] * 5, list(range(1, 101)), [1] * 500])
def test_pack_sizes(sizes):
    got = packing.pack_sizes(np.array(sizes, np.int64), 100, windows=8)
    used = np.bincount(got, weights=sizes) if len(sizes) else np.array([])
    assert len(got) == len(sizes) and (used <= 100).all() and (used > 0).all()
    if sizes == [51] * 9:
        assert len(used) == 9
    if sizes == [60, 40, 60, 40]:
        assert len(used) == 2


def test_fill_of_random_sizes():
    sizes = np.random.default_rng(1).integers(1, 400, 4000)
    used = np.bincount(packing.pack_sizes(sizes, 1000), weights=sizes)
    assert used.max() <= 1000 and sizes.sum() / (len(used) * 1000) > 0.98


def test_differencing_balances():
    windows = packing._differencing([8, 7, 6, 5, 4], 2)
    assert sorted(i for w in windows for i in w) == list(range(5))
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in windows) in ([14, 16], [15, 15])


@pytest.mark.skipif(not os.path.exists(packing.TOKENIZERS), reason="no vocabulary files here")
def test_texts(spark):
    texts = [(1, None, 5), (2, "", 5), (3, "word " * 1000, 5), (4, "word " * 40, 5), (5, "x" * 300_000, 5), (None, "lost key", 5)] + [(10 + i, "some words of text " * (i % 23), 5) for i in range(300)]
    documents = spark.createDataFrame(texts, "doc_id long, text string, n_tokens int").repartition(3)
    tokens = packing.count_tokens(documents).toPandas().set_index("doc_id")["n_tokens"]
    assert len(tokens) == 305 and tokens[1] == tokens[2] == 0 and tokens[3] >= 1000
    got = packing.pack_texts(documents, CAPACITIES).toPandas()
    for name, capacity in CAPACITIES:
        own = got[got.pack_name == name]
        assert set(own.doc_id) == set(tokens.index)
        assert own[own.n_tokens == 0].container.isna().all() and (own[own.n_tokens > 0].container.notna()).all()
        real = own[own.n_tokens > 0].sort_values(["doc_id", "part"])
        assert (real.groupby("container").n_tokens.sum() <= capacity).all()
        for doc, parts in real.groupby("doc_id"):
            assert parts.n_tokens.sum() == tokens[doc] and (parts.first_token.to_numpy() == np.concatenate([[0], np.cumsum(parts.n_tokens)[:-1]])).all()
            assert len(parts) == 1 or tokens[doc] > capacity
            assert (parts.n_tokens.iloc[:-1] == capacity).all()
        for _, c in real.groupby("container"):
            c = c.sort_values("offset")
            assert (c.offset.to_numpy() == np.concatenate([[0], np.cumsum(c.n_tokens)[:-1]])).all()
    report = packing.fill_report(packing.pack_texts(documents, CAPACITIES), CAPACITIES).toPandas()
    assert (report.fill > 0.9).all()
    assert packing.pack_texts(documents.where(F.lit(False)), CAPACITIES).count() == 0
