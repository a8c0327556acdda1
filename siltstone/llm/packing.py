"""Filling fixed-capacity containers with whole texts.

Karmarkar-Karp multiway differencing: every item starts as a partition of its own, one
window holding it and the others empty; the two partitions with the largest
imbalance are merged with their windows in opposing order, until one is left. Its
windows are nearly equal. The number of windows starts at the least that could do and rises
while the fullest one exceeds the capacity.
"""

from __future__ import annotations

import base64
import bisect
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

#: Windows merged together in one differencing; each merge costs in proportion to it.
WINDOWS = 64
#: Documents of one task's group. A group's last windows are its only loss, so larger is tighter.
GROUP_DOCUMENTS = 8192

#: Where the vocabulary files are; a parameter of the operators.
TOKENIZERS = os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-tokenization pattern of the byte-level BPE vocabulary.
BYTE_BPE_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_encodings: dict = {}


def _encoding(path: str):
    """The tokenizer of a ``.tiktoken`` rank file; one per Python worker."""
    if path not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path] = tiktoken.Encoding("packing", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path]


def count_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """key, n_tokens of each text (whole, however long). A null text has 0 tokens, like an empty one; a row without key is no text and left out."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(vocabulary).encode_ordinary
        for f in frames:
            yield pd.DataFrame({key: f[key], "n_tokens": [len(encode(t)) if t else 0 for t in f[text]]})

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(key, text).where(F.col(key).isNotNull()).mapInPandas(count, f"{key} {kind}, n_tokens long")


def _differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp differencing of items into k windows; the items' numbers by window.

    A partial partition is kept as the sums of its windows that hold something, in order, with the trees of what they hold; the others are empty.
    """
    heap: list[tuple] = [(-s, i, [s], [i]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        both = max(0, len(a) + len(b) - k)  # windows that must be put together: the smallest of one with the largest of the other; the rest meet empty ones
        sums = a[both:] + b[both:] + [p + q for p, q in zip(a[:both], reversed(b[:both]), strict=True)]
        trees = x[both:] + y[both:] + list(zip(x[:both], reversed(y[:both]), strict=True))
        by = sorted(range(len(sums)), key=sums.__getitem__)
        sums = [sums[j] for j in by]
        heapq.heappush(heap, ((sums[0] if len(sums) == k else 0) - sums[-1], order, sums, [trees[j] for j in by]))
        order += 1
    windows = []
    for tree in heap[0][3]:
        found, stack = [], [tree]
        while stack:
            t = stack.pop()
            if isinstance(t, tuple):
                stack += t
            else:
                found.append(t)
        windows.append(found)
    return windows + [[] for _ in range(k - len(windows))]


def _relieved(windows: list[list[int]], sizes: list[int], capacity: int, all_of_them: bool = True) -> list[list[int]] | None:
    """The windows after those above capacity have given an item to, or exchanged one with, windows that have the room.

    If one can't be relieved: None, or with ``all_of_them`` unset it stays as it is.
    """
    held = [sorted((sizes[i], i) for i in w) for w in windows]
    used = [sum(s for s, _ in w) for w in held]
    for over in sorted(range(len(held)), key=lambda w: -used[w]):
        while used[over] > capacity:
            excess, best = used[over] - capacity, None
            for other, u in enumerate(used):
                room = capacity - u
                if other == over or room < excess:
                    continue
                there = held[other]
                for a in held[over]:
                    least = a[0] - excess  # what comes back may be so large at most
                    if least < 0:
                        continue
                    j = bisect.bisect_right(there, (least, len(sizes))) - 1
                    b = there[j] if j >= 0 else None
                    d = a[0] - (b[0] if b else 0)
                    if d <= room and (best is None or d < best[0]):
                        best = (d, other, a, b)
                if best and best[0] == excess:
                    break
            if best is None:
                if all_of_them:
                    return None
                break
            d, other, a, b = best
            held[over].remove(a)
            bisect.insort(held[other], a)
            if b is not None:
                held[other].remove(b)
                bisect.insort(held[over], b)
            used[over] -= d
            used[other] += d
    return [[i for _, i in w] for w in held if w]


def _fitting(sizes: list[int], capacity: int) -> list[list[int]]:
    """The fewest windows that differencing, with exchanges from windows above capacity, manages."""
    if not sizes:
        return []
    k = max(1, -(-sum(sizes) // capacity))
    low, best, step = k, None, 1
    while best is None:  # rise until it fits
        best = [[i] for i in range(len(sizes))] if k >= len(sizes) else _relieved(_differencing(sizes, k), sizes, capacity)
        if best is None:
            low, k, step = k + 1, min(len(sizes), k + step), step * 2
    high = len(best)
    while low < high:  # then back to the least that fits
        k = (low + high) // 2
        found = _relieved(_differencing(sizes, k), sizes, capacity)
        if found is None:
            low = k + 1
        else:
            best, high = found, min(k, len(found))
    return best


def _filled(sizes: list[int], capacity: int, well_filled: float) -> tuple[list[list[int]], list[int]]:
    """Difference into the least number of windows, keep those that fit and are well filled, and again with the rest; (kept, left over)."""
    left, kept = list(range(len(sizes))), []
    while left:
        k = -(-sum(sizes[i] for i in left) // capacity)
        own = [sizes[i] for i in left]
        found = [[left[j] for j in w] for w in _relieved(_differencing(own, k), own, capacity, False)]
        good = [w for w in found if well_filled * capacity <= sum(sizes[i] for i in w) <= capacity]
        if not good:
            break
        kept += good
        taken = {i for w in good for i in w}
        left = [i for i in left if i not in taken]
    return kept, left


#: Shares of the capacity from which on a window is kept, pass by pass.
PASSES = (0.995, 0.99, 0.985, 0.98, 0.97)


def pack_sizes(sizes: np.ndarray, capacity: int, windows: int = WINDOWS) -> np.ndarray:
    """The window number of each item; every size must be from 1 to ``capacity``.

    Items are dealt by size into groups of about ``windows`` windows with the same mix,
    and each group is differenced by itself, in two ways of which the one with fewer windows
    counts. Differencing into the least number of windows leaves them around the capacity,
    some just above: either the number rises until all fit; or, in each of several passes, the
    well-filled ones that fit are kept and the items of all others are pooled and dealt
    anew, before what is left is spread over as many windows as it takes.
    """
    ways = [_packed(sizes, capacity, windows, shares) for shares in ((), PASSES)]
    return min(ways, key=lambda numbers: numbers.max(initial=-1))


def _packed(sizes: np.ndarray, capacity: int, windows: int, shares: tuple[float, ...]) -> np.ndarray:
    out = np.zeros(len(sizes), np.int64)
    number, pool = 0, np.argsort(-sizes, kind="stable")
    for share in (*shares, None):
        if not len(pool):
            break
        groups = max(1, int(round(sizes[pool].sum() / (windows * capacity))))
        rest = []
        for g in range(groups):
            own = pool[g::groups]
            own_sizes = sizes[own].tolist()
            kept, left = (_fitting(own_sizes, capacity), []) if share is None else _filled(own_sizes, capacity, share)
            for window in kept:
                out[own[window]] = number
                number += 1
            rest.append(own[left])
        pool = np.concatenate(rest).astype(np.int64)
        pool = pool[np.argsort(-sizes[pool], kind="stable")]
    return out


def pack_documents(tokens: DataFrame, capacities: list[tuple[str, int]], key: str = "doc_id", group_documents: int = GROUP_DOCUMENTS) -> DataFrame:
    """Place every text in containers of each capacity.

    ``tokens``: key (unique), n_tokens. Gives pack_name, container, key, part, first_token,
    n_tokens, offset: tokens first_token .. first_token + n_tokens of the text stand at offset of the container.
    Only a text longer than the capacity is split: into full containers and a rest that
    is placed like any other text. Texts without tokens (null or empty) get one row with
    container null. Groups of about ``group_documents`` texts, by hash of the key, are packed
    independently; with the mix of sizes alike in all, this loses at most a window per group.
    """
    groups = max(1, round(tokens.count() / group_documents))
    kind = tokens.schema[key].dataType.simpleString()
    schema = f"pack_name string, container string, {key} {kind}, part int, first_token long, n_tokens long, offset long"

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(key, kind="stable")
        group, keys, n = int(frame["grp"].iloc[0]), frame[key].to_numpy(), frame["n_tokens"].fillna(0).to_numpy(np.int64)
        out = []
        for name, capacity in capacities:
            empty = np.flatnonzero(n <= 0)
            out.append(pd.DataFrame({"pack_name": name, "container": None, key: keys[empty], "part": 0, "first_token": 0, "n_tokens": 0, "offset": 0}))
            full = np.where(n > capacity, n // capacity, 0)
            owner = np.repeat(np.arange(len(n)), full)
            part = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
            out.append(pd.DataFrame({"pack_name": name, "container": [f"{group}-f{i}" for i in range(len(owner))], key: keys[owner], "part": part, "first_token": part * capacity, "n_tokens": capacity, "offset": 0}))
            rest = n - full * capacity
            at = np.flatnonzero(rest > 0)
            number = pack_sizes(rest[at], capacity)
            placed = pd.DataFrame({"number": number, key: keys[at], "part": full[at], "first_token": full[at] * capacity, "n_tokens": rest[at]}).sort_values(["number", key], kind="stable")
            placed["offset"] = placed.groupby("number")["n_tokens"].cumsum() - placed["n_tokens"]
            placed["container"] = [f"{group}-w{i}" for i in placed.pop("number")]
            out.append(placed.assign(pack_name=name))
        columns = ["pack_name", "container", key, "part", "first_token", "n_tokens", "offset"]
        return pd.concat([o[columns] for o in out if len(o)] or [out[0][columns]])

    keyed = tokens.select(F.pmod(F.xxhash64(key), F.lit(groups)).cast("int").alias("grp"), key, "n_tokens")
    return keyed.repartitionByRange(groups, "grp").groupBy("grp").applyInPandas(pack, schema)


def packing_report(packed: DataFrame, tokens: DataFrame, capacities: list[tuple[str, int]], key: str = "doc_id") -> DataFrame:
    """Whether a packing keeps to its rules: pack_name, texts, whole, within, unsplit.

    ``whole``: the parts of every text follow each other and hold each of its ``tokens`` once; ``within``: no container holds more than its
    capacity; ``unsplit``: only texts longer than that are in parts. A text that is missing counts against ``whole``.
    """
    room = F.create_map(*[F.lit(x) for c in capacities for x in c])
    wanted = tokens.select(key, F.col("n_tokens").alias("wanted"), F.explode(room).alias("pack_name", "capacity"))
    parts = packed.groupBy("pack_name", key).agg(F.sum("n_tokens").alias("n"), F.max(F.col("first_token") + F.col("n_tokens")).alias("last"), F.count(F.lit(1)).alias("parts"), F.countDistinct("first_token").alias("places"))
    texts = wanted.join(parts, ["pack_name", key], "left")
    whole = F.coalesce((F.col("n") == F.col("wanted")) & (F.col("last") == F.col("wanted")) & (F.col("places") == F.col("parts")), F.lit(False))
    judged = texts.groupBy("pack_name", "capacity").agg(F.count(F.lit(1)).alias("texts"), F.bool_and(whole).alias("whole"), F.bool_and(F.coalesce((F.col("parts") == 1) | (F.col("wanted") > F.col("capacity")), F.lit(False))).alias("unsplit"))
    used = packed.where("container is not null").groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("used")).groupBy("pack_name").agg(F.max("used").alias("most"))
    return judged.join(used, "pack_name", "left").select("pack_name", "texts", "whole", F.coalesce(F.col("most") <= F.col("capacity"), F.lit(True)).alias("within"), "unsplit")


def fill_report(packed: DataFrame, capacities: list[tuple[str, int]]) -> DataFrame:
    """pack_name, containers, texts, tokens, fill (share of the containers' room that is used), fullest."""
    room = packed.sparkSession.createDataFrame(capacities, "pack_name string, capacity int")
    by = packed.where("container is not null").groupBy("pack_name", "container").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("texts"))
    total = by.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("texts").alias("texts"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    return total.join(room, "pack_name").select("pack_name", "containers", "texts", "tokens", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"), "fullest")


def pack_texts(documents: DataFrame, capacities: list[tuple[str, int]], vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """Count the tokens of ``documents`` (doc_id, text) and place them; see :func:`pack_documents`."""
    return pack_documents(materialize(count_tokens(documents, vocabulary=vocabulary), "tokens"), capacities)
