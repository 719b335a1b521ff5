"""Benchmark decontamination by greedy string tiling.

Texts are compared as word hashes (letters and digits, lower case; punctuation is ignored).
Documents and benchmark items that share a five-word seed are joined, by a hash join whose build
side is a block of the benchmark. Each pair is tiled: the longest match of words that no tile
holds yet becomes a tile, again and again until none of five words is left (of equally long ones
the first in the item, then in the document). Running Karp-Rabin hashes of all windows of a length
tell whether there is a match of it, and as a match holds shorter ones, bisection finds the
greatest length: time and memory follow the two texts, never the number of pairs of equal seeds.
An item's coverage is the share of its words in tiles, so passages in another order still count.
At ``THRESHOLD`` the document is contaminated.

The benchmark goes to the executors in blocks of at most ``BLOCK_BYTES`` of text, each block
against all documents: a benchmark of any size is scanned with bounded memory, and documents
are never shuffled.

Defined results: null or empty texts match nothing; an item of fewer than five words matches
only as a whole; repeated items and repeated documents give a row each; empty tables give an
empty result; extra columns are ignored (``drop_contaminated`` keeps them).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_texts, map_slices, table
from .hashing import WindowHashes, shingle_hashes, word_hashes

SEED = 5
THRESHOLD = 0.8
BLOCK_BYTES = 32 << 20


class Index:
    """Seeds of a block of benchmark items, each with the items that hold it."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.items = [(i, word_hashes(t, letters=True)) for i, t in items]
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        grouped: dict[int, list[tuple[np.ndarray, int]]] = {}
        for k, (_, words) in enumerate(self.items):
            if len(words):
                size = min(SEED, len(words))
                grouped.setdefault(size, []).append((np.unique(shingle_hashes(words, size)), k))
        for size, parts in grouped.items():
            seed = np.concatenate([s for s, _ in parts])
            item = np.concatenate([np.full(len(s), k) for s, k in parts])
            order = np.argsort(seed, kind="stable")
            self.seeds[size] = (seed[order], item[order])

    def shared(self, words: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(item, places in the document of the seeds that it shares with it)."""
        found = []
        for size, (seed, item) in self.seeds.items():
            if len(words) < size:
                continue
            own = shingle_hashes(words, size)
            lo = np.searchsorted(seed, own)
            hit = np.flatnonzero(seed[np.minimum(lo, len(seed) - 1)] == own)
            if len(hit):
                distinct = np.unique(own[hit])
                a, z = np.searchsorted(seed, distinct), np.searchsorted(seed, distinct, side="right")
                items = np.unique(np.concatenate([item[x:y] for x, y in zip(a.tolist(), z.tolist())]))
                for k in items.tolist():
                    mine = np.unique(shingle_hashes(self.items[k][1], size))
                    at = np.minimum(np.searchsorted(mine, own[hit]), len(mine) - 1)
                    found.append((k, hit[mine[at] == own[hit]]))
        return found


def _runs(free: np.ndarray) -> np.ndarray:
    """How many free places follow from each place on."""
    n = len(free)
    taken = np.where(free, n, np.arange(n))
    return np.minimum.accumulate(taken[::-1])[::-1] - np.arange(n)


def tiles(item: np.ndarray, doc: np.ndarray, size: int, places: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (place in the document, place in the item, length).

    ``places`` are those in the document where a seed of ``size`` words is shared, if known: only
    words of seeds can be in tiles."""
    free_item, free_doc = np.ones(len(item), bool), np.ones(len(doc), bool)
    if places is not None:
        step = np.zeros(len(doc) + 1, np.int64)
        np.add.at(step, places, 1)
        np.add.at(step, places + size, -1)
        free_doc = np.cumsum(step[:-1]) > 0
    near, far = WindowHashes(item), WindowHashes(doc)
    run_item, run_doc = _runs(free_item), _runs(free_doc)

    def match(length: int) -> tuple[int, int] | None:
        q, p = np.flatnonzero(run_item >= length), np.flatnonzero(run_doc >= length)
        if not len(q) or not len(p):
            return None
        x, y = near.of(q, length), far.of(p, length)
        order = np.argsort(y, kind="stable")
        at = np.minimum(np.searchsorted(y, x, sorter=order), len(p) - 1)
        hit = np.flatnonzero(y[order[at]] == x)
        return (int(p[order[at[hit[0]]]]), int(q[hit[0]])) if len(hit) else None

    out, most = [], min(len(item), len(doc))
    while most >= size:
        found, length = match(most), most
        if found is None:  # the greatest length in [size, most) with a match
            low, high, length = size, most, 0
            while low < high:
                middle = (low + high) // 2
                if (here := match(middle)) is not None:
                    found, length, low = here, middle, middle + 1
                else:
                    high = middle
        if found is None:
            return out
        p, q = found
        out.append((p, q, length))
        free_doc[p : p + length] = free_item[q : q + length] = False
        run_item, run_doc, most = _runs(free_item), _runs(free_doc), length
    return out


def _coverage(index: Index, text: str | None) -> list[tuple[int, int, int]]:
    """(item, words, words in tiles) of the items that share a seed."""
    words = word_hashes(text, letters=True)
    out = []
    for k, places in index.shared(words):
        item = index.items[k][1]
        size = min(SEED, len(item))
        # Only the stretches of shared seeds are tiled, with a gap between them.
        out.append((k, len(item), sum(t[2] for t in tiles(item, *_stretches(words, places, size)))))
    return out


def _stretches(words: np.ndarray, places: np.ndarray, size: int) -> tuple[np.ndarray, int, np.ndarray]:
    """The words of the seeds at ``places`` (ascending), ``size``, and the places in these words."""
    step = np.diff(places, prepend=places[0])
    moved = np.cumsum(np.minimum(step, size + 1))
    out = np.zeros(int(moved[-1]) + size, words.dtype)
    for i in range(size):
        out[moved + i] = words[places + i]
    return out, size, moved


def _blocks(benchmark: DataFrame) -> Iterator[Index]:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = max(1, math.ceil(total / BLOCK_BYTES))
    for b in range(many):
        part = benchmark if many == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(many)) == b)
        yield Index([(r[0], r[1]) for r in part.select("item_id", "text").collect()])


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, item_words, tiled_words, coverage, contaminated of each pair that shares a seed."""
    kinds = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    kind = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_words long, tiled_words long"
    out = None
    for index in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value
            for b in batches:
                rows = [(d, index.items[k][0], n, m) for d, t in zip(b["doc_id"], b["text"]) for k, n, m in _coverage(index, t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_words", "tiled_words"])

        part = map_slices(docs.select("doc_id", "text"), run, kind)
        out = part if out is None else out.unionByName(part)
    share = F.col("tiled_words") / F.col("item_words")
    return out.withColumn("coverage", share).withColumn("contaminated", F.col("coverage") >= threshold)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of which no item is covered to ``threshold``, with all their columns."""
    for index in _blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = keep_texts(docs, lambda text, shared=shared: all(m < threshold * n for _, n, m in _coverage(shared.value, text)))
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
