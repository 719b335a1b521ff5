"""Exact Jaccard self-join on word n-grams: a size-aware heavy-light join.

*Light* sets (up to a boundary) enumerate the subsets that a partner must share: all subsets
that leave out at most ``(1 - t) * n`` shingles. *Heavy* sets scan inverted lists of single
shingles: with all shingles in one order, linked sets share one of the first ``n - ceil(t * n) + 1``
of each (prefix filter), so a set is in the lists of these only, and partners must be near in size.
Any order is exact; the one used puts shingles first that are rare in the corpus by a count over
all texts in ``COUNTERS`` hashed counters, so that lists are short. The counters merge by addition
and their size is fixed, whatever the corpus. The boundary is the size of least estimated cost
over the histogram of set sizes.

Equal sets are one node. In a few rounds each node is compared with one pivot of its lists;
nodes that this connects need no more looks at each other. Lists that still hold several
components compare across components only: short lists by a join, long ones by parity bitmaps
(a lower bound of the difference) in square blocks, of which each node's closest partners come
first and the others only where these did not connect the components. What passes is counted
exactly on the whole sets. Links become components by hooks and jumps.

A node is named by 63 bits of its set; a name that two different sets share (their 32 more bits
tell) is drawn again from all 95 bits, and a set is always fetched by its name, never by ``doc_id``.

Defined results: a null text or one without words has an empty set, is linked with nothing and
is its own component; rows with equal sets (repeated rows too) share a component; rows of one
``doc_id`` with different texts are judged one by one, in any order of rows; a null ``doc_id``
keeps its row and never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_slices, materialize
from .components import components
from .hashing import mix, shingle_hashes, word_hashes

WORDS = 3
PERCENT = 90
#: Counters of shingles, and tasks that add them up before the last one.
COUNTERS = 1 << 20
MERGERS = 32
#: Largest boundary that is considered, and the weight of looking at a heavy list entry.
MOST_LIGHT = 40
HEAVY_WEIGHT = 3.0
#: Nodes of a list that one task compares with as many others.
BLOCK = 512
#: Lists up to this length are paired by a join.
SHORT = 16
#: Rounds in which each node looks at one pivot, before components are compared; and how many partners
#: a node of a long list is first compared with in another component (more if that leaves some out).
STARS = 2
MOST = 2
_U = np.uint64


class Scheme:
    """Numbers that follow from the threshold and the boundary."""

    def __init__(self, percent: int, boundary: int):
        self.t = Fraction(percent, 100)
        self.boundary = boundary
        self.percent = percent

    def light(self, n: int) -> bool:
        return 0 < n <= self.boundary / self.t

    def heavy(self, n: int) -> bool:
        return n > self.boundary

    def left_out(self, n: int) -> int:
        return math.floor((1 - self.t) * n)

    def prefix(self, n: int) -> int:
        """Shingles of a heavy set of size n that have it in their lists."""
        return n - math.ceil(self.t * n) + 1

    def cost(self, n: int) -> tuple[float, float]:
        light = sum(math.comb(n, i) for i in range(self.left_out(n) + 1)) if n <= 2 * MOST_LIGHT else math.inf
        heavy = HEAVY_WEIGHT * self.prefix(n)
        return light, heavy


def boundary(sizes: dict[int, int], percent: int) -> int:
    """The boundary of least cost; ``sizes`` counts the sets of up to MOST_LIGHT / t shingles."""
    best = None
    for x in range(MOST_LIGHT + 1):
        s = Scheme(percent, x)
        total = 0.0
        for n, c in sizes.items():
            light, heavy = s.cost(n)
            total += c * ((light if s.light(n) else 0) + (heavy if s.heavy(n) else 0))
        if best is None or total < best[0]:
            best = (total, x)
    return best[1]


def shingle_set(text: str | None, k: int) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(text), k))


def node_of(s: np.ndarray, bits: int = 63) -> tuple[int, int]:
    """A name for the set, from a hash over its sorted shingles and size, and 32 bits of another one."""
    if not len(s):
        return 0, 0
    h = mix(s + np.arange(1, len(s) + 1, dtype=_U) * _U(0x9E3779B97F4A7C15))
    one, two = h.sum(dtype=_U) ^ _U(len(s)), mix(h ^ _U(0x3C3C3C3C)).sum(dtype=_U)
    x, y = mix(np.array([one, two], _U)).tolist()
    return x >> (64 - bits), y >> 33


def parity(s: np.ndarray) -> bytes:
    """Parity bitmap of about four bits a shingle. Sets that differ in D shingles have bitmaps
    that differ in D bits at most; a bitmap of half the size is the exclusive or of its halves."""
    bits = 1 << max(8, (4 * len(s) - 1).bit_length() if len(s) else 0)
    at = (mix(s ^ _U(0xA5A5A5A5)) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def _fold(bitmap: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(bitmap, np.uint8)
    while len(x) > size:
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return x


def _counter(s: np.ndarray) -> np.ndarray:
    return (mix(s ^ _U(0x5151)) & _U(COUNTERS - 1)).astype(np.int64)


def signatures(s: np.ndarray, scheme: Scheme, counts: np.ndarray) -> np.ndarray:
    """Keys of the lists that the set joins; ``counts`` says how frequent the shingles of a counter are."""
    n, out = len(s), []
    if scheme.light(n):
        d = scheme.left_out(n)
        m = mix(s)
        left = [(np.bitwise_xor.reduce(m[list(c)]), n - i) for i in range(d + 1) for c in combinations(range(n), i)]
        rest = np.array([x for x, _ in left], _U) ^ np.bitwise_xor.reduce(m)
        out.append(mix(rest ^ mix(np.array([z for _, z in left], _U))))
    if scheme.heavy(n):
        first = np.lexsort((s, counts[_counter(s)]))[: scheme.prefix(n)]
        out.append(mix(s[first] ^ _U(0x7777)))
    return np.unique(np.concatenate(out)) if out else np.empty(0, _U)


def _tally(k: int):
    """Counters of the shingles of the partition's texts, copies once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        total = np.zeros(COUNTERS, np.int64)
        for b in batches:
            found = [np.empty(0, _U)]
            for digest, text in zip(b["digest"], b["text"]):
                if digest not in seen:
                    found.append(shingle_hashes(word_hashes(text), k))
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(digest)
            total += np.bincount(_counter(np.concatenate(found)), minlength=COUNTERS)
        yield pd.DataFrame({"counts": [zlib.compress(total.tobytes(), 1)]})

    return run


def _add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(COUNTERS, np.int64)
    for b in batches:
        for packed in b["counts"]:
            total += np.frombuffer(zlib.decompress(packed), np.int64)
    yield pd.DataFrame({"counts": [zlib.compress(total.tobytes(), 1)]})


def frequencies(docs: DataFrame, k: int) -> np.ndarray:
    """A byte for each counter, eight steps for each doubling of its count: a megabyte for any corpus."""
    kind = "counts binary"
    each = map_slices(docs.select("digest", "text"), _tally(k), kind)
    whole = each.repartition(MERGERS).mapInPandas(_add, kind).repartition(1).mapInPandas(_add, kind).collect()
    total = sum((np.frombuffer(zlib.decompress(r.counts), np.int64) for r in whole), np.zeros(COUNTERS, np.int64))
    return np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8)


def _sets(k: int, scheme: Scheme, counts: np.ndarray, name_bits: int):
    """Size, name, bitmap and lists of each document's set; of copies within a partition one has the lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        none = np.empty(0, np.int64)
        for b in batches:
            rows = []
            for doc_id, digest, text in zip(b["doc_id"], b["digest"], b["text"]):
                s = shingle_set(text, k)
                node = node_of(s, name_bits)
                if len(seen) > 1_000_000:
                    seen.clear()
                rows.append((doc_id, digest, len(s), *node, parity(s), none if node in seen else signatures(s, scheme, counts).view(np.int64)))
                seen.add(node)
            yield pd.DataFrame(rows, columns=["doc_id", "digest", "n", "node", "check", "bits", "sigs"])

    return run


def _content(k: int, name_bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, k) for t in b["text"]]
            names = [node_of(s, name_bits) for s in sets]
            yield pd.DataFrame({"node": [x for x, _ in names], "check": [y for _, y in names], "s": [s.tobytes() for s in sets]})

    return run


def _most_apart(n, m, percent: int):
    """The most shingles in which linked sets of these sizes differ."""
    return (n + m) * (100 - percent) // (100 + percent)


def _plausible_pairs(percent: int):
    """Pairs (a, b) whose bitmaps allow a link."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for n, x, m, y in zip(b["na"], b["bits_a"], b["nb"], b["bits_b"]):
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum()) <= _most_apart(n, m, percent))
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _across(percent: int, most: int):
    """Plausible pairs between the components of one square block of a list. Of each pair of
    components every node of the smaller one gives its ``most`` closest partners; if there were
    more, a row (-1, -1) says so."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        left, right = part[part["side"] == 0], part[part["side"] == 1]
        out = [np.empty((5, 0), np.int64)]
        if len(left) and len(right):
            size = int(part["bits"].str.len().min())
            x = np.stack([_fold(v, size) for v in left["bits"]])
            y = np.stack([_fold(v, size) for v in right["bits"]])
            ln, rn = left["n"].to_numpy(), right["n"].to_numpy()
            ll, rl = left["label"].to_numpy(), right["label"].to_numpy()
            for i in range(len(x)):
                j = np.flatnonzero((rl != ll[i]) & (np.minimum(rn, ln[i]) * 100 >= np.maximum(rn, ln[i]) * percent))
                if len(j):
                    d = np.bitwise_count(y[j] ^ x[i]).sum(axis=1).astype(np.int64)
                    j, d = j[d <= _most_apart(rn[j], ln[i], percent)], d[d <= _most_apart(rn[j], ln[i], percent)]
                    out.append(np.stack((np.full(len(j), i), j, d, np.full(len(j), ll[i]), rl[j])))
        i, j, d, la, lb = np.concatenate(out, axis=1)
        if not len(i):
            return pd.DataFrame({"a": i, "b": j})
        lo, ro = left["node"].to_numpy()[i], right["node"].to_numpy()[j]
        sizes_a, sizes_b = dict(zip(*np.unique(ll, return_counts=True))), dict(zip(*np.unique(rl, return_counts=True)))
        own = np.array([sizes_a[p] <= sizes_b[q] for p, q in zip(la.tolist(), lb.tolist())])
        key, other = np.where(own, lo, ro), np.where(own, lb, la)
        order = np.lexsort((d, other, key))
        key, other, lo, ro = key[order], other[order], lo[order], ro[order]
        first = np.flatnonzero(np.append(True, (np.diff(key) != 0) | (np.diff(other) != 0)))
        rank = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
        keep = rank < most
        more = [] if keep.all() else [-1]
        return pd.DataFrame({"a": np.append(np.minimum(lo, ro)[keep], more).astype(np.int64), "b": np.append(np.maximum(lo, ro)[keep], more).astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in batches:
            held = b if held is None else pd.concat([held, b], ignore_index=True)
            keys = held[["sig", "bi", "bj"]].to_numpy()
            starts = np.append(0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1)
            for s, e in zip(starts[:-1], starts[1:]):
                yield one(held.iloc[s:e])
            held = held.iloc[starts[-1] :]
        if held is not None and len(held):
            yield one(held)

    return run


def _count(percent: int):
    """Pairs that are linked, by the exact size of the intersection."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keep = []
            for x, y in zip(b["sa"], b["sb"]):
                x, y = np.frombuffer(x, _U), np.frombuffer(y, _U)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.loc[np.array(keep, bool), ["a", "b"]]

    return run


class _Join:
    def __init__(self, docs: DataFrame, words: int, percent: int, name_bits: int = 63):
        self.docs, self.words, self.percent, self.name_bits = docs.select("doc_id", F.xxhash64("text").alias("digest"), "text"), words, percent, name_bits
        # Sizes of the small sets, by their words: all that the boundary depends on, and bounded.
        size = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), " ")) - (words - 1)
        most = math.ceil(MOST_LIGHT * 100 / percent)
        small = self.docs.where(F.length("text") < 60 * most).select(F.greatest(size, F.lit(1)).alias("n")).where(F.col("n") <= most).groupBy("n").count().collect()
        scheme = Scheme(percent, boundary({int(n): int(c) for n, c in small}, percent))
        kind = f"doc_id {dict(docs.dtypes)['doc_id']}, digest long, n long, node long, check long, bits binary, sigs array<long>"
        counts = frequencies(self.docs, words)
        self.sets = rows = materialize(map_slices(self.docs, _sets(words, scheme, counts, name_bits), kind), "sets")
        clash = rows.where("n > 0").groupBy("node").agg(F.min("check").alias("x"), F.max("check").alias("y")).where("x <> y").select("node", F.lit(True).alias("clash"))
        self.clash = materialize(clash, "clashes")
        self.clashes = not self.clash.isEmpty()
        self.rows = self._renamed(rows)
        # Every later step joins the nodes, so they are worked out once.
        nodes = self.rows.where("n > 0").groupBy("node").agg(F.min("n").alias("n"), F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "digest")).alias("row"), F.first("bits").alias("bits"))
        self.nodes = materialize(nodes, "nodes")

    def _renamed(self, rows: DataFrame) -> DataFrame:
        """Names that different sets share, drawn again."""
        if not self.clashes:
            return rows
        again = F.when(F.col("clash"), F.xxhash64("node", "check").bitwiseAND((1 << 63) - 1)).otherwise(F.col("node"))
        return rows.join(self.clash, "node", "left").withColumn("node", again).drop("clash")

    def links(self) -> DataFrame:
        """Links between nodes, enough to connect every component."""
        entries = self.rows.select(F.explode("sigs").alias("sig"), "node")
        # Written on their own: the shuffle of the counts is gone before that of the lists, and the engine splits a hot list.
        shared = materialize(entries.groupBy("sig").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("sig"), "shared")
        raw = materialize(entries.join(shared, "sig"), "lists")
        lists = materialize(raw.distinct(), "lists")
        discard(shared, raw)
        # Stars: each node looks at one pivot of another component, the one of most of its lists.
        # Pivots are drawn by a hash that is the same in all lists and new in each round.
        links, labels = None, None
        for turn in range(STARS):
            named = lists.withColumn("label", F.col("node")) if labels is None else lists.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            drawn = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "label", "node")
            ends = named.groupBy("sig").agg(F.min(drawn).alias("p"), F.min("label").alias("x"), F.max("label").alias("y"), F.max_by("node", "label").alias("far"), F.min_by("node", "label").alias("close")).where("x <> y")
            pivot = F.when(F.col("label") != F.col("p.label"), F.col("p.node")).when(F.col("label") != F.col("y"), F.col("far")).otherwise(F.col("close"))
            best = (named.join(ends, "sig").select("node", pivot.alias("pivot")).groupBy("node", "pivot").agg(F.count("*").alias("c"))
                    .groupBy("node").agg(F.max(F.struct("c", F.xxhash64("pivot", F.lit(turn)).alias("h"), "pivot")).alias("m")).select(F.least("m.pivot", "node").alias("a"), F.greatest("m.pivot", "node").alias("b")).distinct())
            pairs = materialize(self._plausible(best), "pairs")
            new = self._linked(pairs)
            discard(pairs)
            links = new if links is None else links.unionByName(new)
            if turn and new.isEmpty():
                break
            labels = components(links)
        most = MOST
        while True:
            new, more = self._between(lists, labels, most)
            links = links.unionByName(new)
            if not more:
                discard(lists)
                return links
            labels, most = components(links), most * 16

    def _between(self, lists: DataFrame, labels: DataFrame, most: int) -> tuple[DataFrame, bool]:
        """Links between components of a list, and whether there may be more of them."""
        named = lists.join(labels, "node", "left").select("sig", "node", F.coalesce("label", "node").alias("label"))
        mixed = named.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("m")).where("x <> y").select("sig", "m")
        open_ = named.join(mixed, "sig").join(self.nodes.select("node", "n"), "node")
        # Short lists pair their entries; the number of these pairs follows the number of lists.
        few = open_.where(F.col("m") <= SHORT)
        other = few.select("sig", F.col("node").alias("b"), F.col("label").alias("lb"), F.col("n").alias("nb"))
        near = (F.least("n", "nb") * 100 >= F.greatest("n", "nb") * self.percent) & (F.col("node") < F.col("b")) & (F.col("label") != F.col("lb"))
        short_pairs = few.join(other, "sig").where(near).select(F.col("node").alias("a"), "b").distinct()
        # Long lists go in square blocks: an entry is in all blocks of its row and column.
        long = open_.where(F.col("m") > SHORT).withColumn("nb", F.ceil(F.col("m") / BLOCK).cast("int"))
        long = long.withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
        others = F.sequence(F.lit(0), F.col("nb") - 1)
        place = F.explode(F.concat(
            F.transform(F.filter(others, lambda o: o >= F.col("own")), lambda o: F.struct(F.col("own").alias("bi"), o.alias("bj"), F.lit(0).alias("side"))),
            F.transform(F.filter(others, lambda o: o <= F.col("own")), lambda o: F.struct(o.alias("bi"), F.col("own").alias("bj"), F.lit(1).alias("side")))))
        dealt = long.select("sig", "node", "label", "n", place.alias("p")).select("sig", "node", "label", "n", "p.bi", "p.bj", "p.side")
        dealt = dealt.join(self.nodes.select("node", "bits"), "node")
        long_pairs = (dealt.repartition(F.col("sig"), F.col("bi"), F.col("bj")).sortWithinPartitions("sig", "bi", "bj")
                      .mapInPandas(_across(self.percent, most), "a long, b long"))
        pairs = materialize(self._plausible(short_pairs).unionByName(long_pairs).distinct(), "pairs")
        new, more = self._linked(pairs.where("a >= 0")), not pairs.where("a < 0").isEmpty()
        discard(pairs)
        return new, more

    def _plausible(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits_{x}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_plausible_pairs(self.percent), "a long, b long")

    def _linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are linked, as a table of their own."""
        if pairs.isEmpty():
            return materialize(pairs.limit(0), "links")
        used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        # One row of each node is read again; its set has the node's name, whatever else has the row's id.
        row = materialize(used.join(self.nodes.select("node", "row"), "node").select(F.col("row.doc_id").alias("_id"), F.col("row.digest").alias("_digest")).distinct(), "wanted")
        texts = self.docs.join(row, (F.col("digest") == F.col("_digest")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        content = self._renamed(map_slices(texts, _content(self.words, self.name_bits), "node long, check long, s binary")).drop("check")
        sets = materialize(content.dropDuplicates(["node"]), "content")
        side = lambda x: sets.select(F.col("node").alias(x), F.col("s").alias(f"s{x}"))
        links = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInPandas(_count(self.percent), "a long, b long"), "links")
        discard(row, sets)
        return links


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, name_bits: int = 63) -> DataFrame:
    """doc_id, n_shingles, component_id of every document. Fewer ``name_bits`` only cost time."""
    j = _Join(docs, words, percent, name_bits)
    labels = components(j.links())
    named = j.nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    least = named.groupBy("label").agg(F.min("rep").alias("component_id"))
    by_node = named.join(least, "label").select(F.col("node").alias("_node"), "component_id")
    rows = j.rows.select("doc_id", "n", "node")
    full = rows.where("n > 0").join(by_node, F.col("node") == F.col("_node"), "left").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    full = full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    found = materialize(full, "groups")
    discard(j.sets, j.clash, j.nodes)
    return found


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of linked ones, the one of least doc_id; documents without words
    stay. Where ids repeat, a row stays if any row of its id has the group's least id; of rows with
    equal doc_id and text one stays."""
    found = ngram_join(docs, words, percent)
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_keep")).distinct()
    kept = docs.join(keep, F.col("doc_id").eqNullSafe(F.col("_keep")), "left_semi")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.withColumn("_text", F.sha2("text", 256)).dropDuplicates(["doc_id", "_text"]).drop("_text")


def query(docs: DataFrame) -> DataFrame:
    return ngram_join(docs)
