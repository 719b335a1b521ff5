"""Exact removal of repeated byte strings, by rounds of ranks over ever fewer positions.

A byte goes if it lies in a string of ``length`` bytes that also starts at another place.
Prefix doubling ranks every position at offsets 1, 2, 4, ...; sorted rank pairs of all
positions are many times the corpus per round. Here, as in doubling, each round ranks what the
round before left open and unique ranks drop out, but the rounds start sparse and late, and a
rank is a fingerprint of its bytes instead of a pair of earlier ranks:

* *Round 1* ranks only anchors: the leftmost minimum of a 16-byte hash in each window of
  positions. Every string of ``length`` bytes holds the anchor of its first window together
  with ``SEED`` bytes after it, so a position whose anchors all have a unique rank (the
  fingerprint of those bytes) can't start a repeated string. Unique anchors drop out.
* *Later rounds* rank what is left in blocks of ``BLOCKS`` positions at growing offsets, as
  pairs: the ``core`` that all strings starting in the block share, and the ``whole`` that they
  cover. A unique core takes the block out; a repeated whole makes all of it repeated; else the
  block goes to the next round in smaller ones. At block size 1 both are the string itself.

Spark groups (rank, place) rows of each round; a rank is repeated if its least and greatest
place differ, which combines before the shuffle, so no group is ever held by one task. The
repeated ranks are written before they are joined back, so that the engine splits a hot rank.
Ranks that decide are fingerprints of 96 bits (with 10^13 open positions fewer than 0.001 wrong
ones are to be expected), as are the names of texts; those of anchors, which only lead to
candidates, have 64 bits. Whole copies of a text are found by digest; one stands for all. The
texts with repeated anchors are written once, in buckets by name: the rounds move ranks and
places to them and never shuffle a text. Every table of a round is deleted after its last use.

Defined results: a null text counts as empty; rows are compared by their texts, so a repeated
row is a copy; a null ``doc_id`` keeps its row; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir, writing
from .hashing import Fingerprints, gram_order, range_hashes, sliding_argmin

LENGTH = 400
GRAM = 16
BLOCKS = (64, 8, 1)
#: Bytes handled at once within a text: bounds a worker's memory.
SLICE = 1 << 20


def _shape(length: int) -> tuple[int, int]:
    """(window, seed): window - 1 + seed = length."""
    window = max(1, min(length - GRAM, length * 36 // 100))
    return window, length - window + 1


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and ranks of the anchors of a text."""
    window, seed = _shape(length)
    n = len(data)
    places, ranks = [], []
    for a in range(0, max(0, n - length + 1), SLICE):
        part = np.frombuffer(data, np.uint8, min(n - a, SLICE + length - 1), a)
        at = sliding_argmin(gram_order(part)[: len(part) - seed + 1], window)
        at = at[np.diff(at, prepend=-1) > 0]
        places.append(at + a)
        ranks.append(range_hashes(part, at, seed))
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, keep = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(ranks)[keep]


def open_blocks(data: bytes, repeated: np.ndarray, length: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks (first, last, base) of the positions that can start a repeated string, given the
    repeated anchors. A block holds positions with one anchor whose distances to it share a
    multiple of ``size``; ``base`` is where it would begin if no position were missing, so equal
    strings have equal blocks wherever they stand."""
    window, seed = _shape(length)
    n = len(data)
    known = np.zeros(n, bool)
    known[repeated] = True
    out = [np.empty((3, 0), np.int64)]
    for a in range(0, max(0, n - length + 1), SLICE):
        part = np.frombuffer(data, np.uint8, min(n - a, SLICE + length - 1), a)
        at = sliding_argmin(gram_order(part)[: len(part) - seed + 1], window)
        i = np.flatnonzero(known[at + a])
        if not len(i):
            continue
        base = at[i] - (at[i] - i) // size * size - (size - 1)
        edge = np.flatnonzero(np.diff(base, prepend=base[0] - 1) | (np.diff(i, prepend=i[0] - 1) != 1))
        out.append(np.stack((i[edge], i[np.append(edge[1:], len(i)) - 1], base[edge])) + a)
    return tuple(np.concatenate(out, axis=1))


def _ranks(data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (64 bits, 32 more) of data[start:end] (each at most SLICE long), in the order given.

    Blocks ascend by ``first``, but their starts need not: a block whose anchor comes into the
    window late begins before the one that it cuts short. So the slices go by sorted starts."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], end[order]
    ranks, more = np.empty(len(s), np.uint64), np.empty(len(s), np.uint32)
    i = 0
    while i < len(s):
        a = int(s[i])
        j = int(np.searchsorted(s, a + SLICE))
        z = int(e[i:j].max())
        f = Fingerprints(np.frombuffer(data, np.uint8, z - a, a))
        ranks[i:j], more[i:j] = f.wide(s[i:j] - a, e[i:j] - a)
        i = j
    back = np.argsort(order)
    return ranks[back], more[back]


def _positions(flat) -> np.ndarray:
    return np.asarray(flat if flat is not None else [], np.int64)


def _emit_anchors(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()  # copies within the partition add no place
        for b in batches:
            out = [np.empty((4, 0), np.int64)]
            for key, more, text in zip(b["key"], b["key2"], b["text"]):
                if (key, more) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add((key, more))
                at, rank = anchors(text.encode(), length)
                out.append(np.stack((rank.view(np.int64), np.full(len(at), key), np.full(len(at), more), at)))
            rank, key, more, at = np.concatenate(out, axis=1)
            yield pd.DataFrame({"rank": rank, "key": key, "key2": more.astype(np.int32), "at": at.astype(np.int32)})

    return run


_RANKED = "rank long, rank2 int, key long, key2 int, first int, last int, base int, whole int"


def _emit_blocks(length: int, size: int, before: int | None):
    """Ranks of the open blocks: whole 0 for the core, 1 for the whole. Blocks come from repeated anchors, or from blocks of ``before``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [np.empty((8, 0), np.int64)]

            def add(ranks, f, z, s, whole):
                (rank, more), many = ranks, len(f)
                out.append(np.stack((rank.view(np.int64), more.view(np.int32), np.full(many, key), np.full(many, key2), f, z, s, np.full(many, whole))))

            for r in b.itertuples(index=False):
                key, key2, data = r.key, r.key2, r.text.encode()
                if before is None:
                    f, z, s = open_blocks(data, _positions(r.at), length, size)
                else:
                    f, z, s = _split(_positions(r.first), _positions(r.last), _positions(r.base), before, size)
                if not len(f):
                    continue
                add(_ranks(data, s + size - 1, s + length), f, z, s, 0)
                inside = (s >= 0) & (s + size - 1 + length <= len(data))
                if size > 1 and inside.any():
                    f, z, s = f[inside], z[inside], s[inside]
                    add(_ranks(data, s, s + size - 1 + length), f, z, s, 1)
            rank, *rest = np.concatenate(out, axis=1)
            names = ("rank2", "key", "key2", "first", "last", "base", "whole")
            yield pd.DataFrame({"rank": rank, **{n: x if n == "key" else x.astype(np.int32) for n, x in zip(names, rest)}})

    return run


def _split(first: np.ndarray, last: np.ndarray, base: np.ndarray, before: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of ``before`` positions from ``base`` on as blocks of ``size``, those with open positions."""
    if before == size:
        return first, last, base
    s = (base[:, None] + np.arange(0, before, size)).ravel()
    f = np.maximum(s, np.repeat(first, before // size))
    z = np.minimum(s + size - 1, np.repeat(last, before // size))
    here = f <= z
    return f[here], z[here], s[here]


def removed_mask(n: int, first: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """Bytes covered by strings that start in the given blocks of positions."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last + length, -1)
    return np.cumsum(step[:-1]) > 0


def _cut(length: int, with_text: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, more, text, first, last in zip(b["key"], b["key2"], b["text"], b["first"], b["last"]):
                data = text.encode()
                gone = removed_mask(len(data), _positions(first), _positions(last), length)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                spans = int(np.count_nonzero(np.diff(np.concatenate(([False], gone)).view(np.int8)) == 1))
                rows.append((key, more, int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), *[kept] * with_text))
            yield pd.DataFrame(rows, columns=["key", "key2", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text])

    return run


KEY = ["key", "key2"]


def _repeated(ranked: DataFrame, *rank: str) -> DataFrame:
    """The rows whose rank stands at two or more places, by a written table of these ranks. The
    aggregate combines before its shuffle."""
    place = F.xxhash64(*KEY, *[c for c in ("at", "base") if c in ranked.columns])
    found = ranked.groupBy(*rank).agg(F.min(place).alias("a"), F.max(place).alias("z")).where("a <> z").select(*rank)
    return ranked.join(materialize(found, "repeated"), list(rank))


def _bucketed(texts: DataFrame) -> tuple[DataFrame, str]:
    """``texts`` written in buckets by name: joins by name then leave them where they are."""
    spark, name = texts.sparkSession, f"texts_{uuid.uuid4().hex}"
    many = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with writing(spark):
        texts.write.format("parquet").bucketBy(many, *KEY).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    out = spark.table(name)
    out._written = f"{shared_dir(spark)}/{name}"
    return out, name


def _settled(long: DataFrame, length: int) -> tuple[DataFrame, list[DataFrame], str]:
    """(texts with repeated anchors, tables of their settled blocks, name of the first)."""
    blocks = [b for b in BLOCKS if b <= max(1, length // 4)]
    ranked = materialize(long.mapInPandas(_emit_anchors(length), "rank long, key long, key2 int, at int"), "anchors")
    again = _repeated(ranked, "rank").groupBy(*KEY).agg(F.collect_set("at").alias("at"))
    # Of copies of a text one is kept, after the join, which deals by name already.
    texts, name = _bucketed(long.join(again, KEY).dropDuplicates(KEY))
    discard(ranked)
    state, before, settled = texts, None, []
    for size in blocks:
        ranked = materialize(state.mapInPandas(_emit_blocks(length, size, before), _RANKED), "ranks")
        both = _repeated(ranked, "rank", "rank2", "whole")
        if size == 1:
            settled.append(materialize(both.select(*KEY, "first", "last").distinct(), "settled"))
            discard(ranked)
            break
        # A block with a repeated whole is settled; one with only a repeated core stays open,
        # and so do the blocks with the same core, among which its match would be.
        core = F.max(F.when(F.col("whole") == 0, F.struct("rank", "rank2"))).alias("core")
        found = materialize(both.groupBy(*KEY, "first", "last", "base").agg(F.max("whole").alias("whole"), core), "blocks")
        discard(ranked)
        wanted = materialize(found.where("whole = 0").select("core").distinct(), "wanted")
        settled.append(materialize(found.where("whole = 1").select(*KEY, "first", "last"), "settled"))
        block = F.array_sort(F.collect_list(F.struct("first", "last", "base")))
        narrowed = materialize(found.join(wanted, "core", "left_semi").groupBy(*KEY).agg(block.alias("b")), "open")
        discard(found, wanted)
        state, before = texts.select(*KEY, "text").join(narrowed, KEY).select(*KEY, "text", *[F.col(f"b.{n}").alias(n) for n in ("first", "last", "base")]), size
    return texts, settled, name


def suffix_dedup(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, any_removed (and with ``with_text`` the kept bytes) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("sha")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    part = lambda a, n, kind: F.conv(F.substring("sha", a, n), 16, -10).cast(kind)
    rows = rows.withColumns({"key": part(1, 16, "long"), "key2": F.xxhash64(F.substring("sha", 17, 48)).bitwiseAND(0x7FFFFFFF).cast("int")})
    texts, settled, name = _settled(rows.where(F.col("n_bytes") >= length).select(*KEY, "text"), length)
    spans = settled[0]
    for more in settled[1:]:
        spans = spans.unionByName(more)
    spans = spans.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("b"))
    state = texts.select(*KEY, "text").join(spans, KEY).select(*KEY, "text", F.col("b.first").alias("first"), F.col("b.last").alias("last"))
    kind = "key long, key2 int, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    cut = state.mapInPandas(_cut(length, with_text), kind)
    copies = rows.where(F.col("n_bytes") >= length).groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY, F.lit(True).alias("copied"))
    # Written before the join with the documents, so that the engine splits the copies of a hot text.
    facts = materialize(cut.join(copies, KEY, "full"), "facts")
    docs.sparkSession.sql(f"DROP TABLE {name}")
    discard(texts, *settled)
    out = rows.select("doc_id", "n_bytes", *KEY, "sha", *["text"] * with_text).join(facts, KEY, "left")
    pick = lambda whole, part, none: F.when(F.col("copied"), whole).when(F.col("n_removed").isNotNull(), part).otherwise(none)
    return out.select(
        "doc_id", "n_bytes", pick(F.col("n_bytes"), F.col("n_removed"), F.lit(0)).cast("long").alias("n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("n_spans"),
        pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("kept_sha256"), F.col("sha")).alias("kept_sha256"),
        F.coalesce(F.col("copied") | (F.col("n_removed") > 0), F.lit(False)).alias("any_removed"),
        *[pick(F.lit(b""), F.col("kept"), F.encode("text", "UTF-8")).alias("kept")] * with_text)


def query(docs: DataFrame) -> DataFrame:
    return suffix_dedup(docs)
