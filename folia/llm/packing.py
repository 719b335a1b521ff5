"""Best-fit packing of token sequences through a configuration linear program.

Documents are cut into pieces of at most ``capacity`` tokens (only longer ones; the first
piece takes the remainder). Packing sees nothing but the histogram of piece lengths, at most
``capacity`` numbers whatever the size of the corpus:

1. the configuration LP (how often to use each multiset of lengths that fits a sequence) is
   solved by multiplicative weights: each length carries a price, a knapsack dynamic program
   finds the configuration of the highest price, and prices of well-covered lengths fall;
2. the fractional solution is rounded down to whole sequences, and what is left is placed
   best-fit decreasing, in bulk, on the histogram;
3. the plan goes back to the pieces: pieces of a length are numbered within (length, bucket)
   groups, so a hot length is dealt over many tasks, and a range join on the bounded plan
   gives each number its sequence and offset.

Defined results: a null text counts as empty and still has its one end token; repeated rows
are packed one by one; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import default_path, encoder

CAPACITY = 1024
END_ID = 2
#: Rounds of multiplicative weights and their step.
ROUNDS = 300
STEP = 0.25
#: Pieces to a group of (length, bucket).
BUCKET_ROWS = 100_000


def _pieces(path: str, end_id: int, capacity: int, keep_ids: bool):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"]):
                ids = e.ids(text) + end
                n = len(ids) // 4
                size, at, k = n % capacity or capacity, 0, 0
                size = min(size, n)
                while at < n:
                    part = ids[4 * at : 4 * (at + size)]
                    rows.append((doc_id, k, at, size, zlib.crc32(part), *[part] * keep_ids))
                    at, size, k = at + size, capacity, k + 1
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    return run


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of every document; with ``keep_ids`` their ids as little-endian 32-bit bytes."""
    kind = f"doc_id {dict(docs.dtypes)['doc_id']}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInPandas(_pieces(path or default_path(), end_id, capacity, keep_ids), kind)


def best_configuration(price: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of lengths within ``capacity`` of the highest total price (unbounded knapsack
    by dynamic programming, then cut to at most ``most`` of each length)."""
    lengths = np.flatnonzero(price > 0)
    value = np.zeros(capacity + 1)
    take = np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        fit = lengths[: np.searchsorted(lengths, c, side="right")]
        value[c], take[c] = value[c - 1], 0
        if len(fit):
            total = value[c - fit] + price[fit]
            k = int(np.argmax(total))
            if total[k] > value[c] + 1e-15:
                value[c], take[c] = total[k], fit[k]
    found: dict[int, int] = defaultdict(int)
    c = capacity
    while c > 0:
        if take[c] == 0:
            c -= 1
            continue
        found[int(take[c])] += 1
        c -= int(take[c])
    return {k: min(m, int(most[k])) for k, m in found.items() if most[k] > 0}


def _fractional(count: np.ndarray, capacity: int) -> list[tuple[dict[int, int], float]]:
    """Configurations with how often each is used, from multiplicative weights: covers every
    length about equally, scaled to use none more often than it occurs."""
    here = count > 0
    lengths = np.flatnonzero(here)
    weight = np.zeros(capacity + 1)
    weight[lengths] = lengths / capacity
    used: dict[tuple, float] = defaultdict(float)
    covered = np.zeros(capacity + 1)
    for _ in range(ROUNDS):
        price = np.zeros(capacity + 1)
        price[lengths] = weight[lengths] / count[lengths]
        config = best_configuration(price, count, capacity)
        if not config:
            break
        keys = np.array(list(config))
        each = np.array([config[k] for k in keys], float)
        step = float(np.min(count[keys] / each))  # as often as its scarcest length lasts
        used[tuple(sorted(config.items()))] += step
        share = each * step / count[keys]
        covered[keys] += share
        weight[keys] *= np.exp(-STEP * share)
        weight[lengths] /= weight[lengths].max()
    top = max(1e-9, covered.max())
    return [(dict(k), x / top) for k, x in used.items()]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Sequences as (how many, {length: pieces}); every piece is placed once."""
    count = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        count[k] += n
    out: list[tuple[int, dict[int, int]]] = []
    if count[capacity]:
        out.append((int(count[capacity]), {capacity: 1}))
        count[capacity] = 0
    if count.any():
        for config, x in sorted(_fractional(count, capacity), key=lambda c: (-c[1], sorted(c[0].items()))):
            times = min([int(x), *(int(count[k]) // m for k, m in config.items())])
            if times and sum(k * m for k, m in config.items()) >= capacity - max(1, capacity // 256):
                for k, m in config.items():
                    count[k] -= times * m
                out.append((times, config))
        out += _best_fit(count, capacity)
    return out


def _best_fit(count: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best-fit decreasing over a histogram, equal sequences in bulk."""
    open_: dict[int, dict[tuple, int]] = defaultdict(lambda: defaultdict(int))  # free -> content -> how many
    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            free = next((f for f in range(length, capacity) if open_.get(f)), None)
            if free is None:
                per = capacity // length
                full, rest = divmod(left, per)
                if full:
                    open_[capacity - per * length][((length, per),)] += full
                if rest:
                    open_[capacity - rest * length][((length, rest),)] += 1
                break
            content, n = next(iter(open_[free].items()))
            k = min(n, left)
            if k == n:
                del open_[free][content]
            else:
                open_[free][content] = n - k
            grown = dict(content)
            grown[length] = grown.get(length, 0) + 1
            open_[free - length][tuple(grown.items())] += k
            left -= k
    return [(n, dict(content)) for group in open_.values() for content, n in group.items()]


def _plan_rows(sequences: list[tuple[int, dict[int, int]]]) -> pd.DataFrame:
    """Per sequence type and length: which numbers of that length it takes, and where they go."""
    taken: dict[int, int] = defaultdict(int)
    rows, first = [], 0
    for times, config in sequences:
        offset = 0
        for length, m in sorted(config.items(), reverse=True):
            rows.append((length, taken[length], taken[length] + times * m, m, first, offset))
            taken[length] += times * m
            offset += length * m
        first += times
    return pd.DataFrame(rows, columns=["p_length", "p_from", "p_to", "p_each", "p_first", "p_offset"])


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (doc_id, piece, length, ...) with sequence_id and offset added."""
    spark = parts.sparkSession
    total, = parts.agg(F.count("*")).first()
    buckets = max(8, math.ceil(total / BUCKET_ROWS))
    parts = parts.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    groups = parts.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    histogram = {int(r[0]): int(r[1]) for r in groups.groupBy("length").agg(F.sum("_n")).collect()}  # at most `capacity` rows
    rows = _plan_rows(plan(histogram, capacity))
    # Rows of the plan follow from the capacity and the rounds, not from the data.
    kind = "p_length long, p_from long, p_to long, p_each long, p_first long, p_offset long"
    planned = F.broadcast(spark.createDataFrame(rows.astype("int64"), kind) if len(rows) else spark.createDataFrame([], kind))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).withColumnsRenamed({"length": "_l", "_bucket": "_b"})
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (parts.withColumn("_row", F.row_number().over(within))
                .join(starts, F.col("length").eqNullSafe(F.col("_l")) & (F.col("_bucket") == F.col("_b")))
                .withColumn("_number", F.col("_before") + F.col("_row") - 1))
    placed = numbered.join(planned, (F.col("length") == F.col("p_length")) & (F.col("_number") >= F.col("p_from")) & (F.col("_number") < F.col("p_to")))
    number = F.col("_number") - F.col("p_from")
    return (placed.withColumn("sequence_id", F.col("p_first") + F.floor(number / F.col("p_each")).cast("long"))
            .withColumn("offset", F.col("p_offset") + (number % F.col("p_each")) * F.col("length"))
            .drop("_bucket", "_row", "_l", "_b", "_before", "_number", "p_length", "p_from", "p_to", "p_each", "p_first", "p_offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves (sequence_id, length, ids) from pieces with ``ids``; a
    sequence has at most ``capacity`` tokens, so a group is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.col("p"), F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select("sequence_id", "length", joined.alias("ids"))


def query(docs: DataFrame) -> DataFrame:
    return pack(materialize(pieces(docs), "pieces")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
