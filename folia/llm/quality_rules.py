"""Quality rules with adaptive thresholds (native).

Every document gets counts from DataFrame expressions. Each metric of the documents that
pass the base rules goes into a logarithmic-bucket quantile sketch (relative error
``(GAMMA - 1) / 2``) per language and source. Sketches are bucket counts, so they merge by
addition: partial aggregation runs before the shuffle, and a group with few documents
borrows the merged sketch of its language, then of the corpus. The fences read from the
sketches are joined back to the documents and decide ``kept``.

Defined results: a null text has no words and fails the base rules; null ``lang`` or
``source`` is a group of its own; repeated rows are judged one by one; an empty table gives
an empty result; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
GAMMA = 1.02
#: A group with fewer base-passing documents than this uses its language's sketch.
MIN_GROUP = 30
#: Fence = q75 + FENCE * max(q75 - q25, spread); values up to ``zero`` share the sketch's zero
#: bucket, the finest difference the rule cares about.
FENCE = 6.0
METRICS = {
    "symbols_per_word": {"zero": 0.05, "spread": 0.0},
    "dup_line_share": {"zero": 0.3, "spread": 0.05},
    "chars_per_word": {"zero": 1.0, "spread": 0.4},
}
SALTS = 32


def _let(value: Column, body) -> Column:
    """Bind ``value`` once as a lambda variable, so that it isn't evaluated per use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeated_words(words: Column) -> Column:
    """Words lying in 8-word windows that occur twice or more in ``words``."""

    def windows(h: Column) -> Column:
        n = F.size(h) - (WINDOW - 1)
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    def covered(p: Column) -> Column:  # sorted starts of repeated windows
        gaps = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    def slow(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        starts = lambda s: F.sort_array(F.transform(
            F.filter(s, lambda e, j: e["x"].eqNullSafe(F.get(s, j - 1)["x"]) | e["x"].eqNullSafe(F.get(s, j + 1)["x"])), lambda e: e["i"]))
        return _let(ordered, lambda s: _let(starts(s), covered))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(slow(w))

    hashed = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(_let(hashed, lambda h: _let(windows(h), count)))


def features(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text"))
    word = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = _let(word, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        repeated_words(w).alias("n_repeat_words")))
    lined = _let(lines, lambda x: F.struct(
        F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    out = base.select("doc_id", "lang", "source", counted.alias("w"), lined.alias("l"),
                      F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"))
    return out.select("doc_id", "lang", "source", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def with_metrics(rows: DataFrame) -> DataFrame:
    return rows.withColumns({
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        "symbols_per_word": F.try_divide(F.col("n_symbols").cast("double"), F.col("n_words").cast("double")),
        "dup_line_share": F.try_divide(F.col("n_dup_lines").cast("double"), F.col("n_lines").cast("double")),
        "chars_per_word": F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double")),
    })


def sketches(rows: DataFrame) -> DataFrame:
    """Bucket counts (lang, source, metric, bucket, n): bounded per group, merged by addition."""
    bucket = lambda m: F.when(F.col(m) <= METRICS[m]["zero"], F.lit(0)).otherwise(
        F.ceil(F.log(F.col(m) / METRICS[m]["zero"]) / F.log(F.lit(GAMMA))).cast("int"))
    long = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(m).alias("bucket")) for m in METRICS]))
    return (rows.where("NOT base_failed").select("lang", "source", long.alias("m"))
            .groupBy("lang", "source", "m.metric", "m.bucket").agg(F.count("*").alias("n")))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    merged = sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    run = Window.partitionBy(*keys, "metric").orderBy("bucket")
    cum = merged.withColumns({"below": F.sum("n").over(run), "total": F.sum("n").over(Window.partitionBy(*keys, "metric"))})
    at = lambda q: F.min(F.when(F.col("below") >= q * F.col("total"), F.col("bucket")))
    value = lambda b: F.when(b == 0, F.lit(0.0)).otherwise(
        F.col("zero") * F.pow(F.lit(GAMMA), b) * 2 / (1 + F.lit(GAMMA)))
    limits = cum.groupBy(*keys, "metric").agg(at(0.25).alias("b25"), at(0.75).alias("b75"), F.max("total").alias("n_docs"))
    pick = lambda k: F.element_at(F.create_map(*[x for m, v in METRICS.items() for x in (F.lit(m), F.lit(v[k]))]), F.col("metric"))
    limits = limits.withColumns({"zero": pick("zero"), "spread": pick("spread")})
    q25, q75 = value(F.col("b25")), value(F.col("b75"))
    fence = F.greatest(F.col("zero"), q75 + FENCE * F.greatest(q75 - q25, F.col("spread")))
    return limits.select(*keys, "metric", "n_docs", fence.alias("fence"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """One row per language and source: a fence for each metric."""
    whole, lang, own = _quantiles(sketch, []), _quantiles(sketch, ["lang"]), _quantiles(sketch, ["lang", "source"])
    rows = (own.join(lang.select(F.col("lang").alias("l"), F.col("metric").alias("m"), F.col("n_docs").alias("ln"), F.col("fence").alias("lf")),
                     F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m")), "left")
            .join(whole.select(F.col("metric").alias("wm"), F.col("fence").alias("wf")), F.col("metric") == F.col("wm"), "left"))
    fence = F.when(F.col("n_docs") >= MIN_GROUP, F.col("fence")).when(F.col("ln") >= MIN_GROUP, F.col("lf")).otherwise(F.col("wf"))
    return rows.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, fence)).alias(f"max_{m}") for m in METRICS])


def quality_rules(docs: DataFrame) -> DataFrame:
    """Counts, metrics, fences and ``kept`` of every document.

    The fences of a hot language and source are replicated over ``SALTS`` join keys and the
    documents spread over them, so no single task gets a hot group.
    """
    rows = with_metrics(materialize(features(docs), "quality"))
    fences = thresholds(sketches(rows)).withColumnRenamed("lang", "_l").withColumnRenamed("source", "_s")
    fences = fences.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = salted.join(fences, F.col("lang").eqNullSafe(F.col("_l")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_salt") == F.col("_k")), "left")
    inside = F.lit(True)
    for m in METRICS:
        inside = inside & F.coalesce(F.col(m) <= F.col(f"max_{m}"), F.lit(True))
    kept = ~F.col("base_failed") & inside
    return joined.withColumn("kept", kept).drop("_l", "_s", "_k", "_salt")


def query(docs: DataFrame) -> DataFrame:
    return quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_METRIC_SQL = {"symbols_per_word": "n_symbols::double / n_words", "dup_line_share": "CASE WHEN n_lines > 0 THEN n_dup_lines::double / n_lines END",
               "chars_per_word": "word_chars::double / n_words"}
_BUCKET_SQL = " UNION ALL ".join(
    f"SELECT lang, source, '{m}' AS metric, {v['zero']}::double AS zero, {v['spread']}::double AS spread, "
    f"CASE WHEN ({_METRIC_SQL[m]}) <= {v['zero']} THEN 0 ELSE ceil(ln(({_METRIC_SQL[m]}) / {v['zero']}::double) / ln({GAMMA}::double))::int END AS bucket "
    f"FROM f WHERE NOT base_failed" for m, v in METRICS.items())


def _fence_sql(name: str, keys: str) -> str:
    group = f"{keys}, " if keys else ""
    return f"""
{name}_c AS (SELECT {group}metric, zero, spread, bucket, sum(n) AS n FROM b GROUP BY ALL),
{name}_r AS (SELECT *, sum(n) OVER (PARTITION BY {group}metric ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {group}metric) AS total FROM {name}_c),
{name}_q AS (SELECT {group}metric, zero, spread, max(total) AS n_docs, min(CASE WHEN below >= 0.25 * total THEN bucket END) AS b25,
  min(CASE WHEN below >= 0.75 * total THEN bucket END) AS b75 FROM {name}_r GROUP BY ALL),
{name}_v AS (SELECT *, CASE WHEN b25 = 0 THEN 0.0::double ELSE zero * pow({GAMMA}::double, b25) * 2 / (1 + {GAMMA}::double) END AS q25,
  CASE WHEN b75 = 0 THEN 0.0::double ELSE zero * pow({GAMMA}::double, b75) * 2 / (1 + {GAMMA}::double) END AS q75 FROM {name}_q),
{name} AS (SELECT {group}metric, n_docs, greatest(zero, q75 + {FENCE}::double * greatest(q75 - q25, spread)) AS fence FROM {name}_v),"""


ORACLE = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
pos AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM pos) WHERE c > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW})))::bigint AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id),
g AS (SELECT w.doc_id, lang, source, len(words)::bigint AS n_words, list_sum(list_transform(words, lambda x: length(x)))::bigint AS wc,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols, len(lines)::bigint AS n_lines,
  (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, coalesce(wc, 0)::bigint AS word_chars, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM g),
m AS ({_BUCKET_SQL}),
b AS (SELECT lang, source, metric, zero, spread, bucket, count(*) AS n FROM m GROUP BY ALL),
{_fence_sql('own', 'lang, source')}{_fence_sql('lng', 'lang')}{_fence_sql('whole', '')}
t AS (SELECT own.lang, own.source, own.metric, CASE WHEN own.n_docs >= {MIN_GROUP} THEN own.fence WHEN lng.n_docs >= {MIN_GROUP} THEN lng.fence ELSE whole.fence END AS fence
  FROM own LEFT JOIN lng ON own.lang IS NOT DISTINCT FROM lng.lang AND own.metric = lng.metric LEFT JOIN whole ON own.metric = whole.metric),
p AS (SELECT lang, source, {', '.join(f"max(CASE WHEN metric = '{m}' THEN fence END) AS max_{m}" for m in METRICS)} FROM t GROUP BY ALL)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND {' AND '.join(f"coalesce(({_METRIC_SQL[m]}) <= max_{m}, true)" for m in METRICS)}) AS kept
FROM f LEFT JOIN p ON f.lang IS NOT DISTINCT FROM p.lang AND f.source IS NOT DISTINCT FROM p.source
"""
