"""Queries over the test tables, each with its SQL equivalent.

The tables hold no scanned files, so they stand in for them: a source is a PDF and each of its
documents a page; the words of a page are its recognised tokens, with confidences from integer
arithmetic; a second reading leaves words out. Conversations are exam papers, line items images,
events jobs. Both engines derive these in the same way, and everything runs over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions import scripts, text
from .operators import confidence, gate, html, images, jobs, questions, report

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d.rstrip('/')}/{name}.parquet")


_r = lambda c, n=6: F.round(c, n)
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
_NORM = "lower(trim(regexp_replace({0}, '\\s+', ' ', 'g')))"


def _words_sql(x: str) -> str:
    n = _NORM.format(x)
    return f"CASE WHEN {n} = '' THEN []::VARCHAR[] ELSE string_split({n}, ' ') END"


def _distance_sql(a: str, b: str) -> str:
    """Word distance of two lists of at most 127 distinct words in SQL, by way of letters."""
    code = lambda x: f"array_to_string(list_transform({x}, lambda w: chr(list_position(list_distinct(list_concat({a}, {b})), w)::int)), '')"
    return f"levenshtein({code(a)}, {code(b)})"


# Pages ------------------------------------------------------------------------------------------

_PAGES = "SELECT source AS doc_id, doc_id + 1 AS page_number, text, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS char_count FROM documents"


def pages(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return docs.select(F.col("source").alias("doc_id"), (F.col("doc_id") + 1).alias("page_number"), "text", F.length(text.strip(F.col("text"))).cast("long").alias("char_count"))


@_query("native_pages", f"SELECT doc_id, page_number, char_count::bigint AS char_count, md5(text) AS digest FROM ({_PAGES})")
def _(spark, d):
    return pages(spark, d).select("doc_id", "page_number", "char_count", F.md5("text").alias("digest"))


@_query("page_has_text", f"SELECT doc_id, page_number, char_count >= 50 AS has_text FROM ({_PAGES})")
def _(spark, d):
    return pages(spark, d).select("doc_id", "page_number", (F.col("char_count") >= config.NATIVE_MIN_CHARS).alias("has_text"))


@_query("ocr_required_split", f"SELECT doc_id, count(*) FILTER (char_count < 50)::bigint AS n_ocr, count(*) FILTER (char_count >= 50)::bigint AS n_native FROM ({_PAGES}) GROUP BY doc_id")
def _(spark, d):
    need = gate.needs_ocr(F.col("char_count"), F.lit(False))
    return pages(spark, d).groupBy("doc_id").agg(F.count_if(need).alias("n_ocr"), F.count_if(~need).alias("n_native"))


_BODY = _STRIP.format("text")


@_query("text_sane", f"""
WITH b AS (SELECT doc_id, {_BODY} AS b FROM documents), w AS (SELECT doc_id, b, CASE WHEN b = '' THEN []::VARCHAR[] ELSE regexp_split_to_array(b, '\\s+') END AS w FROM b)
SELECT doc_id, CASE WHEN b = '' OR len(w) < 3 THEN false ELSE list_sum(list_transform(w, lambda x: length(x))) / len(w) BETWEEN 1.5 AND 25
  AND length(regexp_replace(b, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length(b) >= 0.4 END AS sane FROM w""")
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", scripts.looks_sane(F.col("text")).alias("sane"))


# Texts with Thai letters, many or few; short and empty ones; every third in a language that isn't judged.
_FOREIGN = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'en-IN' ELSE 'kn-IN' END AS language, CASE doc_id % 5 WHEN 1 THEN translate(text, 'aeiou', 'กขคงจ') WHEN 2 THEN translate(text, 'kwyz', 'กขคง')
 WHEN 3 THEN 'ab กข' WHEN 4 THEN CASE WHEN doc_id % 2 = 0 THEN ' ' ELSE translate(text, 'bfp', 'กขค') END ELSE text END AS text FROM documents"""


@_query("output_valid", f"""WITH b AS (SELECT doc_id, language, {_BODY} AS b FROM ({_FOREIGN})),
c AS (SELECT *, length(regexp_replace(b, '[^\\p{{L}}]', '', 'g')) AS letters, length(regexp_replace(b, '[^\\x{{0E00}}-\\x{{0E7F}}]', '', 'g')) AS thai FROM b)
SELECT doc_id, CASE WHEN b = '' THEN false WHEN language = 'en-IN' OR letters < 5 THEN true ELSE thai::double / letters <= 0.05 END AS valid FROM c""")
def _(spark, d):
    n, t = F.col("doc_id"), F.col("text")
    mixed = (F.when(n % 5 == 1, F.translate(t, "aeiou", "กขคงจ")).when(n % 5 == 2, F.translate(t, "kwyz", "กขคง")).when(n % 5 == 3, "ab กข")
             .when((n % 5 == 4) & (n % 2 == 0), " ").when(n % 5 == 4, F.translate(t, "bfp", "กขค")).otherwise(t))
    return _table(spark, d, "documents").select("doc_id", scripts.output_valid(mixed, F.when(n % 3 == 0, "en-IN").otherwise("kn-IN")).alias("valid"))


@_query("normalize_text", f"SELECT doc_id, {_NORM.format('text')} AS normalized FROM documents")
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", text.normalize(F.col("text")).alias("normalized"))


@_query("script_purity", "SELECT doc_id, length(regexp_replace(text, '[^\\x{0C80}-\\x{0CFF}]', '', 'g'))::double AS kannada, CASE WHEN length(regexp_replace(text, '[\\p{Z}\\p{N}\\p{P}\\s]', '', 'g')) = 0 THEN 0.0 ELSE "
        "length(regexp_replace(text, '[^\\x{0C80}-\\x{0CFF}]', '', 'g')) / length(regexp_replace(text, '[\\p{Z}\\p{N}\\p{P}\\s]', '', 'g')) END AS purity FROM documents")
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", F.regexp_count("text", F.lit(r"[\x{0C80}-\x{0CFF}]")).cast("double").alias("kannada"), scripts.purity(F.col("text")).alias("purity"))


# Pages of which none, some or nearly all letters are Kannada.
_KANNADA = "ಅಆಇಈಉಊಎಏಐಒಓಔಕಖಗಘಚಛಜಝಟಠಡಢತಥ"


@_query("degraded_pages", f"""WITH t AS (SELECT doc_id, CASE page_number % 3 WHEN 0 THEN translate(lower(text), 'aeiost', '{_KANNADA[:6]}') WHEN 1 THEN translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', '{_KANNADA}') ELSE text END AS text FROM ({_PAGES})),
c AS (SELECT doc_id, length(regexp_replace(text, '[^\\x{{0C80}}-\\x{{0CFF}}]', '', 'g'))::double AS own, length(regexp_replace(text, '[\\p{{Z}}\\p{{N}}\\p{{P}}\\s]', '', 'g')) AS n FROM t),
p AS (SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE own / n END AS purity FROM c)
SELECT doc_id, count(*)::bigint AS pages, count(*) FILTER (purity < 0.5)::bigint AS degraded, count(*) FILTER (purity >= 0.8)::bigint AS clean FROM p GROUP BY doc_id""")
def _(spark, d):
    n, low = F.col("page_number"), F.lower("text")
    mixed = F.when(n % 3 == 0, F.translate(low, "aeiost", _KANNADA[:6])).when(n % 3 == 1, F.translate(low, "abcdefghijklmnopqrstuvwxyz", _KANNADA)).otherwise(F.col("text"))
    p = pages(spark, d).withColumn("purity", scripts.purity(mixed))
    return p.groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("purity") < 0.5).alias("degraded"), F.count_if(F.col("purity") >= 0.8).alias("clean"))


@_query("script_distribution", """
WITH c AS (SELECT lang, c, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY ALL)
SELECT lang, CASE WHEN regexp_matches(c, '\\p{L}') AND unicode(c) < 592 THEN 'Latin' WHEN regexp_matches(c, '\\p{N}') THEN 'Digit' WHEN regexp_matches(c, '\\p{P}') THEN 'Punct'
  WHEN regexp_matches(c, '\\s') THEN 'Space' WHEN c = '$' THEN 'Dollar' WHEN c = '|' THEN 'Vertical' WHEN c = '+' THEN 'Plus' WHEN c = '<' THEN 'Less-Than' WHEN c = '>' THEN 'Greater-Than'
  WHEN c = '=' THEN 'Equals' ELSE 'Other' END AS script, sum(n)::bigint AS n_chars FROM c GROUP BY ALL""")
def _(spark, d):
    return scripts.script_distribution(_table(spark, d, "documents"), "lang")


# Text metrics: benchmark items against the next item --------------------------------------------

_PAIRS = "SELECT a.item_id, a.text AS ref, b.text AS hyp FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1"
_PAIR_WORDS = f"SELECT item_id, ref, hyp, {_words_sql('ref')} AS r, {_words_sql('hyp')} AS h FROM ({_PAIRS})"


def pairs(spark: SparkSession, d: str) -> DataFrame:
    a = _table(spark, d, "benchmark").select("item_id", F.col("text").alias("ref"))
    b = _table(spark, d, "benchmark").select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("hyp"))
    return a.join(b, "item_id")


@_query("word_levenshtein", f"SELECT item_id, {_distance_sql('r', 'h')}::bigint AS distance FROM ({_PAIR_WORDS})")
def _(spark, d):
    w = lambda c: text.words(text.normalize(F.col(c)))
    return pairs(spark, d).select("item_id", text.word_distance(w("ref"), w("hyp")).alias("distance"))


@_query("word_error_rate", f"SELECT item_id, {_distance_sql('r', 'h')}::double / len(r) AS wer, 1 - {_distance_sql('r', 'h')}::double / len(r) AS similarity, "
        f"greatest(0.0, 1 - {_distance_sql('r', 'h')}::double / len(r)) AS clamped FROM ({_PAIR_WORDS})")
def _(spark, d):
    p = pairs(spark, d).withColumn("wer", text.word_error_rate(F.col("ref"), F.col("hyp")))
    return p.select("item_id", "wer", (1 - F.col("wer")).alias("similarity"), text.clamped(1 - F.col("wer")).alias("clamped"))


_NAMES = "SELECT p_partkey, lower(p_name) AS r, lower(p_type) AS h FROM part"


@_query("character_error_rate", f"SELECT p_partkey, levenshtein(r, h)::bigint AS distance, levenshtein(r, h)::double / length(r) AS cer FROM ({_NAMES})")
def _(spark, d):
    p = _table(spark, d, "part")
    return p.select("p_partkey", text.char_distance(F.lower("p_name"), F.lower("p_type")).alias("distance"), text.character_error_rate(F.col("p_name"), F.col("p_type")).alias("cer"))


@_query("eval_stats", f"""WITH e AS (SELECT greatest(0.0, 1 - {_distance_sql('r', 'h')}::double / len(r)) AS s FROM ({_PAIR_WORDS}))
SELECT 'wer_similarity' AS metric, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(min(s), 6) AS least, round(max(s), 6) AS most, round(stddev_samp(s), 6) AS stdev, count(*)::bigint AS n FROM e""")
def _(spark, d):
    e = pairs(spark, d).select(text.clamped(text.similarity_ratio(F.col("ref"), F.col("hyp"))).alias("wer_similarity"))
    s = report.stats(e, "wer_similarity", deviation=True)
    return s.select("metric", *[_r(F.col(c)).alias(c) for c in ("mean", "median", "least", "most", "stdev")], "n")


@_query("eval_threshold_failures", f"SELECT item_id, greatest(0.0, 1 - {_distance_sql('r', 'h')}::double / len(r)) AS similarity FROM ({_PAIR_WORDS}) WHERE greatest(0.0, 1 - {_distance_sql('r', 'h')}::double / len(r)) < 0.9")
def _(spark, d):
    e = pairs(spark, d).select("item_id", text.clamped(text.similarity_ratio(F.col("ref"), F.col("hyp"))).alias("wer_similarity"), F.lit(0.0).alias("cer"))
    return report.threshold_failures(e).select("item_id", F.col("wer_similarity").alias("similarity"))


_SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"


@_query("fuzzy_similarity", f"""WITH p AS (SELECT item_id, {_SQUEEZED.format('ref')} AS a, {_SQUEEZED.format('hyp')} AS b FROM ({_PAIRS})), w AS (SELECT *, string_split(a, ' ') AS r, string_split(b, ' ') AS h, string_split(a, '') AS x, string_split(b, '') AS y FROM p)
SELECT item_id, greatest(0.0, round(1 - {_distance_sql('x', 'y')}::double / length(a), 4)) AS char_similarity, greatest(0.0, round(1 - {_distance_sql('r', 'h')}::double / len(r), 4)) AS word_similarity FROM w""")
def _(spark, d):
    return pairs(spark, d).select("item_id", *[c.alias(n) for n, c in report.fuzzy(F.col("ref"), F.col("hyp")).items()])


@_query("eval_match", """SELECT CASE WHEN d.doc_id IS NULL THEN 'missing_extraction' WHEN l.doc_id IS NULL THEN 'missing_truth' ELSE 'matched' END AS side, count(*)::bigint AS n
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id GROUP BY ALL""")
def _(spark, d):
    e = pages(spark, d).select(F.lit("all").alias("doc_id"), "page_number", "text")
    g = _table(spark, d, "labels").select(F.lit("all").alias("doc_id"), (F.col("doc_id") + 1).alias("page_number"), F.col("quality").cast("string").alias("text"))
    return report.match_pages(e, g).groupBy("side").agg(F.count("*").alias("n"))


@_query("set_ops", """SELECT 'without_labels' AS op, count(*)::bigint AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL
SELECT 'both', count(*)::bigint FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'either', count(*)::bigint FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")
def _(spark, d):
    a, b = (_table(spark, d, t).select("doc_id") for t in ("documents", "labels"))
    count = lambda df, op: df.agg(F.count("*").alias("n")).select(F.lit(op).alias("op"), "n")
    return count(a.join(b, "doc_id", "left_anti").distinct(), "without_labels").union(count(a.join(b, "doc_id", "left_semi").distinct(), "both")).union(count(a.union(b).distinct(), "either"))


# Tokens -----------------------------------------------------------------------------------------

_TOKENS = (f"SELECT doc_id, page_number, n, pos::bigint AS pos, w AS text, ((n * 7919 + pos * 104729 + length(w) * 31) % 1000) / 10.0 AS confidence FROM "
           f"(SELECT doc_id, page_number, page_number - 1 AS n, unnest(w) AS w, unnest(range(len(w))) AS pos FROM (SELECT *, {_words_sql('text')} AS w FROM ({_PAGES})))")
_CONF = f"""SELECT p.doc_id, p.page_number, count(t.text)::bigint AS total_tokens, avg(t.confidence) AS raw_avg_confidence, avg(CASE WHEN confidence >= 92 THEN confidence END) AS avg_confidence,
  count(*) FILTER (confidence < 92)::bigint AS low_conf_tokens, sum(CASE WHEN confidence >= 92 THEN confidence END) AS high_sum, count(*) FILTER (confidence >= 92)::bigint AS high_tokens,
  CASE WHEN count(t.text) > 0 THEN count(*) FILTER (confidence < 92)::double / count(t.text) END AS low_conf_ratio
FROM ({_PAGES}) p LEFT JOIN ({_TOKENS}) t USING (doc_id, page_number) GROUP BY ALL"""


def _reading(p: DataFrame, drop: int | None) -> DataFrame:
    """Words of pages; without every ``drop``-th one."""
    w = text.words(text.normalize(F.col("text")))
    return p.withColumn("w", w if drop is None else F.filter(w, lambda x, i: (i + 1) % drop != 0))


def tokens(spark: SparkSession, d: str) -> DataFrame:
    t = _reading(pages(spark, d), None).select("doc_id", "page_number", (F.col("page_number") - 1).alias("n"), F.posexplode("w").alias("pos", "text"))
    t = t.withColumn("pos", F.col("pos").cast("long"))
    return t.withColumn("confidence", ((F.col("n") * 7919 + F.col("pos") * 104729 + F.length("text") * 31) % 1000) / 10.0)


def token_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages that carry their words and their tokens in arrays."""
    n = F.col("page_number") - 1
    confidence_of = lambda w, i: ((n * 7919 + i.cast("long") * 104729 + F.length(w) * 31) % 1000) / 10.0
    return _reading(pages(spark, d), None).withColumn("tokens", F.transform("w", lambda w, i: F.struct(w.alias("text"), confidence_of(w, i).alias("confidence"))))


@_query("token_filter", f"SELECT doc_id, count(*)::bigint AS n, round(sum(confidence), 4) AS total FROM ({_TOKENS}) WHERE confidence >= 0 GROUP BY doc_id")
def _(spark, d):
    return confidence.keep_tokens(tokens(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"), _r(F.sum("confidence"), 4).alias("total"))


@_query("page_confidence", f"SELECT doc_id, page_number, total_tokens, round(raw_avg_confidence, 6) AS raw_avg_confidence, round(avg_confidence, 6) AS avg_confidence, low_conf_tokens, round(low_conf_ratio, 6) AS low_conf_ratio FROM ({_CONF})")
def _(spark, d):
    c = confidence.page_confidence_in_place(token_pages(spark, d))
    return c.select("doc_id", "page_number", "total_tokens", *[_r(F.col(x)).alias(x) for x in ("raw_avg_confidence", "avg_confidence", "low_conf_ratio")], "low_conf_tokens")


@_query("doc_stats", f"SELECT doc_id, sum(total_tokens)::bigint AS total_tokens, round(sum(high_sum) / sum(high_tokens), 6) AS avg_confidence FROM ({_CONF}) GROUP BY doc_id")
def _(spark, d):
    s = confidence.doc_stats(confidence.page_confidence(pages(spark, d), confidence.keep_tokens(tokens(spark, d))))
    return s.select("doc_id", "total_tokens", _r(F.col("avg_confidence")).alias("avg_confidence"))


@_query("candidate_score", f"SELECT doc_id, page_number, (pos % 2)::int AS pass_id, round(coalesce(avg(CASE WHEN confidence >= 70 THEN confidence END), 0.0), 6) AS score, count(*)::bigint AS n_tokens FROM ({_TOKENS}) GROUP BY ALL")
def _(spark, d):
    t = tokens(spark, d).withColumn("pass_id", (F.col("pos") % 2).cast("int"))
    return confidence.candidate_scores(t).select("doc_id", "page_number", "pass_id", _r(F.col("score")).alias("score"), "n_tokens")


# Three readings of each benchmark item.
_CANDIDATES = f"""SELECT item_id, k AS pass_id, CASE WHEN k = 0 THEN w ELSE list_filter(w, lambda x, i: i % (7 - 2 * k) <> 0) END AS w
FROM (SELECT item_id, {_words_sql('text')} AS w FROM benchmark), (VALUES (0), (1), (2)) t(k)"""
_CONSENSUS = f"""SELECT a.item_id, a.pass_id, a.w, avg(1 - {_distance_sql('a.w', 'b.w')}::double / len(a.w)) AS consensus FROM ({_CANDIDATES}) a JOIN ({_CANDIDATES}) b ON a.item_id = b.item_id AND a.pass_id <> b.pass_id GROUP BY ALL"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    p = _table(spark, d, "benchmark").select(F.lit("benchmark").alias("doc_id"), F.col("item_id").alias("page_number"), "text")
    out = None
    for k in range(3):
        one = _reading(p, None if k == 0 else 7 - 2 * k).select("doc_id", "page_number", F.lit(k).alias("pass_id"), F.array_join("w", " ").alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


@_query("consensus", f"SELECT item_id AS page_number, pass_id, round(consensus, 6) AS consensus FROM ({_CONSENSUS})")
def _(spark, d):
    return confidence.consensus(candidates(spark, d)).select("page_number", "pass_id", _r(F.col("consensus")).alias("consensus"))


@_query("best_candidate", f"""SELECT item_id AS page_number, pass_id, round(consensus, 6) AS consensus FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(consensus, 9) DESC, len(w) DESC, pass_id) AS rn FROM ({_CONSENSUS})) WHERE rn = 1""")
def _(spark, d):
    c = confidence.consensus(candidates(spark, d)).withColumns({"score": F.lit(0.0), "n_tokens": F.size(F.split("text", " ")), "consensus": F.round("consensus", 9)})
    return confidence.best_candidate(c).select("page_number", "pass_id", _r(F.col("consensus")).alias("consensus"))


@_query("quality_retry", f"""SELECT doc_id, page_number, CASE WHEN page_number % 3 <> 0 AND page_number % 10 >= page_number % 7 THEN page_number % 10 ELSE page_number % 7 END::bigint AS score,
 CASE WHEN page_number % 3 <> 0 THEN 1 ELSE 0 END::int AS attempts, page_number % 3 <> 0 AND page_number % 10 >= page_number % 7 AS replaced FROM ({_PAGES})""")
def _(spark, d):
    p = pages(spark, d).select("doc_id", "page_number", F.lit("old").alias("text"))
    current = p.withColumns({"score": F.col("page_number") % 7, "attempts": F.lit(0)})
    new = p.where(F.col("page_number") % 3 != 0).withColumns({"text": F.lit("new"), "score": F.col("page_number") % 10})
    return confidence.quality_retry(current, new).select("doc_id", "page_number", "score", "attempts", "replaced")


@_query("progressive_retry", f"SELECT doc_id, page_number, CASE WHEN page_number % 4 = 0 THEN '2' WHEN page_number % 3 = 0 THEN '1' ELSE '0' END AS text FROM ({_PAGES})")
def _(spark, d):
    p = pages(spark, d).select("doc_id", "page_number")
    text_ = lambda k, m: p.withColumn("text", F.when(F.col("page_number") % m == 0, F.lit(str(k))).otherwise(" "))
    return confidence.progressive_retry([text_(0, 1), text_(1, 3), text_(2, 4)])


@_query("chunk_pages", f"SELECT doc_id, page_number, ((row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1) // 5)::bigint AS chunk FROM ({_PAGES})")
def _(spark, d):
    return confidence.chunk_pages(pages(spark, d).select("doc_id", "page_number"), config.OCR_CHUNK_PAGES)


# The gate ---------------------------------------------------------------------------------------

_JOINED = f"""SELECT p.doc_id, p.page_number, p.text AS native_text, p.char_count, CASE WHEN (page_number - 1) % 17 <> 0 THEN array_to_string(list_filter(w, lambda x, i: i % 11 <> 0), ' ') END AS ocr_text,
 len(w) AS nw, len(list_filter(w, lambda x, i: i % 11 <> 0)) AS ow, CASE WHEN (page_number - 1) % 17 <> 0 THEN ((page_number - 1) * 37 % 100) / 100.0 END AS pass_similarity,
 CASE WHEN (page_number - 1) % 17 <> 0 THEN CASE (page_number - 1) % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'noisy' END END AS layout,
 CASE WHEN (page_number - 1) % 17 <> 0 THEN c.avg_confidence END AS avg_confidence, CASE WHEN (page_number - 1) % 17 <> 0 THEN c.low_conf_ratio END AS low_conf_ratio
FROM (SELECT *, {_words_sql('text')} AS w FROM ({_PAGES})) p JOIN ({_CONF}) c USING (doc_id, page_number)"""


def _gate_sql(g: config.Gate, never_native: bool = False) -> str:
    def relaxed(at: int, base: float, ease) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {ease(base, v[at])}" for k, v in config.LAYOUTS.items() if v[at] is not None)
        return f"(CASE coalesce(layout, 'text') {cases} ELSE {base} END)"

    low, sim, nat, avg_ = (relaxed(0, g.max_low_conf_ratio, max), relaxed(1, g.min_pass_similarity, min), relaxed(2, g.min_native_similarity, min), relaxed(3, g.min_avg_confidence, min))
    body = _STRIP.format("native_text")
    sane = f"""({body} <> '' AND len(regexp_split_to_array({body}, '\\s+')) >= 3 AND list_sum(list_transform(regexp_split_to_array({body}, '\\s+'), lambda x: length(x))) / len(regexp_split_to_array({body}, '\\s+')) BETWEEN 1.5 AND 25
      AND length(regexp_replace({body}, '[^\\p{{L}}\\p{{N}}\\s]', '', 'g')) / length({body}) >= 0.4)"""
    kind = ("CASE WHEN poor THEN 'figure' ELSE 'text' END" if never_native else
            "CASE WHEN source0 = 'native' AND sufficient THEN 'native_sufficient' WHEN poor AND sufficient THEN 'native_fallback' WHEN poor THEN 'figure' ELSE 'text' END")
    fallback = "'ocr'" if never_native else f"CASE WHEN {body} <> '' THEN 'native' ELSE 'ocr' END"
    native_gate = "false" if never_native else f"coalesce({nat} > 0 AND native_similarity < {nat}, false)" + (" AND selected_source <> 'native'" if g.skip_native_gate else "")
    return f"""
WITH a AS (SELECT *, CASE WHEN coalesce(ocr_text, '') <> '' AND nw > 0 THEN 1 - (nw - ow)::double / nw END AS native_similarity, {sane} AND char_count >= 50 AS sufficient,
  avg_confidence IS NULL OR coalesce(low_conf_ratio > 0.75 AND pass_similarity < 0.25, false) AS poor FROM ({_JOINED})),
b AS (SELECT *, coalesce(native_similarity, avg_confidence / 100) AS accuracy FROM a),
c AS (SELECT *, CASE WHEN coalesce(accuracy >= {g.decision_accuracy}, false) THEN 'B' ELSE 'A' END AS decision0, CASE WHEN coalesce(accuracy >= {g.decision_accuracy}, false) THEN 'ocr' ELSE {fallback} END AS source0 FROM b),
d AS (SELECT *, {kind} AS page_type FROM c),
e AS (SELECT *, CASE WHEN page_type = 'native_fallback' THEN 'native' ELSE source0 END AS selected_source, CASE WHEN page_type = 'native_fallback' THEN 'A' ELSE decision0 END AS decision FROM d),
f AS (SELECT *, CASE WHEN page_type = 'text' THEN concat_ws(',', CASE WHEN coalesce(avg_confidence < {avg_}, true) THEN 'avg_confidence' END, CASE WHEN coalesce(low_conf_ratio > {low}, true) THEN 'low_conf_ratio' END,
  CASE WHEN coalesce(pass_similarity < {sim}, true) THEN 'dual_pass_similarity' END, CASE WHEN {native_gate} THEN 'native_similarity' END) ELSE '' END AS failed FROM e),
g AS (SELECT *, CASE WHEN failed = '' THEN 'approved' ELSE 'needs_review' END AS status FROM f)"""


def joined(spark: SparkSession, d: str) -> DataFrame:
    p = pages(spark, d)
    n = F.col("page_number") - 1
    read = _reading(p, 11).where(n % 17 != 0).select("doc_id", "page_number", F.array_join("w", " ").alias("ocr_text"), ((n * 37 % 100) / 100.0).alias("pass_similarity"),
                                                  F.when(n % 3 == 0, "text").when(n % 3 == 1, "table").otherwise("noisy").alias("layout"))
    c = confidence.page_confidence(p, confidence.keep_tokens(tokens(spark, d))).select("doc_id", "page_number", "avg_confidence", "low_conf_ratio")
    hide = lambda x: F.when(n % 17 != 0, F.col(x)).alias(x)
    return (p.select("doc_id", "page_number", F.col("text").alias("native_text")).join(read, ["doc_id", "page_number"], "left").join(c, ["doc_id", "page_number"], "left")
            .select("doc_id", "page_number", "native_text", "ocr_text", "pass_similarity", "layout", hide("avg_confidence"), hide("low_conf_ratio")))


_STATUS_SQL = " SELECT doc_id, page_number, page_type, decision, selected_source, failed AS failed_gates, status, round(native_similarity, 6) AS native_similarity FROM g"


def quality(spark: SparkSession, d: str, g: config.Gate | None = None, **kw) -> DataFrame:
    return gate.page_quality(joined(spark, d), g, **kw)


def _status(q: DataFrame) -> DataFrame:
    return q.select("doc_id", "page_number", "page_type", "decision", "selected_source", F.array_join("failed_gates", ",").alias("failed_gates"), "status", _r(F.col("native_similarity")).alias("native_similarity"))


for _name, _g, _kw in (("gate_status_strict", config.gate(), {}), ("gate_status_target90", config.gate(90), {}), ("gate_status_kannada", config.gate(None, "kannada"), {}), ("gate_status_forced", config.gate(), {"force_ocr": True}),
                       ("gate_status_forced90", config.gate(90), {"force_ocr": True})):
    QUERIES[_name] = lambda spark, d, g=_g, kw=_kw: _status(quality(spark, d, g, **kw))
    ORACLE_SQL[_name] = _gate_sql(_g, bool(_kw)) + _STATUS_SQL

_STRICT = _gate_sql(config.gate())
_FORCED = _gate_sql(config.gate(), True)


@_query("gate_metrics", f"SELECT doc_id, page_number, layout, round(avg_confidence, 6) AS avg_confidence, round(low_conf_ratio, 6) AS low_conf_ratio, pass_similarity FROM ({_JOINED})")
def _(spark, d):
    return joined(spark, d).select("doc_id", "page_number", "layout", _r(F.col("avg_confidence")).alias("avg_confidence"), _r(F.col("low_conf_ratio")).alias("low_conf_ratio"), "pass_similarity")


def _threshold_rows() -> str:
    rows = []
    for target in (None, 90):
        for preset in config.PRESETS:
            g = config.gate(target, preset)
            for lay in (None, *config.LAYOUTS):
                v = config.LAYOUTS[lay or "text"]
                ease = lambda at, base, f: base if v[at] is None else f(base, v[at])
                rows.append(f"('{target}', '{preset}', {'NULL' if lay is None else repr(lay)}, {float(ease(0, g.max_low_conf_ratio, max))}::double, {float(ease(1, g.min_pass_similarity, min))}::double, "
                            f"{float(ease(2, g.min_native_similarity, min))}::double, {float(ease(3, g.min_avg_confidence, min))}::double)")
    return ", ".join(rows)


@_query("gate_thresholds", f"SELECT * FROM (VALUES {_threshold_rows()}) t(target, preset, layout, max_low_conf_ratio, min_pass_similarity, min_native_similarity, min_avg_confidence)")
def _(spark, d):
    return gate.gate_table(spark)


@_query("source_selection", _STRICT + " SELECT decision, selected_source, page_type, count(*)::bigint AS n FROM g GROUP BY ALL")
def _(spark, d):
    return quality(spark, d).groupBy("decision", "selected_source", "page_type").agg(F.count("*").alias("n"))


_CHOSEN = "selected_source = 'ocr' AND ocr_text IS NOT NULL"


@_query("page_assembly", _STRICT + f" SELECT doc_id, page_number, CASE WHEN {_CHOSEN} THEN 'ocr' ELSE 'native' END AS source, md5(CASE WHEN {_CHOSEN} THEN ocr_text ELSE native_text END) AS digest FROM g")
def _(spark, d):
    return gate.assemble_pages(quality(spark, d)).select("doc_id", "page_number", "source", F.md5("text").alias("digest"))


@_query("document_assembly", _STRICT + f""", p AS (SELECT doc_id, page_number, {_CHOSEN} AS ocr, CASE WHEN {_CHOSEN} THEN ocr_text ELSE native_text END AS text FROM g)
SELECT doc_id, count(*)::bigint AS pages_total, CASE WHEN bool_or(ocr) AND bool_or(NOT ocr) THEN 'hybrid' WHEN bool_or(ocr) THEN 'ocr' ELSE 'native' END AS method,
 md5(coalesce({_STRIP.format("string_agg(text, chr(10) ORDER BY page_number) FILTER (" + _STRIP.format('text') + " <> '')")}, '')) AS digest FROM p GROUP BY doc_id""")
def _(spark, d):
    return gate.assemble_documents(gate.assemble_pages(quality(spark, d))).select("doc_id", "pages_total", "method", F.md5("full_text").alias("digest"))


@_query("full_text", f"SELECT doc_id, md5(coalesce(string_agg({_BODY}, chr(10) ORDER BY page_number) FILTER ({_BODY} <> ''), '')) AS digest FROM ({_PAGES}) GROUP BY doc_id")
def _(spark, d):
    return report.full_text(pages(spark, d)).select("doc_id", F.md5("full_text").alias("digest"))


@_query("doc_status", _FORCED + """ SELECT doc_id, count(*)::bigint AS pages_total, count(*) FILTER (status = 'approved')::bigint AS approved_count, count(*) FILTER (status <> 'approved')::bigint AS needs_review_count,
 CASE WHEN bool_and(status = 'approved') THEN 'approved' ELSE 'needs_review' END AS status FROM g GROUP BY doc_id""")
def _(spark, d):
    return gate.doc_status(quality(spark, d, force_ocr=True))


@_query("quality_summary", _FORCED + """ SELECT doc_id, count(*) FILTER (status = 'approved')::bigint AS approved_count, count(*) FILTER (status <> 'approved')::bigint AS needs_review_count,
 coalesce(string_agg(page_number::varchar, ',' ORDER BY page_number) FILTER (status = 'approved'), '') AS approved_pages, coalesce(string_agg(page_number::varchar, ',' ORDER BY page_number) FILTER (status <> 'approved'), '') AS review_pages FROM g GROUP BY doc_id""")
def _(spark, d):
    return report.quality_summary(quality(spark, d, force_ocr=True))


@_query("consolidated_pages", _FORCED + """ SELECT doc_id, page_number, CASE WHEN ocr_text IS NOT NULL THEN 'ocr' ELSE 'native' END AS source, length(coalesce(ocr_text, native_text))::bigint AS n_chars,
 left(coalesce(ocr_text, native_text), 500) || CASE WHEN length(coalesce(ocr_text, native_text)) > 500 THEN '...' ELSE '' END AS preview FROM g WHERE status = 'approved'""")
def _(spark, d):
    q = quality(spark, d, force_ocr=True)
    return report.approved_pages(gate.assemble_pages(q), q).select("doc_id", "page_number", "source", F.col("n_chars").cast("long").alias("n_chars"), "preview")


@_query("needs_review_pages", _FORCED + " SELECT doc_id, page_number, page_type, failed AS failed_gates FROM g WHERE status = 'needs_review'")
def _(spark, d):
    return report.needs_review(quality(spark, d, force_ocr=True))


@_query("batch_summary", _FORCED + " SELECT doc_id, count(*)::bigint AS pages, count(*) FILTER (status <> 'approved')::bigint AS failed, count(*) FILTER (status <> 'approved')::double / count(*) AS ratio FROM g GROUP BY ROLLUP (doc_id)")
def _(spark, d):
    return report.batch_summary(quality(spark, d, force_ocr=True), rollup=True)


@_query("topk_worst", _STRICT + " SELECT doc_id, page_number, round(low_conf_ratio, 6) AS low_conf_ratio FROM g WHERE low_conf_ratio IS NOT NULL ORDER BY round(low_conf_ratio, 6) DESC, page_number LIMIT 5")
def _(spark, d):
    worst = quality(spark, d).select("doc_id", "page_number", _r(F.col("low_conf_ratio")).alias("low_conf_ratio")).where("low_conf_ratio IS NOT NULL")
    return worst.orderBy(F.desc("low_conf_ratio"), "page_number").limit(5)  # a top-k report


@_query("language_resolve", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'english' ELSE 'kannada' END AS profile, CASE WHEN lang = 'en' THEN 'eng' ELSE 'kan' END AS tesseract, CASE WHEN lang = 'en' THEN 'default' ELSE 'kannada' END AS preset FROM documents""")
def _(spark, d):
    rows = _table(spark, d, "documents").select("doc_id", F.col("lang").alias("language"), F.lit(" KAN ").alias("ocr_lang"))
    return gate.resolve_language(rows).select("doc_id", "profile", "tesseract", "preset")


@_query("label_precision", _FORCED + """ SELECT status, l.quality, count(*)::bigint AS n FROM g LEFT JOIN labels l ON l.doc_id = page_number - 1 GROUP BY ALL""")
def _(spark, d):
    lab = _table(spark, d, "labels").select((F.col("doc_id") + 1).alias("page_number"), "quality")
    return quality(spark, d, force_ocr=True).join(lab, "page_number", "left").groupBy("status", "quality").agg(F.count("*").alias("n"))


def _pass_rows() -> str:
    rows = []
    for layout, (modes, names) in config.LAYOUT_PASSES.items():
        rows += [f"('{layout}', {k}, '{s}', {psm})" for k, (s, psm) in enumerate((s, psm) for s in names for psm in modes)]
    return ", ".join(rows)


@_query("recognition_passes", f"""SELECT doc_id, page_number, pass_id, strategy, psm FROM (SELECT doc_id, page_number, CASE (page_number - 1) % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'table' ELSE 'noisy' END AS layout FROM ({_PAGES})) p
JOIN (VALUES {_pass_rows()}) t(layout, pass_id, strategy, psm) USING (layout)""")
def _(spark, d):
    n = F.col("page_number") - 1
    p = pages(spark, d).select("doc_id", "page_number", F.when(n % 3 == 0, "text").when(n % 3 == 1, "table").otherwise("noisy").alias("layout"))
    return confidence.recognition_passes(p).select("doc_id", "page_number", "pass_id", "strategy", "psm")


@_query("training_pairs", """SELECT 'paired' AS side, count(*)::bigint AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id UNION ALL SELECT 'missing', count(*)::bigint FROM documents d ANTI JOIN labels l ON d.doc_id = l.doc_id""")
def _(spark, d):
    path = lambda t, kind: F.concat(F.lit("train/"), F.col("doc_id").cast("string"), F.lit(kind)).alias("path")
    i = _table(spark, d, "documents").select(path("d", ".png"))
    t = _table(spark, d, "labels").select(path("l", ".txt"), F.lit("x").alias("text"))
    good, bad = confidence.training_pairs(i, t)
    count = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return count(good, "paired").unionByName(count(bad, "missing"))
