"""Queries on images, question banks, jobs and HTML over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import _query, _r, _table, pages
from .functions import text
from .operators import html, images, jobs, questions
from .sources.pages import natural_key

# Images: line items of a supplier, with their parts as xrefs ------------------------------------

_IMAGES = """SELECT l_suppkey AS doc_id, l_orderkey AS page_number, l_linenumber AS idx, l_partkey AS xref, (l_quantity * 8)::bigint AS width, (l_quantity * 3)::bigint AS height,
 CASE WHEN l_linenumber <> 7 THEN l_quantity * 4 END AS box_w, CASE WHEN l_linenumber <> 7 THEN l_quantity * 2 END AS box_h, (l_extendedprice * 100)::bigint % 792 AS y, l_partkey % 500 AS x FROM lineitem"""


def image_rows(spark: SparkSession, d: str) -> DataFrame:
    li = _table(spark, d, "lineitem")
    known = F.col("l_linenumber") != 7
    return li.select(F.col("l_suppkey").alias("doc_id"), F.col("l_orderkey").alias("page_number"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("xref"),
                     (F.col("l_quantity") * 8).cast("long").alias("width"), (F.col("l_quantity") * 3).cast("long").alias("height"), F.when(known, F.col("l_quantity") * 4).alias("box_w"),
                     F.when(known, F.col("l_quantity") * 2).alias("box_h"), (F.round(F.col("l_extendedprice") * 100).cast("long") % 792).alias("y"), (F.col("l_partkey") % 500).alias("x"))


def _first(where: str) -> str:
    return f"SELECT doc_id, xref, page_number, idx FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, xref ORDER BY page_number, idx) AS rn FROM ({_IMAGES}) WHERE {where}) WHERE rn = 1"


@_query("image_dedup", _first("width >= 20 AND height >= 20 AND coalesce(box_w * box_h >= 1000, true)"))
def _(spark, d):
    return images.page_images(image_rows(spark, d)).select("doc_id", "xref", "page_number", "idx")


@_query("figure_area_filter", _first("box_w * box_h >= 1000 AND page_number <= 5000"))
def _(spark, d):
    return images.figures(image_rows(spark, d), max_pages=5000).select("doc_id", "xref", "page_number", "idx")


# The same over the whole table, as the reference does by default.
@_query("figure_area_whole", _first("box_w * box_h >= 1000"))
def _(spark, d):
    return images.figures(image_rows(spark, d)).select("doc_id", "xref", "page_number", "idx")


@_query("equation_filter", f"SELECT doc_id, count(*)::bigint AS n FROM ({_IMAGES}) WHERE height > 0 AND width::double / height BETWEEN 1.5 AND 20 AND idx % 2 = 0 GROUP BY doc_id")
def _(spark, d):
    rows = image_rows(spark, d).withColumn("has_data", F.col("idx") % 2 == 0)
    return images.equations(rows).groupBy("doc_id").agg(F.count("*").alias("n"))


@_query("image_url", f"SELECT page_number, idx, doc_id, '/api/images/' || doc_id || '/page_' || page_number || '/img_' || idx || '.png' AS url, 'images/' || doc_id || '/page_' || page_number || '/img_' || idx || '.png' AS path FROM ({_IMAGES})")
def _(spark, d):
    doc = F.col("doc_id").cast("string")
    args = doc, F.col("page_number"), F.col("idx"), F.lit("png")
    return image_rows(spark, d).select("page_number", "idx", "doc_id", text.image_url(*args).alias("url"), images.image_path(*args).alias("path"))


@_query("otsu", """
WITH h AS (SELECT l_returnflag AS k, (floor(l_quantity * 5)::bigint % 256) AS bin, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(n) OVER w AS wb, sum(n * bin) OVER w AS sb, sum(n) OVER (PARTITION BY k) AS t, sum(n * bin) OVER (PARTITION BY k) AS s FROM h WINDOW w AS (PARTITION BY k ORDER BY bin)),
v AS (SELECT k, bin, wb::double * (t - wb)::double * pow(sb::double / wb::double - (s - sb)::double / nullif(t - wb, 0)::double, 2) AS v FROM c WHERE wb > 0 AND t - wb > 0)
SELECT k AS l_returnflag, bin::bigint AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, bin) AS rn FROM v WHERE v > 0) WHERE rn = 1""")
def _(spark, d):
    li = _table(spark, d, "lineitem").withColumn("bin", F.floor(F.col("l_quantity") * 5) % 256)
    return images.otsu(images.histogram(li, "l_returnflag", "bin"), "l_returnflag").select("l_returnflag", F.col("threshold").cast("long").alias("threshold"))


@_query("layout_class", "SELECT layout, count(*)::bigint AS n FROM (SELECT CASE WHEN l_tax > 0.01 AND l_linenumber = 1 THEN 'table' WHEN l_discount > 0.10 OR (l_discount > 0.05 AND l_tax < 0.08) THEN CASE WHEN l_discount + 0.05 > 0.10 AND l_tax < 0.08 THEN 'text' ELSE 'noisy' END "
        "WHEN l_discount + 0.05 > 0.10 AND l_tax < 0.08 THEN 'text' ELSE 'noisy' END AS layout FROM lineitem) GROUP BY layout")
def _(spark, d):
    line = F.when(F.col("l_linenumber") == 1, F.col("l_tax")).otherwise(0.0)
    return _table(spark, d, "lineitem").select(images.layout(line, F.col("l_discount") + 0.05, F.col("l_tax")).alias("layout")).groupBy("layout").agg(F.count("*").alias("n"))


@_query("table_cells", f"SELECT doc_id, count(*)::bigint AS n FROM ({_IMAGES}) WHERE width >= 20 AND height >= 20 GROUP BY doc_id")
def _(spark, d):
    return images.table_boxes(image_rows(spark, d).withColumnsRenamed({"width": "w", "height": "h"})).groupBy("doc_id").agg(F.count("*").alias("n"))


@_query("table_rows", """WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY y, x, w, h) AS k FROM
 (SELECT l_orderkey AS table_id, (l_partkey % 200)::double AS y, (l_suppkey % 100)::double AS x, 20.0::double AS w, (l_quantity + 10)::double AS h FROM lineitem)),
r AS (SELECT *, 0 AS row, y AS anchor FROM b WHERE k = 1 UNION ALL SELECT b.*, CASE WHEN abs(b.y - r.anchor) > b.h THEN r.row + 1 ELSE r.row END, CASE WHEN abs(b.y - r.anchor) > b.h THEN b.y ELSE r.anchor END
 FROM r JOIN b ON b.table_id = r.table_id AND b.k = r.k + 1) SELECT table_id, y, x, w, h, row::int AS row FROM r""")
def _(spark, d):
    li = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.col("l_partkey") % 200).alias("y"), (F.col("l_suppkey") % 100).alias("x"), F.lit(20).alias("w"), (F.col("l_quantity") + 10).alias("h"))
    return images.table_rows(li)


# Exam papers: conversations ---------------------------------------------------------------------

_EXAM = """SELECT conv_id AS doc_id, turn // 2 AS page_number, string_agg(CASE WHEN turn % 4 = 0 THEN (['I', 'II', 'III', 'IV'])[(turn // 4) % 4 + 1] || '. Section' || chr(10) || '8 x 1 = 8' || chr(10) ELSE '' END || (turn + 1) || '. ' || text
 || CASE WHEN turn % 3 = 2 THEN chr(10) || 'OR' || chr(10) || 'another' ELSE '' END || CASE WHEN turn % 2 = 0 THEN ' (A) one (B) two ' || (turn % 12) ELSE ' as shown' END, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY ALL"""


def exam_pages(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn")
    roman = F.element_at(F.array(*map(F.lit, ("I", "II", "III", "IV"))), (F.floor(t / 4) % 4 + 1).cast("int"))
    line = F.concat(F.when(t % 4 == 0, F.concat(roman, F.lit(". Section\n8 x 1 = 8\n"))).otherwise(""), (t + 1).cast("string"), F.lit(". "), F.col("text"),
                    F.when(t % 3 == 2, "\nOR\nanother").otherwise(""), F.when(t % 2 == 0, F.concat(F.lit(" (A) one (B) two "), (t % 12).cast("string"))).otherwise(" as shown"))
    c = _table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(t / 2).alias("page_number"), "turn", line.alias("l"))
    return c.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "l"))), lambda x: x["l"]), "\n").alias("text"))


_LINES = f"""WITH p AS ({_EXAM}), u AS (SELECT doc_id, page_number, length(text) AS chars, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM p),
l AS (SELECT *, nullif(regexp_extract(line, '^\\s*(I{{1,3}}|IV|VI{{0,3}}|IX|X)\\s*[.)]\\s+', 1), '') AS header, nullif(regexp_extract(line, '^\\s*(?:Q\\.?\\s*)?(\\d{{1,3}})\\s*[.)]\\s', 1), '') AS q,
 regexp_matches(line, '(?i)^\\s*OR\\s*$') AS is_or, regexp_full_match(regexp_replace(line, '^\\s+|\\s+$', '', 'g'), '(\\d+)\\s+[x×]?\\s*(\\d+)\\s*=\\s*(\\d+)') AS is_marks FROM u),
c AS (SELECT *, last_value(header IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, line_no) AS section, sum((q IS NOT NULL)::int) OVER w AS segment,
 coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id, page_number ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / greatest(chars, 1) AS line_at
 FROM l WINDOW w AS (PARTITION BY doc_id, page_number ORDER BY line_no)),
s AS (SELECT doc_id, page_number, segment, max(CASE WHEN q IS NOT NULL THEN q::int END) AS question_number, max(CASE WHEN q IS NOT NULL THEN section END) AS section, max(CASE WHEN q IS NOT NULL THEN line_at END) AS y_start,
 bool_or(is_or AND q IS NULL) AS has_or, string_agg(CASE WHEN q IS NOT NULL THEN regexp_replace(line, '^\\s+|\\s+$', '', 'g') ELSE line END, chr(10) ORDER BY line_no) FILTER (q IS NOT NULL OR NOT is_marks) || chr(10) AS raw
 FROM c WHERE segment >= 1 GROUP BY ALL),
t AS (SELECT *, regexp_extract(raw, '(?is)^(.*?)\\n\\s*OR\\s*\\n', 1) AS head, coalesce(lead(y_start) OVER (PARTITION BY doc_id, page_number ORDER BY segment), 1.0) AS y_end FROM s),
q AS (SELECT *, CASE WHEN has_or THEN regexp_replace(head, '^\\s+|\\s+$', '', 'g') ELSE raw END AS text,
 CASE WHEN has_or THEN regexp_replace(regexp_replace(raw, '(?is)^.*?\\n\\s*OR\\s*\\n', ''), '^\\s+|\\s+$', '', 'g') END AS or_text FROM t)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    return questions.segments(exam_pages(spark, d))


@_query("question_lines", _LINES + " SELECT doc_id, page_number, line_no::int AS line_no, q::int AS question_number, header AS section_header, is_or, is_marks FROM l")
def _(spark, d):
    return questions.lines(exam_pages(spark, d)).select("doc_id", "page_number", "line_no", "question_number", "section_header", "is_or", "is_marks")


@_query("section_carry", _LINES + " SELECT doc_id, page_number, line_no::int AS line_no, section FROM c")
def _(spark, d):
    return questions.carry_sections(questions.lines(exam_pages(spark, d))).select("doc_id", "page_number", "line_no", "section")


@_query("question_segments", _LINES + " SELECT doc_id, page_number, segment::bigint AS segment, question_number, section, text, or_text, has_or FROM q")
def _(spark, d):
    return segments(spark, d).select("doc_id", "page_number", "segment", "question_number", "section", "text", "or_text", F.col("has_or_alternative").alias("has_or"))


@_query("y_ranges", _LINES + " SELECT doc_id, page_number, question_number, round(y_start, 9) AS y_start, round(y_end, 9) AS y_end FROM q")
def _(spark, d):
    return segments(spark, d).select("doc_id", "page_number", "question_number", _r(F.col("y_start"), 9).alias("y_start"), _r(F.col("y_end"), 9).alias("y_end"))


_MARK = "nullif(regexp_extract(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\b(\\d{1,2})\\s*$', 1), '')::int"
_ENRICHED = _LINES + f", e AS (SELECT *, CASE WHEN {_MARK} BETWEEN 1 AND 10 THEN {_MARK} END AS marks FROM q)"


@_query("marks_difficulty", _ENRICHED + " SELECT doc_id, question_number, marks, CASE WHEN marks <= 1 THEN 'easy' WHEN marks <= 3 THEN 'medium' WHEN marks IS NOT NULL THEN 'hard' END AS difficulty, "
        "regexp_matches(text, '(?i)(?:in\\s+the\\s+figure|as\\s+shown|the\\s+(?:given\\s+)?(?:figure|diagram|graph))') AS has_figure FROM e")
def _(spark, d):
    return questions.enrich(segments(spark, d)).select("doc_id", "question_number", "marks", "difficulty", "has_figure")


@_query("options", """SELECT conv_id, turn, (turn % 5)::int AS n_options, CASE WHEN turn % 5 > 0 THEN 'A=first ' || turn || CASE WHEN turn % 5 > 1 THEN ',B=(2) ' || conv_id ELSE '' END || CASE WHEN turn % 5 > 2 THEN ',C=third' ELSE '' END
 || CASE WHEN turn % 5 > 3 THEN ',D=all' ELSE '' END ELSE '' END AS listed FROM conversations""")
def _(spark, d):
    """No option to four of them, in either case, with white space and brackets inside."""
    n = F.col("turn") % 5
    part = lambda k, *xs: F.when(n > k, F.concat(*xs)).otherwise("")
    question = F.concat(F.lit("Which (of these)?"), part(0, F.lit(" (a)  first "), F.col("turn").cast("string")), part(1, F.lit(" (B) (2) "), F.col("conv_id").cast("string")), part(2, F.lit("\n(C) third  ")), part(3, F.lit("(d)all ")))
    found = questions.options(question)
    listed = F.array_join(F.transform(found, lambda o: F.concat(o["label"], F.lit("="), o["text"])), ",")
    return _table(spark, d, "conversations").select("conv_id", "turn", F.size(found).alias("n_options"), listed.alias("listed"))


@_query("or_rows", _LINES + """ SELECT doc_id, question_number, '' AS prefix FROM q UNION ALL SELECT doc_id, question_number * 1000, '[OR]' FROM q WHERE or_text IS NOT NULL""")
def _(spark, d):
    t = questions.bank_tables(questions.enrich(segments(spark, d)))["questions"]
    return t.select("doc_id", "question_number", F.when(F.col("or_of").isNotNull(), "[OR]").otherwise("").alias("prefix"))


@_query("sections", f"""WITH p AS ({_EXAM}) SELECT doc_id, page_number, (length(text) - length(replace(text, '. Section' || chr(10) || '8 x 1 = 8', '')))::bigint // 19 AS n_sections FROM p""")
def _(spark, d):
    p = exam_pages(spark, d)
    s = questions.sections(p.select(F.struct("doc_id", "page_number").alias("doc_id"), "text"), "text").groupBy("doc_id").agg(F.count("*").alias("n"))
    s = s.select("doc_id.doc_id", "doc_id.page_number", "n")
    return p.join(s, ["doc_id", "page_number"], "left").select("doc_id", "page_number", F.coalesce("n", F.lit(0)).cast("long").alias("n_sections"))


@_query("image_question_assoc", _LINES + """, i AS (SELECT turn::bigint AS idx, conv_id AS doc_id, turn // 2 AS page_number, (turn * 97 + conv_id * 31) % 792 / 792.0 AS img FROM conversations),
x AS (SELECT i.doc_id, i.page_number, i.idx, q.segment, q.question_number, regexp_matches(q.text, '(?i)(?:in\\s+the\\s+figure|as\\s+shown|the\\s+(?:given\\s+)?(?:figure|diagram|graph))') AS fig,
 CASE WHEN img BETWEEN y_start AND y_end THEN img - y_start WHEN img > y_end THEN img - y_end + 0.01 ELSE y_start - img + 0.5 END AS distance FROM i JOIN q ON i.doc_id = q.doc_id AND i.page_number = q.page_number)
SELECT doc_id, page_number, idx, question_number FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, idx ORDER BY fig DESC, distance, segment) AS rn FROM x) WHERE rn = 1""")
def _(spark, d):
    t = F.col("turn")
    i = _table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.floor(t / 2).alias("page_number"), t.alias("idx"), ((t * 97 + F.col("conv_id") * 31) % 792).cast("double").alias("y"),
                                                  F.lit(True).alias("has_bbox"), F.lit(None).cast("double").alias("page_height"))
    return questions.associate_images(i, segments(spark, d)).select("doc_id", "page_number", "idx", "question_number")


@_query("diagram_match", f"""SELECT doc_id, page_number, idx, description FROM (SELECT a.doc_id, a.page_number, a.idx, 'd' || b.idx AS description, row_number() OVER (PARTITION BY a.doc_id, a.page_number, a.idx ORDER BY b.idx) AS rn
 FROM (SELECT page_number AS doc_id, doc_id % 3 AS page_number, idx, x, y FROM ({_IMAGES})) a JOIN (SELECT page_number AS doc_id, doc_id % 3 AS page_number, idx, x, y FROM ({_IMAGES})) b
 ON a.doc_id = b.doc_id AND a.page_number = b.page_number WHERE abs(b.x - a.x) < 20 AND abs(b.y - a.y) < 20) WHERE rn = 1""")
def _(spark, d):
    i = image_rows(spark, d).select(F.col("page_number").alias("doc_id"), (F.col("doc_id") % 3).alias("page_number"), "idx", "x", "y")
    diagrams = i.select("doc_id", "page_number", "x", "y", F.col("idx").alias("ordinal"), F.concat(F.lit("d"), F.col("idx").cast("string")).alias("description"))
    return questions.match_diagrams(i, diagrams)


@_query("enrichment_join", """SELECT c.conv_id AS doc_id, c.turn, e.topic FROM conversations c LEFT JOIN (SELECT conv_id, turn % 3 AS k, arg_max('t' || turn, turn) AS topic FROM conversations GROUP BY ALL) e ON e.conv_id = c.conv_id AND e.k = c.turn""")
def _(spark, d):
    c = _table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("question_number"))
    e = c.select(F.col("conv_id").alias("doc_id"), (F.col("turn") % 3).alias("question_number"), F.col("turn").alias("ordinal"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("topic"), F.lit(1).alias("marks"), F.lit("easy").alias("difficulty"))
    return questions.join_enrichment(rows, e).select("doc_id", F.col("question_number").alias("turn"), F.col("e_topic").alias("topic"))


@_query("qbank_upsert", "SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS ingested_at FROM orders GROUP BY o_custkey")
def _(spark, d):
    o = _table(spark, d, "orders").select("o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("ingested_at"))
    return questions.upsert(o.where("ingested_at % 2 = 0"), o.where("ingested_at % 2 = 1"), ["o_custkey"])


# Jobs: events -----------------------------------------------------------------------------------

_STATUS = "CASE event_type WHEN 'signup' THEN 'pending' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'processing' END"
_LATEST = f"SELECT user_id AS job_id, arg_max({_STATUS}, (ts, event_id)) AS status, max(ts) AS updated_at, min(ts) AS created_at, count(*)::bigint AS n_events FROM events GROUP BY user_id"


def job_events(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "signup", "pending").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("processing")
    return _table(spark, d, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("updated_at"), "event_id")




def _jobs(df: DataFrame) -> DataFrame:
    return df.select("job_id", "status", "n_events", F.unix_micros("updated_at").alias("updated_us"))


@_query("job_latest", f"SELECT job_id, status, n_events, epoch_us(updated_at) AS updated_us FROM ({_LATEST})")
def _(spark, d):
    return _jobs(jobs.latest(job_events(spark, d)))


@_query("job_evict", f"SELECT job_id, status, n_events, epoch_us(updated_at) AS updated_us FROM ({_LATEST}) WHERE NOT (status IN ('completed', 'failed') AND epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(updated_at) > 3600000000)")
def _(spark, d):
    return _jobs(jobs.evict(jobs.latest(job_events(spark, d)), "2024-01-31 00:00:00"))


@_query("job_list", f"SELECT job_id, status, n_events, epoch_us(updated_at) AS updated_us FROM ({_LATEST}) WHERE status = 'processing'")
def _(spark, d):
    return _jobs(jobs.listing(jobs.latest(job_events(spark, d)), "processing"))


@_query("job_with_stored", f"SELECT job_id, CASE WHEN status = 'processing' THEN status ELSE 'stored' END AS status, n_events, epoch_us(updated_at) AS updated_us FROM ({_LATEST})")
def _(spark, d):
    all_ = jobs.latest(job_events(spark, d))
    return _jobs(jobs.with_stored(all_.where("status = 'processing'"), all_.withColumn("status", F.lit("stored"))))


# HTML and small functions -----------------------------------------------------------------------


@_query("html_escape", "SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')) AS digest FROM pages")
def _(spark, d):
    return _table(spark, d, "pages").select("page_id", F.md5(text.escape_html(F.col("html"))).alias("digest"))


@_query("css_color", "SELECT o_orderkey, CASE WHEN o_orderkey % 16777216 = 0 THEN '#000' ELSE '#' || lpad(lower(hex(o_orderkey * 7919 % 16777216)), 6, '0') END AS color FROM orders")
def _(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 16777216 == 0, "#000").otherwise(text.css_color((F.col("o_orderkey") * 7919 % 16777216).cast("int"))).alias("color"))


@_query("latex_text", """SELECT p_partkey, trim(regexp_replace('x' || (['', 'sqrt', ' x ', ' / ', ' +/- ', ' <= ', ' >= ', ' != ', 'infinity', 'pi', 'alpha', 'beta', 'gamma', 'theta', 'SUM', 'INTEGRAL', 'lim', ' -> ', ' <- ', ' => ', ' . ', '...', ''])[p_partkey % 23 + 1]
 || ' ' || p_name || ' y', '\\s+', ' ', 'g')) AS plain FROM part""")
def _(spark, d):
    commands = F.array(*[F.lit("\\" + c) for c in ("frac sqrt times div pm leq geq neq infty pi alpha beta gamma theta sum int lim rightarrow leftarrow Rightarrow cdot ldots unknown").split()])
    command = F.element_at(commands, (F.col("p_partkey") % 23 + 1).cast("int"))
    return _table(spark, d, "part").select("p_partkey", text.latex_text(F.concat(F.lit("x"), command, F.lit("{"), F.col("p_name"), F.lit(r"}\mathrm y"))).alias("plain"))


@_query("natural_sort", "SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey)::int AS place FROM part")
def _(spark, d):
    from pyspark.sql import Window

    name = F.concat(F.lit("page_"), F.col("p_size").cast("string"), F.lit("_"), F.col("p_partkey").cast("string"), F.lit(".md"))
    return _table(spark, d, "part").select("p_partkey", F.row_number().over(Window.orderBy(natural_key(name))).alias("place"))


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), chr(39), '&#x27;')"


@_query("document_html", f"""SELECT source AS doc_id, count(*)::bigint AS sections, md5('<!DOCTYPE html><html><head><meta charset="utf-8"><title>' || source || '</title></head><body>' || string_agg('<section id="page-' || (doc_id + 1) || '" style="width:918.0px;height:1188.0px">'
 || CASE WHEN coalesce(text, '') <> '' THEN '<pre class="fallback-text">' || {_ESCAPED} || '</pre>' ELSE '' END || '</section>', chr(10) ORDER BY doc_id) || '</body></html>') AS digest FROM documents GROUP BY source""")
def _(spark, d):
    p = pages(spark, d).withColumns({"page_width": F.lit(612.0), "page_height": F.lit(792.0)})
    none = p.select("doc_id", "page_number", F.lit(0).alias("idx"), F.lit("").alias("html")).where("false")
    out = html.document_html(html.page_html(html.geometry(p), none))
    return out.select("doc_id", F.regexp_count("html", F.lit("<section ")).cast("long").alias("sections"), F.md5("html").alias("digest"))
