"""Queries on page enrichment, engine routing and order of questions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .bindings import _PAGES, _query, _table, pages
from .bindings_more import _IMAGES, _LINES, image_rows, segments
from .functions import text
from .operators import enrichment, questions


def _images(spark: SparkSession, d: str) -> DataFrame:
    return image_rows(spark, d).select("doc_id", "page_number", "idx", F.when(F.col("idx") % 4 != 0, "jpeg").alias("format"), "width")


def _paths(images: DataFrame) -> DataFrame:
    return images.where("idx % 3 <> 0").groupBy("doc_id", "page_number", "idx").agg(F.concat(F.lit("out/"), F.min("width").cast("string")).alias("image_path"))


@_query("image_paths", f"""WITH i AS ({_IMAGES}), p AS (SELECT doc_id, page_number, idx, 'out/' || min(width) AS image_path FROM i WHERE idx % 3 <> 0 GROUP BY ALL)
SELECT i.doc_id, i.page_number, i.idx, i.width, p.image_path,
 '/api/images/' || i.doc_id || '/page_' || i.page_number || '/img_' || i.idx || '.' || CASE WHEN i.idx % 4 <> 0 THEN 'jpeg' ELSE 'png' END AS image_url
FROM i LEFT JOIN p ON i.doc_id = p.doc_id AND i.page_number = p.page_number AND i.idx = p.idx""")
def _(spark, d):
    images = _images(spark, d)
    return enrichment.with_paths(images, _paths(images)).select("doc_id", "page_number", "idx", "width", "image_path", "image_url")


@_query("enriched_pages", f"""WITH i AS ({_IMAGES}), p AS (SELECT DISTINCT doc_id, page_number FROM i)
SELECT p.doc_id, p.page_number, CASE WHEN p.page_number % 2 = 0 THEN 612.0::double END AS page_width, CASE WHEN p.page_number % 2 = 0 THEN 792.0::double + p.page_number % 7 END AS page_height,
 coalesce(a.n, 0)::bigint AS n_images, a.widths, coalesce(b.n, 0)::bigint AS n_layout, coalesce(c.n, 0)::bigint AS n_tables
FROM p LEFT JOIN (SELECT doc_id, page_number, count(*) AS n, string_agg(width, ',' ORDER BY idx, width) AS widths FROM i WHERE idx % 2 = 1 GROUP BY ALL) a USING (doc_id, page_number)
LEFT JOIN (SELECT doc_id, page_number, count(*) AS n FROM i WHERE idx % 3 = 0 GROUP BY ALL) b USING (doc_id, page_number)
LEFT JOIN (SELECT doc_id, page_number, count(*) AS n FROM i WHERE idx = 7 GROUP BY ALL) c USING (doc_id, page_number)""")
def _(spark, d):
    rows = image_rows(spark, d).select("doc_id", "page_number", "idx", "width")
    own = rows.select("doc_id", "page_number").distinct()
    sizes = own.where("page_number % 2 = 0").select("doc_id", "page_number", F.lit(612.0).alias("page_width"), (F.lit(792.0) + F.col("page_number") % 7).alias("page_height"))
    out = enrichment.enriched_pages(own, sizes, rows.where("idx % 2 = 1"), rows.where("idx % 3 = 0"), rows.where("idx = 7"))
    widths = F.array_join(F.transform("images", lambda x: x["width"].cast("string")), ",")
    size = lambda c: F.size(c).cast("long")
    return out.select("doc_id", "page_number", "page_width", "page_height", size("images").alias("n_images"), F.when(F.size("images") > 0, widths).alias("widths"),
                      size("layout").alias("n_layout"), size("tables").alias("n_tables"))


@_query("engine_routing", f"""SELECT doc_id, page_number, CASE WHEN page_number % 3 <> 0 AND char_count >= {config.NATIVE_MIN_CHARS} THEN 'native' WHEN page_number % 3 = 0 AND page_number % 5 <> 0 THEN 'regional' ELSE 'tesseract' END AS engine,
 CASE WHEN page_number % 3 <> 0 AND char_count >= {config.NATIVE_MIN_CHARS} THEN md5(text) WHEN page_number % 3 = 0 AND page_number % 5 <> 0 THEN md5('read ' || page_number) END AS digest
FROM (SELECT doc_id, page_number, text, coalesce(char_count, 0) AS char_count FROM ({_PAGES}))""")
def _(spark, d):
    own = pages(spark, d).withColumn("regional", F.col("page_number") % 3 == 0)
    read = own.select("doc_id", "page_number", F.when(F.col("page_number") % 5 == 0, " ").otherwise(F.concat(F.lit("read "), F.col("page_number").cast("string"))).alias("text"))
    return enrichment.routed(own, read).select("doc_id", "page_number", "engine", F.md5("text").alias("digest"))


@_query("question_order", _LINES + """ SELECT doc_id, page_number, segment::int AS segment, question_number::int AS question_number,
 row_number() OVER (PARTITION BY doc_id ORDER BY coalesce(nullif(question_number, 0), 9999), page_number, segment)::int AS place FROM q""")
def _(spark, d):
    found = questions.question_order(segments(spark, d))
    return found.select("doc_id", "page_number", F.col("segment").cast("int").alias("segment"), F.col("question_number").cast("int").alias("question_number"), "place")


@_query("json_list", """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN turn + 1 WHEN 1 THEN turn + 2 ELSE -1 END::bigint AS total FROM conversations""")
def _(spark, d):
    """Answers as plain and fenced lists, an object, broken JSON and prose."""
    c = _table(spark, d, "conversations")
    n = F.col("turn").cast("string")
    one, two = F.concat(F.lit('[{"n": '), n, F.lit('}, {"n": 1}]')), F.concat(F.lit('```json\n[{"n": '), n, F.lit('},\n {"n": 2}]\n```'))
    answer = F.element_at(F.array(one, two, F.lit('{"n": 3}'), F.lit('[{"n": 1}, {"n"'), F.col("text")), (F.col("turn") % 5 + 1).cast("int"))
    items = text.json_list(answer, "struct<n:bigint>")
    return c.select("conv_id", "turn", F.when(items.isNull(), F.lit(-1)).otherwise(F.aggregate(items, F.lit(0).cast("bigint"), lambda a, x: a + x["n"])).cast("long").alias("total"))


@_query("safe_limits", f"""SELECT o_orderkey, least(o_orderkey % 700, {config.SAFE_DPI})::bigint AS dpi, coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END, {config.SYNC_MAX_PAGES})::bigint AS sync_pages,
 coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 50 END, {config.ASYNC_MAX_PAGES})::bigint AS async_pages FROM orders""")
def _(spark, d):
    key = F.col("o_orderkey")
    most = F.when(key % 2 == 0, key % 50)
    (dpi, sync), (_, many) = enrichment.safe_limits(key % 700, most, True), enrichment.safe_limits(key % 700, most, True, is_async=True)
    return _table(spark, d, "orders").select("o_orderkey", dpi.cast("long").alias("dpi"), sync.cast("long").alias("sync_pages"), many.cast("long").alias("async_pages"))
