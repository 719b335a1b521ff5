"""Queries on uploads, stored files and what a batch of results leaves out, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import _PAGES, _query, _table, pages
from .bindings_more import _IMAGES, image_rows
from .operators import images, report
from .sources import pages as sources
from .sources import sinks


@_query("uploads", "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN 400 WHEN o_orderkey % 50 > 20 THEN 413 ELSE 202 END::int AS http_status FROM orders")
def _(spark, d):
    files = _table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 50 * 1_000_000).alias("length"))
    return sources.accept_uploads(files, 20_000_000).select("o_orderkey", "http_status")


@_query("missing_pages", f"SELECT doc_id, page_number, md5(CASE WHEN page_number % 3 = 0 THEN text ELSE '' END) AS digest FROM ({_PAGES})")
def _(spark, d):
    p = pages(spark, d)
    got = p.where("page_number % 3 = 0").select("doc_id", "page_number", "text")
    return sources.missing_pages(p.select("doc_id", "page_number"), got).select("doc_id", "page_number", F.md5("text").alias("digest"))


@_query("storage_keys", f"SELECT doc_id, page_number, idx, doc_id || '/q' || page_number || '/img_' || idx || '.png' AS key FROM ({_IMAGES}) WHERE idx % 3 <> 0")
def _(spark, d):
    rows = image_rows(spark, d)
    path = images.image_path(F.col("doc_id").cast("string"), F.col("page_number"), F.col("idx"), F.lit("png"))
    rows = rows.select("doc_id", "page_number", "idx", F.col("page_number").alias("question_number"), F.when(F.col("idx") % 3 != 0, path).alias("path"))
    return sinks.storage_keys(rows).select("doc_id", "page_number", "idx", "key")


@_query("usable_diagrams", "SELECT p_partkey, p_name AS description FROM part WHERE p_size % 5 <> 0 AND p_size % 7 > 1")
def _(spark, d):
    size = F.col("p_size")
    found = _table(spark, d, "part").select("p_partkey", F.when(size % 5 == 0, "timeout").alias("error"), F.when(size % 7 == 0, "").when(size % 7 > 1, F.col("p_name")).alias("description"))
    return report.usable_diagrams(found).select("p_partkey", "description")


@_query("canonical_json", """SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","note":' || CASE WHEN n_nationkey % 2 = 0 THEN '"even"' ELSE 'null' END || '}' AS json FROM nation""")
def _(spark, d):
    rows = _table(spark, d, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, "even").alias("note"))
    found = sinks.canonical_json(rows)
    return found.select(F.get_json_object("json", "$.n_nationkey").cast("long").alias("n_nationkey"), "json")
