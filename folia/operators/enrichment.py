"""Pages with what was found on them, and the engine that reads each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config
from ..functions.text import image_url, strip
from .confidence import PAGE


def with_paths(images: DataFrame, paths: DataFrame) -> DataFrame:
    """Images (doc_id, page_number, idx, format) with their URL, and the path of those that were saved."""
    url = image_url(F.col("doc_id").cast("string"), F.col("page_number"), F.col("idx"), F.coalesce("format", F.lit("png")))
    return images.join(paths.select(*PAGE, "idx", "image_path"), [*PAGE, "idx"], "left").withColumn("image_url", url)


def _listed(rows: DataFrame, name: str) -> DataFrame:
    """The rows of each page as one array in their order; a page's rows are as many as stand on one page."""
    rest = [c for c in rows.columns if c not in PAGE and c != "idx"]
    return rows.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("idx", *rest))).alias(name))


def enriched_pages(pages: DataFrame, dimensions: DataFrame, images: DataFrame, layout: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages with their width and height (null if unknown) and their images, layout blocks and tables (empty if none)."""
    out = pages.join(dimensions.select(*PAGE, "page_width", "page_height"), PAGE, "left")
    for name, rows in (("images", images), ("layout", layout), ("tables", tables)):
        listed = _listed(rows, name)
        kind = dict(listed.dtypes)[name]
        out = out.join(listed, PAGE, "left").withColumn(name, F.coalesce(name, F.array().cast(kind)))
    return out


def needs_recognition(char_count: Column, regional: Column, force: Column, least: int = config.NATIVE_MIN_CHARS) -> Column:
    """All pages of a regional language or of a forced run; else those with too little text of their own."""
    return regional | force | (F.coalesce(char_count, F.lit(0)) < least)


def routed(pages: DataFrame, regional_texts: DataFrame, other: str = "tesseract", force: bool = False) -> DataFrame:
    """The engine and text of each page (doc_id, page_number, text, char_count, regional). Of the pages
    that need recognition, those of a regional language go to its engine; what it leaves blank, and all
    others, are left to ``other``, whose texts are not known here (null). The rest keeps its own text."""
    needed = needs_recognition(F.col("char_count"), F.col("regional"), F.lit(force))
    found = regional_texts.select(*PAGE, F.col("text").alias("_found")).where(strip(F.col("_found")) != "")
    took = needed & F.col("regional") & F.col("_found").isNotNull()
    return (pages.join(found, PAGE, "left").withColumn("engine", F.when(~needed, "native").when(took, "regional").otherwise(other))
            .withColumn("text", F.when(~needed, F.col("text")).when(took, F.col("_found"))).drop("_found"))


def safe_limits(dpi: Column, max_pages: Column, safe: bool, is_async: bool = False) -> tuple[Column, Column]:
    """Resolution and pages as a small host allows them; without ``safe`` as they are."""
    if not safe:
        return dpi, max_pages
    return F.least(dpi, F.lit(config.SAFE_DPI)), F.coalesce(max_pages, F.lit(config.ASYNC_MAX_PAGES if is_async else config.SYNC_MAX_PAGES))


def failures(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, native_chars, pages_required, pages_recognised, full_text) with the error that ends
    them: no text of their own and none recognised, pages required but none recognised, or an empty text."""
    nothing = (F.col("pages_required") > 0) & (F.col("pages_recognised") == 0)
    error = F.when(nothing, "PdfProcessingError").when((F.col("native_chars") == 0) & (F.col("pages_recognised") == 0), "PdfProcessingError").when(strip(F.coalesce("full_text", F.lit(""))) == "", "EmptyContentError")
    return documents.withColumn("error", error)
