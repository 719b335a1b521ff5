"""Pages rebuilt as HTML: positioned blocks, images, and plain text where there are none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import css_color, escape_html, scaled

MAX_WIDTH, PAGE_SIZE = 920.0, (920.0, 1100.0)


def geometry(pages: DataFrame, scale: float = 1.5, most: float = MAX_WIDTH) -> DataFrame:
    """Width, height and scale of each page's container."""
    known = (F.col("page_width") > 0) & (F.col("page_height") > 0)
    width = F.when(known, F.least(F.round(F.col("page_width") * scale, 1), F.lit(most))).otherwise(PAGE_SIZE[0])
    df = pages.withColumn("container_w", width).withColumn("scale", F.when(known, F.col("container_w") / F.col("page_width")).otherwise(F.lit(scale)))
    return df.withColumn("container_h", F.when(known, F.round(F.col("page_height") * F.col("scale"), 1)).otherwise(PAGE_SIZE[1]))


def block_html(blocks: DataFrame) -> DataFrame:
    """Each block (type, x, y, w, h, text, font, size, color, base64_data, format, scale) as an element."""
    at = F.format_string("left:%spx;top:%spx;width:%spx;height:%spx", *[scaled(F.col(c), F.col("scale")).cast("string") for c in "xywh"])
    size = F.round(F.coalesce(F.nullif(F.col("size"), F.lit(0.0)), F.lit(10.0)) * F.col("scale"), 1).cast("string")
    text = F.concat(F.lit('<div class="blk txt" style="'), at, F.lit(";font-size:"), size, F.lit("px;font-family:'"), F.coalesce("font", F.lit("sans-serif")), F.lit("',sans-serif;color:"),
                    css_color(F.col("color")), F.lit('">'), escape_html(F.coalesce("text", F.lit(""))), F.lit("</div>"))
    place = F.concat(F.lit('<div class="blk img-placeholder" style="'), at, F.lit('"><span>[image]</span></div>'))
    image = F.concat(F.lit('<img class="blk embedded-img" src="data:image/'), F.coalesce("format", F.lit("png")), F.lit(";base64,"), F.col("base64_data"), F.lit('" style="'), at, F.lit('"/>'))
    return blocks.where(F.col("x").isNotNull()).withColumn("html", F.when(F.col("type") == "text", text).when(F.col("base64_data").isNotNull(), image).when(F.col("type") == "image", place)).where("html IS NOT NULL")


def page_html(pages: DataFrame, elements: DataFrame) -> DataFrame:
    """Each page's elements in order; without any its text in a <pre>."""
    joined = elements.groupBy("doc_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "html"))), lambda e: e["html"]), "\n").alias("body"))
    plain = F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit('<pre class="fallback-text">'), escape_html(F.col("text")), F.lit("</pre>")))
    return pages.join(joined, ["doc_id", "page_number"], "left").withColumn("body", F.coalesce("body", plain, F.lit("")))


def document_html(pages: DataFrame) -> DataFrame:
    """One self-contained page per document, pages in order."""
    part = F.format_string('<section id="page-%d" style="width:%spx;height:%spx">%s</section>', "page_number", F.col("container_w").cast("string"), F.col("container_h").cast("string"), "body")
    parts = F.array_sort(F.collect_list(F.struct("page_number", part.alias("html"))))
    body = F.array_join(F.transform(parts, lambda p: p["html"]), "\n")
    return pages.groupBy("doc_id").agg(F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"><title>'), escape_html(F.col("doc_id").cast("string")), F.lit("</title></head><body>"), body, F.lit("</body></html>")).alias("html"))
