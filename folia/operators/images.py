"""Images, figures, equations, tables and layout: filters, first-seen dedup, thresholds, row grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EQUATION_ASPECT, MIN_IMAGE_AREA, MIN_IMAGE_PIXELS, OTSU_DEFAULT


def first_seen(images: DataFrame, *order: str) -> DataFrame:
    """Of rows with one xref in a document the first one, by an aggregate that combines before its shuffle."""
    first = F.min_by(F.struct(*images.columns), F.struct(*order))
    return images.groupBy(F.col("doc_id").alias("_d"), F.col("xref").alias("_x")).agg(first.alias("r")).select("r.*")


def page_images(images: DataFrame, min_area: float = MIN_IMAGE_AREA) -> DataFrame:
    """Images of a size worth keeping; an unknown box passes. An xref is seen only after the filters."""
    good = (F.col("width") >= MIN_IMAGE_PIXELS) & (F.col("height") >= MIN_IMAGE_PIXELS) & F.coalesce(F.col("box_w") * F.col("box_h") >= min_area, F.lit(True))
    return first_seen(images.where(good), "page_number", "idx")


def figures(images: DataFrame, max_pages: int | None = None, min_area: float = MIN_IMAGE_AREA) -> DataFrame:
    """Figures of the first pages with a known box of the least area; an xref is seen before decoding."""
    rows = images.where((F.col("box_w") * F.col("box_h")) >= min_area)
    if max_pages is not None:
        rows = rows.where(F.col("page_number") <= max_pages)
    return first_seen(rows, "page_number", "idx")


def equations(images: DataFrame) -> DataFrame:
    """Images of an equation's shape that carry data."""
    low, high = EQUATION_ASPECT
    aspect = F.try_divide(F.col("width").cast("double"), F.col("height").cast("double"))
    return images.where(aspect.between(low, high) & F.col("has_data"))


def image_path(doc: Column, page: Column, index: Column, kind: Column, root: str = "images") -> Column:
    return F.concat_ws("/", F.lit(root), doc, F.concat(F.lit("page_"), page.cast("string")), F.concat(F.lit("img_"), index.cast("string"), F.lit("."), kind))


def table_boxes(boxes: DataFrame) -> DataFrame:
    return boxes.where("w >= 20 AND h >= 20")


def table_rows(boxes: DataFrame, key: str = "table_id") -> DataFrame:
    """Row of each cell box, in (y, x) order: a new row starts where y is more than the box's own height
    from the row's first y. A fold over the boxes of one table, which are few."""
    ordered = F.array_sort(F.collect_list(F.struct("y", "x", "w", "h")))
    zero = F.struct(F.lit(-1).alias("row"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<struct<y:double,x:double,w:double,h:double,row:int>>").alias("out"))

    def step(acc: Column, b: Column) -> Column:
        new = acc["anchor"].isNull() | (F.abs(b["y"] - acc["anchor"]) > b["h"])
        row = acc["row"] + new.cast("int")
        cell = F.struct(b["y"].alias("y"), b["x"].alias("x"), b["w"].alias("w"), b["h"].alias("h"), row.alias("row"))
        return F.struct(row.alias("row"), F.when(new, b["y"]).otherwise(acc["anchor"]).alias("anchor"), F.concat(acc["out"], F.array(cell)).alias("out"))

    cells = boxes.select(key, *[F.col(c).cast("double").alias(c) for c in "yxwh"]).groupBy(key).agg(ordered.alias("b"))
    return cells.select(key, F.explode(F.aggregate("b", zero, step)["out"]).alias("c")).select(key, "c.*")


def table_text(cells: DataFrame, key: str = "table_id") -> DataFrame:
    """Cells joined by tabs, rows by newlines."""
    rows = cells.groupBy(key, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "text"))), lambda c: c["text"]), "\t").alias("t"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "t"))), lambda r: r["t"]), "\n").alias("text"))


def grid_text(rows: Column) -> Column:
    """Text of a table of rows of cells: cells trimmed, joined by bars; lines by newlines."""
    return F.array_join(F.transform(rows, lambda r: F.array_join(F.transform(r, lambda c: F.trim(c)), " | ")), "\n")


def histogram(pixels: DataFrame, key: str, value: str) -> DataFrame:
    return pixels.groupBy(key, F.col(value).alias("bin")).agg(F.count("*").alias("n"))


def otsu(bins: DataFrame, key: str) -> DataFrame:
    """Otsu's threshold of each histogram of at most 256 bins: the first bin of the greatest variance
    between classes, 200 where there is none."""
    w = Window.partitionBy(key).orderBy("bin")
    all_ = Window.partitionBy(key)
    weighted = F.col("bin") * F.col("n")
    df = bins.withColumns({"wb": F.sum("n").over(w), "sb": F.sum(weighted).over(w), "total": F.sum("n").over(all_), "all_sum": F.sum(weighted).over(all_)})
    wb, wf = F.col("wb").cast("double"), (F.col("total") - F.col("wb")).cast("double")
    apart = F.try_divide(F.col("sb").cast("double"), wb) - F.try_divide((F.col("all_sum") - F.col("sb")).cast("double"), wf)
    df = df.withColumn("variance", F.when((wb > 0) & (wf > 0), wb * wf * apart * apart))
    best = F.min_by(F.when(F.col("variance") > 0, F.col("bin")), F.when(F.col("variance") > 0, F.struct(-F.col("variance"), F.col("bin"))))
    return df.groupBy(key).agg(F.coalesce(best, F.lit(OTSU_DEFAULT)).alias("threshold"))


def layout(line_density: Column, ink: Column, edges: Column) -> Column:
    """Layout class of a page from its densities."""
    return F.when(line_density > 0.01, "table").when((ink > 0.10) & (edges < 0.08), "text").otherwise("noisy")
