"""Sources: page text, layout, recognised Markdown, ground truth and job files as tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

#: A PDF reader turns the bytes of a file into (page_number, text, width, height) rows.
PdfReader = Callable[[bytes], list[tuple[int, str, float, float]]]


def default_pdf_reader() -> PdfReader | None:
    """A reader on top of PyMuPDF, if that is installed."""
    try:
        import fitz
    except ImportError:
        return None

    def read(data: bytes) -> list[tuple[int, str, float, float]]:
        with fitz.open(stream=data, filetype="pdf") as doc:
            return [(i + 1, p.get_text("text"), round(p.rect.width, 2), round(p.rect.height, 2)) for i, p in enumerate(doc)]

    return read


def pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """All PDF files below a path, in any spelling of the suffix, by path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.lower("path").endswith(".pdf"))


def native_pages(files: DataFrame, reader: PdfReader | None = None) -> DataFrame:
    """One row per page of PDF files; a file that can't be read is one row with its error."""
    reader = reader or default_pdf_reader()
    if reader is None:
        raise RuntimeError("no PDF reader is installed; pass one")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, data in zip(b["path"], b["content"]):
                name = path.rsplit("/", 1)[-1]
                try:
                    rows += [(name, n, t, w, h, None) for n, t, w, h in reader(bytes(data))]
                except Exception as e:  # a broken file becomes an error row
                    rows.append((name, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "page_number", "text", "page_width", "page_height", "error"])

    kind = "doc_id string, page_number int, text string, page_width double, page_height double, error string"
    return files.select("path", "content").mapInPandas(run, kind).withColumn("char_count", F.length(strip(F.col("text"))))


def layout_spans(pages: DataFrame) -> DataFrame:
    """Nested blocks, lines and spans flattened: blank spans go, image blocks have no text, corners
    become x, y, width and height."""
    block = pages.select("doc_id", "page_number", F.posexplode("blocks").alias("block_no", "b"))
    box = lambda c: [F.round(F.col(f"{c}.x0"), 2).alias("x"), F.round(F.col(f"{c}.y0"), 2).alias("y"), F.round(F.col(f"{c}.x1") - F.col(f"{c}.x0"), 2).alias("w"), F.round(F.col(f"{c}.y1") - F.col(f"{c}.y0"), 2).alias("h")]
    spans = (block.where("b.type = 'text'").select("doc_id", "page_number", "block_no", F.posexplode("b.lines").alias("line_no", "l"))
             .select("doc_id", "page_number", "block_no", "line_no", F.posexplode("l").alias("span_no", "s")).where(strip(F.col("s.text")) != ""))
    text = spans.select("doc_id", "page_number", "block_no", "line_no", "span_no", F.lit("text").alias("type"), F.col("s.text").alias("text"), *box("s"))
    image = block.where("b.type = 'image'").select("doc_id", "page_number", "block_no", F.lit(0).alias("line_no"), F.lit(0).alias("span_no"), F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"), *box("b"))
    return text.unionByName(image)


def natural_key(name: Column) -> Column:
    """A sort key in which numbers compare as numbers."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|\D+)")), lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 20, "0")).otherwise(F.lower(p))), "")


def markdown_pages(files: DataFrame, page_numbers: list[int]) -> DataFrame:
    """Recognised Markdown files (doc_id, name, content) mapped to pages. Several files go to the pages
    in natural order; one file is cut at its rules, and if it has fewer parts than pages every page
    gets the whole. Names that start with two underscores don't count."""
    base = F.substring_index("name", "/", -1)
    good = files.where(F.lower("name").rlike(r"\.(md|html)$") & ~F.col("name").startswith("__") & ~base.startswith("__"))
    grouped = good.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(natural_key(F.col("name")).alias("k"), "content"))).alias("f"))
    parts = F.filter(F.transform(F.split(F.col("f")[0]["content"], r"(?m)^---\s*$"), strip), lambda p: p != "")
    wanted = F.array(*map(F.lit, page_numbers))
    whole = F.transform(wanted, lambda _: F.col("f")[0]["content"])
    texts = F.when(F.size("f") > 1, F.transform("f", lambda x: x["content"])).when(F.size(parts) >= len(page_numbers), parts).otherwise(whole)
    zipped = F.zip_with(wanted, texts, lambda n, t: F.struct(n.alias("page_number"), t.alias("text")))
    return grouped.select("doc_id", F.explode(zipped).alias("z")).select("doc_id", "z.page_number", "z.text").where("page_number IS NOT NULL AND text IS NOT NULL")


def ground_truth(raw: DataFrame) -> DataFrame:
    """Ground truth from JSON (doc_id, json), as a map of page numbers or a list of pages; keys that are no numbers go."""
    listed = raw.select("doc_id", F.from_json("json", "pages array<struct<page_number:int,text:string>>").alias("j"), "json")
    a = listed.where("j.pages IS NULL").select("doc_id", F.explode(F.from_json("json", "map<string,string>")).alias("k", "text")).select("doc_id", F.col("k").try_cast("int").alias("page_number"), "text")
    b = listed.where("j.pages IS NOT NULL").select("doc_id", F.explode("j.pages").alias("p")).select("doc_id", "p.page_number", "p.text")
    return a.unionByName(b).where("page_number IS NOT NULL")


def stored_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs from JSON files; broken files are left out."""
    kind = "job_id string, status string, result string, error string, created_at double, updated_at double, filename string, _corrupt_record string"
    return spark.read.schema(kind).option("mode", "PERMISSIVE").json(path).where("_corrupt_record IS NULL AND job_id IS NOT NULL").drop("_corrupt_record")


def accept_uploads(files: DataFrame, most_bytes: int) -> DataFrame:
    """Uploads with the HTTP status of those that are empty (400) or too large (413)."""
    return files.withColumn("http_status", F.when(F.col("length") == 0, 400).when(F.col("length") > most_bytes, 413).otherwise(202))


def missing_pages(wanted: DataFrame, got: DataFrame) -> DataFrame:
    """A result row for every wanted page; pages without one have an empty text."""
    return wanted.join(got, ["doc_id", "page_number"], "left").withColumn("text", F.coalesce("text", F.lit("")))
