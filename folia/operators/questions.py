"""Exam question banks: pages of lines become questions, options, sections, images and tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BBOX_TOLERANCE, DEFAULT_PAGE_HEIGHT
from ..functions.text import strip

#: Patterns of exam papers (fixed values).
SECTION = r"(?U)^\s*(I{1,3}|IV|VI{0,3}|IX|X)\s*[.)]\s+"
QUESTION = r"(?U)^\s*(?:Q\.?\s*)?(\d{1,3})\s*[.)]\s"
OR_LINE = r"(?iU)^\s*OR\s*$"
OR_SPLIT = r"(?imU)^\s*OR\s*$"
MARKS_HEADER = r"(?U)(\d+)\s+[x×]?\s*(\d+)\s*=\s*(\d+)"
FIGURE = r"(?iU)(?:in\s+the\s+figure|as\s+shown|the\s+(?:given\s+)?(?:figure|diagram|graph))"
INSTRUCTIONS = r"(?iU)(?:General\s+Instructions|Instructions\s+to\s+the\s+candidate)"
OPTION = r"(?sU)\(([A-Da-d])\)\s*(.+?)(?=\s*\([A-Da-d]\)|\s*$)"
TITLE = r"(?iU)(S\.?S\.?L\.?C\.?\s+MODEL\s+QUESTION\s+PAPER[^\n]*)"
SUBJECT = r"(?U)Subject\s*:\s*([A-Z][A-Za-z ]+)"
TOTAL_MARKS = r"(?iU)Max\.?\s*Marks?\s*:\s*(\d+)"

PAGE = ["doc_id", "page_number"]


def _found(x: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def lines(pages: DataFrame) -> DataFrame:
    """One row a line with what it is. ``page_order`` (or else the page number) gives the order of pages."""
    order = F.col("page_order") if "page_order" in pages.columns else F.col("page_number")
    good = pages.where((strip(F.coalesce("text", F.lit(""))) != "") & ~F.col("text").rlike(INSTRUCTIONS))
    out = good.select(*PAGE, order.alias("page_order"), F.length("text").alias("page_chars"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    number = _found(F.col("line"), QUESTION).cast("int")
    return out.withColumns({"section_header": _found(F.col("line"), SECTION), "question_number": number, "is_start": number.isNotNull(),
                            "is_or": F.col("line").rlike(OR_LINE), "is_marks": strip(F.col("line")).rlike(f"^(?:{MARKS_HEADER})$")})


def carry_sections(rows: DataFrame) -> DataFrame:
    """Each line's section: the last header before it in the document, across pages."""
    w = Window.partitionBy("doc_id").orderBy("page_order", "page_number", "line_no")
    return rows.withColumn("section", F.last("section_header", ignorenulls=True).over(w))


def number_segments(rows: DataFrame) -> DataFrame:
    """Segment of each line (lines before a page's first question have none) and where the line starts on the page."""
    w = Window.partitionBy(*PAGE, "page_order").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)) / F.greatest(F.col("page_chars"), F.lit(1))
    return rows.withColumns({"segment": F.sum(F.col("is_start").cast("int")).over(w), "line_at": at}).where("segment >= 1")


def segments(pages: DataFrame) -> DataFrame:
    """Question segments of all documents: number, section, text, alternative after OR, and extent on the page."""
    rows = number_segments(carry_sections(lines(pages)))
    text = F.when(F.col("is_start"), strip(F.col("line"))).when(~F.col("is_marks"), F.col("line"))
    kept = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("line_no", text.alias("t")))))
    first = lambda c: F.max(F.when(F.col("is_start"), F.col(c)))
    out = rows.groupBy(*PAGE, "page_order", "segment").agg(
        first("question_number").alias("question_number"), first("section").alias("section"), first("line_at").alias("y_start"),
        F.max("is_or").alias("has_or_alternative"), F.concat(F.array_join(F.transform(kept, lambda k: k["t"]), "\n"), F.lit("\n")).alias("raw"))
    end = F.lead("y_start").over(Window.partitionBy(*PAGE, "page_order").orderBy("segment"))
    parts = F.split("raw", OR_SPLIT, 2)
    split = F.col("has_or_alternative") & (F.size(parts) == 2)
    return out.select(*PAGE, "page_order", "segment", "question_number", "section", F.when(split, strip(parts[0])).otherwise(F.col("raw")).alias("text"),
                      F.when(split, strip(F.get(parts, 1))).alias("or_text"), "has_or_alternative", "y_start", F.coalesce(end, F.lit(1.0)).alias("y_end"))


def sort_key() -> list[Column]:
    """Order of a question bank: by number, unnumbered and 0 last, then by place."""
    return [F.coalesce(F.nullif(F.col("question_number"), F.lit(0)), F.lit(9999)), F.col("page_order"), F.col("segment")]


def figure_reference(text: Column) -> Column:
    return text.rlike(FIGURE)


def options(text: Column) -> Column:
    """Array of (label, text) of multiple-choice options."""
    labels, texts = F.regexp_extract_all(text, F.lit(OPTION), F.lit(1)), F.regexp_extract_all(text, F.lit(OPTION), F.lit(2))
    return F.zip_with(labels, texts, lambda a, b: F.struct(F.upper(a).alias("label"), strip(b).alias("text")))


def marks(text: Column) -> Column:
    """A number of 1 to 10 at the end of the text."""
    value = _found(strip(text), r"(?U)\b(\d{1,2})\s*$").cast("int")
    return F.when(value.between(1, 10), value)


def difficulty(m: Column) -> Column:
    return F.when(m <= 1, "easy").when(m <= 3, "medium").when(m.isNotNull(), "hard")


def enrich(rows: DataFrame) -> DataFrame:
    """What patterns alone tell of a question."""
    found = options(F.col("text"))
    m = marks(F.col("text"))
    return rows.withColumns({"options": found, "marks": m, "difficulty": difficulty(m), "has_figure": figure_reference(F.col("text")),
                             "question_type": F.when(F.size(found) > 0, "mcq").otherwise("short_answer"), "topic": F.lit(None).cast("string")})


def join_enrichment(rows: DataFrame, enrichment: DataFrame) -> DataFrame:
    """Enrichment by question number; of repeated numbers the last one counts (column ``ordinal``)."""
    last = enrichment.groupBy("doc_id", "question_number").agg(F.max_by(F.struct("topic", "marks", "difficulty"), "ordinal").alias("e"))
    return rows.join(last, ["doc_id", "question_number"], "left").select(*rows.columns, F.col("e.topic").alias("e_topic"), F.col("e.marks").alias("e_marks"), F.col("e.difficulty").alias("e_difficulty"))


def exam_metadata(text: Column) -> dict[str, Column]:
    return {"exam_title": strip(_found(text, TITLE)), "subject": strip(_found(text, SUBJECT)), "total_marks": _found(text, TOTAL_MARKS).cast("int")}


def sections(documents: DataFrame, text: str = "full_text") -> DataFrame:
    """Sections with questions and marks, where count times marks is the total. A section reaches from
    its header to the next one."""
    parts = documents.select("doc_id", F.posexplode(F.split(F.col(text), r"(?mU)(?=^\s*(?:I{1,3}|IV|VI{0,3}|IX|X)\s*[.)]\s+)")).alias("ordinal", "part"))
    label = _found(F.col("part"), SECTION)
    number = lambda k: _found(F.col("part"), MARKS_HEADER, k).try_cast("long")
    out = parts.select("doc_id", "ordinal", label.alias("section"), number(1).alias("count"), number(2).alias("marks_per_question"), number(3).alias("total"))
    return out.where("section IS NOT NULL AND count * marks_per_question = total").drop("total")


def proximity(at: Column, start: Column, end: Column) -> Column:
    """How far an image is from a segment; lower is better."""
    start, end = F.coalesce(start, F.lit(0.0)), F.coalesce(F.nullif(end, F.lit(0.0)), F.lit(1.0))
    return F.when((start <= at) & (at <= end), at - start).when(at > end, at - end + 0.01).otherwise(start - at + 0.5)


def associate_images(images: DataFrame, found: DataFrame) -> DataFrame:
    """The segment of each image on its page: one that refers to a figure if there is any, then the
    nearest, then the first. Images without a box have none."""
    where = F.coalesce(F.col("y"), F.lit(0.0)) / F.coalesce(F.nullif(F.col("page_height"), F.lit(0.0)), F.lit(DEFAULT_PAGE_HEIGHT))
    segs = found.select(*PAGE, "segment", "page_order", "question_number", figure_reference(F.col("text")).alias("fig"), "y_start", "y_end")
    pairs = images.where("has_bbox").withColumn("at", where).join(segs, PAGE).withColumn("distance", proximity(F.col("at"), F.col("y_start"), F.col("y_end")))
    best = F.min_by(F.struct("segment", "question_number", "fig", "distance"), F.struct(~F.col("fig"), "distance", "page_order", "segment"))
    return pairs.groupBy(*PAGE, "idx").agg(best.alias("b")).select(*PAGE, "idx", "b.*")


def match_diagrams(images: DataFrame, diagrams: DataFrame) -> DataFrame:
    """The first diagram whose box starts near the image's on the same page."""
    d = diagrams.select(*PAGE, F.col("x").alias("dx"), F.col("y").alias("dy"), "ordinal", "description")
    near = images.join(d, PAGE).where((F.abs(F.col("dx") - F.col("x")) < BBOX_TOLERANCE) & (F.abs(F.col("dy") - F.col("y")) < BBOX_TOLERANCE))
    return near.groupBy(*PAGE, "idx").agg(F.min_by("description", "ordinal").alias("description"))


def bank_tables(questions: DataFrame) -> dict[str, DataFrame]:
    """Relational rows of enriched questions: documents, questions (an alternative after OR is a row of
    its own, number times 1000), options and images with their order."""
    own = questions.select("doc_id", "question_number", "section", "page_number", F.col("text").alias("question_text"), "marks", "difficulty", "question_type",
                           "has_or_alternative", F.lit(None).cast("int").alias("or_of"))
    alternative = questions.where("or_text IS NOT NULL").select(
        "doc_id", (F.col("question_number") * 1000).alias("question_number"), "section", "page_number", F.concat(F.lit("[OR] "), "or_text").alias("question_text"), "marks",
        "difficulty", "question_type", F.lit(False).alias("has_or_alternative"), F.col("question_number").alias("or_of"))
    opts = questions.select("doc_id", "question_number", F.posexplode("options").alias("sort_order", "o")).select("doc_id", "question_number", "sort_order", "o.label", "o.text")
    out = {"documents": questions.groupBy("doc_id").agg(F.count("*").alias("total_questions")), "questions": own.unionByName(alternative), "question_options": opts}
    # Children of questions that have them: columns ``images`` (paths) and ``sub_parts`` (label, text, marks).
    for name, column, fields in (("question_images", "images", {"image_path": "o"}), ("question_parts", "sub_parts", {"label": "o.label", "text": "o.text", "marks": "o.marks"})):
        if column in questions.columns:
            rows = questions.select("doc_id", "question_number", F.posexplode(column).alias("sort_order", "o"))
            out[name] = rows.select("doc_id", "question_number", "sort_order", *[F.col(c).alias(n) for n, c in fields.items()])
    return out


def bank_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """doc_id, table and rows of each table of ``bank_tables``."""
    out = None
    for name, df in tables.items():
        part = df.groupBy("doc_id").agg(F.count("*").alias("n_rows")).withColumn("table", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def question_order(segments: DataFrame) -> DataFrame:
    """Segments with their place in their document: by question number, where number 0 and none come last."""
    by = Window.partitionBy("doc_id").orderBy(F.coalesce(F.nullif("question_number", F.lit(0)), F.lit(9999)), "page_number", "segment")
    return segments.withColumn("place", F.row_number().over(by))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], version: str = "ingested_at") -> DataFrame:
    """The table after an upsert: of rows with a key the latest version stays."""
    all_ = table.unionByName(rows)
    latest = F.max_by(F.struct(*all_.columns), version)
    return all_.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(latest.alias("r")).select("r.*")
