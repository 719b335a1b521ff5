"""Consolidated reports, batch summaries and ground-truth evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PREVIEW_CHARS, TEXT_CHARS
from ..functions.text import char_distance, character_error_rate, clamped, preview, squeeze, strip, word_distance, word_error_rate, words


def approved_pages(pages: DataFrame, quality: DataFrame) -> DataFrame:
    """Approved pages with previews of their texts."""
    good = quality.where("status = 'approved'").select("doc_id", "page_number")
    return (pages.join(good, ["doc_id", "page_number"], "left_semi")
            .select("doc_id", "page_number", "source", preview(F.col("text"), PREVIEW_CHARS).alias("preview"), preview(F.col("text"), TEXT_CHARS).alias("text"), F.length("text").alias("n_chars")))


def needs_review(quality: DataFrame) -> DataFrame:
    return quality.where("status = 'needs_review'").select("doc_id", "page_number", "page_type", F.array_join("failed_gates", ",").alias("failed_gates"))


def quality_summary(quality: DataFrame) -> DataFrame:
    """Per document: counts and the ordered page lists."""
    good = F.col("status") == "approved"
    pages = lambda hit: F.array_join(F.array_sort(F.collect_list(F.when(hit, F.col("page_number")))), ",")
    return quality.groupBy("doc_id").agg(F.count_if(good).alias("approved_count"), F.count_if(~good).alias("needs_review_count"),
                                         pages(good).alias("approved_pages"), pages(~good).alias("review_pages"))


def usable_diagrams(diagrams: DataFrame) -> DataFrame:
    return diagrams.where(F.col("error").isNull() & (F.coalesce(F.col("description"), F.lit("")) != ""))


def batch_summary(quality: DataFrame, rollup: bool = False) -> DataFrame:
    """Pages, failed pages and their share per document; with ``rollup`` a total row (null doc_id) too."""
    grouped = quality.rollup("doc_id") if rollup else quality.groupBy("doc_id")
    bad = F.count_if(F.col("status") != "approved")
    return grouped.agg(F.count("*").alias("pages"), bad.alias("failed"), F.coalesce(F.try_divide(bad.cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("ratio"))


def match_pages(extracted: DataFrame, truth: DataFrame) -> DataFrame:
    """Extraction and ground truth by page, with what is missing on either side."""
    e = extracted.select("doc_id", "page_number", F.col("text").alias("hypothesis"))
    g = truth.select("doc_id", "page_number", F.col("text").alias("reference"))
    side = F.when(F.col("hypothesis").isNull(), "missing_extraction").when(F.col("reference").isNull(), "missing_truth").otherwise("matched")
    return e.join(g, ["doc_id", "page_number"], "full_outer").withColumn("side", side)


def evaluate(matched: DataFrame) -> DataFrame:
    """Clamped word similarity and character error rate of matched pages."""
    r, h = F.col("reference"), F.col("hypothesis")
    return matched.where("side = 'matched'").select("doc_id", "page_number", clamped(1 - word_error_rate(r, h)).alias("wer_similarity"), character_error_rate(r, h).alias("cer"))


def stats(rows: DataFrame, *columns: str, deviation: bool = False) -> DataFrame:
    """Mean, median, least and greatest of columns (null without values), one row a column; with
    ``deviation`` the sample deviation too, 0 for a single value."""
    out = None
    for c in columns:
        n = F.count(c)
        extra = [F.when(n > 1, F.stddev_samp(c)).when(n == 1, F.lit(0.0)).alias("stdev")] if deviation else []
        part = rows.agg(F.avg(c).alias("mean"), F.median(c).alias("median"), F.min(c).alias("least"), F.max(c).alias("most"), *extra, n.alias("n")).withColumn("metric", F.lit(c))
        out = part if out is None else out.unionByName(part)
    return out


def threshold_failures(evaluated: DataFrame, least_similarity: float = 0.90, most_cer: float = 0.10) -> DataFrame:
    """Pages that fail a threshold; the run passes or fails on the means."""
    low, high = F.col("wer_similarity") < least_similarity, F.col("cer") > most_cer
    return evaluated.where(low | high).withColumn("fails", F.concat_ws(",", F.when(low, "wer"), F.when(high, "cer")))


def verdict(evaluated: DataFrame, least_similarity: float = 0.90, most_cer: float = 0.10) -> DataFrame:
    return evaluated.agg(F.avg("wer_similarity").alias("mean_similarity"), F.avg("cer").alias("mean_cer")).withColumn(
        "passed", F.coalesce((F.col("mean_similarity") >= least_similarity) & (F.col("mean_cer") <= most_cer), F.lit(False)))


def fuzzy(reference: Column, hypothesis: Column) -> dict[str, Column]:
    """Case-preserving character and word similarity, clamped and rounded to four places."""
    r, h = squeeze(reference), squeeze(hypothesis)
    over = lambda d, n: F.greatest(F.lit(0.0), F.round(1 - d.cast("double") / n, 4))
    return {"char_similarity": F.when(r != "", over(char_distance(r, h), F.length(r))),
            "word_similarity": F.when(r != "", over(word_distance(words(r), words(h)), F.size(words(r))))}


def exit_code(status: Column, error: Column, fail_on_review: bool = True) -> Column:
    """0 fine, 1 an extraction error, 2 another error, 3 needs review where that counts."""
    known = error.isin("MissingDependencyError", "PdfValidationError", "PdfProcessingError", "MaxPagesExceededError", "EmptyContentError", "QualityGateError", "ExtractionError")
    return (F.when(error.isNotNull() & known, 1).when(error.isNotNull(), 2).when(F.lit(fail_on_review) & (status == "needs_review"), 3).otherwise(0))


def full_text(pages: DataFrame) -> DataFrame:
    """Non-blank page texts of a document, joined in page order."""
    parts = F.array_sort(F.collect_list(F.when(strip(F.col("text")) != "", F.struct("page_number", strip(F.col("text")).alias("t")))))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["t"]), "\n").alias("full_text"))
