"""Whole plans: from page tables to verdicts, documents and reports; from pages to a question bank."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Gate, MAX_RETRIES
from ..operators import confidence, gate, questions, report


def extraction(pages: DataFrame, tokens: DataFrame, ocr_pages: DataFrame, verdicts: Gate | None = None, **kw) -> dict[str, DataFrame]:
    """The extraction of documents as tables: page verdicts, assembled pages, documents, statistics."""
    stats = confidence.page_confidence(pages, confidence.keep_tokens(tokens))
    joined = (pages.select("doc_id", "page_number", F.col("text").alias("native_text"))
              .join(ocr_pages.select("doc_id", "page_number", F.col("text").alias("ocr_text"), "pass_similarity", "layout"), ["doc_id", "page_number"], "left")
              .join(stats, ["doc_id", "page_number"], "left"))
    quality = gate.page_quality(joined, verdicts, **kw)
    assembled = gate.assemble_pages(quality)
    return {"page_quality": quality, "pages": assembled, "documents": gate.assemble_documents(assembled, force_ocr=kw.get("force_ocr", False)),
            "status": gate.doc_status(quality), "stats": confidence.doc_stats(stats), "approved_pages": report.approved_pages(assembled, quality)}


def retried(current: DataFrame, recognise, failing, retries: int = MAX_RETRIES) -> DataFrame:
    """The bounded loop of retries: only failing pages are recognised again, with the parameters of the attempt."""
    for attempt in range(retries):
        current = confidence.quality_retry(current, recognise(current.where(failing), attempt))
    return current


def question_bank(pages: DataFrame) -> dict[str, DataFrame]:
    """Relational tables of the question banks in pages."""
    enriched = questions.enrich(questions.segments(pages))
    return {"enriched": enriched, **questions.bank_tables(enriched), "sections": questions.sections(report.full_text(pages))}
