"""Adapters for recognition engines and language models, each behind a check of its availability.

An adapter is a function from a pandas row batch to a result batch. Engines load once per
worker. Without an engine the deterministic fallback runs, or a RuntimeError says what is missing.
"""

from __future__ import annotations

import importlib.util
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import LLM_BATCH, OCR_CHUNK_PAGES
from ..functions.text import json_list
from ..operators.confidence import PAGE, chunk_pages, progressive_retry

MODULES = {"pymupdf": "fitz", "tesseract": "pytesseract", "paddleocr": "paddleocr", "sarvam": "sarvamai", "math": "pix2tex", "tables": "camelot", "llm": "openai", "vlm": "openai"}


def available(name: str) -> bool:
    return importlib.util.find_spec(MODULES[name]) is not None


def require(*names: str) -> None:
    missing = [n for n in names if not available(n)]
    if missing:
        raise RuntimeError("MissingDependencyError: " + ", ".join(missing))


def recognise(pages: DataFrame, engine: Callable[[list], list[str | None]], chunk: int = OCR_CHUNK_PAGES, attempts: int = 3, backoff: float = 1.0) -> DataFrame:
    """Texts of pages from an engine that takes chunks of page numbers of one document; a chunk that
    fails ``attempts`` times gives empty texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for (doc, _), part in b.groupby(["doc_id", "chunk"], sort=False):
                numbers, texts = part["page_number"].tolist(), None
                for k in range(attempts):
                    try:
                        texts = engine([(doc, n) for n in numbers])
                        break
                    except Exception:
                        time.sleep(backoff * 2**k if k < attempts - 1 else 0)
                rows += zip([doc] * len(numbers), numbers, texts or [""] * len(numbers))
            yield pd.DataFrame(rows, columns=[*PAGE, "text"])

    kinds = dict(pages.dtypes)
    dealt = chunk_pages(pages.select(*PAGE), chunk).repartition(F.col("doc_id"), F.col("chunk")).sortWithinPartitions("doc_id", "chunk", "page_number")
    return dealt.mapInPandas(run, f"doc_id {kinds['doc_id']}, page_number {kinds['page_number']}, text string")


def recognise_progressively(pages: DataFrame, engine, chunk: int = OCR_CHUNK_PAGES, backoff: float = 1.0) -> DataFrame:
    """Three passes: chunks, then pages without text in half-size chunks, then one by one."""
    sizes = [chunk, *([max(2, chunk // 2)] if chunk > 2 else []), 1]
    out = recognise(pages, engine, sizes[0], backoff=backoff)
    for size in sizes[1:]:
        blank = out.where(F.trim(F.coalesce("text", F.lit(""))) == "").select(*PAGE)
        out = progressive_retry([out, recognise(blank, engine, size, backoff=backoff)])
    return out


def prompt_batches(questions: DataFrame, size: int = LLM_BATCH) -> DataFrame:
    """Questions of a document in batches, each with its prompt."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("question_number"))
    line = F.format_string("Q%d: %s", "question_number", "text")
    rows = questions.withColumn("batch", F.floor((order - 1) / size).cast("int"))
    return rows.groupBy("doc_id", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("question_number", line.alias("l")))), lambda x: x["l"]), "\n").alias("prompt"))


def enrich_questions(questions: DataFrame, model: Callable[[str], str | None], size: int = LLM_BATCH, attempts: int = 3, backoff: float = 1.0) -> DataFrame:
    """doc_id, question_number, topic, marks and difficulty by a model that answers a batch's prompt with a
    JSON list. A batch whose answer fails ``attempts`` times, or is no list, has no rows: its questions
    keep what ``enrich_fallback`` gives them when the result is joined by ``join_enrichment``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers = []
            for prompt in b["prompt"]:
                answer = None
                for k in range(attempts):
                    try:
                        answer = model(prompt)
                        break
                    except Exception:
                        time.sleep(backoff * (k + 1) if k < attempts - 1 else 0)
                answers.append(answer)
            yield pd.DataFrame({"doc_id": b["doc_id"], "batch": b["batch"], "answer": answers})

    prompts = prompt_batches(questions, size)
    answered = prompts.mapInPandas(run, f"doc_id {dict(questions.dtypes)['doc_id']}, batch int, answer string")
    rows = answered.select("doc_id", "batch", F.posexplode(json_list(F.col("answer"), "question_number:int,topic:string,marks:int,difficulty:string".join(("struct<", ">")))).alias("at", "e"))
    return rows.select("doc_id", "e.*", (F.col("batch") * 1_000_000 + F.col("at")).alias("ordinal")).where("question_number IS NOT NULL")
