"""Schemas of the engine's tables, as DDL, and checks of their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"
TABLES = {
    "documents": "doc_id string, filename string, ingested_at timestamp, method string, pages_total bigint, dpi int, engine string, language string, full_text string",
    "native_pages": "doc_id string, page_number int, text string, char_count int, page_width double, page_height double",
    "tokens": "doc_id string, page_number int, token_idx int, text string, bbox struct<x:int,y:int,w:int,h:int>, confidence double",
    "ocr_candidates": "doc_id string, page_number int, pass_id int, strategy string, psm int, text string, score double, n_tokens bigint",
    "ocr_pages": "doc_id string, page_number int, text string, pass_similarity double, layout string, engine string",
    "page_quality": "doc_id string, page_number int, status string, layout string, page_type string, avg_confidence double, low_conf_ratio double, pass_similarity double, "
                    "native_similarity double, failed_gates array<string>, accuracy_score double, decision string, selected_source string",
    "images": f"doc_id string, page_number int, idx int, xref int, format string, width int, height int, bbox {BOX}, size_bytes int, image_url string, image_path string, raw_bytes binary",
    "layout_blocks": f"doc_id string, page_number int, idx int, type string, bbox {BOX}, text string, font string, size double, color int",
    "page_tables": f"doc_id string, page_number int, idx int, rows array<array<string>>, num_rows int, csv_text string, bbox {BOX}",
    "diagrams": f"doc_id string, page_number int, ordinal int, bbox {BOX}, area double, description string, kind string, error string",
    "questions": "doc_id string, question_number int, section string, page_number int, question_text string, marks int, difficulty string, question_type string, has_or_alternative boolean, or_of int",
    "question_options": "doc_id string, question_number int, sort_order int, label string, text string",
    "question_images": "doc_id string, question_number int, sort_order int, storage_key string, description string",
    "question_parts": "doc_id string, question_number int, sort_order int, label string, text string",
    "jobs": "job_id string, status string, result string, error string, created_at double, updated_at double, filename string",
}
KEYS = {"documents": ["doc_id"], "native_pages": ["doc_id", "page_number"], "questions": ["doc_id", "question_number"], "question_options": ["doc_id", "question_number", "sort_order"], "jobs": ["job_id"]}
#: Child tables and the parent columns they refer to.
REFERENCES = {"questions": ("documents", ["doc_id"]), "question_options": ("questions", ["doc_id", "question_number"]), "question_images": ("questions", ["doc_id", "question_number"]),
              "question_parts": ("questions", ["doc_id", "question_number"])}


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    """Keys that occur more than once; none if the table's primary key holds."""
    return df.groupBy(*KEYS[table]).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, table: str) -> DataFrame:
    """Rows of a child table without a parent."""
    return child.join(parent.select(*REFERENCES[table][1]).distinct(), REFERENCES[table][1], "left_anti")
