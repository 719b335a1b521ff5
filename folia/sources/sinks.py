"""Sinks: reports, question banks and images as files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.images import image_path


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def canonical_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("json"))


def save_images(images: DataFrame, root: str) -> DataFrame:
    """Write images to ``root``, a folder that all executors share, and return (doc_id, page_number,
    idx, path); rows without bytes are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        for b in batches:
            for path, data in zip(b["path"], b["raw_bytes"]):
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(path, "wb") as f:
                    f.write(data)
            yield b[["doc_id", "page_number", "idx", "path"]]

    rows = images.where("raw_bytes IS NOT NULL").withColumn("path", image_path(F.col("doc_id").cast("string"), F.col("page_number"), F.col("idx"), F.coalesce("format", F.lit("png")), root))
    kinds = dict(rows.dtypes)
    return rows.select("doc_id", "page_number", "idx", "path", "raw_bytes").mapInPandas(run, f"doc_id {kinds['doc_id']}, page_number {kinds['page_number']}, idx {kinds['idx']}, path string")


def storage_keys(images: DataFrame) -> DataFrame:
    """Keys under which a question's images are stored; images without a path have none."""
    return images.where("path IS NOT NULL").withColumn("key", F.concat_ws("/", F.col("doc_id").cast("string"), F.concat(F.lit("q"), F.col("question_number").cast("string")), F.substring_index("path", "/", -1)))


def write_bank(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
