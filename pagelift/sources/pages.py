"""Tables of pages: page_id, url, html."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("page_id", "url", "html")


def read_files(spark: SparkSession, path: str, base_url: str = "") -> DataFrame:
    """One page a file; the file's name ends its URL, and a hash of its path is its id. Bytes that are no UTF-8 are
    replaced, as in a decoder that never fails; Spark passes over files without bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a page at a time: a file may be large
                page, url, content = (batch.column(k)[i].as_py() for k in range(3))
                yield pa.record_batch([pa.array([page]), pa.array([url]), pa.array([(content or b"").decode("utf-8", "replace")])], names=["page_id", "url", "html"])

    files = spark.read.format("binaryFile").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    url = F.concat(F.lit(base_url), name) if base_url else F.lit("")
    return files.select(F.xxhash64("path").alias("page_id"), url.alias("url"), "content").mapInArrow(decode, "page_id long, url string, html string")
