"""Extraction over a stream of pages. The kernel keeps no state, so every trigger is a batch of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pagelift.operators.article import Options
from pagelift.plans.kernel import extract_articles


def read_pages(spark: SparkSession, path: str, schema: str = "page_id long, url string, html string") -> DataFrame:
    """Pages from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def extract_stream(pages: DataFrame, options: Options | None = None, **changes) -> DataFrame:
    """Articles of a stream of pages; append mode, no watermark is needed."""
    return extract_articles(pages, options=options, **changes)


def write_articles(articles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write all articles that are there to Parquet, each once, and stop."""
    return articles.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
