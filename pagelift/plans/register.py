"""SQL functions over the kernel and its Column twins."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelift.functions import text, urls
from pagelift.operators.article import extract_page
from pagelift.operators.readable import probably_article
from pagelift.plans.kernel import NODE_COLUMNS, NODES, RESULT, _rows, flatten
from pagelift.sources.html import parse

COLUMNS = [name for name, _ in NODE_COLUMNS]


def register(spark: SparkSession) -> None:
    """extract_article(html, url), probably_article(html), plain_text_length(text), absolute_url(base, ref); and the table
    function nodes(html) for use with LATERAL: a row for each node of the page's tree, none for null."""

    @F.pandas_udf(RESULT)
    def extract_article(html: pd.Series, url: pd.Series) -> pd.DataFrame:
        rows = [dict.fromkeys(RESULT.fieldNames()) | {"status": "read_error"} if h is None else _rows(lambda h=h, u=u: extract_page(h, u or "")) for h, u in zip(html, url, strict=True)]
        return pd.DataFrame(rows, columns=RESULT.fieldNames()).astype({c: "Int32" for c in ("error_count", "error_max", "length", "attempts")})

    @F.pandas_udf("boolean")
    def probably(html: pd.Series) -> pd.Series:
        return html.map(lambda h: h is not None and probably_article(parse(h)))

    @F.pandas_udf("int")
    def length(value: pd.Series) -> pd.Series:
        return value.map(lambda v: None if v is None else text.utf16(v)).astype("Int32")

    @F.pandas_udf("string")
    def absolute(base: pd.Series, ref: pd.Series) -> pd.Series:
        def one(b: str | None, r: str | None) -> str | None:
            start, own = urls.parse(b or ""), urls.parse(r or "")
            return r if start is None or own is None or r is None else str(urls.resolve(start, own))

        return pd.Series([one(b, r) for b, r in zip(base, ref, strict=True)])

    for name, f in (("extract_article", extract_article), ("probably_article", probably), ("plain_text_length", length), ("absolute_url", absolute)):
        spark.udf.register(name, f)

    spark.udtf.register("nodes", F.udtf(Nodes, useArrow=False, returnType=T.StructType.fromDDL(f"nodes {NODES}")["nodes"].dataType.elementType))


class Nodes:
    """The nodes of pages' trees in document order. Rows, not Arrow batches, since Spark joins no other kind laterally."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        if html is not None:
            for r in flatten(parse(html)):
                yield (*(r[name] for name in COLUMNS[:-1]), [(a["key"], a["val"]) for a in r["attrs"]])
