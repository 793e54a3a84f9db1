"""Plans around the per-page kernel: map-only, with only the columns that are needed sent to Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelift.operators.article import Article, Failed, Options, extract_node, extract_page
from pagelift.sources.html import COMMENT, DOCTYPE, DOCUMENT, ELEMENT, TEXT, Node, parse

#: Pages that a task holds as Python objects at a time.
PAGES = 500

RESULT = T.StructType(
    [T.StructField("status", T.StringType()), T.StructField("error_count", T.IntegerType()), T.StructField("error_max", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("title", "byline", "dir", "lang", "content", "text_content")]
    + [T.StructField("length", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("excerpt", "site_name", "published_time")]
    + [T.StructField("attempts", T.IntegerType())]
)
NODES = "array<struct<id:int,parent:int,depth:int,pos:int,last_id:int,kind:tinyint,tag:string,text:string,attrs:array<struct<key:string,val:string>>>>"

NODE_COLUMNS = [("id", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("pos", pa.int32()), ("last_id", pa.int32()), ("kind", pa.int8()), ("tag", pa.string()), ("text", pa.string()), ("attrs", pa.list_(pa.struct([("key", pa.string()), ("val", pa.string())])))]


def _clean(value: object) -> object:
    """Strings without halves of surrogate pairs, which UTF-8 cannot hold."""
    return value.encode("utf-16", "surrogatepass").decode("utf-16", "replace") if isinstance(value, str) and not value.isascii() else value


def _rows(get: Callable[[], Article]) -> dict:
    out: dict = dict.fromkeys(RESULT.fieldNames())
    try:
        found = get()
    except Failed as e:
        return out | {"status": e.status, "error_count": e.count, "error_max": e.most}
    return out | {"status": "ok"} | {k: _clean(v) for k, v in vars(found).items()}


def _arrow(kind: T.DataType) -> pa.DataType:
    return pa.int32() if isinstance(kind, T.IntegerType) else pa.string()


def _map(df: DataFrame, id_cols: Sequence[str], inputs: Sequence, schema: T.StructType, one: Callable[..., list[pa.Array]]) -> DataFrame:
    """mapInArrow over the columns of id_cols and inputs; one makes the arrays of schema from the inputs' lists."""
    n_ids, n_inputs, names = len(id_cols), len(inputs), [*id_cols, *schema.fieldNames()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PAGES):
                part = batch.slice(at, PAGES)
                made = one(*(part.column(n_ids + k).to_pylist() for k in range(n_inputs)))
                yield pa.record_batch([*(part.column(k) for k in range(n_ids)), *made], names=names)

    chosen = df.select(*id_cols, *(c.alias(f"_in{k}") for k, c in enumerate(inputs)))
    return chosen.mapInArrow(run, T.StructType([*(df.schema[c] for c in id_cols), *schema.fields]))


def extract_articles(df: DataFrame, id_cols: Sequence[str] = ("page_id",), url_col: str = "url", html_col: str = "html", options: Options | None = None, **changes) -> DataFrame:
    """RESULT for each page, after its id columns. changes are single options; status says why a page has none."""
    own = replace(options or Options(), **changes)

    def one(pages: list, urls: list) -> list[pa.Array]:
        rows = [dict.fromkeys(RESULT.fieldNames()) | {"status": "read_error"} if p is None else _rows(lambda p=p, u=u: extract_page(p, u or "", own)) for p, u in zip(pages, urls, strict=True)]
        return [pa.array([r[f.name] for r in rows], _arrow(f.dataType)) for f in RESULT]

    return _map(df, id_cols, [F.col(html_col).cast("string"), F.col(url_col).cast("string")], RESULT, one)


def flatten(doc: Node) -> list[dict]:
    """Rows of a tree in document order; last_id is that of the last node below, attributes keep their order."""
    out: list[dict] = []
    todo: list[tuple[Node | dict, int, int, int]] = [(doc, -1, 0, 0)]
    while todo:
        n, parent, depth, pos = todo.pop()
        if isinstance(n, dict):
            n["last_id"] = len(out) - 1
            continue
        row = {"id": len(out), "parent": parent, "depth": depth, "pos": pos, "last_id": len(out), "kind": n.kind, "tag": n.tag, "text": _clean(n.text), "attrs": [{"key": _clean(k), "val": _clean(v)} for k, v in n.attrs]}
        out.append(row)
        if n.children:
            todo.append((row, 0, 0, 0))
            todo.extend((c, row["id"], depth + 1, i) for i, c in reversed(list(enumerate(n.children))))
    return out


def unflatten(rows: list[dict]) -> Node:
    """The tree of flattened rows; the first is its root, a document, html or body."""
    nodes: dict[int, Node] = {}
    for r in sorted(rows, key=lambda r: r["id"]):
        n = Node(r["kind"], r["tag"] or "", r["text"] or "", [[a["key"], a["val"]] for a in r["attrs"] or []])
        nodes[r["id"]] = n
        if r["parent"] in nodes:
            nodes[r["parent"]].append(n)
    if not nodes:
        raise Failed("no_body")
    return nodes[min(nodes)]


def node_table(df: DataFrame, id_cols: Sequence[str] = ("page_id",), html_col: str = "html") -> DataFrame:
    """The tree of each page as an array of nodes (null for null)."""
    schema = T.StructType.fromDDL(f"nodes {NODES}")
    kind = pa.list_(pa.struct(NODE_COLUMNS))

    def one(pages: list) -> list[pa.Array]:
        return [pa.array([None if p is None else flatten(parse(p)) for p in pages], kind)]

    return _map(df, id_cols, [F.col(html_col).cast("string")], schema, one)


def extract_articles_from_nodes(df: DataFrame, id_cols: Sequence[str] = ("page_id",), url_col: str = "url", nodes_col: str = "nodes", options: Options | None = None, **changes) -> DataFrame:
    """As extract_articles, from trees that were parsed before."""
    own = replace(options or Options(), **changes)

    def get(rows: list[dict], url: str) -> Article:
        return extract_node(unflatten(rows), url, own)

    def one(trees: list, urls: list) -> list[pa.Array]:
        rows = [dict.fromkeys(RESULT.fieldNames()) | {"status": "no_body"} if t is None else _rows(lambda t=t, u=u: get(t, u or "")) for t, u in zip(trees, urls, strict=True)]
        return [pa.array([r[f.name] for r in rows], _arrow(f.dataType)) for f in RESULT]

    return _map(df, id_cols, [F.col(nodes_col), F.col(url_col).cast("string")], RESULT, one)


def to_json(articles: DataFrame) -> DataFrame:
    """The articles' JSON, with the names of a page API."""
    names = {"title": "title", "byline": "byline", "dir": "dir", "lang": "lang", "content": "content", "text_content": "textContent", "length": "length", "excerpt": "excerpt", "site_name": "siteName", "published_time": "publishedTime"}
    rest = [c for c in articles.columns if c not in RESULT.fieldNames()]
    return articles.select(*rest, F.when(F.col("status") == "ok", F.to_json(F.struct(*(F.col(k).alias(v) for k, v in names.items())))).alias("json"))


__all__ = ["COMMENT", "DOCTYPE", "DOCUMENT", "ELEMENT", "NODES", "RESULT", "TEXT", "extract_articles", "extract_articles_from_nodes", "flatten", "node_table", "to_json", "unflatten"]
