"""The pipeline's stages against brute force, each on the rows that the stage before it kept."""

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from pagelift.llm import queries, toxicity
from pagelift.llm.runtime import materialize

from . import test_decontam, test_exact_dedup, test_jaccard, test_packing
from .helpers import odd

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = materialize(stage(spark, docs, sf), "test")
        assert out.schema == docs.schema
        if name == "toxicity":
            labels = spark.read.parquet(f"{sf}/labels.parquet").filter("crc32(cast(doc_id as string)) % 3 != 1")
            scores = toxicity.score(docs, toxicity.train(docs, labels))
            want = {r["doc_id"] for r in scores.filter("score < 0.7").collect()}
        elif name == "exact_dedup":
            want = {r[0] for r in test_exact_dedup.brute(rows) if r[3]}
        elif name == "near_duplicates":
            want = {r[0] for r in test_jaccard.brute(rows) if r[0] == r[2]}
        else:
            want = {i for i, _ in rows} - {r[0] for r in test_decontam.brute(rows, items)}
        assert ids(out) == want and (out.count() < len(rows) or name in ("toxicity", "exact_dedup")), name
        docs = out
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert test_packing.check(docs.collect(), pieces, Tokenizer.from_file(PATH)) < 0.05


def test_run(spark, sf):
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert corpus_pipeline.run(spark, sf).count() > 100


def test_odd_rows(spark, sf, tmp_path):
    """Stages on nulls, empty and repeated rows, and columns with the names that operators use."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    for docs in (odd(spark), odd(spark).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
