"""The pipeline's stages, each held against a plain form on its own input."""

import numpy as np
import pytest
from tokenizers import Tokenizer

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from quillsieve.llm import jaccard_join as J, queries, secrets  # noqa: E402
from quillsieve.llm.common import written  # noqa: E402

from .helpers import collected, odd_docs  # noqa: E402
from .test_dedup import brute_components  # noqa: E402


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf))
        seen[name] = (before, docs)
        if name != "encoding":
            assert docs.columns == columns
    before, after = seen["quality"]
    bad = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 0").collect()}
    gone = {i for i, _ in collected(before)} - {i for i, _ in collected(after)}
    assert bad and len(bad & gone) >= 0.9 * len(bad)
    before, after = seen["near_duplicates"]
    want = {i for i, _, c in brute_components(collected(before), 5, 80) if i == c}
    assert {repr(i) for i, _ in collected(after)} == want
    before, after = seen["secrets"]
    assert before.count() == after.count() and secrets.scan(after, secrets.BASE).where("size(found) > 0").count() == 0
    before, after = seen["mixing"]
    assert 0.7 * before.count() < after.count() <= before.count()
    before, after = seen["encoding"]
    own = Tokenizer.from_file(queries.tokenizer_file("word_bpe_49k.json"))
    texts = dict(collected(before))
    assert all(r.n_tokens == len(own.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in after.collect())
    assert [tuple(r) for r in corpus_pipeline.run(spark, sf).orderBy("doc_id").collect()] == [tuple(r) for r in after.orderBy("doc_id").collect()]


def test_odd_rows_pass_every_stage(spark, sf):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf))
        empty = stage(spark, odd_docs(spark).limit(0), sf)
        assert empty.count() == 0
    assert docs.count() > 0 and np.all([r.n_tokens >= 0 for r in docs.collect()])
    assert J.shingles([b"a"], 3) == {(b"a",)}


def test_columns_of_clashing_names_keep_their_values(spark, sf):
    from pyspark.sql import functions as F

    names = ["rows", "found", "predicted", "score", "__id", "__rows", "__found", "__kinds", "__text", "key", "label", "map", "n", "sig", "topic", "weight", "probability", "u", "n_tokens"]
    docs = odd_docs(spark, 30).drop("predicted", "score").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf))
        assert docs.schema.names == before.schema.names, name
        assert docs.where(" OR ".join(f"coalesce(`{c}` <> concat('{c}', doc_id), false)" for c in names)).count() == 0, name
        assert docs.where("`rows` IS NULL AND doc_id IS NOT NULL").count() == 0, name
