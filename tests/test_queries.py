"""Every registered query runs, and equals its DuckDB form where it has one."""

import pytest

from quillsieve.plans.queries import ORACLES, QUERIES

from .compare import duck, rows


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, sf, name):
    sf = "/root/testdata/sf0.01" if name.startswith("fmt_") else sf  # formats need texts of some length
    own = QUERIES[name](spark, sf).toPandas()
    assert len(own)
    if name in ORACLES:
        other = duck(sf).sql(ORACLES[name]).df()
        assert sorted(own.columns) == sorted(other.columns)
        assert rows(own) == rows(other)


def test_corpora_reach_every_strategy(spark, sf):
    found = {r.strategy for r in QUERIES["strategy_route"](spark, "/root/testdata/sf0.01").collect()}
    assert {"eslint-json", "tsc", "jest-vitest", "pytest", "go-test", "diffstat", "jsonl-log", "npm-audit", "diagnostic-block", "sidecar", "generic"} <= found


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_same_under_any_partitioning(spark, sf):
    from quillsieve.operators import condense, lines
    from quillsieve.plans import corpora
    from pyspark.sql import functions as F

    docs = corpora.load_texts(spark, sf, corpora.event_log)
    want = rows(condense.condense(docs, ["doc_id"]).select("doc_id", "out").toPandas())
    assert rows(condense.condense(docs.repartition(13), ["doc_id"]).select("doc_id", "out").toPandas()) == want
    log = corpora.load(spark, sf, corpora.event_runs)
    assert rows(lines.dedupe_runs(log.repartition(7, F.rand(1))).toPandas()) == rows(lines.dedupe_runs(log).toPandas())


def test_scans_prune_columns(spark, sf):
    plan = QUERIES["net_win"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "o_orderpriority" not in plan and "Exchange" not in plan
    plan = QUERIES["dup_ring"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in plan.split("ReadSchema")[-1]


def test_trailer_kept_is_the_operators(spark, tmp_path):
    from hashlib import md5

    texts = {0: "a", 2: "a\nFull result: /own", 3: "b\nFull result: /three\n", 4: "c", 7: "Full result: /x\nlater"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in QUERIES["trailer_kept"](spark, str(tmp_path)).collect()}
    want = {0: "cut", 2: "cut\nFull result: /own", 3: "cut\nFull result: /three", 4: "cut\nFull result: /tmp/out", 7: "cut"}
    assert got == {k: md5(v.encode()).hexdigest() for k, v in want.items()}
