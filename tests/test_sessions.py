"""Session operators: unit vectors, and streams equal to the batch folds."""

from collections import OrderedDict

from pyspark.sql import functions as F

from quillsieve import streaming
from quillsieve.operators import sessions as S

KIB = 1024


def test_bands():
    assert [S.next_band(b, n * KIB) for b, n in (("low", 430), ("low", 460), ("mid", 390), ("mid", 350))] == ["low", "mid", "mid", "low"]
    assert S.next_band("high", 950 * KIB) == "high" and S.next_band(None, None) == "low"


def test_handled_evicts_oldest():
    state = OrderedDict()
    for k in range(201):
        state, (again,) = S.step_handled(state, {"call_id": str(k), "hash": "h"})
        assert not again
    assert S.step_handled(state, {"call_id": "0", "hash": "h"})[1] == (False,)
    assert S.step_handled(state, {"call_id": "200", "hash": "h"})[1] == (True,)


def test_narration_rearms():
    state, seen = {}, []
    for words in (70, 1, 17, 1, 18):
        state, (_, fires) = S.step_narration(state, {"profile": "eval", "words": words, "blocker": False, "turn_key": "t"})
        seen.append(fires)
    assert seen == [False, True, False, True, True]
    assert S.step_narration({}, {"profile": "other", "words": 99, "blocker": False, "turn_key": "t"})[1] == (None, False)


def _rows(spark, n=400):
    return spark.range(n).select(
        F.concat(F.lit("s"), (F.col("id") % 3).cast("string")).alias("session"), F.col("id").alias("seq"), (F.col("id") * 1000).alias("at"), (F.pmod(F.xxhash64("id"), F.lit(1400)) * KIB).alias("bytes"),
        F.concat(F.lit("h"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(25)).cast("string")).alias("hash"), F.concat(F.lit("c"), (F.col("id") % 11).cast("string")).alias("call_id"), (F.col("id") % 97 == 50).alias("reset"),
        F.lit("eval").alias("profile"), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(60)).alias("words"), (F.col("id") % 13 == 0).alias("blocker"), F.floor(F.col("id") / 20).cast("string").alias("turn_key"),
        F.floor(F.col("id") / 100).alias("epoch"), F.concat(F.lit("m"), F.pmod(F.xxhash64("id", F.lit(3)), F.lit(6)).cast("string")).alias("cmd_hash"), (F.col("id") % 10 == 0).alias("bypass"),
        F.when(F.col("id") % 4 == 0, F.lit("/f")).alias("path"), F.when(F.col("id") % 4 == 0, F.lit("c")).alias("content"), (F.col("id") % 3 == 0).alias("lossy"), (F.col("id") % 6 == 0).alias("sidecar"), (F.col("id") % 17 == 0).alias("sidecar_read"), (F.col("id") % 5 == 0).alias("is_edit"),
        F.lit(None).cast("string").alias("range"), F.lit(None).cast("string").alias("marker"), F.lit(True).alias("applied"),
    )


def _stream(spark, tmp_path, make, name):
    _rows(spark).repartition(3, "session").write.mode("overwrite").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(_rows(spark).schema).parquet(str(tmp_path / "in"))
    done = make(rows).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert done.awaitTermination(180)
    return {(r.session, r.seq): tuple(r)[2:] for r in spark.table(name).collect()}


def _batch(df, *columns):
    return {(r.session, r.seq): tuple(r)[2:] for r in df.select("session", "seq", *columns).collect()}


def test_stream_bands(spark, tmp_path):
    assert _stream(spark, tmp_path, streaming.pressure_bands, "bands") == _batch(S.pressure_hysteresis(_rows(spark)), "band")


def test_stream_duplicates(spark, tmp_path):
    own = S.exact_duplicates(S.islands(_rows(spark), F.col("reset")))
    got = _stream(spark, tmp_path, streaming.duplicates, "dups")
    want = _batch(own, "duplicate", "age_ms")
    assert {k: (d, None if a is None or a != a else int(a)) for k, (d, a) in got.items()} == want


def test_stream_repeats_and_narration(spark, tmp_path):
    assert _stream(spark, tmp_path / "a", streaming.repeated_calls, "repeats") == _batch(S.repeated_calls(_rows(spark)), "repeated")
    got = _stream(spark, tmp_path / "b", streaming.narration, "narration")
    want = _batch(S.narration_meter(_rows(spark)), "total", "exceeded")
    assert {k: e for k, (_, e) in got.items()} == {k: e for k, (_, e) in want.items()}


def test_stream_recovery(spark, tmp_path):
    own = S.recovery(S.epoch_islands(_rows(spark)))
    assert _stream(spark, tmp_path, streaming.recovery, "recovery") == _batch(own, "kind")
