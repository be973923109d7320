"""Runtime composites: routes, gates, patches, resets, kept state."""

import pytest
from pyspark.sql import functions as F

from quillsieve.operators import runtimes as R
from quillsieve.operators import sessions

LOG = "waiting for lock\n" * 200 + "done"
CALLS = "session string, seq long, call_id string, tool string, command string, path string, offset long, reset string, blocks array<struct<type:string,text:string>>"


def calls(spark):
    text = lambda *t: [("text", x) for x in t]
    rows = [
        ("s", 1, "a", "bash", "make", None, None, None, [*text(LOG), ("image", "raw"), *text("short")]), ("s", 2, "a", "bash", "make", None, None, None, [*text(LOG), ("image", "raw"), *text("short")]),
        ("s", 3, "b", "bash", "TRIM_OFF=1 make", None, None, None, text(LOG)), ("s", 4, None, None, None, None, None, "compaction", None), ("s", 5, "a", "bash", "make", None, None, None, text(LOG, "short")),
        ("s", 6, None, None, None, None, None, "switch", None), ("s", 7, "a", "bash", "make", None, None, None, text(LOG, "short")), ("s", 8, "c", "read", None, "/src/a.py", None, None, text(LOG)),
        ("s", 9, "d", "read", None, "/var/log/a.log", None, None, text(LOG)), ("s", 10, "e", "read", None, "/tmp/trim-sidecar/x.txt", 1, None, text("line")), ("s", 11, "f", "mcp__a", None, None, None, None, text(LOG)),
        ("s", 12, "g", "bash", "ls", None, None, None, None), ("s", 13, "h", "bash", "ls", None, None, None, text("")),
    ]
    return spark.createDataFrame(rows, CALLS)


def handled(spark, name, mcp=None):
    return {r.seq: r for r in R.handle(calls(spark), R.RUNTIMES[name], mcp).collect()}


def test_pi(spark):
    got = handled(spark, "pi")
    assert [got[k].route for k in sorted(got)] == ["condense", "repeated", "bypass", "reset", "repeated", "reset", "condense", "skip", "condense", "verbatim", "condense", "skip", "condense"]
    assert [b.text for b in got[1].blocks] == ["waiting for lock  [trim hook: line repeated 200x]\ndone", "raw", "short"]
    assert got[1].applied and got[1].in_bytes == len(LOG) + 5 and got[1].sidecars == 0 and not got[13].applied and got[12].blocks is None
    kept = R.records(R.handle(calls(spark), R.RUNTIMES["pi"]), R.RUNTIMES["pi"]).collect()
    assert {r.seq for r in kept} == {1, 3, 7, 9, 10, 11, 13} and [r.in_bytes for r in kept if r.verbatim] == [4]


@pytest.mark.parametrize("mcp, route", [(R.Observed("off"), "skip"), (R.Observed("observe", "a"), "observe"), (R.Observed("on"), "observe"), (R.Observed("on", "mcp__b"), "observe"), (R.Observed("on", "mcp__a"), "condense")])
def test_other_servers_tools(spark, mcp, route):
    got = handled(spark, "claude", mcp)[11]
    assert got.route == route and got.applied == (route == "condense")
    assert (got.blocks[0].text == LOG) != got.applied and (route == "skip" or got.would_bytes < got.in_bytes == len(LOG))


def test_denied_tool_is_left(spark):
    got = handled(spark, "claude", R.Observed("on", "mcp", "__a"))[11]
    assert not got.applied and got.in_bytes is None


def test_joined_results_become_one_text(spark):
    got = handled(spark, "codex")
    assert [b.text for b in got[5].blocks] == ["waiting for lock  [trim hook: line repeated 200x]\ndone\nshort"] and got[9].route == "skip"


def test_resets_inside_folds(spark):
    rows = [("s", 1, 2_000_000, None, "c", "h", "eval", 80, False, "t"), ("s", 2, None, "compaction", "c", "h", "eval", 0, False, "t"), ("s", 3, 1_000_000, None, "c", "h", "eval", 70, False, "t"),
            ("s", 4, None, "switch", None, None, "eval", 0, False, "t"), ("s", 5, 10, None, "c", "h", "eval", 1, False, "t")]
    d = spark.createDataFrame(rows, "session string, seq long, bytes long, reset string, call_id string, hash string, profile string, words long, blocker boolean, turn_key string")
    column = lambda df, c: [r[c] for r in df.orderBy("seq").collect()]
    assert column(sessions.pressure_hysteresis(d), "band") == ["high", "low", "mid", "low", "low"]
    assert column(sessions.repeated_calls(d), "repeated") == [False, False, True, False, False]
    assert column(sessions.narration_meter(d), "total") == [80, None, 70, None, 1]


def test_state_and_settings(spark):
    texts = ['{"pressureBand":3,"observedBytes":5,"profile":"eval","turnCounter":"x"}', '{"pressureBand":"mid","profile":"own","compactionEpoch":2.5}', "[]", "broken", None]
    got = [tuple(r.s) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(R.state_of(F.col("t")).alias("s")).collect()]
    none = ("low", 0, 0, None, 0, 0)
    assert got == [("low", 5, 0, "eval", 0, 0), ("mid", 0, 0, None, 0, 0), none, none, none]
    assert [R.positive(v, 3) for v in (" 12px", "-1", "0", "+7", "x", None)] == [12, 3, 3, 7, 3, 3]
    assert R.telemetry({"log": "/x"}) and not R.telemetry({"log": ""}) and not R.telemetry({})


def test_empty(spark):
    assert R.handle(calls(spark).limit(0), R.RUNTIMES["pi"], R.Observed()).count() == 0
