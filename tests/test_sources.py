"""Sources and sinks over small files."""

import json

from pyspark.sql import functions as F

from quillsieve import sources
from quillsieve.operators import condense, report, textops


def test_hook_events(spark, tmp_path):
    rows = [
        {"session_id": "s", "call_id": "1", "tool_name": "Bash", "tool_input": {"command": "make"}, "tool_response": {"stdout": "a", "stderr": "b", "interrupted": True}},
        {"session_id": "s", "call_id": "2", "tool_name": "Read", "tool_input": {"file_path": "/x.log", "limit": 5}, "tool_response": {"file": {"filePath": "/x.log", "content": "c"}}},
        {"session_id": "s", "call_id": "3", "tool_name": "mcp__x", "tool_response": {"content": [{"type": "text", "text": "t"}, {"type": "image"}]}},
    ]
    (tmp_path / "e.json").write_text("\n".join([*map(json.dumps, rows), "{broken"]))
    got = sources.shell_hook_events(spark, str(tmp_path / "e.json")).orderBy("call_id", "field").collect()
    assert [(r.call_id, r.field, r.text, r.exit_code) for r in got] == [("1", "stderr", "b", 1), ("1", "stdout", "a", 1), ("2", "content", "c", None)]
    assert [r.text for r in sources.joined_hook_events(spark, str(tmp_path / "e.json")).orderBy("call_id").collect()] == ["a\nb", None, None]
    assert [(r.block, r.type) for r in sources.block_events(spark, str(tmp_path / "e.json")).collect()] == [(0, "text"), (1, "image")]


def test_transcript(spark, tmp_path):
    rows = [
        {"type": "user", "message": {"role": "user", "content": "first"}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "text": "no"}]}},
        {"type": "user", "isMeta": True, "message": {"role": "user", "content": "meta"}},
        {"type": "user", "message": {"role": "user", "content": [{"type": "text", "text": "second"}]}},
        {"type": "assistant", "message": {"role": "assistant", "content": "x"}},
    ]
    (tmp_path / "t.jsonl").write_text("\n".join([*map(json.dumps, rows), "broken", ""]))
    t = sources.transcript(spark, str(tmp_path / "t.jsonl"))
    assert t.count() == 5
    assert sources.last_prompt(t).first().prompt == "second"
    assert sources.transcript(spark, str(tmp_path / "t.jsonl"), 100).count() < 5


def test_metrics_round_trip(spark, tmp_path):
    rows = [{"ts": "2024-01-01T00:00:00Z", "inBytes": 100, "outBytes": 40, "changed": True, "strategy": "tsc"}, {"inBytes": 10, "bypass": True}]
    (tmp_path / "m.jsonl").write_text("\n".join([*map(json.dumps, rows), "", "{bad"]))
    m = sources.metrics(spark, str(tmp_path / "m.jsonl")).withColumn("pos", F.monotonically_increasing_id())
    row = report.summary(m).first()
    assert (row.calls_processed, row.bypasses, row.bytes_saved, row.tokens_saved, row.estimator, row.ratio) == (1, 1, 60, 15, "bytes/4", 0.4)
    assert "calls_processed: 1" in report.rendered(m) and json.loads(report.rendered(m, True))["bytes_saved"]["value"] == 60
    assert "no data" in report.rendered(m.limit(0))
    sources.append_metrics(m.drop("pos"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2


def test_sidecars_are_written_once(spark, tmp_path):
    text = "\n".join(f"step {i} " + "z" * 30 + " y" * (i % 4) for i in range(800))
    done = condense.condense(spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string"), ["doc_id"])
    path = str(tmp_path / "saved")
    assert sources.write_sidecars(done, path) == 1
    assert sources.write_sidecars(done, path) == 0
    saved = spark.read.parquet(path)
    assert saved.first().total_lines == 800
    assert sources.expired(saved, F.current_timestamp() + F.expr("INTERVAL 73 HOURS")).count() == 1
    assert sources.expired(saved, F.current_timestamp()).count() == 0


def test_saved_outputs_carry_their_facts(spark, tmp_path):
    text = "\n".join([*(f"step {i} " + "z" * 30 + " y" * (i % 4) for i in range(800)), "error: one", "2 errors", "warning: w", "tests failed", "[trim hook: 3 lines omitted, no error]"])
    rows = spark.createDataFrame([(1, "s/1", text), (2, None, text), (3, "s/1", text.replace("one", "two"))], "doc_id long, session_id string, text string")
    done = condense.condense(rows, ["doc_id", "session_id"])
    assert sources.write_sidecars(done, str(tmp_path / "saved")) == 3
    saved = spark.read.parquet(str(tmp_path / "saved")).collect()
    assert {(r.schema, r.session_id, r.errors, r.warnings, r.census, r.hostComplete) for r in saved} == {
        (2, s, 3, 1, "3 errors, 1 failure, 1 warning", True) for s in ("s/1", None)
    }
    for r in saved:
        assert textops.count_signals(r.content) == (r.errors, r.warnings)
        assert textops.digest(r.content, [])[2] == r.census


def test_sidecar_meta(spark):
    new = {"schema": "x/sidecar-meta/2", "content": "host-truncated", "runtime": "pi", "totalLinesObserved": 4, "bytesObserved": 9, "hostComplete": False, "diagnostics": {"errors": 1, "warnings": 2}}
    new |= {"contentHash": "h", "census": "1 error", "sessionId": "s", "createdAt": "2024-01-01T00:00:00Z"}
    rows = [json.dumps(x) for x in (new, {"schema": 1, "totalLines": 3, "bytes": 7}, {"schema": "x/sidecar-meta/1", "sessionId": "t", "census": "c"}, {"schema": 9}, {"schema": "x/other/2"}, [2])]
    got = [r.facts and tuple(r.facts) for r in sources.sidecar_meta(spark.createDataFrame([(r,) for r in [*rows, "bad", None]], "meta string").coalesce(1)).collect()]
    assert got[0] == (2, 4, 9, "host-truncated", "pi", False, 1, 2, "h", "1 error", "s", "2024-01-01T00:00:00Z")
    assert got[1] == (2, 3, 7, "complete-cleaned", "unknown", True, 0, 0, None, "", None, None)
    assert got[2] == (2, None, None, "complete-cleaned", "unknown", True, 0, 0, None, "c", "t", None)
    assert got[3:] == [None] * 5


def test_records_need_a_sink(spark, tmp_path):
    done = spark.createDataFrame([("t", 5, 3)], "tag string, inBytes long, outBytes long")
    assert not sources.record(done.selectExpr("raise_error('computed') AS tag", "inBytes", "outBytes"))
    assert sources.record(done, log_path=str(tmp_path / "log")) and not (tmp_path / "metrics").exists()
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["t 5 -> 3"]


def test_settings_are_positive_numbers():
    assert [sources.positive_int(v, 72) for v in ("5", " 7h", "+3", "0", "-1", "x", "", None, 4)] == [5, 7, 3, 72, 72, 72, 72, 72, 4]


def test_gate_is_per_call(spark):
    big = "\n".join(["same line of output"] * 500)
    blocks = spark.createDataFrame([(1, 1, big), (1, 2, "short"), (2, 1, "short")], "call int, block int, text string")
    done = condense.gate(condense.condense(blocks, ["call", "block"]), ["call"])
    assert {(r.call, r.block): r.applied for r in done.collect()} == {(1, 1): True, (1, 2): True, (2, 1): False}
    assert len(sources.hook_response(done).collect()) == 2
