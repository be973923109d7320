"""The condensing composite: published sizes, signal vectors, edge cases, invariants."""

import json

import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from quillsieve import constants as C
from quillsieve.functions import text
from quillsieve.operators import condense, formats, textops as T

from .fixtures import EXPECTED, FIXTURES

FOLDER = "/tmp/trim-sidecar"


def run(text, **options):
    return T.condense(text, T.Options(**options), FOLDER, formats.first_match)


@pytest.mark.parametrize("name", FIXTURES)
def test_published_sizes(name):
    text, options = FIXTURES[name]
    r = run(text, no_sidecar=True, **options)
    assert (r["inputBytes"], r["outputBytes"], r["strategy"], r["lossy"], r["preservedErrors"], r["preservedWarnings"]) == EXPECTED[name]


SIGNAL = [
    "Found 3 errors and 2 warnings.", "- Expected", "+ Received", "E       assert 0 == 3600", "not ok 3 - handles empty input", "✗ should update the cache", "× order > applies discount once",
    "Segmentation fault (core dumped)", "command terminated with exit code 137", "Process exited with non-zero exit status", "FATAL: could not connect to server", "DeprecationWarning: Buffer() is deprecated",
    "UnhandledPromiseRejection: missing", "ld: undefined reference to `png_create_read_struct`", "Killed (OOM)", "AssertionError: expected 90 to be 81",
]
PLAIN = ["The Terror is a novel by Dan Simmons", "errorless operation is the goal", "unexpectedly fast build", "exit code 0"]


@pytest.mark.parametrize("line", SIGNAL)
def test_signal(line):
    assert T.is_signal(line)
    filler = [f">>> filler item number {i} <<<" for i in range(400)]
    filler[200] = line
    assert line in run("\n".join(filler), exit_code=0, no_sidecar=True)["out"]


@pytest.mark.parametrize("line", PLAIN)
def test_plain(line):
    assert not T.is_signal(line)


def test_python_and_columns_agree_on_signal(spark):
    from quillsieve.operators.lines import with_signal

    rows = [(k, 0, x) for k, x in enumerate([*SIGNAL, *PLAIN, "éerror", "ſignal warn", "", " ✗ x"])]
    got = with_signal(spark.createDataFrame(rows, "doc_id long, ln int, line string")).orderBy("doc_id").collect()
    assert [r.signal for r in got] == [T.is_signal(x) for _, _, x in rows]


def test_cap_and_floors():
    rows = "\n".join(" ".join(f"w{i}_{k}" for k in range(i % 5 + 1)) for i in range(1000))
    assert run(rows, exit_code=0, no_sidecar=True)["outputLines"] == 122
    assert run(rows, exit_code=1, no_sidecar=True)["outputLines"] == 302
    assert run(rows, exit_code=0, no_sidecar=True, scale=0.1)["outputLines"] == 32
    assert run(rows, exit_code=0, no_sidecar=True, enumerate=True)["out"] == rows
    assert run(rows, exit_code=0, no_sidecar=True, profile="eval")["outputLines"] == 62
    assert run(rows, exit_code=0, no_sidecar=True, task_phase="final-verification")["profile"] == "final-verification"


def test_relevance_keeps_what_is_named_within_budget():
    lines = [f"row {'x ' * (i % 5)}{i}" + (" needle" if i % 50 == 0 else "") for i in range(2000)]
    r = run("\n".join(lines), exit_code=0, no_sidecar=True, tokens=["needle"])
    kept = set(r["out"].split("\n"))
    assert "row 0 needle" in kept and len(kept) <= 120 + 120
    assert T.relevance_hits(["A", "b", "a"], ["a"]) == [0, 2]
    assert T.relevance_hits(["a"] * 51, ["a"]) == []


def test_digest_and_saved_copy():
    rows = [f"step {i} " + "z" * (i % 7 + 20) + f" {' y' * (i % 4)}" for i in range(800)]
    rows[300], rows[500] = "warning: slow link", "error: build broke"
    r = run("\n".join(rows), session_id="abc/def-123456")
    assert r["strategy"] == "sidecar" and r["sidecarPath"].startswith(f"{FOLDER}/abc_def-") and r["sidecar"] == T.clean("\n".join(rows))
    assert "L501: error: build broke" in r["out"] and "(1 error, 1 warning)" in r["out"]
    assert run("\n".join(rows), host_may_truncate=True)["strategy"] == "generic"
    assert "saved as observed" in run("\n".join(rows), host_complete=False, host_may_truncate=True)["out"]


def test_trailer_and_condensed():
    body = "\n".join(f"item {i} " + "q" * (i % 9) + " k" * (i % 4) for i in range(2000))
    out = run(body + "\nFull result: /tmp/x\n", exit_code=0, no_sidecar=True)["out"]
    assert out.endswith("\nFull result: /tmp/x")
    envelope = json.dumps({"a": list(range(9999))}) + "\nFull result: /tmp/x"
    assert run(envelope)["strategy"] == "passthrough-condensed" and run(envelope)["out"] == envelope
    assert T.condensed("[other hook: cut]\nx") and not T.condensed("[trim hook: cut]\nx") and not T.condensed("a\nb")


def test_empty_and_blank():
    assert run("")["out"] == "" and run("")["strategy"] is None
    assert run(" \n\n\n\n ")["out"] == "\n\n"
    assert run("50%\r")["out"] == ""


def test_formats_decline():
    assert formats.read_audit(json.dumps({"vulnerabilities": []}), T.Options(command="npm audit")) is None
    assert formats.first_match("x" * 5000, T.Options()) is None
    assert formats.first_match("[" + "{" * 3000, T.Options()) is None
    with pytest.raises(ValueError):
        formats.strict_json("NaN")


def test_audit_labels():
    report = {"vulnerabilities": {"b": {"severity": "low", "isDirect": False, "fixAvailable": {"name": "b", "version": "2", "isSemVerMajor": True}}, "@a/x": {"via": ["q", {"title": "t"}, "r", "s"], "fixAvailable": False}}, "metadata": {"totalDependencies": 4}}
    out = formats.read_audit(json.dumps(report), T.Options(command="npm audit"))[0]
    assert out.split("\n")[1:] == ["unknown @a/x — q; t; r [no fix]", "low b [transitive; fix: b@2 (major)]", "dependencies: 4"]


@pytest.mark.parametrize("n", [2, 5, 20, 500])
def test_diagnostic_blocks_keep_every_place(n):
    text = "\n".join(f"error[E0308]: mismatched types\n --> src/f{i}.rs:{i}:5\n  |" for i in range(n)) + "\nwarning[x]: unused\n --> a.rs:1:1\n" + " | pad" * 80
    found = formats.read_diagnostics(text, T.Options())
    assert found is None or all(f"src/f{i}.rs:{i}" in found[0] for i in range(n))


def test_token_classes(spark):
    from pyspark.sql import functions as F

    from quillsieve.functions import scalars as S

    texts = ["", "plain words of a sentence that goes on and on in the usual way of things", '{"a":[1,2,{"b":"c"}],"d":[[3],[4]]}', "漢字かな交じり文です", "if (a[0] == b) { return f(x, y); } else { g(); }", "éé 🔥🔥 x", "a" * 70000]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", S.token_class(F.col("t")).alias("c"), S.token_estimate(F.col("t")).alias("n"), S.utf16_length(F.col("t")).alias("u"), S.fnv1a(F.col("t")).alias("h")).orderBy("k").collect()
    for row, t in zip(rows, texts):
        assert (row.n, row.c) == T.token_estimate(t) and row.u == T.units(t) and row.h == T.fnv1a(t)
    assert T.fnv1a("foobar") == "bf9cf968" and T.fnv1a("é🔥") == "27d0d8fa"


lines = st.lists(st.sampled_from(["", "INFO job 1 done", "INFO job 2 done", "error: x", "a b c", "  ", "ok\r", "\x1b[31mred\x1b[0m", "warning w", "same", "same"]), max_size=300)


@settings(max_examples=60, deadline=None)
@given(lines)
def test_invariants(rows):
    text = "\n".join(rows)
    clean = T.clean(text)
    assert T.clean(clean) == clean
    r = run(text, exit_code=0, no_sidecar=True)
    if text and r["strategy"] == "generic":
        assert r["out"] == text or T.units(r["out"]) <= T.units(text) + 200
        kept = r["out"]
        assert all(s in kept for s in clean.split("\n") if T.is_signal(s))


def test_registered_names(spark):
    from quillsieve.functions.register import register

    register(spark)
    row = spark.sql("SELECT clean_text('a  \\n') AS c, is_signal('error') AS s, token_class('x') AS t, fnv1a('foobar') AS h, token_estimate('abcd') AS n, condense_text('x') AS o").first()
    assert (row.c, row.s, row.h, row.o) == ("a\n", True, "bf9cf968", "x")
    got = spark.sql("SELECT * FROM condense_lines('a\\nerror: b')").collect()
    assert [(r.ln, r.kind) for r in got] == [(0, "plain"), (1, "signal")]


def test_constants_are_sane():
    assert C.duck(C.SIGNAL).count("(?<") == 0


def test_users_patterns(spark):
    lines = [f"row {'ab'[i % 2] * 5} {i * 7919} {'xyz'[i % 3] * 9}" for i in range(400)]
    lines[150], lines[250], lines[-1] = "KEEP this line", "error: none of the user's", "Receipt: /a/b"
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").withColumn("exit_code", F.lit(0)).withColumn("no_sidecar", F.lit(True))
    plain = condense.condense(docs, ["doc_id"]).first()
    assert "error: none" in plain.out and "KEEP this" not in plain.out and plain.preservedErrors == 1
    own = condense.condense(docs, ["doc_id"], keep="keep this", keep_last="^Receipt: ").first()
    assert "KEEP this" in own.out and "error: none" not in own.out and own.out.endswith("\nReceipt: /a/b")
    assert condense.condense(docs, ["doc_id"], keep_last="(").first().out == plain.out
    assert T.trailer("a\nReceipt: /a/b\n", "^Receipt: ") == "Receipt: /a/b" and T.trailer("Full result: /x", "(") == "Full result: /x"
    got = spark.createDataFrame([("KEEP this",), ("error",), ("TypeError",)], "line string").select(text.is_signal(F.col("line"), "keep this").alias("s")).collect()
    assert [r.s for r in got] == [T.is_signal(x, "keep this") for x in ("KEEP this", "error", "TypeError")] == [True, False, True]
