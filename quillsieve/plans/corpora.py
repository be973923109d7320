"""Tool outputs derived from the tables, by the same SQL for Spark and for the oracle: whole tables, no limits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Dialect:
    """How an engine names a table and joins strings in order."""

    table: Callable[[str], str]
    spark: bool

    def joined(self, value: str, order: str, sep: str = "chr(10)") -> str:
        if self.spark:
            return f"array_join(transform(array_sort(collect_list(struct({order} AS o, {value} AS v))), x -> x.v), {sep})"
        return f"string_agg({value}, {sep} ORDER BY {order})"


DUCK = Dialect(lambda name: name, False)


def spark_dialect(sf_dir: str) -> Dialect:
    return Dialect(lambda name: f"parquet.`{sf_dir}/{name}.parquet`", True)


def events(d: Dialect) -> str:
    return f"(SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {d.table('events')}) AS ev"


def _numbered(doc: str, order: str, line: str, source: str) -> str:
    return f"SELECT CAST({doc} AS BIGINT) AS doc_id, CAST(row_number() OVER (PARTITION BY {doc} ORDER BY {order}) - 1 AS BIGINT) AS ln, {line} AS line FROM {source}"


def event_log(d: Dialect) -> str:
    """A log a user: errors by code, everything else in one shape."""
    line = "CASE WHEN event_type = 'error' THEN concat('ERROR request ', event_id, ' failed code ', k) ELSE concat('INFO worker handled ', event_type, ' job ', event_id) END"
    return _numbered("user_id", "event_id", line, events(d))


def event_cap(d: Dialect) -> str:
    """Logs of 250 lines with few signal lines; neighbours never have one shape."""
    line = "CASE WHEN event_type = 'error' AND k < 5 THEN concat('ERROR request ', event_id, ' failed code ', k) ELSE rtrim(repeat(concat('job', event_id, ' '), CAST(event_id % 5 + 1 AS INT))) END"
    return _numbered("floor(event_id / 250)", "event_id", line, events(d))


def event_runs(d: Dialect) -> str:
    """Lines that repeat: a line a step of ten events, shared by kinds."""
    return _numbered("user_id % 20", "event_id", "CASE WHEN k < 8 THEN '' WHEN k < 60 THEN 'waiting for lock' WHEN k < 90 THEN concat('step ', user_id % 2) ELSE 'warning: slow' END", events(d))


def event_jsonl(d: Dialect) -> str:
    level = "CASE event_type WHEN 'error' THEN 50 WHEN 'view' THEN 20 ELSE 30 END"
    return _numbered("floor(event_id / 200)", "event_id", f"concat('{{\"level\":', {level}, ',\"msg\":\"job ', event_id, '\"}}')", events(d))


def tsc_rows(d: Dialect) -> str:
    line = "concat('src/p', l_partkey, '.ts(', l_linenumber, ',', l_orderkey % 90, '): error TS', 2000 + l_partkey % 7, ': Kind ', l_partkey % 7)"
    return _numbered("floor(l_orderkey / 200)", "l_orderkey, l_linenumber, l_partkey, l_suppkey", line, d.table("lineitem"))


def js_rows(d: Dialect) -> str:
    line = "CASE WHEN o_orderkey % 9 = 0 THEN concat('   × case ', o_orderkey) WHEN o_orderkey % 40 = 1 THEN concat(' ✓ suite', o_orderkey, ' (15 tests) 20ms') ELSE concat('   ✓ case ', o_orderkey, ' (', o_orderkey % 50, 'ms)') END"
    rows = _numbered("floor(o_orderkey / 400)", "o_orderkey", line, d.table("orders"))
    return f"{rows} UNION ALL SELECT DISTINCT CAST(floor(o_orderkey / 400) AS BIGINT), CAST(1000000000 AS BIGINT), 'Tests:       done' FROM {d.table('orders')}"


def py_rows(d: Dialect) -> str:
    line = "CASE WHEN o_orderkey % 11 = 0 THEN concat('tests/test_a.py::test_', o_orderkey, ' FAILED') ELSE concat('tests/test_a.py::test_', o_orderkey, ' PASSED [ ', o_orderkey % 100, '%]') END"
    rows = _numbered("floor(o_orderkey / 400)", "o_orderkey", line, d.table("orders"))
    doc = f"SELECT DISTINCT CAST(floor(o_orderkey / 400) AS BIGINT) AS doc_id FROM {d.table('orders')}"
    return (
        f"{rows} UNION ALL SELECT doc_id, CAST(-1 AS BIGINT), '==== test session starts ====' FROM ({doc}) a"
        f" UNION ALL SELECT doc_id, CAST(1000000000 AS BIGINT), '==== FAILURES ====' FROM ({doc}) b"
        f" UNION ALL SELECT doc_id, CAST(1000000001 AS BIGINT), 'tests/test_b.py::test_kept PASSED' FROM ({doc}) c"
    )


def go_rows(d: Dialect) -> str:
    line = "CASE o_orderkey % 4 WHEN 0 THEN concat('=== RUN   TestA', o_orderkey) WHEN 1 THEN concat('--- PASS: TestA', o_orderkey, ' (0.01s)') WHEN 2 THEN concat('    a_test.go:', o_orderkey, ': got 3') ELSE concat('--- FAIL: TestA', o_orderkey, ' (0.01s)') END"
    return _numbered("floor(o_orderkey / 400)", "o_orderkey", line, d.table("orders"))


def stat_rows(d: Dialect) -> str:
    rows = _numbered("floor(p_partkey / 100)", "p_partkey", "concat(' src/p', p_partkey, '.py | ', p_size, ' ', repeat('+', CAST(p_size % 30 + 1 AS INT)), repeat('-', CAST(p_partkey % 9 AS INT)))", d.table("part"))
    return f"{rows} UNION ALL SELECT DISTINCT CAST(floor(p_partkey / 100) AS BIGINT), CAST(1000000000 AS BIGINT), ' 99 files changed, 9 insertions(+)' FROM {d.table('part')}"


def rust_rows(d: Dialect) -> str:
    source = f"(SELECT *, unnest_n AS part FROM {d.table('orders')} CROSS JOIN (SELECT 0 AS unnest_n UNION ALL SELECT 1) n) AS o"
    line = "CASE part WHEN 0 THEN concat('error[E', o_orderkey % 7, ']: mismatched kind ', o_orderkey % 7) ELSE concat(' --> src/f', o_orderkey, '.rs:', o_custkey, ':5') END"
    return _numbered("floor(o_orderkey / 400)", "o_orderkey, part", line, source)


def lint_docs(d: Dialect) -> str:
    """Lint reports: a file a brand, a message a part, every third brand without messages."""
    message = "concat('{\"ruleId\":\"r', p_partkey % 3, '\",\"severity\":', 1 + p_partkey % 2, ',\"message\":\"m', p_partkey % 5, '\",\"line\":', p_size, ',\"column\":', p_partkey % 80 + 1, '}')"
    clean = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 3 = 0"
    files = f"SELECT floor(p_partkey / 200) AS doc_id, p_brand, CASE WHEN {clean} THEN '' ELSE {d.joined(message, 'p_partkey', chr(39) + ',' + chr(39))} END AS m FROM {d.table('part')} GROUP BY floor(p_partkey / 200), p_brand"
    one = "concat('{\"filePath\":\"/src/', p_brand, '.js\",\"messages\":[', m, '],\"usedDeprecatedRules\":[],\"source\":\"', repeat('x', 100), '\"}')"
    return f"SELECT CAST(doc_id AS BIGINT) AS doc_id, concat('[', {d.joined(one, 'p_brand', chr(39) + ',' + chr(39))}, ']') AS text FROM ({files}) f GROUP BY doc_id"


def audit_docs(d: Dialect) -> str:
    """Audit reports: a package a part."""
    name = "concat('pkg-', lpad(CAST(p_partkey AS {0}), 9, '0'))".format("STRING" if d.spark else "VARCHAR")
    severity = "CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'critical' END"
    item = f"concat('\"', {name}, '\":{{\"severity\":\"', {severity}, '\",\"isDirect\":', CASE WHEN p_size % 2 = 0 THEN 'true' ELSE 'false' END, ',\"via\":[\"x', p_size, '\",{{\"title\":\"t', p_partkey % 4, '\"}}],\"range\":\"<', p_size, '.0\",\"fixAvailable\":', CASE WHEN p_size % 3 = 0 THEN 'true' ELSE 'false' END, ',\"nodes\":[\"node_modules/some/very/long/path\"]}}')"
    tail = "concat('\"metadata\":{\"vulnerabilities\":{\"high\":', count(*), ',\"low\":2},\"totalDependencies\":', count(*) * 2, '}}')"
    return f"SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS doc_id, concat('{{\"vulnerabilities\":{{', {d.joined(item, 'p_partkey', chr(39) + ',' + chr(39))}, '}},', {tail}) AS text FROM {d.table('part')} GROUP BY floor(p_partkey / 200)"


def dirty(d: Dialect) -> str:
    """Documents with escapes, repaints, blanks at line ends, blank runs."""
    body = (
        "CASE doc_id % 5 WHEN 0 THEN concat(chr(27), '[31m', text, chr(27), '[0m', chr(27), ']0;title', chr(7)) WHEN 1 THEN concat('10%', chr(13), '50%', chr(13), text, chr(13), chr(10), 'end') "
        "WHEN 2 THEN replace(text, chr(10), concat('  ', chr(9), chr(10))) WHEN 3 THEN replace(text, chr(10), concat(chr(10), chr(10), chr(10), chr(10))) ELSE concat(text, chr(1), chr(10), 'Full result: /tmp/out') END"
    )
    return f"SELECT doc_id, {body} AS text FROM {d.table('documents')}"


def calls(d: Dialect) -> str:
    """Tool calls: a session a user, in order of events."""
    kind = "STRING" if d.spark else "VARCHAR"
    return (
        f"SELECT CAST(user_id AS {kind}) AS session, CAST(event_id AS BIGINT) AS seq, CAST(event_id * 1000 AS BIGINT) AS at, concat(event_type, ' ', k % 3) AS command, concat(event_type, ' ', k % 3) AS cmd_hash, "
        "concat(event_type, k % 3) AS hash, concat('call', k % 7) AS call_id, CAST(k * 9000 AS BIGINT) AS bytes, CAST((event_id - event_id % 2000) / 2000 AS BIGINT) % 3 AS epoch, event_id % 3 = 0 AS lossy, event_id % 6 = 0 AS sidecar, "
        "k % 10 = 0 AS bypass, event_type = 'view' AS sidecar_read, event_type = 'click' AS is_edit, CASE WHEN event_type = 'purchase' THEN concat('/f', k % 4) END AS path, CASE WHEN event_type = 'purchase' THEN concat('c', k % 2) END AS content, "
        f"CAST(NULL AS {kind}) AS range, CASE WHEN event_id % 3 = 0 THEN 'omitted' END AS marker, event_id % 5 <> 0 AS applied FROM {events(d)}"
    )


def host_calls(d: Dialect) -> str:
    """Calls with their results: shells, reads of every kind, other servers' tools, bypasses, now and then a reset."""
    text = "concat(repeat(concat('waiting for lock', chr(10)), CAST(k AS INT)), 'done')"
    return (
        f"SELECT CAST(user_id AS {'STRING' if d.spark else 'VARCHAR'}) AS session, CAST(event_id AS BIGINT) AS seq, concat('call', k % 3) AS call_id, "
        "CASE k % 10 WHEN 7 THEN 'read' WHEN 8 THEN 'read' WHEN 9 THEN 'mcp__a' ELSE 'bash' END AS tool, CASE k % 10 WHEN 6 THEN 'TRIM_OFF=1 make' WHEN 7 THEN NULL WHEN 8 THEN NULL ELSE 'make' END AS command, "
        "CASE k % 10 WHEN 7 THEN CASE event_id % 3 WHEN 0 THEN '/var/log/a.log' WHEN 1 THEN '/src/a.py' ELSE '/tmp/trim-sidecar/a.txt' END WHEN 8 THEN '/tmp/trim-sidecar/b.txt' END AS path, "
        "CASE WHEN k % 10 = 8 THEN CAST(1 AS BIGINT) END AS \"offset\", CAST(event_id * 1000 AS BIGINT) AS at, CAST(k * 9000 AS BIGINT) AS context_bytes, "
        f"CASE event_id % 50 WHEN 7 THEN 'compaction' WHEN 8 THEN 'switch' END AS reset, k, {text} AS text FROM {events(d)}"
    ).replace('"', "`" if d.spark else '"')


def records(d: Dialect) -> str:
    """Metrics records of the calls, old and new vintages."""
    return (
        "SELECT CAST(event_id AS BIGINT) AS pos, CAST(event_id * 7000 AS BIGINT) AS ts_ms, CASE WHEN event_id % 4 = 0 THEN 'library' ELSE 'hook' END AS tag, "
        "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'generic' WHEN 2 THEN 'tsc' WHEN 3 THEN 'sidecar' ELSE 'jsonl-log' END AS strategy, event_id % 2 = 0 AS changed, event_id % 3 = 0 AS lossy, "
        "CAST(1000 + k * 37 AS BIGINT) AS inBytes, CAST(400 + k * 11 AS BIGINT) AS outBytes, event_id % 5 = 3 AS sidecar, CASE WHEN event_id % 2 = 0 THEN CAST(300 + k AS BIGINT) END AS inTokEst, "
        "CASE WHEN event_id % 2 = 0 THEN CAST(90 + k AS BIGINT) END AS outTokEst, CASE WHEN event_id % 4 = 0 THEN 'prose' WHEN event_id % 4 = 2 THEN 'code' END AS tokenClass, CASE WHEN event_id % 2 = 0 THEN 'class/1' END AS estimator, "
        "event_type AS cmdWord, concat(event_type, k % 3) AS cmdHash, CASE WHEN k = 50 THEN true END AS bypass, event_id % 11 = 0 AS dupExact, event_id % 9 = 0 AS candidate, "
        f"CASE WHEN event_id % 9 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 'same-read' ELSE 'same-command' END END AS kind, event_id % 18 = 0 AS preceding_lossy FROM {events(d)}"
    )


def paths(d: Dialect) -> str:
    """Paths and commands of every kind, a row a part."""
    path = "CASE p_partkey % 8 WHEN 0 THEN concat('/var/log/app', p_partkey, '.log') WHEN 1 THEN concat('/srv/logs/run', p_partkey, '.txt') WHEN 2 THEN concat('src/p', p_partkey, '.py') WHEN 3 THEN 'web/package-lock.json' WHEN 4 THEN concat('node_modules/x/p', p_partkey, '.js') WHEN 5 THEN concat('a/b', p_partkey, '.min.js') WHEN 6 THEN concat('/tmp/trim-sidecar/s', p_partkey, '.txt') ELSE concat('/tmp/trim-sidecar/deep/s', p_partkey, '.log.1') END"
    command = "CASE p_partkey % 6 WHEN 0 THEN concat('cat src/p', p_partkey, '.py') WHEN 1 THEN 'cat a.txt | grep x' WHEN 2 THEN 'TRIM_OFF=1 make all' WHEN 3 THEN concat('Get-Content  file', p_partkey) WHEN 4 THEN concat(' npm test ', p_name) ELSE 'type' END"
    prompt = "CASE p_partkey % 6 WHEN 0 THEN 'please list the failing tests' WHEN 1 THEN 'show every single warning now' WHEN 2 THEN 'fix it. all good' WHEN 3 THEN concat('look at `mod', p_partkey, '` and \"W', p_size, '42\" or \"W', p_size, '42\"') WHEN 4 THEN 'why is each of these very different builds of ours so slow in files' ELSE p_name END"
    out = "CASE p_partkey % 5 WHEN 0 THEN 'all fine' WHEN 1 THEN concat('step ', p_partkey, chr(10), 'error: bad') WHEN 2 THEN 'no failures' WHEN 3 THEN concat('[other hook: cut]', chr(10), 'x') ELSE concat('{\"a\":1}', chr(10), 'Full result: /tmp/r', p_partkey) END"
    return f"SELECT CAST(p_partkey AS BIGINT) AS id, {path} AS path, {command} AS command, {prompt} AS prompt, {out} AS text, CASE WHEN p_partkey % 7 = 0 THEN 0 WHEN p_partkey % 7 = 1 THEN 2 END AS exit_code FROM {d.table('part')}"


def load(spark: SparkSession, sf_dir: str, corpus: Callable[[Dialect], str]) -> DataFrame:
    return spark.sql(corpus(spark_dialect(sf_dir)))


def load_texts(spark: SparkSession, sf_dir: str, corpus: Callable[[Dialect], str]) -> DataFrame:
    """``doc_id, text`` of a corpus of lines."""
    d = spark_dialect(sf_dir)
    return spark.sql(f"SELECT doc_id, {d.joined('line', 'ln')} AS text FROM ({corpus(d)}) c GROUP BY doc_id")


def duck_texts(corpus: Callable[[Dialect], str]) -> str:
    return f"(SELECT doc_id, {DUCK.joined('line', 'ln')} AS text FROM ({corpus(DUCK)}) c GROUP BY doc_id)"
