"""Registered queries and, where SQL can say the same, their DuckDB form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scalars as S
from ..functions import text as X
from ..operators import condense as K
from ..operators import formats, lines, report, runtimes, sessions
from ..sources import spread
from . import corpora as D
from .corpora import DUCK, load, load_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with its DuckDB form."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _sql(corpus, body: str, **more: str) -> str:
    """``body`` over the corpus ``c``; further names are CTEs."""
    ctes = ", ".join([f"c AS ({corpus(DUCK)})", *(f"{k} AS ({v})" for k, v in more.items())])
    return f"WITH {ctes} {body}"


SIGNAL = f"(regexp_matches(line, '{C.duck(C.SIGNAL)}') OR regexp_matches(line, '{C.duck(C.COMPOUND)}'))"
DIRTY = D.dirty
CSI = "chr(27) || '(?:\\[[0-9;?]*[ -/]*[@-~]|\\][^' || chr(7) || chr(27) || ']*(?:' || chr(7) || '|' || chr(27) || '\\\\)|[@-Z\\\\-_])'"


def _stripped(t: str) -> str:
    return f"regexp_replace({t}, {CSI}, '', 'g')"


def _resolved(t: str) -> str:
    return f"regexp_replace(replace({t}, chr(13) || chr(10), chr(10)), '[^\\n]*\\r', '', 'g')"


def _tidied(t: str) -> str:
    return f"regexp_replace(regexp_replace({t}, '[\\x01-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g'), '[ \\t]+(\\n|\\r|$)', '\\1', 'g')"


def _collapsed(t: str) -> str:
    return f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')"


def _digest(out: str) -> str:
    return f"SELECT doc_id, md5({out}) AS digest, CAST(length({out}) AS BIGINT) AS n FROM c"


def _digests(spark, sf_dir, step) -> DataFrame:
    docs = spread(load(spark, sf_dir, DIRTY)).withColumn("text", step(F.col("text")))
    return docs.select("doc_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


# --- cleanup ------------------------------------------------------------------------------------------------------------
@query(_sql(DIRTY, _digest(_stripped("text"))))
def strip_ansi(spark, sf_dir):
    return _digests(spark, sf_dir, X.strip_ansi)


@query(_sql(DIRTY, _digest(_resolved("text"))))
def resolve_cr(spark, sf_dir):
    return _digests(spark, sf_dir, X.resolve_cr)


@query(_sql(DIRTY, _digest(_tidied("text"))))
def tidy_ws(spark, sf_dir):
    return _digests(spark, sf_dir, X.tidy_whitespace)


@query(_sql(DIRTY, _digest(_collapsed("text"))))
def collapse_blanks(spark, sf_dir):
    return _digests(spark, sf_dir, X.collapse_blanks)


@query(_sql(DIRTY, _digest(_collapsed(_tidied(_resolved(_stripped("text")))))))
def clean_text(spark, sf_dir):
    return _digests(spark, sf_dir, X.clean)


LAST = "list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))[-1]"


@query(_sql(DIRTY, f"SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines, md5({LAST}) AS last_line FROM c"))
def last_line(spark, sf_dir):
    return load(spark, sf_dir, DIRTY).select("doc_id", X.line_count(F.col("text")).alias("n_lines"), F.md5(X.last_non_blank(F.col("text"))).alias("last_line"))


@query(_sql(DIRTY, f"SELECT doc_id, CASE WHEN regexp_matches({LAST}, '^Full result: .+$') THEN {LAST} END AS trailer FROM c"))
def protected_trailer(spark, sf_dir):
    return load(spark, sf_dir, DIRTY).select("doc_id", X.protected_trailer(F.col("text")).alias("trailer"))


@query(_sql(DIRTY, f"SELECT doc_id, md5(CASE WHEN regexp_matches({LAST}, '^Full result: .+$') THEN 'cut' || chr(10) || {LAST} ELSE 'cut' END) AS digest FROM c"))
def trailer_kept(spark, sf_dir):
    """A view that lost its protected trailer gets it back as its last line; digest without line ends at the end."""
    kept = X.keep_trailer(F.lit("cut\n\n"), F.col("text"))
    return load(spark, sf_dir, DIRTY).select("doc_id", F.md5(F.regexp_replace(kept, "\n+\\z", "")).alias("digest"))


# --- predicates ---------------------------------------------------------------------------------------------------------
P = D.paths
NOT_WS = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


@query(_sql(P, f"SELECT id, regexp_matches(path, '{C.duck(C.LOG_PATH)}') AS is_log, regexp_matches(path, '{C.duck(C.GENERATED_PATH)}') AS is_generated, regexp_matches(path, '^/tmp/trim-sidecar/[^/]+$') AS is_sidecar FROM c"))
def path_kinds(spark, sf_dir):
    p = F.col("path")
    return load(spark, sf_dir, P).select("id", X.is_log_path(p).alias("is_log"), X.is_generated_path(p).alias("is_generated"), X.is_sidecar_path(p, K.SIDECARS).alias("is_sidecar"))


@query(_sql(P, f"SELECT id, regexp_matches({NOT_WS.format('command')}, '{C.duck(C.FILE_DUMP)}') AS is_dump, contains(command, 'TRIM_OFF=1') AS is_bypass FROM c"))
def command_kinds(spark, sf_dir):
    return load(spark, sf_dir, P).select("id", X.is_file_dump(F.col("command")).alias("is_dump"), X.is_bypass(F.col("command")).alias("is_bypass"))


@query(_sql(P, f"SELECT id, regexp_matches(prompt, '{C.duck(C.ENUMERATION)}') AS enumerate FROM c"))
def enumeration_prompt(spark, sf_dir):
    return load(spark, sf_dir, P).select("id", X.requests_enumeration(F.col("prompt")).alias("enumerate"))


@query(_sql(P, f"SELECT id, CASE WHEN exit_code IS NOT NULL THEN exit_code <> 0 ELSE regexp_matches(text, '(?m)' || '{C.duck(C.FAILURE)}') END AS failed FROM c"))
def failure_sniff(spark, sf_dir):
    return load(spark, sf_dir, P).select("id", X.looks_like_failure(F.col("text"), F.col("exit_code")).alias("failed"))


@query(_sql(P, "SELECT id, regexp_matches(text, '(?m)^\\[[a-z][A-Za-z0-9_-]* (?:hook|digest):') AND NOT regexp_matches(text, '(?m)^\\[trim\\b') OR regexp_matches(text, '^[{]') AND regexp_matches(text, 'Full result: .+$') AS condensed FROM c"))
def already_condensed(spark, sf_dir):
    return load(spark, sf_dir, P).select("id", X.already_condensed(F.col("text")).alias("condensed"))


@query(_sql(P, "SELECT id, octet_length(encode(text)) < 28000 AND NOT contains(text, 'truncated') AS complete, CAST(id % 3 <> 0 AS BOOLEAN) AS complete_typed, regexp_matches(path, '^/tmp/trim-sidecar/[^/]+$') AS exact_range FROM c"))
def host_completeness(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, P).select(
        "id", X.host_complete_shell(t, F.lit(False)).alias("complete"), X.host_complete_details(t, F.col("id") % 3 == 0, F.lit(None).cast("string")).alias("complete_typed"),
        X.is_exact_range(F.col("path"), K.SIDECARS, F.lit(1), F.lit(None), t).alias("exact_range"),
    )


@query(_sql(P, "SELECT id, path FROM c WHERE regexp_matches(path, '^/tmp/trim-sidecar/[^/]+$') OR regexp_matches(path, '{}') OR regexp_matches(path, '{}')".format(C.duck(C.LOG_PATH), C.duck(C.GENERATED_PATH))))
def admitted_reads(spark, sf_dir):
    return load(spark, sf_dir, P).where(K.admitted_read(F.col("path"))).select("id", "path")


@query("SELECT conv_id, turn, regexp_matches(text, '{}') AS blocker, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words FROM conversations".format(C.duck(C.BLOCKER)))
def chat_words(spark, sf_dir):
    chat = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.select("conv_id", "turn", X.is_blocker(F.col("text")).alias("blocker"), S.word_count(F.col("text")).alias("words"))


# --- scalars ------------------------------------------------------------------------------------------------------------
@query(_sql(P, "SELECT id, array_to_string(list_filter(s, lambda x, i: x <> '' AND list_position(s, x) = i)[1:8], ',') AS tokens FROM (SELECT id, list_transform(regexp_extract_all(prompt, '{}'), lambda x: lower(trim(x[2:-2]))) AS s FROM c) q".format(C.duck(C.QUOTED))))
def relevance_tokens(spark, sf_dir):
    return load(spark, sf_dir, P).select("id", F.array_join(S.prompt_tokens(F.col("prompt")), ",").alias("tokens"))


@query(_sql(P, "SELECT id, 'src/a.py,' || CASE WHEN id % 4 = 0 THEN '' ELSE 'id' || id % 10 || 'x,' END || 'ts2304' AS merged FROM c"))
def merge_relevance(spark, sf_dir):
    own = F.when(F.col("id") % 4 == 0, "Error").otherwise(F.concat(F.lit(" ID"), (F.col("id") % 10).cast("string"), F.lit("x ")))
    return load(spark, sf_dir, P).select("id", F.array_join(S.merge_relevance(F.array(F.lit("src/A.py"), F.lit("ab")), F.array(own), F.array(F.lit("TS2304"), F.lit("SRC/a.py"))), ",").alias("merged"))


FNV = "printf('%x', list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split({0}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda h, u: CAST((CAST(xor(h, u) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT)))"


@query(_sql(P, f"SELECT id, {FNV.format('command')} AS cmd_hash, regexp_extract(command, '\\S+') AS cmd_word, 'sess-' || id % 9 || '-' || {FNV.format('command')} || '.txt' AS saved FROM c"))
def cmd_fingerprint(spark, sf_dir):
    c = F.col("command")
    return load(spark, sf_dir, P).select("id", S.fnv1a(c).alias("cmd_hash"), S.command_word(c).alias("cmd_word"), S.sidecar_name(c, F.concat(F.lit("sess-"), (F.col("id") % 9).cast("string"))).alias("saved"))


@query("SELECT doc_id, 'sha256:' || sha256(text) AS name, substr(sha256(text), 1, 16) AS short FROM documents")
def text_sha256(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", S.sha256_name(F.col("text")).alias("name"), S.short_hash(F.col("text")).alias("short"))


@query(_sql(DIRTY, "SELECT doc_id, sha256(trim(regexp_replace(regexp_replace({}, '\\b[0-9]{{4}}-[0-9][0-9]-[0-9][0-9][T ][0-9:.+-]+Z?\\b', '<time>', 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS h FROM c".format(_stripped("text"))))
def dup_hash(spark, sf_dir):
    return load(spark, sf_dir, DIRTY).select("doc_id", S.dup_hash(F.col("text")).alias("h"))


def _share(pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(s, '{pattern}')) AS DOUBLE)"


CLASSED = f"""SELECT doc_id, text, CASE WHEN {_share('[^a-zA-Z0-9_ \\t-\\r]')} / length(s) > 0.28 OR {_share('[0-9]')} / length(s) > 0.22 OR length(s) / ({_share('[ \\t-\\r]+')} + 1) > 18 THEN 'dense'
  WHEN {_share('[^a-zA-Z0-9_ \\t-\\r]')} / length(s) > 0.14 THEN 'code' WHEN {_share(' ')} / length(s) > 0.14 AND {_share('[^a-zA-Z0-9_ \\t-\\r]')} / length(s) < 0.09 THEN 'prose' ELSE 'mixed' END AS cls
  FROM (SELECT doc_id, text, substr(text, 1, 65536) AS s FROM documents) d"""


@query(f"SELECT doc_id, cls, CAST(ceil(length(text) / CASE cls WHEN 'dense' THEN 2.0 WHEN 'code' THEN 2.6 WHEN 'prose' THEN 3.8 ELSE 3.2 END) AS BIGINT) AS tokens FROM ({CLASSED}) x")
def token_estimate(spark, sf_dir):
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", S.token_facts(F.col("text")).alias("f")).select("doc_id", F.col("f.cls").alias("cls"), F.col("f.tokens").alias("tokens"))


@query("SELECT o_orderkey, o_totalprice * 0.5 >= 32 AND (o_totalprice - o_custkey) >= 24 AS win FROM orders")
def net_win(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select("o_orderkey", S.net_win(F.col("o_totalprice"), F.col("o_totalprice") * 0.5, F.col("o_totalprice"), F.col("o_custkey")).alias("win"))


SAID = (
    "CASE id % 6 WHEN 0 THEN concat('{\"exit_code\":', id % 5, ',\"code\":9}') WHEN 1 THEN concat('{\"exitCode\":\"x', id, '\",\"code\":7}') WHEN 2 THEN concat('{\"code\":4, \"exit_code\":3, \"exitCode\":', id % 3, '}') "
    "WHEN 3 THEN concat('exit code ', id) WHEN 4 THEN '{\"exitCode\":null,\"exit_code\":true,\"code\":-1}' ELSE '{\"in\":{\"code\":5}}' END"
)


def _number(key: str) -> str:
    return f"CASE WHEN json_type(j, '$.{key}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract(j, '$.{key}') AS BIGINT) END"


@query(_sql(P, f"SELECT id, coalesce({_number('exitCode')}, {_number('exit_code')}, {_number('code')}) AS code FROM (SELECT id, TRY_CAST({SAID} AS JSON) AS j FROM c) q"))
def exit_codes(spark, sf_dir):
    return load(spark, sf_dir, P).select("id", S.exit_code(F.expr(SAID)).cast("long").alias("code"))


@query(_sql(P, "SELECT id, '{\"a\":\"' || id % 3 || '\",\"b\":\"x\"}' AS canonical FROM c"))
def canonical(spark, sf_dir):
    return load(spark, sf_dir, P).select("id", S.canonical_json(F.concat(F.lit('{"b":"x","a":"'), (F.col("id") % 3).cast("string"), F.lit('"}'))).alias("canonical"))


# --- lines --------------------------------------------------------------------------------------------------------------
@query("SELECT doc_id, CAST(i AS BIGINT) - 1 AS ln, md5(l[i]) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) d, unnest(range(1, len(l) + 1)) AS u(i)")
def line_explode(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return lines.explode_lines(docs).select("doc_id", F.col("ln").cast("long").alias("ln"), F.md5("line").alias("line"))


@query(_sql(D.event_log, f"SELECT doc_id, ln, line FROM c WHERE {SIGNAL}"))
def signal_lines(spark, sf_dir):
    return lines.with_signal(load(spark, sf_dir, D.event_log)).where("signal").select("doc_id", "ln", "line")


RUNS = """SELECT doc_id, min(ln) AS ln, max(line) AS line, count(*) AS n FROM (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY ln) AS g FROM (
  SELECT *, CASE WHEN line = '' OR lag(line) OVER (PARTITION BY doc_id ORDER BY ln) IS DISTINCT FROM line THEN 1 ELSE 0 END AS brk FROM c) a) b GROUP BY doc_id, g"""


@query(_sql(D.event_runs, "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ln, k) - 1 AS BIGINT) AS ln, CASE WHEN n >= 3 THEN line || '  [trim hook: line repeated ' || n || 'x]' ELSE line END AS line FROM r, unnest(range(0, CASE WHEN n >= 3 THEN 1 ELSE n END)) AS u(k)", r=RUNS))
def dedupe_runs(spark, sf_dir):
    return lines.dedupe_runs(load(spark, sf_dir, D.event_runs)).select("doc_id", F.col("ln").cast("long").alias("ln"), "line")


FLAGGED = f"SELECT *, {SIGNAL} AS sig, count(*) OVER (PARTITION BY doc_id) AS n FROM c"
KEPT = """SELECT doc_id, ln, line, n, sig FROM (SELECT *, ceil(greatest(0, 120 - s) * 0.6) AS head, greatest(0, 120 - s) AS budget FROM (
  SELECT *, sum(CASE WHEN sig THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id) AS s FROM flagged) a) b
  WHERE n <= 120 OR s >= n * 0.9 OR sig OR ln < head OR ln >= n - (budget - head)"""
GAPS = """SELECT *, ln - coalesce(lag(ln) OVER w, -1) - 1 AS gap, CASE WHEN lead(ln) OVER w IS NULL THEN n - 1 - ln ELSE 0 END AS rest FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY ln)"""


def _mark(n: str) -> str:
    before, after = C.OMITTED.split("{n}")
    return f"'{before}' || CAST({n} AS BIGINT) || '{after}'"


@query(_sql(D.event_cap, "SELECT doc_id, ln, CAST(gap AS BIGINT) AS gap, CAST(rest AS BIGINT) AS rest FROM gaps", flagged=FLAGGED, kept=KEPT, gaps=GAPS))
def gap_markers(spark, sf_dir):
    rows = lines.cap_flags(load(spark, sf_dir, D.event_cap), F.lit(120)).where("kept")
    return lines.gap_rows(rows).select("doc_id", "ln", "gap", "rest")


CAPPED = f"SELECT doc_id, string_agg(concat_ws(chr(10), CASE WHEN gap > 0 THEN {_mark('gap')} END, line, CASE WHEN rest > 0 THEN {_mark('rest')} END), chr(10) ORDER BY ln) || chr(10) || '{C.SHORTENED}' AS out, CAST(sum(gap + rest) AS BIGINT) AS omitted FROM gaps GROUP BY doc_id"


@query(_sql(D.event_cap, "SELECT doc_id, md5(out) AS digest, omitted FROM capped", flagged=FLAGGED, kept=KEPT, gaps=GAPS, capped=CAPPED))
def cap_lines(spark, sf_dir):
    return lines.cap_lines(load(spark, sf_dir, D.event_cap), F.lit(120)).select("doc_id", F.md5("text").alias("digest"), "omitted")


@query(
    _sql(
        D.event_cap,
        f"SELECT t.doc_id, CAST(length(text) AS BIGINT) AS in_bytes, CAST(length(out) AS BIGINT) AS out_bytes, omitted, coalesce(e.errors, 0) AS errors FROM capped JOIN {D.duck_texts(D.event_cap)} t USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS errors FROM kept WHERE sig GROUP BY doc_id) e USING (doc_id)",
        flagged=FLAGGED, kept=KEPT, gaps=GAPS, capped=CAPPED,
    )
)
def condense_generic_meta(spark, sf_dir):
    """The composite over long logs, capped in place."""
    done = K.condense(load_texts(spark, sf_dir, D.event_cap).withColumns({"no_sidecar": F.lit(True), "exit_code": F.lit(0)}), ["doc_id"])
    return done.select("doc_id", F.col("inputBytes").alias("in_bytes"), F.col("outputBytes").alias("out_bytes"), F.col("omittedLines").alias("omitted"), F.col("preservedErrors").alias("errors"))


CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches(line, '{C.duck(p)}') THEN {k}" for k, (_, _, p) in enumerate(C.CENSUS)) + " END"


def _words() -> str:
    return "concat_ws(', ', " + ", ".join(f"CASE WHEN c{k} > 0 THEN c{k} || ' ' || CASE WHEN c{k} = 1 THEN '{one}' ELSE '{many}' END END" for k, (one, many, _) in enumerate(C.CENSUS)) + ")"


@query(_sql(D.event_runs, f"SELECT doc_id, n_signal, {_words()} AS census FROM (SELECT doc_id, count(*) AS n_signal, " + ", ".join(f"count(*) FILTER (k = {k}) AS c{k}" for k in range(5)) + f" FROM (SELECT doc_id, {CATEGORY} AS k FROM c WHERE {SIGNAL}) a GROUP BY doc_id) b"))
def signal_census(spark, sf_dir):
    return lines.signal_census(load(spark, sf_dir, D.event_runs))


@query(_sql(D.event_log, f"SELECT doc_id, count(*) FILTER (sig AND k <= 2) AS errors, count(*) FILTER (sig AND k > 2) AS warnings FROM (SELECT doc_id, {SIGNAL} AS sig, {CATEGORY} AS k FROM c) a GROUP BY doc_id"))
def count_signals(spark, sf_dir):
    return lines.count_signals(load(spark, sf_dir, D.event_log))


@query(
    _sql(
        D.event_cap,
        "SELECT doc_id, ln, part FROM (SELECT doc_id, ln, CASE WHEN sig AND (up <= 10 OR down <= 10) THEN 'lead' WHEN ln < 20 OR ln >= n - 15 THEN 'structure' WHEN sig THEN 'unshown' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, sig ORDER BY ln) AS up, row_number() OVER (PARTITION BY doc_id, sig ORDER BY ln DESC) AS down FROM flagged) a) b WHERE part IS NOT NULL",
        flagged=FLAGGED,
    )
)
def sidecar_digest(spark, sf_dir):
    return lines.digest_rows(load(spark, sf_dir, D.event_cap)).select("doc_id", "ln", "part")


@query(_sql(D.event_log, "SELECT doc_id, token, ln FROM (SELECT doc_id, token, ln, count(*) OVER (PARTITION BY doc_id, token) AS n FROM c, (VALUES ('code 7'), ('info worker'), ('purchase')) t(token) WHERE contains(lower(line), token)) a WHERE n <= 50"))
def relevance_hits(spark, sf_dir):
    rows = load(spark, sf_dir, D.event_log)
    tokens = rows.select("doc_id").distinct().withColumn("token", F.explode(F.array(F.lit("code 7"), F.lit("info worker"), F.lit("purchase"))))
    return lines.relevance_hits(rows, tokens).select("doc_id", "token", "ln")


FOLD = """WITH RECURSIVE c AS ({corpus}), w AS (SELECT doc_id, ln, line, list_filter(string_split(line, ' '), lambda x: x <> '') AS t, {signal} AS sig FROM c),
f(doc_id, ln, head, anchor, sig) AS (SELECT doc_id, ln, ln, t, sig FROM w WHERE ln = 0 UNION ALL
  SELECT w.doc_id, w.ln, CASE WHEN same THEN f.head ELSE w.ln END, CASE WHEN same THEN f.anchor ELSE w.t END, w.sig FROM f JOIN w ON w.doc_id = f.doc_id AND w.ln = f.ln + 1,
  LATERAL (SELECT NOT w.sig AND NOT f.sig AND len(w.t) = len(f.anchor) AND len(w.t) > 0 AND 2 * len(list_filter(list_zip(w.t, f.anchor), lambda z: z[1] = z[2])) >= len(w.t)
    AND len(list_filter(list_zip(w.t, f.anchor), lambda z: z[1] = z[2] AND length(z[1]) >= 3 AND NOT regexp_matches(z[1], '[0-9]'))) >= 2 AS same) x),
r AS (SELECT doc_id, head, count(*) AS n FROM f GROUP BY doc_id, head)"""
FOLDED = FOLD.format(corpus=D.event_log(DUCK), signal=SIGNAL)


@query(
    FOLDED
    + " SELECT doc_id, md5(string_agg(piece, chr(10) ORDER BY head)) AS digest, CAST(sum(CASE WHEN n >= 5 THEN n - 1 ELSE 0 END) AS BIGINT) AS collapsed FROM (SELECT r.doc_id, r.head, r.n, CASE WHEN n >= 5 THEN max(c.line) FILTER (c.ln = r.head) || chr(10) || '[trim hook: ' || (n - 1) || ' similar lines collapsed (same shape, varying values)]' ELSE string_agg(c.line, chr(10) ORDER BY c.ln) END AS piece FROM r JOIN f ON f.doc_id = r.doc_id AND f.head = r.head JOIN c ON c.doc_id = f.doc_id AND c.ln = f.ln GROUP BY r.doc_id, r.head, r.n) p GROUP BY doc_id"
)
def template_fold(spark, sf_dir):
    return K.fold_templates(load_texts(spark, sf_dir, D.event_log)).select("doc_id", F.md5("text").alias("digest"), "collapsed")


# --- formats ------------------------------------------------------------------------------------------------------------
READERS = {r.name: r for r in formats.REGISTRY}


def _read(spark, sf_dir, corpus, name, texts=load_texts) -> DataFrame:
    return K.read_format(texts(spark, sf_dir, corpus), READERS[name]).select("doc_id", F.md5("out").alias("digest"), F.col("omitted").cast("long").alias("omitted"))


def _noise(corpus, noise: str, mark: str, source: str = "c") -> str:
    return _sql(
        corpus,
        f"SELECT doc_id, md5(string_agg(CASE WHEN noise THEN replace('{mark}', '{{n}}', CAST(n AS VARCHAR)) ELSE line END, chr(10) ORDER BY ln)) AS digest, CAST(max(n) AS BIGINT) AS omitted FROM (SELECT *, count(*) FILTER (noise) OVER (PARTITION BY doc_id) AS n, min(CASE WHEN noise THEN ln END) OVER (PARTITION BY doc_id) AS first, sum(length(line) + 1) OVER (PARTITION BY doc_id) AS size FROM (SELECT *, {noise} AS noise FROM {source}) a) b WHERE size > 2000 AND n >= 10 AND (NOT noise OR ln = first) GROUP BY doc_id",
    )


@query(_noise(D.js_rows, "regexp_matches(line, '^\\s*[✓√✔]\\s') AND NOT regexp_matches(line, '\\([0-9]+ tests?[^)]*\\)')", "[trim hook: {n} passing-test lines collapsed; suite results, all failures, and the summary are kept in full]"))
def fmt_jest(spark, sf_dir):
    return _read(spark, sf_dir, D.js_rows, "jest-vitest")


@query(_noise(D.py_rows, "regexp_matches(line, 'PASSED') AND NOT past", "[trim hook: {n} PASSED test lines collapsed; failures, errors, warnings, and the summary are kept in full]", "(SELECT *, max(CASE WHEN regexp_matches(line, '^=+ FAILURES') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY ln) = 1 AS past FROM c) z"))
def fmt_pytest(spark, sf_dir):
    return _read(spark, sf_dir, D.py_rows, "pytest")


@query(_noise(D.go_rows, "regexp_matches(line, '^\\s*(=== (RUN|PAUSE|CONT)\\s|--- PASS:)')", "[trim hook: {n} go test RUN/PASS progress lines collapsed; package results, all failures, and panics are kept in full]"))
def fmt_gotest(spark, sf_dir):
    return _read(spark, sf_dir, D.go_rows, "go-test")


@query(_sql(D.stat_rows, "SELECT doc_id, md5(string_agg(regexp_replace(line, '^( .*\\S \\|\\s+[0-9]+)( [+-]+)$', '\\1'), chr(10) ORDER BY ln)) AS digest, CAST(0 AS BIGINT) AS omitted FROM c GROUP BY doc_id HAVING sum(length(line) + 1) > 2000 AND count(*) <= 2000"))
def fmt_diffstat(spark, sf_dir):
    return _read(spark, sf_dir, D.stat_rows, "diffstat")


@query(
    _sql(
        D.event_jsonl,
        "SELECT k.doc_id, md5('[trim hook: JSONL log — ' || dropped || ' routine records collapsed (' || levels || '); every warn/error/fatal record plus the first and last record kept verbatim below]' || chr(10) || body) AS digest, CAST(dropped AS BIGINT) AS omitted FROM "
        "(SELECT doc_id, max(n) - count(*) AS dropped, string_agg(CASE WHEN gap > 0 THEN '[trim hook: ' || gap || ' routine records omitted here]' || chr(10) || line ELSE line END, chr(10) ORDER BY ln) AS body, max(kept) AS kept FROM (SELECT *, ln - coalesce(lag(ln) OVER (PARTITION BY doc_id ORDER BY ln), ln) - 1 AS gap FROM r WHERE loud OR ln = 0 OR ln = n - 1) g GROUP BY doc_id) k "
        "JOIN (SELECT doc_id, string_agg(m || ' ' || lvl, ', ' ORDER BY m DESC, first) AS levels FROM (SELECT doc_id, lvl, count(*) AS m, min(ln) AS first FROM r WHERE NOT loud GROUP BY doc_id, lvl) a GROUP BY doc_id) l USING (doc_id) WHERE dropped >= 20 AND kept <= 300",
        r="SELECT *, regexp_extract(line, 'level\":([0-9]+)', 1) AS lvl, CAST(regexp_extract(line, 'level\":([0-9]+)', 1) AS INT) >= 40 AS loud, count(*) OVER (PARTITION BY doc_id) AS n, count(*) FILTER (CAST(regexp_extract(line, 'level\":([0-9]+)', 1) AS INT) >= 40) OVER (PARTITION BY doc_id) AS kept FROM c",
    )
)
def fmt_jsonl(spark, sf_dir):
    return _read(spark, sf_dir, D.event_jsonl, "jsonl-log")


@query(
    _sql(
        D.tsc_rows,
        "SELECT doc_id, md5('[trim hook: ' || sum(n) || ' TypeScript diagnostics grouped into ' || count(*) || ' unique messages; every message and every location kept.]' || chr(10) || string_agg(head || CASE WHEN n > 1 THEN '  (' || n || ' locations)' ELSE '' END || chr(10) || '  at ' || places, chr(10) ORDER BY first)) AS digest, CAST(0 AS BIGINT) AS omitted FROM "
        "(SELECT doc_id, regexp_extract(line, 'error TS.*$') AS head, count(*) AS n, min(ln) AS first, string_agg(regexp_extract(line, '^(.+?): error', 1), ', ' ORDER BY ln) AS places FROM c GROUP BY 1, 2) g GROUP BY doc_id HAVING sum(n) >= 4 AND count(*) < sum(n)",
    )
)
def fmt_tsc(spark, sf_dir):
    return _read(spark, sf_dir, D.tsc_rows, "tsc")


@query(
    _sql(
        D.rust_rows,
        "SELECT doc_id, md5(string_agg(body || CASE WHEN n > 1 THEN chr(10) || code || ' ×' || n || ' (' || places || ')' ELSE '' END, chr(10) || chr(10) ORDER BY first)) AS digest, "
        "CAST(greatest(0, max(total) - (len(string_split(string_agg(body || CASE WHEN n > 1 THEN chr(10) || code ELSE '' END, chr(10) || chr(10) ORDER BY first), chr(10))))) AS BIGINT) AS omitted FROM "
        "(SELECT doc_id, code, count(*) AS n, min(ln) AS first, max(total) AS total, min_by(l1 || chr(10) || l2, ln) AS body, string_agg(place, ', ' ORDER BY ln) AS places FROM "
        "(SELECT a.doc_id, a.ln, a.line AS l1, b.line AS l2, regexp_extract(a.line, '\\[(E[0-9]+)\\]', 1) AS code, regexp_extract(b.line, '--> (.+?:[0-9]+)', 1) AS place, count(*) OVER (PARTITION BY a.doc_id) * 2 AS total, sum(length(a.line) + length(b.line) + 2) OVER (PARTITION BY a.doc_id) AS size FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.ln = a.ln + 1 WHERE a.ln % 2 = 0) x WHERE size > 400 GROUP BY doc_id, code) g GROUP BY doc_id HAVING sum(n) >= 3",
    )
)
def fmt_diagnostic(spark, sf_dir):
    return _read(spark, sf_dir, D.rust_rows, "diagnostic-block")


CLEAN = "CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) % 3 = 0"


@query(
    f"""WITH m AS (SELECT floor(p_partkey / 200) AS doc_id, p_brand, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'warning' ELSE 'error' END AS sev, p_size || ':' || (p_partkey % 80 + 1) AS place, 'm' || p_partkey % 5 AS msg, 'r' || p_partkey % 3 AS rule, {CLEAN} AS clean FROM part),
u AS (SELECT doc_id, p_brand, place, msg, rule, min(p_partkey) AS first, min_by(sev, p_partkey) AS sev FROM m WHERE NOT clean GROUP BY ALL),
f AS (SELECT doc_id, p_brand, '/src/' || p_brand || '.js' || chr(10) || string_agg('  ' || place || '  ' || sev || '  ' || msg || '  (' || rule || ')', chr(10) ORDER BY first) AS body, count(*) AS kept FROM u GROUP BY doc_id, p_brand),
t AS (SELECT doc_id, count(*) FILTER (NOT clean AND sev = 'error') AS e, count(*) FILTER (NOT clean AND sev = 'warning') AS w, count(*) FILTER (NOT clean) AS n, count(DISTINCT p_brand) FILTER (clean) AS cl FROM m GROUP BY doc_id),
b AS (SELECT doc_id, string_agg(body, chr(10) ORDER BY p_brand) AS body, sum(kept) AS kept, count(*) AS files FROM f GROUP BY doc_id)
SELECT CAST(doc_id AS BIGINT) AS doc_id, md5('[trim hook: eslint JSON rendered compactly — ' || e || ' error' || CASE WHEN e = 1 THEN '' ELSE 's' END || ', ' || w || ' warning' || CASE WHEN w = 1 THEN '' ELSE 's' END || ' in ' || files || ' file' || CASE WHEN files = 1 THEN '' ELSE 's' END
 || CASE WHEN cl > 0 THEN '; ' || cl || ' clean file' || CASE WHEN cl = 1 THEN '' ELSE 's' END || ' omitted' ELSE '' END || CASE WHEN n > kept THEN '; ' || CAST(n - kept AS BIGINT) || ' exact duplicate' || CASE WHEN n - kept = 1 THEN '' ELSE 's' END || ' deduped' ELSE '' END
 || '. Every message kept with file, line:col, and rule.]' || chr(10) || body) AS digest, CAST(0 AS BIGINT) AS omitted FROM t JOIN b USING (doc_id) JOIN (SELECT doc_id, length(text) AS size FROM ({D.lint_docs(DUCK)}) l) s USING (doc_id) WHERE size >= 2000 AND n <= 1000"""
)
def fmt_eslint(spark, sf_dir):
    return _read(spark, sf_dir, D.lint_docs, "eslint-json", load)


@query(
    f"""SELECT CAST(floor(p_partkey / 200) AS BIGINT) AS doc_id, md5('npm audit: critical 0, high ' || count(*) || ', moderate 0, low 2, info 0' || chr(10) || string_agg(CASE p_partkey % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'critical' END || ' pkg-' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || ' <' || p_size || '.0 — x' || p_size || '; t' || p_partkey % 4
 || ' [' || CASE WHEN p_size % 2 = 0 THEN 'direct' ELSE 'transitive' END || '; ' || CASE WHEN p_size % 3 = 0 THEN 'fix available' ELSE 'no fix' END || ']', chr(10) ORDER BY p_partkey) || chr(10) || 'dependencies: ' || count(*) * 2) AS digest, CAST(0 AS BIGINT) AS omitted FROM part GROUP BY floor(p_partkey / 200) HAVING count(*) <= 1998"""
)
def fmt_audit(spark, sf_dir):
    return _read(spark, sf_dir, D.audit_docs, "npm-audit", load)


def _mixed(spark, sf_dir) -> DataFrame:
    parts = [(n, load_texts(spark, sf_dir, c)) for n, c in (("js", D.js_rows), ("py", D.py_rows), ("go", D.go_rows), ("stat", D.stat_rows), ("jsonl", D.event_jsonl), ("tsc", D.tsc_rows), ("rust", D.rust_rows), ("log", D.event_log), ("cap", D.event_cap))]
    parts += [("lint", load(spark, sf_dir, D.lint_docs)), ("audit", load(spark, sf_dir, D.audit_docs)), ("dirty", load(spark, sf_dir, DIRTY))]
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("corpus"), "doc_id", "text")
        out = one if out is None else out.unionByName(one)
    return spread(out)


@query()
def strategy_route(spark, sf_dir):
    """How many texts of each corpus each strategy takes."""
    done = K.condense(_mixed(spark, sf_dir), ["corpus", "doc_id"])
    return done.groupBy("corpus", "strategy").agg(F.count("*").alias("docs"), F.sum("inputBytes").alias("in_bytes"), F.sum("outputBytes").alias("out_bytes"))


@query()
def compress_full(spark, sf_dir):
    """The whole composite: every text's facts."""
    done = K.condense(_mixed(spark, sf_dir), ["corpus", "doc_id"])
    return done.select("corpus", "doc_id", F.md5("out").alias("digest"), *[f.name for f in K.META.fields])


@query()
def cap_lines_relevance(spark, sf_dir):
    """Capped views that keep what a prompt names."""
    docs = load_texts(spark, sf_dir, D.event_cap).withColumns({"no_sidecar": F.lit(True), "exit_code": F.lit(0), "tokens": F.array(F.lit("job12 "), F.lit("code 3"))})
    return K.condense(docs, ["doc_id"]).select("doc_id", F.md5("out").alias("digest"), "outputLines", "omittedLines")


# --- policy -------------------------------------------------------------------------------------------------------------
PROFILE = "CASE p_partkey % 7 WHEN 0 THEN 'eval' WHEN 1 THEN 'autonomous-loop' WHEN 2 THEN 'interactive-long' WHEN 3 THEN 'final-verification' WHEN 4 THEN 'interactive-short' WHEN 5 THEN 'other' END"
CAPS = "(VALUES " + ", ".join(f"('{n}', {p}, {f}, {s})" for n, (p, f, s) in C.PROFILES.items()) + ") AS d(known, p, f, s)"


@query(f"SELECT CAST(p_partkey AS BIGINT) AS id, known AS profile, CAST(coalesce(p, 120) AS BIGINT) AS cap_pass, CAST(250 AS BIGINT) AS cap_fail, CAST(coalesce(s, 15000) AS BIGINT) AS sidecar_min FROM part LEFT JOIN {CAPS} ON known = {PROFILE}")
def profile_caps(spark, sf_dir):
    parts = spark.sql(f"SELECT CAST(p_partkey AS BIGINT) AS id, {PROFILE} AS name FROM parquet.`{sf_dir}/part.parquet`")
    return K.profile_caps(parts, F.col("name"), {"cap_fail": 250}).drop("name")


@query(
    "SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_custkey * 900 < 409600 THEN 'low' WHEN o_custkey * 900 < 1048576 THEN 'mid' ELSE 'high' END AS band, "
    "CAST(CASE WHEN o_orderkey % 5 = 0 THEN 2000 WHEN o_orderkey % 2 = 0 THEN greatest(125, floor(300 * sc + 0.5)) ELSE greatest(30, floor(50 * sc + 0.5)) END AS BIGINT) AS cap FROM (SELECT *, CASE WHEN o_custkey * 900 < 409600 THEN 1.0 WHEN o_custkey * 900 < 1048576 THEN 0.75 ELSE 0.5 END AS sc FROM orders) o"
)
def pressure_scale(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    band = S.pressure_band(F.col("o_custkey") * 900)
    cap = S.choose_cap(F.col("o_orderkey") % 5 == 0, F.col("o_orderkey") % 2 == 0, F.lit(50), F.lit(300), S.pressure_scale(band))
    return o.select(F.col("o_orderkey").cast("long").alias("id"), band.alias("band"), cap.alias("cap"))


@query()
def block_gate(spark, sf_dir):
    """Blocks of one call are rewritten together or not at all."""
    blocks = spread(load(spark, sf_dir, DIRTY)).select((F.col("doc_id") % 100).alias("call"), F.col("doc_id").alias("block"), "text")
    done = K.condense(blocks, ["call", "block"]).withColumn("out", F.md5("out"))  # before the gate's window, which need not carry texts
    return K.gate(done, ["call"]).select("call", "block", "applied", F.col("emitted").alias("digest"))


@query(_sql(P, "SELECT id, id % 5 IN (0, 1, 2) AND id % 4 <> 0 AND id % 3 = 0 AS eligible FROM c"))
def mcp_observe(spark, sf_dir):
    """Content blocks that may be rewritten."""
    kind, tool = F.when(F.col("id") % 4 == 0, "image").otherwise("text"), F.when(F.col("id") % 3 == 0, "mcp__a").otherwise("mcp__secret")
    return load(spark, sf_dir, P).select("id", K.block_eligible(kind, F.col("text"), "^mcp__", "secret", tool).alias("eligible"))


@query()
def metrics_records(spark, sf_dir):
    """Metrics records of condensed logs."""
    docs = load_texts(spark, sf_dir, D.event_log).withColumn("command", F.concat(F.lit("tail log"), F.col("doc_id").cast("string")))
    done = K.gate(K.condense(docs, ["doc_id", "command"]), ["doc_id"])
    return K.metrics_records(done, F.lit(0).cast("long"), F.lit("batch"), F.col("command"))


# --- sessions -----------------------------------------------------------------------------------------------------------
CALLS = D.calls
ISLAND = "SELECT *, CAST(sum(CASE WHEN brk THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS BIGINT) AS island FROM (SELECT *, coalesce(epoch <> lag(epoch) OVER (PARTITION BY session ORDER BY seq), false) AS brk FROM c) a"


def _calls(spark, sf_dir) -> DataFrame:
    return sessions.epoch_islands(load(spark, sf_dir, CALLS))


@query(_sql(CALLS, "SELECT session, seq, island FROM i", i=ISLAND))
def epoch_islands(spark, sf_dir):
    return _calls(spark, sf_dir).select("session", "seq", "island")


@query(
    _sql(
        CALLS,
        "SELECT session, seq, coalesce(pos - prev <= 20, false) AS duplicate, CASE WHEN pos - prev <= 20 THEN greatest(0, \"at\" - was) END AS age_ms FROM (SELECT *, lag(pos) OVER w AS prev, lag(\"at\") OVER w AS was FROM (SELECT *, row_number() OVER (PARTITION BY session, island ORDER BY seq) AS pos FROM i) a WINDOW w AS (PARTITION BY session, island, hash ORDER BY seq)) b",
        i=ISLAND,
    )
)
def dup_ring(spark, sf_dir):
    return sessions.exact_duplicates(_calls(spark, sf_dir)).select("session", "seq", "duplicate", "age_ms")




@query(
    _sql(
        CALLS,
        "SELECT session, seq, CASE WHEN m1 IS NOT NULL THEN 'trim-bypass-rerun' WHEN m2 IS NOT NULL THEN 'artifact-retrieval' WHEN m3 IS NOT NULL THEN 'same-read' WHEN m4 IS NOT NULL AND last_edit >= m4 THEN 'same-command' WHEN m4 IS NOT NULL THEN 'unchanged-validation' END AS kind, CAST(pos - coalesce(m1, m2, m3, m4) AS BIGINT) AS seq_gap FROM "
        "(SELECT n.session, n.seq, n.pos, max(o.pos) FILTER (n.bypass AND o.cmd_hash = n.cmd_hash) AS m1, max(o.pos) FILTER (n.sidecar_read AND o.lossy AND o.sidecar) AS m2, max(o.pos) FILTER (o.path = n.path AND o.content = n.content) AS m3, max(o.pos) FILTER (o.cmd_hash = n.cmd_hash) AS m4, max(o.pos) FILTER (o.is_edit) AS last_edit "
        "FROM p n LEFT JOIN p o ON o.session = n.session AND o.island = n.island AND o.pos BETWEEN n.pos - 5 AND n.pos - 1 GROUP BY n.session, n.seq, n.pos) a",
        i=ISLAND,
        p="SELECT *, row_number() OVER (PARTITION BY session, island ORDER BY seq) AS pos FROM i",
    )
)
def recovery(spark, sf_dir):
    return sessions.recovery(_calls(spark, sf_dir)).select("session", "seq", "kind", "seq_gap")


@query(_sql(CALLS, "SELECT session, seq, CAST(sum(bytes) OVER w AS BIGINT) AS observed, count(*) OVER w AS turn FROM i WINDOW w AS (PARTITION BY session, island ORDER BY seq)", i=ISLAND))
def observed_bytes(spark, sf_dir):
    return sessions.observed_bytes(_calls(spark, sf_dir)).select("session", "seq", "observed", "turn")


BAND = "CASE WHEN {b} = 'high' AND {x} >= 943718.4 THEN 'high' WHEN {b} = 'mid' AND {x} >= 368640 AND {x} < 1153433.6 THEN 'mid' WHEN {b} = 'low' AND {x} < 450560 THEN 'low' WHEN {x} < 409600 THEN 'low' WHEN {x} < 1048576 THEN 'mid' ELSE 'high' END"


@query(
    f"WITH RECURSIVE c AS ({D.calls(DUCK)}), n AS (SELECT session, seq, bytes, row_number() OVER (PARTITION BY session ORDER BY seq) AS pos FROM c), "
    f"b(session, seq, pos, band) AS (SELECT session, seq, pos, {BAND.format(b=chr(39) + chr(39), x='bytes')} FROM n WHERE pos = 1 UNION ALL SELECT n.session, n.seq, n.pos, {BAND.format(b='b.band', x='n.bytes')} FROM b JOIN n ON n.session = b.session AND n.pos = b.pos + 1) SELECT session, seq, band FROM b"
)
def pressure_hysteresis(spark, sf_dir):
    return sessions.pressure_hysteresis(load(spark, sf_dir, CALLS)).select("session", "seq", "band")


@query(_sql(CALLS, "SELECT session, seq, coalesce(hash = lag(hash) OVER (PARTITION BY session, call_id ORDER BY seq), false) AS repeated FROM c"))
def lru_repeat(spark, sf_dir):
    return sessions.repeated_calls(load(spark, sf_dir, CALLS)).select("session", "seq", "repeated")


def _turns(spark, sf_dir) -> DataFrame:
    chat = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return chat.select(
        F.col("conv_id").cast("string").alias("session"), F.col("turn").cast("long").alias("seq"), F.lit("eval").alias("profile"), S.word_count(F.col("text")).alias("words"),
        X.is_blocker(F.col("text")).alias("blocker"), F.floor(F.col("turn") / 4).cast("string").alias("turn_key"),
    )


@query(
    "WITH RECURSIVE n AS (SELECT CAST(conv_id AS VARCHAR) AS session, CAST(turn AS BIGINT) AS seq, turn // 4 AS tk, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations), "
    "f(session, seq, pos, tk, total, fired, exceeded) AS (SELECT session, seq, pos, tk, words, CASE WHEN words >= 71 THEN words ELSE 0 END, words >= 71 FROM n WHERE pos = 1 UNION ALL "
    "SELECT n.session, n.seq, n.pos, n.tk, t, CASE WHEN t >= lim THEN t ELSE was END, t >= lim FROM f JOIN n ON n.session = f.session AND n.pos = f.pos + 1, LATERAL (SELECT CASE WHEN n.tk = f.tk THEN f.total ELSE 0 END + n.words AS t, CASE WHEN n.tk = f.tk THEN f.fired ELSE 0 END AS was) x, LATERAL (SELECT CASE WHEN was > 0 THEN was + 18 ELSE 71 END AS lim) y) "
    "SELECT session, seq, total, exceeded FROM f"
)
def narration_meter(spark, sf_dir):
    return sessions.narration_meter(_turns(spark, sf_dir)).select("session", "seq", "total", "exceeded")


@query("SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn)) AS prompt FROM conversations")
def prompt_asof(spark, sf_dir):
    chat = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumns({"session": F.col("conv_id"), "seq": F.col("turn")})
    return sessions.prompt_as_of(chat, F.col("role") == "user").select("conv_id", "turn", F.md5("prompt").alias("prompt"))


@query(_sql(CALLS, "SELECT session, seq, coalesce(lossy AND row_number() OVER (PARTITION BY session, island, lossy ORDER BY seq) = 1, false) AS note FROM i", i=ISLAND))
def note_once(spark, sf_dir):
    return sessions.note_once(_calls(spark, sf_dir), F.col("lossy")).select("session", "seq", "note")


# --- runtimes -----------------------------------------------------------------------------------------------------------
HOSTS = D.host_calls


def _classed(t: str) -> str:
    """A text's estimate by its class, as SQL."""
    other, digits, gaps = (f"CAST(len(regexp_extract_all({t}, '{p}')) AS DOUBLE)" for p in ("[^a-zA-Z0-9_ \\t-\\r]", "[0-9]", "[ \\t-\\r]+"))
    blanks = f"(length({t}) - length(replace({t}, ' ', '')))"
    return (
        f"CAST(ceil(length({t}) / CASE WHEN {other} / length({t}) > 0.28 OR {digits} / length({t}) > 0.22 OR length({t}) / ({gaps} + 1) > 18 THEN 2.0 "
        f"WHEN {other} / length({t}) > 0.14 THEN 2.6 WHEN {blanks} / length({t}) > 0.14 AND {other} / length({t}) < 0.09 THEN 3.8 ELSE 3.2 END) AS BIGINT)"
    )


def _host_sql(name: str, reads: bool, repeats: bool) -> str:
    """Routes and totals of one runtime, from the texts themselves."""
    bypass = "contains(coalesce(command, ''), 'TRIM_OFF=1')"
    admitted = f"(regexp_matches(path, '{C.duck(C.LOG_PATH)}') OR starts_with(path, '/tmp/trim-sidecar/'))"
    way = f"CASE WHEN reset IS NOT NULL THEN 'reset' WHEN {bypass} THEN 'bypass' "
    way += "WHEN repeated THEN 'repeated' " if repeats else ""
    way += f"WHEN tool = 'read' AND NOT {admitted} THEN 'skip' " if reads else "WHEN tool = 'read' THEN 'skip' "
    way += "WHEN tool = 'read' AND \"offset\" IS NOT NULL AND starts_with(path, '/tmp/trim-sidecar/') AND len(string_split(text, chr(10))) <= 400 AND length(text) <= 65536 THEN 'verbatim' WHEN tool = 'mcp__a' THEN 'observe' ELSE 'condense' END"
    short = "CASE WHEN k >= 3 THEN 'waiting for lock  [trim hook: line repeated ' || k || 'x]' || chr(10) || 'done' ELSE text END"
    return f"""SELECT '{name}' AS runtime, session, seq, route, applied, CASE WHEN work THEN length(text) END AS in_bytes, CASE WHEN work THEN length(CASE WHEN applied THEN short ELSE text END) END AS out_bytes FROM (
  SELECT *, route IN ('condense', 'observe') AS work, route = 'condense' AND length(text) - length(short) >= 32 AND {_classed('text')} - {_classed('short')} >= 24 AS applied FROM (
    SELECT *, {way} AS route, {short} AS short FROM (SELECT *, coalesce(reset IS NULL AND NOT {bypass} AND lag(text) OVER (PARTITION BY session, island, call_id, reset IS NULL AND NOT {bypass} ORDER BY seq) = text, false) AS repeated FROM i) a) b) d"""


HOST_ISLAND = "SELECT *, sum(CASE WHEN reset = 'switch' THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY seq) AS island FROM c"


def _host_calls(spark, sf_dir) -> DataFrame:
    block = F.array(F.struct(F.lit("image").alias("type"), F.lit("raw").alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")))
    return load(spark, sf_dir, HOSTS).withColumn("blocks", F.when(F.col("reset").isNull(), block))


@query(_sql(HOSTS, " UNION ALL ".join(_host_sql(r.name, r.reads, r.repeats) for r in runtimes.RUNTIMES.values()), i=HOST_ISLAND))
def runtime_routes(spark, sf_dir):
    """Every runtime over the same calls: routes, gates, and bytes in and out; other servers' tools are only observed."""
    calls, out = _host_calls(spark, sf_dir), None
    for r in runtimes.RUNTIMES.values():
        one = runtimes.handle(calls, r, runtimes.Observed("observe")).select(F.lit(r.name).alias("runtime"), "session", "seq", "route", "applied", "in_bytes", "out_bytes")
        out = one if out is None else out.union(one)
    return out


@query(_sql(HOSTS, "SELECT session, seq, coalesce(reset IS NULL AND text = was, false) AS repeated FROM (SELECT *, lag(text) OVER (PARTITION BY session, island, call_id, reset IS NULL ORDER BY seq) AS was FROM i) a", i=HOST_ISLAND))
def repeat_resets(spark, sf_dir):
    """Calls seen again since the last switch; a compaction keeps them."""
    return sessions.repeated_calls(load(spark, sf_dir, HOSTS).withColumn("hash", F.md5("text"))).select("session", "seq", "repeated")


@query(
    f"WITH RECURSIVE c AS ({D.host_calls(DUCK)}), n AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS pos FROM c), "
    f"b(session, seq, pos, band) AS (SELECT session, seq, pos, CASE WHEN reset IS NOT NULL THEN 'low' ELSE {BAND.format(b=chr(39) + chr(39), x='context_bytes')} END FROM n WHERE pos = 1 UNION ALL "
    f"SELECT n.session, n.seq, n.pos, CASE WHEN n.reset IS NOT NULL THEN 'low' ELSE {BAND.format(b='b.band', x='n.context_bytes')} END FROM b JOIN n ON n.session = b.session AND n.pos = b.pos + 1) SELECT session, seq, band FROM b"
)
def pressure_resets(spark, sf_dir):
    """Pressure bands that compactions and switches set low."""
    return sessions.pressure_hysteresis(load(spark, sf_dir, HOSTS).withColumn("bytes", F.col("context_bytes"))).select("session", "seq", "band")


# --- report -------------------------------------------------------------------------------------------------------------
R = D.records
LIVE = "NOT coalesce(bypass, false)"
TOK = "CASE WHEN inTokEst IS NOT NULL AND outTokEst IS NOT NULL THEN {0}TokEst ELSE CAST(floor({0}Bytes / 4.0 + 0.5) AS BIGINT) END"


@query(
    _sql(
        R,
        f"SELECT count(*) FILTER ({LIVE}) AS calls_processed, count(*) FILTER ({LIVE} AND changed) AS calls_changed, count(*) FILTER (NOT ({LIVE})) AS bypasses, CAST(sum(inBytes) FILTER ({LIVE}) AS BIGINT) AS input_bytes, CAST(sum(outBytes) FILTER ({LIVE}) AS BIGINT) AS output_bytes, "
        f"CAST(sum(inBytes - outBytes) FILTER ({LIVE}) AS BIGINT) AS bytes_saved, round(CAST(sum(outBytes) FILTER ({LIVE}) AS DOUBLE) / sum(inBytes) FILTER ({LIVE}), 3) AS ratio, CAST(sum({TOK.format('in')} - {TOK.format('out')}) FILTER ({LIVE}) AS BIGINT) AS tokens_saved, 'class/1' AS estimator, "
        f"count(*) FILTER ({LIVE} AND lossy) AS lossy, count(*) FILTER ({LIVE} AND changed AND NOT lossy) AS lossless, count(*) FILTER ({LIVE} AND sidecar) AS sidecars, count(*) FILTER ({LIVE} AND strategy <> 'generic') AS detections, count(*) FILTER ({LIVE} AND dupExact) AS exact_duplicates FROM c",
    )
)
def stats_summary(spark, sf_dir):
    return report.summary(load(spark, sf_dir, R))


def _groups(key: str, most: str = "") -> str:
    return _sql(R, f"SELECT coalesce({key}, '(none)') AS key, count(*) AS calls, CAST(sum(inBytes) AS BIGINT) AS in_bytes, CAST(sum(outBytes) AS BIGINT) AS out_bytes, CAST(sum(inBytes) - sum(outBytes) AS BIGINT) AS saved FROM c WHERE {LIVE} GROUP BY 1 ORDER BY saved DESC, min(pos) {most}")


@query(_groups("strategy"))
def by_strategy(spark, sf_dir):
    return report.grouped(load(spark, sf_dir, R), "strategy")


@query(_groups("tag"))
def by_runtime(spark, sf_dir):
    return report.grouped(load(spark, sf_dir, R), "tag")


@query(_groups("cmdWord", "LIMIT 15"))
def by_command_top15(spark, sf_dir):
    return report.grouped(load(spark, sf_dir, R), "cmdWord", 15)


@query(_sql(R, f"SELECT pos, tag, cmdWord, strategy, inBytes, outBytes FROM c WHERE {LIVE} ORDER BY inBytes DESC, pos LIMIT 5"))
def largest5(spark, sf_dir):
    return report.largest(load(spark, sf_dir, R))


@query(_sql(R, "SELECT pos, cmdHash, cmdWord, ts_ms - was AS gap_ms FROM (SELECT *, lag(lossy) OVER w AS was_lossy, lag(ts_ms) OVER w AS was FROM c WINDOW w AS (PARTITION BY cmdHash ORDER BY pos)) a WHERE was_lossy AND ts_ms - was < 300000"))
def possible_reruns(spark, sf_dir):
    return report.possible_reruns(load(spark, sf_dir, R))


@query(_sql(R, f"SELECT count(*) FILTER (candidate) AS candidates, count(*) FILTER ({LIVE}) AS total, round(CAST(count(*) FILTER (candidate) AS DOUBLE) / count(*) FILTER ({LIVE}), 3) AS rate, count(*) FILTER (candidate AND preceding_lossy) AS after_lossy, count(*) FILTER ({LIVE} AND lossy) AS lossy_total, count(*) FILTER (candidate AND NOT preceding_lossy) AS after_untouched, count(*) FILTER ({LIVE} AND NOT lossy) AS untouched_total FROM c"))
def recovery_rate(spark, sf_dir):
    return report.recovery_rate(load(spark, sf_dir, R))


@query(_sql(R, "SELECT kind, count(*) AS n FROM c WHERE candidate GROUP BY kind"))
def recovery_kinds(spark, sf_dir):
    return report.recovery_kinds(load(spark, sf_dir, R))


@query(_sql(R, f"SELECT tokenClass AS cls, count(*) AS n FROM c WHERE {LIVE} AND inTokEst IS NOT NULL GROUP BY 1"))
def token_class_mix(spark, sf_dir):
    return report.class_mix(load(spark, sf_dir, R))


@query("SELECT p_name AS file, p_size * 30 AS out_bytes, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 20 + p_partkey % 500 END AS base_bytes, CASE WHEN p_partkey % 3 <> 0 THEN p_size * 30 > (p_size * 20 + p_partkey % 500) * 1.1 + 64 ELSE false END AS regressed FROM (SELECT concat(p_name, p_partkey) AS p_name, CAST(p_size AS BIGINT) AS p_size, p_partkey FROM part) p")
def regression_gate(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat("p_name", F.col("p_partkey").cast("string")).alias("file"), F.col("p_size").cast("long").alias("s"), "p_partkey")
    return report.regression_gate(p.select("file", (F.col("s") * 30).alias("out_bytes")), p.where("p_partkey % 3 <> 0").select("file", (F.col("s") * 20 + F.col("p_partkey") % 500).alias("out_bytes")))


@query("SELECT o_orderpriority AS posture, count(*) AS files, CAST(sum(o_custkey) AS BIGINT) AS in_bytes, CAST(sum(o_orderkey) AS BIGINT) AS out_bytes FROM orders GROUP BY 1")
def posture_totals(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return report.posture_totals(o.select(F.col("o_orderpriority").alias("posture"), F.col("o_custkey").alias("in_bytes"), F.col("o_orderkey").alias("out_bytes")))


@query("SELECT event_type AS scenario, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return report.latency(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("scenario"), F.col("value").alias("ms")))


@query("SELECT coalesce(a.e, b.e) AS event, CASE WHEN b.e IS NULL THEN 'missing' WHEN a.e IS NULL THEN 'extra' WHEN a.c <> b.c THEN 'changed' ELSE 'same' END AS status FROM (SELECT s_suppkey AS e, s_nationkey AS c FROM supplier WHERE s_suppkey % 3 <> 0) a FULL JOIN (SELECT s_suppkey AS e, s_nationkey + CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END AS c FROM supplier WHERE s_suppkey % 4 <> 0) b ON a.e = b.e")
def hook_compare(spark, sf_dir):
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    wanted = s.where("s_suppkey % 3 <> 0").select(F.col("s_suppkey").alias("event"), F.col("s_nationkey").alias("command"))
    installed = s.where("s_suppkey % 4 <> 0").select(F.col("s_suppkey").alias("event"), (F.col("s_nationkey") + F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0)).alias("command"))
    return report.compare_wiring(wanted, installed)
