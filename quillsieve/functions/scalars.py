"""Column functions: lengths, hashes, token estimates, tokens of prompts, gates and caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C
from .text import trim_ws

def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def fnv1a(text: Column) -> Column:
    """FNV-1a of the UTF-16 units, 32 bits, as hex without leading zeros."""
    hexed = F.hex(F.encode(text, "UTF-16BE"))
    units = F.transform(
        F.when(F.length(hexed) > 0, F.sequence(F.lit(0), (F.length(hexed) / 4 - 1).cast("int"))).otherwise(F.array().cast("array<int>")),
        lambda k: F.conv(F.substring(hexed, k * 4 + 1, F.lit(4)), 16, 10).cast("long"),
    )
    step = lambda h, u: h.bitwiseXOR(u) * F.lit(16777619) % F.lit(2**32)  # noqa: E731  32 by 25 bits fit a long
    return F.lower(F.hex(F.aggregate(units, F.lit(2166136261).cast("long"), step)))


def sha256_name(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16)


def dup_hash(text: Column) -> Column:
    """SHA-256 of a text without escapes, time stamps and repeated blanks."""
    from .text import strip_ansi

    plain = F.regexp_replace(F.regexp_replace(strip_ansi(text), C.TIME_STAMP, "<time>"), "[ \\t]+", " ")
    return F.sha2(trim_ws(plain), 256)


def command_word(command: Column) -> Column:
    return F.substring(F.split(trim_ws(command), f"[{C.WS}]+", 2)[0], 1, 32)


def sidecar_name(text: Column, session: Column) -> Column:
    """Name of a saved output: the session's first characters and the text's hash."""
    prefix = F.when(F.coalesce(session, F.lit("")) != "", F.concat(F.substring(F.regexp_replace(session, "[^a-zA-Z0-9-]", "_"), 1, 8), F.lit("-"))).otherwise("")
    return F.concat(prefix, fnv1a(text), F.lit(".txt"))


def session_key(session: Column) -> Column:
    return F.substring(F.regexp_replace(session, "[^a-zA-Z0-9-]", "_"), 1, 120)


def _class_of(facts: Column) -> Column:
    """The class by shares of a sample's units; each share is a count from ``_sample_facts``."""
    share = lambda name: facts[name] / facts["units"]
    return (
        F.when(facts["units"] == 0, "mixed")
        .when(share("cjk") > 0.15, "cjk")
        .when((share("other") > 0.28) | (share("digits") > 0.22) | (facts["units"] / (facts["gaps"] + 1) > 18), "dense")
        .when(share("other") > 0.14, "code")
        .when((share("blanks") > 0.14) & (share("other") < 0.09), "prose")
        .otherwise("mixed")
    )


def _sample_facts(sample: Column) -> Column:
    """Counts over a sample. A class of characters is counted by what its removal takes away: one pass, run by run."""
    left = lambda pattern: F.length(F.regexp_replace(sample, pattern, ""))
    size, units = F.length(sample), utf16_length(sample)
    plain = F.octet_length(sample) == size  # ASCII has none of the CJK ranges
    return F.struct(
        units.cast("double").alias("units"),
        (left(f"[A-Za-z0-9_{C.WS}]+") + units - size).cast("double").alias("other"),  # a character of two units counts twice
        (size - left("[0-9]+")).cast("double").alias("digits"),
        (size - F.length(F.replace(sample, F.lit(" "), F.lit("")))).cast("double").alias("blanks"),
        F.regexp_count(sample, F.lit(f"[{C.WS}]+")).cast("double").alias("gaps"),
        F.when(plain, 0).otherwise(size - left(C.CJK + "+")).cast("double").alias("cjk"),
    )


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def token_facts(text: Column) -> Column:
    """Struct of ``cls`` (cjk, dense, code, prose or mixed, by shares in the first 65,536 characters) and ``tokens``:
    code points of cjk text, else UTF-16 units by the class's divisor, rounded up."""
    whole = F.coalesce(text, F.lit(""))
    named = _once(_sample_facts(F.substring(whole, 1, C.SAMPLE_UNITS)), _class_of)

    def estimate(kind):
        divisor = F.lit(C.DIVISORS["mixed"])
        for name in ("dense", "code", "prose"):
            divisor = F.when(kind == name, F.lit(C.DIVISORS[name])).otherwise(divisor)
        tokens = F.when(whole == "", F.lit(0).cast("long")).when(kind == "cjk", F.length(whole).cast("long")).otherwise(F.ceil(utf16_length(whole).cast("double") / divisor))
        return F.struct(kind.alias("cls"), tokens.alias("tokens"))

    return _once(named, estimate)


def token_class(text: Column) -> Column:
    """The class alone of :func:`token_facts`."""
    return token_facts(text)["cls"]


def token_estimate(text: Column) -> Column:
    """The estimate alone of :func:`token_facts`."""
    return token_facts(text)["tokens"]


def net_win(in_bytes: Column, out_bytes: Column, in_tokens: Column, out_tokens: Column) -> Column:
    """A rewrite must save bytes and estimated tokens."""
    return F.coalesce((in_bytes - out_bytes >= C.NET_WIN_BYTES) & (in_tokens - out_tokens >= C.NET_WIN_TOKENS), F.lit(False))


def prompt_tokens(prompt: Column) -> Column:
    """Marked spans of a prompt: back-ticked or quoted, lower case, distinct, the first eight."""
    spans = F.transform(F.regexp_extract_all(prompt, F.lit(C.QUOTED), 0), lambda s: F.lower(trim_ws(F.substring(s, F.lit(2), F.length(s) - 2))))
    return F.slice(F.array_distinct(F.filter(spans, lambda s: s != "")), 1, C.RELEVANCE_TOKENS)


def merge_relevance(legacy: Column, *categories: Column) -> Column:
    """Trusted terms: eight of each list, trimmed, lower case, 3 to 120 characters, no stop terms, 24 in all."""
    none = F.array().cast("array<string>")
    parts = [F.slice(F.coalesce(c, none), 1, C.RELEVANCE_TOKENS) for c in (legacy, *categories)]
    tidy = F.transform(F.concat(*parts), lambda s: F.lower(trim_ws(s)))
    good = F.filter(tidy, lambda s: s.isNotNull() & F.length(s).between(3, 120) & ~s.isin(*C.STOP_TOKENS))
    return F.slice(F.array_distinct(good), 1, C.RELEVANCE_TOTAL)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{C.WS}]+")).cast("long")


def pressure_band(size: Column) -> Column:
    return F.when(size.isNull() | (size < C.PRESSURE_MID), "low").when(size < C.PRESSURE_HIGH, "mid").otherwise("high")


def pressure_scale(band: Column) -> Column:
    return F.when(band == "high", 0.5).when(band == "mid", 0.75).otherwise(1.0)


def js_round(x: Column) -> Column:
    return F.floor(x + 0.5).cast("long")


def choose_cap(enumerate_: Column, generous: Column, pass_cap: Column, fail_cap: Column, scale: Column) -> Column:
    """Lines that a view may have."""
    return (
        F.when(enumerate_, F.lit(C.CAP_ENUMERATE).cast("long"))
        .when(generous, F.greatest(F.lit(C.FLOOR_FAIL).cast("long"), js_round(fail_cap * scale)))
        .otherwise(F.greatest(F.lit(C.FLOOR_PASS).cast("long"), js_round(pass_cap * scale)))
    )


def exit_code(response: Column) -> Column:
    """The first numeric one of exitCode, exit_code and code in a JSON object."""
    parsed = F.try_parse_json(response)
    number = lambda k: F.when(F.schema_of_variant(F.try_variant_get(parsed, f"$.{k}", "variant")).rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.try_variant_get(parsed, f"$.{k}", "double"))
    return F.coalesce(number("exitCode"), number("exit_code"), number("code")).cast("int")


def canonical_json(text: Column) -> Column:
    """JSON with the keys of every object in order, arrays as they are and no blanks; null where it is none.

    Nested values are walked by an expression as deep as ``CANONICAL_DEPTH``; deeper ones keep their own order of keys.
    """
    return _canonical(F.try_parse_json(text), CANONICAL_DEPTH)


CANONICAL_DEPTH = 5


def _canonical(value: Column, depth: int) -> Column:
    plain = F.to_json(value)
    if not depth:
        return plain
    kind = F.schema_of_variant(value)
    below = lambda v: _canonical(v, depth - 1)
    fields = F.try_variant_get(value, "$", "map<string,variant>")
    named = F.transform(F.array_sort(F.map_keys(fields)), lambda k: F.concat(_quoted(k), F.lit(":"), F.coalesce(below(fields[k]), F.lit("null"))))
    items = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.coalesce(below(v), F.lit("null")))
    joined = lambda parts, ends: F.concat(F.lit(ends[0]), F.array_join(parts, ","), F.lit(ends[1]))
    return F.when(kind.startswith("OBJECT"), joined(named, "{}")).when(kind.startswith("ARRAY"), joined(items, "[]")).otherwise(plain)


def _quoted(key: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(key.alias("k"))), '(?s)^\\{"k":(.*)\\}\\z', 1)
