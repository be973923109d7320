"""Whole-text operators for the Arrow path: what a fold over lines decides, row by row, without any shuffle."""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import accumulate, compress

import numpy as np

from .. import constants as C

#: Characters that either split() or WS takes as white space, but not both.
UNLIKE_WS = "\x1c\x1d\x1e\x1f\x85\ufeff"
#: A blank before a line's end, as TRAILING sees it, inside a text.
BLANK_ENDS = tuple(a + b for a in " \t" for b in "\n\r\u2028\u2029")
WORD_OR_WS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_\t\n\x0b\x0c\r "
WIDE_WS = "".join(c for c in C.WS_CHARS if not c.isascii())


@functools.cache
def _re(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace("\\z", "\\Z"), re.A)


def strip(text: str) -> str:
    return text.strip(C.WS_CHARS)


def units(text: str) -> int:
    """UTF-16 units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2


def is_signal(line: str, keep: str | None = None) -> bool:
    """``keep``: a pattern of the user's, in either case, in place of the vocabulary; compound names count as well."""
    return bool(_re(f"(?i){keep}" if keep else C.SIGNAL).search(line) or _re(C.COMPOUND).search(line))


def _alternatives(pattern: str) -> list[str]:
    """A pattern cut at its outermost bars."""
    out, depth = [""], 0
    for c in pattern:
        depth += (c in "([") - (c in ")]")
        if c == "|" and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


@functools.cache
def _parts(pattern: str) -> tuple[list, list]:
    """A pattern's alternatives: those that begin with letters as ``stem, cased, pattern at the stem``, those that are bound
    to a line's start as ``characters that such a line holds, pattern``."""
    stems, bound = [], []
    flags, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    for alternative in _alternatives(body):
        if alternative.startswith("^"):
            glyphs = "".join(c for c in alternative if not c.isascii()) or alternative[1]
            bound.append((glyphs + (glyphs.swapcase() if flags else ""), _re(flags + alternative)))
            continue
        edge = next((e for e in (C.B, C.NOT_AFTER) if alternative.startswith(e)), "")
        own = alternative[len(edge) :]
        words, end = ([own], "") if not own.startswith("(?:") else (_alternatives(own[3 : own.rindex(")", 0, own.rindex("(?!") if "(?!" in own else None)]), own[own.rindex(")", 0, own.rindex("(?!") if "(?!" in own else None) + 1 :])
        for word in words:
            stem = re.match(r"[^\\()\[\]?*+|.^${}]+", word)[0]
            stem = stem[:-1] if word[len(stem) : len(stem) + 1] in ("?", "*", "{") else stem
            stems.append((stem.lower() if flags else stem, not flags, _re(f"{flags}{edge}{word}{end}")))
    return stems, bound


def _lowered(text: str) -> str:
    """A-Z in lower case, nothing else, so places stay."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def matched(lines: list[str], *patterns: str) -> list[bool]:
    """Which lines hold one of the patterns. All lines are looked through for one stem after the other, and a pattern is
    tried only where its stem stands."""
    text, hit = "\n".join(lines), [False] * len(lines)
    low, ends = _lowered(text), None
    for stems, bound in map(_parts, patterns):
        for stem, cased, pattern in stems:
            source = text if cased else low
            at = source.find(stem)
            while at >= 0:
                if pattern.match(text, at):
                    ends = ends or list(accumulate(len(line) + 1 for line in lines))
                    k = bisect_right(ends, at)
                    hit[k], at = True, ends[k] - 1
                at = source.find(stem, at + 1)
        for chars, pattern in bound:
            if chars.isascii() or any(c in text for c in chars):
                for k, line in enumerate(lines):
                    if not hit[k] and (line[:1] in chars if chars.isascii() else any(c in line for c in chars)) and pattern.search(line):
                        hit[k] = True
    return hit


def holds(text: str, pattern: str) -> bool:
    """Whether a text holds a pattern whose alternatives all begin with letters."""
    low = _lowered(text)
    for stem, cased, own in _parts(pattern)[0]:
        source = text if cased else low
        at = source.find(stem)
        while at >= 0:
            if own.match(text, at):
                return True
            at = source.find(stem, at + 1)
    return False


def signal_mask(lines: list[str], keep: str | None = None) -> list[bool]:
    """``is_signal`` of each line."""
    return [is_signal(line, keep) for line in lines] if keep else matched(lines, C.SIGNAL, C.COMPOUND)


def clean(text: str) -> str:
    if "\x1b" in text:
        text = _re(C.ANSI).sub("", text)
    if "\r" in text:
        text = "\n".join(line[line.rfind("\r") + 1 :] for line in text.replace("\r\n", "\n").split("\n"))
    text = _re(C.CONTROL).sub("", text)
    if text.endswith((" ", "\t")) or any(x in text for x in BLANK_ENDS):
        if any(x in text for x in "\r\u2028\u2029"):
            text = _re(C.TRAILING).sub("", text)
        else:
            text = "\n".join(line.rstrip(" \t") for line in text.split("\n"))
    return _re("\\n{3,}").sub("\n\n", text) if "\n\n\n" in text else text


def last_line(text: str) -> str | None:
    """The last line that is not blank."""
    end = len(text.rstrip(C.WS_CHARS))
    return text[text.rfind("\n", 0, end) + 1 :].split("\n", 1)[0] if end else None


@functools.cache
def _trailer(keep_last: str | None) -> re.Pattern:
    try:
        return _re(f"(?:{C.TRAILER})|(?:{keep_last})" if keep_last else C.TRAILER)
    except re.error:
        return _re(C.TRAILER)


def trailer(text: str, keep_last: str | None = None) -> str | None:
    """The last line that is not blank, if it must stay last. ``keep_last``: a pattern for more such lines; one that does
    not compile counts as none."""
    line = last_line(text)
    return line if line is not None and _trailer(keep_last).search(line) else None


def condensed(text: str, keep_last: str | None = None) -> bool:
    own = trailer(text, keep_last)
    if own is not None:
        body = strip(text[: text.rindex(own)])
        if not body or body[0] in "[{":
            return True
    return (" hook:" in text or " digest:" in text) and bool(_re(C.FOREIGN).search(text))


def census(lines: Iterable[str]) -> list[int]:
    counts, rest = [], list(lines)
    for _, _, pattern in C.CENSUS:
        own = matched(rest, pattern)
        counts.append(sum(own))
        rest = [line for line, m in zip(rest, own) if not m]
    return counts


def census_words(counts: list[int]) -> str:
    return ", ".join(f"{n} {one if n == 1 else many}" for n, (one, many, _) in zip(counts, C.CENSUS) if n)


def count_signals(text: str, keep: str | None = None) -> tuple[int, int]:
    lines = [line for line in text.split("\n") if C.MARK not in line]
    counts = census(compress(lines, signal_mask(lines, keep)))
    return sum(counts[:3]), sum(counts[3:])


def token_class(text: str) -> str:
    """As the column function, over 65,536 UTF-16 units."""
    sample = text[: C.SAMPLE_UNITS] if text.isascii() else text.encode("utf-16-le")[: 2 * C.SAMPLE_UNITS].decode("utf-16-le", "ignore")
    if not sample:
        return "mixed"
    n, raw, plain = units(sample), sample.encode(), sample.isascii()
    if not plain and (len(sample) - len(_re(C.CJK + "+").sub("", sample))) / n > 0.15:
        return "cjk"
    worded = len(raw) - len(raw.translate(None, WORD_OR_WS)) + (0 if plain else sum(sample.count(c) for c in WIDE_WS))
    other = (n - worded) / n
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    if other > 0.28 or digits / n > 0.22 or n / (_gaps(sample) + 1) > 18:
        return "dense"
    if other > 0.14:
        return "code"
    return "prose" if sample.count(" ") / n > 0.14 and other < 0.09 else "mixed"


def _gaps(text: str) -> int:
    """Runs of white space."""
    if any(c in text for c in UNLIKE_WS):
        return len(_re(f"[{C.WS}]+").findall(text))
    words = text.split()
    return len(words) - 1 + text[0].isspace() + text[-1].isspace() if words else 1


def token_estimate(text: str) -> tuple[int, str]:
    kind = token_class(text)
    if not text:
        return 0, "mixed"
    return (len(text) if kind == "cjk" else math.ceil(units(text) / C.DIVISORS[kind])), kind


FNV_START, FNV_PRIME = 2166136261, 16777619


def fnv1a(text: str) -> str:
    """FNV-1a over UTF-16 units, without a loop over them.

    A unit changes only bits below its own width, and bit k of the next state is that of this one, of the unit, and of
    what the bits below carry: a running XOR a bit. With what each unit changed known, the rest is a sum.
    """
    codes = np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2").astype(np.uint32)
    if not len(codes):
        return f"{FNV_START:x}"
    low = np.zeros(len(codes), np.uint32)  # the state before each unit, bit by bit
    for k in range(int(codes.max()).bit_length()):
        turns = (((low ^ codes) & np.uint32((1 << k) - 1)) * np.uint32(FNV_PRIME) ^ codes) >> np.uint32(k) & np.uint32(1)
        turns[1:] = turns[:-1]
        turns[0] = FNV_START >> k & 1
        low |= np.bitwise_xor.accumulate(turns) << np.uint32(k)
    powers = np.multiply.accumulate(np.full(len(codes), FNV_PRIME, np.uint32))
    changes = ((low ^ codes) - low) * powers[::-1]
    return f"{(FNV_START * int(powers[-1]) + int(changes.sum(dtype=np.uint32))) & 0xFFFFFFFF:x}"


def dedupe_runs(lines: list[str]) -> list[str]:
    out, k = [], 0
    while k < len(lines):
        end = k + 1
        while lines[k] and end < len(lines) and lines[end] == lines[k]:
            end += 1
        out += [lines[k] + C.REPEATED.format(n=end - k)] if end - k >= 3 else lines[k:end]
        k = end
    return out


@functools.lru_cache(1 << 16)
def _telling(word: str) -> bool:
    """Three letters and more, no digit."""
    return units(word) >= 3 and not re.search("[0-9]", word)


def same_shape(a: list[str], b: list[str]) -> bool:
    """Equal numbers of words, half of them equal in place, two of those words of three letters and more without digits."""
    if not a or len(a) != len(b):
        return False
    equal = [x for x, y in zip(a, b) if x == y]
    return 2 * len(equal) >= len(a) and sum(map(_telling, equal)) >= 2


def fold_templates(lines: list[str], least: int = C.FOLD_RUN, keep: str | None = None) -> tuple[list[str], int]:
    """Runs of lines shaped as their first become that line and a count; signal lines stand alone. Also: lines folded."""
    runs: list[tuple[int, int]] = []  # first line and length
    shape: list[str] | None = None
    text = "\n".join(lines)
    unlike = any(c in text for c in UNLIKE_WS)
    for k, (line, signal) in enumerate(zip(lines, signal_mask(lines, keep))):
        if signal:
            runs.append((k, 1))
            shape = None
            continue
        words = [w for w in _re(f"[{C.WS}]+").split(line) if w] if unlike else line.split()
        if shape is not None and same_shape(shape, words):
            first, n = runs[-1]
            runs[-1] = (first, n + 1)
        else:
            runs.append((k, 1))
            shape = words
    out, folded = [], 0
    for first, n in runs:
        if n >= least:
            out += [lines[first], C.FOLDED.format(n=n - 1)]
            folded += n - 1
        else:
            out += lines[first : first + n]
    return out, folded


def relevance_hits(lines: list[str], tokens: list[str]) -> list[int]:
    """Lines that hold a token, in order of tokens, then lines; tokens of over 50 lines are too common."""
    if not tokens:
        return []
    lower, hits = [line.lower() for line in lines], {}
    for token in tokens:
        found = [k for k, line in enumerate(lower) if token in line]
        if len(found) <= C.RELEVANCE_COMMON:
            hits.update(dict.fromkeys(found))
    return list(hits)


def _around(lines: list[str], k: int):
    """A hit, its neighbours, and the lines beyond them up to a blank one, 20 at most each way."""
    yield from (k, k - 1, k + 1)
    for start, way in ((k - 2, -1), (k + 2, 1)):
        for n in range(C.RELEVANCE_WINDOW):
            at = start + n * way
            if not 0 <= at < len(lines) or not strip(lines[at]):
                break
            yield at


def cap(lines: list[str], most: int, tokens: list[str], keep: str | None = None) -> tuple[list[str], int]:
    """A view of ``most`` lines and up: signal, what tokens name, then head and tail. Also: lines left out."""
    if len(lines) <= most:
        return lines, 0
    signal = set(compress(range(len(lines)), signal_mask(lines, keep)))
    if len(signal) >= len(lines) * 0.9:
        return lines, 0
    named: set[int] = set()
    for hit in relevance_hits(lines, tokens):
        for k in _around(lines, hit):
            if len(named) < most and 0 <= k < len(lines):
                named.add(k)
        if len(named) >= most:
            break
    kept = signal | named
    budget = max(0, most - len(kept))
    head = math.ceil(budget * 0.6)
    kept |= set(range(min(head, len(lines)))) | set(range(max(0, len(lines) - (budget - head)), len(lines)))
    out, last, omitted = [], -1, 0
    for k in [*sorted(kept), len(lines)]:
        if k - last > 1:
            out.append(C.OMITTED.format(n=k - last - 1))
            omitted += k - last - 1
        if k < len(lines):
            out.append(lines[k])
        last = k
    return [*out, C.SHORTENED], omitted


def digest(text: str, tokens: list[str], keep: str | None = None) -> tuple[str, int, str]:
    """Numbered signal lines, then head and tail. Also: lines in all, and the census."""
    lines = text.split("\n")
    signal = list(compress(range(len(lines)), signal_mask(lines, keep)))
    lead = {*signal[: C.DIGEST_SIGNAL], *signal[-C.DIGEST_SIGNAL :], *relevance_hits(lines, tokens)}
    structure = [k for k in range(len(lines)) if (k < C.DIGEST_HEAD or k >= len(lines) - C.DIGEST_TAIL) and k not in lead]
    words = census_words(census(lines[k] for k in signal))
    out = []
    if lead:
        out.append(f"Signal lines ({len(signal)} total: {words}):")
        out += [f"L{k + 1}: {lines[k]}" for k in sorted(lead)]
        rest = [f"L{k + 1}" for k in signal if k not in lead]
        if rest:
            more = f" ... (+{len(rest) - C.DIGEST_OTHER} more)" if len(rest) > C.DIGEST_OTHER else ""
            out.append(f"Other signal lines (not shown): {', '.join(rest[: C.DIGEST_OTHER])}{more}")
        out.append("")
    out.append("Structure (head + tail; read the file for the rest):")
    last = -1
    for k in structure:
        if k - last > 1:
            out.append(f"  ... {k - last - 1} lines in the file only ...")
        out.append(f"L{k + 1}: {lines[k]}")
        last = k
    return "\n".join(out), len(lines), words


@dataclass(frozen=True)
class Options:
    """What is known about a text besides itself; see the README for the columns."""

    exit_code: int | None = None
    is_dump: bool = False
    enumerate: bool = False
    no_sidecar: bool = False
    host_complete: bool | None = None
    host_may_truncate: bool = False
    profile: str | None = None
    task_phase: str | None = None
    command: str | None = None
    session_id: str | None = None
    runtime: str | None = None
    scale: float = 1.0
    tokens: list = field(default_factory=list)
    keep: str | None = None
    keep_last: str | None = None


def caps_of(profile: str | None) -> tuple[str | None, int, int, int]:
    known = profile in C.PROFILES
    return (profile if known else None, *(C.PROFILES[profile] if known else C.DEFAULT_CAPS))


def sidecar_name(text: str, session: str | None) -> str:
    prefix = re.sub("[^a-zA-Z0-9-]", "_", session)[:8] + "-" if session else ""
    return f"{prefix}{fnv1a(text)}.txt"


def condense(text: str, o: Options, folder: str, formats) -> dict:
    """One text's condensed view and the facts about it. ``formats``: tried in order before the generic way.

    Pure: what a saved copy would hold is returned as ``sidecar``, for a sink to write.
    """
    if not text:
        return {"out": text, "strategy": None}
    if condensed(text, o.keep_last):
        return _facts(text, text, o, None, "passthrough-condensed", len(text.split("\n")), reason="already condensed by another tool; not ours to re-elide")
    profile = o.profile or ("final-verification" if o.task_phase == "final-verification" else None)
    profile, cap_pass, cap_fail, digest_from = caps_of(profile)
    s = clean(text)
    n_lines, own = len(s.split("\n")), trailer(text, o.keep_last)
    saved_as = "saved as observed (host may have truncated)" if o.host_complete is False else None
    path = functools.cache(lambda: f"{folder}/{sidecar_name(s, o.session_id)}")  # hashed only where a copy is saved
    too_big = o.host_may_truncate and o.host_complete is None and units(s) >= C.SHELL_MAX

    def done(out, strategy, **more):
        return _facts(text, _ending(out, own, text), o, profile, strategy, n_lines, **more)

    if not o.enumerate:
        found = formats(s, o)
        if found:
            name, out, lossy, omitted, reason = found
            saved = None
            if lossy and not o.no_sidecar and units(s) >= digest_from and not too_big:
                saved = path()
                what = f"{n_lines}-line output {saved_as}" if saved_as else f"full {n_lines}-line output saved"
                out += f"\n[trim hook: {what} to {saved} — Read it with offset/limit for an exact range]"
            if units(out) < units(s):
                return done(out, name, lossy=lossy, omitted=omitted, path=saved, saved=s if saved else None, reason=reason)
        if not o.no_sidecar and units(s) >= digest_from and not too_big:
            body, total, words = digest(s, o.tokens, o.keep)
            head = (
                f"[trim hook: this output is {total} lines ({words or '0 signal lines'}) and was {saved_as or 'saved in full'} to {path()}; "
                "the digest below keeps the head, tail, every prompt-named line, and a sample of the signal lines, each with its L<n> line number. "
                "For anything else, Read that file with offset/limit around the L<n> line numbers you need. If that file no longer exists, re-run the command instead.]"
            )
            out = f"{head}\n{body}"
            if units(out) < units(s):
                return done(out, "sidecar", lossy=True, omitted=max(0, n_lines - len(out.split("\n"))), path=path(), saved=s, reason="very large output moved to sidecar file, digest kept inline")
    lines, folded = dedupe_runs(s.split("\n")), 0
    if not o.enumerate:
        lines, folded = fold_templates(lines, keep=o.keep)
    if o.enumerate:
        most = C.CAP_ENUMERATE
    elif o.is_dump or (o.exit_code != 0 if o.exit_code is not None else holds(s, C.FAILURE_WORDS)):
        most = max(C.FLOOR_FAIL, math.floor(cap_fail * o.scale + 0.5))
    else:
        most = max(C.FLOOR_PASS, math.floor(cap_pass * o.scale + 0.5))
    lines, omitted = cap(lines, most, o.tokens, o.keep)
    out = "\n".join(lines)
    if omitted and units(out) >= units(s):
        return done(s, "generic", reason="lossless cleanup only; elision markers would not shrink output")
    reason = "capped repetitive output, all signal lines kept" if omitted else "same-shaped log runs collapsed, counts kept" if folded else "lossless cleanup only"
    return done(out, "generic", lossy=bool(omitted or folded), omitted=omitted + folded, reason=reason)


def _ending(out: str, own: str | None, text: str) -> str:
    """``out`` with the protected trailer as its last line, where there is one and the text changed."""
    if own is None or out == text or last_line(out) == own:
        return out
    out = re.sub(rf"\n?{re.escape(own)}[{C.WS}]*\Z", "", out, count=1)
    return out.rstrip("\n") + "\n" + own


def _facts(text, out, o, profile, strategy, n_lines, lossy=False, omitted=0, path=None, saved=None, reason="") -> dict:
    errors, warnings = count_signals(out, o.keep)
    (in_tokens, _), (out_tokens, kind) = token_estimate(text), token_estimate(out)
    return {
        "out": out, "changed": out != text, "strategy": strategy, "inputBytes": len(text.encode()), "outputBytes": len(out.encode()),
        "inputLines": n_lines, "outputLines": len(out.split("\n")), "lossy": lossy, "preservedErrors": errors, "preservedWarnings": warnings,
        "omittedLines": omitted, "sidecarPath": path, "hostComplete": o.host_complete is not False, "runtime": o.runtime, "profile": profile,
        "reason": reason, "inputTokenEstimate": in_tokens, "outputTokenEstimate": out_tokens, "tokenClass": kind, "estimator": C.ESTIMATOR, "sidecar": saved,
    }
