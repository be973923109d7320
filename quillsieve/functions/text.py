"""Column functions: lossless cleanup, line predicates and text classifiers. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as C


def strip_ansi(text: Column) -> Column:
    """Without CSI, OSC and two-byte escape sequences."""
    return F.when(text.contains("\x1b"), F.regexp_replace(text, C.ANSI, "")).otherwise(text)


def resolve_cr(text: Column) -> Column:
    """CRLF as LF; of each line what follows its last CR."""
    return F.when(text.contains("\r"), F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), C.REPAINTED, "")).otherwise(text)


def tidy_whitespace(text: Column) -> Column:
    """Without control characters (tab, LF and CR stay) and blanks at line ends."""
    return F.regexp_replace(F.regexp_replace(text, C.CONTROL, ""), C.TRAILING, "")


def collapse_blanks(text: Column) -> Column:
    """Three and more line ends as two."""
    return F.regexp_replace(text, "\\n{3,}", "\n\n")


def clean(text: Column) -> Column:
    """All cleanup steps in their order."""
    return collapse_blanks(tidy_whitespace(resolve_cr(strip_ansi(text))))


def line_list(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_count(text: Column) -> Column:
    return F.size(line_list(text)).cast("long")


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{C.WS}]++|(?<![{C.WS}])[{C.WS}]++\\z", "")


def last_non_blank(text: Column) -> Column:
    """The last line with anything but white space; null without one."""
    return F.try_element_at(F.filter(line_list(text), lambda x: F.length(trim_ws(x)) > 0), F.lit(-1))


def protected_trailer(text: Column, pattern: str = C.TRAILER) -> Column:
    """The last non-blank line if it must stay last; else null."""
    last = last_non_blank(text)
    return F.when(last.rlike(pattern), last)


def keep_trailer(out: Column, original: Column) -> Column:
    """``out`` ending with the original's protected trailer, if that has one and the text changed."""
    trailer = protected_trailer(original)
    tail = F.concat(F.lit("\\n?\\Q"), trailer, F.lit(f"\\E[{C.WS}]*\\z"))
    body = F.regexp_replace(F.regexp_replace(out, tail, F.lit("")), F.lit("\\n+\\z"), F.lit(""))
    needed = trailer.isNotNull() & (out != original) & ~F.coalesce(last_non_blank(out) == trailer, F.lit(False))
    return F.when(needed, F.concat(body, F.lit("\n"), trailer)).otherwise(out)


def is_signal(line: Column, keep: str | None = None) -> Column:
    """Error, warning and failure vocabulary (or ``keep``, in either case), runner glyphs, compound names."""
    return line.rlike(f"(?i){keep}" if keep else C.SIGNAL) | line.rlike(C.COMPOUND)


def looks_like_failure(text: Column, exit_code: Column) -> Column:
    """The exit code decides; without one, the text's own vocabulary."""
    return F.when(exit_code.isNotNull(), exit_code != 0).otherwise(text.rlike("(?m)" + C.FAILURE))


def is_file_dump(command: Column) -> Column:
    """A command that only prints a file."""
    return F.coalesce(trim_ws(F.substring_index(command, "\n", 1)).rlike(C.FILE_DUMP), F.lit(False))


def requests_enumeration(prompt: Column) -> Column:
    """A prompt that asks for every one of something countable."""
    return F.coalesce(prompt.rlike(C.ENUMERATION), F.lit(False))


def is_log_path(path: Column) -> Column:
    return F.coalesce(trim_ws(path).rlike(C.LOG_PATH), F.lit(False))


def is_generated_path(path: Column) -> Column:
    return F.coalesce(trim_ws(path).rlike(C.GENERATED_PATH), F.lit(False))


def is_sidecar_path(path: Column, folder: str) -> Column:
    """A file directly in the folder of saved outputs."""
    plain = F.regexp_replace(F.replace(trim_ws(path), F.lit("\\"), F.lit("/")), "/(?:\\./)+|/{2,}", "/")
    return F.coalesce(F.regexp_replace(plain, "/[^/]*\\z", "") == F.lit(folder.rstrip("/")), F.lit(False))


def is_exact_range(path: Column, folder: str, offset: Column, limit: Column, content: Column) -> Column:
    """A bounded range read of a saved output, to be left as it is."""
    small = (F.octet_length(content) <= C.EXACT_MAX_BYTES) & (line_count(content) <= C.EXACT_MAX_LINES)
    return F.coalesce(is_sidecar_path(path, folder) & (offset.isNotNull() | limit.isNotNull()) & small, F.lit(False))


def condensed_envelope(text: Column) -> Column:
    """A JSON body (or none) behind a protected trailer."""
    trailer = protected_trailer(text)
    body = trim_ws(F.regexp_replace(text, F.concat(F.lit("\\Q"), trailer, F.lit(f"\\E[{C.WS}]*\\z")), F.lit("")))
    return F.coalesce((body == "") | body.rlike("^[\\[{]"), F.lit(False))


def already_condensed(text: Column) -> Column:
    """Output that another tool has condensed."""
    return condensed_envelope(text) | text.rlike(C.FOREIGN)


def host_complete_shell(text: Column, is_read: Column) -> Column:
    return is_read | ((F.octet_length(text) < C.SHELL_MAX) & ~text.rlike(C.HOST_CUT))


def host_complete_details(text: Column, truncated: Column, full_path: Column) -> Column:
    """Typed flags, marks in the text, size and lines."""
    flagged = F.coalesce(truncated, F.lit(False)) | (F.coalesce(full_path, F.lit("")) != "")
    big = (F.octet_length(text) >= C.HOST_MAX_BYTES) | ((text != "") & (line_count(text) >= C.HOST_MAX_LINES))
    return ~(flagged | text.rlike(C.HOST_CUT_MARK) | big)


def is_bypass(command: Column) -> Column:
    return F.coalesce(command.contains(C.BYPASS), F.lit(False))


def is_blocker(text: Column) -> Column:
    return text.rlike(C.BLOCKER)


def census_category(line: Column) -> Column:
    """Number of the first census category of a line; null if none."""
    out = F.lit(None).cast("int")
    for k in reversed(range(len(C.CENSUS))):
        out = F.when(line.rlike(C.CENSUS[k][2]), F.lit(k)).otherwise(out)
    return out
