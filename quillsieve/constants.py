"""Markers, patterns, thresholds and tables that results depend on, in one place.

Patterns are written in the dialect that Java and Python share. Word edges are ASCII look-arounds, white space is the
explicit class WS, so both engines agree on text of any language.
"""

from __future__ import annotations

# --- fixed values: markers that outputs carry ---------------------------------------------------------------------
MARK = "[trim hook:"
REPEATED = "  [trim hook: line repeated {n}x]"
FOLDED = "[trim hook: {n} similar lines collapsed (same shape, varying values)]"
OMITTED = "[trim hook: {n} lines omitted from this view, none with errors/warnings]"
SHORTENED = "[trim hook: output shortened; rerun with TRIM_OFF=1 prefix for the full version]"
BYPASS = "TRIM_OFF=1"

# --- fixed values: thresholds -----------------------------------------------------------------------------------------
CAP_ENUMERATE = 2000
FLOOR_PASS, FLOOR_FAIL = 30, 125
FOLD_RUN = 5
RELEVANCE_COMMON, RELEVANCE_TOKENS, RELEVANCE_TOTAL, RELEVANCE_WINDOW = 50, 8, 24, 20
DIGEST_HEAD, DIGEST_TAIL, DIGEST_SIGNAL, DIGEST_OTHER = 20, 15, 10, 15
SHELL_MAX = 28000
EXACT_MAX_BYTES, EXACT_MAX_LINES = 64 * 1024, 400
PRESSURE_MID, PRESSURE_HIGH = 400 * 1024, 1024 * 1024
NET_WIN_BYTES, NET_WIN_TOKENS = 32, 24
FORMAT_LINES = 2000
DUP_RING, RECOVERY_RING, RECOVERY_WINDOW, HANDLED_MAX = 20, 32, 5, 200
NARRATION_BUDGET = 70
HOST_MAX_BYTES, HOST_MAX_LINES = 50 * 1024, 2000
TTL_HOURS, SWEEP_MAX = 72, 200
TAIL_BYTES = 1024 * 1024
RERUN_MS = 5 * 60 * 1000
ESTIMATOR = "class/1"
SAMPLE_UNITS = 65536

#: Caps by profile: passing output, failing output, characters from which a digest replaces the text.
DEFAULT_CAPS = (120, 300, 15000)
PROFILES = {
    "interactive-short": (120, 300, 15000),
    "interactive-long": (80, 220, 10000),
    "autonomous-loop": (50, 180, 8000),
    "eval": (60, 200, 8000),
    "final-verification": (100, 300, 12000),
}
#: Characters per token by text class.
DIVISORS = {"dense": 2.0, "code": 2.6, "mixed": 3.2, "prose": 3.8}
STOP_TOKENS = ("error", "warning", "failed", "output", "result", "everything", "all", "keep")

# --- fixed values: patterns -------------------------------------------------------------------------------------------
WS = "\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
WS_CHARS = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
B, E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
SIGNAL_WORDS = (
    "err(?:or)?s?|warn(?:ing)?s?|fail(?:s|ed|ing|ure|ures)?|exception|traceback|panic|fatal|denied|refused|"
    "timeout|timed out|not found|cannot|unable|deprecated|critical|assert(?:ion)?|expected|received|actual|"
    "missing|unresolved|undefined reference|segfault|segmentation fault|core dumped|killed|aborted|"
    "out of memory|stack overflow|unhandled|uncaught|non-zero exit|exit code [1-9][0-9]*"
)
SIGNAL = f"(?i){B}(?:{SIGNAL_WORDS}){E}|^[{WS}]*(?:✗|✘|×|✖|❯)|{B}not ok{E}|^E[{WS}]{{2,}}[^{WS}]"
COMPOUND = f"(?:Error|Warning|Exception){E}"
_FAILURE = "(?:FAIL(?:ED|URE)?|fail(?:ed|ure)?s?:|Error|error:|ERR!|✗|✘|not ok|Traceback|exception|panic|fatal)"
FAILURE = f"(?:^|[^0-9a-zA-Z]){_FAILURE}(?:[^0-9a-zA-Z]|$)"
NOT_AFTER = "(?<![0-9a-zA-Z])"
FAILURE_WORDS = f"{NOT_AFTER}{_FAILURE}(?![0-9a-zA-Z])"  # the same with look-around, as the fold looks for it
FILE_DUMP = f"(?i)^(?:cat|type|gc|Get-Content)[{WS}]+[^|;&<>]+$"
ANSI = "\\x1b(?:\\[[0-9;?]*[ -/]*[@-~]|\\][^\\x07\\x1b]*(?:\\x07|\\x1b\\\\)|[@-Z\\\\-_])"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]"
TRAILING = "(?<![ \\t])[ \\t]++(?=[\\n\\r\\u2028\\u2029]|\\z)"  # a run is tried once, from its start
REPAINTED = "(?<![^\\n])[^\\n]*\\r"  # from a line's start to its last CR
TRAILER = "^Full result: [^\\n\\r\\u2028\\u2029]+$"
FOREIGN = f"(?m)^\\[(?!trim{E})[a-z][A-Za-z0-9_-]* (?:hook|digest):"
ENUM_NOUN = (
    "warn(?:ing)?s?|errors?|failures?|deprecat[A-Za-z0-9_]*|issues?|items?|entr(?:y|ies)|lines?|occurrences?|matches|results?|files?|"
    "records?|rows?|messages?|violations?|findings?|instances?|columns?|tests?"
)
ENUMERATION = (
    f"(?i){B}(?:every|each|all|complete|full|entire|exhaustive){E}[^.?!\\n]{{0,30}}?{B}(?:{ENUM_NOUN}){E}"
    f"|{B}(?:list|enumerate){E}[^.?!\\n]{{0,20}}?{B}(?:{ENUM_NOUN}){E}"
)
LOG_PATH = "(?i)\\.log(?:\\.[0-9]+)?$|[\\\\/]logs?[\\\\/][^\\\\/]+\\.(?:log|txt|out)$"
GENERATED_PATH = (
    "(?i)(?:^|[\\\\/])(?:package-lock\\.json|yarn\\.lock|pnpm-lock\\.yaml|npm-shrinkwrap\\.json|cargo\\.lock|poetry\\.lock|"
    "gemfile\\.lock|composer\\.lock|go\\.sum|uv\\.lock|flake\\.lock)$|\\.(?:min\\.(?:js|css)|bundle\\.js|map)$"
    "|(?:^|[\\\\/])(?:node_modules|dist|\\.next|__pycache__)[\\\\/]"
)
HOST_CUT = f"(?i){B}output (?:was )?truncated{E}|full output saved"
HOST_CUT_MARK = "(?i)\\[(?:Truncated:|Full output saved to )"
BLOCKER = f"(?i){B}(?:blocked|cannot proceed|needs? user|decision needed|fatal|error|failed|failure|final result){E}"
QUOTED = "`([^`\\n]{3,80})`|\"([^\"\\n]{3,80})\"|'([^'\\n]{3,80})'"
TIME_STAMP = f"{B}[0-9]{{4}}-[0-9][0-9]-[0-9][0-9][T ][0-9:.+-]+Z?{E}"
CJK = "[\\u3000-\\u9fff\\uac00-\\ud7af]"
#: Census: the first category that a signal line matches counts it.
CENSUS = (
    ("error", "errors", f"(?i)(?:Error|Exception){E}|{B}err(?:or)?s?{E}|{B}panic{E}|{B}traceback{E}|{B}fatal{E}"),
    ("failure", "failures", f"(?i){B}fail(?:s|ed|ing|ure|ures)?{E}|^[{WS}]*[✗✘×✖]|{B}not ok{E}"),
    ("critical", "criticals", f"(?i){B}critical{E}"),
    ("warning", "warnings", f"(?i)Warning{E}|{B}warn(?:ing)?s?{E}"),
    ("deprecation", "deprecations", f"(?i){B}deprecated{E}"),
)
LEVEL_KEYS = ("level", "severity", "lvl", "loglevel", "log.level")
KEEP_LEVEL = "(?i)^(?:err(?:or)?|fatal|crit(?:ical)?|warn(?:ing)?|alert|emerg(?:ency)?)$"
SEVERITIES = ("critical", "high", "moderate", "low", "info")
#: Reading order of punctuation before digits and letters, for package names.
COLLATION = "_-,;:!?.'\"()[]{}@*/\\&#%`^+<=>|~$"


def duck(pattern: str) -> str:
    """A pattern for an engine without look-around: word edges as \\b, white space as \\s; quotes doubled for SQL."""
    out = pattern.replace(f"(?!trim{E})", "").replace(B, "\\b").replace(E, "\\b").replace(f"[^{WS}]", "\\S").replace(f"[{WS}]", "\\s")
    return out.replace("'", "''")
