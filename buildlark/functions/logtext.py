"""Column functions that read a log line: level, service, time stamp, masking, tokens.

Everything is a built-in Spark expression, so a scan plus any number of these stays in one
code-generated stage. Patterns carry ``(?U)`` because ``\\w``, ``\\d`` and ``\\b`` are meant
in their Unicode sense.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Word lists, patterns and constants that define the results.
# ---------------------------------------------------------------------------
WILDCARD = "<*>"

LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "FATAL", "CRITICAL", "UNKNOWN")

SEVERITY = {
    "UNKNOWN": 0,
    "DEBUG": 1,
    "INFO": 2,
    "WARNING": 3,
    "ERROR": 4,
    "FATAL": 5,
    "CRITICAL": 5,
}

LEVEL_PATTERN = r"\b(DEBUG|INFO|WARNING|WARN|ERROR|ERR|FATAL|CRITICAL|CRIT|PANIC|EXCEPTION|TIMEOUT)\b"

LEVEL_ALIASES = {
    "WARN": "WARNING",
    "ERR": "ERROR",
    "CRIT": "CRITICAL",
    "PANIC": "ERROR",
    "EXCEPTION": "ERROR",
    "TIMEOUT": "ERROR",
}

SERVICE_PATTERN = r"\[([A-Za-z][\w\-\.]{1,63})\]"

MASK_PATTERNS = (
    r"\[[A-Za-z][\w\-\.]{1,63}\]",
    r"\b\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?\b",
    r"\b[0-9a-fA-F]{8,}\b",
    r"\b0x[0-9a-fA-F]+\b",
    r"\bv?\d+(?:\.\d+){1,3}(?:[\-\w]+)?\b",
    r"\b\d+(?:\.\d+)?(?:ms|s|m|h|MB|KB|GB|%)\b",
    r"\b\d+\b",
)

ISO_STAMP = r"\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[\.,]\d+)?(?:Z|[+\-]\d{2}:?\d{2})?)\b"
SYSLOG_STAMP = r"\b([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\b"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

ERROR_PATTERNS = (
    "error", "fatal", "critical", "exception",
    "failed", "timeout", "crash", "panic",
    "outofmemory", "stackoverflow", "nullpointer",
    "connection.*refused", "permission denied",
    "not.*found", "disk.*full", "unavailable",
)

TFIDF_MARKERS = (
    (r"\d{1,3}(?:\.\d{1,3}){3}", "<ip>"),
    (r"0x[0-9a-f]+", "<hex>"),
    (r"\b\d+\b", "<num>"),
)
TFIDF_TOKEN = r"[a-z]+(?:_[a-z]+)*|<ip>|<hex>|<num>"
TERM_PATTERN = r"\b\w\w+\b"

SEQUENCE_MARKERS = (
    (r"\b\d{1,3}(\.\d{1,3}){3}\b", "<ip>"),
    (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"\b\d+\.?\d*\b", "<num>"),
)
SEQUENCE_TOKEN = r"[a-z<>]+"

NUMERIC_FEATURES = ("level_severity", "msg_length", "num_params", "has_timestamp")
# ---------------------------------------------------------------------------

# White space and line breaks as Python's str methods see them; Java's \s and \R lack \x1c-\x1f.
_SPACE = r"[\s\x1c-\x1f]"
_LINE_BREAK = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\u2028\u2029]"
# Characters that count as digits: decimal digits, superscripts, subscripts, enclosed digits.
_DIGIT = (
    r"[\p{Nd}\u00b2\u00b3\u00b9\u2070\u2074-\u2079\u2080-\u2089"
    r"\u2460-\u2468\u2474-\u247c\u2488-\u2490\u24ea\u24f5-\u24fd\u24ff\u2776-\u277e\u2780-\u2788\u278a-\u2792]"
)


def _uni(pattern: str) -> str:
    return "(?U)" + pattern


def strip(text: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.regexp_replace(text, _uni(f"^{_SPACE}+|{_SPACE}+$"), "")


def is_blank(text: Column) -> Column:
    return ~text.rlike(_uni(f"[^{_SPACE[1:-1]}]"))


def split_lines(blob: Column) -> Column:
    return F.split(blob, _LINE_BREAK)


def content_lines(blob: Column) -> Column:
    """The non-blank lines of a blob; the stripped blob alone where every line is blank."""
    kept = F.filter(split_lines(blob), lambda line: ~is_blank(line))
    return F.when(is_blank(blob), F.array(strip(blob))).otherwise(kept)


def first_line(blob: Column) -> Column:
    """The first non-blank line, the stripped blob if there is none, NULL for an empty blob."""
    found = F.get(content_lines(blob), F.lit(0))
    return F.when(F.length(blob) > 0, found)


def level(line: Column) -> Column:
    """The first level keyword of a line, abbreviations normalised; UNKNOWN without one."""
    word = F.upper(F.regexp_extract(line, "(?iU)" + LEVEL_PATTERN, 1))
    out = F.when(word == "", F.lit("UNKNOWN"))
    for short, full in LEVEL_ALIASES.items():
        out = out.when(word == short, F.lit(full))
    known = out.when(word.isin(*LOG_LEVELS), word).otherwise(F.lit("UNKNOWN"))
    return F.coalesce(known, F.lit("UNKNOWN"))


def service(line: Column) -> Column:
    """The name in the first ``[name]``, NULL without one."""
    return F.nullif(F.regexp_extract(line, _uni(SERVICE_PATTERN), 1), F.lit(""))


def severity(level_col: Column) -> Column:
    pairs = [F.lit(x) for kv in SEVERITY.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[level_col], F.lit(0))


def _iso_time(line: Column) -> Column:
    token = F.regexp_extract(line, _uni(ISO_STAMP), 1)
    frac = r"(\.\d{1,6})?"
    naive = token.rlike(rf"^\d{{4}}-\d\d-\d\d[T ]\d\d:\d\d:\d\d{frac}$")
    zoned = token.rlike(rf"^\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d{frac}(Z|[+-]\d\d:?\d\d)$")
    # A stamp without a zone is taken as UTC whatever the session's zone is.
    text = F.when(naive, F.concat(token, F.lit("Z"))).when(
        zoned, F.regexp_replace(token, r"([+-]\d\d):?(\d\d)$", "$1:$2")
    )
    return text.try_cast("timestamp")


def _syslog_time(line: Column, year: int) -> Column:
    token = F.regexp_extract(line, _uni(SYSLOG_STAMP), 1)
    parts = F.split(token, r"(?U)\s+")
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.get(parts, F.lit(0)))
    text = F.when(
        month > 0,
        F.format_string(
            "%04d-%02d-%s %sZ",
            F.lit(year),
            month.cast("int"),
            F.lpad(F.get(parts, F.lit(1)), 2, "0"),
            F.get(parts, F.lit(2)),
        ),
    )
    return text.try_cast("timestamp")


def timestamp(line: Column, syslog_year: int = 1900) -> Column:
    """The first ISO-8601 or syslog stamp of a line; NULL where no known format fits."""
    return F.coalesce(_iso_time(line), _syslog_time(line, syslog_year))


def without_timestamp(line: Column) -> Column:
    """The line without its first ISO or syslog stamp."""
    iso = F.regexp_replace(line, _uni(rf"^(.*?){ISO_STAMP}\s*"), "$1")
    return F.when(line.rlike(_uni(ISO_STAMP)), iso).otherwise(
        F.regexp_replace(line, _uni(rf"^(.*?){SYSLOG_STAMP}\s*"), "$1")
    )


def mask(line: Column) -> Column:
    """Replace service, address, hash, version, quantity and number by the wildcard, in order."""
    out = line
    for pattern in MASK_PATTERNS:
        out = F.regexp_replace(out, _uni(pattern), WILDCARD)
    return out


def tokens(line: Column) -> Column:
    return F.filter(F.split(line, _uni(f"{_SPACE}+")), lambda t: t != "")


def has_digit(token: Column) -> Column:
    return token.rlike(_DIGIT)


def branch_key(token: Column) -> Column:
    return F.when(has_digit(token), F.lit(WILDCARD)).otherwise(token)


def match_count(template: Column, toks: Column) -> Column:
    """Positions where a template holds the same literal token."""
    hit = F.zip_with(
        template, toks, lambda t, s: F.when((t == s) & (t != WILDCARD), 1).otherwise(0)
    )
    return F.aggregate(hit, F.lit(0), lambda acc, x: acc + x)


def similarity(template: Column, toks: Column) -> Column:
    return F.when(
        F.size(template) == F.size(toks),
        match_count(template, toks) / F.size(toks).cast("double"),
    ).otherwise(F.lit(-1.0))


def wildcard_count(template: Column) -> Column:
    return F.size(F.filter(template, lambda t: t == WILDCARD))


def generalise(template: Column, toks: Column) -> Column:
    """The template with a wildcard wherever the tokens differ."""
    return F.zip_with(template, toks, lambda t, s: F.when(t == s, t).otherwise(F.lit(WILDCARD)))


def parameters(template: Column, toks: Column) -> Column:
    """Literal tokens that fall on wildcard positions; none where the lengths differ."""
    at_wildcard = F.zip_with(
        template, toks, lambda t, s: F.when((t == WILDCARD) & (s != WILDCARD), s)
    )
    return F.when(
        F.size(template) == F.size(toks), F.filter(at_wildcard, lambda s: s.isNotNull())
    ).otherwise(F.array().cast("array<string>"))


def event_id(number: Column) -> Column:
    return F.format_string("E%05d", number.cast("long"))


def numeric_features(raw: Column, level_col: Column, params: Column, ts: Column) -> dict[str, Column]:
    """The four numeric features of a line, each scaled to 0..1."""
    return {
        "level_severity": severity(level_col) / F.lit(5.0),
        "msg_length": F.least(F.length(raw), F.lit(500)) / F.lit(500.0),
        "num_params": F.least(F.size(params), F.lit(20)) / F.lit(20.0),
        "has_timestamp": F.when(ts.isNotNull(), F.lit(1.0)).otherwise(F.lit(0.0)),
    }


def _with_markers(text: Column, markers) -> Column:
    out = F.lower(text)
    for pattern, marker in markers:
        out = F.regexp_replace(out, _uni(pattern), marker)
    return out


def tfidf_text(text: Column) -> Column:
    """Lower-case text with address, hex and number markers and only word tokens kept."""
    found = F.regexp_extract_all(
        _with_markers(text, TFIDF_MARKERS), F.lit(TFIDF_TOKEN), F.lit(0)
    )
    return F.array_join(found, " ")


def sequence_tokens(line: Column) -> Column:
    return F.regexp_extract_all(
        _with_markers(line, SEQUENCE_MARKERS), F.lit(SEQUENCE_TOKEN), F.lit(0)
    )


def folded(text: Column) -> Column:
    """Text in lower case, with the four letters that fold to an ASCII letter folded too."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.lower(F.translate(text, "İıſK", "iisk")))


def error_matches(low: Column) -> Column:
    """How often the error patterns occur in the whole text, all patterns added up.

    ``low`` is a column holding ``folded`` text. A pattern is counted only where its (last) word
    is in the text at all, which a plain byte search tells far more cheaply.
    """
    total = F.lit(0)
    for pattern in ERROR_PATTERNS:
        word = pattern.split(".*")[-1]
        n = F.when(low.contains(word), F.regexp_count(low, F.lit(f"(?d){pattern}"))).otherwise(0)
        total = total + n
    return total


def count_error_matches(df: DataFrame, text: str, out: str = "n_matches") -> DataFrame:
    """Add the error match count of a text column; the folded text is computed once per row."""
    low = df.withColumn("_low", folded(F.coalesce(text, F.lit(""))))
    return low.withColumn(out, error_matches(F.col("_low"))).drop("_low")


def words(text: Column) -> Column:
    """Word tokens of at least two characters."""
    return F.regexp_extract_all(text, F.lit(_uni(TERM_PATTERN)), F.lit(0))


def unigrams_and_bigrams(word_array: Column) -> Column:
    """All words followed by all pairs of neighbours, with repeats. Pass a column, not a formula."""
    pairs = F.zip_with(
        word_array,
        F.slice(word_array, F.lit(2), F.greatest(F.size(word_array), F.lit(1))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    # The last word has no neighbour: its pair is NULL.
    return F.concat(word_array, F.array_compact(pairs))


def head(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def slug(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit(" "), F.lit("_"))


def spaced(text: Column) -> Column:
    return F.replace(text, F.lit("-"), F.lit(" "))
