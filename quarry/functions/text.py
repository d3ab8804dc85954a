"""Scalar text functions as column expressions: no Python runs on the executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that token streams and keyword lists leave out.
TOKEN_STOP = ("the", "a", "an", "of", "to", "and", "or", "in", "on", "for", "is", "it", "as", "at", "by", "be")
KEYWORD_STOP = ("this", "that", "with", "from", "into", "return", "none", "true", "false", "self", "print", "the", "and", "for", "are")

# Patterns.
TOKEN = "[a-z0-9_]{2,}"
KEYWORD = "[A-Za-z][A-Za-z0-9_.-]{2,}"
HEADING = r"(?m)^#{1,6}\s+(.+)$"
FIRST_HEADING = r"(?m)^#\s+(.+)$"
IMPORT = r"(?m)^(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))"
FUNCTION = r"(?m)^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"
CLASS = r"(?m)^\s*class\s+([A-Za-z_]\w*)"
EXPORT = r"(?:export\s+)?(?:async\s+)?(?:const|function|class|let|var)\s+([A-Za-z_]\w*)"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

DENSE_DIM, SPARSE_DIM = 1024, 250_002
SNIPPET = 180


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: str | Column) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*TOKEN_STOP))


def token_count(text: str | Column) -> Column:
    return F.size(tokens(text))


def token_bucket(token: str | Column, dim: int) -> Column:
    """First 8 hex digits of the SHA-256 as a number, modulo ``dim``."""
    return (F.conv(F.substring(F.sha2(col(token), 256), 1, 8), 16, 10).cast("long") % dim).cast("long")


def lines(text: str | Column) -> Column:
    """Lines at every Unicode line boundary; a boundary at the end opens no further line."""
    # The last boundary is taken off beforehand, so that a text is split once.
    t = F.coalesce(col(text), F.lit(""))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(t, rf"(?:{LINE_END})\z", ""), LINE_END, -1))


def line_count(text: str | Column) -> Column:
    return F.greatest(F.size(lines(text)), F.lit(1))


def collapse(text: str | Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"(?U)\s+", " "))


def cut_off(text: str | Column, n: int) -> Column:
    """At most ``n`` characters; a longer text ends in an ellipsis."""
    t = col(text)
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.substring(t, 1, n - 1), F.lit("…")))


def clip(text: str | Column, n: int = SNIPPET, collapsed: bool = True) -> Column:
    """White space collapsed, cut to ``n`` characters with an ellipsis."""
    t = col(text)
    if collapsed:
        # ``n`` + 1 visible characters decide the result, so a long text is read that far.
        t = collapse(F.regexp_extract(F.coalesce(t, F.lit("")), rf"(?U)\A\s*+(?:\S\s*+){{0,{n + 1}}}+", 0))
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, n - 1)), F.lit("…")))


def format_location(path, page, line_start, line_end) -> Column:
    path, page, a, b = map(col, (path, page, line_start, line_end))
    base = F.coalesce(path, F.lit(""))
    return (
        F.when(page.isNotNull(), F.concat(base, F.lit(" page "), page.cast("string")))
        .when(a.isNotNull() & b.isNotNull(), F.concat(base, F.lit(" lines "), a.cast("string"), F.lit("-"), b.cast("string")))
        .otherwise(base)
    )


def unit_id(path, page, line_start, line_end, chunk=None) -> Column:
    path, page, a, b = map(col, (path, page, line_start, line_end))
    own = F.when(page.isNotNull(), F.concat(path, F.lit(":page:"), page.cast("string"))).when(
        a.isNotNull() & b.isNotNull(), F.concat(path, F.lit(":lines:"), a.cast("string"), F.lit("-"), b.cast("string"))
    ).otherwise(path)
    return own if chunk is None else F.concat_ws(":", own, col(chunk).cast("string"))


def point_key(material, unit, version: str = "v1") -> Column:
    """A stable key of (material, unit, version)."""
    return F.sha2(F.concat_ws(":", col(material).cast("string"), col(unit).cast("string"), F.lit(version)), 256)


def headings(text: str | Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(HEADING), F.lit(1)), lambda v: F.trim(v))


def title(text: str | Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(col(text), FIRST_HEADING, 1)), F.lit(""))


def imports(text: str | Column) -> Column:
    """Top-level package of every import statement, in order."""
    whole = F.regexp_extract_all(col(text), F.lit(IMPORT), F.lit(0))
    return F.transform(whole, lambda m: F.regexp_extract(m, r"^(?:from|import)\s+([\w]*)", 1))


def plain_keywords(text: str | Column) -> Column:
    """Words of three or more characters outside the stop list, in order."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(KEYWORD), F.lit(0))
    return F.filter(found, lambda w: ~F.lower(w).isin(*KEYWORD_STOP))


def keywords(text: str | Column) -> Column:
    """Headings, then words; not yet unique."""
    return F.concat(headings(text), plain_keywords(text))


def unique(items: str | Column, limit: int) -> Column:
    """Trimmed, case-insensitively distinct items in first-seen order with their first spelling, cut to ``limit``.

    ``array_distinct`` keeps first places; the place of each lower-cased item picks its spelling.
    """
    own = F.filter(F.transform(col(items), lambda v: F.trim(v)), lambda x: x != "")
    low = F.transform(own, F.lower)
    return F.transform(F.slice(F.array_distinct(low), 1, limit), lambda k: F.element_at(own, F.array_position(low, k).cast("int")))


def requirement_name(spec: str | Column) -> Column:
    return F.trim(F.regexp_extract(col(spec), r"^[^<>=!~\[; ]*", 0))


def header_fields(text: str | Column, key: str) -> Column:
    return F.transform(F.regexp_extract_all(col(text), F.lit(rf"(?m)^{key}:\s*(.+)$"), F.lit(1)), lambda v: F.trim(v))


def clamp_relevance(value: str | Column, fallback: float) -> Column:
    return F.least(F.greatest(F.coalesce(col(value).try_cast("double"), F.lit(fallback)), F.lit(0.0)), F.lit(1.0))


def unsafe_path(path: str | Column) -> Column:
    """NUL, absolute or climbing path."""
    p = F.replace(col(path), F.lit("\\"), F.lit("/"))
    return p.contains("\x00") | p.startswith("/") | F.array_contains(F.split(p, "/"), "..")


def compact_list(items: str | Column) -> Column:
    """All items if there are at most four, else the first and the last."""
    c = col(items)
    return F.when(F.size(c) <= 4, F.array_join(c, ", ")).otherwise(F.concat(c[0], F.lit(" … "), F.element_at(c, -1)))


def file_name(path: str | Column) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def suffix(path: str | Column) -> Column:
    """Last suffix of the file name with its dot, lower-cased; empty for none or for a leading dot only."""
    return F.regexp_extract(F.lower(file_name(path)), r"^.+(\.[^.]+)$", 1)


def stem(path: str | Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


# The material types.
MATERIAL_TYPES = ("document", "project", "dataset", "code", "image", "presentation", "spreadsheet", "configuration", "unknown")


def normalized_type(value: str | Column) -> Column:
    """Trimmed and lower-cased, null if blank."""
    return F.nullif(F.lower(F.trim(col(value))), F.lit(""))


def checked_type(value: str | Column) -> Column:
    """Like :func:`normalized_type`; a type that does not exist ends the query with an error."""
    kind = normalized_type(value)
    return F.when(kind.isNull() | kind.isin(*MATERIAL_TYPES), kind).otherwise(F.raise_error(F.concat(F.lit("unknown material_type: "), col(value))).cast("string"))


def run_key(material, version) -> Column:
    return F.concat_ws(":", col(material).cast("string"), col(version).cast("string"))
