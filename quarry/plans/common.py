"""Registration of queries with their SQL, and SQL fragments used by several of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.functions import text as T

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; ``sql`` is what an SQL engine would run on the same tables."""

    def add(f: Query) -> Query:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def quoted(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower(coalesce({text}, '')), '{T.TOKEN}'), lambda x: x NOT IN ({quoted(T.TOKEN_STOP)}))"


def bucket_sql(token: str, dim: int) -> str:
    return f"(('0x' || substr(sha256({token}), 1, 8))::BIGINT % {dim})"


def lines_sql(text: str) -> str:
    raw = f"string_split_regex(coalesce({text}, ''), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')"
    return f"(CASE WHEN {raw}[-1] = '' THEN {raw}[:-2] ELSE {raw} END)"


def collapse_sql(text: str) -> str:
    return f"trim(regexp_replace(coalesce({text}, ''), '\\s+', ' ', 'g'))"


def cut_sql(text: str, n: int) -> str:
    return f"(CASE WHEN length({text}) <= {n} THEN {text} ELSE substr({text}, 1, {n - 1}) || '…' END)"


def clip_sql(text: str, n: int = T.SNIPPET) -> str:
    t = collapse_sql(text)
    return f"(CASE WHEN length({t}) <= {n} THEN {t} ELSE rtrim(substr({t}, 1, {n - 1})) || '…' END)"


def keywords_sql(text: str) -> str:
    return f"list_filter(regexp_extract_all(coalesce({text}, ''), '{T.KEYWORD}'), lambda x: lower(x) NOT IN ({quoted(T.KEYWORD_STOP)}))"


