"""Read-only SQL over views and databases."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

# Statements and words that may not run.
FORBIDDEN = (
    "ALTER", "CREATE", "DELETE", "DROP", "EXEC", "EXECUTE", "GRANT", "INSERT", "MERGE", "REVOKE", "TRUNCATE", "UPDATE",
)


#: Literals and quoted names, comments, or a single other character.
PARTS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/|.", re.DOTALL)


def check_read_only(sql: str) -> str:
    """The statement without comments, or an error unless it is one SELECT or WITH."""
    # Literals and quoted names stay as they are; what looks like a comment or an end in them is text.
    parts = [m.group(0) for m in PARTS.finditer(sql or "")]
    kept = "".join(" " if p.startswith(("--", "/*")) else p for p in parts)
    bare = "".join(" " if p.startswith(("--", "/*")) else " ''" if p[0] in "'\"`" else p for p in parts)
    statements = [part.strip() for part in bare.split(";") if part.strip()]
    if not statements:
        raise ValueError("the query is empty")
    if len(statements) > 1:
        raise ValueError("only one statement is allowed")
    statement = statements[0]
    whole = kept.strip().rstrip("; \t\r\n")
    if not re.match(r"\(*\s*(SELECT|WITH)\b", statement, flags=re.IGNORECASE):
        raise ValueError("only SELECT or WITH is allowed")
    blocked = sorted(set(re.findall(r"\b[A-Z_]+\b", statement.upper())) & set(FORBIDDEN))
    if blocked:
        raise ValueError(f"blocked words: {', '.join(blocked)}")
    return whole


def sql_readonly(spark: SparkSession, sql: str, limit: int | None = None) -> DataFrame:
    found = spark.sql(check_read_only(sql))
    return found.limit(limit) if limit else found


def jdbc_options(url: str, sql: str, *, user: str, password: str, driver: str | None = None, fetch_size: int = 10_000) -> dict[str, str]:
    """Options of a pushed-down, read-only JDBC query."""
    options = {"url": url, "query": check_read_only(sql), "user": user, "password": password, "fetchsize": str(fetch_size)}
    return {**options, "driver": driver} if driver else options


def read_jdbc(
    spark: SparkSession, url: str, sql: str, *, user: str, password: str, driver: str | None = None,
    fetch_size: int = 10_000, partition_column: str | None = None, lower: int = 0, upper: int = 0, partitions: int = 1,
) -> DataFrame:
    """A query pushed to the database; split on ``partition_column`` into parallel range reads."""
    options = jdbc_options(url, sql, user=user, password=password, driver=driver, fetch_size=fetch_size)
    if partition_column:
        statement = options.pop("query")
        options |= {
            "dbtable": f"({statement}) q", "partitionColumn": partition_column, "lowerBound": str(lower),
            "upperBound": str(upper), "numPartitions": str(partitions),
        }
    return spark.read.format("jdbc").options(**options).load()
