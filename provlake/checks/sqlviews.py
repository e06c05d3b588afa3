"""Named SQL views over the driver's tables.

Texts use the part of SQL that Spark and DuckDB share.  ``{name}`` refers to
another view or a driver table, ``@SHA(x@)`` stands for the SHA-256 function; :func:`spark_view` resolves it with DataFrames,
:func:`with_clause` with common table expressions.
"""

from __future__ import annotations

import re
from string import Formatter

from pyspark.sql import DataFrame, SparkSession

from provlake.sources.tables import read_table

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
VIEWS: dict[str, str] = {}


def register(name: str, sql: str) -> None:
    VIEWS[name] = sql.strip()


def deps(sql: str) -> list[str]:
    return sorted({f for _, f, _, _ in Formatter().parse(sql) if f})


def idiv(x: str, n: int) -> str:
    return f"CAST(FLOOR(({x}) / {n}) AS BIGINT)"


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return str(v)
    return "'" + str(v).replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def values(rows, cols: str) -> str:
    """An inline table as a FROM item."""
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({cols})"


def dim(rows, cols: str) -> str:
    return f"SELECT * FROM {values(rows, cols)}"


def pick(expr: str, options, else_null: bool = False) -> str:
    """CASE over a small integer expression."""
    arms = " ".join(f"WHEN {i} THEN {lit(o)}" for i, o in enumerate(options))
    return f"CASE {expr} {arms} END"


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in TABLES:
        return read_table(spark, f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name].replace("@SHA(", "SHA2(").replace("@)", ", 256)")
    return spark.sql(sql, **{d: spark_view(spark, sf_dir, d) for d in deps(sql)})


def with_clause(sql: str) -> str:
    """The statement with every view it needs placed before it, for DuckDB."""
    order: list[str] = []

    def visit(text: str) -> None:
        for d in deps(text):
            if d not in TABLES and d not in order:
                visit(VIEWS[d])
                if d not in order:
                    order.append(d)

    visit(sql)

    def plain(text: str) -> str:
        text = text.replace("@SHA(", "SHA256(").replace("@)", ")")
        return text.format(**{d: d for d in deps(text)})

    if not order:
        return plain(sql)
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n])})" for n in order)
    body = plain(sql)
    if re.match(r"\s*WITH\s", body, re.I):
        return f"WITH {ctes},\n" + re.sub(r"^\s*WITH\s", "", body, count=1, flags=re.I)
    return f"WITH {ctes}\n{body}"
