"""Executable data contracts: gates that raise, and tables of checks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def run_checks(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per row-wise check (name -> (category, condition)): failures and status.

    All checks are counted in one pass; a null condition fails.
    """
    counted = df.agg(F.count("*").alias("rows"), *[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, (_, c) in checks.items()])
    long = counted.unpivot("rows", list(checks), "check_id", "failures")
    category = F.create_map(*[F.lit(x) for n, (c, _) in checks.items() for x in (n, c)])
    return long.select("check_id", category[F.col("check_id")].alias("category"), "rows", "failures", (F.col("failures") == 0).alias("passed"))


def enforce(checks: DataFrame) -> None:
    """Raise with every failed check (a check table has a row per check)."""
    failed = [r.check_id for r in checks.where("NOT passed").select("check_id").collect()]
    if failed:
        raise ValueError(f"failed checks: {', '.join(sorted(failed))}")


def reconcile(totals: DataFrame, published: DataFrame, keys: list[str], value: str, tolerance: float = 0.0) -> DataFrame:
    """Each published total beside ours (null if we have none), and whether they agree."""
    ours = totals.select(*keys, F.col(value).alias("ours"))
    both = published.select(*keys, F.col(value).alias("published")).join(ours, keys, "left")
    return both.withColumn("agrees", F.coalesce(F.abs(F.col("ours") - F.col("published")) <= tolerance, F.lit(False)))


def gate_table(df: DataFrame, gates: dict[str, tuple[str, Column, Column]]) -> DataFrame:
    """Checks on the table as a whole (name -> (category, aggregate, condition on ``value``)): check_id, category, value, passed."""
    counted = df.agg(*[a.cast("double").alias(n) for n, (_, a, _) in gates.items()])
    long = counted.unpivot([], list(gates), "check_id", "value")
    category = F.create_map(*[F.lit(x) for n, (c, _, _) in gates.items() for x in (n, c)])
    passed = F.coalesce(*[F.when(F.col("check_id") == n, F.coalesce(test, F.lit(False))) for n, (_, _, test) in gates.items()])
    return long.select("check_id", category[F.col("check_id")].alias("category"), "value", passed.alias("passed"))


def completeness(df: DataFrame, by: list[str], expected: DataFrame) -> DataFrame:
    """Rows of each expected group (keys and ``expected``) and whether it has them all; groups without rows count 0."""
    have = df.groupBy(*by).agg(F.count("*").alias("rows"))
    out = expected.join(have, by, "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    return out.withColumn("complete", F.col("rows") == F.col("expected"))


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """The table; raises if it has no row."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def coverage(df: DataFrame, by: list[str], date: str, least: int) -> DataFrame:
    """Groups with fewer than ``least`` distinct days."""
    return df.groupBy(*by).agg(F.count_distinct(date).alias("days")).where(F.col("days") < least)


#: A check set: row-wise conditions and whole-table aggregates by table, and queries over several tables.
RowChecks = dict[str, dict[str, tuple[str, Column]]]
TotalChecks = dict[str, dict[str, tuple[str, Column, Callable[[Column], Column]]]]
CrossChecks = dict[str, tuple[str, Callable[[dict[str, DataFrame]], DataFrame]]]


def check_tables(tables: dict[str, DataFrame], rows: RowChecks | None = None, totals: TotalChecks | None = None, across: CrossChecks | None = None) -> DataFrame:
    """Every check of a declared set over several tables: check_id, category, table, value, passed, detail.

    ``rows`` (table -> id -> category, condition) count the rows that fail (a null condition fails); ``totals`` (table ->
    id -> category, aggregate, test of its value) judge a table as a whole: both in one scan a table.  ``across``
    (id -> category, query) returns offending rows of a query over the tables; ``detail`` shows one of them.
    """
    parts = []
    for name in sorted({*(rows or {}), *(totals or {})}):
        own, whole = (rows or {}).get(name, {}), (totals or {}).get(name, {})
        cells = [F.count_if(~F.coalesce(c, F.lit(False))).cast("double").alias(f"r_{i}") for i, (_, c) in own.items()] + [a.cast("double").alias(f"t_{i}") for i, (_, a, _) in whole.items()]
        listed = [F.struct(F.lit(i).alias("check_id"), F.lit(c).alias("category"), F.col(f"`r_{i}`").alias("value"), (F.col(f"`r_{i}`") == 0).alias("passed")) for i, (c, _) in own.items()]
        listed += [F.struct(F.lit(i).alias("check_id"), F.lit(c).alias("category"), F.col(f"`t_{i}`").alias("value"), F.coalesce(test(F.col(f"`t_{i}`")), F.lit(False)).alias("passed")) for i, (c, _, test) in whole.items()]
        counted = tables[name].agg(*cells).select(F.inline(F.array(*listed)))
        parts.append(counted.select("check_id", "category", F.lit(name).alias("table"), "value", "passed", F.lit(None).cast("string").alias("detail")))
    for i, (category, bad) in (across or {}).items():
        found = bad(tables)
        counted = found.agg(F.count("*").alias("n"), F.min(F.to_json(F.struct(*found.columns))).alias("detail"))
        parts.append(counted.select(F.lit(i).alias("check_id"), F.lit(category).alias("category"), F.lit("*").alias("table"), F.col("n").cast("double").alias("value"), (F.col("n") == 0).alias("passed"), "detail"))
    return reduce(DataFrame.unionByName, parts)


def enforce_all(checks: DataFrame) -> None:
    """Raise with every failed check of ``check_tables``, its value and an offending row."""
    failed = checks.where("NOT passed").orderBy("table", "check_id").collect()  # a row per check
    if failed:
        raise ValueError("; ".join(f"{r.table}: {r.check_id} ({r.value:g}{', ' + r.detail if r.detail else ''})" for r in failed))


def lacking(child: str, parent: str, on: dict[str, str]) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """A cross check: rows of a table whose key another table lacks (column -> the other's column)."""

    def bad(tables: dict[str, DataFrame]) -> DataFrame:
        keys = tables[parent].select(*[F.col(p).alias(c) for c, p in on.items()])
        return tables[child].select(*on).join(keys, list(on), "left_anti")

    return bad


def repeated(table: str, keys: list[str]) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """A cross check: keys that a table has more than once."""
    return lambda tables: duplicate_keys(tables[table], keys)


def differing(table: str, keys: list[str], columns: list[str], derive: Callable[[dict[str, DataFrame]], DataFrame], tolerance: float = 1e-9) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """A cross check: rows of a table that differ from an independent derivation (keys and columns), or that one side lacks."""

    def bad(tables: dict[str, DataFrame]) -> DataFrame:
        mine = tables[table].select(*keys, *columns, F.lit(True).alias("__a"))
        other = derive(tables).select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__b"))

        def same(c: str) -> Column:
            near = F.abs(F.col(c).cast("double") - F.col(f"__{c}").cast("double")) <= tolerance * F.greatest(F.lit(1.0), F.abs(F.col(f"__{c}").cast("double")))
            return F.col(c).eqNullSafe(F.col(f"__{c}")) | F.coalesce(near, F.lit(False))

        agree = reduce(lambda a, b: a & b, [same(c) for c in columns])
        both = mine.join(other, keys, "full")
        return both.where(F.col("__a").isNull() | F.col("__b").isNull() | ~agree).drop("__a", "__b")

    return bad
