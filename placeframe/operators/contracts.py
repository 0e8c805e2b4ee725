"""Contracts of a set of tables, declared once and checked as issue rows (level, table, check, count).

Columns are held against the schema without reading a row. What a row alone can break costs one pass a table; unique keys
one aggregate each; references and counts across tables one join each, by their keys.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISSUE = "level string, table string, check string, count long"


@dataclass(frozen=True)
class Field:
    """A column; what is not stated is not asked. Null breaks `nullable` only. NaN is out of any range.

    among: the only values. text: not blank. keys: those a map must have, and no others.
    """

    name: str
    type: str | None = None
    nullable: bool = False
    least: float | None = None
    most: float | None = None
    among: tuple = ()
    text: bool = False
    keys: tuple[str, ...] = ()

    def rules(self) -> dict[str, Column]:
        """check -> what a bad row meets."""
        c = F.col(self.name)
        out = {}
        if not self.nullable:
            out[f"null:{self.name}"] = c.isNull()
        if self.least is not None:
            out[f"below:{self.name}"] = (c < F.lit(self.least)) | (c.cast("double") == float("nan"))
        if self.most is not None:
            out[f"above:{self.name}"] = c > F.lit(self.most)
        if self.among:
            out[f"unlisted:{self.name}"] = ~c.isin(*self.among)
        if self.text:
            out[f"blank:{self.name}"] = F.trim(c) == ""
        if self.keys:
            out[f"keys:{self.name}"] = F.array_sort(F.map_keys(c)) != F.array_sort(F.array(*[F.lit(k) for k in self.keys]))
        return out


@dataclass(frozen=True)
class Reference:
    """Each non-null key of `columns` stands in `to_columns` of table `to`; count: rows whose key doesn't."""

    columns: tuple[str, ...]
    to: str
    to_columns: tuple[str, ...]
    level: str = "error"


@dataclass(frozen=True)
class Count:
    """`column` holds how many rows of table `of` have the row's `key` in `of_key`; with `where` (SQL), of those that meet it."""

    column: str
    key: str
    of: str
    of_key: str
    where: str | None = None


@dataclass(frozen=True)
class Table:
    """fields: the columns. closed: others are an issue. unique: keys that no two rows share. derived: column -> SQL that
    it must equal, null-safe (a tier of people). rules: check -> level and SQL that a bad row meets. rows: least and most."""

    fields: tuple[Field, ...]
    closed: bool = True
    unique: tuple[tuple[str, ...], ...] = ()
    derived: Mapping[str, str] = field(default_factory=dict)
    rules: Mapping[str, tuple[str, str]] = field(default_factory=dict)
    references: tuple[Reference, ...] = ()
    counts: tuple[Count, ...] = ()
    rows: tuple[int | None, int | None] = (1, None)


def check(spark: SparkSession, tables: Mapping[str, DataFrame], contract: Mapping[str, Table]) -> DataFrame:
    """level, table, check, count: the issues of the tables; no row where all is well.

    A table or column that is missing is an issue, and no further check reads it.
    """
    told: list[tuple[str, str, str, int]] = []
    found: list[DataFrame] = []
    for name, table in contract.items():
        rows = tables.get(name)
        if rows is None:
            told.append(("error", name, "missing_table", 1))
            continue
        have = dict(rows.dtypes)
        told += [("error", name, f"missing:{f.name}", 1) for f in table.fields if f.name not in have]
        told += [("error", name, f"type:{f.name}", 1) for f in table.fields if f.type and have.get(f.name, f.type) != f.type]
        if table.closed:
            told += [("error", name, f"unknown:{c}", 1) for c in rows.columns if c not in {f.name for f in table.fields}]
        sound = {f.name for f in table.fields if have.get(f.name) and f.type in (None, have[f.name])}
        found.append(_row_issues(name, rows, table, sound))
        found += [_repeated(name, rows, key) for key in table.unique if sound.issuperset(key)]
        for r in table.references:
            if sound.issuperset(r.columns) and r.to in tables and set(r.to_columns) <= set(tables[r.to].columns):
                found.append(_unresolved(name, rows, r, tables[r.to]))
        for c in table.counts:
            if sound.issuperset((c.column, c.key)) and c.of in tables and c.of_key in tables[c.of].columns:
                found.append(_miscounted(name, rows, c, tables[c.of]))
    return reduce(DataFrame.unionByName, found, spark.createDataFrame(told, ISSUE))


def _row_issues(name: str, rows: DataFrame, table: Table, sound: set[str]) -> DataFrame:
    asked = [("error", check, bad) for f in table.fields if f.name in sound for check, bad in f.rules().items()]
    if sound.issuperset(f.name for f in table.fields):
        asked += [("error", f"derived:{c}", ~F.col(c).eqNullSafe(F.expr(value))) for c, value in table.derived.items()]
        asked += [(level, check, F.expr(bad)) for check, (level, bad) in table.rules.items()]
    least, most = table.rows
    n = F.count(F.lit(1))
    sums = [F.count_if(F.coalesce(bad, F.lit(False))) for _, _, bad in asked]
    asked += [("error", "rows", F.lit(True))]
    sums += [F.when((n < (least or 0)) | (n > F.lit(most) if most is not None else F.lit(False)), F.greatest(n, F.lit(1))).otherwise(0)]
    one = rows.agg(*[s.cast("long").alias(f"_{i}") for i, s in enumerate(sums)])
    each = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(name).alias("table"), F.lit(check).alias("check"), F.col(f"_{i}").alias("count")) for i, (level, check, _) in enumerate(asked)])
    return one.select(F.inline(each)).where("count > 0")


def _issue(level: str, name: str, check: str, count: DataFrame) -> DataFrame:
    return count.select(F.lit(level).alias("level"), F.lit(name).alias("table"), F.lit(check).alias("check"), F.col("count").cast("long").alias("count")).where("count > 0")


def _repeated(name: str, rows: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Rows beyond the first of each key."""
    n = rows.groupBy(*key).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.sum("n").alias("count"))
    return _issue("error", name, f"repeated:{','.join(key)}", n)


def _unresolved(name: str, rows: DataFrame, r: Reference, others: DataFrame) -> DataFrame:
    """Keys are counted first, so a hot key meets the other table as one row."""
    keys = rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in r.columns)).groupBy(*r.columns).agg(F.count(F.lit(1)).alias("n"))
    there = others.select(*[F.col(d).alias(c) for c, d in zip(r.columns, r.to_columns, strict=True)]).distinct()
    return _issue(r.level, name, f"unresolved:{','.join(r.columns)}", keys.join(there, list(r.columns), "left_anti").agg(F.sum("n").alias("count")))


def _miscounted(name: str, rows: DataFrame, c: Count, others: DataFrame) -> DataFrame:
    own = others if c.where is None else others.where(c.where)
    n = own.groupBy(F.col(c.of_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    both = rows.select(F.col(c.key).alias("_k"), F.col(c.column).alias("_v")).join(n, "_k", "left")
    return _issue("error", name, f"count:{c.column}", both.agg(F.count_if(~F.col("_v").eqNullSafe(F.coalesce("_n", F.lit(0)))).alias("count")))


def key_profile(rows: DataFrame, name: str, key: tuple[str, ...]) -> DataFrame:
    """table, key, rows, distinct, distinct_pct, repeated, nulls of a key that should be unique."""
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    per = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce(F.sum("_n"), F.lit(0))
    made = per.agg(n.alias("rows"), F.count_if(whole).alias("distinct"), F.coalesce(F.sum(F.when(whole, F.col("_n") - 1)), F.lit(0)).alias("repeated"), F.coalesce(F.sum(F.when(~whole, F.col("_n"))), F.lit(0)).alias("nulls"))
    share = F.round(F.lit(100.0) * F.col("distinct") / F.nullif("rows", F.lit(0)), 4)
    return made.select(F.lit(name).alias("table"), F.lit(",".join(key)).alias("key"), "rows", "distinct", share.alias("distinct_pct"), "repeated", "nulls")
