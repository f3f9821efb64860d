"""Integrity rules of the tables as audits: one row per broken rule and key or rule and count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborwatch.plans.skew import buckets, key_counts
from harborwatch.schemas import FOREIGN_KEYS, LENGTH_RULES, UNIQUE_RULES


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _measured(tables: dict[str, DataFrame], wanted: list[tuple[str, str]]) -> dict[tuple[str, str], tuple[int, int]]:
    """Rows and about how many distinct keys there are, by table and key (columns joined by commas); one scan per table."""
    parts = []
    for name in dict.fromkeys(t for t, _ in wanted):
        lists = list(dict.fromkeys(keys for t, keys in wanted if t == name))
        found = tables[name].agg(
            F.count("*").alias("rows"), *[F.hll_sketch_agg(F.xxhash64(*k.split(","))).alias(f"s{i}") for i, k in enumerate(lists)]
        )
        pairs = [F.struct(F.lit(k).alias("keys"), F.hll_sketch_estimate(f"s{i}").alias("distinct")) for i, k in enumerate(lists)]
        parts.append(found.select(F.lit(name).alias("table"), "rows", F.explode(F.array(*pairs)).alias("k")))
    rows = _union(parts).select("table", "k.keys", "rows", "k.distinct").collect() if parts else []  # one row per rule
    return {(r["table"], r["keys"]): (r["rows"], r["distinct"]) for r in rows}


def _tasks(rows: int, distinct: int) -> int:
    """Few keys are counted where they are read, whatever the number of rows."""
    return buckets(rows) if buckets(distinct) > 1 else 1


def duplicate_keys(df: DataFrame, keys: list[str], rule: str, nulls_distinct: bool = False, tasks: int = 1) -> DataFrame:
    """Keys held by more than one row: ``(rule, key, n)``; ``tasks`` as in :func:`key_counts`."""
    rows = df.dropna(subset=keys) if nulls_distinct else df
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in keys])
    return key_counts(rows, keys, tasks).filter(F.col("n") > 1).select(F.lit(rule).alias("rule"), text.alias("key"), "n")


def unique_violations(tables: dict[str, DataFrame]) -> DataFrame:
    rules = [(t, keys, distinct) for t, keys, distinct in UNIQUE_RULES if t in tables]
    size = _measured(tables, [(t, ",".join(keys)) for t, keys, _ in rules])
    return _union([
        duplicate_keys(tables[t], keys, f"{t}({','.join(keys)})", distinct, _tasks(*size[t, ",".join(keys)]))
        for t, keys, distinct in rules
    ])


def orphans(
    child: DataFrame, fk: str, parent: DataFrame, pk: str, rule: str, child_tasks: int = 1, parent_tasks: int = 1
) -> DataFrame:
    """Key values without a parent: ``(rule, key, n)``. Keys are counted before the join, so none is hot.

    ``child_tasks`` as in :func:`key_counts`; counts and parents meet in as many tasks as the longer side needs.
    """
    keys, tasks = child.filter(F.col(fk).isNotNull()).select(F.col(fk).alias("__k")), max(child_tasks, parent_tasks)
    counts, parents = key_counts(keys, ["__k"], tasks if child_tasks > 1 else 1), parent.select(F.col(pk).alias("__k"))
    if tasks > 1:
        counts, parents = counts.repartition(tasks, "__k"), parents.repartition(tasks, "__k")
    return counts.join(parents, "__k", "left_anti").select(
        F.lit(rule).alias("rule"), F.col("__k").cast("string").alias("key"), "n"
    )


def orphan_rows(tables: dict[str, DataFrame]) -> DataFrame:
    rules = [(c, fk, p, pk) for c, fk, p, pk, _ in FOREIGN_KEYS if c in tables and p in tables]
    size = _measured(tables, [pair for c, fk, p, pk in rules for pair in ((c, fk), (p, pk))])
    return _union([
        orphans(tables[c], fk, tables[p], pk, f"{c}.{fk}", _tasks(*size[c, fk]), buckets(size[p, pk][0]))
        for c, fk, p, pk in rules
    ])


def length_counts(df: DataFrame, rules: list[tuple[str, int | None, bool]], table: str) -> DataFrame:
    """``(rule, key, n)`` with the rows over a length or null where required; one scan per table."""
    checks: list[tuple[str, Column]] = []
    for column, limit, required in rules:
        if limit is not None:
            checks.append((f"{table}.{column}:length", F.length(column) > limit))
        if required:
            checks.append((f"{table}.{column}:null", F.col(column).isNull()))
    sums = df.agg(*[F.count_if(test).alias(f"c{i}") for i, (_, test) in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"c{i}").alias("n")) for i, (rule, _) in enumerate(checks)])
    return sums.select(F.explode(rows).alias("r")).select("r.rule", F.lit("").alias("key"), "r.n").filter(F.col("n") > 0)


def length_violations(tables: dict[str, DataFrame]) -> DataFrame:
    parts = []
    for name, df in tables.items():
        rules = [(c, n, r) for t, c, n, r in LENGTH_RULES if t == name and c in df.columns]
        if rules:
            parts.append(length_counts(df, rules, name))
    return _union(parts)
