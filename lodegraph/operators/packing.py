"""Fitting ranked items into token budgets by folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Section, share of the limit. What a section leaves goes on to the next; constraints are never cut.
SECTIONS = (("constraints", 0.15), ("reusable", 0.25), ("architecture", 0.15), ("patterns", 0.10), ("decisions", 0.10), ("related_features", 0.10), ("memory", 0.10), ("tests", 0.05), ("dependencies", 0.0), ("docs", 0.0), ("unverified", 0.0))


def greedy(costs: Column, allowance: Column, never_cut: Column | None = None) -> Column:
    """struct(used, kept): items in order, each kept if it still fits; later smaller ones may. `kept` are positions."""
    free = never_cut if never_cut is not None else F.lit(False)
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("kept"), F.lit(0).alias("i"))

    def step(acc: Column, cost: Column) -> Column:
        fits = free | (acc["used"] + cost <= allowance)
        return F.struct(F.when(fits, acc["used"] + cost).otherwise(acc["used"]).cast("long").alias("used"), F.when(fits, F.concat(acc["kept"], F.array(acc["i"]))).otherwise(acc["kept"]).alias("kept"), (acc["i"] + 1).alias("i"))

    return F.aggregate(costs, start, step, lambda acc: F.struct(acc["used"].alias("used"), acc["kept"].alias("kept")))


def pack(items: DataFrame, key: str, limit: int) -> DataFrame:
    """key, section, used, kept of each section in order. items: key, section, pos, cost.

    One group per pack; a pack's items are few (each list before it is a top-k)."""
    grouped = items.groupBy(key, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cost"))), lambda x: x["cost"].cast("long")).alias("costs"))
    by_name = grouped.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("section", "costs"))).alias("by"))
    out, carry, rows = by_name, F.lit(0).cast("long"), []
    for name, share in SECTIONS:
        costs = F.coalesce(F.try_element_at("by", F.lit(name)), F.array().cast("array<bigint>"))
        allowance = F.lit(int(limit * share)) + carry
        out = out.withColumn(f"_{name}", greedy(costs, allowance, F.lit(name == "constraints"))).withColumn(f"c_{name}", F.greatest(F.lit(0), allowance - F.col(f"_{name}.used")).cast("long"))
        carry = F.col(f"c_{name}")
        rows.append(F.struct(F.lit(name).alias("section"), F.col(f"_{name}.used").alias("used"), F.col(f"_{name}.kept").alias("kept")))
    return out.select(key, F.explode(F.array(*rows)).alias("s")).select(key, "s.*")


def fit_response(rows: DataFrame, key: str, order: str, limit: int = 25_000) -> DataFrame:
    """The first rows of each key whose JSON together stays within `limit` characters."""
    from pyspark.sql import Window

    size = F.sum(F.length(F.to_json(F.struct(*rows.columns)))).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_size", size).where(F.col("_size") <= limit).drop("_size")
