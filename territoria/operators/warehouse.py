"""Star-schema layer: cleaned tables, calendar dimension, fact table and its reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from territoria.functions.text import safe_date, safe_double
from territoria.operators.ranking import surrogate_key


def clean_clients(df: DataFrame, key: str, city: str, date: str) -> DataFrame:
    """Bad keys dropped, bad dates null, city capitalised."""
    return df.withColumn(key, F.col(key).try_cast("bigint")).where(F.col(key).isNotNull()).withColumn(
        city, F.initcap(city)).withColumn(date, safe_date(date, "yyyy-MM-dd"))


def clean_products(df: DataFrame, key: str, category: str, price: str, default: str = "Non classe") -> DataFrame:
    return df.withColumn(key, F.col(key).try_cast("bigint")).where(F.col(key).isNotNull()).withColumn(
        category, F.coalesce(category, F.lit(default))).withColumn(price, safe_double(price))


def calendar(spark: SparkSession, start: str, end: str) -> DataFrame:
    return date_columns(spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("date")))


def calendar_of(df: DataFrame, ts: str) -> DataFrame:
    """Calendar spanning the data."""
    span = df.agg(F.min(ts).cast("date").alias("_a"), F.max(ts).cast("date").alias("_b"))
    return date_columns(span.select(F.explode(F.sequence("_a", "_b")).alias("date")))


def date_columns(days: DataFrame) -> DataFrame:
    d = F.col("date")
    return days.select(
        "date", F.year(d).alias("year"), F.concat(F.lit("T"), F.quarter(d).cast("string")).alias("quarter"),
        F.month(d).alias("month_no"), F.date_format(d, "MMMM").alias("month_name"), F.date_format(d, "EEEE").alias("weekday"),
        F.dayofweek(d).isin(1, 7).alias("is_weekend"))


def exclude(df: DataFrame, key: str, ids: Sequence[int]) -> DataFrame:
    return df.where(~F.col(key).isin(*ids))


def fact_sales(orders: DataFrame, products: DataFrame, product_key: str, order_key: str, tie: str | None = None,
               rest: Sequence[str] = ()) -> DataFrame:
    """Orders of known products with a dense surrogate key in order-key order."""
    kept = orders.join(products.select(product_key), product_key, "left_semi")
    return surrogate_key(kept, order_key, tie, "sale_id", rest)


def revenue_by(fact: DataFrame, dim: DataFrame, on: str, keys: Sequence[str], amount: str) -> DataFrame:
    """Count and revenue per group. The fact is summed per join key before the join, so hot keys collapse first."""
    part = fact.groupBy(on).agg(F.count(F.lit(1)).alias("_n"), F.sum(amount).alias("_a"))
    return part.join(dim, on, "inner").groupBy(*keys).agg(F.sum("_n").alias("n_sales"), F.round(F.sum("_a"), 2).alias("revenue"))


def orphan_counts(fact: DataFrame, dims: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(check, n): fact rows whose key is absent from each dimension, null keys included. Counted per distinct key."""
    out = None
    for name, (dim, key) in dims.items():
        part = (fact.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(dim.select(key).distinct(), key, "left_anti")
                .agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).select(F.lit(name).alias("check_name"), "n"))
        out = part if out is None else out.unionByName(part)
    return out
