"""Jobs from end to end, loads of marts into targets, and seeds."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.scalars import ladder, money, ratio
from tidemill.operators import quality, transforms
from tidemill.operators.history import scd2
from tidemill.plans.models import STRENGTH, Models
from tidemill.sources.versioned import VersionedTable


def order_facts(models: Models, target: VersionedTable, bad: quality.Quarantine, least: int = 1000, most: int = 48) -> None:
    """Lines pass rules, are made unique, looked up in the customer and product dimensions (those without a match go) and
    come down to days and customers, which are appended to the target unless it holds them."""
    rules = [
        quality.positive("quantity"), quality.not_null("customer_key", quality.CRITICAL), quality.Rule.sql("small_line", f"line_total <= {least}"),
        quality.Rule.sql("large_line", f"quantity >= {most}"), quality.Rule.sql("late_line", "order_date > date'2001-07-01'", severity=quality.WARNING),
    ]
    good, rejected = quality.split(models.star.fact_orders, rules, "t", "fact_orders", "order_facts")
    bad.write(rejected, "order_facts")
    if not bad.read(models.star.spark, "t", "fact_orders").where(F.col("_quarantine_severity") == quality.CRITICAL).isEmpty():
        raise quality.CriticalViolation("order_facts: a critical rule is violated")
    steps = [
        transforms.dedup(["order_key"], "order_date"),
        transforms.enrich(models.stg_customers, "customer_key", ["customer_id", "tier"], True),
        transforms.enrich(models.stg_products, "product_key", ["product_id", "category_name"], True),
    ]
    lines = transforms.chain(good.drop("_warnings"), steps).where("customer_id is not null and product_id is not null")
    days = lines.groupBy("date_key", "customer_key").agg(money(F.sum("line_total")).alias("revenue"), F.sum("quantity").alias("quantity"), F.count("*").alias("order_lines"))
    target.append_unseen(days, ["date_key", "customer_key"])


def customer_dimension(source: DataFrame, target: VersionedTable, tracked: list[str], as_of: dt.datetime, key: str = "customer_id") -> None:
    """Versions of the customers in a target: repeated rows of the source count once, a changed customer's open version is
    closed and a new one opened, all as one merge on key and start."""
    rows = source.dropDuplicates()
    old = target.read() if target.exists() else None
    new = scd2(old, rows, [key], tracked, as_of)
    if old is None:
        target.overwrite(new)
        return
    changed = new.exceptAll(old)
    target.upsert(changed, [key, "valid_from"])


def merge_daily(models: Models, target: VersionedTable, lookback_days: int = 0) -> None:
    """Days after the target's last one, and so many before it, replaced or added by key."""
    last = target.read().agg(F.max("date_key")).first()[0] if target.exists() else None
    target.upsert(models.sales_daily_since(last, lookback_days), ["date_key"])


def product_pairs(models: Models, least: int) -> DataFrame:
    """Pairs of products ordered together in ``least`` orders or more, with names and categories. Pairs are formed within
    an order from its set of products, so they grow with lines per order alone."""
    baskets = models.stg_orders.groupBy("order_id").agg(F.sort_array(F.collect_set("product_key")).alias("k"))
    each = baskets.select(F.explode(F.expr("flatten(transform(k, (x, i) -> transform(slice(k, i + 2, size(k)), y -> struct(x as product_a, y as product_b))))")).alias("p"))
    pairs = each.groupBy("p.product_a", "p.product_b").agg(F.count("*").alias("co_occurrence_count")).where(F.col("co_occurrence_count") >= least)
    orders = baskets.select(F.explode("k").alias("product_a")).groupBy("product_a").agg(F.count("*").alias("orders_a"))
    p = models.stg_products.select("product_key", "product_name", "category_name")
    named = lambda x: p.select(F.col("product_key").alias(f"product_{x}"), F.col("product_name").alias(f"name_{x}"), F.col("category_name").alias(f"category_{x}"))
    out = pairs.join(orders, "product_a").join(named("a"), "product_a").join(named("b"), "product_b").withColumn("confidence_a_to_b", ratio(F.col("co_occurrence_count"), F.col("orders_a")))
    return out.drop("orders_a").withColumns({"recommendation_strength": ladder(F.col("confidence_a_to_b"), STRENGTH, "Very Weak"), "cross_category": (F.col("category_a") != F.col("category_b")).cast("int")})


def seed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A delimited file with a header, read by a declared schema; a field that doesn't fit it is an error."""
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").csv(path)
