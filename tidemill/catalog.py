"""All registered queries of the warehouse and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.config import Tenant
from tidemill.functions import scalars
from tidemill.operators import history, merge, quality, transforms, vault
from tidemill.plans import jobs, sql
from tidemill.plans.models import Models
from tidemill.plans.star import Star
from tidemill.sources import sinks, strategies
from tidemill.sources.versioned import VersionedTable
from tidemill.state import Cursor
from tidemill.storage import new_path

LOAD = "timestamp '2001-08-02 00:00:00'"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(statement: str):
    """Register a function as the query of its name, with its SQL."""

    def add(f):
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql.query(statement)
        return f

    return add


def _models(spark: SparkSession, folder: str) -> Models:
    return Models(Star(spark, folder))


def _model(name: str, attribute: str | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        got = getattr(_models(spark, folder), attribute or name)
        return got() if callable(got) else got

    _QUERIES[name], _SQL[name] = run, sql.model(attribute or name)


for _name in ("customer_metrics", "product_metrics", "sales_daily", "customer_enriched", "product_enriched", "monthly_financials",
              "customer_cohort", "customer_rfm", "product_affinity", "ltv_distribution", "ltv_distribution_scaled", "daily_summary", "weekly_ltv", "monthly_product", "vendor_performance"):
    _model(_name)
for _name, _source in (("stg_orders", "fact_orders"), ("stg_customers", "dim_customer"), ("stg_products", "dim_product"), ("stg_dates", "dim_date")):
    _QUERIES[_name] = lambda s, d, n=_name, t=_source: _models(s, d).audited(n, t)
    _SQL[_name] = sql.query(f"SELECT *, {LOAD} AS load_date, 'olap.{_source}' AS record_source FROM {_name}")
_QUERIES["orders_enriched"], _SQL["orders_enriched"] = lambda s, d: _models(s, d).orders_enriched, sql.model("enriched")


def _at(df: DataFrame) -> DataFrame:
    return df.withColumn("load_date", F.expr(LOAD).cast("timestamp_ntz"))


# ---- incremental loads ----


@query("SELECT * FROM sales_daily WHERE date_key > 20001231")
def sales_daily_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Days after the last day that the target holds."""
    return _models(spark, folder).sales_daily_since(20001231)


@query("SELECT * FROM sales_daily WHERE date_key > 20001201")
def sales_daily_lookback(spark: SparkSession, folder: str) -> DataFrame:
    return _models(spark, folder).sales_daily_since(20001231, lookback_days=30)


def _context(spark: SparkSession, df: DataFrame, last: str | None, **options) -> strategies.Context:
    cursor = Cursor("t", "t", "", last) if last else None
    return strategies.Context(spark, Tenant("t"), "t", options | {"frame": df}, cursor, dt.datetime(2001, 8, 2))


@query("SELECT * FROM events WHERE ts > timestamp '2024-01-15 00:00:00'")
def timestamp_delta(spark: SparkSession, folder: str) -> DataFrame:
    return strategies.timestamp(_context(spark, Star(spark, folder).table("events"), "2024-01-15T00:00:00", column="ts"))[0]


@query("SELECT * FROM events WHERE ts <= timestamp '2024-01-20 00:00:00' AND (ts > timestamp '2024-01-14 23:00:00' OR (ts = timestamp '2024-01-14 23:00:00' AND event_id > 5))")
def composite_delta(spark: SparkSession, folder: str) -> DataFrame:
    c = _context(spark, Star(spark, folder).table("events"), "x", column="ts", key="event_id", overlap_s=3600, upper=dt.datetime(2024, 1, 20))
    c.cursor.more = {"time": "2024-01-15T00:00:00", "key": 5}
    return strategies.composite(c)[0]


@query("SELECT *, cast(o_orderdate AS date) AS dt FROM orders WHERE cast(o_orderdate AS date) > date '2001-06-28' AND cast(o_orderdate AS date) < date '2001-08-02'")
def partition_delta(spark: SparkSession, folder: str) -> DataFrame:
    df = Star(spark, folder).table("orders").withColumn("dt", F.to_date("o_orderdate"))
    return strategies.partition(_context(spark, df, "2001-06-30", lookback_days=2))[0]


@query("SELECT * FROM region")
def full_reload(spark: SparkSession, folder: str) -> DataFrame:
    return strategies.full_reload(_context(spark, Star(spark, folder).table("region"), None))[0]


def _envelopes(spark: SparkSession, folder: str) -> DataFrame:
    """Events as change envelopes: sign-ups insert, errors delete, clicks and views update a user's value."""
    e = Star(spark, folder).table("events")
    op = F.when(F.col("event_type") == "signup", "c").when(F.col("event_type") == "error", "d").when(F.col("event_type") == "purchase", "r").otherwise("u")
    row = F.struct(F.col("user_id"), F.col("value"))
    none = F.lit(None).cast("struct<user_id:bigint,value:double>")
    lsn = F.when(F.col("event_id") % 97 != 0, F.col("event_id"))
    return e.select(F.struct(F.when(op == "c", none).otherwise(row).alias("before"), F.when(op == "d", none).otherwise(row).alias("after"), F.struct(lsn.alias("lsn")).alias("source"), op.alias("op"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms")).alias("payload"))


_CHANGES = "SELECT event_id AS _lsn, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' WHEN 'purchase' THEN 'r' ELSE 'update' END AS _change_type, user_id, value FROM events WHERE event_id % 97 <> 0"


@query(f"SELECT * FROM ({_CHANGES}) WHERE _lsn > 1000")
def cdc_normalize(spark: SparkSession, folder: str) -> DataFrame:
    df = strategies.cdc(_context(spark, _envelopes(spark, folder), "1000"))[0]
    return df.select("_lsn", "_change_type", "data.user_id", "data.value")


@query(f"SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _lsn DESC) AS k FROM ({_CHANGES})) WHERE k = 1 AND _change_type <> 'delete'")
def cdc_apply(spark: SparkSession, folder: str) -> DataFrame:
    df = strategies.debezium(_envelopes(spark, folder)).select("_lsn", "_change_type", "data.user_id", "data.value")
    return strategies.apply_changes(None, df, ["user_id"])


@query("SELECT event_type AS _change_type, count(*) AS n, max(event_id) AS last FROM (SELECT event_id, CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS event_type FROM events) GROUP BY 1")
def cdc_trigger_counts(spark: SparkSession, folder: str) -> DataFrame:
    e = Star(spark, folder).table("events")
    op = F.when(F.col("event_type") == "signup", "INSERT").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    df = strategies.trigger(e.select(F.col("event_id").alias("cdc_id"), op.alias("operation"), F.col("ts").alias("changed_at")))
    return df.groupBy("_change_type").agg(F.count("*").alias("n"), F.max("_lsn").alias("last"))


# ---- transforms ----


@query("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1")
def dedup_latest(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).table("events").transform(transforms.dedup(["user_id"], "ts", tie_break=["event_id"]))


@query("SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def dedup_oldest(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).table("events").transform(transforms.dedup(["user_id", "event_type"], "ts", newest=False, tie_break=["event_id"]))


@query("SELECT f.order_key, f.customer_key, f.product_key, f.line_total, c.segment, c.tier, p.category_name FROM fact_orders f LEFT JOIN dim_customer c USING (customer_key) LEFT JOIN dim_product p USING (product_key)")
def enrich_broadcast(spark: SparkSession, folder: str) -> DataFrame:
    s = Star(spark, folder)
    steps = [transforms.enrich(s.dim_customer, "customer_key", ["segment", "tier"], True), transforms.enrich(s.dim_product, "product_key", ["category_name"], True)]
    return transforms.chain(s.fact_orders.select("order_key", "customer_key", "product_key", "line_total"), steps)


def _window_query(name: str, window: str, start: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        e = Star(spark, folder).table("events").withColumn("value", F.col("value").cast("decimal(12,2)"))
        a = [("SUM", "value", "total"), ("COUNT", "event_id", "n"), ("COUNT_DISTINCT", "user_id", "users"), ("MAX", "value", "top"), ("MIN", "value", "low")]
        return e.transform(transforms.aggregate(["event_type"], a, window, "ts")).withColumn("total", scalars.money("total")).drop("window_end")

    v = "cast(value AS decimal(12,2))"
    _QUERIES[name] = run
    _SQL[name] = f"SELECT event_type, {start} AS window_start, cast(sum({v}) AS decimal(18,2)) AS total, count(event_id) AS n, count(DISTINCT user_id) AS users, max({v}) AS top, min({v}) AS low FROM events GROUP BY 1, 2"


_window_query("agg_windows_1d", "1 day", "date_trunc('day', ts)")
_window_query("agg_windows_7d", "7 days", "time_bucket(interval '7 days', ts)")
_window_query("agg_windows_30d", "30 days", "time_bucket(interval '30 days', ts, timestamp '1970-01-01')")


@query("""SELECT f.order_key, v.tier FROM fact_orders f LEFT JOIN (
  SELECT customer_key, tier, timestamp '1995-01-01' AS a, timestamp '1998-01-01' AS b FROM dim_customer UNION ALL
  SELECT customer_key, upper(tier), timestamp '1998-01-01', timestamp '9999-12-31' FROM dim_customer) v
ON f.customer_key = v.customer_key AND f.order_date >= v.a AND f.order_date < v.b""")
def pit_join(spark: SparkSession, folder: str) -> DataFrame:
    """Each line with the customer version of its day; versions change on 1 January 1998."""
    s = Star(spark, folder)
    edge = F.expr("timestamp_ntz '1998-01-01 00:00:00'")
    c = s.dim_customer.select("customer_key", "tier", "valid_from", "valid_to")
    versions = c.withColumn("valid_to", edge).unionByName(c.withColumns({"tier": F.upper("tier"), "valid_from": edge}))
    lines = s.fact_orders.select("order_key", "customer_key", F.col("order_date").cast("timestamp_ntz").alias("at"))
    return lines.transform(transforms.point_in_time(versions, "customer_key", "at")).select("order_key", "tier")


@query(f"SELECT {sql.DAY.split(',')[0]}, total_orders FROM sales_daily WHERE day_category = 'Holiday'")
def holidays(spark: SparkSession, folder: str) -> DataFrame:
    return _models(spark, folder).sales_daily.where("day_category = 'Holiday'").select("date_key", "total_orders")


@query("SELECT cast(unnest(generate_series(date '2001-01-01', date '2001-01-30', interval 1 day)) AS date) AS date_day")
def date_spine(spark: SparkSession, folder: str) -> DataFrame:
    return scalars.date_spine(spark, dt.date(2001, 1, 1), dt.date(2001, 1, 31))


@query("SELECT c_custkey, md5(cast(c_custkey AS varchar) || '-' || coalesce(CASE WHEN c_custkey % 3 <> 0 THEN c_name END, '_null_')) AS sk, cast(cast(c_custkey AS decimal(18,2)) / 100 AS decimal(18,2)) AS dollars FROM customer")
def surrogate_key(spark: SparkSession, folder: str) -> DataFrame:
    c = Star(spark, folder).table("customer").withColumn("n", F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")))
    return c.select("c_custkey", scalars.surrogate_key("c_custkey", "n").alias("sk"), scalars.cents_to_dollars("c_custkey").alias("dollars"))


# ---- merges and history ----


def _source(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Customers below key 1000 as the target; those from 900 on, with another segment, as the source."""
    c = Star(spark, folder).table("customer").select("c_custkey", "c_name", "c_mktsegment")
    return c.where("c_custkey < 1000"), c.where("c_custkey >= 900").withColumn("c_mktsegment", F.lower("c_mktsegment"))


_MERGED = "SELECT c_custkey, c_name, CASE WHEN c_custkey >= 900 THEN lower(c_mktsegment) ELSE c_mktsegment END AS c_mktsegment FROM customer"


def _table(spark: SparkSession, rows: DataFrame, partition: str | None = None) -> VersionedTable:
    t = VersionedTable(spark, new_path(spark, "table"), partition)
    t.overwrite(rows)
    return t


@query(_MERGED)
def upsert_merge(spark: SparkSession, folder: str) -> DataFrame:
    target, source = _source(spark, folder)
    t = _table(spark, target)
    t.upsert(source, ["c_custkey"])
    return t.read()


@query(_MERGED)
def delete_insert(spark: SparkSession, folder: str) -> DataFrame:
    target, source = _source(spark, folder)
    t = _table(spark, target)
    t.delete_insert(source, ["c_custkey"])
    return t.read()


@query(f"""SELECT c_custkey, c_name, c_mktsegment, CASE WHEN c_custkey >= 1000 THEN 'insert' ELSE 'update_postimage' END AS _change_type FROM ({_MERGED}) WHERE c_custkey >= 900
UNION ALL SELECT c_custkey, c_name, c_mktsegment, 'update_preimage' FROM customer WHERE c_custkey >= 900 AND c_custkey < 1000""")
def cdf_changes(spark: SparkSession, folder: str) -> DataFrame:
    target, source = _source(spark, folder)
    t = _table(spark, target)
    t.upsert(source, ["c_custkey"])
    return t.changes(0, ["c_custkey"])


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def append_unseen(spark: SparkSession, folder: str) -> DataFrame:
    target, source = _source(spark, folder)
    t = _table(spark, target)
    t.append_unseen(source.withColumn("c_mktsegment", F.upper("c_mktsegment")), ["c_custkey"])
    return t.read()


@query("SELECT customer_id, first_name, last_name, email, phone, segment, tier, registration_date, timestamp '2001-08-02' AS dw_updated_at FROM dim_customer")
def scd1_upsert(spark: SparkSession, folder: str) -> DataFrame:
    cols = ["customer_id", "first_name", "last_name", "email", "phone", "segment", "tier", "registration_date"]
    c = Star(spark, folder).dim_customer.select(*cols)
    first = history.scd1(None, c.where("customer_id < 700").withColumn("tier", F.lit("old")), ["customer_id"], dt.datetime(2001, 8, 1))
    return history.scd1(first, c, ["customer_id"], dt.datetime(2001, 8, 2))


_SCD2 = """
SELECT customer_id, 'old' AS tier, segment, timestamp '2001-08-01' AS valid_from, timestamp '2001-08-02' AS valid_to, false AS is_current FROM dim_customer WHERE customer_id < 700
UNION ALL SELECT customer_id, tier, segment, timestamp '2001-08-02', timestamp '9999-12-31', true FROM dim_customer WHERE customer_id < 1000
UNION ALL SELECT customer_id, tier, segment, timestamp '2001-08-01', timestamp '9999-12-31', true FROM dim_customer WHERE customer_id >= 1000"""


def _history(spark: SparkSession, folder: str) -> DataFrame:
    """Loads on two days and a rerun of the second: some tiers change, some customers are new, some missing."""
    c, key, tracked = Star(spark, folder).dim_customer.select("customer_id", "tier", "segment"), ["customer_id"], ["tier", "segment"]
    first = c.where("customer_id < 700").withColumn("tier", F.lit("old")).unionByName(c.where("customer_id >= 1000"))
    old = history.scd2(None, first, key, tracked, dt.datetime(2001, 8, 1))
    second = c.where("customer_id < 1000 or customer_id % 2 = 0")
    new = history.scd2(old, second, key, tracked, dt.datetime(2001, 8, 2))
    return history.scd2(new, second, key, tracked, dt.datetime(2001, 8, 2))


@query(f"SELECT *, md5(tier || '|' || segment) AS _scd_hash FROM ({_SCD2})")
def scd2_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return _history(spark, folder)


@query(f"SELECT *, md5(cast(customer_id AS varchar) || '-' || strftime(valid_from, '%Y-%m-%d %H:%M:%S')) AS customer_version_key FROM ({_SCD2})")
def scd2_view(spark: SparkSession, folder: str) -> DataFrame:
    return history.versions_view(_history(spark, folder), "customer_id").drop("_scd_hash")


# ---- vault ----


def _hub(name: str, frame: Callable[[Star], DataFrame], key: str, table: str, day: str | None = None) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = frame(Star(spark, folder))
        df = df.withColumn("load_date", F.col(day).cast("timestamp_ntz")) if day else _at(df)
        return vault.hub(df, name, key, f"olap.{table}")

    when = f"cast(min({day}) AS timestamp)" if day else LOAD
    _QUERIES[f"hub_{name}"] = run
    _SQL[f"hub_{name}"] = sql.query(f"SELECT md5(cast({key} AS varchar)) AS {name}_hk, {key} AS {name}_bk, {when} AS load_date, 'olap.{table}' AS record_source FROM {table} GROUP BY {key}")


_hub("customer", lambda s: s.dim_customer, "customer_id", "dim_customer")
_hub("order", lambda s: s.fact_orders, "order_id", "fact_orders", "order_date")
_hub("product", lambda s: s.dim_product, "product_id", "dim_product")
_hub("vendor", lambda s: s.dim_vendor, "vendor_id", "dim_vendor")


def _link(name: str, ends: dict[str, str]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return vault.link(Star(spark, folder).fact_orders.withColumn("load_date", F.col("order_date").cast("timestamp_ntz")), name, ends, "olap.fact_orders")

    a, b = ends.values()
    cols = ", ".join(f"md5(cast({c} AS varchar)) AS {h}_hk, {c} AS {h}_bk" for h, c in ends.items())
    _QUERIES[f"link_{name}"] = run
    _SQL[f"link_{name}"] = sql.query(f"SELECT md5({a} || '|' || {b}) AS {name}_hk, {cols}, cast(min(order_date) AS timestamp) AS load_date, 'olap.fact_orders' AS record_source FROM fact_orders GROUP BY {a}, {b}")


_link("order_customer", {"order": "order_id", "customer": "customer_key"})
_link("order_product", {"order": "order_id", "product": "product_key"})
_link("product_vendor", {"product": "product_key", "vendor": "vendor_key"})


def _satellite(name: str, frame: Callable[[Star], DataFrame], key: str, table: str, attributes: list[str]) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return vault.satellite(_at(frame(Star(spark, folder))), name, key, attributes, f"olap.{table}")

    parts = " || '|' || ".join(f"coalesce(cast({a} AS varchar), '')" for a in attributes)
    _QUERIES[f"sat_{name}"] = run
    _SQL[f"sat_{name}"] = sql.query(f"SELECT DISTINCT md5(cast({key} AS varchar)) AS {name}_hk, {', '.join(attributes)}, md5({parts}) AS hash_diff, {LOAD} AS load_date, 'olap.{table}' AS record_source FROM {table}")


_satellite("customer", lambda s: s.dim_customer, "customer_id", "dim_customer", ["first_name", "last_name", "email", "phone", "segment", "tier"])
_satellite("product", lambda s: s.dim_product, "product_id", "dim_product", ["name", "sku", "category_name", "price", "cost"])
_satellite("order", lambda s: s.fact_orders, "order_id", "fact_orders", ["line_number", "quantity", "line_total", "order_status"])


@query(f"SELECT md5(cast(c_custkey AS varchar)) AS customer_hk, c_custkey AS customer_bk, {LOAD} AS load_date, 'olap.customer' AS record_source FROM customer")
def vault_incremental_hub(spark: SparkSession, folder: str) -> DataFrame:
    """Two overlapping batches appended: each key once."""
    c = _at(Star(spark, folder).table("customer"))
    t = _table(spark, vault.hub(c.where("c_custkey < 800"), "customer", "c_custkey", "olap.customer"))
    t.append_unseen(vault.hub(c.where("c_custkey >= 300"), "customer", "c_custkey", "olap.customer"), ["customer_hk"])
    return t.read()


@query("""SELECT md5(cast(c_custkey AS varchar)) AS customer_hk, c_mktsegment, md5(c_mktsegment) AS hash_diff FROM customer
UNION ALL SELECT md5(cast(c_custkey AS varchar)), lower(c_mktsegment), md5(lower(c_mktsegment)) FROM customer WHERE c_custkey < 500""")
def vault_incremental_sat(spark: SparkSession, folder: str) -> DataFrame:
    """States A, B and A again: the third is known already."""
    c = _at(Star(spark, folder).table("customer"))
    sat = lambda df: vault.satellite(df, "customer", "c_custkey", ["c_mktsegment"], "olap.customer")
    t = _table(spark, sat(c))
    for df in (c.where("c_custkey < 500").withColumn("c_mktsegment", F.lower("c_mktsegment")), c):
        t.append_unseen(sat(df), ["customer_hk", "hash_diff"])
    return t.read().select("customer_hk", "c_mktsegment", "hash_diff")


# ---- quality ----

_RULES = "CASE WHEN l_quantity IS NULL THEN 'l_quantity_not_null' WHEN l_discount <= 0 THEN 'l_discount_positive' WHEN l_extendedprice >= 90000 THEN 'price_cap' END"


def _split(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    rules = [quality.not_null("l_quantity"), quality.positive("l_discount"), quality.Rule.sql("price_cap", "l_extendedprice >= 90000")]
    return quality.split(Star(spark, folder).table("lineitem"), rules, "t", "lineitem", "p")


@query(f"SELECT * FROM lineitem WHERE {_RULES} IS NULL")
def quarantine_split(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder)[0].drop("_warnings")


@query(f"SELECT {_RULES} AS _quarantine_rule, count(*) AS n FROM lineitem WHERE {_RULES} IS NOT NULL GROUP BY 1")
def quarantine_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _split(spark, folder)[1].groupBy("_quarantine_rule").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dq_unique(spark: SparkSession, folder: str) -> DataFrame:
    return quality.unique(Star(spark, folder).table("lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT customer_id, full_name FROM dim_customer WHERE email IS NULL")
def dq_not_null(spark: SparkSession, folder: str) -> DataFrame:
    return quality.nulls(Star(spark, folder).dim_customer, "email").select("customer_id", "full_name")


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') GROUP BY 1")
def dq_accepted(spark: SparkSession, folder: str) -> DataFrame:
    return quality.accepted(Star(spark, folder).table("lineitem"), "l_returnflag", ["A", "N"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def dq_relationships(spark: SparkSession, folder: str) -> DataFrame:
    s = Star(spark, folder)
    return quality.referential(s.table("orders"), s.table("customer").where("c_acctbal >= 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size > 45")
def dq_range(spark: SparkSession, folder: str) -> DataFrame:
    return quality.out_of_range(Star(spark, folder).table("part"), "p_size", 5, 45).select("p_partkey", "p_size")


@query("SELECT order_key, line_total FROM fact_orders WHERE abs(line_total - (gross_amount - discount_amount)) > 0.01 OR order_date > date '2001-07-31'")
def dq_revenue(spark: SparkSession, folder: str) -> DataFrame:
    f = Star(spark, folder).fact_orders
    return quality.expression(f, "abs(line_total - (gross_amount - discount_amount)) <= 0.01 and order_date <= date'2001-07-31'").select("order_key", "line_total")


@query("""SELECT o_orderkey, n_lines, cast(total AS decimal(18,2)) AS total FROM (SELECT l_orderkey, count(*) AS n_lines, sum(cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(5,2)))) AS total FROM lineitem GROUP BY 1)
JOIN orders ON l_orderkey = o_orderkey WHERE abs(cast(o_totalprice AS decimal(12,2)) - total) > 1000""")
def dq_order_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Orders whose own total, a column of another table, lies far from that of their lines."""
    s = Star(spark, folder)
    line = F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1).cast("decimal(5,2)") - F.col("l_discount").cast("decimal(5,2)"))
    lines = s.table("lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum(line).alias("total"))
    both = s.table("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return quality.expression(both, "abs(cast(o_totalprice as decimal(12,2)) - total) <= 1000").select("o_orderkey", "n_lines", scalars.money("total").alias("total"))


@query("SELECT p_brand, count(DISTINCT md5(p_type)) AS n FROM part GROUP BY 1 HAVING count(DISTINCT md5(p_type)) > 1")
def dq_hash_determinism(spark: SparkSession, folder: str) -> DataFrame:
    return quality.one_hash_per_key(Star(spark, folder).table("part").withColumn("hk", F.md5("p_type")), "p_brand", "hk")


@query("SELECT event_type, sum(cast(json_extract_string(props, '$.k') AS bigint))::bigint AS k FROM events GROUP BY 1")
def json_props(spark: SparkSession, folder: str) -> DataFrame:
    e = Star(spark, folder).table("events").select("event_type", F.from_json("props", T.StructType([T.StructField("k", T.LongType())])).alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"))


@query("SELECT event_id, ts, user_id, event_type, value, props, CASE WHEN event_id % 2 = 0 THEN 'even' END AS note FROM events")
def union_by_name(spark: SparkSession, folder: str) -> DataFrame:
    e = Star(spark, folder).table("events")
    return e.where("event_id % 2 = 1").unionByName(e.where("event_id % 2 = 0").withColumn("note", F.lit("even")), allowMissingColumns=True)


@query("SELECT event_id, ts, value FROM events ORDER BY ts DESC, event_id LIMIT 20")
def latest_events(spark: SparkSession, folder: str) -> DataFrame:
    """A top-k report."""
    return Star(spark, folder).table("events").select("event_id", "ts", "value").orderBy(F.desc("ts"), "event_id").limit(20)


@query("SELECT c_custkey FROM customer WHERE c_custkey < 900")
def keys_removed(spark: SparkSession, folder: str) -> DataFrame:
    target, source = _source(spark, folder)
    return merge.diff(target, source, ["c_custkey"]).where("_change_type = 'delete'").select("c_custkey")


# ---- partitions, replays and other loads ----


@query("""SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey >= 900 THEN lower(c_mktsegment) || '/=%' WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment FROM customer""")
def upsert_partitioned(spark: SparkSession, folder: str) -> DataFrame:
    """Keys move to other partitions, whose names need spelling out; some partitions are null."""
    c = Star(spark, folder).table("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    named = c.withColumn("c_mktsegment", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")))
    t = _table(spark, named.where("c_custkey < 1000"), "c_mktsegment")
    source = c.where("c_custkey >= 900").withColumn("c_mktsegment", F.concat(F.lower("c_mktsegment"), F.lit("/=%")))
    t.upsert(source, ["c_custkey"])
    t.upsert(source, ["c_custkey"])
    return t.read()


@query(f"SELECT user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY _lsn DESC) AS k FROM ({_CHANGES})) WHERE k = 1 AND _change_type <> 'delete'")
def cdc_apply_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Three batches of changes, the newest first and one twice: the same rows as in order."""
    df = strategies.debezium(_envelopes(spark, folder)).select("_lsn", "_change_type", "data.user_id", "data.value")
    state = None
    for part in (2, 0, 1, 0):
        state = strategies.replay(state, df.where(F.expr(f"_lsn div 4000 % 3 = {part}")), ["user_id"])
    return strategies.alive(state)


@query("SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN value END AS value, CASE WHEN event_id % 2 = 1 THEN event_type END AS event_type FROM events")
def schema_sync(spark: SparkSession, folder: str) -> DataFrame:
    """The second batch has a new column and lacks one: both the table's rows and its columns follow."""
    e = Star(spark, folder).table("events")
    t = _table(spark, e.where("event_id % 2 = 0").select("event_id", "user_id", "value", "ts"))
    t.evolve(e.where("event_id % 2 = 1").select("event_id", "user_id", F.lit(None).cast("double").alias("value"), "event_type"))
    return t.read()


@query("SELECT event_id, user_id, CASE WHEN event_id % 3 = 1 THEN value END AS value, CASE event_id % 3 WHEN 0 THEN 'a.parquet' ELSE 'b.parquet' END AS file FROM events WHERE event_id % 3 < 2")
def landing_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files of different columns, those named after the last one done."""
    return strategies.landing(_landing(spark, folder))[0].withColumnRenamed("_source_file", "file").drop("_ingestion_time")


@query("SELECT event_id % 3 AS part, count(*) AS n FROM events WHERE event_id % 3 = 1 GROUP BY 1")
def manifest_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files that an earlier run hasn't listed, whatever their names."""
    c = _landing(spark, folder)
    first = strategies.manifest(c)[1]
    first.more["done"] = [x for x in first.more["done"] if "/a/" in x[0] or "/a.parquet" in x[0]]
    c.cursor = first
    return strategies.manifest(c)[0].groupBy((F.col("event_id") % 3).alias("part")).agg(F.count("*").alias("n"))


def _landing(spark: SparkSession, folder: str) -> strategies.Context:
    """A landing folder with a file for each third of the events, the first without ``value``."""
    e, at = Star(spark, folder).table("events").select("event_id", "user_id", "value"), new_path(spark, "landing")
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(at).getFileSystem(spark._jsc.hadoopConfiguration())
    for k, name in enumerate("abz"):
        part = e.where(F.col("event_id") % 3 == k)
        (part.drop("value") if k == 0 else part).coalesce(1).write.parquet(f"{at}/.{name}")
        file = next(s.getPath() for s in fs.listStatus(p(f"{at}/.{name}")) if s.getPath().getName().startswith("part-"))
        fs.rename(file, p(f"{at}/{name}.parquet"))
    return strategies.Context(spark, Tenant("t"), "t", {"path": at, "pattern": "[ab].parquet"}, None, dt.datetime(2001, 8, 2))


@query("SELECT c_custkey, c_name, lower(c_mktsegment) AS c_mktsegment, CASE WHEN c_custkey >= 1000 THEN 'insert' ELSE 'update_postimage' END AS _change_type FROM customer WHERE c_custkey >= 900")
def change_feed(spark: SparkSession, folder: str) -> DataFrame:
    target, source = _source(spark, folder)
    t = _table(spark, target)
    t.upsert(source, ["c_custkey"])
    c = _context(spark, target, "0", path=t.path, keys=["c_custkey"])
    return strategies.change_feed(c)[0]


@query("SELECT customer_id, CASE WHEN customer_id < 700 THEN 'old' ELSE tier END AS tier FROM dim_customer")
def scd0_insert_only(spark: SparkSession, folder: str) -> DataFrame:
    c = Star(spark, folder).dim_customer.select("customer_id", "tier")
    return history.scd0(c.where("customer_id < 700").withColumn("tier", F.lit("old")), c, ["customer_id"])


@query(f"SELECT _quarantine_rule, count(*) AS n FROM (SELECT {_RULES} AS _quarantine_rule FROM lineitem WHERE {_RULES} IS NOT NULL) GROUP BY 1")
def quarantine_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Bad rows written twice, as by a rerun of one batch, and read back by customer and table."""
    store = quality.Quarantine(new_path(spark, "quarantine"))
    for _ in range(2):
        store.write(_split(spark, folder)[1], "batch-1")
    return store.read(spark, "t", "lineitem").groupBy("_quarantine_rule").agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN o_orderdate < timestamp '1995-01-01' OR o_orderdate > timestamp '2000-12-31' THEN 'o_orderdate_range' END AS rule, count(*) AS n FROM orders GROUP BY 1 HAVING rule IS NOT NULL")
def rule_date_range(spark: SparkSession, folder: str) -> DataFrame:
    o = Star(spark, folder).table("orders")
    bad = quality.split(o, [quality.date_range("o_orderdate", dt.datetime(1995, 1, 1), dt.datetime(2000, 12, 31))])[1]
    return bad.groupBy(F.col("_quarantine_rule").alias("rule")).agg(F.count("*").alias("n"))


@query("SELECT customer_id FROM dim_customer WHERE email IS NULL OR NOT regexp_matches(email, '^[A-Za-z0-9+_.-]+@[A-Za-z0-9.-]+$')")
def rule_email(spark: SparkSession, folder: str) -> DataFrame:
    """Addresses that are missing or malformed; as the rule only warns, these rows stay valid."""
    good, _ = quality.split(Star(spark, folder).dim_customer, [quality.valid_email("email")])
    return good.where(F.array_contains("_warnings", "email_email")).select("customer_id")


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'other' END AS size_name FROM part")
def map_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return Star(spark, folder).table("part").select("p_partkey", scalars.lookup(F.col("p_size") % 3, {0: "small", 1: "medium"}, "other").alias("size_name"))


@query("SELECT order_key, customer_key, segment FROM fact_orders LEFT JOIN stg_customers USING (customer_key)")
def enrich_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """A lookup in a view of the catalog, by its name."""
    m = _models(spark, folder)
    m.register_views()
    return m.star.fact_orders.select("order_key", "customer_key").transform(transforms.enrich("stg_customers", "customer_key", ["segment"]))


@query("SELECT margin_category, count(*) AS n FROM stg_products GROUP BY 1")
def staging_views(spark: SparkSession, folder: str) -> DataFrame:
    _models(spark, folder).register_views()
    return spark.sql("SELECT margin_category, count(*) AS n FROM stg_products GROUP BY 1")


@query("SELECT cast(ts AS date) AS date, event_type, count(*) AS n, cast(sum(cast(value AS decimal(18,4))) AS decimal(18,2)) AS total FROM events GROUP BY 1, 2")
def event_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Events written as JSON lines by day, in two batches, and read back."""
    e, at = Star(spark, folder).table("events"), new_path(spark, "events")
    for k in range(2):
        sinks.json_lines(e.where(F.col("event_id") % 2 == k), at, "ts", 1000)
    back = spark.read.schema("event_id long, event_type string, value double, date date").json(at)
    return back.groupBy("date", "event_type").agg(F.count("*").alias("n"), scalars.money(F.sum(F.col("value").cast("decimal(18,4)"))).alias("total"))


# ---- tests of the vault ----


@query("SELECT md5(cast(customer_id AS varchar)) AS customer_hk FROM dim_customer WHERE customer_id NOT IN (SELECT customer_key FROM fact_orders WHERE order_id % 20 = 0)")
def vault_orphan_hubs(spark: SparkSession, folder: str) -> DataFrame:
    """Customers without an order among those of every twentieth number."""
    q = queries()
    return quality.orphans(q["hub_customer"](spark, folder), "customer", [q["link_order_customer"](spark, folder).where("order_bk % 20 = 0")])


@query("""SELECT 'customer' AS "end", count(*) AS n FROM (SELECT DISTINCT order_id, customer_key FROM fact_orders WHERE customer_key >= 700) HAVING count(*) > 0""")
def vault_broken_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links whose customers were left out of the hub; no order is missing."""
    q = queries()
    hub = q["hub_customer"](spark, folder).where("customer_bk < 700")
    return quality.broken_links(q["link_order_customer"](spark, folder), {"customer": hub, "order": q["hub_order"](spark, folder)})


@query("SELECT md5(cast(customer_id AS varchar)) AS customer_hk, md5(tier) AS hash_diff, cast(2 AS bigint) AS n FROM dim_customer WHERE customer_id % 7 = 0")
def vault_repeated_states(spark: SparkSession, folder: str) -> DataFrame:
    """A satellite into which every seventh row was loaded twice, around the check for known states."""
    c = _at(Star(spark, folder).dim_customer)
    sat = vault.satellite(c, "customer", "customer_id", ["tier"], "olap.dim_customer")
    again = vault.satellite(c.where("customer_id % 7 = 0"), "customer", "customer_id", ["tier"], "olap.dim_customer")
    return quality.repeated_states(sat.unionByName(again), "customer")


@query("SELECT customer_id FROM dim_customer WHERE email IS NULL")
def vault_hash_length(spark: SparkSession, folder: str) -> DataFrame:
    """Hashes that are missing, as of a key column that is null."""
    c = Star(spark, folder).dim_customer.withColumn("mail_hk", scalars.hash_key("email"))
    return quality.hash_length(c, "mail_hk").select("customer_id")


@query("SELECT p_partkey, p_size - 10 AS room FROM part WHERE p_size - 10 <= 0")
def dq_positive(spark: SparkSession, folder: str) -> DataFrame:
    p = Star(spark, folder).table("part").select("p_partkey", (F.col("p_size") - 10).alias("room"))
    return quality.positive_values(p, "room")


# ---- jobs ----


@query("""SELECT date_key, customer_key, cast(sum(line_total) AS decimal(18,2)) AS revenue, cast(sum(quantity) AS bigint) AS quantity, count(*) AS order_lines
FROM (SELECT f.* FROM fact_orders f JOIN dim_customer USING (customer_key) JOIN dim_product p USING (product_key) WHERE f.quantity > 0 AND f.line_total > 1000 AND f.quantity < 48) GROUP BY 1, 2""")
def order_fact_job(spark: SparkSession, folder: str) -> DataFrame:
    t = VersionedTable(spark, new_path(spark, "daily"))
    jobs.order_facts(_models(spark, folder), t, quality.Quarantine(new_path(spark, "bad")))
    return t.read()


@query(f"SELECT *, md5(tier || '|' || segment) AS _scd_hash FROM ({_SCD2})")
def customer_dimension_job(spark: SparkSession, folder: str) -> DataFrame:
    """The loads of ``scd2_snapshot`` into a versioned table, by merge."""
    c, t = Star(spark, folder).dim_customer.select("customer_id", "tier", "segment"), VersionedTable(spark, new_path(spark, "customers"))
    first = c.where("customer_id < 700").withColumn("tier", F.lit("old")).unionByName(c.where("customer_id >= 1000"))
    second = c.where("customer_id < 1000 or customer_id % 2 = 0")
    for source, day in ((first, 1), (second, 2), (second, 2)):
        jobs.customer_dimension(source.unionByName(source), t, ["tier", "segment"], dt.datetime(2001, 8, day))
    return t.read()


@query("SELECT * FROM sales_daily")
def sales_daily_merged(spark: SparkSession, folder: str) -> DataFrame:
    """Days loaded up to the end of 2000, wrongly for the last month; then merged from the target's own last day."""
    m, t = _models(spark, folder), VersionedTable(spark, new_path(spark, "sales"))
    t.overwrite(m.sales_daily.where("date_key <= 20001231").withColumn("total_orders", F.when(F.col("date_key") <= 20001130, F.col("total_orders")).otherwise(F.lit(0).cast("bigint"))))
    jobs.merge_daily(m, t, lookback_days=31)
    return t.read()


@query(sql.affinity("product_key", "product_name", 1))
def product_affinity_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of single products, with their names and categories."""
    return jobs.product_pairs(_models(spark, folder), 2)


@query("SELECT * FROM (VALUES ('USD', 'EUR', cast(0.92 AS decimal(10,4)), date '2024-01-01'), ('USD', 'GBP', cast(0.79 AS decimal(10,4)), date '2024-01-01'), ('USD', 'JPY', NULL, date '2024-01-01')) AS t(from_currency, to_currency, rate, effective_date)")
def seed_rates(spark: SparkSession, folder: str) -> DataFrame:
    """A seed file read by its declared schema; an empty field is null."""
    at = new_path(spark, "seed")
    lines = ["from_currency,to_currency,rate,effective_date", "USD,EUR,0.92,2024-01-01", "USD,GBP,0.79,2024-01-01", "USD,JPY,,2024-01-01"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(at)
    return jobs.seed(spark, at, "from_currency string, to_currency string, rate decimal(10,4), effective_date date")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
