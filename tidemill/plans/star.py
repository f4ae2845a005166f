"""The star schema over the driver's retail tables. What those tables lack is derived here and nowhere else.

Derived, documented stand-ins: unit cost is (40 + size) percent of the retail price (the line's cost 60
percent of its gross amount), tier by account balance, payment method by order priority, holidays are
1 January and 25 December, the fiscal year is the calendar's, e-mail from the name, missing for every fiftieth
customer, tax id from the vendor's key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.scalars import date_parts, ladder

PAYMENT = {"1-URGENT": "credit_card", "2-HIGH": "debit_card", "3-MEDIUM": "paypal", "4-NOT SPECIFIED": "cash"}
TIERS = [(7500, "VIP"), (5000, "Gold"), (2500, "Silver")]
OPENED = "1995-01-01 00:00:00"


@dataclass
class Star:
    """Tables of one folder; each is a plan, read when a query runs."""

    spark: SparkSession
    folder: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def fact_orders(self) -> DataFrame:
        lines, orders = self.table("lineitem"), self.table("orders")
        pay = F
        for k, v in PAYMENT.items():
            pay = pay.when(F.col("o_orderpriority") == k, v)
        df = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        df = df.select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"), F.to_date("o_orderdate").alias("order_date"),
            F.date_format("o_orderdate", "yyyyMMdd").cast("int").alias("date_key"), F.col("o_custkey").alias("customer_key"), F.col("l_partkey").alias("product_key"),
            F.col("l_suppkey").alias("vendor_key"), F.col("l_quantity").cast("bigint").alias("quantity"), F.try_divide("l_extendedprice", "l_quantity").alias("unit_price"),
            F.col("l_discount").cast("decimal(5,2)").alias("discount_percent"), F.col("l_extendedprice").cast("decimal(12,2)").alias("gross_amount"),
            F.col("o_orderstatus").alias("order_status"), pay.otherwise("other").alias("payment_method"),
            F.col("l_returnflag").alias("return_flag"), F.to_date("l_shipdate").alias("ship_date"),
        )
        df = df.withColumn("line_total", (F.col("gross_amount") * (F.lit(1).cast("decimal(5,2)") - F.col("discount_percent"))).cast("decimal(12,2)"))
        df = df.withColumns({
            "discount_amount": (F.col("gross_amount") - F.col("line_total")).cast("decimal(12,2)"),
            "cost_amount": (F.col("gross_amount") * F.lit("0.60").cast("decimal(3,2)")).cast("decimal(12,2)"),
        })
        df = df.withColumn("profit_amount", (F.col("line_total") - F.col("cost_amount")).cast("decimal(12,2)"))
        key = F.concat_ws("|", *(F.col(c).cast("string") for c in ("order_id", "line_number", "product_key", "vendor_key", "quantity", "gross_amount", "discount_percent")))
        return df.withColumn("order_key", F.md5(key))

    @cached_property
    def dim_customer(self) -> DataFrame:
        first = self.table("orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("registration_date"))
        name = F.split("c_name", "#")
        return self.table("customer").join(first, F.col("c_custkey") == F.col("o_custkey"), "left").select(
            F.col("c_custkey").alias("customer_key"), F.col("c_custkey").alias("customer_id"), name[0].alias("first_name"), name[1].alias("last_name"), F.col("c_name").alias("full_name"),
            F.when(F.col("c_custkey") % 50 != 0, F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com"))).alias("email"),
            F.concat(F.lit("+"), F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lit("-"), name[1]).alias("phone"), F.col("c_mktsegment").alias("segment"),
            ladder(F.col("c_acctbal").cast("decimal(12,2)"), TIERS, "Bronze").alias("tier"), "registration_date",
            F.lit(OPENED).cast("timestamp_ntz").alias("valid_from"), F.lit("9999-12-31 00:00:00").cast("timestamp_ntz").alias("valid_to"), F.lit(1).alias("is_current"),
        )

    @cached_property
    def dim_product(self) -> DataFrame:
        price = F.col("p_retailprice").cast("decimal(10,2)")
        cost = (price * (F.col("p_size") + 40).cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(10,2)")
        return self.table("part").select(
            F.col("p_partkey").alias("product_key"), F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_partkey").cast("string").alias("sku"),
            F.col("p_type").alias("category_name"), F.concat_ws("/", "p_type", "p_brand").alias("category_path"), F.col("p_brand").alias("brand"),
            price.alias("price"), cost.alias("cost"), F.try_divide((price - cost).cast("double"), price.cast("double")).alias("margin"), F.lit("active").alias("status"), F.lit(1).alias("is_current"),
            F.concat_ws(", ", "p_name", "p_type", "p_brand").alias("description"),
        )

    @cached_property
    def dim_vendor(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("vendor_key"), F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("name"), F.lit("active").alias("status"), F.lit(1).alias("is_current"), F.concat(F.lit("TX"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0")).alias("tax_id"))

    @cached_property
    def dim_date(self) -> DataFrame:
        ends = self.table("orders").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("b")).where("a is not null")
        days = ends.select(F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date"))
        d = days.withColumns(date_parts("date"))
        return d.select(
            F.date_format("date", "yyyyMMdd").cast("int").alias("date_key"), "date", "year", "quarter", "month", "day", "day_of_week", "year_month", "year_quarter",
            F.date_format("date", "EEEE").alias("day_name"), F.date_format("date", "MMMM").alias("month_name"), F.col("year").alias("fiscal_year"), F.col("quarter").alias("fiscal_quarter"),
            (F.col("day_of_week") >= 6).cast("int").alias("is_weekend"), F.date_format("date", "MM-dd").isin("01-01", "12-25").cast("int").alias("is_holiday"),
        )


#: The same tables in DuckDB SQL, as CTEs.
SQL = {
    "fact_orders": """
  SELECT *, cast(line_total - cost_amount AS decimal(12,2)) AS profit_amount,
    md5(concat_ws('|', order_id, line_number, product_key, vendor_key, quantity, gross_amount, discount_percent)) AS order_key
  FROM (SELECT *, cast(gross_amount - line_total AS decimal(12,2)) AS discount_amount, cast(gross_amount * cast('0.60' AS decimal(3,2)) AS decimal(12,2)) AS cost_amount
    FROM (SELECT *, cast(gross_amount * (cast(1 AS decimal(5,2)) - discount_percent) AS decimal(12,2)) AS line_total
      FROM (SELECT l_orderkey AS order_id, l_linenumber AS line_number, cast(o_orderdate AS date) AS order_date, cast(strftime(o_orderdate, '%Y%m%d') AS int) AS date_key,
          o_custkey AS customer_key, l_partkey AS product_key, l_suppkey AS vendor_key, cast(l_quantity AS bigint) AS quantity, l_extendedprice / nullif(l_quantity, 0) AS unit_price,
          cast(l_discount AS decimal(5,2)) AS discount_percent, cast(l_extendedprice AS decimal(12,2)) AS gross_amount, o_orderstatus AS order_status,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'credit_card' WHEN '2-HIGH' THEN 'debit_card' WHEN '3-MEDIUM' THEN 'paypal' WHEN '4-NOT SPECIFIED' THEN 'cash' ELSE 'other' END AS payment_method, l_returnflag AS return_flag, cast(l_shipdate AS date) AS ship_date
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)))""",
    "dim_customer": """
  SELECT c_custkey AS customer_key, c_custkey AS customer_id, split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name, c_name AS full_name,
    CASE WHEN c_custkey % 50 <> 0 THEN lower(replace(c_name, '#', '.')) || '@example.com' END AS email, '+' || lpad(cast(c_nationkey AS varchar), 2, '0') || '-' || split_part(c_name, '#', 2) AS phone,
    c_mktsegment AS segment, CASE WHEN cast(c_acctbal AS decimal(12,2)) >= 7500 THEN 'VIP' WHEN cast(c_acctbal AS decimal(12,2)) >= 5000 THEN 'Gold' WHEN cast(c_acctbal AS decimal(12,2)) >= 2500 THEN 'Silver' ELSE 'Bronze' END AS tier,
    registration_date, timestamp '1995-01-01' AS valid_from, timestamp '9999-12-31' AS valid_to, 1 AS is_current
  FROM customer LEFT JOIN (SELECT o_custkey, cast(min(o_orderdate) AS date) AS registration_date FROM orders GROUP BY 1) ON c_custkey = o_custkey""",
    "dim_product": """
  SELECT p_partkey AS product_key, p_partkey AS product_id, p_name AS name, cast(p_partkey AS varchar) AS sku, p_type AS category_name, concat_ws('/', p_type, p_brand) AS category_path, p_brand AS brand,
    price, cost, cast(price - cost AS double) / nullif(cast(price AS double), 0) AS margin, 'active' AS status, 1 AS is_current, concat_ws(', ', p_name, p_type, p_brand) AS description
  FROM (SELECT *, cast(price * cast(p_size + 40 AS decimal(5,0)) * cast('0.01' AS decimal(3,2)) AS decimal(10,2)) AS cost FROM (SELECT *, cast(p_retailprice AS decimal(10,2)) AS price FROM part))""",
    "dim_vendor": "SELECT s_suppkey AS vendor_key, s_suppkey AS vendor_id, s_name AS name, 'active' AS status, 1 AS is_current, 'TX' || lpad(cast(s_suppkey AS varchar), 8, '0') AS tax_id FROM supplier",
    "dim_date": """
  SELECT cast(strftime(date, '%Y%m%d') AS int) AS date_key, date, cast(year(date) AS int) AS year, cast(quarter(date) AS int) AS quarter, cast(month(date) AS int) AS month, cast(day(date) AS int) AS day,
    cast(isodow(date) AS int) AS day_of_week, strftime(date, '%Y-%m') AS year_month, year(date) || '-Q' || quarter(date) AS year_quarter,
    dayname(date) AS day_name, monthname(date) AS month_name, cast(year(date) AS int) AS fiscal_year, cast(quarter(date) AS int) AS fiscal_quarter, cast(isodow(date) >= 6 AS int) AS is_weekend,
    cast(strftime(date, '%m-%d') IN ('01-01', '12-25') AS int) AS is_holiday
  FROM (SELECT cast(unnest(generate_series(min(o_orderdate), max(o_orderdate), interval 1 day)) AS date) AS date FROM orders)""",
}
