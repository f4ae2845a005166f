"""Staging views, intermediate models and marts, as plans over the star schema."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.config import DEFAULT, Settings
from tidemill.functions.scalars import ladder, mean, money, month_start, months_apart, ratio
from tidemill.plans.star import Star

# Bounds and labels of the documented scores and segments.
RECENCY = [(7, 5), (30, 4), (90, 3), (180, 2)]
FREQUENCY = [(20, 5), (10, 4), (5, 3), (2, 2)]
MARGIN = [(0.5, "High"), (0.3, "Medium"), (0.1, "Low")]
TIER_RANK = {"VIP": 4, "Gold": 3, "Silver": 2}
LIFECYCLE = [(30, "Active"), (90, "At Risk"), (180, "Dormant")]
SEGMENT_CORE = [(13, "Champions"), (10, "Loyal Customers"), (7, "Potential Loyalists"), (5, "At Risk"), (3, "Cannot Lose Them")]
SEGMENT_RFM = [(13, "Champions"), (11, "Loyal Customers"), (9, "Potential Loyalists"), (7, "New Customers"), (5, "Promising"), (4, "Need Attention"), (3, "About to Sleep")]
ACTION_RFM = [
    (13, "Reward them, early adopter for new products"), (11, "Upsell higher value products"), (9, "Offer membership/loyalty program"), (7, "Make them familiar, nurture them"),
    (5, "Offer free trials, limited time offers"), (4, "Make limited time offers"), (3, "Share valuable resources, recommend products"),
]
ACTION_OTHER = "Send personalized reactivation campaigns"
PRIORITY = [(11, "High"), (7, "Medium")]
PERFORMANCE = [(100_000, "Top Seller"), (10_000, "Strong Performer"), (1_000, "Moderate")]
VELOCITY = [(100, "Fast Moving"), (20, "Steady")]
STRENGTH = [(0.5, "Strong"), (0.3, "Moderate"), (0.1, "Weak")]
LTV_BUCKETS = [(10_000, "$10K+"), (5_000, "$5K - $9.9K"), (1_000, "$1K - $4.9K"), (500, "$500 - $999"), (100, "$100 - $499")]

LTV_SCALED = [(1_000_000, "$1M+"), (500_000, "$500K - $999K"), (200_000, "$200K - $499K"), (100_000, "$100K - $199K"), (50_000, "$50K - $99K")]

_n = lambda c: F.count_distinct(c).cast("bigint")


def _sum(c: str | Column) -> Column:
    return money(F.sum(c))


def _parts(*cols: str) -> list[Column]:
    """Sum and count of each column, to be summed again by ``_sum``, ``F.sum`` and ``_mean``."""
    return [x for c in cols for x in (F.sum(c).alias(c), F.count(c).alias(f"n_{c}"))]


def _mean(c: str) -> Column:
    return F.try_divide(F.sum(c).cast("double"), F.sum(f"n_{c}").cast("double"))


@dataclass
class Models:
    star: Star
    settings: Settings = DEFAULT

    # ---- staging ----

    @cached_property
    def stg_orders(self) -> DataFrame:
        o = self.star.fact_orders
        return o.withColumns({"effective_unit_price": ratio(F.col("line_total"), F.col("quantity")), "profit_margin_pct": ratio(F.col("profit_amount"), F.col("line_total"))})

    @cached_property
    def stg_customers(self) -> DataFrame:
        rank = F
        for tier, n in TIER_RANK.items():
            rank = rank.when(F.col("tier") == tier, n)
        return self.star.dim_customer.where("is_current = 1").withColumns({"display_name": F.concat("first_name", F.lit(" "), "last_name"), "tier_rank": rank.otherwise(1)})

    @cached_property
    def stg_products(self) -> DataFrame:
        p = self.star.dim_product.where("is_current = 1").withColumnRenamed("name", "product_name")
        above = F
        for bound, label in MARGIN:
            above = above.when(F.col("margin") > bound, label)
        return p.withColumns({"margin_category": above.otherwise("Loss Leader"), "absolute_margin": (F.col("price") - F.col("cost")).cast("decimal(10,2)")})

    @cached_property
    def stg_dates(self) -> DataFrame:
        return self.star.dim_date.withColumns({"quarter_label": F.concat(F.lit("Q"), F.col("quarter").cast("string")), "calendar_year": F.year("date"), "calendar_month": F.month("date"), "day_of_week_num": F.weekday("date") + 1})

    def audited(self, name: str, source: str) -> DataFrame:
        """A staging model with when it was loaded and from where."""
        when = F.lit(self.settings.as_of).cast("timestamp_ntz")
        return getattr(self, name).withColumns({"load_date": when, "record_source": F.lit(f"olap.{source}")})

    def register_views(self) -> None:
        """Temporary views of the staging models, by their names."""
        for name in ("stg_orders", "stg_customers", "stg_products", "stg_dates"):
            getattr(self, name).createOrReplaceTempView(name)

    # ---- intermediate ----

    @cached_property
    def orders_enriched(self) -> DataFrame:
        c = self.stg_customers.select("customer_key", "customer_id", F.col("full_name").alias("customer_name"), F.col("email").alias("customer_email"), F.col("segment").alias("customer_segment"), F.col("tier").alias("customer_tier"), "tier_rank", "registration_date")
        p = self.stg_products.select("product_key", "product_name", "sku", "category_name", "category_path", "margin_category", F.col("price").alias("current_product_price"), F.col("cost").alias("current_product_cost"), "brand")
        d = self.stg_dates.select("date_key", "date", "year", "month", "quarter", "year_month", "year_quarter", "is_weekend", "is_holiday")
        v = self.star.dim_vendor.select("vendor_key", F.col("name").alias("vendor_name"), F.col("status").alias("vendor_status"))
        return self.stg_orders.join(d, "date_key", "left").join(c, "customer_key", "left").join(p, "product_key", "left").join(v, "vendor_key", "left")

    @cached_property
    def customer_metrics(self) -> DataFrame:
        """Lines come down to orders, orders to customers; attributes, one row a key, join the result."""
        s, as_of = self.settings, F.lit(self.settings.as_of)
        lines = self.stg_orders.select("customer_key", "order_id", "order_date", "line_total", "profit_amount", "profit_margin_pct", "product_key")
        orders = lines.groupBy("customer_key", "order_id", "order_date").agg(*_parts("line_total", "profit_amount", "profit_margin_pct"))
        m = orders.groupBy("customer_key").agg(
            F.count("order_id").alias("total_orders"), _n("order_date").alias("unique_order_days"), F.min("order_date").alias("first_order_date"), F.max("order_date").alias("last_order_date"),
            _sum("line_total").alias("lifetime_value"), _sum("profit_amount").alias("lifetime_profit"), _mean("line_total").alias("avg_order_value"), F.round(_mean("profit_margin_pct"), 6).alias("avg_profit_margin"),
        )
        bought = lines.select("customer_key", "product_key").distinct().join(self.stg_products.select("product_key", "category_name"), "product_key", "left")
        bought = bought.groupBy("customer_key").agg(F.count("product_key").alias("unique_products_purchased"), _n("category_name").alias("unique_categories"))
        m = m.join(bought, "customer_key")
        c = self.stg_customers.select("customer_key", "customer_id", F.col("full_name").alias("customer_name"), F.col("email").alias("customer_email"), F.col("segment").alias("customer_segment"), F.col("tier").alias("customer_tier"), "registration_date")
        m = m.join(c, "customer_key", "left")
        m = m.withColumns({"customer_tenure_days": F.datediff("last_order_date", "first_order_date"), "days_since_last_order": F.datediff(as_of, "last_order_date")})
        m = m.withColumns({
            "recency_score": ladder(F.col("days_since_last_order"), RECENCY, 1, above=False), "frequency_score": ladder(F.col("total_orders"), FREQUENCY, 1),
            "monetary_score": ladder(F.col("lifetime_value"), [(s.vip, 5), (s.gold, 4), (s.silver, 3), (500, 2)], 1),
        })
        return m.withColumn("rfm_score", F.expr("recency_score + frequency_score + monetary_score"))

    @cached_property
    def product_metrics(self) -> DataFrame:
        parts = _parts("line_total", "profit_amount", "profit_margin_pct", "effective_unit_price", "discount_percent", "quantity")
        orders = self.stg_orders.groupBy("product_key", "order_id", "customer_key", "order_date").agg(*parts, F.max("effective_unit_price").alias("high"), F.min("effective_unit_price").alias("low"))
        m = orders.groupBy("product_key").agg(
            F.count("order_id").alias("times_ordered"), F.sum("quantity").alias("total_units_sold"), _sum("line_total").alias("total_revenue"), _sum("profit_amount").alias("total_profit"),
            F.round(_mean("profit_margin_pct"), 6).alias("avg_margin_pct"), _n("customer_key").alias("unique_customers"), F.round(_mean("effective_unit_price"), 6).alias("avg_selling_price"),
            _mean("discount_percent").alias("avg_discount_pct"), F.max("high").alias("max_selling_price"), F.min("low").alias("min_selling_price"), F.min("order_date").alias("first_sale_date"), F.max("order_date").alias("last_sale_date"),
        )
        p = self.stg_products.select("product_key", "product_name", "sku", "category_name", "category_path", "margin_category", F.col("price").alias("current_product_price"), F.col("cost").alias("current_product_cost"))
        return m.join(p, "product_key", "left")

    # ---- marts ----

    def sales_daily_of(self, orders: DataFrame) -> DataFrame:
        """Day grain of some staged lines. Lines first come down to orders, each of one day, customer and way
        of paying, so that orders are counted without expanding lines once per distinct count; the customer's
        tier then joins orders, and the calendar, one row a day, joins the result."""
        vip, paid = F.col("customer_tier") == "VIP", lambda x: F.count(F.when(F.col("payment_method") == x, F.col("order_id")))
        tier = self.stg_customers.select("customer_key", F.col("tier").alias("customer_tier"))
        parts = _parts("line_total", "gross_amount", "discount_amount", "profit_amount", "quantity", "profit_margin_pct")
        each = orders.groupBy("date_key", "order_id", "customer_key", "payment_method").agg(*parts).join(tier, "customer_key", "left")
        m = each.groupBy("date_key").agg(
            F.count("order_id").alias("total_orders"), _n("customer_key").alias("unique_customers"), _sum("line_total").alias("total_revenue"),
            _sum("gross_amount").alias("total_gross_revenue"), _sum("discount_amount").alias("total_discounts"), _sum("profit_amount").alias("total_profit"), F.sum("quantity").alias("total_quantity"),
            _mean("quantity").alias("avg_items_per_order"), _mean("line_total").alias("avg_order_value"), F.round(_mean("profit_margin_pct"), 6).alias("avg_profit_margin"),
            _n(F.when(vip, F.col("customer_key"))).alias("vip_customers"), money(F.sum(F.when(vip, F.col("line_total")).otherwise(F.lit(0)))).alias("vip_revenue"),
            *(paid(x).alias(f"{x}_orders") for x in ("credit_card", "debit_card", "paypal")),
        )
        products = orders.select("date_key", "product_key").distinct().groupBy("date_key").agg(F.count("product_key").alias("unique_products"))
        m = m.join(products, "date_key")
        d = self.stg_dates.select("date_key", "date", "year", "month", "quarter", "year_month", "year_quarter", "is_weekend", "is_holiday")
        return m.join(d, "date_key", "left").withColumns({
            "day_type": F.when(F.col("is_weekend") == 1, "Weekend").otherwise("Weekday"),
            "day_category": F.when(F.col("is_holiday") == 1, "Holiday").when(F.col("is_weekend") == 1, "Weekend").otherwise("Regular"),
        })

    @cached_property
    def sales_daily(self) -> DataFrame:
        return self.sales_daily_of(self.stg_orders)

    def sales_daily_since(self, loaded_to: int | None, lookback_days: int = 0) -> DataFrame:
        """Days after the last loaded one; with a lookback also that many days before it, to be replaced."""
        if loaded_to is None:
            return self.sales_daily
        after = F.date_format(F.date_sub(F.to_date(F.lit(str(loaded_to)), "yyyyMMdd"), lookback_days), "yyyyMMdd").cast("int")
        return self.sales_daily_of(self.stg_orders.where(F.col("date_key") > after))

    @cached_property
    def customer_enriched(self) -> DataFrame:
        s = self.settings
        m = self.customer_metrics.drop("customer_id", "customer_name", "customer_email", "customer_segment", "customer_tier", "registration_date")
        c = self.stg_customers.withColumnsRenamed({"segment": "original_segment", "tier": "original_tier"}).drop("tier_rank")
        days = F.col("days_since_last_order")
        return c.join(m, "customer_key", "left").withColumns({
            "calculated_tier": ladder(F.col("lifetime_value"), [(s.vip, "VIP"), (s.gold, "Gold"), (s.silver, "Silver")], "Bronze"),
            "lifecycle_stage": F.when(F.col("total_orders") == 1, "New").otherwise(ladder(days, LIFECYCLE, "Churned", above=False)),
            "rfm_segment": ladder(F.col("rfm_score"), SEGMENT_CORE, "Lost"),
            "missing_email_flag": F.col("email").isNull().cast("int"), "negative_ltv_flag": F.coalesce(F.col("lifetime_value") < 0, F.lit(False)).cast("int"),
        })

    @cached_property
    def product_enriched(self) -> DataFrame:
        m = self.product_metrics.drop("product_name", "sku", "category_name", "category_path", "margin_category", "current_product_price", "current_product_cost")
        price = F.col("price").cast("double")
        return self.stg_products.join(m, "product_key", "left").withColumns({
            "performance_tier": ladder(F.col("total_revenue"), PERFORMANCE, "Low Volume"),
            "price_position": F.when(F.col("avg_selling_price") >= price * 0.95, "Premium").when(F.col("avg_selling_price") >= price * 0.8, "Standard").otherwise("Discounted"),
            "velocity_category": F.when(F.col("times_ordered").isNull(), "No Sales").otherwise(ladder(F.col("times_ordered"), VELOCITY, "Slow Moving")),
        })

    @cached_property
    def monthly_financials(self) -> DataFrame:
        """Month grain over the daily mart. ``unique_customers`` adds up daily distinct counts, as defined;
        ``distinct_customers`` is the true number."""
        keys = ["year", "month", "year_month", "year_quarter"]
        total = lambda c: F.sum(c).cast("bigint")
        m = self.sales_daily.groupBy(*keys).agg(
            _sum("total_revenue").alias("revenue"), _sum("total_gross_revenue").alias("gross_revenue"), _sum("total_discounts").alias("discounts"), _sum("total_profit").alias("gross_profit"),
            total("total_orders").alias("orders"), total("total_quantity").alias("units_sold"), total("unique_customers").alias("unique_customers"),
            mean(F.col("avg_order_value").cast("decimal(28,9)")).alias("avg_order_value"), mean(F.col("avg_profit_margin").cast("decimal(18,6)")).alias("avg_profit_margin"), total("vip_customers").alias("vip_customers"),
            _sum("vip_revenue").alias("vip_revenue"), *(total(f"{x}_orders").alias(f"{x}_orders") for x in ("credit_card", "debit_card", "paypal")),
        )
        m = m.withColumns({"gross_margin_pct": ratio(F.col("gross_profit"), F.col("revenue")), "discount_rate": ratio(F.col("discounts"), F.col("gross_revenue")), "vip_revenue_pct": ratio(F.col("vip_revenue"), F.col("revenue"))})
        order = Window.orderBy("year_month")  # one row per month: small, whatever the fact table's size
        m = m.withColumns({"revenue_mom_change": money(F.col("revenue") - F.lag("revenue").over(order)), "orders_mom_change": F.col("orders") - F.lag("orders").over(order)})
        true = self.stg_orders.groupBy(F.date_format("order_date", "yyyy-MM").alias("year_month")).agg(_n("customer_key").alias("distinct_customers"))
        return m.join(true, "year_month")

    @cached_property
    def customer_cohort(self) -> DataFrame:
        o = self.stg_orders.select("customer_key", "order_id", "line_total", F.col("order_date").alias("date"))
        first = o.groupBy("customer_key").agg(month_start(F.min("date")).alias("cohort_month"))
        sizes = first.groupBy("cohort_month").agg(F.count("*").alias("cohort_size"))
        # Lines come down to one row per customer, month and order before they meet the cohorts.
        per = o.withColumn("activity_month", month_start("date")).groupBy("customer_key", "activity_month", "order_id").agg(F.sum("line_total").alias("v"))
        per = per.groupBy("customer_key", "activity_month").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
        a = per.join(first, "customer_key").groupBy("cohort_month", months_apart("cohort_month", "activity_month").alias("period_number"))
        a = a.agg(F.count("*").alias("active_customers"), _sum("v").alias("revenue"), F.sum("n").cast("bigint").alias("orders"))
        return a.join(F.broadcast(sizes), "cohort_month").withColumns({  # one row per month
            "retention_rate": ratio(F.col("active_customers"), F.col("cohort_size")), "revenue_per_customer": ratio(F.col("revenue"), F.col("active_customers")),
            "orders_per_customer": ratio(F.col("orders"), F.col("active_customers")),
        }).orderBy("cohort_month", "period_number")

    @cached_property
    def customer_rfm(self) -> DataFrame:
        s, score, days = self.settings, F.col("rfm_score"), F.col("days_since_last_order")
        risk = F.when(days > 180, "High Risk").when(days > 90, "Medium Risk").when(days > 30, "Low Risk").otherwise("Active")
        return self.customer_metrics.select(
            "customer_key", "customer_id", "customer_name", "customer_email", "customer_segment", "registration_date", "recency_score", "frequency_score", "monetary_score", "rfm_score",
            ladder(score, SEGMENT_RFM, "At Risk").alias("rfm_segment"), ladder(score, ACTION_RFM, ACTION_OTHER).alias("recommended_action"), ladder(score, PRIORITY, "Low").alias("campaign_priority"),
            ladder(F.col("lifetime_value"), [(s.vip, "VIP"), (s.gold, "High Value"), (s.silver, "Medium Value")], "Low Value").alias("value_tier"), risk.alias("churn_risk"),
            "total_orders", "lifetime_value", "lifetime_profit", "avg_order_value", "days_since_last_order", "unique_products_purchased",
        )

    def product_affinity(self, key: str = "brand", category: str | None = None) -> DataFrame:
        """Pairs of products (or of another attribute of theirs) ordered together. Each order's distinct keys
        are paired within the order alone, so the join grows with lines per order, not with the table."""
        category = category or key
        p = self.stg_products.select("product_key", F.col(key).alias("k"), F.col(category).alias("c"))
        o = self.stg_orders.select("order_id", "product_key").join(p, "product_key").select("order_id", "k", "c").distinct()
        b = o.select("order_id", F.col("k").alias("k2"), F.col("c").alias("c2"))
        pairs = o.join(b, "order_id").where("k < k2").groupBy(F.col("k").alias("a_key"), F.col("c").alias("a_category"), F.col("k2").alias("b_key"), F.col("c2").alias("b_category"))
        pairs = pairs.agg(F.count("*").alias("co_occurrence_count")).where(F.col("co_occurrence_count") >= self.settings.pair_orders)
        total = o.groupBy(F.col("k").alias("a_key")).agg(_n("order_id").alias("orders_a"))
        out = pairs.join(total, "a_key").withColumn("confidence_a_to_b", ratio(F.col("co_occurrence_count"), F.col("orders_a"))).drop("orders_a")
        out = out.where(F.col("confidence_a_to_b") >= self.settings.pair_confidence)
        return out.withColumns({"recommendation_strength": ladder(F.col("confidence_a_to_b"), STRENGTH, "Very Weak"), "cross_category": (F.col("a_category") != F.col("b_category")).cast("int")}).orderBy(F.desc("co_occurrence_count"))

    @cached_property
    def ltv_distribution(self) -> DataFrame:
        return self.ltv_in(LTV_BUCKETS, "< $100")

    @cached_property
    def ltv_distribution_scaled(self) -> DataFrame:
        """The same over bounds that fit these tables' larger values."""
        return self.ltv_in(LTV_SCALED, "< $50K")

    def ltv_in(self, buckets: list[tuple[int, str]], other: str) -> DataFrame:
        bucket = ladder(F.col("lifetime_value"), buckets, other)
        return self.customer_metrics.groupBy(bucket.alias("ltv_bucket")).agg(
            F.count("*").alias("customer_count"), mean("total_orders").alias("avg_orders"), mean("days_since_last_order").alias("avg_days_since_order"), F.min("lifetime_value").alias("lowest"),
        ).orderBy("lowest").drop("lowest")

    # ---- summary tables ----

    @cached_property
    def daily_summary(self) -> DataFrame:
        return self.stg_orders.groupBy("date_key").agg(_sum("line_total").alias("total_amount"), F.count("order_id").alias("order_lines"), _n("customer_key").alias("unique_customers"))

    @cached_property
    def weekly_ltv(self) -> DataFrame:
        """Weeks start on Monday. ``lifetime_value`` adds up to the week's end; a customer has one row a week."""
        o = self.stg_orders.withColumn("week_start", F.to_date(F.date_trunc("week", "order_date")))
        m = o.groupBy("customer_key", "week_start").agg(
            _sum("line_total").alias("weekly_spend"), _n("order_id").alias("weekly_orders"), F.sum("quantity").alias("weekly_quantity"), mean("line_total").alias("avg_order_value"),
            F.datediff(F.lit(self.settings.as_of), F.max("order_date")).alias("days_since_last_order"),
        )
        so_far = Window.partitionBy("customer_key").orderBy("week_start").rowsBetween(Window.unboundedPreceding, 0)
        m = m.withColumns({"lifetime_value": money(F.sum("weekly_spend").over(so_far)), "week_key": F.date_format("week_start", "yyyyMMdd").cast("int")})
        return m.join(self.stg_customers.select("customer_key", F.col("segment").alias("customer_segment")), "customer_key", "left")

    @cached_property
    def monthly_product(self) -> DataFrame:
        o = self.stg_orders.withColumn("month_start", month_start("order_date"))
        returned = F.sum((F.col("order_status") == "P").cast("bigint"))
        out = o.groupBy("month_start", "product_key").agg(
            F.sum("quantity").alias("units_sold"), _sum("line_total").alias("revenue"), _sum("cost_amount").alias("cost"), _sum("profit_amount").alias("profit"),
            ratio(F.sum("line_total"), F.sum("quantity")).alias("avg_selling_price"), mean("discount_percent").alias("discount_rate"), ratio(returned, F.count("*")).alias("open_rate"),
            ratio(F.sum((F.col("return_flag") == "R").cast("bigint")), F.count("*")).alias("return_rate"), F.min("vendor_key").alias("vendor_key"),
        )
        out = out.join(self.stg_products.select("product_key", "product_name", "category_name"), "product_key", "left")
        return out.join(self.star.dim_vendor.select("vendor_key", F.col("name").alias("vendor_name")), "vendor_key", "left")

    @cached_property
    def vendor_performance(self) -> DataFrame:
        o = self.stg_orders.withColumn("month_start", month_start("order_date"))
        out = o.groupBy("month_start", "vendor_key").agg(_n("order_id").alias("total_orders"), _sum("line_total").alias("total_revenue"), _sum("cost_amount").alias("total_cost"), _sum("profit_amount").alias("total_profit"), _n("product_key").alias("unique_products"), mean(F.datediff("ship_date", "order_date")).alias("avg_lead_days"))
        return out.join(self.star.dim_vendor.select("vendor_key", F.col("name").alias("vendor_name")), "vendor_key", "left")
