"""The models in DuckDB SQL, as common table expressions that name each other."""

from __future__ import annotations

import re

from tidemill.plans import models as m
from tidemill.plans import star

AS_OF = "date '2001-08-02'"


def _text(x) -> str:
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def case(value: str, steps, other, op: str = ">=") -> str:
    return "CASE " + " ".join(f"WHEN {value} {op} {_text(b)} THEN {_text(x)}" for b, x in steps) + f" ELSE {_text(other)} END"


def total(x: str, name: str) -> str:
    return f"cast(sum({x}) AS decimal(18,2)) AS {name}"


def whole(x: str, name: str) -> str:
    return f"cast(sum({x}) AS bigint) AS {name}"


def mean(x: str, name: str) -> str:
    return f"cast(sum({x}) AS double) / nullif(cast(count({x}) AS double), 0) AS {name}"


def div(a: str, b: str) -> str:
    return f"cast({a} AS double) / nullif(cast({b} AS double), 0)"


DAY = "date_key, date, year, month, quarter, year_month, year_quarter, is_weekend, is_holiday"

CTE = star.SQL | {
    "stg_orders": f"SELECT *, {div('line_total', 'quantity')} AS effective_unit_price, {div('profit_amount', 'line_total')} AS profit_margin_pct FROM fact_orders",
    "stg_customers": "SELECT *, first_name || ' ' || last_name AS display_name, CASE tier WHEN 'VIP' THEN 4 WHEN 'Gold' THEN 3 WHEN 'Silver' THEN 2 ELSE 1 END AS tier_rank FROM dim_customer WHERE is_current = 1",
    "stg_products": f"SELECT * EXCLUDE (name), name AS product_name, {case('margin', m.MARGIN, 'Loss Leader', '>')} AS margin_category, cast(price - cost AS decimal(10,2)) AS absolute_margin FROM dim_product WHERE is_current = 1",
    "stg_dates": "SELECT *, 'Q' || quarter AS quarter_label, year AS calendar_year, month AS calendar_month, day_of_week AS day_of_week_num FROM dim_date",
    "enriched": """SELECT o.*, d.* EXCLUDE (date_key), customer_id, c.full_name AS customer_name, c.email AS customer_email, c.segment AS customer_segment, c.tier AS customer_tier, tier_rank, registration_date,
    product_name, sku, category_name, category_path, margin_category, p.price AS current_product_price, p.cost AS current_product_cost, brand, v.name AS vendor_name, v.status AS vendor_status
  FROM stg_orders o LEFT JOIN (SELECT date_key, date, year, month, quarter, year_month, year_quarter, is_weekend, is_holiday FROM stg_dates) d USING (date_key)
    LEFT JOIN stg_customers c USING (customer_key) LEFT JOIN stg_products p USING (product_key) LEFT JOIN dim_vendor v USING (vendor_key)""",
    "customer_metrics": f"""SELECT *, recency_score + frequency_score + monetary_score AS rfm_score FROM (SELECT *, {case('days_since_last_order', m.RECENCY, 1, '<=')} AS recency_score,
    {case('total_orders', m.FREQUENCY, 1)} AS frequency_score, {case('lifetime_value', [(10000, 5), (5000, 4), (1000, 3), (500, 2)], 1)} AS monetary_score
  FROM (SELECT *, cast(date_diff('day', first_order_date, last_order_date) AS int) AS customer_tenure_days, cast(date_diff('day', last_order_date, {AS_OF}) AS int) AS days_since_last_order
    FROM (SELECT customer_key, customer_id, customer_name, customer_email, customer_segment, customer_tier, registration_date, count(DISTINCT order_id) AS total_orders, count(DISTINCT date) AS unique_order_days,
        min(date) AS first_order_date, max(date) AS last_order_date, {total('line_total', 'lifetime_value')}, {total('profit_amount', 'lifetime_profit')}, {mean('line_total', 'avg_order_value')},
        round(avg(profit_margin_pct), 6) AS avg_profit_margin, count(DISTINCT product_key) AS unique_products_purchased, count(DISTINCT category_name) AS unique_categories
      FROM enriched GROUP BY ALL)))""",
    "product_metrics": f"""SELECT product_key, product_name, sku, category_name, category_path, margin_category, current_product_price, current_product_cost, count(DISTINCT order_id) AS times_ordered,
    {whole('quantity', 'total_units_sold')}, {total('line_total', 'total_revenue')}, {total('profit_amount', 'total_profit')}, round(avg(profit_margin_pct), 6) AS avg_margin_pct, count(DISTINCT customer_key) AS unique_customers,
    round(avg(effective_unit_price), 6) AS avg_selling_price, {mean('discount_percent', 'avg_discount_pct')}, max(effective_unit_price) AS max_selling_price, min(effective_unit_price) AS min_selling_price,
    min(date) AS first_sale_date, max(date) AS last_sale_date
  FROM enriched GROUP BY ALL""",
    "sales_daily": f"""SELECT *, CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS day_type, CASE WHEN is_holiday = 1 THEN 'Holiday' WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Regular' END AS day_category
  FROM (SELECT {DAY}, count(DISTINCT order_id) AS total_orders, count(DISTINCT customer_key) AS unique_customers, count(DISTINCT product_key) AS unique_products, {total('line_total', 'total_revenue')},
      {total('gross_amount', 'total_gross_revenue')}, {total('discount_amount', 'total_discounts')}, {total('profit_amount', 'total_profit')}, {whole('quantity', 'total_quantity')},
      {mean('quantity', 'avg_items_per_order')}, {mean('line_total', 'avg_order_value')}, round(avg(profit_margin_pct), 6) AS avg_profit_margin,
      count(DISTINCT CASE WHEN customer_tier = 'VIP' THEN customer_key END) AS vip_customers, {total("CASE WHEN customer_tier = 'VIP' THEN line_total ELSE 0 END", 'vip_revenue')},
      {', '.join(f"count(DISTINCT CASE WHEN payment_method = '{x}' THEN order_id END) AS {x}_orders" for x in ('credit_card', 'debit_card', 'paypal'))}
    FROM enriched GROUP BY {DAY})""",
    "customer_enriched": f"""SELECT c.* EXCLUDE (segment, tier, tier_rank), c.segment AS original_segment, c.tier AS original_tier, x.* EXCLUDE (customer_key, customer_id, customer_name, customer_email, customer_segment, customer_tier, registration_date),
    {case('lifetime_value', [(10000, 'VIP'), (5000, 'Gold'), (1000, 'Silver')], 'Bronze')} AS calculated_tier,
    CASE WHEN total_orders = 1 THEN 'New' ELSE {case('days_since_last_order', m.LIFECYCLE, 'Churned', '<=')} END AS lifecycle_stage, {case('rfm_score', m.SEGMENT_CORE, 'Lost')} AS rfm_segment,
    cast(email IS NULL AS int) AS missing_email_flag, cast(coalesce(lifetime_value < 0, false) AS int) AS negative_ltv_flag
  FROM stg_customers c LEFT JOIN customer_metrics x USING (customer_key)""",
    "product_enriched": f"""SELECT p.*, x.* EXCLUDE (product_key, product_name, sku, category_name, category_path, margin_category, current_product_price, current_product_cost),
    {case('total_revenue', m.PERFORMANCE, 'Low Volume')} AS performance_tier,
    CASE WHEN avg_selling_price >= cast(price AS double) * 0.95::double THEN 'Premium' WHEN avg_selling_price >= cast(price AS double) * 0.8::double THEN 'Standard' ELSE 'Discounted' END AS price_position,
    CASE WHEN times_ordered IS NULL THEN 'No Sales' ELSE {case('times_ordered', m.VELOCITY, 'Slow Moving')} END AS velocity_category
  FROM stg_products p LEFT JOIN product_metrics x USING (product_key)""",
    "monthly_financials": f"""SELECT a.*, distinct_customers FROM (
    SELECT *, {div('gross_profit', 'revenue')} AS gross_margin_pct, {div('discounts', 'gross_revenue')} AS discount_rate, {div('vip_revenue', 'revenue')} AS vip_revenue_pct,
      cast(revenue - lag(revenue) OVER (ORDER BY year_month) AS decimal(18,2)) AS revenue_mom_change, orders - lag(orders) OVER (ORDER BY year_month) AS orders_mom_change
    FROM (SELECT year, month, year_month, year_quarter, {total('total_revenue', 'revenue')}, {total('total_gross_revenue', 'gross_revenue')}, {total('total_discounts', 'discounts')}, {total('total_profit', 'gross_profit')},
        {whole('total_orders', 'orders')}, {whole('total_quantity', 'units_sold')}, {whole('unique_customers', 'unique_customers')}, {mean('cast(avg_order_value AS decimal(28,9))', 'avg_order_value')}, {mean('cast(avg_profit_margin AS decimal(18,6))', 'avg_profit_margin')},
        {whole('vip_customers', 'vip_customers')}, {total('vip_revenue', 'vip_revenue')}, {', '.join(whole(f'{x}_orders', f'{x}_orders') for x in ('credit_card', 'debit_card', 'paypal'))}
      FROM sales_daily GROUP BY ALL)) a JOIN (SELECT year_month, count(DISTINCT customer_key) AS distinct_customers FROM enriched GROUP BY 1) USING (year_month)""",
    "cohort_first": "SELECT customer_key, cast(date_trunc('month', min(date)) AS date) AS cohort_month FROM enriched GROUP BY 1",
    "customer_cohort": f"""SELECT cohort_month, period_number, active_customers, revenue, orders, cohort_size, {div('active_customers', 'cohort_size')} AS retention_rate, {div('revenue', 'active_customers')} AS revenue_per_customer, {div('orders', 'active_customers')} AS orders_per_customer
  FROM (SELECT cohort_month, cast(date_diff('month', cohort_month, cast(date_trunc('month', date) AS date)) AS int) AS period_number, count(DISTINCT customer_key) AS active_customers, {total('line_total', 'revenue')}, count(DISTINCT order_id) AS orders
    FROM enriched JOIN cohort_first USING (customer_key) GROUP BY 1, 2) JOIN (SELECT cohort_month, count(*) AS cohort_size FROM cohort_first GROUP BY 1) USING (cohort_month)""",
    "customer_rfm": f"""SELECT customer_key, customer_id, customer_name, customer_email, customer_segment, registration_date, recency_score, frequency_score, monetary_score, rfm_score,
    {case('rfm_score', m.SEGMENT_RFM, 'At Risk')} AS rfm_segment, {case('rfm_score', m.ACTION_RFM, m.ACTION_OTHER)} AS recommended_action, {case('rfm_score', m.PRIORITY, 'Low')} AS campaign_priority,
    {case('lifetime_value', [(10000, 'VIP'), (5000, 'High Value'), (1000, 'Medium Value')], 'Low Value')} AS value_tier, {case('days_since_last_order', [(180, 'High Risk'), (90, 'Medium Risk'), (30, 'Low Risk')], 'Active', '>')} AS churn_risk,
    total_orders, lifetime_value, lifetime_profit, avg_order_value, days_since_last_order, unique_products_purchased FROM customer_metrics""",
    "product_affinity": f"""SELECT a_key, a_category, b_key, b_category, co_occurrence_count, confidence_a_to_b, {case('confidence_a_to_b', m.STRENGTH, 'Very Weak')} AS recommendation_strength, cast(a_category <> b_category AS int) AS cross_category
  FROM (SELECT *, {div('co_occurrence_count', 'n')} AS confidence_a_to_b
    FROM (SELECT a.k AS a_key, a.k AS a_category, b.k AS b_key, b.k AS b_category, count(*) AS co_occurrence_count FROM ordered a JOIN ordered b ON a.order_id = b.order_id AND a.k < b.k GROUP BY ALL HAVING count(*) >= 10)
    JOIN (SELECT k AS a_key, count(*) AS n FROM ordered GROUP BY 1) USING (a_key)) WHERE confidence_a_to_b >= 0.1""",
    "ordered": "SELECT DISTINCT order_id, brand AS k FROM enriched",
    "ltv_distribution": f"SELECT {case('lifetime_value', m.LTV_BUCKETS, '< $100')} AS ltv_bucket, count(*) AS customer_count, {mean('total_orders', 'avg_orders')}, {mean('days_since_last_order', 'avg_days_since_order')} FROM customer_metrics GROUP BY 1",
    "ltv_distribution_scaled": f"SELECT {case('lifetime_value', m.LTV_SCALED, '< $50K')} AS ltv_bucket, count(*) AS customer_count, {mean('total_orders', 'avg_orders')}, {mean('days_since_last_order', 'avg_days_since_order')} FROM customer_metrics GROUP BY 1",
    "daily_summary": f"SELECT date_key, {total('line_total', 'total_amount')}, count(order_id) AS order_lines, count(DISTINCT customer_key) AS unique_customers FROM stg_orders GROUP BY 1",
    "weekly_ltv": f"""SELECT w.*, cast(sum(weekly_spend) OVER (PARTITION BY customer_key ORDER BY week_start) AS decimal(18,2)) AS lifetime_value, cast(strftime(week_start, '%Y%m%d') AS int) AS week_key, segment AS customer_segment
  FROM (SELECT customer_key, cast(date_trunc('week', order_date) AS date) AS week_start, {total('line_total', 'weekly_spend')}, count(DISTINCT order_id) AS weekly_orders, {whole('quantity', 'weekly_quantity')}, {mean('line_total', 'avg_order_value')},
    cast(date_diff('day', max(order_date), {AS_OF}) AS int) AS days_since_last_order FROM stg_orders GROUP BY 1, 2) w
  LEFT JOIN stg_customers USING (customer_key)""",
    "monthly_product": f"""SELECT cast(date_trunc('month', date) AS date) AS month_start, product_key, product_name, category_name, {whole('quantity', 'units_sold')}, {total('line_total', 'revenue')}, {total('cost_amount', 'cost')}, {total('profit_amount', 'profit')},
    {div('sum(line_total)', 'sum(quantity)')} AS avg_selling_price, {mean('discount_percent', 'discount_rate')}, {div("count(*) FILTER (order_status = 'P')", 'count(*)')} AS open_rate,
    {div("count(*) FILTER (return_flag = 'R')", 'count(*)')} AS return_rate, min(vendor_key) AS vendor_key, (SELECT name FROM dim_vendor v WHERE v.vendor_key = min(enriched.vendor_key)) AS vendor_name FROM enriched GROUP BY 1, 2, 3, 4""",
    "vendor_performance": f"SELECT cast(date_trunc('month', date) AS date) AS month_start, vendor_key, vendor_name, count(DISTINCT order_id) AS total_orders, {total('line_total', 'total_revenue')}, {total('cost_amount', 'total_cost')}, {total('profit_amount', 'total_profit')}, count(DISTINCT product_key) AS unique_products, {mean("date_diff('day', date, ship_date)", 'avg_lead_days')} FROM enriched GROUP BY 1, 2, 3",
}


def query(body: str) -> str:
    """A statement with the expressions that its body names, and theirs, in order."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in CTE:
            if name not in order and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", text):
                need(CTE[name])
                order.append(name)

    need(body)
    return ("WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in order) + "\n" if order else "") + body


def model(name: str) -> str:
    return query(f"SELECT * FROM {name}")


def affinity(key: str, name: str, above: int) -> str:
    """Pairs of products in more than ``above`` orders, as ``jobs.product_pairs`` gives them."""
    return f"""SELECT product_a, product_b, co_occurrence_count, a.{name} AS name_a, a.category_name AS category_a, b.{name} AS name_b, b.category_name AS category_b, confidence_a_to_b,
  {case('confidence_a_to_b', m.STRENGTH, 'Very Weak')} AS recommendation_strength, cast(a.category_name <> b.category_name AS int) AS cross_category
FROM (SELECT product_a, product_b, co_occurrence_count, {div('co_occurrence_count', 'orders_a')} AS confidence_a_to_b
  FROM (SELECT x.{key} AS product_a, y.{key} AS product_b, count(*) AS co_occurrence_count FROM (SELECT DISTINCT order_id, {key} FROM fact_orders) x JOIN (SELECT DISTINCT order_id, {key} FROM fact_orders) y
    ON x.order_id = y.order_id AND x.{key} < y.{key} GROUP BY 1, 2 HAVING count(*) > {above})
  JOIN (SELECT {key} AS product_a, count(DISTINCT order_id) AS orders_a FROM fact_orders GROUP BY 1) USING (product_a))
JOIN stg_products a ON a.{key} = product_a JOIN stg_products b ON b.{key} = product_b"""
