"""The 41 business reports."""

from __future__ import annotations

from tallymart.catalog.base_sql import big, flat, money, pct, tables
from tallymart.plans import customers, overview, products, trends

REVENUE = money("SUM(sales)") + " AS revenue"
PROFIT = money("SUM(profit)") + " AS profit"
MARGIN = pct("SUM(profit)", "SUM(sales)") + " AS margin_pct"
MEAN_MARGIN = "ROUND(AVG(profit_margin) * 100, 2) AS avg_margin_pct"

# All categories of the star data, each a column of the region matrix.
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
MATRIX = {category: f"{category.lower()}_revenue" for category in CATEGORIES}

MONTHLY = """monthly AS (
  SELECT order_month, SUM(sales) AS amount FROM flat GROUP BY order_month)"""

SPEND = """spend AS (
  SELECT customer_id, customer_name, segment, SUM(sales) AS amount
  FROM flat GROUP BY customer_id, customer_name, segment)"""

RFM = """rfm AS (
  SELECT customer_id, customer_name,
         CAST((SELECT MAX(order_date) FROM kept) - MAX(order_date) AS INTEGER) AS recency_days,
         COUNT(DISTINCT order_id) AS frequency, SUM(sales) AS amount
  FROM flat GROUP BY customer_id, customer_name)"""

SCORED = """scored AS (
  SELECT *,
    CAST(NTILE(5) OVER (ORDER BY recency_days, customer_id) AS INTEGER) AS r_score,
    CAST(NTILE(5) OVER (ORDER BY frequency DESC, customer_id) AS INTEGER) AS f_score,
    CAST(NTILE(5) OVER (ORDER BY amount DESC, customer_id) AS INTEGER) AS m_score
  FROM rfm)"""


def _growth(over: str) -> str:
    before = f"LAG(amount) OVER ({over})"
    return pct(f"(amount - {before})", before)


ENTRIES = {
    "q01_headline_kpis": (overview.headline_kpis, flat(f"""
        SELECT {money("SUM(sales)")} AS total_revenue, {money("SUM(profit)")} AS total_profit,
               {pct("SUM(profit)", "SUM(sales)")} AS profit_margin_pct,
               COUNT(DISTINCT order_id) AS total_orders,
               ROUND(CAST(SUM(sales) AS DOUBLE) / NULLIF(COUNT(DISTINCT order_id), 0), 2)
                 AS avg_order_value
        FROM flat""")),
    "q02_category_revenue": (lambda m: overview.profitability_by(m, "category_name"), flat(f"""
        SELECT category_name, COUNT(*) AS line_items, {REVENUE}, {PROFIT}, {MARGIN}
        FROM flat GROUP BY category_name""")),
    "q03_region_revenue": (lambda m: overview.profitability_by(m, "region_name"), flat(f"""
        SELECT region_name, COUNT(*) AS line_items, {REVENUE}, {PROFIT}, {MARGIN}
        FROM flat GROUP BY region_name""")),
    "q04_discount_profile": (overview.discount_profile, flat(f"""
        SELECT ROUND(AVG(CAST(discount AS DOUBLE)), 4) AS avg_discount,
               ROUND(AVG(profit_margin), 4) AS avg_margin,
               {money("MIN(discount)")} AS min_discount, {money("MAX(discount)")} AS max_discount
        FROM flat""")),
    "q05_thin_margin_subcategories": (overview.thin_margin_subcategories, flat(f"""
        SELECT subcategory_name, {REVENUE}, {MEAN_MARGIN}
        FROM flat GROUP BY subcategory_name HAVING AVG(profit_margin) < 0.08""")),
    "q06_frequent_customers": (customers.frequent_customers, flat(f"""
        SELECT customer_id, customer_name, segment, COUNT(DISTINCT order_id) AS order_count,
               {money("SUM(sales)")} AS lifetime_revenue
        FROM flat GROUP BY customer_id, customer_name, segment
        HAVING COUNT(DISTINCT order_id) > 3""")),
    "q07_broad_reach_products": (products.broad_reach_products, flat(f"""
        SELECT product_name, COUNT(DISTINCT order_id) AS distinct_orders,
               {big("SUM(quantity)")} AS total_units_sold
        FROM flat GROUP BY product_name HAVING COUNT(DISTINCT order_id) >= 5""")),
    "q08_loss_making_regions": (overview.loss_making, flat(f"""
        SELECT region_name, {REVENUE}, {PROFIT}
        FROM flat GROUP BY region_name HAVING SUM(profit) < 0""")),
    "q08b_loss_making_products": (lambda m: overview.loss_making(m, "product_id"), flat(f"""
        SELECT product_id, {REVENUE}, {PROFIT}
        FROM flat GROUP BY product_id HAVING SUM(profit) < 0""")),
    # Limits and names of the tiers.
    "q09_discount_tiers": (overview.discount_tiers, flat(f"""
        SELECT CASE WHEN discount > 0.20 THEN 'High (21%+)'
                    WHEN discount > 0.10 THEN 'Medium (11-20%)'
                    WHEN discount > 0 THEN 'Low (0-10%)' ELSE 'No discount' END AS discount_tier,
               COUNT(*) AS line_items, {REVENUE}, {MEAN_MARGIN}
        FROM flat GROUP BY 1""")),
    "q10_shipping_speed": (overview.shipping_speed, tables("""
        SELECT CASE WHEN days = 0 THEN 'Same day' WHEN days IN (1, 2, 3) THEN '1-3 days'
                    ELSE '4+ days' END AS shipping_speed,
               COUNT(*) AS order_count, ROUND(AVG(days), 2) AS avg_days_to_ship
        FROM gaps GROUP BY 1""",
        "gaps AS (SELECT ship_date - order_date AS days FROM t_orders)")),
    "q11_profitable_split": (overview.profitable_split, flat(f"""
        SELECT CASE WHEN profit < 0 THEN 'Loss-making' ELSE 'Profitable' END AS profitability,
               COUNT(*) AS line_items, {REVENUE}, {PROFIT},
               {pct("COUNT(*)", "(SELECT COUNT(*) FROM flat)")} AS pct_of_line_items
        FROM flat GROUP BY 1""")),
    "q12_category_month_share": (trends.category_month_share, flat(f"""
        SELECT order_month, category_name, {money("amount")} AS revenue,
               {pct("amount", "month_amount")} AS pct_of_month_revenue
        FROM cells JOIN months USING (order_month)""",
        """cells AS (SELECT order_month, category_name, SUM(sales) AS amount
                     FROM flat GROUP BY order_month, category_name)""",
        "months AS (SELECT order_month, SUM(sales) AS month_amount FROM flat GROUP BY order_month)")),
    "q13_top_products_in_context": (products.top_products_in_context, flat(f"""
        SELECT product_name, {money("SUM(profit)")} AS total_profit, category_name,
               subcategory_name
        FROM flat GROUP BY product_id, product_name, category_name, subcategory_name
        ORDER BY SUM(profit) DESC, product_id LIMIT 5""")),
    "q14_top_decile_customers": (customers.top_decile_customers, flat("""
        SELECT customer_id, customer_name, segment, CAST(amount AS DOUBLE) AS lifetime_spend
        FROM spend
        WHERE CAST(amount AS DOUBLE) >= (
          SELECT quantile_cont(CAST(amount AS DOUBLE), 0.9) FROM spend)""", SPEND)),
    "q15_spend_rank_in_segment": (customers.spend_rank_in_segment, flat(f"""
        SELECT segment, customer_name, {money("SUM(amount)")} AS total_spend,
               RANK() OVER (PARTITION BY segment ORDER BY SUM(amount) DESC)
                 AS spend_rank_in_segment
        FROM spend GROUP BY segment, customer_name""", SPEND)),
    "q16_latest_order": (customers.latest_order_per_customer, tables("""
        SELECT customer_name, order_id, order_date
        FROM t_orders JOIN t_customers USING (customer_id)
        QUALIFY row_number() OVER (
          PARTITION BY customer_id ORDER BY order_date DESC, order_id DESC) = 1""")),
    "q17_best_product_per_category": (products.best_product_per_category, flat(f"""
        SELECT category_name, product_name, {money("amount")} AS total_profit
        FROM cells AS c
        WHERE amount = (SELECT MAX(amount) FROM cells AS d
                        WHERE d.category_name = c.category_name)""",
        """cells AS (SELECT category_name, product_name, SUM(profit) AS amount
                     FROM flat GROUP BY category_name, product_name)""")),
    "q18_spend_quartiles": (customers.spend_quartiles, flat(f"""
        SELECT customer_name, {money("amount")} AS lifetime_spend,
               CAST(NTILE(4) OVER (ORDER BY amount DESC, customer_id) AS INTEGER)
                 AS spend_quartile
        FROM spend""", SPEND)),
    "q19_order_value_changes": (customers.order_value_changes, flat(f"""
        SELECT customer_name, order_date, {money("amount")} AS order_value,
               {money("before")} AS previous_order_value,
               {money("amount - before")} AS change_vs_previous
        FROM history""",
        """history AS (
             SELECT customer_name, order_date, SUM(sales) AS amount,
                    LAG(SUM(sales)) OVER (PARTITION BY customer_id
                                          ORDER BY order_date, order_id) AS before
             FROM flat GROUP BY customer_id, customer_name, order_date, order_id)""")),
    "q20_cumulative_revenue": (trends.cumulative_revenue, flat(f"""
        SELECT order_month, {money("amount")} AS revenue,
               {money("SUM(amount) OVER (ORDER BY order_month)")} AS cumulative_revenue
        FROM monthly""", MONTHLY)),
    "q21_rolling_revenue": (trends.rolling_revenue, flat(f"""
        SELECT order_month, {money("amount")} AS revenue,
               ROUND(CAST(SUM(amount) OVER last3 AS DOUBLE) / COUNT(*) OVER last3, 2)
                 AS rolling_3mo_avg
        FROM monthly
        WINDOW last3 AS (ORDER BY order_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
        MONTHLY)),
    "q22_cumulative_profit_by_category": (trends.cumulative_profit_by_category, flat(f"""
        SELECT order_month, category_name, {money("SUM(profit)")} AS profit,
               {money("SUM(SUM(profit)) OVER (PARTITION BY category_name ORDER BY order_month)")}
                 AS cumulative_profit
        FROM flat GROUP BY order_month, category_name""")),
    "q23_month_over_month": (
        lambda m: trends.revenue_growth(m, "order_month", "mom_growth_pct"), flat(f"""
        SELECT order_month, {money("amount")} AS revenue,
               {_growth("ORDER BY order_month")} AS mom_growth_pct
        FROM monthly""", MONTHLY)),
    "q24_year_over_year": (
        lambda m: trends.revenue_growth(m, "order_year", "yoy_growth_pct"), flat(f"""
        SELECT order_year, {money("amount")} AS revenue,
               {_growth("ORDER BY order_year")} AS yoy_growth_pct
        FROM (SELECT order_year, SUM(sales) AS amount FROM flat GROUP BY order_year) AS y""")),
    "q25_category_year_over_year": (trends.category_yoy_growth, flat(f"""
        SELECT order_year, category_name, {money("amount")} AS revenue,
               {_growth("PARTITION BY category_name ORDER BY order_year")} AS yoy_growth_pct
        FROM (SELECT order_year, category_name, SUM(sales) AS amount
              FROM flat GROUP BY order_year, category_name) AS y""")),
    "q26_segment_summary": (customers.segment_summary, flat(f"""
        SELECT segment, COUNT(DISTINCT order_id) AS order_count, {REVENUE}, {PROFIT}, {MARGIN},
               ROUND(CAST(SUM(sales) AS DOUBLE) / NULLIF(COUNT(DISTINCT order_id), 0), 2)
                 AS avg_order_value
        FROM flat GROUP BY segment""")),
    "q27_top_customers": (customers.top_customers, flat(f"""
        SELECT customer_name, segment, region_name AS most_recent_region,
               {money("SUM(sales)")} AS lifetime_revenue, COUNT(DISTINCT order_id) AS order_count
        FROM flat GROUP BY customer_id, customer_name, segment, region_name
        ORDER BY SUM(sales) DESC, customer_id, region_name LIMIT 10""")),
    "q28_new_vs_returning": (trends.new_vs_returning, flat(f"""
        SELECT order_month,
               CASE WHEN order_date > first_date THEN 'Returning' ELSE 'New' END AS customer_type,
               COUNT(DISTINCT order_id) AS order_count, {REVENUE}
        FROM (SELECT *, MIN(order_date) OVER (PARTITION BY customer_id) AS first_date
              FROM flat) AS f
        GROUP BY 1, 2""")),
    "q29_highest_margin_products": (products.highest_margin_products, flat(f"""
        SELECT product_name, {REVENUE}, {MEAN_MARGIN}
        FROM flat GROUP BY product_name HAVING SUM(sales) >= 500
        ORDER BY avg_margin_pct DESC, product_name LIMIT 10""")),
    "q30_worst_products": (products.worst_products, flat(f"""
        SELECT product_name, {REVENUE}, {money("SUM(profit)")} AS total_profit
        FROM flat GROUP BY product_name ORDER BY SUM(profit), product_name LIMIT 10""")),
    "q31_subcategory_share": (products.subcategory_share, flat(f"""
        SELECT category_name, subcategory_name, {REVENUE},
               {pct("SUM(sales)", "SUM(SUM(sales)) OVER (PARTITION BY category_name)")}
                 AS pct_of_category_revenue
        FROM flat GROUP BY category_name, subcategory_name""")),
    "q32_region_category_matrix": (
        lambda m: overview.region_category_matrix(m, MATRIX), flat(f"""
        SELECT region_name, {", ".join(
            money(f"COALESCE(SUM(sales) FILTER (WHERE category_name = '{c}'), 0)") + f" AS {name}"
            for c, name in MATRIX.items())}
        FROM flat GROUP BY region_name""")),
    "q33_best_state_per_region": (overview.best_state_per_region, flat(f"""
        SELECT region_name, state, {money("amount")} AS revenue
        FROM (SELECT region_name, state, SUM(sales) AS amount
              FROM flat GROUP BY region_name, state) AS s
        QUALIFY RANK() OVER (PARTITION BY region_name ORDER BY amount DESC) = 1""")),
    "q34_margin_by_ship_mode": (overview.margin_by_ship_mode, flat(f"""
        SELECT ship_mode, COUNT(DISTINCT order_id) AS order_count, {REVENUE}, {MARGIN}
        FROM flat GROUP BY ship_mode""")),
    "q35_profit_concentration": (products.profit_concentration, flat(f"""
        SELECT place AS product_rank, n AS total_product_count,
               {pct("place", "n", 1)} AS pct_of_products_so_far,
               {pct("running", "everything", 1)} AS pct_of_profit_so_far
        FROM (SELECT SUM(amount) OVER (ORDER BY amount DESC) AS running,
                     SUM(amount) OVER () AS everything, COUNT(*) OVER () AS n,
                     row_number() OVER (ORDER BY amount DESC, product_name) AS place
              FROM (SELECT product_name, SUM(profit) AS amount FROM flat
                    GROUP BY product_name HAVING SUM(profit) > 0) AS p) AS r
        WHERE CAST(running AS DOUBLE) >= CAST(0.8 AS DOUBLE) * CAST(everything AS DOUBLE)
        ORDER BY place LIMIT 1""")),
    "q36_rfm_raw": (customers.rfm_raw, flat(f"""
        SELECT customer_name, recency_days, frequency, {money("amount")} AS monetary
        FROM rfm""", RFM)),
    "q37_rfm_scores": (customers.rfm_scores, flat(f"""
        SELECT customer_name, recency_days, frequency, {money("amount")} AS monetary,
               r_score, f_score, m_score,
               CAST(100 * r_score + 10 * f_score + m_score AS VARCHAR) AS rfm_score
        FROM scored""", RFM, SCORED)),
    "q38_rfm_segments": (customers.rfm_segments, flat("""
        SELECT customer_name, r_score, f_score, m_score,
               CASE WHEN LEAST(r_score, f_score, m_score) >= 4 THEN 'Champions'
                    WHEN r_score <= 2 AND LEAST(f_score, m_score) >= 4 THEN 'At Risk'
                    WHEN r_score >= 4 AND f_score <= 2 THEN 'New / Promising'
                    WHEN GREATEST(r_score, f_score, m_score) <= 2 THEN 'Lost'
                    ELSE 'Needs Attention' END AS rfm_segment
        FROM scored""", RFM, SCORED)),
    "q38b_rfm_segments_best5": (lambda m: customers.rfm_segments(m, best_score=5), flat("""
        SELECT customer_name, 6 - r_score AS r_score, 6 - f_score AS f_score,
               6 - m_score AS m_score,
               CASE WHEN GREATEST(r_score, f_score, m_score) <= 2 THEN 'Champions'
                    WHEN r_score >= 4 AND GREATEST(f_score, m_score) <= 2 THEN 'At Risk'
                    WHEN r_score <= 2 AND f_score >= 4 THEN 'New / Promising'
                    WHEN LEAST(r_score, f_score, m_score) >= 4 THEN 'Lost'
                    ELSE 'Needs Attention' END AS rfm_segment
        FROM scored""", RFM, SCORED)),
    "q39_fast_movers": (products.fast_movers, flat(f"""
        SELECT product_name, {big("SUM(quantity)")} AS total_units_sold,
               CAST(MAX(order_date) - MIN(order_date) AS INTEGER) AS active_days,
               ROUND(CAST(SUM(quantity) AS DOUBLE)
                     / (CAST(GREATEST(MAX(order_date) - MIN(order_date), 1) AS DOUBLE) / 30), 2)
                 AS units_per_month
        FROM flat GROUP BY product_name HAVING SUM(quantity) >= 5
        ORDER BY units_per_month DESC, product_name LIMIT 15""")),
    "q40_dormant_products": (products.dormant_products, flat(f"""
        SELECT product_name, MAX(order_date) AS last_sold_date,
               CAST((SELECT MAX(order_date) FROM kept) - MAX(order_date) AS INTEGER)
                 AS days_since_last_sale,
               {big("SUM(quantity)")} AS total_units_sold
        FROM flat GROUP BY product_name
        ORDER BY days_since_last_sale DESC, product_name LIMIT 15""")),
    "q41_discount_dependency": (products.discount_dependency, flat(f"""
        SELECT product_name, COUNT(*) AS total_sales,
               COUNT(*) FILTER (WHERE discount > 0) AS discounted_sales,
               {pct("COUNT(*) FILTER (WHERE discount > 0)", "COUNT(*)", 1)}
                 AS pct_sold_at_discount,
               {MEAN_MARGIN}
        FROM flat GROUP BY product_name HAVING COUNT(*) >= 5
        ORDER BY pct_sold_at_discount DESC, product_name LIMIT 15""")),
}
