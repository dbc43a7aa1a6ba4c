"""SQL twins of the registered queries, for checking results in another engine."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}
#: Parts read several times that are dear to work out.
_PINNED = {"entries", "itemsets", "splits", "rules0"}


def _part(name: str, body: str, *needs: str) -> None:
    _PARTS[name] = (needs, body)


def _twin(name: str, body: str, *needs: str) -> None:
    order: list[str] = []

    def visit(part: str) -> None:
        for n in _PARTS[part][0]:
            visit(n)
        if part not in order:
            order.append(part)

    for n in needs:
        visit(n)
    head = ",\n".join(f"{p} AS {'MATERIALIZED ' if p in _PINNED else ''}({_PARTS[p][1]})" for p in order)
    ORACLE[name] = (f"WITH {head}\n" if order else "") + body


_DAYS = "CAST(floor(epoch({b} - {a}) / 86400) AS INTEGER)"


def _days(a: str, b: str) -> str:
    return _DAYS.format(a=f"({a})", b=f"({b})")


# shared parts

_part(
    "items",
    """SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id, l_extendedprice AS price,
    CAST(round(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)), 2) AS DOUBLE) AS freight_value,
    l_shipdate AS delivered FROM lineitem WHERE l_extendedprice > 0 AND l_tax >= 0""",
)
_part(
    "fact",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_unique_id, o_orderdate AS ts,
    o_orderdate + INTERVAL 30 DAY AS estimated, o_totalprice AS payment_value,
    CAST(o_totalprice AS DECIMAL(18,2)) AS pay, c_nationkey AS zip, c_mktsegment AS city, n_name AS state,
    product_id, seller_id, price, freight_value, delivered, p_name AS category
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
    LEFT JOIN items ON o_orderkey = order_id LEFT JOIN part ON product_id = p_partkey""",
    "items",
)
_part(
    "rfm_base",
    f"""SELECT customer_unique_id, {_days('max(ts)', '(SELECT max(ts) FROM fact) + INTERVAL 1 DAY')} AS Recency,
    count(order_id) AS Frequency, CAST(sum(pay) AS DOUBLE) AS Monetary
    FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY 1""",
    "fact",
)

_part(
    "payments",
    """SELECT o_orderkey AS pay_order, (cents // n + CASE WHEN k = 1 THEN cents % n ELSE 0 END) / 100.0::DOUBLE AS amount FROM (
    SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey % 3 + 1 AS n,
    unnest(range(1, o_orderkey % 3 + 2)) AS k FROM orders)""",
)
_part(
    "paid_fact",
    """SELECT f.* REPLACE (amount AS payment_value, CAST(amount AS DECIMAL(18,2)) AS pay)
    FROM fact f JOIN payments ON order_id = pay_order""",
    "fact",
    "payments",
)
_part("paid_rfm_base", _PARTS["rfm_base"][1].replace("FROM fact", "FROM paid_fact"), "paid_fact")


def _scored(base: str) -> str:
    return f"""SELECT b.*,
    CASE WHEN Recency <= rq[1] THEN 4 WHEN Recency <= rq[2] THEN 3 WHEN Recency <= rq[3] THEN 2 ELSE 1 END AS R,
    CASE WHEN Frequency <= fq[1] THEN 1 WHEN Frequency <= fq[2] THEN 2 WHEN Frequency <= fq[3] THEN 3 ELSE 4 END AS F,
    CASE WHEN Monetary <= mq[1] THEN 1 WHEN Monetary <= mq[2] THEN 2 WHEN Monetary <= mq[3] THEN 3 ELSE 4 END AS M
    FROM {base} b CROSS JOIN (SELECT quantile_cont(Recency, [0.25, 0.5, 0.75]) AS rq,
    quantile_cont(Frequency, [0.25, 0.5, 0.75]) AS fq, quantile_cont(Monetary, [0.25, 0.5, 0.75]) AS mq FROM {base})"""


_part("scores", _scored("rfm_base"), "rfm_base")
_GROUP_ALL = "CASE WHEN least(R, F, M) >= 3 THEN 'High-value' WHEN least(R, F, M) >= 2 THEN 'Medium-value' ELSE 'Low-value' END"
_part(
    "rfm",
    f"""SELECT *, R::VARCHAR || F::VARCHAR || M::VARCHAR AS RFM_Score, {_GROUP_ALL} AS CustomerGroup,
    CASE WHEN R = 4 AND F = 4 AND M = 4 THEN 'Champions' WHEN R >= 3 AND F >= 3 THEN 'Loyal Customers'
    WHEN R = 4 THEN 'Recent Customers' WHEN F = 4 THEN 'Frequent Buyers' WHEN M = 4 THEN 'Big Spenders'
    ELSE 'Others' END AS BehaviorSegment FROM scores""",
    "scores",
)
_part(
    "basic",
    """SELECT customer_unique_id, count(DISTINCT order_id) AS total_orders, CAST(sum(pay) AS DOUBLE) AS total_payment,
    CAST(sum(pay) AS DOUBLE) / count(pay) AS avg_order_value,
    count(DISTINCT order_id) / (SELECT count(DISTINCT customer_unique_id) FROM fact) AS purchase_frequency
    FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY 1""",
    "fact",
)
_part("basic_v", "SELECT *, avg_order_value * purchase_frequency AS cltv FROM basic", "basic")
_part(
    "valued",
    """SELECT *, (cltv - min(cltv) OVER ()) / CASE WHEN min(cltv) OVER () = max(cltv) OVER () THEN 1.0
    ELSE max(cltv) OVER () - min(cltv) OVER () END AS normalized_cltv,
    avg_order_value * (CAST(sum(total_orders) OVER () AS DOUBLE) / count(*) OVER ()) * 12 AS better_cltv FROM basic_v""",
    "basic_v",
)
_part(
    "cltv",
    """SELECT v.*, CASE WHEN normalized_cltv <= 0.2 THEN 'Low CLTV' WHEN normalized_cltv <= 0.8 THEN 'Medium CLTV'
    ELSE 'High CLTV' END AS CLTV_Segment, (better_cltv - lo) / (hi - lo) AS cltv_normalized,
    CASE WHEN better_cltv <= q[1] THEN 'Low CLTV' WHEN better_cltv <= q[2] THEN 'Medium CLTV' ELSE 'High CLTV' END AS CLTV_new_Segment
    FROM valued v CROSS JOIN (SELECT min(better_cltv) AS lo, max(better_cltv) AS hi,
    quantile_cont(better_cltv, [0.2, 0.8]) AS q FROM valued)""",
    "valued",
)
_part(
    "rfm_cltv",
    """SELECT r.*, c.better_cltv, c.cltv_normalized, c.CLTV_new_Segment FROM rfm r JOIN cltv c USING (customer_unique_id)""",
    "rfm",
    "cltv",
)
_part(
    "rft",
    f"""SELECT customer_unique_id, count(DISTINCT order_id) - 1 AS frequency, {_days('min(ts)', 'max(ts)')} AS recency,
    {_days('min(ts)', '(SELECT max(ts) FROM fact)')} AS T, CAST(sum(pay) AS DOUBLE) / count(pay) AS monetary_value
    FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY 1""",
    "fact",
)
_part("rft2", "SELECT * FROM rft WHERE frequency >= 2 AND monetary_value IS NOT NULL", "rft")
_part(
    "repeat_uncapped",
    """SELECT * FROM rft2 WHERE monetary_value <= (SELECT quantile_cont(monetary_value, 0.99) FROM rft2)
    AND monetary_value > 0""",
    "rft2",
)
_part(
    "repeat",
    """SELECT customer_unique_id, frequency, least(recency, 365) AS recency, least(T, 365) AS T, monetary_value
    FROM repeat_uncapped""",
    "repeat_uncapped",
)
_part(
    "stand_in",
    """SELECT *, predicted_purchases * predicted_avg_value AS predicted_cltv FROM (
    SELECT *, CAST(frequency AS DOUBLE) / (T + 365.0::DOUBLE) * 365.0::DOUBLE AS predicted_purchases,
    (6.0::DOUBLE * frequency / (6.0::DOUBLE * frequency + 4.0::DOUBLE - 1)) * monetary_value
    + (1.0::DOUBLE - (6.0::DOUBLE * frequency / (6.0::DOUBLE * frequency + 4.0::DOUBLE - 1)))
    * (15000.0::DOUBLE * 6.0::DOUBLE / (4.0::DOUBLE - 1)) AS predicted_avg_value FROM repeat)""",
    "repeat",
)
_part("odd_stand_in", _PARTS["stand_in"][1].replace("6.0::DOUBLE", "0.048::DOUBLE").replace("4.0::DOUBLE", "0.5::DOUBLE"), "repeat")
_part(
    "tertiles",
    """SELECT s.*, CASE WHEN predicted_cltv <= q[1] THEN 'Low' WHEN predicted_cltv <= q[2] THEN 'Mid' ELSE 'High' END
    AS cltv_segment FROM stand_in s CROSS JOIN
    (SELECT quantile_cont(predicted_cltv, [1.0::DOUBLE / 3, 2.0::DOUBLE / 3]) AS q FROM stand_in)""",
    "stand_in",
)
_part("cutoff", "SELECT max(ts) - INTERVAL 180 DAY AS c FROM fact", "fact")
_part(
    "churn_features",
    f"""SELECT customer_unique_id, count(order_id) AS total_orders, CAST(sum(pay) AS DOUBLE) AS total_revenue,
    max(ts) AS last_order, min(ts) AS first_order, {_days('max(ts)', 'any_value(c)')} AS recency_days,
    {_days('min(ts)', 'any_value(c)')} AS customer_age_days,
    CAST(sum(pay) AS DOUBLE) / count(order_id) AS avg_order_value,
    {_days('max(ts)', 'any_value(c)')} AS days_since_last_purchase,
    CASE WHEN customer_unique_id IN (SELECT customer_unique_id FROM fact, cutoff WHERE ts > c) THEN 0 ELSE 1 END AS churned
    FROM fact CROSS JOIN cutoff WHERE ts <= c AND customer_unique_id IS NOT NULL GROUP BY customer_unique_id""",
    "cutoff",
)
_part(
    "churn",
    """SELECT f.*, CLTV_new_Segment, CASE CLTV_new_Segment WHEN 'High CLTV' THEN 0 WHEN 'Low CLTV' THEN 1 ELSE 2 END
    AS cltv_segment_encoded FROM churn_features f JOIN cltv v USING (customer_unique_id) WHERE v.total_orders > 1""",
    "churn_features",
    "cltv",
)
_part(
    "scored",
    """SELECT customer_unique_id, churned AS actual, CAST(recency_days AS DOUBLE) / (recency_days + 90.0::DOUBLE) AS probability,
    CASE WHEN CAST(recency_days AS DOUBLE) / (recency_days + 90.0::DOUBLE) >= 0.5 THEN 1 ELSE 0 END AS predicted
    FROM churn_features""",
    "churn_features",
)
_part(
    "cells",
    """SELECT count(*) FILTER (actual = 0 AND predicted = 0) AS tn, count(*) FILTER (actual = 0 AND predicted = 1) AS fp,
    count(*) FILTER (actual = 1 AND predicted = 0) AS fn, count(*) FILTER (actual = 1 AND predicted = 1) AS tp FROM scored""",
    "scored",
)
_part(
    "curve",
    """SELECT probability AS threshold, sum(count(*) FILTER (actual = 1)) OVER w AS tps,
    sum(count(*) FILTER (actual = 0)) OVER w AS fps, count(*) FILTER (actual = 1) AS pos, count(*) FILTER (actual = 0) AS neg
    FROM scored GROUP BY probability WINDOW w AS (ORDER BY probability DESC)""",
    "scored",
)
_part(
    "order_items_set",
    """SELECT DISTINCT order_id, customer_unique_id, category FROM fact
    WHERE customer_unique_id IS NOT NULL""",
    "fact",
)
_part("order_revenue", "SELECT order_id, CAST(sum(pay) AS DOUBLE) AS order_revenue FROM fact GROUP BY 1", "fact")
_part(
    "entries",
    """SELECT order_id, lower(trim(category)) AS item FROM order_items_set s JOIN cltv v USING (customer_unique_id)
    WHERE CLTV_new_Segment = 'Medium CLTV' AND category IS NOT NULL
    QUALIFY count(*) OVER (PARTITION BY order_id) > 1""",
    "order_items_set",
    "cltv",
)
_part("nb", "SELECT CAST(count(DISTINCT order_id) AS DOUBLE) AS n FROM entries", "entries")
_part(
    "itemsets",
    """SELECT items, count(*) AS freq FROM (
    SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS items FROM (
    SELECT items, unnest(range(1, 1 << len(items))) AS mask FROM (
    SELECT list(item ORDER BY item) AS items FROM entries GROUP BY order_id)))
    GROUP BY items HAVING count(*) / (SELECT n FROM nb) >= 0.001""",
    "nb",
)
_part(
    "splits",
    """SELECT list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 1) AS ante,
    list_filter(items, lambda x, i: (mask >> (i - 1)) & 1 = 0) AS cons, freq
    FROM (SELECT items, freq, unnest(range(1, (1 << len(items)) - 1)) AS mask FROM itemsets WHERE len(items) > 1)""",
    "itemsets",
)
_part(
    "rules0",
    """SELECT ante, cons, list_aggregate(ante, 'string_agg', ', ') AS antecedents,
    list_aggregate(cons, 'string_agg', ', ') AS consequents, a.freq / n AS antecedent_support,
    c.freq / n AS consequent_support, s.freq / n AS support, CAST(s.freq AS DOUBLE) / a.freq AS confidence,
    (CAST(s.freq AS DOUBLE) / a.freq) / (c.freq / n) AS lift
    FROM splits s JOIN itemsets a ON s.ante = a.items JOIN itemsets c ON s.cons = c.items CROSS JOIN nb""",
    "splits",
    "nb",
)
_part("rules1", "SELECT *, antecedents || ' → ' || consequents AS rule FROM rules0 WHERE lift >= 1.0", "rules0")
_part(
    "held",
    """SELECT ante, CAST(sum(CAST(order_revenue AS DECIMAL(18,2))) AS DOUBLE) AS r FROM (
    SELECT ante, order_id FROM (SELECT DISTINCT ante FROM rules1), UNNEST(ante) u(item) JOIN entries e ON e.item = u.item
    GROUP BY ante, order_id HAVING count(*) = len(ante)) JOIN order_revenue USING (order_id) GROUP BY ante""",
    "rules1",
    "order_revenue",
)
_part("rules", "SELECT r.*, coalesce(h.r, 0.0) AS estimated_revenue FROM rules1 r LEFT JOIN held h ON r.ante = h.ante", "held")
_part(
    "monthly",
    """SELECT strftime(ts, '%Y-%m') AS order_month, CAST(sum(pay) AS DOUBLE) AS total_revenue,
    count(DISTINCT order_id) AS order_count FROM fact WHERE ts IS NOT NULL GROUP BY 1""",
    "fact",
)
_part(
    "rf",
    f"""SELECT order_id, seller_id, category, score AS review_score, {_days('ts', 'delivered')} AS delivery_days,
    score < 3 AS low_score, delivered > estimated AS delayed, freight_value / price AS freight_ratio
    FROM fact JOIN (SELECT o_orderkey AS order_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS score FROM orders)
    USING (order_id) WHERE seller_id IS NOT NULL AND {_days('ts', 'delivered')} < 100""",
    "fact",
)
_part(
    "centroids",
    """SELECT s_nationkey AS zip, avg(CAST(s_suppkey % 60 - 30 AS DOUBLE)) AS lat, avg(CAST((s_suppkey * 7) % 60 - 70 AS DOUBLE)) AS lon,
    min(s_name) AS geo_city, CAST(s_nationkey AS VARCHAR) AS geo_state FROM supplier GROUP BY s_nationkey""",
)
_part(
    "zip_month",
    """SELECT zip AS customer_zip_code_prefix, strftime(ts, '%Y-%m') AS year_month, CAST(sum(pay) AS DOUBLE) AS total_revenue,
    count(order_id) AS total_orders, min(state) AS state, min(city) AS city FROM fact WHERE zip IS NOT NULL GROUP BY 1, 2""",
    "fact",
)
_part("geo_month", "SELECT * FROM zip_month JOIN centroids ON customer_zip_code_prefix = zip", "zip_month", "centroids")
_part(
    "features",
    f"""SELECT customer_unique_id, count(order_id) AS num_orders, CAST(sum(pay) AS DOUBLE) / count(pay) AS avg_order_value,
    CAST(sum(pay) AS DOUBLE) AS total_revenue, min(ts) AS first_purchase, max(ts) AS last_purchase,
    {_days('max(ts)', "date_trunc('day', (SELECT max(ts) FROM fact))")} AS recency_days,
    {_days('min(ts)', 'max(ts)')} AS purchase_span_days,
    CAST({_days('min(ts)', 'max(ts)')} AS DOUBLE) / count(order_id) AS order_frequency
    FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY 1""",
    "fact",
)
_part(
    "cluster_features",
    f"""SELECT customer_unique_id, num_orders, {_days('last_purchase', '(SELECT max(last_purchase) FROM features)')} AS recency_days,
    total_revenue / num_orders AS avg_order_value, purchase_span_days FROM features""",
    "features",
)
_part(
    "state_month",
    """SELECT state AS customer_state, strftime(ts, '%Y-%m') AS year_month, CAST(sum(pay) AS DOUBLE) AS payment_value
    FROM fact WHERE state IS NOT NULL GROUP BY 1, 2""",
    "fact",
)
_part(
    "state_segments",
    """SELECT state AS customer_state, CLTV_new_Segment AS segment, count(*) AS count FROM fact
    JOIN cltv USING (customer_unique_id) WHERE state IS NOT NULL GROUP BY 1, 2""",
    "cltv",
)
_part(
    "drops",
    """SELECT *, (revenue - prev_revenue) / prev_revenue * 100 AS pct_change FROM (
    SELECT *, lag(revenue) OVER (PARTITION BY customer_state ORDER BY year_month) AS prev_revenue FROM (
    SELECT state AS customer_state, strftime(ts, '%Y-%m') AS year_month, CAST(sum(pay) AS DOUBLE) AS revenue,
    CAST(sum(CAST(better_cltv AS DECIMAL(28,6))) AS DOUBLE) AS cltv FROM fact JOIN cltv USING (customer_unique_id)
    WHERE state IS NOT NULL GROUP BY 1, 2))""",
    "cltv",
)

# A

_SIZES = """SELECT 'orders' AS table_name, count(*) AS row_count FROM orders UNION ALL SELECT 'customers', count(*) FROM customer
    UNION ALL SELECT 'order_items', count(*) FROM items UNION ALL SELECT 'order_reviews', count(*) FROM orders
    UNION ALL SELECT 'products', count(*) FROM part UNION ALL SELECT 'geolocation', count(*) FROM supplier
    UNION ALL SELECT 'sellers', count(*) FROM supplier"""
_twin("a01_load_tables", _SIZES, "items")
_twin(
    "a01_load_csv_tables",
    f"""{_SIZES} UNION ALL SELECT 'order_payments', count(*) FROM payments
    UNION ALL SELECT 'category_translation', count(DISTINCT p_name) FROM part""",
    "items",
    "payments",
)
_twin(
    "a02_coerce_ts",
    """SELECT o_orderkey AS order_id, strftime(try_cast(CAST(o_orderdate AS VARCHAR) AS TIMESTAMP), '%Y-%m-%d') AS purchased,
    try_cast(o_orderpriority AS TIMESTAMP) IS NULL AS unparsed FROM orders""",
)
_twin(
    "a03_clean_reviews",
    """SELECT CAST(o_orderkey AS VARCHAR) AS review_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS review_score
    FROM orders WHERE o_orderpriority NOT LIKE '%NOT SPECIFIED'""",
)
_part(
    "translated",
    """SELECT p_partkey AS product_id, upper(p_name) AS product_category, p_size AS s, p_retailprice AS w
    FROM part WHERE p_name NOT LIKE '%ring'""",
)
_twin("a04_translate_category", "SELECT product_id, product_category FROM translated", "translated")
_twin(
    "a05_impute_mean",
    """SELECT product_id,
    round(coalesce(CAST(nullif(s, 1) AS DOUBLE), (SELECT avg(CAST(nullif(s, 1) AS DOUBLE)) FROM translated)), 6) AS product_weight_g,
    round(coalesce(CAST(nullif(s, 2) AS DOUBLE), (SELECT avg(CAST(nullif(s, 2) AS DOUBLE)) FROM translated)), 6) AS product_length_cm,
    round(coalesce(CAST(nullif(s, 3) AS DOUBLE), (SELECT avg(CAST(nullif(s, 3) AS DOUBLE)) FROM translated)), 6) AS product_height_cm,
    round(w, 6) AS product_width_cm FROM translated""",
    "translated",
)
_twin("a06_valid_items", "SELECT order_id, product_id, seller_id, price, freight_value FROM items", "items")
_FACT_COLUMNS = """order_id, customer_unique_id, ts AS order_purchase_timestamp, payment_value,
    zip AS customer_zip_code_prefix, city AS customer_city, state AS customer_state"""
_twin(
    "a07_sales_fact",
    f"SELECT {_FACT_COLUMNS}, product_id, seller_id, price, freight_value, category AS product_category FROM fact",
    "fact",
)
_twin(
    "a07_sales_fact_per_order",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_unique_id, o_orderdate AS order_purchase_timestamp,
    o_totalprice AS payment_value, c_nationkey AS customer_zip_code_prefix, c_mktsegment AS customer_city,
    n_name AS customer_state, CAST(1 AS BIGINT) AS fact_rows
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
_twin(
    "a07_sales_fact_payments",
    f"SELECT {_FACT_COLUMNS}, product_id, seller_id, price, freight_value, category AS product_category FROM paid_fact",
    "paid_fact",
)
ORACLE["a07_sales_fact_payments_per_order"] = ORACLE["a07_sales_fact_per_order"]
_twin(
    "a08_complete_rows",
    """SELECT state AS customer_state, city AS customer_city, category AS product_category, count(*) AS row_count FROM fact
    WHERE state IS NOT NULL AND city IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2, 3""",
    "fact",
)
_twin(
    "a09_in_window",
    """SELECT order_id, customer_unique_id, ts AS order_purchase_timestamp, payment_value FROM fact
    WHERE CAST(ts AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'""",
    "fact",
)
_twin(
    "a10_facet_filter",
    """SELECT order_id, state AS customer_state, city AS customer_city, category AS product_category, price FROM fact
    WHERE state IN ('NATION_3', 'NATION_7', 'NATION_12') AND city IN ('MACHINERY', 'BUILDING')""",
    "fact",
)
_twin(
    "a11_slice_by",
    "SELECT order_id, state AS customer_state, category AS product_category, price FROM fact WHERE state = 'NATION_3'",
    "fact",
)
_twin("a12_facet_values", "SELECT DISTINCT category AS product_category FROM fact WHERE category IS NOT NULL", "fact")
_PROFILE = [
    ("order_id", "order_id", "bigint"),
    ("customer_unique_id", "customer_unique_id", "bigint"),
    ("order_purchase_timestamp", "ts", "timestamp_ntz"),
    ("payment_value", "payment_value", "double"),
    ("customer_state", "state", "string"),
    ("seller_id", "seller_id", "bigint"),
    ("product_category", "category", "string"),
]
_twin(
    "a13_profile",
    " UNION ALL ".join(
        f"""SELECT {i} AS position, '{name}' AS column_name, '{kind}' AS data_type,
    round_even(((count(*) - count({col})) * 100.0::DOUBLE / count(*)) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS null_pct, count(*) AS row_count,
    {len(_PROFILE)} AS column_count FROM fact"""
        for i, (name, col, kind) in enumerate(_PROFILE)
    ),
    "fact",
)
_twin(
    "a14_preview",
    """SELECT order_id, customer_unique_id, seller_id, price, category AS product_category FROM fact
    ORDER BY price DESC NULLS LAST, order_id, seller_id NULLS FIRST, category NULLS FIRST LIMIT 50""",
    "fact",
)
_twin(
    "a15_dedupe_columns",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id, n_name AS customer_state FROM orders
    LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
_twin("a16_export_csv", "SELECT * FROM rfm", "rfm")
_twin("a16_export_cltv_csv", "SELECT * FROM cltv", "cltv")

# B

_twin("b01_rfm_base", "SELECT * FROM rfm_base", "rfm_base")
_twin(
    "b01_rfm_base_orders",
    "SELECT b.* REPLACE (n AS Frequency) FROM rfm_base b JOIN (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) ON k = customer_unique_id",
    "rfm_base",
)
_twin("b01_rfm_base_payments", "SELECT * FROM paid_rfm_base", "paid_rfm_base")
_twin(
    "b01_rfm_base_payments_per_order",
    f"""SELECT o_custkey AS customer_unique_id,
    {_days('max(o_orderdate)', '(SELECT max(o_orderdate) FROM orders) + INTERVAL 1 DAY')} AS Recency, count(*) AS Frequency,
    CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS Monetary FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1""",
)
_twin("b02_rfm_scores", "SELECT customer_unique_id, R, F, M FROM scores", "scores")
_twin("b03_rfm_code", "SELECT customer_unique_id, RFM_Score FROM rfm", "rfm")
_GROUP_CODE = "CASE WHEN CAST(RFM_Score AS INTEGER) >= 444 THEN 'High-value' WHEN CAST(RFM_Score AS INTEGER) >= 222 THEN 'Medium-value' ELSE 'Low-value' END"
_twin("b04_customer_group_code", f"SELECT customer_unique_id, RFM_Score, {_GROUP_CODE} AS CustomerGroup FROM rfm", "rfm")
_twin("b05_customer_group_all", "SELECT customer_unique_id, RFM_Score, CustomerGroup FROM rfm", "rfm")
_twin("b06_behavior_segment_first", "SELECT customer_unique_id, RFM_Score, BehaviorSegment FROM rfm", "rfm")
_twin(
    "b07_behavior_segment_last",
    """SELECT customer_unique_id, RFM_Score, CASE WHEN M = 4 THEN 'Big Spenders' WHEN F = 4 THEN 'Frequent Buyers'
    WHEN R = 4 THEN 'Recent Customers' WHEN R >= 3 AND F >= 3 THEN 'Loyal Customers' ELSE 'Others' END AS BehaviorSegment
    FROM rfm""",
    "rfm",
)


def _bucket(col: str) -> str:
    rank = f"row_number() OVER (ORDER BY {col} DESC, customer_unique_id)"
    return f"CAST(greatest(1, ceil(4.0::DOUBLE * ({rank} - 1) / greatest(count(*) OVER () - 1, 1))) AS INTEGER)"


_twin(
    "b08_rfm_quartiles",
    f"""SELECT customer_unique_id, CAST(5 - R AS INTEGER) AS R_Quartile, {_bucket('Frequency')} AS F_Quartile,
    {_bucket('Monetary')} AS M_Quartile FROM scores""",
    "scores",
)
_twin(
    "b09_segment_summary",
    """SELECT CustomerGroup, round_even((CAST(sum(Recency) AS DOUBLE) / count(*)) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS Recency,
    round_even((CAST(sum(Frequency) AS DOUBLE) / count(*)) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS Frequency,
    round_even((CAST(sum(CAST(Monetary AS DECIMAL(18,2))) AS DOUBLE) / count(*)) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS Monetary, count(*) AS CustomerCount
    FROM rfm GROUP BY 1""",
    "rfm",
)
_twin("b10_value_counts", "SELECT BehaviorSegment, count(*) AS customer_count FROM rfm GROUP BY 1", "rfm")
for _x, _y in (("R", "F"), ("R", "M"), ("M", "F")):
    _cells = ", ".join(f"count(*) FILTER ({_y} = {v}) AS {_y}_{v}" for v in (1, 2, 3, 4))
    _twin(f"b11_score_matrix_{(_x + _y).lower()}", f"SELECT {_x}, {_cells} FROM scores GROUP BY 1", "scores")
_twin(
    "b12_category_by_segment",
    """SELECT BehaviorSegment, category AS product_category, count(*) AS purchase_count FROM fact
    JOIN rfm USING (customer_unique_id) WHERE category IS NOT NULL GROUP BY 1, 2""",
    "rfm",
)
_twin(
    "b12_category_by_group",
    f"""SELECT {_GROUP_CODE} AS CustomerGroup, category AS product_category, count(*) AS purchase_count FROM fact
    JOIN rfm USING (customer_unique_id) WHERE category IS NOT NULL GROUP BY 1, 2""",
    "rfm",
)
_twin(
    "b13_revenue_by_segment",
    "SELECT BehaviorSegment, CAST(sum(CAST(Monetary AS DECIMAL(18,2))) AS DOUBLE) AS Monetary FROM rfm GROUP BY 1",
    "rfm",
)
_twin(
    "b14_segment_orders_by_month",
    """SELECT strftime(ts, '%Y-%m') AS order_month, CustomerGroup, count(order_id) AS order_count FROM fact
    LEFT JOIN rfm USING (customer_unique_id) WHERE CustomerGroup IS NOT NULL GROUP BY 1, 2""",
    "rfm",
)
_part("wfact", "SELECT * FROM fact WHERE CAST(ts AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1998-06-30'", "fact")
_part("wbase", _PARTS["rfm_base"][1].replace("FROM fact", "FROM wfact"), "wfact")
_part("wscores", _scored("wbase"), "wbase")
_twin(
    "b15_segment_customers_by_month",
    f"""SELECT strftime(ts, '%Y-%m') AS order_month, CustomerGroup, count(DISTINCT customer_unique_id) AS unique_customers
    FROM wfact JOIN (SELECT customer_unique_id, {_GROUP_ALL} AS CustomerGroup FROM wscores) USING (customer_unique_id) GROUP BY 1, 2""",
    "wscores",
)

# C

_twin("c01_cltv_basic", "SELECT * FROM basic_v", "basic_v")
_twin("c02_minmax", "SELECT customer_unique_id, normalized_cltv FROM valued", "valued")
_twin("c03_cut_fixed", "SELECT customer_unique_id, CLTV_Segment FROM cltv", "cltv")
_twin("c04_cltv_lifespan", "SELECT customer_unique_id, better_cltv FROM valued", "valued")
_twin("c05_cut_quantile", "SELECT customer_unique_id, CLTV_new_Segment FROM cltv", "cltv")
_twin("c05_segment_cltv", "SELECT * FROM cltv", "cltv")
_twin("c06_rfm_cltv", "SELECT * FROM rfm_cltv", "rfm_cltv")
_twin(
    "c07_crosstab",
    """SELECT CLTV_new_Segment, count(*) FILTER (CustomerGroup = 'Low-value') AS low_value,
    count(*) FILTER (CustomerGroup = 'Medium-value') AS medium_value, count(*) FILTER (CustomerGroup = 'High-value') AS high_value
    FROM rfm_cltv GROUP BY 1""",
    "rfm_cltv",
)
_twin("c08_log_scale", "SELECT customer_unique_id, round(ln(1 + 1000 * cltv_normalized), 6) AS cltv_transformed FROM cltv", "cltv")


def _box(group: str, col: str, source: str, plain_ends: bool) -> str:
    q = f"quantile_cont(CAST({col} AS DOUBLE), [0.25, 0.5, 0.75])"
    lo, hi = (f"min({col})", f"max({col})") if plain_ends else (f"round(min({col}), 6)", f"round(max({col}), 6)")
    return f"""SELECT {group}, count(*) AS n, {lo} AS min, round({q}[1], 6) AS q1, round({q}[2], 6) AS median,
    round({q}[3], 6) AS q3, {hi} AS max, round({q}[1] - ({q}[3] - {q}[1]) * 1.5, 6) AS lower_fence,
    round({q}[3] + ({q}[3] - {q}[1]) * 1.5, 6) AS upper_fence FROM {source} GROUP BY 1"""


_twin("c09_box_stats", _box("CLTV_new_Segment", "cltv_normalized", "cltv", False), "cltv")
for _name, _c in (("recency", "recency"), ("age", "T")):
    _twin(
        f"c10_histogram_{_name}",
        f"""SELECT bin, round(lo + (bin - 1) * width, 6) AS bin_start, count(*) AS count FROM (
        SELECT lo, width, CAST(least(50, floor(({_c} - lo) / width) + 1) AS INTEGER) AS bin FROM repeat CROSS JOIN (
        SELECT min({_c}) AS lo, CASE WHEN max({_c}) = min({_c}) THEN 1.0::DOUBLE ELSE (max({_c}) - min({_c})) / 50.0::DOUBLE END AS width
        FROM repeat)) GROUP BY bin, lo, width""",
        "repeat",
    )
_twin(
    "c11_score_vs_cltv",
    """SELECT RFM_Score, CLTV_new_Segment, count(*) AS customers, round(min(cltv_normalized), 6) AS min_cltv,
    round(avg(cltv_normalized), 6) AS mean_cltv, round(max(cltv_normalized), 6) AS max_cltv FROM rfm_cltv GROUP BY 1, 2""",
    "rfm_cltv",
)
_twin(
    "c12_revenue_comparison",
    """SELECT cltv_segment, CAST(sum(coalesce(past, 0)) AS DOUBLE) AS past_revenue,
    round(CAST(sum(CAST(predicted_cltv AS DECIMAL(28,6))) AS DOUBLE), 1) AS predicted_cltv FROM tertiles LEFT JOIN
    (SELECT customer_unique_id, sum(pay) AS past FROM fact GROUP BY 1) USING (customer_unique_id) GROUP BY 1""",
    "tertiles",
)
_twin(
    "c13_top_categories_per_segment",
    """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY CLTV_new_Segment ORDER BY purchase_count DESC, product_category) AS INTEGER) AS place
    FROM (SELECT CLTV_new_Segment, category AS product_category, count(*) AS purchase_count FROM fact
    JOIN cltv USING (customer_unique_id) WHERE category IS NOT NULL GROUP BY 1, 2)) WHERE place <= 5""",
    "cltv",
)
_QUARTER = "year({0})::VARCHAR || 'Q' || quarter({0})::VARCHAR"
_part("firsts", "SELECT customer_unique_id, min(ts) AS first, sum(pay) AS paid FROM fact WHERE customer_unique_id IS NOT NULL GROUP BY 1", "fact")
_twin(
    "c14_cohort_summary",
    f"""SELECT {_QUARTER.format('first')} AS first_purchase_quarter, count(*) AS customer_count,
    CAST(sum(paid) AS DOUBLE) AS total_revenue FROM firsts GROUP BY 1""",
    "firsts",
)
_twin(
    "c15_cltv_by_quarter",
    f"""SELECT {_QUARTER.format('ts')} AS first_quarter, CLTV_new_Segment, round(avg(cltv_normalized), 6) AS cltv_normalized
    FROM fact JOIN cltv USING (customer_unique_id) GROUP BY 1, 2""",
    "cltv",
)
_twin(
    "c15_cltv_by_first_quarter",
    f"""SELECT {_QUARTER.format('first')} AS first_quarter, CLTV_new_Segment, round(avg(cltv_normalized), 6) AS cltv_normalized
    FROM fact JOIN cltv USING (customer_unique_id) JOIN firsts USING (customer_unique_id) GROUP BY 1, 2""",
    "cltv",
    "firsts",
)
_twin(
    "c16_repeat_rate",
    """SELECT CLTV_new_Segment, avg(CASE WHEN total_orders > 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS repeat_flag
    FROM cltv GROUP BY 1""",
    "cltv",
)

# D

_twin("d01_rft_summary", "SELECT * FROM rft", "rft")
_twin("d02_rft_filter", "SELECT * FROM repeat", "repeat")
_twin(
    "d03_bounds",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, CAST(min({c}) AS DOUBLE) AS min_value, CAST(max({c}) AS DOUBLE) AS max_value,
    count(*) - count({c}) AS null_count FROM repeat"""
        for c in ("frequency", "recency", "T", "monetary_value")
    ),
    "repeat",
)
_twin("d04_pareto_nbd_at_rest", "SELECT unnest(['r', 'alpha', 's', 'beta']) AS parameter, true AS at_rest")
_twin("d05_gamma_gamma_at_rest", "SELECT unnest(['p', 'q', 'v']) AS parameter, true AS at_rest")
_twin("d06_purchase_bounds", "SELECT count(*) AS customers, true AS not_negative, true AS rising FROM repeat", "repeat")
_twin("d07_predict_value", "SELECT customer_unique_id, round(predicted_avg_value, 6) AS predicted_avg_value FROM stand_in", "stand_in")
_twin("d08_predicted_cltv", "SELECT customer_unique_id, round(predicted_cltv, 4) AS predicted_cltv FROM stand_in", "stand_in")
_twin(
    "d08_anomalies",
    "SELECT customer_unique_id, round(predicted_cltv, 4) AS predicted_cltv FROM odd_stand_in WHERE odd_stand_in.predicted_cltv < 0",
    "odd_stand_in",
)
_twin("d09_tertiles", "SELECT customer_unique_id, cltv_segment FROM tertiles", "tertiles")
_part(
    "pareto",
    """SELECT customer_unique_id, CAST(sum(CAST(predicted_cltv AS DECIMAL(28,6))) OVER
    (ORDER BY predicted_cltv DESC, customer_unique_id) AS DOUBLE) /
    CAST(sum(CAST(predicted_cltv AS DECIMAL(28,6))) OVER () AS DOUBLE) AS share FROM stand_in""",
    "stand_in",
)
_twin(
    "d10_pareto_segment",
    """SELECT customer_unique_id, round(share, 6) AS cum_cltv_perc,
    CASE WHEN share <= 0.80 THEN 'High' WHEN share <= 0.95 THEN 'Mid' ELSE 'Low' END AS cltv_segment FROM pareto""",
    "pareto",
)
_twin(
    "d11_regression_error",
    """SELECT round(avg(abs(better_cltv - predicted_cltv)), 3) AS mae,
    round(sqrt(avg((better_cltv - predicted_cltv) * (better_cltv - predicted_cltv))), 3) AS rmse
    FROM stand_in JOIN cltv USING (customer_unique_id)""",
    "stand_in",
    "cltv",
)

# E

_twin("e01_last_purchase", "SELECT customer_unique_id, max(ts) AS last_purchase FROM fact GROUP BY 1", "fact")
_part(
    "inactive",
    f"""SELECT customer_unique_id, CASE WHEN {_days('max(ts)', '(SELECT max(ts) FROM fact)')} > 180 THEN 1 ELSE 0 END AS churned
    FROM fact GROUP BY 1""",
    "fact",
)
_twin("e02_churn_inactive", "SELECT * FROM inactive", "inactive")
_twin("e03_churn_holdout", "SELECT customer_unique_id, churned FROM churn_features", "churn_features")
_twin("e04_churn_features", "SELECT * FROM churn_features", "churn_features")
_twin("e05_customer_features", "SELECT * FROM features", "features")
_twin("e06_churn_dataset", "SELECT customer_unique_id, total_orders, total_revenue, churned, CLTV_new_Segment FROM churn", "churn")
_twin(
    "e07_churn_cltv_dataset",
    """SELECT customer_unique_id, churned, frequency, recency, T, round(predicted_cltv, 4) AS predicted_cltv, cltv_segment
    FROM inactive JOIN tertiles USING (customer_unique_id)""",
    "inactive",
    "tertiles",
)
_twin("e08_label_encode", "SELECT customer_unique_id, CLTV_new_Segment, cltv_segment_encoded FROM churn", "churn")
_twin(
    "e09_churn_rate_by",
    "SELECT CLTV_new_Segment, count(*) AS customers, avg(churned) AS churn_rate FROM churn GROUP BY 1",
    "churn",
)
_twin("e09_class_counts", "SELECT churned, count(*) AS customer_count FROM churn GROUP BY 1", "churn")
_twin("e09_recency_box_by_churn", _box("churned", "days_since_last_purchase", "churn", True), "churn")
_CORR = (
    "churned",
    "total_orders",
    "total_revenue",
    "recency_days",
    "customer_age_days",
    "avg_order_value",
    "days_since_last_purchase",
    "cltv_segment_encoded",
)
_twin(
    "e10_corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS row_name, '{b}' AS col_name, round(corr({a}, {b}), 6) AS corr FROM churn" for a in _CORR for b in _CORR
    ),
    "churn",
)


def _hash(seed: int, buckets: int) -> str:
    return f"CAST(('0x' || substr(md5(customer_unique_id::VARCHAR || '-{seed}'), 1, 8)) AS BIGINT) % {buckets}"


_part("parts", f"SELECT *, CASE WHEN {_hash(42, 10000)} < 8000 THEN 'train' ELSE 'test' END AS part FROM churn_features", "churn_features")
_twin("e11_split", "SELECT customer_unique_id, part FROM parts", "parts")
_twin(
    "e12_dummy_baseline",
    """SELECT avg(CASE WHEN churned = (SELECT CASE WHEN avg(churned) > 0.5 THEN 1 ELSE 0 END FROM parts WHERE part = 'train')
    THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS baseline_accuracy FROM parts WHERE part = 'test'""",
    "parts",
)
_FEATURES = "total_orders total_revenue recency_days customer_age_days avg_order_value days_since_last_purchase cltv_segment_encoded".split()
_part("held_out", f"SELECT * FROM churn WHERE {_hash(42, 10000)} >= 8000", "churn")
for _name in ("e13_scored_checks", "e15_scored_checks", "e24_exported_scores"):
    _twin(
        _name,
        """SELECT count(*) AS rows, CAST(sum(churned) AS BIGINT) AS positives, true AS in_range, true AS consistent FROM held_out""",
        "held_out",
    )
_twin("e14_logistic_at_rest", f"SELECT unnest({['intercept', *_FEATURES]}) AS feature, true AS at_rest")
_twin("e22_importance_shares", f"SELECT '[{', '.join(sorted(_FEATURES))}]' AS features, true AS shares")
_twin(
    "e16_class_weights",
    """SELECT churned, count(*) AS n, ((SELECT count(*) FROM churn) / (2.0::DOUBLE * count(*))) AS balanced_weight,
    CASE WHEN churned = 1 THEN ((SELECT CAST(count(*) FILTER (churned = 0) AS DOUBLE) / count(*) FILTER (churned = 1) FROM churn))
    ELSE 1.0::DOUBLE END AS pos_weight FROM churn GROUP BY churned""",
    "churn",
)
_part(
    "folds",
    """SELECT customer_unique_id, churned, CAST((row_number() OVER (PARTITION BY churned
    ORDER BY md5(customer_unique_id || '-7'), customer_unique_id) - 1) % 3 AS INTEGER) AS fold FROM churn""",
    "churn",
)
_twin(
    "e17_fold_sizes",
    "SELECT fold, churned, count(*) AS customers FROM folds GROUP BY 1, 2",
    "folds",
)
_twin("e17_folds", "SELECT * FROM folds", "folds")
_twin(
    "e18_confusion",
    """SELECT 0 AS actual, 0 AS predicted, tn AS count FROM cells UNION ALL SELECT 0, 1, fp FROM cells
    UNION ALL SELECT 1, 0, fn FROM cells UNION ALL SELECT 1, 1, tp FROM cells""",
    "cells",
)
_part(
    "by_class",
    """SELECT '0' AS class, tn / (tn + fn) AS p, tn / (tn + fp) AS r, 2 * tn / (2 * tn + fn + fp) AS f, tn + fp AS support FROM cells
    UNION ALL SELECT '1', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fn + fp), tp + fn FROM cells""",
    "cells",
)
_twin(
    "e19_class_report",
    """SELECT class, p AS precision, r AS recall, f AS f1_score, support FROM by_class
    UNION ALL SELECT 'accuracy', ((tp + tn) / (tp + tn + fp + fn)), ((tp + tn) / (tp + tn + fp + fn)),
    ((tp + tn) / (tp + tn + fp + fn)), tp + tn + fp + fn FROM cells
    UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f), CAST(sum(support) AS BIGINT) FROM by_class
    UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
    sum(f * support) / sum(support), CAST(sum(support) AS BIGINT) FROM by_class""",
    "by_class",
)
_twin(
    "e20_roc",
    """SELECT threshold, CAST(fps AS DOUBLE) / (SELECT sum(neg) FROM curve) AS fpr,
    CAST(tps AS DOUBLE) / (SELECT sum(pos) FROM curve) AS tpr FROM curve
    UNION ALL SELECT CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE""",
    "curve",
)
_twin(
    "e20_auc",
    """SELECT ((SELECT sum(CASE WHEN a.probability > b.probability THEN 1.0::DOUBLE WHEN a.probability = b.probability THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)
    FROM scored a JOIN scored b ON a.actual = 1 AND b.actual = 0)
    / ((SELECT count(*) FROM scored WHERE actual = 1) * CAST((SELECT count(*) FROM scored WHERE actual = 0) AS DOUBLE))) AS auc""",
    "scored",
)
_twin(
    "e21_pr_curve",
    """SELECT threshold, CAST(tps AS DOUBLE) / (tps + fps) AS precision,
    CAST(tps AS DOUBLE) / (SELECT sum(pos) FROM curve) AS recall FROM curve
    UNION ALL SELECT CAST(NULL AS DOUBLE), 1.0::DOUBLE, 0.0::DOUBLE""",
    "curve",
)

# F

_SET = "coalesce(string_agg(category, ', ' ORDER BY category), '')"
_twin("f01_baskets", f"SELECT order_id, customer_unique_id, {_SET} AS items FROM order_items_set GROUP BY 1, 2", "order_items_set")
_twin(
    "f02_segment_baskets",
    f"""SELECT order_id, customer_unique_id, {_SET} AS items, any_value(CLTV_new_Segment) AS CLTV_new_Segment
    FROM order_items_set JOIN cltv USING (customer_unique_id) WHERE CLTV_new_Segment = 'Medium CLTV' GROUP BY 1, 2""",
    "order_items_set",
    "cltv",
)
_twin(
    "f03_multi_item",
    """SELECT order_id, customer_unique_id, CAST(count(category) AS INTEGER) AS item_count FROM order_items_set
    GROUP BY 1, 2 HAVING count(category) > 1""",
    "order_items_set",
)
_twin(
    "f04_clean_items",
    """SELECT order_id, coalesce(string_agg(lower(trim('  ' || upper(category) || ' ')), ', ' ORDER BY category), '') AS items
    FROM order_items_set GROUP BY order_id, customer_unique_id""",
    "order_items_set",
)
_twin(
    "f05_frequent_itemsets",
    "SELECT list_aggregate(items, 'string_agg', ', ') AS items, CAST(len(items) AS INTEGER) AS item_count, freq FROM itemsets",
    "itemsets",
)
_RN = ", ".join(("antecedent_support", "consequent_support", "support", "confidence", "lift"))
_twin("f06_association_rules", f"SELECT antecedents, consequents, {_RN} FROM rules1", "rules1")
_twin("f07_rule_label", "SELECT rule FROM rules1", "rules1")
_twin("f08_order_revenue", "SELECT * FROM order_revenue", "order_revenue")
_twin("f09_rule_revenue", "SELECT rule, estimated_revenue FROM rules", "rules")
_twin(
    "f10_top_bundles",
    "SELECT rule, lift, estimated_revenue FROM rules ORDER BY estimated_revenue DESC, rules.lift DESC, rule LIMIT 10",
    "rules",
)
_twin(
    "f11_rule_points",
    "SELECT rule, support, confidence, lift FROM rules1",
    "rules1",
)
_twin(
    "f12_dead_ends",
    "SELECT DISTINCT item FROM entries WHERE item NOT IN (SELECT unnest(cons) FROM rules1 WHERE lift >= 1.25)",
    "rules1",
)
_twin(
    "f12_dead_ends_of_all_rules",
    "SELECT DISTINCT item FROM entries WHERE item NOT IN (SELECT unnest(cons) FROM rules1)",
    "rules1",
)
_twin("f13_rule_edges", "SELECT antecedents AS src, consequents AS dst, lift AS weight FROM rules1", "rules1")
_twin(
    "f13_rule_nodes",
    """SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, count(*) AS degree FROM (
    SELECT antecedents AS node, 1 AS o, 0 AS i FROM rules1 UNION ALL SELECT consequents, 0, 1 FROM rules1) GROUP BY 1""",
    "rules1",
)
_twin(
    "f14_filter_rules",
    """SELECT rule, support, confidence, lift, estimated_revenue
    FROM rules WHERE rules.confidence >= 0.07 AND rules.lift >= 1.2 AND rules.support >= 0.004""",
    "rules",
)
_twin(
    "f15_uplift",
    "SELECT rule, estimated_revenue, round(estimated_revenue * (lift - 1), 2) AS predicted_uplift_revenue FROM rules",
    "rules",
)

for _name in ("f05_frequent_itemsets", "f09_rule_revenue"):
    ORACLE[f"{_name}_all"] = ORACLE[_name].replace("WHERE CLTV_new_Segment = 'Medium CLTV' AND category", "WHERE category")

# G

_twin(
    "g01_with_time_keys",
    """SELECT o_orderkey AS order_id, strftime(o_orderdate, '%Y-%m') AS order_month, CAST(month(o_orderdate) AS INTEGER) AS month,
    CLTV_new_Segment FROM orders LEFT JOIN cltv ON o_custkey = customer_unique_id""",
    "cltv",
)
_twin("g02_monthly", "SELECT * FROM monthly", "monthly")
_WINDOW = "(ORDER BY order_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
_part(
    "rolled",
    f"""SELECT *, CASE WHEN count(*) OVER {_WINDOW} = 3 THEN avg(total_revenue) OVER {_WINDOW} END AS rev3,
    CASE WHEN count(*) OVER {_WINDOW} = 3 THEN avg(order_count) OVER {_WINDOW} END AS ord3 FROM monthly""",
    "monthly",
)
_twin(
    "g03_rolling_mean",
    "SELECT order_month, total_revenue, order_count, round(rev3, 2) AS revenue_3mo, ord3 AS orders_3mo FROM rolled",
    "rolled",
)
_twin(
    "g04_seasonality",
    """SELECT CAST(month(ts) AS INTEGER) AS month_number, strftime(ts, '%b') AS month, CAST(sum(pay) AS DOUBLE) AS total_revenue,
    count(DISTINCT order_id) AS order_count FROM fact GROUP BY 1, 2""",
    "fact",
)
_twin(
    "g05_forecast_structure",
    """SELECT state AS customer_state, metric, count(DISTINCT date_trunc('month', ts)) AS months,
    strftime(min(ts), '%Y-%m-01') AS first_month, strftime(max(ts), '%Y-%m-01') AS last_month,
    strftime(last_day(max(ts)), '%Y-%m-%d') AS first_forecast,
    strftime(last_day(date_trunc('month', max(ts)) + INTERVAL 5 MONTH), '%Y-%m-%d') AS last_forecast,
    true AS ordered, true AS widens
    FROM fact, (VALUES ('total_revenue'), ('order_count')) AS m(metric) WHERE state IS NOT NULL GROUP BY 1, 2""",
    "fact",
)
_twin(
    "g06_forecast_error",
    """SELECT round(avg(abs(total_revenue - rev3)), 2) AS mae, round(sqrt(avg((total_revenue - rev3) * (total_revenue - rev3))), 2) AS rmse,
    round(avg(abs((total_revenue - rev3) / total_revenue)) * 100, 6) AS mape FROM rolled WHERE rev3 IS NOT NULL""",
    "rolled",
)
_twin(
    "g07_category_monthly",
    """SELECT strftime(ts, '%Y-%m') AS order_month, CAST(sum(pay) AS DOUBLE) AS total_revenue FROM fact
    WHERE category = 'small ring' GROUP BY 1""",
    "fact",
)

# H

_twin(
    "h01_sentiment",
    """SELECT CAST(o_orderkey AS VARCHAR) AS review_id, score AS review_score, CASE WHEN score >= 4 THEN 'Positive' WHEN score = 3
    THEN 'Neutral' ELSE 'Negative' END AS review_sentiment
    FROM (SELECT o_orderkey, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS score FROM orders)""",
)
_twin(
    "h02_review_fact",
    """SELECT order_id, seller_id, category AS product_category, review_score, delivery_days, low_score, delayed,
    freight_ratio FROM rf""",
    "rf",
)
_STATS = """count(review_score) AS num_reviews, avg(review_score) AS avg_rating, round(stddev_samp(review_score), 6) AS rating_std,
    (avg(CAST(low_score AS INTEGER)) * 100) AS pct_low_scores"""
_twin("h03_rating_stats_seller", f"SELECT seller_id, {_STATS} FROM rf GROUP BY 1", "rf")
_twin(
    "h03_rating_stats_category",
    f"SELECT category AS product_category, {_STATS} FROM rf WHERE category IS NOT NULL GROUP BY 1",
    "rf",
)
_twin(
    "h04_top_rated",
    """SELECT seller_id, count(review_score) AS num_reviews, avg(review_score) AS avg_rating FROM rf GROUP BY 1
    ORDER BY avg(review_score) DESC, num_reviews DESC, seller_id LIMIT 10""",
    "rf",
)
_twin(
    "h04_worst_rated",
    """SELECT category AS product_category, count(review_score) AS num_reviews, avg(review_score) AS avg_rating FROM rf
    WHERE category IS NOT NULL GROUP BY 1 HAVING count(review_score) >= 10 ORDER BY avg(review_score), product_category LIMIT 10""",
    "rf",
)
_twin(
    "h05_delivery_by_score",
    "SELECT review_score, avg(delivery_days) AS avg_delivery_days, count(*) AS num_orders FROM rf GROUP BY 1",
    "rf",
)
_twin(
    "h06_slow_sellers",
    """SELECT seller_id, count(*) AS num_orders, avg(review_score) AS avg_rating, avg(delivery_days) AS avg_delivery_days
    FROM rf GROUP BY 1 HAVING count(*) >= 10 AND avg(review_score) <= 3 ORDER BY avg(delivery_days) DESC, seller_id LIMIT 10""",
    "rf",
)
_twin("h06_slow_sellers_rated_two", ORACLE["h06_slow_sellers"].replace("<= 3 ", "<= 2 "))
_twin(
    "h07_delay_impact",
    """SELECT CASE WHEN delayed THEN 'Late' ELSE 'On-Time' END AS delayed, avg(review_score) AS avg_rating,
    count(review_score) AS count FROM rf GROUP BY rf.delayed""",
    "rf",
)
_twin(
    "h08_freight_vs_rating",
    """SELECT seller_id, category AS product_category, count(*) AS num_reviews, avg(review_score) AS avg_rating,
    round(avg(freight_ratio), 6) AS avg_freight_ratio FROM rf WHERE category IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 10""",
    "rf",
)

# I

_twin(
    "i01_cltv_geo",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_unique_id, n_name AS customer_state, better_cltv, n AS fact_rows
    FROM orders JOIN cltv ON o_custkey = customer_unique_id LEFT JOIN customer ON o_custkey = c_custkey
    LEFT JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT order_id AS k, count(*) AS n FROM fact GROUP BY 1) ON k = o_orderkey""",
    "cltv",
)
_twin(
    "i02_zip_centroids",
    "SELECT zip AS geolocation_zip_code_prefix, lat, lon, geo_city, geo_state FROM centroids",
    "centroids",
)
_twin(
    "i10_nearest_mean",
    """SELECT count(*) AS points, CAST(5 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced
    FROM (SELECT DISTINCT state, city, lat, lon FROM geo_month)""",
    "geo_month",
)
_twin(
    "i12_nearest_mean",
    "SELECT count(*) AS points, CAST(4 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS misplaced FROM features",
    "features",
)
_twin(
    "i13_component_equations",
    "SELECT unnest(['pca1', 'pca2']) AS component, (SELECT count(*) FROM features) AS rows, true AS unit, true AS solves, true AS falling",
    "features",
)
_twin("i03_zip_month", "SELECT * FROM zip_month", "zip_month")
_twin(
    "i04_geo_month",
    """SELECT customer_zip_code_prefix, year_month, total_revenue, total_orders, state, city, lat,
    lon, geo_city, geo_state FROM geo_month""",
    "geo_month",
)
_twin(
    "i05_geo_bubbles",
    """SELECT state, city, lat, lon, CAST(sum(CAST(total_revenue AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue
    FROM geo_month WHERE year_month BETWEEN '1995-06' AND '1998-03' AND city <> 'AUTOMOBILE' GROUP BY state, city, geo_month.lat, geo_month.lon""",
    "geo_month",
)
_twin(
    "i06_scaled_metric",
    """SELECT state, city, lat, lon, CAST(sum(total_orders) AS BIGINT) AS total_orders,
    (CAST(sum(total_orders) AS DOUBLE) / 18735 * 40000 + 1000) AS scaled_metric
    FROM geo_month GROUP BY state, city, geo_month.lat, geo_month.lon""",
    "geo_month",
)
_twin(
    "i07_top_cities",
    """SELECT city, CAST(sum(CAST(total_revenue AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue FROM geo_month GROUP BY 1
    ORDER BY 2 DESC, 1 LIMIT 10""",
    "geo_month",
)
for _level in ("state", "city"):
    _twin(
        f"i08_value_per_customer_{_level}",
        f"""SELECT customer_{_level}, total_revenue, unique_customers, total_revenue / unique_customers AS avg_cltv_per_customer
        FROM (SELECT {_level} AS customer_{_level}, CAST(sum(pay) AS DOUBLE) AS total_revenue,
        count(DISTINCT customer_unique_id) AS unique_customers FROM fact WHERE {_level} IS NOT NULL GROUP BY 1)
        ORDER BY total_revenue / unique_customers DESC, customer_{_level} LIMIT 10""",
        "fact",
    )
_CF = ("num_orders", "recency_days", "avg_order_value", "purchase_span_days")
_twin(
    "i09_standardize",
    "SELECT customer_unique_id, "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}_std" for c in _CF)
    + " FROM cluster_features",
    "cluster_features",
)
_part(
    "means",
    "SELECT R AS cluster, " + ", ".join(f"round_even((avg({c})) * 100.0::DOUBLE, 0) / 100.0::DOUBLE AS {c}" for c in _CF)
    + " FROM cluster_features JOIN scores USING (customer_unique_id) GROUP BY 1",
    "cluster_features",
    "scores",
)
_twin(
    "i14_label_clusters",
    """SELECT means.*, CASE WHEN num_orders > mo AND avg_order_value > mv AND purchase_span_days > ms AND recency_days < mr THEN 'Loyal Customers'
    WHEN avg_order_value > mv * 2 THEN 'High Value Buyers'
    WHEN num_orders <= 2 AND purchase_span_days < 5 AND recency_days < mr THEN 'New Customers'
    WHEN recency_days > mr * 1.2 THEN 'Inactive Customers' ELSE 'Occasional Buyers' END AS segment
    FROM means CROSS JOIN (SELECT avg(num_orders) AS mo, avg(recency_days) AS mr, avg(avg_order_value) AS mv, avg(purchase_span_days) AS ms FROM means)""",
    "means",
)
_twin("i15_state_month", "SELECT * FROM state_month", "state_month")
_STATES = ("NATION_3", "NATION_7", "NATION_12")
_twin(
    "i15_state_month_pivot",
    "SELECT year_month, "
    + ", ".join(f"coalesce(max(payment_value) FILTER (customer_state = '{s}'), 0.0) AS {s}" for s in _STATES)
    + f" FROM state_month WHERE customer_state IN {_STATES} GROUP BY 1",
    "state_month",
)
_twin("i16_segments_by_state", "SELECT * FROM state_segments", "state_segments")
_twin(
    "i16_segment_state_pivot",
    "SELECT segment, "
    + ", ".join(f"CAST(coalesce(sum(count) FILTER (customer_state = '{s}'), 0) AS BIGINT) AS {s}" for s in _STATES)
    + f" FROM state_segments WHERE customer_state IN {_STATES} GROUP BY 1",
    "state_segments",
)
_twin(
    "i17_drop_detection",
    """SELECT customer_state, year_month, revenue, CAST(round(CAST(cltv AS DECIMAL(28,6)), 2) AS DOUBLE) AS cltv, prev_revenue, pct_change,
    coalesce(drops.pct_change < -20, false) AS drop_flag FROM drops""",
    "drops",
)
_twin(
    "i17_flagged_drops",
    "SELECT customer_state, year_month, revenue, pct_change FROM drops WHERE drops.pct_change < -20",
    "drops",
)

# J

_twin(
    "j01_global_row_number",
    "SELECT customer_unique_id, Monetary, row_number() OVER (ORDER BY Monetary DESC, customer_unique_id) AS place FROM rfm_base",
    "rfm_base",
)
_twin(
    "j02_running_sum",
    """SELECT o_orderkey AS order_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER
    (ORDER BY o_totalprice DESC, o_orderkey) AS DOUBLE) AS running FROM orders""",
)
_twin(
    "j03_scalars",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_unique_id, o_totalprice AS payment_value FROM orders
    WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)""",
)
_twin(
    "j04_complete_pairs",
    """SELECT s AS BehaviorSegment, v AS last_r, count(rfm.R) AS customers FROM (SELECT DISTINCT BehaviorSegment AS s FROM rfm)
    CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS v) LEFT JOIN rfm ON BehaviorSegment = s AND R = v GROUP BY 1, 2""",
    "rfm",
)
_part(
    "all_entries",
    """SELECT order_id, category AS item, count(*) OVER (PARTITION BY order_id) AS k FROM order_items_set
    WHERE category IS NOT NULL""",
    "order_items_set",
)
_twin(
    "j05_containment_join",
    """SELECT a || ', ' || b AS set_items, count(*) AS orders, CAST(sum(CAST(order_revenue AS DECIMAL(18,2))) AS DOUBLE) AS revenue
    FROM (SELECT DISTINCT a, b FROM (SELECT order_id, min(item) AS a, max(item) AS b FROM all_entries WHERE k = 2 GROUP BY 1))
    JOIN all_entries x ON x.item = a JOIN all_entries y ON y.order_id = x.order_id AND y.item = b
    JOIN order_revenue r ON r.order_id = x.order_id GROUP BY 1""",
    "all_entries",
    "order_revenue",
)

_twin(
    "j06_support",
    """SELECT '0' AS class, count(*) FILTER (churned = 0) AS support FROM held_out
    UNION ALL SELECT '1', count(*) FILTER (churned = 1) FROM held_out UNION ALL SELECT 'accuracy', count(*) FROM held_out""",
    "held_out",
)
