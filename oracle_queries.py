"""The expected result of every registered query, as SQL for an independent engine.

The returns match is written as a step-by-step queue, one recursion per cancellation of a
key, so that it shares no formula with the Spark job it checks.
"""

from __future__ import annotations

RAW = """
line AS (
    SELECT l.*, o.o_custkey, o.o_orderdate, o.o_orderpriority, n.n_name,
           p.p_brand, p.p_size, p.p_name, p.p_retailprice,
           (l.l_discount = 0 AND l.l_tax = 0) AS free
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN part p ON l.l_partkey = p.p_partkey
),
entry AS (
    SELECT *, CAST(l_orderkey AS VARCHAR) AS inv,
           CASE WHEN free AND l_linenumber = 1 THEN -CAST(l_quantity AS INTEGER)
                ELSE CAST(l_quantity AS INTEGER) END AS qty,
           o_orderdate + (l_orderkey % 24) * INTERVAL 1 HOUR AS sold_at
    FROM line WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'O')
    UNION ALL
    SELECT *, 'C' || CAST(l_orderkey AS VARCHAR), -CAST(l_quantity AS INTEGER), l_shipdate
    FROM line WHERE l_returnflag = 'R'
),
whole AS (
    SELECT inv AS Invoice, p_brand AS StockCode,
           CASE WHEN p_size = 1 THEN NULL ELSE p_name END AS Description,
           qty AS Quantity, CAST(sold_at AS TIMESTAMP) AS InvoiceDate,
           CASE WHEN free THEN CAST(0 AS DECIMAL(12,4))
                ELSE CAST(p_retailprice AS DECIMAL(12,4)) END AS Price,
           CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END AS CustomerID,
           n_name AS Country
    FROM entry
),
raw_sales AS MATERIALIZED (
    SELECT * FROM whole WHERE InvoiceDate < TIMESTAMP '1998-06-01'
    UNION ALL
    SELECT * FROM whole WHERE InvoiceDate >= TIMESTAMP '1998-05-01'
)"""

SALES = (
    RAW
    + """,
valid AS MATERIALIZED (
    SELECT DISTINCT * FROM raw_sales
    WHERE NOT starts_with(coalesce(Invoice, 'nan'), 'C')
      AND NOT coalesce(Quantity <= 0, false) AND NOT coalesce(Price <= 0, false)
),
sale_queue AS MATERIALIZED (
    SELECT *, row_number() OVER (
        PARTITION BY CustomerID, StockCode, Quantity
        ORDER BY InvoiceDate, Invoice, Description NULLS LAST, Price, Country) AS place
    FROM valid WHERE CustomerID IS NOT NULL
),
cancel_queue AS MATERIALIZED (
    SELECT CustomerID, StockCode, abs(Quantity) AS Quantity, InvoiceDate, Invoice,
           row_number() OVER (
               PARTITION BY CustomerID, StockCode, abs(Quantity)
               ORDER BY InvoiceDate, Invoice) AS turn
    FROM raw_sales WHERE starts_with(Invoice, 'C') AND CustomerID IS NOT NULL
),
walk AS (
    SELECT c.CustomerID, c.StockCode, c.Quantity, c.turn, c.Invoice, c.InvoiceDate,
           CASE WHEN s.InvoiceDate <= c.InvoiceDate THEN 1 ELSE 0 END AS taken,
           CASE WHEN s.InvoiceDate <= c.InvoiceDate THEN 1 END AS place
    FROM cancel_queue c
    LEFT JOIN sale_queue s ON s.CustomerID = c.CustomerID AND s.StockCode = c.StockCode
         AND s.Quantity = c.Quantity AND s.place = 1
    WHERE c.turn = 1
    UNION ALL
    SELECT c.CustomerID, c.StockCode, c.Quantity, c.turn, c.Invoice, c.InvoiceDate,
           w.taken + CASE WHEN s.InvoiceDate <= c.InvoiceDate THEN 1 ELSE 0 END,
           CASE WHEN s.InvoiceDate <= c.InvoiceDate THEN w.taken + 1 END
    FROM walk w
    JOIN cancel_queue c ON c.CustomerID = w.CustomerID AND c.StockCode = w.StockCode
         AND c.Quantity = w.Quantity AND c.turn = w.turn + 1
    LEFT JOIN sale_queue s ON s.CustomerID = c.CustomerID AND s.StockCode = c.StockCode
         AND s.Quantity = c.Quantity AND s.place = w.taken + 1
),
matched AS MATERIALIZED (SELECT * FROM walk WHERE place IS NOT NULL),
sales AS MATERIALIZED (
    SELECT Invoice, StockCode, Description, Quantity, InvoiceDate, Price, CustomerID, Country,
           CAST(Quantity * Price AS DECIMAL(18,4)) AS Revenue
    FROM valid WHERE CustomerID IS NULL
    UNION ALL
    SELECT s.Invoice, s.StockCode, s.Description, s.Quantity, s.InvoiceDate, s.Price,
           s.CustomerID, s.Country, CAST(s.Quantity * s.Price AS DECIMAL(18,4))
    FROM sale_queue s
    WHERE NOT EXISTS (
        SELECT 1 FROM matched m
        WHERE m.CustomerID = s.CustomerID AND m.StockCode = s.StockCode
          AND m.Quantity = s.Quantity AND m.place = s.place)
)"""
)

MONTHLY = """,
monthly AS (
    SELECT CAST(date_trunc('month', InvoiceDate) AS TIMESTAMP) AS month,
           SUM(Revenue) AS revenue, COUNT(DISTINCT Invoice) AS orders
    FROM {source} GROUP BY 1
)"""

GROWTH = """,
steps AS (
    SELECT month, CAST(revenue AS DOUBLE) AS now,
           CAST(LAG(revenue, 1) OVER (ORDER BY month) AS DOUBLE) AS prev,
           CAST(LAG(revenue, 12) OVER (ORDER BY month) AS DOUBLE) AS last_year
    FROM monthly
),
growth AS (
    SELECT *, ROUND(100.0::DOUBLE * (now - prev) / NULLIF(prev, 0), 1) AS mom,
           ROUND(100.0::DOUBLE * (now - last_year) / NULLIF(last_year, 0), 1) AS yoy
    FROM steps
)"""

WEEKLY = """,
weeks AS (
    SELECT CAST(date_trunc('week', InvoiceDate) AS TIMESTAMP) AS week,
           CAST(SUM(Revenue) AS DOUBLE) AS revenue
    FROM sales GROUP BY 1
),
weekly AS (
    SELECT * FROM weeks
    WHERE week > (SELECT MIN(week) FROM weeks) AND week < (SELECT MAX(week) FROM weeks)
),
numbered AS (
    SELECT *, row_number() OVER (ORDER BY week) AS n, COUNT(*) OVER () AS total FROM weekly
),
naive AS (
    SELECT a.week, a.revenue, b.revenue AS prediction, a.n > a.total - 13 AS is_test
    FROM numbered a LEFT JOIN numbered b ON b.n = a.n - 52
)"""

RFM = """,
rfm AS MATERIALIZED (
    SELECT CAST(CustomerID AS BIGINT) AS customer_id,
           CAST(DATE_DIFF('day', MAX(InvoiceDate),
                (SELECT MAX(InvoiceDate) + INTERVAL 1 DAY FROM sales)) AS BIGINT) AS recency_days,
           COUNT(DISTINCT Invoice) AS frequency,
           CAST(SUM(Revenue) AS DOUBLE) AS monetary
    FROM sales WHERE CustomerID IS NOT NULL GROUP BY 1
)"""

LONG = """,
cells AS (
    SELECT 'recency_days' AS metric, CAST(recency_days AS DOUBLE) AS value FROM rfm
    UNION ALL SELECT 'frequency', CAST(frequency AS DOUBLE) FROM rfm
    UNION ALL SELECT 'monetary', monetary FROM rfm
)"""

TIERS = """,
labelled AS MATERIALIZED (SELECT *, CAST(LEAST(frequency, 5) AS INTEGER) AS cluster FROM rfm),
overall AS (
    SELECT median(recency_days) AS r, median(frequency) AS f, median(monetary) AS m FROM rfm
),
grouped AS (
    SELECT cluster, COUNT(*) AS customers, CAST(median(recency_days) AS DOUBLE) AS recency_days,
           CAST(median(frequency) AS DOUBLE) AS frequency, median(monetary) AS monetary,
           SUM(CAST(monetary AS DECIMAL(28,4))) AS total
    FROM labelled GROUP BY 1
)"""

FILTERED = """,
filtered AS (
    SELECT * FROM sales
    WHERE InvoiceDate BETWEEN TIMESTAMP '1996-03-01 00:00:00' AND TIMESTAMP '1999-10-15 23:59:59'
      AND Country IN ('NATION_1', 'NATION_7', 'NATION_18')
)"""

LABELLED_SALES = r""",
marked AS (
    SELECT * REPLACE (Description || CASE WHEN Quantity % 2 = 0 THEN '\50%' ELSE '/50%' END
                      AS Description) FROM sales
)"""

SHEETS = """,
sheets AS (
    SELECT * REPLACE (Description || ' "' || StockCode || '", big' AS Description,
                      CASE WHEN Quantity <> 13 THEN Invoice END AS Invoice) FROM raw_sales
)"""

TOP = """,
country_totals AS (
    SELECT Country, SUM(Revenue) AS revenue FROM sales
    GROUP BY 1 ORDER BY revenue DESC, Country LIMIT 8
),
products AS (
    SELECT s.Country, s.Description AS product, SUM(s.Revenue) AS revenue, SUM(s.Quantity) AS units
    FROM sales s JOIN country_totals c ON s.Country = c.Country
    WHERE s.Description IS NOT NULL GROUP BY 1, 2
),
ranked AS (
    SELECT *, RANK() OVER (PARTITION BY Country ORDER BY revenue DESC) AS place,
           ROUND(100.0::DOUBLE * CAST(revenue AS DOUBLE)
                 / CAST(SUM(revenue) OVER (PARTITION BY Country) AS DOUBLE), 2) AS share
    FROM products
)"""


REPORT = """,
rest AS (SELECT * FROM raw_sales WHERE NOT starts_with(coalesce(Invoice, 'nan'), 'C')),
kept AS (SELECT * FROM rest
         WHERE NOT coalesce(Quantity <= 0, false) AND NOT coalesce(Price <= 0, false)),
counts AS (
    SELECT (SELECT COUNT(*) FROM raw_sales) AS rows_in,
           (SELECT COUNT(*) FROM raw_sales) - (SELECT COUNT(*) FROM rest) AS cancelled,
           (SELECT COUNT(*) FROM rest WHERE Quantity <= 0) AS non_positive_qty,
           (SELECT COUNT(*) FROM rest WHERE Price <= 0) AS non_positive_price,
           (SELECT COUNT(*) FROM kept) - (SELECT COUNT(*) FROM valid) AS duplicates,
           (SELECT COUNT(*) FROM matched) AS matched_returns_netted,
           (SELECT COUNT(*) FROM sales WHERE CustomerID IS NULL) AS null_customer_id,
           (SELECT COUNT(*) FROM sales) AS rows_out
)
SELECT *, ROUND(100.0::DOUBLE * rows_out / NULLIF(rows_in, 0), 1) AS kept_pct FROM counts"""

COUNTRY_WEEKS = """,
weeks AS (
    SELECT Country, CAST(date_trunc('week', InvoiceDate) AS TIMESTAMP) AS week,
           CAST(SUM(Revenue) AS DOUBLE) AS revenue
    FROM sales GROUP BY 1, 2
),
edges AS (SELECT Country, MIN(week) AS lo, MAX(week) AS hi FROM weeks GROUP BY 1)"""

PLACED = """,
placed AS (
    SELECT w.*, row_number() OVER (PARTITION BY w.Country ORDER BY week) AS n,
           COUNT(*) OVER (PARTITION BY w.Country) AS total
    FROM weeks w JOIN edges e ON e.Country = w.Country AND w.week > e.lo AND w.week < e.hi
    {extra}
)"""

SHORT = """WHERE CASE WHEN w.Country = 'NATION_3' THEN week >= TIMESTAMP '2001-01-01'
               WHEN length(w.Country) = 8 THEN week >= TIMESTAMP '2000-03-01' ELSE true END"""

TWO_LAGS = """,
paired AS (
    SELECT a.Country, a.revenue, b.revenue AS year, c.revenue AS quarter
    FROM placed a
    LEFT JOIN placed b ON b.Country = a.Country AND b.n = a.n - 52
    LEFT JOIN placed c ON c.Country = a.Country AND c.n = a.n - 13
    WHERE a.n > a.total - 13
),
long AS (
    SELECT Country, revenue, 'Seasonal naive (52w)' AS model,
           CASE WHEN quarter IS NOT NULL THEN year END AS prediction FROM paired
    UNION ALL
    SELECT Country, revenue, 'Seasonal naive (13w)',
           CASE WHEN year IS NOT NULL THEN quarter END FROM paired
),
scored AS (
    SELECT Country, model, COUNT(prediction) AS weeks_scored, AVG(abs(revenue - prediction)) AS mae,
           AVG(abs((revenue - prediction) / NULLIF(revenue, 0))) * 100 AS mape
    FROM long GROUP BY 1, 2
)
SELECT s.Country, s.model, s.weeks_scored, ROUND(s.mae, 6) AS "MAE", ROUND(s.mape, 6) AS "MAPE_%",
       ROUND((b.mae - s.mae) / NULLIF(b.mae, 0) * 100, 6) AS "MAE_vs_baseline_%"
FROM scored s JOIN scored b ON b.Country = s.Country AND b.model = 'Seasonal naive (52w)'"""

ROLLING = """,
seen AS (
    SELECT p.*, o.origin, p.total - o.origin * 13 AS last
    FROM placed p, range(0, 5) o(origin) WHERE p.n <= p.total - o.origin * 13
),
paired AS (
    SELECT a.Country, a.origin, a.revenue, b.revenue AS prediction
    FROM seen a
    LEFT JOIN seen b ON b.Country = a.Country AND b.origin = a.origin AND b.n = a.n - 52
    WHERE a.n > a.last - 13
)
SELECT Country, CAST(origin AS INTEGER) AS origin, 'Seasonal naive (52w)' AS model,
       COUNT(prediction) AS weeks_scored, ROUND(AVG(abs(revenue - prediction)), 6) AS "MAE",
       ROUND(AVG(abs((revenue - prediction) / NULLIF(revenue, 0))) * 100, 6) AS "MAPE_%",
       CASE WHEN COUNT(prediction) > 0 THEN 0::DOUBLE END AS "MAE_vs_baseline_%"
FROM paired GROUP BY 1, 2"""

# A line fitted by ridge, with the noise estimated anew in each round.
LINE = """,
train AS (
    SELECT Country, date_diff('day', DATE '1970-01-01', CAST(week AS DATE)) AS d, revenue
    FROM placed WHERE n <= total - 13
),
scale AS (
    SELECT Country, MIN(d) AS d0, greatest(MAX(d) - MIN(d), 1) AS span, MAX(abs(revenue)) AS top
    FROM train GROUP BY 1
),
unit AS (
    SELECT Country, (d - d0)::DOUBLE / span AS t, revenue / top AS y FROM train JOIN scale USING (Country)
),
moment AS (
    SELECT Country, COUNT(*)::DOUBLE AS n, SUM(t) AS t, SUM(t * t) AS tt, SUM(y) AS y,
           SUM(t * y) AS ty, SUM(y * y) AS yy, var_pop(y) + 1e-9 AS noise
    FROM unit GROUP BY 1
),
fit AS (
    SELECT Country, 0 AS step, noise, 0::DOUBLE AS a, 0::DOUBLE AS b FROM moment
    UNION ALL
    SELECT Country, step, greatest((yy - 2 * (a * y + b * ty) + a * a * n + 2 * a * b * t + b * b * tt) / n, 1e-9),
           a, b
    FROM (
        SELECT f.Country, f.step + 1 AS step, m.n, m.t, m.tt, m.y, m.ty, m.yy,
               (m.y * (m.tt + f.noise / 25) - m.t * m.ty)
                   / ((m.n + f.noise / 25) * (m.tt + f.noise / 25) - m.t * m.t) AS a,
               ((m.n + f.noise / 25) * m.ty - m.t * m.y)
                   / ((m.n + f.noise / 25) * (m.tt + f.noise / 25) - m.t * m.t) AS b
        FROM fit f JOIN moment m ON m.Country = f.Country WHERE f.step < 40
    )
)
SELECT p.Country, p.week, p.revenue, 'Trend + yearly seasonality' AS model,
       ROUND((f.a + f.b * (date_diff('day', DATE '1970-01-01', CAST(p.week AS DATE)) - s.d0) / s.span)
             * s.top, 2) AS prediction
FROM placed p JOIN fit f ON f.Country = p.Country AND f.step = 40
JOIN scale s ON s.Country = p.Country
WHERE p.n > p.total - 13"""

POINTS = """,
feature AS (
    SELECT customer_id, CAST(recency_days AS DOUBLE) AS r, ln(1 + frequency) AS f,
           ln(1 + monetary) AS m FROM rfm
),
point AS MATERIALIZED (
    SELECT customer_id, (r - AVG(r) OVER ()) / stddev_pop(r) OVER () AS x,
           (f - AVG(f) OVER ()) / stddev_pop(f) OVER () AS y,
           (m - AVG(m) OVER ()) / stddev_pop(m) OVER () AS z
    FROM feature
),
c0(cluster, x, y, z) AS (
    VALUES (0, -0.75::DOUBLE, 0.75::DOUBLE, 0.75::DOUBLE), (1, 1.0, -1.0, -1.0),
           (2, 0.25, -0.25, 0.5), (3, -0.5, -0.75, -0.5)
)"""

NEAREST = """,
n{step} AS MATERIALIZED (
    SELECT p.customer_id, p.x, p.y, p.z,
           arg_min(c.cluster, (p.x - c.x)**2 + (p.y - c.y)**2 + (p.z - c.z)**2) AS cluster
    FROM point p, c{step} c GROUP BY ALL
)"""

MEANS = """,
c{after} AS MATERIALIZED (
    SELECT cluster, AVG(x) AS x, AVG(y) AS y, AVG(z) AS z FROM n{step} GROUP BY 1
)"""

LLOYD = (
    "".join(NEAREST.format(step=i) + MEANS.format(step=i, after=i + 1) for i in range(5))
    + NEAREST.format(step=5)
    + """
SELECT c.cluster, COUNT(*) AS customers, ROUND(c.x, 6) AS recency, ROUND(c.y, 6) AS log_frequency,
       ROUND(c.z, 6) AS log_monetary
FROM c5 c JOIN n5 n ON n.cluster = c.cluster GROUP BY ALL"""
)

SILHOUETTES = """,
near AS MATERIALIZED (
    SELECT k, p.customer_id, p.x, p.y, p.z,
           arg_min(c.cluster, (p.x - c.x)**2 + (p.y - c.y)**2 + (p.z - c.z)**2) AS cluster
    FROM point p, c0 c, range(2, 5) t(k) WHERE c.cluster < k GROUP BY ALL
),
apart AS (
    SELECT a.k, a.customer_id, a.cluster = b.cluster AS own, b.cluster, COUNT(*) AS n,
           SUM({distance}) AS total
    FROM near a JOIN near b ON a.k = b.k GROUP BY ALL
),
sides AS (
    SELECT k, customer_id, MAX(total / (n - 1)) FILTER (own AND n > 1) AS a,
           MIN(total / n) FILTER (NOT own) AS b
    FROM apart GROUP BY 1, 2
),
score AS (
    SELECT k, AVG(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END) AS s
    FROM sides GROUP BY 1
)
SELECT CAST(k AS INTEGER) AS k, ROUND(s, 6) AS silhouette,
       k = (SELECT k FROM score WHERE k >= 3 ORDER BY s DESC, k LIMIT 1) AS chosen
FROM score"""

SQUARED = "(a.x - b.x)**2 + (a.y - b.y)**2 + (a.z - b.z)**2"

INERTIAS = (
    "".join(NEAREST.format(step=i) + MEANS.format(step=i, after=i + 1) for i in range(5))
    + """,
apart AS (
    SELECT k, 0 AS passes, p.customer_id, MIN((p.x - c.x)**2 + (p.y - c.y)**2 + (p.z - c.z)**2) AS near
    FROM point p, c0 c, range(2, 5) t(k) WHERE c.cluster < k GROUP BY ALL
    UNION ALL
    SELECT 4, 5, p.customer_id, MIN((p.x - c.x)**2 + (p.y - c.y)**2 + (p.z - c.z)**2)
    FROM point p, c5 c GROUP BY ALL
)
SELECT CAST(k AS INTEGER) AS k, CAST(passes AS INTEGER) AS passes, ROUND(SUM(near), 6) AS inertia
FROM apart GROUP BY 1, 2"""
)


def _query(ctes: str, body: str) -> str:
    return "WITH RECURSIVE " + ctes.strip() + "\n" + body.strip()


def _kpis(source: str) -> str:
    return f"""
SELECT CAST(SUM(Revenue) AS DOUBLE) AS revenue, COUNT(DISTINCT Invoice) AS orders,
       CAST(SUM(Revenue) AS DOUBLE) / NULLIF(COUNT(DISTINCT Invoice), 0) AS avg_order_value,
       COUNT(DISTINCT CustomerID) AS customers
FROM {source}"""


def _top(source: str, n: int) -> str:
    return f"""
SELECT Country, CAST(SUM(Revenue) AS DOUBLE) AS revenue FROM {source}
GROUP BY 1 ORDER BY SUM(Revenue) DESC, Country LIMIT {n}"""


LINES = """Invoice, StockCode, Description, Quantity, InvoiceDate, CAST(Price AS DOUBLE) AS Price,
       CustomerID, Country"""

SEARCH = """
SELECT InvoiceDate, Invoice, Description, Country, Quantity, CAST(Price AS DOUBLE) AS Price,
       CAST(Revenue AS DOUBLE) AS Revenue
FROM {source} WHERE lower(Description) LIKE '{pattern}'
ORDER BY InvoiceDate DESC, Invoice, Description, Quantity, sales.Price, Country LIMIT 500"""

AUDIT = """
SELECT COUNT(*) AS rows, MIN(InvoiceDate) AS first_date, MAX(InvoiceDate) AS last_date,
       CAST(SUM(Revenue) AS DOUBLE) AS revenue FROM sales"""

NAIVE_METRICS = """
SELECT 'Seasonal naive (52w)' AS model, COUNT(prediction) AS weeks_scored,
       ROUND(AVG(abs(revenue - prediction)), 6) AS "MAE",
       ROUND(AVG(abs((revenue - prediction) / NULLIF(revenue, 0))) * 100, 6) AS "MAPE_%",
       CAST(0 AS DOUBLE) AS "MAE_vs_baseline_%"
FROM naive WHERE is_test"""


def oracle_sql() -> dict[str, str]:
    tile = SALES + FILTERED + MONTHLY.format(source="filtered")
    monthly = SALES + MONTHLY.format(source="sales")
    weekly = SALES + WEEKLY
    rfm = SALES + RFM
    return {
        "raw_stack": _query(RAW, f"SELECT {LINES} FROM raw_sales"),
        "clean_sales": _query(
            SALES, f"SELECT {LINES}, CAST(Revenue AS DOUBLE) AS Revenue FROM sales"
        ),
        "incremental_sales": _query(
            SALES, f"SELECT {LINES}, CAST(Revenue AS DOUBLE) AS Revenue FROM sales"
        ),
        "cleaning_report": _query(SALES, REPORT),
        "cleaning_report_grouped": _query(SALES, REPORT),
        "load_report_observed": _query(SALES, REPORT),
        "incremental_report": _query(SALES, REPORT),
        "returns_pairs": _query(
            SALES,
            """
SELECT m.CustomerID, m.StockCode, m.Quantity, m.Invoice AS cancel_invoice,
       m.InvoiceDate AS cancel_date, s.Invoice AS sale_invoice, s.InvoiceDate AS sale_date
FROM matched m
JOIN sale_queue s ON s.CustomerID = m.CustomerID AND s.StockCode = m.StockCode
     AND s.Quantity = m.Quantity AND s.place = m.place""",
        ),
        "returns_match_rate": _query(
            SALES,
            """
SELECT (SELECT COUNT(*) FROM matched) AS matched, COUNT(*) AS cancels_with_customer,
       ROUND(100.0::DOUBLE * (SELECT COUNT(*) FROM matched) / COUNT(*), 1) AS match_rate_pct
FROM raw_sales WHERE starts_with(Invoice, 'C') AND CustomerID IS NOT NULL""",
        ),
        "load_audit": _query(SALES, AUDIT),
        "load_audit_observed": _query(SALES, AUDIT),
        "monthly_trend": _query(
            monthly,
            """
SELECT month, CAST(revenue AS DOUBLE) AS monthly_revenue, orders,
       CAST(SUM(revenue) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE)
           AS running_total_revenue
FROM monthly ORDER BY month""",
        ),
        "monthly_trend_rollup": _query(
            monthly,
            """
SELECT month, CAST(revenue AS DOUBLE) AS monthly_revenue, orders,
       CAST(SUM(revenue) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE)
           AS running_total_revenue
FROM monthly ORDER BY month""",
        ),
        "monthly_trend_tile": _query(
            tile,
            """
SELECT month, CAST(revenue AS DOUBLE) AS monthly_revenue,
       CAST(SUM(revenue) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running_total
FROM monthly ORDER BY month""",
        ),
        "growth": _query(
            monthly + GROWTH,
            """
SELECT month, now AS monthly_revenue, prev AS prev_month_revenue, mom AS mom_growth_pct,
       last_year AS same_month_last_year, yoy AS yoy_growth_pct
FROM growth ORDER BY month""",
        ),
        "growth_calendar": _query(
            monthly,
            """
SELECT a.month, CAST(a.revenue AS DOUBLE) AS monthly_revenue,
       CAST(b.revenue AS DOUBLE) AS prev_month_revenue,
       ROUND(100.0::DOUBLE * (CAST(a.revenue AS DOUBLE) - CAST(b.revenue AS DOUBLE))
             / NULLIF(CAST(b.revenue AS DOUBLE), 0), 1) AS mom_growth_pct,
       CAST(c.revenue AS DOUBLE) AS same_month_last_year,
       ROUND(100.0::DOUBLE * (CAST(a.revenue AS DOUBLE) - CAST(c.revenue AS DOUBLE))
             / NULLIF(CAST(c.revenue AS DOUBLE), 0), 1) AS yoy_growth_pct
FROM monthly a
LEFT JOIN monthly b ON b.month = a.month - INTERVAL 1 MONTH
LEFT JOIN monthly c ON c.month = a.month - INTERVAL 12 MONTH
ORDER BY 1""",
        ),
        "growth_tile": _query(
            tile + GROWTH,
            """
SELECT strftime(month, '%Y-%m') AS "Month", now AS "Revenue (£)", mom AS "MoM %", yoy AS "YoY %"
FROM growth ORDER BY month DESC""",
        ),
        "top_products_by_country": _query(
            SALES + TOP,
            """
SELECT Country, product, CAST(revenue AS DOUBLE) AS product_revenue,
       CAST(units AS BIGINT) AS units_sold, place AS rank_in_country,
       share AS pct_of_country_revenue
FROM ranked WHERE place <= 5 ORDER BY Country, place, product""",
        ),
        "filter_countries": _query(
            SALES,
            """
SELECT Country FROM sales GROUP BY 1 ORDER BY SUM(Revenue) DESC, Country""",
        ),
        "date_bounds": _query(
            SALES, "SELECT MIN(InvoiceDate) AS lo, MAX(InvoiceDate) AS hi FROM sales"
        ),
        "kpis": _query(SALES, _kpis("sales")),
        "kpis_filtered": _query(SALES + FILTERED, _kpis("filtered")),
        "kpis_bound_sql": _query(SALES + FILTERED, _kpis("filtered")),
        "kpis_rollup": _query(SALES, _kpis("sales")),
        "kpis_rollup_filtered": _query(SALES + FILTERED, _kpis("filtered")),
        "top_market": _query(SALES, _top("sales", 1)),
        "top10_markets": _query(SALES, _top("sales", 10)),
        "top10_markets_filtered": _query(SALES + FILTERED, _top("filtered", 10)),
        "top10_products": _query(
            SALES,
            """
SELECT Description AS product, CAST(SUM(Revenue) AS DOUBLE) AS revenue FROM sales
WHERE Description IS NOT NULL GROUP BY 1 ORDER BY SUM(Revenue) DESC, 1 LIMIT 10""",
        ),
        "transaction_search": _query(SALES, SEARCH.format(source="sales", pattern="%widget%")),
        "transaction_search_wildcard": _query(
            SALES, SEARCH.format(source="sales", pattern="%red%b_lt%")
        ),
        "transaction_search_escaped": _query(
            SALES + LABELLED_SALES,
            SEARCH.format(source="marked AS sales", pattern="%widget\\50%"),
        ),
        "transaction_search_indexed": _query(SALES, SEARCH.format(source="sales", pattern="%widget%")),
        "transaction_search_wildcard_indexed": _query(
            SALES, SEARCH.format(source="sales", pattern="%red%b_lt%")
        ),
        "transaction_search_escaped_indexed": _query(
            SALES + LABELLED_SALES,
            SEARCH.format(source="marked AS sales", pattern="%widget\\50%"),
        ),
        "csv_sheets": _query(RAW + SHEETS, f"SELECT {LINES} FROM sheets"),
        "model_comparison_rule": _query(
            SALES + COUNTRY_WEEKS + PLACED.format(extra=SHORT) + TWO_LAGS, ""
        ),
        "rolling_origin_naive": _query(
            SALES + COUNTRY_WEEKS + PLACED.format(extra="") + ROLLING, ""
        ),
        "forecast_linear": _query(SALES + COUNTRY_WEEKS + PLACED.format(extra="") + LINE, ""),
        "kmeans_fixed_start": _query(rfm + POINTS + LLOYD, ""),
        "inertia_fixed_starts": _query(rfm + POINTS + INERTIAS, ""),
        "silhouette_rule": _query(rfm + POINTS + SILHOUETTES.format(distance=SQUARED), ""),
        "silhouette_euclidean": _query(
            rfm + POINTS + SILHOUETTES.format(distance=f"sqrt({SQUARED})"), ""
        ),
        "like_for_like": _query(
            SALES,
            """,
spans AS (
    SELECT CAST(SUM(Revenue) FILTER (year(InvoiceDate) = 2000) AS DOUBLE) AS revenue,
           CAST(SUM(Revenue) FILTER (year(InvoiceDate) = 1999) AS DOUBLE) AS revenue_before
    FROM sales WHERE month(InvoiceDate) <= 11
)
SELECT *, ROUND(100.0::DOUBLE * (revenue - revenue_before) / NULLIF(revenue_before, 0), 1)
    AS growth_pct FROM spans""",
        ),
        "market_share": _query(
            SALES,
            """
SELECT Country, CAST(SUM(Revenue) AS DOUBLE) AS revenue,
       ROUND(100.0::DOUBLE * CAST(SUM(Revenue) AS DOUBLE)
             / (SELECT CAST(SUM(Revenue) AS DOUBLE) FROM sales), 1) AS share_pct
FROM sales GROUP BY 1""",
        ),
        "service_line_leaders": _query(
            SALES + TOP,
            """
SELECT Country, product, CAST(revenue AS DOUBLE) AS product_revenue,
       CAST(units AS BIGINT) AS units_sold, share AS pct_of_country_revenue,
       product IN ('small ring', 'red bolt', 'hot plate') AS is_service_line
FROM ranked WHERE place = 1""",
        ),
        "null_customer_share": _query(
            SALES,
            """
SELECT COUNT(*) AS rows, COUNT(*) - COUNT(CustomerID) AS null_customer_rows,
       ROUND(100.0::DOUBLE * (COUNT(*) - COUNT(CustomerID)) / COUNT(*), 1) AS share_pct
FROM sales""",
        ),
        "weekday_profile": _query(
            SALES,
            """
SELECT CAST(isodow(InvoiceDate) AS INTEGER) AS weekday,
       COUNT(DISTINCT CAST(InvoiceDate AS DATE)) AS trading_days,
       COUNT(DISTINCT Invoice) AS orders, CAST(SUM(Revenue) AS DOUBLE) AS revenue
FROM sales GROUP BY 1""",
        ),
        "weekly_complete": _query(weekly, "SELECT week, revenue FROM weekly ORDER BY week"),
        "seasonal_naive": _query(weekly, "SELECT week, revenue, prediction FROM naive"),
        "holdout_split": _query(
            weekly,
            "SELECT week, revenue, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split FROM naive",
        ),
        "future_weeks": _query(
            weekly,
            """
SELECT week FROM naive WHERE NOT is_test
UNION ALL
SELECT CAST((SELECT MAX(week) FROM naive WHERE NOT is_test) + i * INTERVAL 7 DAY AS TIMESTAMP)
FROM range(1, 14) t(i)""",
        ),
        "naive_metrics": _query(weekly, NAIVE_METRICS),
        "peak_week": _query(
            weekly,
            """
SELECT week, revenue AS actual, prediction AS naive FROM naive
WHERE is_test ORDER BY revenue DESC, week LIMIT 1""",
        ),
        "naive_metrics_by_country": _query(
            SALES + COUNTRY_WEEKS + PLACED.format(extra=""),
            """,
missed AS (
    SELECT a.Country, a.revenue, b.revenue AS prediction
    FROM placed a LEFT JOIN placed b ON b.Country = a.Country AND b.n = a.n - 52
    WHERE a.n > a.total - 13
)
SELECT Country, 'Seasonal naive (52w)' AS model, COUNT(prediction) AS weeks_scored,
       ROUND(AVG(abs(revenue - prediction)), 6) AS "MAE",
       ROUND(AVG(abs((revenue - prediction) / NULLIF(revenue, 0))) * 100, 6) AS "MAPE_%",
       CASE WHEN COUNT(prediction) > 0 THEN CAST(0 AS DOUBLE) END AS "MAE_vs_baseline_%"
FROM missed GROUP BY 1""",
        ),
        "rfm": _query(rfm, "SELECT * FROM rfm ORDER BY customer_id"),
        "rfm_by_customer": _query(rfm, "SELECT * FROM rfm ORDER BY customer_id"),
        "rfm_summary": _query(
            rfm + LONG,
            """
SELECT metric, COUNT(*) AS count, ROUND(AVG(value), 6) AS mean,
       ROUND(stddev_samp(value), 6) AS std, MIN(value) AS min,
       ROUND(quantile_cont(value, 0.5), 6) AS p50, ROUND(quantile_cont(value, 0.9), 6) AS p90,
       ROUND(quantile_cont(value, 0.99), 6) AS p99, MAX(value) AS max
FROM cells GROUP BY 1""",
        ),
        "rfm_medians": _query(
            rfm,
            """
SELECT CAST(median(recency_days) AS DOUBLE) AS recency_days,
       CAST(median(frequency) AS DOUBLE) AS frequency, median(monetary) AS monetary FROM rfm""",
        ),
        "rfm_scaled": _query(
            rfm,
            """,
f AS (
    SELECT customer_id, CAST(recency_days AS DOUBLE) AS r, ln(1 + frequency) AS f,
           ln(1 + monetary) AS m FROM rfm
),
s AS (
    SELECT AVG(r) AS ra, stddev_pop(r) AS rs, AVG(f) AS fa, stddev_pop(f) AS fs,
           AVG(m) AS ma, stddev_pop(m) AS ms FROM f
)
SELECT customer_id, ROUND((r - ra) / rs, 6) AS recency, ROUND((f - fa) / fs, 6) AS log_frequency,
       ROUND((m - ma) / ms, 6) AS log_monetary
FROM f, s""",
        ),
        "persona_rule": _query(
            rfm + TIERS,
            """
SELECT cluster, customers, recency_days, grouped.frequency, grouped.monetary,
       CAST(total AS DOUBLE) AS total_revenue,
       round_even(CAST(customers AS DOUBLE) / SUM(CAST(customers AS DOUBLE)) OVER () * 100, 1)
           AS pct_of_customers,
       round_even(CAST(total AS DOUBLE) / SUM(CAST(total AS DOUBLE)) OVER () * 100, 1)
           AS pct_of_revenue,
       CASE WHEN recency_days <= r AND grouped.frequency >= f AND grouped.monetary >= m
                THEN 'Champions - recent and high value'
            WHEN recency_days <= r THEN 'New / low-engagement - recent but small'
            WHEN grouped.frequency >= f AND grouped.monetary >= m
                THEN 'At risk - valuable but slipping away'
            ELSE 'Dormant - inactive and low value' END AS persona
FROM grouped, overall""",
        ),
    }
