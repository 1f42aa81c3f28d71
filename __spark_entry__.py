"""Registry of the queries, for the driver.

``queries()`` maps a name to a callable ``(spark, sf_dir) -> DataFrame``, ``oracle_sql()`` the
same names to SQL that gives the expected result. Queries without SQL (clustering and the
fitted forecast) have none there.

As in the programs this rebuilds, the cleaned table is built once and every report reads
it. It is kept in the shared folder for the life of the application, one per input folder; input
that changes meanwhile is not noticed.
"""

from __future__ import annotations

import importlib.util
import os
import re
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np  # noqa: E402
from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import oracle_queries  # noqa: E402
from retailloom.functions.expressions import money_to_double  # noqa: E402
from retailloom.operators import (  # noqa: E402
    cleaning,
    clustering,
    filters,
    quantiles,
    returns,
    rfm,
    rollup,
    series,
)
from retailloom.operators.forecast import forecast_ahead  # noqa: E402
from retailloom.operators.profiles import segment_profile  # noqa: E402
from retailloom.plans import (
    build,
    forecasting,
    increments,
    reports,
    search_index,
    segmentation,
)  # noqa: E402
from retailloom.schema import RAW_CUSTOMER_HEADING, SALE_MONTH  # noqa: E402
from retailloom.session import materialise, scratch_path  # noqa: E402
from retailloom.sources import raw as raw_source  # noqa: E402
from retailloom.sources import by_customer, tpch_retail, warehouse  # noqa: E402

# The operators for training data come and go as one: the subpackage with corpus_pipeline.py.
if importlib.util.find_spec("retailloom.llm") and importlib.util.find_spec("corpus_pipeline"):
    from retailloom.llm import queries as llm_queries
else:
    llm_queries = None

FLAGSHIP_DIR = "/root/testdata/sf0.001"
DATES = ("1996-03-01", "1999-10-15")
MARKETS = ("NATION_1", "NATION_7", "NATION_18")
# Stand-ins for the charge lines, which the test tables do not contain.
CHARGES = ("small ring", "red bolt", "hot plate")
# Centres to start from, in standardised recency, log frequency and log revenue.
START = np.array(
    [(-0.75, 0.75, 0.75), (1.0, -1.0, -1.0), (0.25, -0.25, 0.5), (-0.5, -0.75, -0.5)]
)
PASSES = 5
ORIGINS = 5

_built: dict[tuple, object] = {}


def _once(spark: SparkSession, sf_dir: str, what: str, make: Callable[[], object]):
    key = (spark.sparkContext.applicationId, os.path.abspath(sf_dir), what)
    if key not in _built:
        _built[key] = make()
    return _built[key]


def _raw(spark, sf_dir) -> DataFrame:
    sheets = _once(spark, sf_dir, "sheets", lambda: tpch_retail.sheets(spark, sf_dir))
    return raw_source.stack(sheets)


def _matches(spark, sf_dir) -> DataFrame:
    return _once(spark, sf_dir, "matches", lambda: cleaning.match_returns(_raw(spark, sf_dir)))


def _sales(spark, sf_dir) -> DataFrame:
    def make():
        path = scratch_path(spark, "sales")
        warehouse.write_sales(cleaning.clean_lines(_raw(spark, sf_dir), _matches(spark, sf_dir)), path)
        return warehouse.read_sales(spark, path)

    return _once(spark, sf_dir, "sales", make)


def _load(spark, sf_dir) -> build.Load:
    """A load of its own, for what it counts on its way."""
    return _once(
        spark, sf_dir, "load", lambda: build.load(_raw(spark, sf_dir), scratch_path(spark, "load"))
    )


def _rollup(spark, sf_dir) -> rollup.Rollup:
    return _once(
        spark, sf_dir, "rollup", lambda: rollup.build(_sales(spark, sf_dir), scratch_path(spark, "rollup"))
    )


def _increments(spark, sf_dir) -> str:
    """The load by three batches, of which the last brings lines between those of the others."""

    def make():
        raw, folder = _raw(spark, sf_dir), scratch_path(spark, "increments")
        date = F.col("InvoiceDate")
        first, last = (F.lit(d).cast("timestamp_ntz") for d in ("1997-07-15", "1999-01-10"))
        for part in (date < first, date >= last, (date >= first) & (date < last)):
            increments.apply(raw.where(part), folder)
        return folder

    return _once(spark, sf_dir, "increments", make)


def _customers(spark, sf_dir) -> DataFrame:
    return _once(
        spark, sf_dir, "rfm", lambda: materialise(rfm.rfm(_sales(spark, sf_dir)), "rfm")
    )


def _by_customer(spark, sf_dir) -> by_customer.ByCustomer:
    return _once(
        spark,
        sf_dir,
        "by-customer",
        lambda: by_customer.write(
            _sales(spark, sf_dir), path := scratch_path(spark, "by-customer"), re.sub(r"\W", "_", os.path.basename(path)), buckets=8
        ),
    )


def _search(spark, sf_dir) -> segmentation.Search:
    return _once(
        spark, sf_dir, "search", lambda: segmentation.search(_customers(spark, sf_dir))
    )


def _segments(spark, sf_dir) -> segmentation.Segmentation:
    return _once(spark, sf_dir, "segments", lambda: segmentation.label(_search(spark, sf_dir)))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Six decimals: means of floating-point values differ past that with the order of addition."""
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _filtered(sales: DataFrame) -> DataFrame:
    return filters.filter_sales(sales, *DATES, MARKETS)


def _kpis_bound_sql(spark, sf_dir) -> DataFrame:
    """Lines are summed per invoice first, and the months are named, so that others stay closed."""
    markets = ", ".join("?" for _ in MARKETS)
    return warehouse.run_query(
        spark,
        f"""
        SELECT SUM(Revenue) AS revenue, COUNT(DISTINCT Invoice) AS orders,
               try_divide(CAST(SUM(Revenue) AS DOUBLE), COUNT(DISTINCT Invoice)) AS avg_order_value,
               COUNT(DISTINCT CustomerID) AS customers
        FROM (
            SELECT Invoice, CustomerID, SUM(Revenue) AS Revenue FROM sales
            WHERE sale_month BETWEEN trunc(CAST(? AS DATE), 'month') AND CAST(? AS DATE)
              AND InvoiceDate BETWEEN ? AND ? AND Country IN ({markets})
            GROUP BY Invoice, CustomerID
        )
        """,
        (*DATES, DATES[0], f"{DATES[1]} 23:59:59", *MARKETS),
        _sales(spark, sf_dir),
    )


def _naive(sales: DataFrame, by=(), strict=True) -> DataFrame:
    return forecasting.naive_predictions(series.complete_weeks(sales, by), by=by, strict=strict)


def _metrics(predictions: DataFrame, by=()) -> DataFrame:
    return _rounded(
        forecasting.accuracy(predictions, by), "MAE", "MAPE_%", "MAE_vs_baseline_%"
    )


def _rule_comparison(sales: DataFrame) -> DataFrame:
    """Two lags compared per country; some countries have a short history, one too short a one."""
    by, week = ("Country",), F.col("week")
    since = F.when(F.col("Country") == "NATION_3", "2001-01-01").when(
        F.length("Country") == 8, "2000-03-01"
    )
    weekly = series.complete_weeks(sales, by)
    weekly = weekly.where(since.isNull() | (week >= since.cast("timestamp_ntz")))
    quarter = forecasting.naive_predictions(
        weekly, lag=13, by=by, strict=False, model="Seasonal naive (13w)"
    )
    year = forecasting.naive_predictions(weekly, by=by, strict=False)
    return _metrics(year.unionByName(quarter), by)


def _rolling(sales: DataFrame, by=()) -> DataFrame:
    return forecasting.rolling_origins(series.complete_weeks(sales, by), ORIGINS, by=by)


def _rolling_naive(sales: DataFrame) -> DataFrame:
    by = ("Country", "origin")
    found = forecasting.naive_predictions(_rolling(sales, ("Country",)), by=by, strict=False)
    return _metrics(found, by)


def _linear_forecast(sales: DataFrame) -> DataFrame:
    by = ("Country",)
    found = forecasting.additive_predictions(
        series.complete_weeks(sales, by), by=by, order=0, changepoints=0
    )
    return found.withColumn("prediction", F.round("prediction", 2))


def _points(spark, sf_dir) -> DataFrame:
    return _once(
        spark,
        sf_dir,
        "points",
        lambda: materialise(rfm.standardised(rfm.features(_customers(spark, sf_dir))), "points"),
    )


def _kmeans_fixed_start(spark, sf_dir) -> DataFrame:
    points = _points(spark, sf_dir)
    centres = clustering.lloyd(points, rfm.FEATURES, START, PASSES)
    rows = [(i, *map(float, centre)) for i, centre in enumerate(centres)]
    schema = "cluster int, " + ", ".join(f"{c} double" for c in rfm.FEATURES)
    own = clustering.cluster_of(rfm.FEATURES, centres).alias("cluster")
    sizes = points.groupBy(own).agg(F.count(F.lit(1)).alias("customers"))
    return _rounded(sizes.join(spark.createDataFrame(rows, schema), "cluster"), *rfm.FEATURES)


def _inertia_fixed_starts(spark, sf_dir) -> DataFrame:
    points = _points(spark, sf_dir)
    moved = clustering.lloyd(points, rfm.FEATURES, START, PASSES)
    models = [*((k, 0, START[:k]) for k in (2, 3, 4)), (len(START), PASSES, moved)]
    costs = clustering.inertias(points, rfm.FEATURES, [centres for _, _, centres in models])
    rows = [(k, passes, cost) for (k, passes, _), cost in zip(models, costs)]
    return _rounded(spark.createDataFrame(rows, "k int, passes int, inertia double"), "inertia")


def _silhouette_rule(spark, sf_dir, measure=segmentation.SQUARED) -> DataFrame:
    fits = [clustering.Fit(k, START[:k]) for k in (2, 3, 4)]
    scored = segmentation.score(_points(spark, sf_dir), fits, measure)
    chosen = clustering.best_k(scored).k
    scores = segmentation.scores_table(spark, scored).drop("inertia")
    return _rounded(scores, "silhouette").withColumn("chosen", F.col("k") == chosen)


def _csv_sheets(spark, sf_dir) -> DataFrame:
    """The sheets written as spreadsheets export them, the second with its columns in another
    order, and read back: quotes and commas in descriptions, missing invoices."""
    paths = []
    for sheet in _once(spark, sf_dir, "sheets", lambda: tpch_retail.sheets(spark, sf_dir)):
        written = sheet.withColumns(
            {
                "Description": F.concat("Description", F.lit(' "'), "StockCode", F.lit('", big')),
                "Invoice": F.when(F.col("Quantity") != 13, F.col("Invoice")),
            }
        ).withColumnRenamed("CustomerID", RAW_CUSTOMER_HEADING)
        columns = written.columns if not paths else written.columns[::-1]
        paths.append(scratch_path(spark, "sheet"))
        exported = written.select(*columns).write.options(
            header=True, escape='"', timestampNTZFormat="yyyy-MM-dd HH:mm:ss"
        )
        exported.csv(paths[-1])
    return raw_source.read_raw(spark, paths, "csv")


def _with_escapes(sales: DataFrame) -> DataFrame:
    label = F.when(F.col("Quantity") % 2 == 0, F.lit("\\50%")).otherwise("/50%")
    return sales.withColumn("Description", F.concat("Description", label))


def _escaped_search(sales: DataFrame) -> DataFrame:
    return reports.transaction_search(_with_escapes(sales), "widget\\50")


def _indexed_search(term: str, described=lambda sales: sales, what: str = "index"):
    """The search through an index, which is built once."""

    def search(spark, sf_dir) -> DataFrame:
        index = _once(
            spark,
            sf_dir,
            what,
            lambda: search_index.build(described(_sales(spark, sf_dir)), scratch_path(spark, what)),
        )
        return money_to_double(search_index.transaction_search(index, term))

    return search


def _summary(customers: DataFrame) -> DataFrame:
    return _rounded(
        quantiles.distribution_summary(customers, rfm.METRICS), "mean", "std", "p50", "p90", "p99"
    )


def _frequency_tiers(customers: DataFrame) -> DataFrame:
    """Customers grouped by a rule, so that the profile and the personas can be checked."""
    tier = F.least("frequency", F.lit(5)).cast("int")
    return customers.withColumn("cluster", tier)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def on_sales(report: Callable[[DataFrame], DataFrame]):
        return lambda spark, sf_dir: money_to_double(report(_sales(spark, sf_dir)))

    def on_customers(report: Callable[[DataFrame], DataFrame]):
        return lambda spark, sf_dir: money_to_double(report(_customers(spark, sf_dir)))

    weekly = series.complete_weeks
    return {
        # load
        "raw_stack": lambda s, d: money_to_double(_raw(s, d)),
        "clean_sales": lambda s, d: money_to_double(cleaning.clean(_raw(s, d))),
        "cleaning_report": lambda s, d: cleaning.cleaning_report(
            _raw(s, d), _matches(s, d), _sales(s, d)
        ),
        "cleaning_report_grouped": lambda s, d: cleaning.cleaning_report(
            _raw(s, d), _matches(s, d)
        ),
        "csv_sheets": lambda s, d: money_to_double(_csv_sheets(s, d)),
        "returns_pairs": lambda s, d: returns.pairs(_matches(s, d)),
        "returns_match_rate": lambda s, d: returns.match_rate(
            _matches(s, d), cleaning.cancellations(_raw(s, d))
        ),
        "load_audit": on_sales(warehouse.load_audit),
        "load_report_observed": lambda s, d: _load(s, d).report,
        "load_audit_observed": lambda s, d: money_to_double(_load(s, d).audit),
        "incremental_sales": lambda s, d: money_to_double(
            increments.sales(s, _increments(s, d)).drop(SALE_MONTH)
        ),
        "incremental_report": lambda s, d: increments.report(s, _increments(s, d)),
        # reports
        "monthly_trend": on_sales(reports.monthly_trend),
        "monthly_trend_tile": on_sales(
            lambda sales: reports.monthly_trend(_filtered(sales), with_orders=False)
        ),
        "growth": on_sales(reports.growth),
        "growth_calendar": on_sales(lambda sales: reports.growth(sales, mode=series.CALENDAR)),
        "growth_tile": on_sales(lambda sales: reports.growth_tile(_filtered(sales))),
        "top_products_by_country": on_sales(reports.top_products_by_country),
        "filter_countries": on_sales(reports.filter_countries),
        "date_bounds": on_sales(reports.date_bounds),
        "kpis": on_sales(reports.kpis),
        "kpis_filtered": on_sales(lambda sales: reports.kpis(_filtered(sales))),
        "kpis_rollup": lambda s, d: money_to_double(rollup.kpis(_rollup(s, d))),
        "kpis_rollup_filtered": lambda s, d: money_to_double(rollup.kpis(_rollup(s, d), *DATES, MARKETS)),
        "monthly_trend_rollup": lambda s, d: money_to_double(rollup.monthly_trend(_rollup(s, d))),
        "kpis_bound_sql": lambda s, d: money_to_double(_kpis_bound_sql(s, d)),
        "top_market": on_sales(reports.top_market),
        "top10_markets": on_sales(
            lambda sales: reports.chart_order(reports.top_markets(sales), "Country")
        ),
        "top10_markets_filtered": on_sales(lambda sales: reports.top_markets(_filtered(sales))),
        "top10_products": on_sales(
            lambda sales: reports.chart_order(reports.top_products(sales), "product")
        ),
        "transaction_search": on_sales(
            lambda sales: reports.transaction_search(sales, "WIDGET")
        ),
        "transaction_search_wildcard": on_sales(
            lambda sales: reports.transaction_search(sales, "red%b_lt")
        ),
        "transaction_search_escaped": on_sales(_escaped_search),
        "transaction_search_indexed": _indexed_search("WIDGET"),
        "transaction_search_wildcard_indexed": _indexed_search("red%b_lt"),
        "transaction_search_escaped_indexed": _indexed_search(
            "widget\\50", _with_escapes, "escaped-index"
        ),
        "like_for_like": on_sales(lambda sales: reports.like_for_like(sales, 2000)),
        "market_share": on_sales(reports.market_share),
        "service_line_leaders": on_sales(
            lambda sales: reports.service_line_leaders(sales, CHARGES)
        ),
        "null_customer_share": on_sales(reports.null_customer_share),
        "weekday_profile": on_sales(reports.weekday_profile),
        # weekly series and forecasts
        "weekly_complete": on_sales(lambda sales: weekly(sales).orderBy("week")),
        "seasonal_naive": on_sales(lambda sales: series.seasonal_naive(weekly(sales))),
        "holdout_split": on_sales(lambda sales: series.holdout_split(weekly(sales))),
        "future_weeks": on_sales(
            lambda sales: series.future_weeks(
                series.holdout_split(weekly(sales)).where("split = 'train'")
            )
        ),
        "naive_metrics": on_sales(lambda sales: _metrics(_naive(sales))),
        "peak_week": on_sales(
            lambda sales: forecasting.peak_week(_naive(sales), {"naive": forecasting.NAIVE})
        ),
        "peak_week_comparison": on_sales(
            lambda sales: forecasting.peak_week(
                forecasting.compare(weekly(sales)),
                {"naive": forecasting.NAIVE, "additive": forecasting.ADDITIVE},
            )
        ),
        "naive_metrics_by_country": on_sales(
            lambda sales: _metrics(_naive(sales, ("Country",), strict=False), ("Country",))
        ),
        "model_comparison_rule": on_sales(_rule_comparison),
        "forecast_linear": on_sales(_linear_forecast),
        "forecast_additive": on_sales(
            lambda sales: forecasting.additive_predictions(weekly(sales))
        ),
        "forecast_frame": on_sales(
            lambda sales: forecast_ahead(
                # A few hundred rows, read for the history and for its last week.
                series.holdout_split(materialise(weekly(sales), "weekly")).where("split = 'train'"),
                series.TEST_WEEKS,
            )
        ),
        "forecast_comparison": on_sales(
            lambda sales: _metrics(forecasting.compare(weekly(sales)))
        ),
        "forecast_comparison_by_country": on_sales(
            lambda sales: _metrics(
                forecasting.compare(weekly(sales, ("Country",)), ("Country",), strict=False),
                ("Country",),
            )
        ),
        "rolling_origin_naive": on_sales(_rolling_naive),
        "rolling_origin_comparison": on_sales(
            lambda sales: _metrics(
                forecasting.compare(_rolling(sales), ("origin",), strict=False), ("origin",)
            )
        ),
        # customers
        "rfm": on_sales(lambda sales: rfm.rfm(sales).orderBy("customer_id")),
        "rfm_by_customer": lambda s, d: money_to_double(
            by_customer.customers(_by_customer(s, d)).orderBy("customer_id")
        ),
        "rfm_summary": on_customers(_summary),
        "rfm_medians": on_customers(lambda c: quantiles.exact_medians(c, rfm.METRICS)),
        "rfm_scaled": on_customers(
            lambda c: _rounded(rfm.standardised(rfm.features(c)), *rfm.FEATURES)
        ),
        "persona_rule": on_customers(lambda c: segment_profile(_frequency_tiers(c))),
        "kmeans_fixed_start": _kmeans_fixed_start,
        "inertia_fixed_starts": _inertia_fixed_starts,
        "silhouette_rule": _silhouette_rule,
        "silhouette_euclidean": lambda s, d: _silhouette_rule(s, d, segmentation.EUCLIDEAN),
        "k_by_measure": lambda s, d: segmentation.choices(_search(s, d)),
        "k_selection": lambda s, d: _segments(s, d).scores,
        "segments": lambda s, d: money_to_double(_segments(s, d).customers),
        "segment_profile": lambda s, d: money_to_double(_segments(s, d).profile),
        **(llm_queries.queries() if llm_queries else {}),
    }


def oracle_sql() -> dict[str, str]:
    return oracle_queries.oracle_sql() | (llm_queries.oracle_sql() if llm_queries else {})


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: monthly revenue with orders and the running total."""
    return queries()["monthly_trend"](spark, FLAGSHIP_DIR)
