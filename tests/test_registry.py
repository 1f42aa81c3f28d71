"""Every registered query against the independent SQL."""

import re
import duckdb
import pytest
from conftest import SF_DIR

import __spark_entry__ as registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def other_engine():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def in_order(rows):
    return sorted(rows, key=lambda row: [(v is None, "" if v is None else v) for v in row])


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
    # The numbered operators and the pipeline have tests of their own.
    own = {q for q in QUERIES if not re.match(r"op\d+_|pipeline$", q)}
    assert own - set(ORACLE) == {
        "forecast_additive",
        "forecast_frame",
        "forecast_comparison",
        "forecast_comparison_by_country",
        "peak_week_comparison",
        "rolling_origin_comparison",
        "k_selection",
        "k_by_measure",
        "segments",
        "segment_profile",
    }


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_matches(spark, other_engine, name):
    found = QUERIES[name](spark, SF_DIR)
    want = other_engine.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    rows = [tuple(row[c] for c in columns) for row in found.collect()]
    assert in_order(rows) == in_order(want.fetchall())


def test_flagship(spark):
    assert registry.entry(spark).count() == 80


def test_forecasts(spark):
    assert QUERIES["forecast_additive"](spark, SF_DIR).count() == 13
    weeks = QUERIES["future_weeks"](spark, SF_DIR).count()
    assert QUERIES["forecast_frame"](spark, SF_DIR).count() == weeks
    rows = QUERIES["forecast_comparison"](spark, SF_DIR).collect()
    assert len(rows) == 2 and all(r.MAE > 0 for r in rows)
    peak = QUERIES["peak_week_comparison"](spark, SF_DIR).first()
    naive = QUERIES["peak_week"](spark, SF_DIR).first()
    assert (peak.week, peak.actual, peak.naive) == (naive.week, naive.actual, naive.naive)


@pytest.mark.parametrize("name", ["kpis_bound_sql", "like_for_like", "kpis_filtered"])
def test_a_date_range_prunes_months(spark, name):
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    scans = re.findall(r"PartitionFilters: \[(.*?)\], PushedFilters", plan)
    assert scans and all("sale_month" in s for s in scans)


def test_a_forecast_reads_its_weeks_from_one_small_table(spark):
    plan = QUERIES["forecast_frame"](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "/sales-" not in plan and "Quantity" not in plan


def test_models_are_compared_on_the_same_weeks(spark):
    rows = {(r.Country, r.model): r for r in QUERIES["model_comparison_rule"](spark, SF_DIR).collect()}
    by_country = {}
    for (country, _), row in rows.items():
        by_country.setdefault(country, set()).add(row.weeks_scored)
    assert all(len(n) == 1 for n in by_country.values())
    assert by_country["NATION_3"] == {0} and any(n != {0} for n in by_country.values())
    assert rows["NATION_3", "Seasonal naive (13w)"].MAE is None
    assert any(r["MAE_vs_baseline_%"] for r in rows.values())


def test_k_by_measure(spark):
    rows = QUERIES["k_by_measure"](spark, SF_DIR).collect()
    by = {m: [r for r in rows if r.measure == m] for m in ("squared", "euclidean")}
    assert [r.k for r in by["squared"]] == [r.k for r in by["euclidean"]] == list(range(2, 9))
    for some in by.values():
        best = max((r for r in some if r.k >= 3), key=lambda r: r.silhouette)
        assert [r.k for r in some if r.chosen] == [best.k]
    assert [r.silhouette for r in by["squared"]] == [
        r.silhouette for r in QUERIES["k_selection"](spark, SF_DIR).collect()
    ]


def test_segments(spark):
    scores = QUERIES["k_selection"](spark, SF_DIR).collect()
    assert [r.k for r in scores] == list(range(2, 9))
    assert all(a.inertia > b.inertia for a, b in zip(scores, scores[1:]))
    customers = QUERIES["segments"](spark, SF_DIR).count()
    assert customers == QUERIES["rfm"](spark, SF_DIR).count()
    profile = QUERIES["segment_profile"](spark, SF_DIR).collect()
    assert sum(r.customers for r in profile) == customers
