"""Command line: build the table, print reports, forecast and segment.

    python -m retailloom build    --raw sheet1.csv sheet2.csv --format csv --table PATH
    python -m retailloom report   kpis --table PATH --start 2010-12-01 --end 2011-11-30
    python -m retailloom sql      --table PATH "SELECT COUNT(*) FROM sales WHERE Country = ?" France
    python -m retailloom forecast --table PATH --out FOLDER
    python -m retailloom segment  --table PATH --out FOLDER
    python -m retailloom increment --raw december.parquet --load FOLDER
    python -m retailloom prepare  --table PATH --out FOLDER
    python -m retailloom report   search --table PATH --prepared FOLDER --term heart

Also runs under spark-submit; master and cluster settings then come from there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame

from retailloom.operators import filters, quantiles, rfm, rollup, series
from retailloom.plans import (
    build,
    forecasting,
    increments,
    reports,
    search_index,
    segmentation,
)
from retailloom.session import materialise, remove, scratch_made, submitted_session
from retailloom.sources import raw, warehouse

REPORTS = {
    "monthly_trend": reports.monthly_trend,
    "growth": reports.growth,
    "growth_tile": reports.growth_tile,
    "top_products_by_country": reports.top_products_by_country,
    "kpis": reports.kpis,
    "top_market": reports.top_market,
    "top_markets": reports.top_markets,
    "top_products": reports.top_products,
    "countries": reports.filter_countries,
    "date_bounds": reports.date_bounds,
    "market_share": reports.market_share,
    "service_line_leaders": reports.service_line_leaders,
    "null_customer_share": reports.null_customer_share,
    "weekday_profile": reports.weekday_profile,
}


PREPARED = ("kpis", "monthly_trend", "search")
SCREEN = 100  # rows on the screen; --out has them all


def _show(df: DataFrame, out: str | None = None) -> None:
    """Print a result, and say so if the screen does not have all of it."""
    if out:
        warehouse.write_csv(df, out)
    some = df.limit(SCREEN + 1).toPandas()
    df.limit(SCREEN).show(SCREEN, truncate=False)
    if len(some) > SCREEN:
        print(f"The first {SCREEN} rows." + ("" if out else " --out FOLDER writes all of them."))


def _build(spark, args) -> None:
    lines = raw.read_raw(spark, args.raw, args.format)
    if args.format == "csv":  # the load reads its lines several times; the text is parsed once
        lines = materialise(lines, "raw-lines")
    done = build.load(lines, args.table)
    _show(done.report)
    _show(done.audit)


def _increment(spark, args) -> None:
    lines = raw.read_raw(spark, args.raw, args.format)
    if args.format == "csv":
        lines = materialise(lines, "raw-lines")
    months = increments.apply(lines, args.load)
    print("Written anew:", ", ".join("without date" if m is None else f"{m:%Y-%m}" for m in months) or "nothing")
    _show(increments.report(spark, args.load))


def _prepare(spark, args) -> None:
    sales = warehouse.read_sales(spark, args.table)
    rollup.build(sales, f"{args.out}/rollup")
    search_index.build(sales, f"{args.out}/search")


def _prepared_report(spark, args, sales: DataFrame) -> DataFrame:
    """The reports that need no scan of all lines in the range, if ``prepare`` has run."""
    bounds = (args.start, args.end, args.country)
    if args.name == "search":
        index = search_index.read(spark, f"{args.prepared}/search", sales)
        return search_index.transaction_search(index, args.term, search_index.LATEST, *bounds)
    totals = rollup.read(spark, f"{args.prepared}/rollup", sales)
    return {"kpis": rollup.kpis, "monthly_trend": rollup.monthly_trend}[args.name](totals, *bounds)


def _report(spark, args) -> None:
    sales = warehouse.read_sales(spark, args.table)
    if (args.start is None) != (args.end is None):
        raise SystemExit("--start and --end go together")
    if args.prepared:
        if args.name not in PREPARED:
            raise SystemExit(f"--prepared serves {', '.join(PREPARED)}")
        _show(_prepared_report(spark, args, sales), args.out)
        return
    sales = filters.filter_sales(sales, args.start, args.end, args.country)
    if args.name == "search":
        _show(reports.transaction_search(sales, args.term), args.out)
    elif args.name == "like_for_like":
        _show(reports.like_for_like(sales, args.year, args.month), args.out)
    else:
        _show(REPORTS[args.name](sales), args.out)


def _sql(spark, args) -> None:
    sales = warehouse.read_sales(spark, args.table)
    _show(warehouse.run_query(spark, args.text, args.values, sales), args.out)


def _forecast(spark, args) -> None:
    weekly = materialise(series.complete_weeks(warehouse.read_sales(spark, args.table)), "weekly")
    predictions = materialise(forecasting.compare(weekly), "predictions")
    metrics = forecasting.accuracy(predictions)
    _show(metrics)
    if args.origins > 1:
        by = ("origin",)
        earlier = forecasting.compare(forecasting.rolling_origins(weekly, args.origins), by, strict=False)
        _show(forecasting.accuracy(earlier, by).orderBy("origin", "model"))
    models = {"seasonal_naive": forecasting.NAIVE, "additive": forecasting.ADDITIVE}
    _show(forecasting.peak_week(predictions, models))
    forecasting.write_results(metrics, args.out)


def _segment(spark, args) -> None:
    result = segmentation.segment(warehouse.read_sales(spark, args.table), measure=args.silhouette)
    _show(quantiles.distribution_summary(result.customers, rfm.METRICS))
    _show(result.scores)
    _show(result.profile)
    segmentation.write_results(result, args.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="retailloom", description=__doc__.splitlines()[0])
    commands = top.add_subparsers(required=True)

    def command(name, run, where="--table", what="folder of the stored sales table"):
        sub = commands.add_parser(name)
        sub.add_argument(where, required=True, help=what)
        sub.set_defaults(run=run)
        return sub

    for sub in (
        command("build", _build),
        command("increment", _increment, "--load", "folder of the load; its table is in sales"),
    ):
        sub.add_argument("--raw", nargs="+", required=True, help="exported sheets")
        sub.add_argument("--format", default="parquet", choices=["parquet", "csv"])
    sub = command("prepare", _prepare)
    sub.add_argument("--out", required=True, help="folder for the rollup and the search index")
    sub = command("report", _report)
    sub.add_argument("name", choices=[*REPORTS, "search", "like_for_like"])
    sub.add_argument("--out", help="folder for the whole result as CSV")
    sub.add_argument("--start")
    sub.add_argument("--end")
    sub.add_argument("--country", nargs="*", default=[])
    sub.add_argument("--term", default="")
    sub.add_argument("--prepared", help="folder that prepare has written")
    sub.add_argument("--year", type=int)
    sub.add_argument("--month", type=int, default=11)
    sub = command("sql", _sql)
    sub.add_argument("text")
    sub.add_argument("values", nargs="*")
    sub.add_argument("--out", help="folder for the whole result as CSV")
    sub = command("forecast", _forecast)
    sub.add_argument("--out", required=True)
    sub.add_argument("--origins", type=int, default=1, help="also score the models at so many earlier quarters")
    sub = command("segment", _segment)
    sub.add_argument("--out", required=True)
    sub.add_argument(
        "--silhouette",
        choices=segmentation.MEASURES,
        default=segmentation.SQUARED,
        help="distance by which k is chosen; euclidean compares all customers with all",
    )
    return top


def main(argv=None) -> None:
    args = parser().parse_args(argv)
    spark = submitted_session()
    try:
        with scratch_made() as paths:
            args.run(spark, args)
    finally:
        remove(spark, paths)


if __name__ == "__main__":
    main()
