import random
from datetime import datetime, timedelta

import pytest

from retailloom.__main__ import main

HEAD = "Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country\n"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Seventy weeks of sales in two sheets, some of them returned."""
    folder = tmp_path_factory.mktemp("shop")
    rng, lines, at = random.Random(1), [], datetime(2010, 1, 4)
    for i in range(1200):
        at += timedelta(hours=10)
        who, units = rng.randint(1, 40), rng.randint(1, 3)
        line = f"S{rng.randint(1, 4)},item,{{}},{{}},{rng.randint(1, 9)}.5,{who}.0,France\n"
        lines.append(f"{i}," + line.format(units, at))
        if i % 10 == 0:
            lines.append(f"C{i}," + line.format(-units, at + timedelta(hours=1)))
    for n in (0, 1):
        (folder / f"{n}.csv").write_text(HEAD + "".join(lines[n::2]))
    path = str(folder / "sales")
    main(["build", "--table", path, "--format", "csv", "--raw", f"{folder}/0.csv", f"{folder}/1.csv"])
    return path


def test_reports(table, capsys):
    main(["report", "kpis", "--table", table, "--start", "2010-02-01", "--end", "2010-03-01"])
    main(["report", "search", "--table", table, "--term", "IT_M"])
    main(["report", "like_for_like", "--table", table, "--year", "2011", "--month", "3"])
    main(["sql", "--table", table, "SELECT COUNT(*) AS n FROM sales WHERE Country = ?", "Nowhere"])
    out = capsys.readouterr().out
    assert "avg_order_value" in out and "growth_pct" in out and "|0  |" in out


def test_programs_write_their_results(table, spark, tmp_path, capsys):
    out = str(tmp_path)
    main(["forecast", "--table", table, "--out", out])
    metrics = spark.read.option("header", True).csv(f"{out}/forecast_metrics")
    assert metrics.columns == ["model", "MAE", "MAPE_%", "MAE_vs_baseline_%"]
    assert metrics.count() == 2
    main(["segment", "--table", table, "--out", out])
    profile = spark.read.option("header", True).csv(f"{out}/cluster_profiles")
    assert profile.columns == [
        "cluster", "customers", "recency_days", "frequency", "monetary", "total_revenue",
        "pct_of_customers", "pct_of_revenue", "persona",
    ]
    customers = spark.read.option("header", True).csv(f"{out}/rfm_clusters")
    assert customers.count() == 40


def test_whole_results_and_refused_dates(table, spark, tmp_path, capsys):
    out = str(tmp_path / "all")
    main(["sql", "--table", table, "--out", out, "SELECT Invoice FROM sales"])
    rows = spark.read.option("header", True).csv(out).count()
    assert rows > 100
    assert "The first 100 rows." in capsys.readouterr().out
    with pytest.raises(SystemExit):
        main(["report", "kpis", "--table", table, "--start", "2010-02-01"])


def test_prepared_reports(table, tmp_path, capsys):
    out = str(tmp_path / "prepared")
    main(["prepare", "--table", table, "--out", out])
    for name in (["kpis"], ["monthly_trend"], ["search", "--term", "iTe"]):
        report = ["report", *name, "--table", table, "--start", "2010-02-10", "--end", "2010-04-03", "--country", "France"]
        capsys.readouterr()
        main(report)
        want = capsys.readouterr().out
        main([*report, "--prepared", out])
        assert capsys.readouterr().out == want and len(want) > 200
    with pytest.raises(SystemExit, match="serves kpis"):
        main(["report", "growth", "--table", table, "--prepared", out])


def test_increments(spark, tmp_path, capsys):
    folder = str(tmp_path / "load")
    line = "{},S1,item,2,{},1.5,7.0,France\n"
    (tmp_path / "1.csv").write_text(HEAD + line.format("1", "2010-01-04 10:00:00") + line.format("2", "2010-02-04 10:00:00"))
    (tmp_path / "2.csv").write_text(HEAD + line.format("C3", "2010-03-04 10:00:00"))
    for name, months in (("1.csv", "2010-01, 2010-02"), ("2.csv", "2010-01")):
        main(["increment", "--load", folder, "--format", "csv", "--raw", str(tmp_path / name)])
        assert f"Written anew: {months}\n" in capsys.readouterr().out
    main(["sql", "--table", f"{folder}/sales", "SELECT Invoice FROM sales"])
    assert "|2      |" in capsys.readouterr().out
