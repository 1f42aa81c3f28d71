"""The first-in-first-out match, against hand cases and a plain queue."""

import random
from collections import defaultdict

import pytest
from conftest import day
from pyspark.sql import functions as F

from retailloom.operators import cleaning, returns


def sale(d, invoice=None, **more):
    return {"Invoice": invoice or f"s{d}", "InvoiceDate": day(d), **more}


def cancel(d, invoice=None, **more):
    return {"Invoice": invoice or f"C{d}", "InvoiceDate": day(d), "Quantity": -5, **more}


CASES = {
    "exact": ([sale(1), cancel(2)], []),
    "same instant": ([sale(1), cancel(1)], []),
    "return first": ([cancel(1), sale(2)], ["s2"]),
    "head blocks": ([cancel(1), sale(2), cancel(3)], []),
    "earliest, not nearest": ([sale(1), sale(2), cancel(3)], ["s2"]),
    "more returns than sales": ([sale(1), cancel(2), cancel(3)], []),
    "interleaved": ([sale(1), cancel(2), cancel(3), sale(4), cancel(5)], []),
    "unmatched return is not kept for later": ([sale(1), cancel(2), cancel(3), sale(4)], ["s4"]),
    "equal returns each take one": ([sale(1), sale(2), cancel(3), cancel(3)], []),
    "equal sales are one": ([sale(1), sale(1), cancel(2), cancel(2)], []),
    "partial return": ([sale(1), cancel(2, Quantity=-3)], ["s1"]),
    "no customer": ([sale(1, CustomerID=None), cancel(2, CustomerID=None)], ["s1"]),
    "no product": ([sale(1, StockCode=None), cancel(2, StockCode=None)], ["s1"]),
    "no date": ([sale(1, InvoiceDate=None), cancel(2)], ["s1"]),
    "positive quantity on a return": ([sale(1), cancel(2, Quantity=5)], []),
    "other customer": ([sale(1), cancel(2, CustomerID=2)], ["s1"]),
    "ties go by invoice": ([sale(1, "b"), sale(1, "a"), cancel(2)], ["b"]),
    "free return still matches": ([sale(1), cancel(2, Price=0)], []),
}


@pytest.fixture(scope="module")
def kept_by_case(raw_frame):
    """All cases in one job; each has a product of its own."""
    rows = []
    for name, (events, _) in CASES.items():
        for event in events:
            code = None if event.get("StockCode", 1) is None else name
            rows.append({**event, "StockCode": code, "Country": name})
    kept = defaultdict(list)
    for row in cleaning.clean(raw_frame(rows)).collect():
        kept[row.Country].append(row.Invoice)
    return kept


@pytest.mark.parametrize("name", CASES)
def test_hand_case(kept_by_case, name):
    assert sorted(kept_by_case[name]) == sorted(CASES[name][1])


def queue(rows):
    """Step through the returns one by one."""
    sales, pairs, dropped = defaultdict(list), [], []
    ordered = sorted((r for r in rows if r["Invoice"][0] != "C"), key=lambda r: (r["InvoiceDate"], r["Invoice"]))
    for r in ordered:
        sales[r["CustomerID"], r["StockCode"], r["Quantity"]].append(r)
    returned = sorted((r for r in rows if r["Invoice"][0] == "C"), key=lambda r: (r["InvoiceDate"], r["Invoice"]))
    for r in returned:
        waiting = sales[r["CustomerID"], r["StockCode"], -r["Quantity"]]
        if waiting and waiting[0]["InvoiceDate"] <= r["InvoiceDate"]:
            taken = waiting.pop(0)
            dropped.append(taken["Invoice"])
            pairs.append((r["Invoice"], taken["Invoice"]))
    return dropped, pairs


def random_rows(seed, n, customers):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        is_cancel = rng.random() < 0.45
        rows.append(
            {
                "Invoice": f"C{i // 2}" if is_cancel else f"s{i:05d}",
                "CustomerID": rng.randint(1, customers),
                "StockCode": rng.choice("AB"),
                "Quantity": rng.choice([5, 6]) * (-1 if is_cancel else 1),
                "InvoiceDate": day(rng.randint(1, 40)),
            }
        )
    return rows


@pytest.mark.parametrize(
    "seed, n, customers", [(1, 600, 30), (2, 400, 3), (3, 500, 1)], ids=["many keys", "few", "hot"]
)
def test_against_a_queue(raw_frame, seed, n, customers):
    """With few keys, each spans several blocks, so the chaining is exercised."""
    rows = random_rows(seed, n, customers)
    dropped, pairs = queue(rows)
    raw = raw_frame(rows)
    events = cleaning.match_returns(raw)
    if customers == 1:
        blocks = events.groupBy("StockCode", "Quantity").agg(F.count_distinct("block").alias("n"))
        assert blocks.agg(F.max("n")).first()[0] > 1
    found = returns.pairs(events).collect()
    assert sorted((r.cancel_invoice, r.sale_invoice) for r in found) == sorted(pairs)
    assert sorted(r.Invoice for r in returns.netted_sales(events).collect()) == sorted(dropped)
    assert returns.matched_count(events).first().matched == len(dropped)


def test_large_batch_is_spread_over_its_ordinals(raw_frame, monkeypatch):
    monkeypatch.setattr(returns, "SPREAD", 3)
    rows = [sale(1, f"s{i:02d}") for i in range(10)] + [cancel(2, "C")] * 8
    events = cleaning.match_returns(raw_frame(rows))
    found = returns.pairs(events).collect()
    assert sorted(r.sale_invoice for r in found) == [f"s{i:02d}" for i in range(8)]
    assert {r.cancel_invoice for r in found} == {"C"}


def test_match_rate(raw_frame):
    raw = raw_frame([sale(1), cancel(2), cancel(3), cancel(4, CustomerID=None)])
    row = returns.match_rate(cleaning.match_returns(raw), cleaning.cancellations(raw)).first()
    assert row.asDict() == {"matched": 1, "cancels_with_customer": 2, "match_rate_pct": 50.0}


def test_a_hot_key_is_split_in_the_candidate_join(spark):
    """Too big to broadcast, the keys meet the sales in a join that adaptive execution can split."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "128KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        lines = spark.range(40_000).selectExpr(
            "string(id) AS Invoice",
            "if(id % 3 = 0, 'HOT', string(id % 1000)) AS StockCode",
            "uuid() AS Description",
            "1 AS Quantity",
            "timestamp_ntz'2020-01-01' AS InvoiceDate",
            "cast(1 AS decimal(12,4)) AS Price",
            "if(id % 3 = 0, 0, id % 1000) AS CustomerID",
            "'X' AS Country",
        )
        cancels = returns.cancel_batches(lines)
        found = returns.candidate_sales(lines, cancels)
        assert len(found.collect()) == 40_000
        assert "skew=true" in found._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@pytest.mark.parametrize("most", [returns.BUCKETS, 1])
def test_many_keys_pass_a_bitmap_first(raw_frame, monkeypatch, most):
    """The bitmap drops sales of other keys before the join moves them, and none of a key that was returned."""
    rows = random_rows(4, 400, 200) + [sale(3, f"other{i}", CustomerID=1000 + i) for i in range(300)]
    rows += [sale(4, "s-none", CustomerID=None), sale(5, "s-late", InvoiceDate=None, CustomerID=1)]
    valid = cleaning.valid_lines(raw_frame(rows))
    cancels = returns.cancel_batches(cleaning.cancellations(raw_frame(rows)))
    plain = returns.candidate_sales(valid, cancels).select(*valid.columns)
    monkeypatch.setattr(returns, "MANY_KEYS", 1)
    monkeypatch.setattr(returns, "BUCKETS", most)
    found = returns.candidate_sales(valid, cancels)
    assert found.count() == plain.count() and not found.select(*valid.columns).exceptAll(plain).count()
    keys = cancels.select(*returns.MATCH_KEY).distinct()
    passed = returns._maybe_among(valid, keys, keys.count())
    assert plain.count() <= passed.count() < plain.count() + 100


def test_events_are_moved_once_to_be_matched(raw_frame):
    """Only keys that lie in several blocks are chained, so the whole timeline has one shuffle."""
    events = cleaning.match_returns(raw_frame(random_rows(1, 600, 30)))
    several = {tuple(r) for r in returns._crossing(events).collect()}
    blocks = events.groupBy(*returns.MATCH_KEY).agg(F.count_distinct("block").alias("n")).collect()
    assert several == {tuple(r)[:3] for r in blocks if r.n > 1}
    assert 0 < len(several) <= 2 * events.select("block").distinct().count()
    plan = returns.netted_sales(events)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and plan.count("LeftSemi") == 2
