"""The indexed search against the search over all lines."""

import random
import shutil
from datetime import date, datetime, timedelta

import pytest

from retailloom.operators import filters
from retailloom.plans import reports, search_index
from retailloom.sources import warehouse

WORDS = ["Heart", "HEART", "lamp", "red_lamp", "50% off", "a\\b", "Öl", "tin", "of", "İstanbul", "set"]


@pytest.fixture(scope="module")
def stored(sales_frame, spark, tmp_path_factory):
    rng = random.Random(13)
    rows = []
    for i in range(2500):
        words = [rng.choice(WORDS) for _ in range(rng.randint(1, 3))]
        rows.append(
            {
                "Invoice": f"{i}",
                "Description": None if rng.random() < 0.05 else " ".join(words),
                "InvoiceDate": datetime(2020, 1, 1) + timedelta(hours=rng.randrange(24 * 600)),
                "Country": rng.choice("XXXYZ"),
                "Quantity": rng.randint(1, 9),
            }
        )
    rows += [{"Invoice": "undated", "Description": "heart without a date", "InvoiceDate": None}]
    path = str(tmp_path_factory.mktemp("search") / "sales")
    warehouse.write_sales(sales_frame(rows), path)
    sales = warehouse.read_sales(spark, path)
    return sales, search_index.build(sales, path + "-index"), path


TERMS = ["HEART LAMP", "", "of", "tin%set", "h_art", "50% off", "a\\b", "öl tin", "no such thing", "without a", "i̇stanbul"]


@pytest.mark.parametrize("term", TERMS)
@pytest.mark.parametrize("n", [500, 20])
def test_like_the_search_over_all_lines(stored, term, n):
    sales, index, _ = stored
    want = reports.transaction_search(sales, term, n)
    assert search_index.transaction_search(index, term, n).collect() == want.collect()
    some = filters.filter_sales(sales, "2020-03-10", "2021-02-03", ["X", "Z"])
    found = search_index.transaction_search(index, term, n, "2020-03-10", "2021-02-03", ["X", "Z"])
    assert found.collect() == reports.transaction_search(some, term, n).collect()


def test_needed_grams():
    assert search_index.needed_grams("Heart") == ["art", "ear", "hea"]
    assert search_index.needed_grams("ab%cdef_gh") == ["cde", "def"]
    assert search_index.needed_grams("%a_b%") == []


def test_months_are_opened_from_the_newest(stored, spark, tmp_path):
    """Twenty lines with a heart lie in the newest months; the files of all others are torn."""
    sales, index, path = stored
    found = search_index.matching(index, "heart")
    since, enough = search_index.first_month(index, found, 20)
    assert enough and since >= date(2021, 7, 1)
    copy = tmp_path / "sales"
    shutil.copytree(path, copy)
    torn = 0
    for folder in copy.glob("sale_month=*"):
        if folder.name < f"sale_month={since}" or "HIVE" in folder.name:
            torn += 1
            for part in folder.glob("part-*"):
                part.write_bytes(b"torn")
    assert torn >= 18
    half = search_index.read(spark, path + "-index", warehouse.read_sales(spark, str(copy)))
    want = reports.transaction_search(sales, "heart", 20).collect()
    assert search_index.transaction_search(half, "heart", 20).collect() == want
    with pytest.raises(Exception):
        search_index.transaction_search(half, "heart", 2000).collect()


def test_a_rare_term_opens_every_month(stored):
    _, index, _ = stored
    found = search_index.matching(index, "without a")
    assert search_index.first_month(index, found) == (None, False)
    assert [r.Description for r in found.collect()] == ["heart without a date"]
