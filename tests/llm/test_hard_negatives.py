import itertools
import math
import random

import duckdb
import numpy as np
import pytest

from retailloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows):
    kept = {}
    for vec_id, v, label in rows:
        if None in (vec_id, v, label) or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id % 7 == 0:
            label = (label + 1) % 10
        kept[vec_id] = min(kept.get(vec_id, (v, label)), (v, label))
    kept = {i: ([math.floor(256 * x) for x in v], label) for i, (v, label) in kept.items()}
    out = []
    for a, (v, label) in kept.items():
        if a % 50:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(v, w, strict=True)), i, other)
            for i, (w, other) in kept.items() if i != a and len(w) == len(v)
        )
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            fits = [(-n, i) for n, i, other in scored if other != label and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out += [(a, positive, r, i, -p, n) for r, (n, i) in enumerate(fits, 1)]
    return sorted(out)


def found(spark, rows):
    return sorted(map(tuple, hn.digest(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()))


@pytest.mark.parametrize("rows,anchors", [(hn.ROWS, hn.ANCHORS), (97, 3)])
def test_like_brute_force(spark, monkeypatch, rows, anchors):
    monkeypatch.setattr(hn, "ROWS", rows)
    monkeypatch.setattr(hn, "ANCHORS", anchors)
    rng = random.Random(4)
    centres = [[rng.gauss(0, 0.4) for _ in range(6)] for _ in range(4)]
    table = []
    for i in range(-150, 450):
        label = rng.randrange(4)
        v = [x + rng.gauss(0, 0.2) for x in centres[label]]
        table.append((i, v if rng.random() < 0.9 else centres[rng.randrange(4)], label))
    table += [(1000 + i, centres[0], 0) for i in range(60)]  # copies: ties by vec_id
    table += [
        (2000, None, 1), (2050, [0.1] * 6, None), (None, [0.1] * 6, 1), (2100, [0.1] * 5 + [None], 1), (2150, [float("nan")] * 6, 1),
        (2200, [float("inf")] * 6, 1), (2250, [0.5] * 3, 1), (2251, [0.5] * 3, 1), (2252, [0.4] * 3, 2), (2300, [], 1), (2301, [], 1),
        (2302, [], 3), (2350, [0.0] * 6, 2), (50, table[200][1], table[200][2]), table[0], table[0],
    ]
    got = found(spark, table)
    assert got == brute(table) and len(got) > 50


def test_large_numbers_and_their_limit(spark):
    rng = random.Random(5)
    table = [(i, [rng.choice([1.0, 3.0, 2.0]) * 2.0**19 + rng.randrange(9) for _ in range(4)], i % 2) for i in range(110)]
    assert found(spark, table) == brute(table) != []
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(50, [1e300], 1), (51, [1.0], 1)])


def test_keys_sort_as_wanted():
    values = [-(2**63), -5, -1, 0, 1, 7, 2**63 - 1]
    pairs = list(itertools.product(values, values, (0, 1), values[1:4]))
    keys = [k for a, s, kind, r in pairs for k in hn.packed_keys(*(np.array([x]) for x in (a, s)), kind, np.array([r]))]
    assert [hn.unpacked(k) for k in keys] == pairs
    assert sorted(range(len(keys)), key=keys.__getitem__) == sorted(
        range(len(keys)), key=lambda i: (pairs[i][0], -pairs[i][1], pairs[i][2], pairs[i][3])
    )


def test_empty_table_and_clashing_columns(spark):
    assert found(spark, []) == []
    table = [(i, [i % 9 / 8, i % 5 / 4], i % 3) for i in range(120)]
    more = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1 AS block", "2 AS score", "3 AS rank", "4 AS anchor")
    assert sorted(map(tuple, hn.digest(more).collect())) == brute(table)


def test_table_like_sql(spark):
    path = "/root/testdata/sf0.01/embeddings.parquet"
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{path}'")
    got = sorted(map(tuple, hn.digest(spark.read.parquet(path)).collect()))
    assert got == sorted(duckdb.sql(hn.ORACLE).fetchall()) and got


def test_no_copies_of_blocks_are_broadcast(spark, monkeypatch):
    plans, sort = [], hn.sorted_stream

    def kept(keys):
        plans.append(keys._jdf.queryExecution().optimizedPlan().toString())
        return sort(keys)

    monkeypatch.setattr(hn, "sorted_stream", kept)
    monkeypatch.setattr(hn, "ROWS", 9)
    monkeypatch.setattr(hn, "ANCHORS", 2)
    table = [(i, [i % 9 / 8, i % 5 / 4], i % 3) for i in range(500)]
    assert found(spark, table) == brute(table)
    joins = [line for plan in plans for line in plan.splitlines() if " Join " in line]
    # Of the windows alone, one row for a block of anchors; copies come by the shuffle of a cogroup.
    assert len(plans) == 2 and len(joins) == 1
    assert "FlatMapCoGroupsInArrow" in plans[0] and "Join " not in plans[0]


@pytest.mark.parametrize("held", [1, 200, 1 << 20])
def test_sides_and_stripes(spark, monkeypatch, held):
    monkeypatch.setattr(hn, "ROWS", 25)
    monkeypatch.setattr(hn, "ANCHORS", 3)
    monkeypatch.setattr(hn, "HELD", held)
    monkeypatch.setattr(hn, "buckets", lambda spark: 2)
    rng = random.Random(8)
    # Few different scores, so that ties go through tiles, stripes and the sort.
    table = [(i, [rng.randrange(4) / 4 for _ in range(3 + i % 2)], rng.randrange(3)) for i in range(700)]
    got = found(spark, table)
    assert got == brute(table) and len(got) > 50
