import random

import numpy as np
import pyarrow as pa
import pytest

from retailloom.llm import ngram_join
from retailloom.llm.components import components


def brute(rows):
    sets = {}
    for doc, text in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        n = len(words)
        sets[doc] = {tuple(words[i : i + 5]) for i in range(max(n - 4, min(n, 1)))}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((d, len(sets[d]), find(d)) for d in ids)


@pytest.mark.parametrize("limit", [None, 0, 12], ids=["by cost", "lists only", "subsets"])
def test_like_brute_force(corpus, awkward, limit, monkeypatch):
    rng = random.Random(3)
    rows = list(awkward)
    base = {n: [f"x{i}" for i in range(n)] for n in (6, 9, 12, 16, 40)}
    for i in range(60):
        words = list(rng.choice(list(base.values())))
        for _ in range(rng.randint(0, 2)):
            words[rng.choice([0, -1, rng.randrange(len(words))])] = f"y{rng.randint(0, 3)}"
        rows.append((100 + i, " ".join(words[rng.randint(0, 1) :])))
    if limit is not None:
        monkeypatch.setattr(ngram_join, "boundary", lambda sets: limit)
    got = ngram_join.digest(corpus(rows)).collect()
    assert sorted(map(tuple, got)) == brute(sorted({r for r in rows if r[0] is not None}))


def test_copies_in_descending_order(spark):
    base = [f"x{i}" for i in range(60)]
    near = [*base[:-1], "other"]
    rows = [(50, " ".join(base)), (7, " ".join(near)), (9, None), (3, " ".join(base)), (60, " ".join(near)), (3, " ".join(base))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = ngram_join.digest(docs).collect()
    assert sorted(map(tuple, got)) == brute(rows)
    assert {r.component_id for r in got if r.doc_id != 9} == {3}


def test_marks_never_differ_in_more_bits_than_tokens():
    rng = np.random.default_rng(4)
    pool = rng.integers(1, 1 << 47, 9000)
    sets = [rng.choice(pool, n, replace=False) for n in (1, 6, 200, 250, 257, 300, 900, 1100, 6000, 8000)]
    sets += [np.r_[s[: len(s) * 9 // 10], rng.integers(1 << 47, 1 << 48, len(s) // 10)] for s in sets]
    marks = ngram_join._Marks(pa.chunked_array([[ngram_join._marks(s, len(s)) for s in sets]]))
    for i, x in enumerate(sets):
        near = [j for j, y in enumerate(sets) if 3 * len(x) <= 4 * len(y) and 3 * len(y) <= 4 * len(x)]
        bound = marks.differing(i, np.array(near))
        true = [len(set(x.tolist()) ^ set(sets[j].tolist())) for j in near]
        assert (bound <= true).all() and bound[near.index(i)] == 0


def test_empty_table(corpus):
    assert ngram_join.digest(corpus([])).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r.node, r.component) for r in got} == {(i, 1) for i in range(1, 41)} | {
        (100 + i, 100) for i in range(30)
    }
