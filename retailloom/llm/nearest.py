"""Operator 6: nearest vectors by inner product, exactly, as a block matrix join.

Vectors are packed into blocks. Every block of queries meets every block of vectors in a tile.
There, products of int8 codes give each score up to a bound on the quantisation error; a pair whose
upper bound is below the query's k-th best lower bound cannot be among the nearest. The others are
computed again in double precision, component by component in order, and go into the query's heap.
A task keeps one heap per query over all its tiles; the heaps of different tasks are merged last.

Vectors that are null, empty or zero, or hold null, NaN or infinite components take no part, nor
do rows without vec_id. A score that is no number, as infinite products of both signs add up to, counts as
minus infinity. Rows that repeat a vec_id must repeat its vector and count once. Only
vectors of equal length are compared. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailloom.llm.common import listed
from retailloom.session import materialise

NEAREST = 20
EVERY = 20  # queries are the rows whose vec_id this divides
BLOCK = 2048
QUERIES = 512
TINY = 1e-250  # products below have no digits to spare for bounds


def usable(vectors: DataFrame) -> DataFrame:
    odd = F.exists(
        "v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return (
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("embedding").cast("array<double>").alias("v"),
        )
        .where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~odd)
        .where(F.exists("v", lambda x: x != 0.0))
        .dropDuplicates(["vec_id"])
    )


def _packed(rows: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` vectors of one length, and how many block numbers there are."""
    parts = int(-(-rows.count() // size)) or 1
    numbered = rows.select(
        "vec_id", "v", F.size("v").alias("length"),
        F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("block"),
    )

    def pack(table: pa.Table) -> pa.Table:
        return pa.table(
            {
                "length": table["length"][:1],
                "block": table["block"][:1],
                "ids": pa.array([table["vec_id"].to_numpy()], pa.list_(pa.int64())),
                "values": pa.array([listed(table["v"])], pa.list_(pa.float64())),
            }
        )

    schema = "length int, block int, ids array<long>, values array<double>"
    return materialise(numbered.groupBy("length", "block").applyInArrow(pack, schema), name), parts


def quantised(matrix: np.ndarray):
    """Codes within int8, their step, and the lengths of the coded vector and of its error. Components
    so large or small that these leave the range of doubles have an error without bound."""
    with np.errstate(all="ignore"):
        step = np.abs(matrix).max(1) / 127
        codes = np.nan_to_num(np.rint(matrix / step[:, None]))
        coded = codes * step[:, None]
        length, error = np.linalg.norm(coded, axis=1), np.linalg.norm(matrix - coded, axis=1)
    wild = ~((step > TINY) & np.isfinite(length) & np.isfinite(error))
    codes[wild], step[wild], length[wild], error[wild] = 0, 0.0, 0.0, np.inf
    return codes.astype(np.int8), step, length, error


def exact(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows, added up in the order of the components. Products beyond the range of doubles
    are infinite, as doubles have it; what is no number then (infinite parts of both signs) ranks last."""
    total = np.zeros(len(queries))
    with np.errstate(all="ignore"):
        for j in range(queries.shape[1]):
            total += queries[:, j] * vectors[:, j]
    return np.where(np.isnan(total), -np.inf, total)


def tile(q_ids, queries, coded_q, v_ids, vectors, coded_v, floor, k):
    """Pairs that may be among the k nearest: positions and double-precision scores. ``floor`` is
    the k-th best score known of each query so far."""
    (cq, sq, nq, eq), (cv, sv, nv, ev) = coded_q, coded_v
    # Products of codes are whole numbers, exact while the sums stay below what the type holds.
    kind = np.float32 if 127 * 127 * queries.shape[1] < 1 << 24 else np.float64
    with np.errstate(all="ignore"):
        near = (cq.astype(kind) @ cv.astype(kind).T).astype(np.float64) * (sq[:, None] * sv)
        error = (eq[:, None] * (nv + ev) + nq[:, None] * ev) * (1 + 1e-9) + 1e-12 * nq[:, None] * nv
        lower, upper = near - error, near + error
    # A bound that is no finite number, or so small that digits are lost, rules nothing out.
    loose = ~(np.isfinite(lower) & np.isfinite(upper)) | (nq[:, None] * nv < TINY)
    lower[loose], upper[loose] = -np.inf, np.inf
    own = q_ids[:, None] == v_ids
    lower[own] = -np.inf
    upper[own] = -np.inf
    if len(v_ids) >= k:
        floor = np.maximum(floor, np.partition(lower, len(v_ids) - k, axis=1)[:, len(v_ids) - k])
    row, col = np.nonzero((upper >= floor[:, None]) & ~own)
    return row, col, exact(queries[row], vectors[col])


def nearest(vectors: DataFrame, k: int = NEAREST, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows of every query."""
    rows = materialise(usable(vectors), "vectors")
    blocks, _ = _packed(rows, BLOCK, "blocks")
    asked, parts = _packed(rows.where(F.col("vec_id") % every == 0), QUERIES, "queries")
    asked = asked.select("length", F.col("block").alias("asked"), F.col("ids").alias("q_ids"), F.col("values").alias("q_values"))
    # Every block of queries against every block of rows: a stated query set, in blocks.
    tiles = blocks.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(
        asked, ["length", "asked"]
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                length = batch.column(0)[i].as_py()
                v_ids, v_flat, q_ids, q_flat = (
                    batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(1, 5)
                )
                q, v = q_flat.reshape(-1, length), v_flat.reshape(-1, length)
                coded_v = quantised(v)
                for low in range(0, len(q_ids), 128):
                    part = slice(low, low + 128)
                    ids = q_ids[part]
                    floor = np.array(
                        [h[0][0] if len(h := heaps.setdefault(int(x), [])) == k else -np.inf for x in ids]
                    )
                    row, col, score = tile(
                        ids, q[part], quantised(q[part]), v_ids, v, coded_v, floor, k
                    )
                    for r, c, s in zip(ids[row].tolist(), v_ids[col].tolist(), score.tolist(), strict=True):
                        heap = heaps[r]
                        if len(heap) < k:
                            heapq.heappush(heap, (s, -c))
                        elif (s, -c) > heap[0]:
                            heapq.heapreplace(heap, (s, -c))
        found = [(q, -c, s) for q, heap in heaps.items() for s, c in heap]
        columns = list(zip(*found, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())],
            names=["query_id", "vec_id", "score"],
        )

    found = tiles.select("length", "ids", "values", "q_ids", "q_values").mapInArrow(
        search, "query_id long, vec_id long, score double"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
