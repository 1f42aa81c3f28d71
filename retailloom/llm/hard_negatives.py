"""Operator 11: hard negatives for contrastive training, mined by a secondary-sort shuffle.

Vectors become whole numbers, floor(scale * x), so that scores are exact. Blocks of anchors meet
blocks of rows in tiles. A task takes the tiles of one side, some blocks of anchors, and one stripe, some
blocks of rows, and sends each anchor's best rows of the same label; the best of these are its positives.
A second pass sends, for each positive, the first rows of other labels inside its window, ``low`` to
``high`` hundredths of the positive's score. A block of rows is copied once a side and one of anchors once
a stripe, by a shuffle: a join of the copies would broadcast them where the anchors alone are small.

Each pair is packed into one key: anchor, falling score, positives before negatives of the same score, id,
as 25 bytes whose order is the wanted one. ``repartitionAndSortWithinPartitions`` deals the keys by anchor and sorts
them, and an iterator reads the stream: a positive opens its window, a negative goes to every open window that
it falls into, a full window closes. It holds the windows of one anchor, never its rows.

Rows with a null vec_id, label or vector, or any null, NaN or infinite component take no part. Rows
that repeat a vec_id count once; if they differ, the smallest (vector, label) stands. Only vectors of
equal length are compared; empty ones all score 0. A negative score opens no window, as its bounds
cross. Numbers and scores beyond 64 bits fail the job.
"""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retailloom.llm.common import buckets, listed, run_bounds
from retailloom.session import materialise

SCALE = 256
EVERY = 50  # anchors are the rows whose vec_id this divides
RELABELLED = 7  # where it divides the vec_id, the label moves on by one of LABELS
LABELS = 10
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95  # hundredths of a positive's score
ROWS = 4096  # in a block of rows
ANCHORS = 1024  # in a block of anchors
STEP = 128  # anchors whose scores are held at a time
HELD = 16 << 20  # bytes of the numbers of a side, and of a stripe
KEY = ">QQBQ"
SIGN = 1 << 63


def relabelled(vectors: DataFrame) -> DataFrame:
    """The table with every seventh label wrong, as the query wants it."""
    moved = F.col("vec_id") % RELABELLED == 0
    label = F.col("label").cast("long")
    return vectors.withColumn("label", F.when(moved, (label + 1) % LABELS).otherwise(label))


def usable(vectors: DataFrame) -> DataFrame:
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.col("label").cast("long").alias("label"),
    )
    known = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
    return rows.where(known & ~odd).groupBy("vec_id").agg(F.min(F.struct("v", "label")).alias("r")).select(
        "vec_id", "r.label", "r.v"
    )


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in as few bytes as hold them all."""
    with np.errstate(over="ignore"):
        numbers = np.floor(values * scale)
    most = np.abs(numbers).max(initial=0.0)
    if most >= 2.0**63:
        raise OverflowError("a component does not fit into 64 bits")
    kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
    return numbers.astype(kind)


def _block(column: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(parts)).cast("int")


def _packed(rows: DataFrame, size: int, scale: int, name: str) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` vectors of one length, by vec_id, and how many block numbers."""
    parts = math.ceil(rows.count() / size) or 1
    numbered = rows.withColumns({"length": F.size("v"), "block": _block("vec_id", parts)})

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("vec_id")
        numbers = whole_numbers(listed(table["v"]), scale)
        return pa.table(
            {
                "length": table["length"][:1],
                "block": table["block"][:1],
                "ids": pa.array([table["vec_id"].to_numpy()], pa.list_(pa.int64())),
                "labels": pa.array([table["label"].to_numpy()], pa.list_(pa.int64())),
                "width": pa.array([numbers.itemsize], pa.int32()),
                "numbers": pa.array([numbers.tobytes()], pa.binary()),
            }
        )

    schema = "length int, block int, ids array<long>, labels array<long>, width int, numbers binary"
    packed = numbered.groupBy("length", "block").applyInArrow(pack, schema)
    return materialise(packed, name), parts


def _blocks_within(packed: DataFrame, parts: int) -> int:
    """How many block numbers hold HELD bytes of numbers, at least one."""
    size = F.sum(F.size("ids").cast("long") * F.col("length") * F.col("width"))
    return max(1, HELD * parts // (packed.agg(size.alias("bytes")).first()["bytes"] or 1))


class Block:
    """A block read from a row of a table."""

    def __init__(self, table: pa.Table, i: int):
        self.length = table["length"][i].as_py()
        self.ids, self.labels = (table[c][i].values.to_numpy(zero_copy_only=False) for c in ("ids", "labels"))
        kind = f"<i{table['width'][i].as_py()}"
        self.matrix = np.frombuffer(table["numbers"][i].as_py(), kind).reshape(len(self.ids), -1)
        self.most = int(np.abs(self.matrix.astype(np.float64)).max(initial=0))


def scores(a: Block, b: Block, rows_a, rows_b) -> np.ndarray:
    """Inner products of whole numbers, exactly: in floating point while every sum is one of its
    whole numbers, else in Python's integers."""
    left, right = a.matrix[rows_a], b.matrix[rows_b]
    bound = a.most * b.most * max(1, left.shape[1])
    if bound < 1 << 24:
        return (left.astype(np.float32) @ right.T.astype(np.float32)).astype(np.int64)
    if bound < 1 << 53:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return (left.astype(object) @ right.T.astype(object)).astype(np.int64)


def first_of(score: np.ndarray, allowed: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest allowed scores of each row; of equal ones the first columns."""
    if score.shape[1] > 4 * k:
        least = np.iinfo(np.int64).min
        masked = np.where(allowed, score, least)
        floor = np.partition(masked, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        allowed = allowed & (score >= floor[:, None])
    row, col = np.nonzero(allowed)
    order = np.lexsort((col, ~score[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


#: Anchor, window of the anchor, row and score of pairs.
Pairs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
Search = Callable[[Block, Block], Iterator[Pairs]]


def positives_of(a: Block, b: Block, k: int) -> Iterator[Pairs]:
    """The k best rows of the anchors' own labels in a tile; all are of one window."""
    for label in np.unique(a.labels).tolist():
        mine, theirs = np.flatnonzero(a.labels == label), np.flatnonzero(b.labels == label)
        for low in range(0, len(mine) if len(theirs) else 0, STEP):
            some = mine[low : low + STEP]
            score = scores(a, b, some, theirs)
            row, col = first_of(score, a.ids[some][:, None] != b.ids[theirs], k)
            yield a.ids[some[row]], np.zeros(len(row), np.int64), b.ids[theirs[col]], score[row, col]


def negatives_of(
    a: Block, b: Block, windows: dict[int, list[int]], k: int, low: int, high: int
) -> Iterator[Pairs]:
    """The first k rows of other labels in every window of a tile; ``windows``: the scores of the
    positives of each anchor."""
    asked = np.array([i for i, x in enumerate(a.ids.tolist()) if x in windows], np.int64)
    for begin in range(0, len(asked), STEP):
        some = asked[begin : begin + STEP]
        score = scores(a, b, some, slice(None))
        other = a.labels[some][:, None] != b.labels
        # In floating point hundredfold scores would lose digits, so the bounds are made whole.
        bounds = [[(-(-low * p // 100), high * p // 100) for p in windows[x]] for x in a.ids[some].tolist()]
        for place in range(max(map(len, bounds))):
            least, most = np.array(
                [w[place] if place < len(w) else (1, 0) for w in bounds], np.int64
            ).T
            inside = other & (score >= least[:, None]) & (score <= most[:, None])
            row, col = first_of(score, inside, k)
            yield a.ids[some[row]], np.full(len(row), place, np.int64), b.ids[col], score[row, col]


def first_of_tiles(found: Iterable[Pairs], k: int) -> Pairs:
    """Of what several tiles found, the k highest scores of each window; of equal ones the first rows."""
    none = (np.zeros(0, np.int64),) * 4
    anchor, window, row, score = map(np.concatenate, zip(none, *found))
    order = np.lexsort((row, ~score, window, anchor))
    anchor, window, row, score = (x[order] for x in (anchor, window, row, score))
    heads, ends = run_bounds(anchor, window)
    first = np.arange(len(order)) - np.repeat(heads, ends - heads) < k
    return anchor[first], window[first], row[first], score[first]


def packed_keys(anchor: np.ndarray, score: np.ndarray, kind: int, row: np.ndarray) -> list[bytes]:
    """Keys whose bytes sort by anchor, falling score, kind and id."""
    table = np.empty(len(anchor), [("a", ">u8"), ("s", ">u8"), ("k", "u1"), ("r", ">u8")])
    sign = np.uint64(SIGN)
    table["a"] = anchor.astype(np.int64).view(np.uint64) ^ sign
    table["s"] = ~(score.astype(np.int64).view(np.uint64) ^ sign)
    table["k"] = kind
    table["r"] = row.astype(np.int64).view(np.uint64) ^ sign
    raw, size = table.tobytes(), table.itemsize
    return [raw[i : i + size] for i in range(0, len(raw), size)]


def unpacked(key: bytes) -> tuple[int, int, int, int]:
    """Anchor, score, kind, id."""
    anchor, score, kind, row = struct.unpack(KEY, key)
    return anchor - SIGN, (~score & (2 * SIGN - 1)) - SIGN, kind, row - SIGN


def sorted_stream(keys: DataFrame):
    """The keys as an RDD, each anchor's in one partition and in their order."""
    spark = keys.sparkSession
    return (
        keys.rdd.map(lambda r: (bytes(r[0]), None))
        .repartitionAndSortWithinPartitions(
            int(spark.conf.get("spark.sql.shuffle.partitions")), lambda key: zlib.crc32(key[:8])
        )
    )


def first_positives(stream, k: int) -> Iterator[tuple[int, int, int]]:
    """Anchor, row and score of the first k of every anchor."""
    anchor, taken = None, 0
    for key, _ in stream:
        mine, score, _kind, row = unpacked(key)
        if mine != anchor:
            anchor, taken = mine, 0
        if taken < k:
            taken += 1
            yield mine, row, score


def mined(stream, k: int, low: int, high: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Anchor, positive, rank, negative and both scores, as the windows fill."""
    anchor, last, windows = None, None, []
    for key, _ in stream:
        if key == last:  # one negative of several windows
            continue
        last = key
        mine, score, kind, row = unpacked(key)
        if mine != anchor:
            anchor, windows = mine, []
        if kind == 0:
            windows.append([row, score, 0])
            continue
        windows = [w for w in windows if w[2] < k and low * w[1] <= 100 * score]
        for window in windows:
            if 100 * score <= high * window[1]:
                window[2] += 1
                yield mine, window[0], window[2], row, window[1], score


def hard_negatives(
    vectors: DataFrame,
    every: int = EVERY,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    spark = vectors.sparkSession
    rows = materialise(usable(vectors), "vectors")
    blocks, n_blocks = _packed(rows, ROWS, scale, "row-blocks")
    anchors, n_asked = _packed(rows.where(F.col("vec_id") % every == 0), ANCHORS, scale, "anchor-blocks")
    # Each row of a side against each row of its stripe: a stated query set, in blocks.
    side = min(n_asked, _blocks_within(anchors, n_asked))
    sides = -(-n_asked // side)
    stripe = max(1, min(n_blocks * sides // buckets(spark), _blocks_within(blocks, n_blocks)))
    stripes = -(-n_blocks // stripe)
    # Little is sent for much work, so partitions must not be merged by their size.
    spread = min(4096, 2 * sides * stripes)

    def every_number(count: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(name)

    def group_of(length: int, name: str) -> Column:
        return F.floor(F.col("block") / length).cast("int").alias(name)

    def in_tiles(asking: DataFrame, search: Callable[[pa.Table, int], Search], k: int, kind: int) -> DataFrame:
        """Keys of the first k of every window in each side and stripe. ``search`` makes of a row with a block
        of anchors what is asked of its tiles."""

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            others = [Block(right, i) for i in range(right.num_rows)]
            keys = [pa.array([], pa.binary())]
            for i in range(left.num_rows if others else 0):
                mine, of_tile = Block(left, i), search(left, i)
                found = (pairs for b in others if b.length == mine.length for pairs in of_tile(mine, b))
                anchor, _, row, score = first_of_tiles(found, k)
                keys.append(pa.array(packed_keys(anchor, score, kind, row), pa.binary()))
            return pa.table({"key": pa.concat_arrays(keys)})

        left = asking.select("*", group_of(side, "side"), every_number(stripes, "stripe"))
        right = blocks.select("*", group_of(stripe, "part"), every_number(sides, "into"))
        return (
            left.repartition(spread, "side", "stripe")
            .groupBy("side", "stripe")
            .cogroup(right.repartition(spread, "into", "part").groupBy("into", "part"))
            .applyInArrow(both, "key binary")
        )

    def best(_table: pa.Table, _i: int):
        return lambda a, b: positives_of(a, b, positives)

    stream = sorted_stream(in_tiles(anchors, best, positives, 0))
    chosen = materialise(
        spark.createDataFrame(
            stream.mapPartitions(lambda s: first_positives(s, positives)),
            "anchor long, positive long, score long",
        ),
        "positives",
    )
    # One row per block of anchors, with at most ``positives`` windows of each.
    windows = chosen.groupBy(_block("anchor", n_asked).alias("block")).agg(
        F.collect_list("anchor").alias("w_anchors"), F.collect_list("score").alias("w_scores")
    )
    asking = anchors.join(materialise(windows, "windows"), "block")

    def within(table: pa.Table, i: int):
        opened: dict[int, list[int]] = {}
        for anchor, score in zip(table["w_anchors"][i].as_py(), table["w_scores"][i].as_py(), strict=True):
            if score >= 0:
                opened.setdefault(anchor, []).append(score)
        return lambda a, b: negatives_of(a, b, opened, negatives, low, high)

    found = in_tiles(asking, within, negatives, 1)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            anchor, row, score = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            keys = pa.array(packed_keys(anchor, score, 0, row), pa.binary())
            yield pa.RecordBatch.from_arrays([keys], names=["key"])

    pairs = found.unionByName(chosen.mapInArrow(opened, "key binary"))
    return spark.createDataFrame(
        sorted_stream(pairs).mapPartitions(lambda s: mined(s, negatives, low, high)),
        "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long",
    )


def digest(vectors: DataFrame) -> DataFrame:
    return hard_negatives(relabelled(vectors))


ORACLE = """
WITH e AS (
  SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
    CAST(CASE WHEN len(a.v) = 0 THEN 0 ELSE list_inner_product(a.v, b.v) END AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
    FROM scored WHERE label = own) WHERE place <= 5),
negatives AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives AS p JOIN scored AS n ON p.anchor_id = n.anchor_id AND n.label <> n.own
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 3
"""
