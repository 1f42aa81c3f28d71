"""Operator 9: documents linked by the Jaccard similarity of their word shingles.

Size-aware heavy-light join. Documents with equal sets form a class first. Tokens are ordered by
how many documents hold them; a token that one document holds cannot be shared and is only counted.

* Small sets enumerate subsets: two sets of x and y shingles link exactly if they share a subset of
  the required overlap, so the subset itself is the join key and no list is scanned.
* Large sets scan inverted lists: linked sets share a token among the rarest of each, so only those
  are listed. The members of a list are first tried against one leader; after the components of
  these links are known, only pairs of different components are still tried. Lists of the same
  documents are tried once, and of their pairs only those whose parity marks leave a link possible:
  bits that differ are tokens that one of the two lacks, so no link is passed over.

The boundary is the size at which the counted costs of both add up to the least. Every pair is
decided by its exact overlap. Nothing is capped: a group of copies costs a star, not its pairs.

Null texts and texts without words have an empty set and link with nothing. doc_id is a key: rows
that repeat it must repeat its text; they count once. Rows without doc_id are left out.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailloom.llm.common import (
    Rolling,
    blocks,
    buckets,
    id_and_text,
    listed,
    lists,
    lower_ascii,
    mix,
    release,
    run_bounds,
    word_bounds,
    word_values,
)
from retailloom.llm.components import components
from retailloom.session import materialise

WORDS = 5
FLUSH = 1 << 19  # shingles gathered before they are dealt out
SMALL = 12  # sizes for which enumerating subsets is weighed against scanning lists


def shingles(data: np.ndarray, bounds: np.ndarray, words: int = WORDS):
    """Document and hash of the distinct shingles, by document and hash."""
    data = lower_ascii(data)
    starts, ends, limits = word_bounds(data, bounds)
    rolling = Rolling(word_values(data, starts, ends))
    count = np.diff(limits)
    number = np.where(count >= words, count - words + 1, np.minimum(count, 1))
    doc = np.repeat(np.arange(len(count)), number)
    at = limits[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)
    value = rolling.of(at, at + np.minimum(count, words)[doc])
    order = np.lexsort((value, doc))
    heads, _ = run_bounds(doc[order], value[order])
    return doc[order][heads], value[order][heads]


def _signatures(doc: np.ndarray, value: np.ndarray, count: int):
    """Size and two order-free hashes of each set."""
    size = np.bincount(doc, minlength=count)
    heads, _ = run_bounds(doc)
    out = []
    for salt in (0xA24BAED4963EE407, 0x9FB21C651E98DF25):
        total = np.zeros(count, np.uint64)
        if len(heads):
            total[doc[heads]] = np.add.reduceat(mix(value ^ np.uint64(salt)), heads)
        out.append(total.view(np.int64))
    return size, *out


def required(x, y):
    """Least overlap of linked sets of x and y shingles."""
    return -(-3 * (x + y) // 7)


def _sizes(docs: DataFrame, words: int) -> DataFrame:
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, bounds in blocks(batches):
            size, s1, s2 = _signatures(*shingles(data, bounds, words), len(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int64()), pa.array(s1), pa.array(s2)],
                names=["doc_id", "n", "s1", "s2"],
            )

    found = docs.mapInArrow(measure, "doc_id long, n long, s1 long, s2 long").dropDuplicates(["doc_id"])
    return materialise(found, "sizes")


def _dealt_tokens(docs: DataFrame, words: int, deal: int) -> DataFrame:
    """Tokens by bucket: 40 bits each beside the bucket; documents with their numbers of tokens."""

    def pack(parts, stands) -> pa.RecordBatch:
        doc, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        doc = np.array(stands, np.int64)[doc]
        bucket = ((value >> np.uint64(44)) % np.uint64(deal)).astype(np.int32)
        order = np.lexsort((doc, bucket))
        bucket, doc, value = bucket[order], doc[order], value[order]
        heads, ends = run_bounds(bucket, doc)
        keys, sizes = np.unique(bucket, return_counts=True)
        _, runs = np.unique(bucket[heads], return_counts=True)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(keys),
                lists((value & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), sizes),
                lists(((value >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8).view(np.int8), sizes),
                lists(doc[heads], runs),
                lists((ends - heads).astype(np.int32), runs),
            ],
            names=["bucket", "low", "high", "doc", "tokens"],
        )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, seen, stands = [], 0, {}, []
        for ids, data, bounds in blocks(batches):
            doc, value = shingles(data, bounds, words)
            marks = list(zip(*(x.tolist() for x in _signatures(doc, value, len(ids))), strict=True))
            place = np.full(len(ids), -1)
            # Of equal sets the smallest document stands for all, as it does for its class,
            # wherever its row comes.
            for i, (mark, own) in enumerate(zip(marks, ids.tolist(), strict=True)):
                at = seen.setdefault(mark, len(stands))
                if at == len(stands):
                    stands.append(own)
                    place[i] = at
                elif own < stands[at]:
                    stands[at] = own
            keep = place[doc] >= 0
            parts.append((place[doc[keep]], value[keep]))
            held += int(keep.sum())
            if held >= FLUSH:
                yield pack(parts, stands)
                parts, held, seen, stands = [], 0, {}, []
        if held:
            yield pack(parts, stands)

    return docs.mapInArrow(
        emit, "bucket int, low array<int>, high array<tinyint>, doc array<long>, tokens array<int>"
    )


def _shared(table: pa.Table, deal: int) -> pa.Table:
    """Of a bucket's tokens those that several documents hold, dealt out by document."""
    bucket = table["bucket"][0].as_py()
    doc = np.repeat(listed(table["doc"]), listed(table["tokens"]))
    key = (
        np.int64(bucket) << np.int64(40)
        | listed(table["high"]).view(np.uint8).astype(np.int64) << np.int64(32)
        | listed(table["low"]).view(np.uint32).astype(np.int64)
    )
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    heads, _ = run_bounds(key, doc)
    key, doc = key[heads], doc[heads]
    heads, ends = run_bounds(key)
    held = np.repeat(ends - heads, ends - heads)
    keep = held > 1
    key, doc, held = key[keep], doc[keep], held[keep]
    home = _home(doc, deal)
    order = np.lexsort((doc, home))
    home, doc, key, held = home[order], doc[order], key[order], held[order]
    heads, ends = run_bounds(home, doc)
    keys, sizes = np.unique(home, return_counts=True)
    _, runs = np.unique(home[heads], return_counts=True)
    release()
    return pa.table(
        {
            "home": pa.array(keys.astype(np.int32)),
            "doc": lists(doc[heads], runs),
            "tokens": lists((ends - heads).astype(np.int32), runs),
            "key": lists(key, sizes),
            "held": lists(held.astype(np.int32), sizes),
        }
    )


def _home(doc: np.ndarray, deal: int) -> np.ndarray:
    return (mix(doc.astype(np.int64).view(np.uint64)) >> np.uint64(8)) % np.uint64(deal)


SETS = "doc_id long, n long, tokens array<long>, rare array<long>, scan long, marks binary"
LEAST_MARKS, MOST_MARKS = 9, 13  # powers of two: bits of a set's marks, twice its size within these


def _marks(key: np.ndarray, n: int) -> bytes:
    """For each residue of the hashed tokens, whether an odd number of them has it."""
    width = 1 << min(max((2 * n - 1).bit_length(), LEAST_MARKS), MOST_MARKS)
    at = (mix(key.view(np.uint64)) % np.uint64(width)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=width) & 1).astype(np.uint8)).tobytes()


def _gather(table: pa.Table, members: pa.Table) -> pa.Table:
    """Sets of the documents that stand for their class: shared tokens, the rarest listed."""
    ids = members["doc_id"].to_numpy()
    sizes = members["n"].to_numpy()
    stands = ids == members["rep"].to_numpy()
    order = np.argsort(ids[stands])
    ids, sizes = ids[stands][order], sizes[stands][order]
    rows = []
    if table.num_rows and len(ids):
        doc = np.repeat(listed(table["doc"]), listed(table["tokens"]))
        key, held = listed(table["key"]), listed(table["held"])
        order = np.lexsort((key, held, doc))
        doc, key, held = doc[order], key[order], held[order]
        for low, high in zip(*run_bounds(doc), strict=True):
            at = np.searchsorted(ids, doc[low])
            if at == len(ids) or ids[at] != doc[low]:
                continue
            n = int(sizes[at])
            least = -(-3 * n // 4)
            if high - low < least:  # too little that anyone else holds
                continue
            rare = max(0, n - least + 1 - (n - (high - low)))
            rows.append(
                (int(ids[at]), n, np.sort(key[low:high]), key[low : low + rare], int(held[low : low + rare].sum()), _marks(key[low:high], n))
            )
    release()
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    return pa.table(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
        names=["doc_id", "n", "tokens", "rare", "scan", "marks"],
    )


def _subset_cost(n: int, boundary: int) -> int:
    return sum(math.comb(n, required(n, z)) for z in _partners(n, boundary))


def _partners(n: int, boundary: int) -> range:
    return range(-(-3 * n // 4), min(boundary, 4 * n // 3) + 1)


def boundary(sets: DataFrame) -> int:
    """Size up to which enumerating subsets, summed over the sets, costs less than scanning."""
    rows = (
        sets.where(F.col("n") <= SMALL)
        .groupBy("n")
        .agg(F.count("*").alias("sets"), F.sum("scan").alias("scan"))
        .collect()  # at most SMALL rows
    )
    best, least = 0, math.inf
    for m in range(SMALL + 1):
        cost = sum(
            r["sets"] * _subset_cost(r["n"], m) if r["n"] <= m else r["scan"] for r in rows
        )
        if cost < least:
            best, least = m, cost
    return best


def _small_pairs(sets: DataFrame, limit: int) -> DataFrame:
    """Candidate links of small sets: a star within the documents that share a subset."""

    def enumerate_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [], [])
            for doc, n, tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for z in _partners(n, limit):
                    for subset in itertools.combinations(tokens, required(n, z)):
                        out[0].append(doc)
                        out[1].append(min(n, z) * (SMALL + 1) + max(n, z))
                        out[2].append(",".join(map(str, subset)))
                        out[3].append(int(n <= z))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int32())],
                names=["doc_id", "sizes", "subset", "lower"],
            )

    keyed = (
        sets.where(F.col("n") <= limit)
        .select("doc_id", "n", "tokens")
        .mapInArrow(enumerate_, "doc_id long, sizes int, subset string, lower int")
        .withColumn("key", F.xxhash64("sizes", "subset"))
        .drop("subset")
    )
    keyed = materialise(keyed, "subsets")
    same = F.col("sizes") % (SMALL + 2) == 0  # both sizes equal: one side
    hub = keyed.groupBy("key").agg(
        F.min(F.when((F.col("lower") == 1) | same, F.col("doc_id"))).alias("low"),
        F.min(F.when((F.col("lower") == 0) | same, F.col("doc_id"))).alias("high"),
    )
    return (
        keyed.join(hub.where("low IS NOT NULL AND high IS NOT NULL"), "key")
        .select(
            F.col("doc_id").alias("a"),
            F.when(F.col("lower") == 1, F.col("high")).otherwise(F.col("low")).alias("b"),
        )
        .where("a <> b")
        .distinct()
    )


def _links(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) whose exact overlap reaches the threshold."""
    own = sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("tokens").alias("ta"))
    other = sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("tokens").alias("tb"))
    overlap = F.size(F.array_intersect("ta", "tb"))
    return (
        pairs.join(own, "a")
        .join(other, "b")
        .where(100 * overlap >= 75 * (F.col("na") + F.col("nb") - overlap))
        .select("a", "b")
    )


def _leader_pairs(listed_: DataFrame) -> DataFrame:
    """For each document the leader, of its size class or the one below, that it shares most
    listed tokens with."""
    leaders = listed_.groupBy("token", "scale").agg(F.min("doc_id").alias("b"))
    near = leaders.unionByName(leaders.withColumn("scale", F.col("scale") + 1))
    return (
        listed_.join(near, ["token", "scale"])
        .where("doc_id <> b")
        .groupBy("doc_id", "b")
        .agg(F.count("*").alias("common"))
        .groupBy(F.col("doc_id").alias("a"))
        .agg(F.max(F.struct("common", "b"))["b"].alias("b"))
    )


class _Marks:
    """Marks of documents, each at its own width and folded to half of it. Sets that can be linked
    are less than a factor of two apart, so two documents always have a width in common."""

    def __init__(self, marks: pa.ChunkedArray):
        raw = [np.frombuffer(m, np.uint64) for m in marks.to_pylist()]
        self.width = np.array([len(m) for m in raw], np.int64)
        self.row = np.zeros((2, len(raw)), np.int64)
        rows: dict[int, list[np.ndarray]] = {}
        for i, m in enumerate(raw):
            half = len(m) // 2
            for level, part in enumerate((m, m[:half] ^ m[half:])):
                at = rows.setdefault(len(part), [])
                self.row[level, i] = len(at)
                at.append(part)
        self.rows = {width: np.stack(parts) for width, parts in rows.items()}

    def differing(self, one: int, others: np.ndarray) -> np.ndarray:
        """Bits in which the marks of one document differ from those of others."""
        out = np.zeros(len(others), np.int64)
        width = np.minimum(self.width[others], self.width[one])
        for w in np.unique(width):
            here = width == w
            rows, there = self.rows[w], others[here]
            mine = rows[self.row[int(self.width[one] > w), one]]
            theirs = rows[self.row[(self.width[there] > w).astype(int), there]]
            out[here] = np.bitwise_count(theirs ^ mine).sum(1)
        return out


def _cross_pairs(listed_: DataFrame, sets: DataFrame, deal: int, limit: int) -> DataFrame:
    """Pairs on a common list whose components differ and whose sizes and marks allow a link."""

    def cross(table: pa.Table) -> pa.Table:
        release()
        token, doc, n, component, alone = (
            table[c].to_numpy() for c in ("token", "doc_id", "n", "component", "alone")
        )
        ids, first, doc = np.unique(doc, return_index=True, return_inverse=True)
        marks = _Marks(table["marks"].take(first))
        order = np.lexsort((doc, component, token))
        heads, ends = run_bounds(token[order], component[order])
        size = np.zeros(len(order), np.int64)
        size[order] = np.repeat(ends - heads, ends - heads)
        order = np.lexsort((doc, component, size, token))  # the largest components last
        token, doc, n, component, alone = (x[order] for x in (token, doc, n, component, alone))
        heads, ends = run_bounds(token, component)
        lists_, stops = run_bounds(token)
        rest_of = np.repeat(stops, stops - lists_)
        found = []
        for low, high in zip(heads, ends, strict=True):
            rest = rest_of[low]  # members of later components on the same list
            for i in range(low, high) if high < rest else ():
                m = n[high:rest]
                fits = (3 * m <= 4 * n[i]) & (3 * n[i] <= 4 * m) & ((m > limit) | (n[i] > limit))
                fits &= 7 * (alone[high:rest] + alone[i]) <= m + n[i]
                at = high + np.flatnonzero(fits)
                if len(at):
                    differ = marks.differing(doc[i], doc[at]) + alone[at] + alone[i]
                    at = at[7 * differ <= n[at] + n[i]]
                if len(at):
                    found.append(np.stack([np.full(len(at), ids[doc[i]]), ids[doc[at]]]))
        pairs = np.concatenate(found, 1) if found else np.zeros((2, 0), np.int64)
        pairs = np.unique(np.sort(pairs, 0), axis=1)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    lists_ = listed_.groupBy("token").agg(
        F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("members"),
        F.bit_xor(F.xxhash64("doc_id")).alias("h1"),
        F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("h2"),
    )
    several = lists_.where("x <> y").groupBy("members", "h1", "h2").agg(F.min("token").alias("token"))
    marks = sets.select("doc_id", (F.col("n") - F.size("tokens")).alias("alone"), "marks")
    return (
        listed_.join(several.select("token"), "token")
        .join(marks, "doc_id")
        .select("token", "doc_id", "n", "component", "alone", "marks")
        .withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(deal)).cast("int"))
        .groupBy("bucket")
        .applyInArrow(cross, "a long, b long")
        .distinct()
    )


def ngram_join(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest document with the same set)
    and component_id (smallest document reachable by links)."""
    spark = docs.sparkSession
    docs = id_and_text(docs)
    deal = buckets(spark, 2)
    sizes = _sizes(docs, words)
    classes = sizes.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"))
    members = materialise(
        sizes.join(classes, ["n", "s1", "s2"], "left").select(
            "doc_id", "n", F.coalesce("rep", "doc_id").alias("rep")
        ),
        "members",
    )
    shared = (
        _dealt_tokens(docs, words, deal)
        .groupBy("bucket")
        .applyInArrow(
            lambda table: _shared(table, deal),
            "home int, doc array<long>, tokens array<int>, key array<long>, held array<int>",
        )
    )

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = _home(batch.column(0).to_numpy(), deal).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(home), *batch.columns], names=["home", "doc_id", "n", "rep"]
            )

    homes = members.mapInArrow(at_home, "home int, doc_id long, n long, rep long")
    sets = materialise(
        shared.groupBy("home").cogroup(homes.groupBy("home")).applyInArrow(_gather, SETS), "sets"
    )
    limit = boundary(sets)
    lists_ = materialise(
        sets.select(
            F.explode("rare").alias("token"), "doc_id", "n",
            F.floor(F.log(F.col("n")) / math.log(4 / 3)).alias("scale"),
        ),
        "lists",
    )
    first = materialise(
        _links(sets, _small_pairs(sets, limit).unionByName(_leader_pairs(lists_))), "links"
    )
    known = components(first)
    with_known = lists_.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn(
        "component", F.coalesce("component", "doc_id")
    )
    second = _links(sets, _cross_pairs(with_known, sets, deal, limit))
    joined = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second))
    return (
        members.join(joined.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.col("rep").alias("class_id"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                          '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
  FROM w, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS t(i)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
commons AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM commons JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * i >= 75 * (p.n + q.n - i)),
reach(node, root) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT links.b, root FROM reach JOIN links ON links.a = reach.node)
SELECT w.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles,
       coalesce(min(least(root, w.doc_id)), w.doc_id) AS component_id
FROM w LEFT JOIN sizes ON sizes.doc_id = w.doc_id LEFT JOIN reach ON reach.node = w.doc_id
GROUP BY w.doc_id
"""


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    return ngram_join(docs).select("doc_id", "n_shingles", "component_id")
