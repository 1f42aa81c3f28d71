"""Operator 12: near-duplicates by SimHash, compared bit plane by bit plane.

The fingerprint of a text has a bit where more than half of its word shingles, repeats included,
have it in their XXH64. Equal fingerprints are one class, named by its smallest doc_id. Of the 64
bits, cut into ``parts``, two fingerprints that differ in at most 3 bits share all but 3 parts; so
each class goes to one bucket for every choice of the parts that must agree. A bucket of more than
``BLOCK`` classes is dealt into blocks, and every two of its blocks meet in a tile of their own,
which spreads a large family over many tasks.

In a tile the fingerprints stand as bit planes: a word holds one bit of 64 fingerprints. A
fingerprint meets 64 others at once: three planes are xored with its bits and added by a carry-save
adder to counters of two bits, kept vertically like the planes; what passes the radius stays marked
as over. Words in which all 64 are over are abandoned, the others go on to the next planes.

A tile sends one edge per linked class, to the smallest of its group within the tile, never all
pairs. Connected components of these edges join the classes.

With 4 parts a bucket holds 1 of 65,536 of random fingerprints, which suits up to some 10**9
documents; beyond that take 5 parts (10 buckets a class, 1 of 2**25).

A text without words, null or empty has fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle. Rows that share a doc_id are one document; if their texts differ,
the smallest of their fingerprints (as a signed number) stands for it. Rows without doc_id are left.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailloom.llm.common import blocks, id_and_text, release
from retailloom.llm.components import components
from retailloom.session import materialise

SHINGLE = 3
SEED = 42
RADIUS = 3  # the counters of two bits hold no more
PARTS = 4
BLOCK = 2048  # classes of a bucket that stay together
CHUNK = 16_384  # classes whose planes are held at a time
ROWS = 32_768  # words of planes compared at a time
HASHES = 100_000  # shingles whose bits are counted at a time
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the hashes, as a signed number. Bytes split at white space just as
    the words are defined, and only A-Z have a lower case."""
    words = text.lower().split()
    if not words:
        return 0
    run = words if len(words) >= shingle else []
    parts = zip(*(run[i:] for i in range(shingle)), strict=False) if run else [words]
    hashes = map(lambda p: xxhash.xxh64_intdigest(b" ".join(p), SEED), parts)
    counts, total = np.zeros(64, np.int64), 0
    while len(some := np.fromiter(itertools.islice(hashes, HASHES), np.uint64)):
        bits = np.unpackbits(some.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
        total += len(some)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and ``bits``, the fingerprint as a long; one row per document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, bounds in blocks(batches):
            raw = data.tobytes()
            found = [fingerprint(raw[a:b], shingle) for a, b in itertools.pairwise(bounds.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(found, pa.int64())], names=["doc_id", "bits"]
            )

    rows = id_and_text(docs).mapInArrow(each, "doc_id long, bits long")
    return rows.groupBy("doc_id").agg(F.min("bits").alias("bits"))


def masks(parts: int, radius: int = RADIUS) -> list[int]:
    """The bits that must agree, for every choice of ``parts - radius`` of the parts."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    fields = [(1 << b) - (1 << a) for a, b in itertools.pairwise(cuts)]
    return [sum(chosen) for chosen in itertools.combinations(fields, parts - radius)]


def planes(values: np.ndarray) -> np.ndarray:
    """Row b, word w: bit b of the values 64 w to 64 w + 63."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _spans(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): which (0, 0, 1, 1, 1) and the place within (0, 1, 0, 1, 2)."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - (np.cumsum(counts) - counts)[which]


def near_pairs(
    values: np.ndarray, heads: np.ndarray, cuts: np.ndarray, ends: np.ndarray, equal: int = 0
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of the values of a tile that differ in at most RADIUS bits.

    A tile takes the values from its head to its end. Where it has no cut (the cut is its end) all
    its pairs are compared, else those across the cut. ``equal``: bits in which all values of a tile agree.
    """
    whole = cuts == ends
    first = np.where(whole, heads, cuts)  # of the values that stand in planes
    wide = -(-(ends - first) // 64)
    base = np.cumsum(wide) - wide  # first word of a tile
    tile, place = _spans(ends - first)
    slot = base[tile] * 64 + place
    padded = np.zeros(int(wide.sum()) * 64, np.uint64)
    padded[slot] = values[first[tile] + place]
    table = planes(padded)
    owner = np.zeros(len(padded), np.int64)
    owner[slot] = first[tile] + place
    filled = np.zeros(len(padded), np.uint8)
    filled[slot] = 1
    filled = np.packbits(filled, bitorder="little").view("<u8")

    tile, place = _spans(np.where(whole, ends, cuts) - heads)  # of the values that ask
    asker = heads[tile] + place
    own = np.where(whole[tile], place // 64, 0)  # words before hold earlier values only
    row, word = _spans(wide[tile] - own)
    words = base[tile][row] + own[row] + word
    # In the own word only later lanes count.
    later = np.where(whole[tile], FULL << np.uint64(1) << (place % 64).astype(np.uint64), FULL)
    order = [b for b in range(64) if not equal >> b & 1]
    order += [None] * (-len(order) % 3)
    for low in range(0, len(row), ROWS):
        r, w = row[low : low + ROWS], words[low : low + ROWS]
        within = filled[w] & np.where(word[low : low + ROWS] == 0, later[r], FULL)
        asked = values[asker[r]]
        at = np.arange(len(r))
        ones, twos, over = np.zeros(len(r), np.uint64), np.zeros(len(r), np.uint64), ~within
        for step in range(0, len(order), 3):
            a, b, c = (
                np.zeros(len(at), np.uint64) if bit is None
                else table[bit][w] ^ (np.uint64(0) - (asked >> np.uint64(bit) & np.uint64(1)))
                for bit in order[step : step + 3]
            )
            ab = a ^ b
            total, carry = ab ^ c, (a & b) | (ab & c)  # carry-save: three bits to a sum and a carry
            second = ones & total
            ones = ones ^ total
            both = twos ^ carry
            over = over | (twos & carry) | (both & second)
            twos = both ^ second
            if step % 12 == 9:
                alive = np.flatnonzero(over != FULL)
                if not len(alive):
                    break
                if len(alive) < 0.7 * len(at):
                    at, w, asked = at[alive], w[alive], asked[alive]
                    ones, twos, over = ones[alive], twos[alive], over[alive]
        hit = np.flatnonzero(over != FULL)
        if len(hit):
            lanes = np.unpackbits((~over[hit]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            which, lane = np.nonzero(lanes)
            which = hit[which]
            yield asker[r[at[which]]], owner[w[which] * 64 + lane]


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give linked positions the smallest label of their group; labels are positions."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def edges(classes: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between class names, of which the components are those of all links.
    ``classes``: rows (bits, name), each fingerprint once."""
    choices = masks(parts)
    chosen = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("bits").bitwiseAND(F.lit(_signed(m))).alias("agreed")) for i, m in enumerate(choices)]))
    placed = classes.select("bits", "name", chosen.alias("b")).select("b.*", "bits", "name")
    large = materialise(
        placed.groupBy("choice", "agreed").agg(F.count("*").alias("n")).where(F.col("n") > block)
        .select("choice", "agreed", F.ceil(F.col("n") / block).cast("int").alias("blocks")),
        "large-buckets",
    )
    own = F.pmod(F.xxhash64("bits"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = (
        placed.join(large, ["choice", "agreed"], "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("own", own)
        .withColumn("other", other)
        .select(
            "choice", "agreed",
            F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
            (F.col("own") > F.col("other")).alias("second"), "bits", "name",
        )
    )
    key = ["choice", "agreed", "low", "high"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def links(table: np.ndarray) -> pa.RecordBatch:
            new = np.ones(len(table), bool)
            new[1:] = (table[1:, :4] != table[:-1, :4]).any(1)
            heads = np.flatnonzero(new)
            ends = np.r_[heads[1:], len(table)]
            several = ends - heads > 1
            heads, ends = heads[several], ends[several]
            before = np.r_[0, np.cumsum(table[:, 4] == 0)]
            cuts = np.where(table[heads, 2] == table[heads, 3], ends, heads + before[ends] - before[heads])
            values, names = table[:, 5].view(np.uint64), table[:, 6]
            labels = np.arange(len(table))
            equal = choices[int(table[0, 0])] if (table[:, 0] == table[0, 0]).all() else 0
            # Tiles of a chunk share no label, since every row has its own.
            for a, b in near_pairs(values, heads, cuts, ends, equal):
                join_labels(labels, a, b)
            moved = np.flatnonzero(labels != np.arange(len(table)))
            return pa.RecordBatch.from_arrays(
                [pa.array(names[moved]), pa.array(names[labels[moved]])], names=["a", "b"]
            )

        def joined() -> np.ndarray:
            return held[0] if len(held) == 1 else np.concatenate(held)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.column_stack([c.cast(pa.int64()).to_numpy(zero_copy_only=False) for c in batch.columns]))
            if sum(map(len, held)) < CHUNK:
                continue
            table = joined()
            # The last tile may go on in the next batch.
            change = np.flatnonzero((table[1:, :4] != table[:-1, :4]).any(1)) + 1
            if len(change):
                whole, held = table[: change[-1]], [table[change[-1] :]]
                for part in _by_choice(whole):
                    yield links(part)
            else:
                held = [table]
        if held:
            for part in _by_choice(joined()):
                yield links(part)
        release()

    dealt = tiles.repartition(*key).sortWithinPartitions(*key, "second")
    return dealt.mapInArrow(compare, "a long, b long")


def _by_choice(table: np.ndarray) -> list[np.ndarray]:
    return np.split(table, np.flatnonzero(table[1:, 0] != table[:-1, 0]) + 1)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_duplicates(docs: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id, the smallest doc_id that links
    reach."""
    found = materialise(fingerprints(docs), "fingerprints")
    classes = materialise(
        found.groupBy("bits").agg(F.min("doc_id").alias("name")), "fingerprint-classes"
    )
    joined = components(edges(classes, parts, block), stored=True)
    # Stored, so that a fingerprint that holds a third of the documents can be split in the join.
    named = materialise(
        classes.join(joined, classes["name"] == joined["node"], "left").select(
            "bits", F.coalesce("component", "name").alias("component_id")
        ),
        "fingerprint-components",
    )
    return found.join(named, "bits").select(
        "doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id"
    )
