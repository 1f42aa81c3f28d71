"""Operator 2: training documents that hold a benchmark item, word for word or edited.

Seeds are rare word n-grams of the items, whole or with a word left out between two of theirs; a document
holds a seed also where it has a word more between two, or between all. So a copy keeps seeds though every
third word is replaced, inserted or missing. The corpus frequency of every n-gram of the items is counted
over all documents, whatever the gaps. What does not occur can find nothing; of the others an item keeps
those in at most ``RARE`` documents or at most ``TIMES`` as many as its rarest (so an item that
is copied everywhere keeps all that is its own), and of every ``STRETCH`` successive ones the rarest.

Where a document holds a seed of the first sort, or ``SEVERAL`` seeds of any, the item is aligned with the
words around by Smith-Waterman; of a short item any seed will do. A document is contaminated if the
alignment reaches ``SIMILARITY`` of a perfect one. An item of one or two words is found by all its words alone.

The items go to every task in blocks of at most ``BLOCK`` bytes; a benchmark beyond that takes
one pass over the corpus per block. Words are lower-cased runs of letters and digits. Rows without
id, and texts without words, match nothing. Repeated rows give one row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailloom.llm.common import BASE, LETTERS, blocks, id_and_text, mix, run_bounds, utf8, word_bounds, word_values

GRAM = 3
STRETCH = 4
RARE = 20
TIMES = 4
SEVERAL = 2
SHORT = 12  # words
SIMILARITY = 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
BLOCK = 16 << 20
SIEVE_BITS = 22


def shapes(gram: int, all_gaps: bool) -> list[tuple[int, ...]]:
    """Where the words of an n-gram stand: together, with one word between two of them, or (in
    documents) with one between all."""
    whole = tuple(range(gram))
    found = [whole, *(tuple(i + (i >= gap) for i in whole) for gap in range(1, gram))]
    if all_gaps and gram > 2:
        found.append(tuple(2 * i for i in whole))
    return found


class Words:
    """Word hashes of a block of texts, and the hashes of their n-grams in every shape."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, gram: int, all_gaps: bool = True):
        starts, ends, self.limits = word_bounds(data, bounds, LETTERS)
        self.values = word_values(data, starts, ends).view(np.int64)
        word = self.values.view(np.uint64)
        after = np.repeat(self.limits[1:], np.diff(self.limits)) - np.arange(len(word))  # words to the end
        doc = np.repeat(np.arange(len(self.limits) - 1), np.diff(self.limits))
        at, grams, kind = [], [], []
        for number, shape in enumerate(shapes(gram, all_gaps)):
            place = np.flatnonzero(after > shape[-1])
            total = np.zeros(len(place), np.uint64)
            for offset in shape:
                total = total * np.uint64(BASE) + word[place + offset]
            at.append(place)
            grams.append(mix(total).view(np.int64))
            kind.append(np.full(len(place), number, np.int8))
        at = np.concatenate(at)
        self.grams, self.kind = np.concatenate(grams), np.concatenate(kind)
        self.owner = doc[at]
        self.place = at - self.limits[self.owner]

    def of(self, i: int) -> np.ndarray:
        return self.values[self.limits[i] : self.limits[i + 1]]


class Sieve:
    """Which of many n-grams are among some known ones: most are not, and a table of bits tells."""

    def __init__(self, known: np.ndarray):
        self.known = known  # in order
        self.table = np.zeros(1 << SIEVE_BITS, bool)
        self.table[self._cell(known)] = True

    @staticmethod
    def _cell(grams: np.ndarray) -> np.ndarray:
        return grams.view(np.uint64) >> np.uint64(64 - SIEVE_BITS)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the n-grams that are known, and the first place of each among the known."""
        some = np.flatnonzero(self.table[self._cell(grams)])
        place = np.searchsorted(self.known, grams[some])
        good = self.known[np.minimum(place, len(self.known) - 1)] == grams[some]
        return some[good], place[good]


class Items:
    """A block of the benchmark: words of each item and where its seeds stand."""

    def __init__(self, ids: list[int], texts: list[str], gram: int):
        self.ids = ids
        data, bounds = utf8(pc.utf8_lower(pa.array(texts, pa.string())))
        count = np.diff(word_bounds(data, bounds, LETTERS)[2])
        # An item shorter than an n-gram is found by what it has: all items of one block share
        # the n-gram length, so such items get a block of their own.
        self.gram = max(1, min(gram, int(count.min(initial=gram))))
        self.words = Words(data, bounds, self.gram, all_gaps=False)
        self.sizes = np.diff(self.words.limits)
        self.all_grams = np.unique(self.words.grams)
        self.seeds = self.all_grams[:0]

    def choose(self, frequency: np.ndarray) -> None:
        """Keep the seeds, given the corpus frequency of ``all_grams``."""
        words = self.words
        seen = frequency[np.searchsorted(self.all_grams, words.grams)]
        occurs = seen > 0
        never = np.iinfo(np.int64).max
        met = np.where(occurs, seen, never)
        least = np.full(len(self.ids), never)
        np.minimum.at(least, words.owner, met)
        own = occurs & (seen <= np.maximum(RARE, TIMES * np.minimum(least, never // TIMES))[words.owner])
        # The n-grams of an item in one shape stand one after another. Of every stretch the first of the rarest.
        rarest = np.zeros(len(seen), bool)
        lows, highs = run_bounds(words.kind, words.owner)
        end = np.repeat(highs, highs - lows)
        at = np.arange(len(seen))
        best = at.copy()
        for step in range(1, STRETCH):
            other = np.minimum(at + step, end - 1)
            best = np.where(met[other] < met[best], other, best)
        rarest[best[(end - at >= STRETCH) | (at == np.repeat(lows, highs - lows))]] = True
        kept = np.flatnonzero(own | (rarest & occurs))
        order = np.argsort(words.grams[kept], kind="stable")
        self.at = kept[order]
        self.seeds = words.grams[self.at]
        self.alone = own[self.at] | (self.sizes[words.owner[self.at]] <= SHORT)
        if len(self.seeds):
            self.sieve = Sieve(self.seeds)


def best_end(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Score of the best local alignment, and where it ends in item and text."""
    slope = np.arange(len(text) + 1) * -GAP
    row = np.zeros(len(text) + 1, np.int64)
    best = (0, 0, 0)
    for i, word in enumerate(item):
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(text == word, MATCH, MISMATCH))
        # Gaps in the item: what is on the left, less a step each.
        row = np.maximum.accumulate(new + slope) - slope
        top = int(row.argmax())
        if row[top] > best[0]:
            best = (int(row[top]), i + 1, top)
    return best


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int, int]:
    """Smith-Waterman: score, and the aligned stretches of item and text."""
    score, i, j = best_end(item, text)
    if not score:
        return 0, 0, 0, 0, 0
    _, a, b = best_end(item[:i][::-1], text[:j][::-1])
    return score, i - a, i, j - b, j


def _matches(items: Items, words: Words) -> Iterator[tuple]:
    """Document, item, score and stretches of every alignment that is similar enough."""
    if not len(items.seeds) or not len(words.grams):
        return
    hit, low = items.sieve.find(words.grams)
    many = np.searchsorted(items.seeds, words.grams[hit], "right") - low
    each = np.repeat(hit, many)
    step = np.arange(len(each)) - np.repeat(np.cumsum(many) - many, many)
    found = np.repeat(low, many) + step
    seed = items.at[found]
    doc, item = words.owner[each], items.words.owner[seed]
    size = items.sizes[item]
    slack = size // 2 + 4
    begin = words.place[each] - items.words.place[seed] - slack
    end = begin + size + 2 * slack
    order = np.lexsort((begin, item, doc))
    doc, item, begin, end = doc[order], item[order], begin[order], end[order]
    alone, place = items.alone[found][order], items.words.place[seed][order]
    # Windows of one item that overlap are one stretch; windows of an item have one length.
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(new)]
    group = np.cumsum(new) - 1
    strong = np.zeros(len(first), bool)
    strong[group[alone]] = True
    # Seeds at one place of the item count once.
    pairs = np.unique(np.column_stack([group, place]), axis=0)[:, 0]
    strong |= np.bincount(pairs, minlength=len(first)) >= SEVERAL
    best: dict[tuple[int, int], tuple] = {}
    for k in np.flatnonzero(strong).tolist():
        d, i = int(doc[first[k]]), int(item[first[k]])
        low = max(int(begin[first[k]]), 0)
        own = items.words.of(i)
        score, i0, i1, t0, t1 = align(own, words.of(d)[low : int(end[last[k] - 1])])
        similarity = score / (MATCH * len(own))
        if similarity >= SIMILARITY and similarity > best.get((d, i), (0.0,))[0]:
            best[d, i] = (similarity, i0, i1, low + t0, low + t1)
    for (d, i), found in best.items():
        yield d, items.ids[i], *found


def _frequencies(docs: DataFrame, items: Items) -> np.ndarray:
    """In how many documents each n-gram of the items occurs."""
    wanted, gram = items.all_grams, items.gram
    sieve = Sieve(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted), np.int64)
        for _, data, bounds in blocks(batches, lower=True):
            words = Words(data, bounds, gram)
            known, at = sieve.find(words.grams)
            pairs = np.unique(words.owner[known] * len(wanted) + at)
            total += np.bincount(pairs % len(wanted), minlength=len(wanted))
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held.astype(np.int32)), pa.array(total[held])], names=["gram", "n"]
        )

    rows = docs.mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(len(wanted), np.int64)
    for r in rows.collect():  # at most one row per n-gram of the block of items
        out[r["gram"]] = r["n"]
    return out


def _blocks_of_items(benchmark: DataFrame, gram: int) -> Iterator[Items]:
    rows = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string"))
        .where("item_id IS NOT NULL AND text IS NOT NULL")
        .dropDuplicates()
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = int(size // BLOCK) + 1
    own = rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)))
    for part in range(parts):
        got = own.where(F.col("part") == part).orderBy("item_id", "text").collect()  # about BLOCK bytes
        by_length: dict[int, list] = {}
        for r in got:
            data, bounds = utf8(pc.utf8_lower(pa.array([r["text"]], pa.string())))
            words = len(word_bounds(data, bounds, LETTERS)[0])
            if words:
                by_length.setdefault(min(words, gram), []).append(r)
        for same in by_length.values():
            yield Items([r["item_id"] for r in same], [r["text"] for r in same], gram)


def contaminated(docs: DataFrame, benchmark: DataFrame, gram: int = GRAM) -> DataFrame:
    """doc_id, item_id, similarity (1: the whole item, word for word), and the aligned stretches
    of words: item_start, item_end, doc_start, doc_end."""
    docs = id_and_text(docs)
    schema = (
        "doc_id long, item_id long, similarity double, item_start int, item_end int, "
        "doc_start int, doc_end int"
    )

    def search(items: Items) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, data, bounds in blocks(batches, lower=True):
                found = list(_matches(items, Words(data, bounds, items.gram)))
                if found:
                    columns = list(zip(*found, strict=True))
                    columns[0] = [int(ids[d]) for d in columns[0]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(columns, KINDS, strict=True)],
                        names=["doc_id", "item_id", "similarity", "item_start", "item_end", "doc_start", "doc_end"],
                    )

        return docs.mapInArrow(find, schema)

    passes = []
    for items in _blocks_of_items(benchmark, gram):
        items.choose(_frequencies(docs, items))
        passes.append(search(items))
    if not passes:
        return docs.sparkSession.createDataFrame([], schema)
    rows = reduce(DataFrame.unionByName, passes)
    best = F.max(F.struct("similarity", *[c for c in rows.columns if c not in ("doc_id", "item_id", "similarity")]))
    return rows.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


KINDS = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
