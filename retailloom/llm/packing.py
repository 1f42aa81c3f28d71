"""Operator 3: documents packed into as few sequences of a fixed number of tokens as possible.

The lengths of all pieces are counted; there are at most as many different ones as a sequence has
tokens, so the plan is made on counts and its size does not grow with the corpus:

1. large lengths are split into groups of equal cardinality and rounded up within their group;
2. configurations of the few rounded sizes are optimised by a linear programme (columns are found
   by a knapsack over the capacity), and what rounding leaves is filled greedily;
3. actual lengths take the places of the rounded ones, which leaves small gaps;
4. small lengths go, longest first, where they fit best, and into new sequences after that.

The plan is a table of runs: so many pieces of a length, in their order, go to consecutive
sequences at one offset. Pieces find their place by their number within their length.

A null or empty text is the end token alone. Repeated rows are packed each.
"""

from __future__ import annotations

import bisect
import operator
import re
import string
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailloom.llm.common import buckets, id_and_text, release
from retailloom.session import materialise

CAPACITY = 4096
END_ID = 1
#: Tried in turn; the plan with the fewest sequences is taken. Lengths above capacity / LARGE are
#: planned in GROUPS groups, the others fill gaps.
LARGE = (4, 3, 2, 8)
GROUPS = (12, 24, 48)
WORDS_KEPT = 300_000  # encoded words a task remembers, and as many seen before them
RUNS_KEPT = 400_000  # and encoded runs of letters, which many words share
AT_ONCE = 4 << 20  # bytes of texts whose words are looked up together
VOCABULARY = "word_bpe_49k.json"


def _byte_symbols() -> dict[int, str]:
    """The symbol of each byte in byte-level vocabularies: itself if it prints, else one past 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Ids of texts as little-endian 32-bit numbers.

    White space separates tokens in this vocabulary and is dropped, so a text is encoded word by
    word, each different word once. Most words are a run of letters and then marks, which the
    vocabulary's own split separates too. Letters whose composed form and lower case are beyond
    doubt are prepared here and many runs are encoded at once; their ends show in the ids, since
    the last token of a run has the suffix of word ends. All other words go through the whole
    tokenizer.
    """

    MARKS = "".join(m for m in string.punctuation if m != "'")
    LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.runs = Tokenizer(self.tokenizer.model)
        self.runs.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.symbols = {b: s for b, s in _byte_symbols().items() if b != ord(" ")}
        words = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(words.values()) + 1, bool)
        self.ends[[i for w, i in words.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}

    def forget(self) -> None:
        """The worker outlives its task; its memory is wanted by others."""
        self.known, self.older, self.letters = {}, {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def _learn_letters(self, runs: list[str]) -> None:
        spelled = " ".join(runs).encode().decode("latin-1").translate(self.symbols)
        found = self.runs.encode_batch_fast([spelled], add_special_tokens=False)
        ids = np.array(found[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        if len(cuts) != len(runs):
            self.letters.update(zip(runs, self._whole(runs), strict=True))
            return
        raw, low = ids.tobytes(), 0
        for run, high in zip(runs, cuts.tolist(), strict=True):
            self.letters[run] = raw[low:high]
            low = high

    def _learn(self, new: list[bytes]) -> None:
        texts = b" ".join(new).decode().split(" ") if new else []
        bare = [t.rstrip(self.MARKS) for t in texts]
        latin = self.LATIN.fullmatch
        words, runs, marks, rest = [], [], [], []
        for word, text, run in zip(new, texts, bare, strict=True):
            if run.isalpha() and (run.isascii() or latin(run)):
                words.append(word)
                runs.append(run.lower())
                marks.append(text[len(run) :])
            else:
                rest.append(word)
        self.known.update(zip(rest, self._whole([w.decode() for w in rest]), strict=True))
        different = set(runs)
        letters = list(different.difference(self.letters))
        if len(self.letters) + len(letters) > RUNS_KEPT:
            self.letters = {}
            letters = list(different)
        for low in range(0, len(letters), 2000):
            self._learn_letters(letters[low : low + 2000])
        self.letters[""] = b""
        some = list(set(marks).difference(self.letters))
        self.letters.update(zip(some, self._whole(some), strict=True))
        get = self.letters.__getitem__
        self.known.update(zip(words, map(operator.add, map(get, runs), map(get, marks)), strict=True))

    def encode(self, texts: list[str | bytes | None]) -> Iterator[bytes]:
        """``texts`` as text, or as its UTF-8 bytes."""
        words = [(t.encode() if isinstance(t, str) else t or b"").split() for t in texts]
        different = set().union(*words)
        new = different.difference(self.known)
        if len(self.known) + len(new) > WORDS_KEPT:
            # Frequent words come back from the older half before it is dropped; only rare ones are lost.
            self.known, self.older, new = {}, self.known, different
        again = new.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again), strict=True))
        self._learn(list(new.difference(again)))
        get = self.known.__getitem__
        for ws in words:
            yield b"".join(map(get, ws))


_encoders: dict[str, Encoder] = {}


def _portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows in turn, their texts as bytes: some AT_ONCE bytes of them, or one longer text, at a time."""
    raw = batch.column(1).cast(pa.large_binary())
    batch = pa.RecordBatch.from_arrays([batch.column(0), raw], names=batch.schema.names[:2])
    ends = pc.fill_null(pc.binary_length(raw), 0).to_numpy(zero_copy_only=False).cumsum()
    low = 0
    while low < batch.num_rows:
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        yield batch.slice(low, high - low)
        low = high


def pieces(
    docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every piece; its ids too, if wanted."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    end = np.array([END_ID], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _encoders:
            _encoders[vocabulary] = Encoder(vocabulary)
        encoder = _encoders[vocabulary]
        for batch in batches:
            for part in _portions(batch):
                rows = []
                texts = part.column(1).to_pylist()
                for doc_id, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids += end
                    for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[at : at + 4 * capacity]
                        rows.append((doc_id, i, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                wanted = len(kinds) if with_ids else 5
                columns = list(zip(*rows, strict=True))[:wanted]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds[:wanted], strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=NAMES[:wanted])
        encoder.forget()
        release()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return id_and_text(docs).mapInArrow(encode, schema + (", ids binary" if with_ids else ""))


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]


@dataclass
class Run:
    """``count`` pieces of ``length`` from number ``first`` on: ``per`` to a sequence, from
    ``sequence`` on, the first of each at ``offset``."""

    length: int
    first: int
    count: int
    sequence: int
    per: int
    offset: int


def _best_pattern(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: how many of each size give the most value within the capacity."""
    best = np.zeros(capacity + 1)
    taken = []
    for _ in range(capacity // int(sizes.min())):  # one item more each time
        before, chosen = best, np.full(capacity + 1, -1)
        best = before.copy()
        for i, size in enumerate(sizes):
            gain = before[: capacity + 1 - size] + value[i]
            better = gain > best[size:] + 1e-12
            best[size:][better] = gain[better]
            chosen[size:][better] = i
        taken.append(chosen)
    pattern = np.zeros(len(sizes), np.int64)
    room = capacity
    for chosen in reversed(taken):
        if chosen[room] >= 0:
            pattern[chosen[room]] += 1
            room -= int(sizes[chosen[room]])
    return pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of few sizes and how often each is used, so that the demand is met."""
    k = len(sizes)
    columns = [np.eye(k, dtype=np.int64)[i] * (capacity // sizes[i]) for i in range(k)]
    for _ in range(20 * k):
        matrix = np.array(columns, float).T
        use = np.linalg.solve(matrix, demand.astype(float))
        price = np.linalg.solve(matrix.T, np.ones(k))
        pattern = _best_pattern(sizes, price, capacity)
        if pattern @ price <= 1 + 1e-4:  # within that share of the optimum
            break
        enter = np.linalg.solve(matrix, pattern.astype(float))
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(enter > 1e-7, use / enter, np.inf)
        columns[int(ratio.argmin())] = pattern
    use = np.linalg.solve(np.array(columns, float).T, demand.astype(float))
    out, left = [], demand.copy()
    for pattern, times in zip(columns, np.floor(use + 1e-9).astype(np.int64), strict=True):
        if times > 0:
            out.append((pattern, int(times)))
            left = left - pattern * times
    left = np.maximum(left, 0)
    while left.any():  # fewer than one use of each column
        room, pattern = capacity, np.zeros(k, np.int64)
        for i in range(k):
            pattern[i] = min(left[i], room // sizes[i])
            room -= int(pattern[i] * sizes[i])
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, times))
        left = left - pattern * times
    return out


def best_plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """The plan with the fewest sequences, or the first that needs no more than the tokens do."""
    bound = -(-sum(n * c for n, c in counts.items()) // capacity)
    best = None
    for groups in GROUPS:
        for large in LARGE:
            found = plan(counts, capacity, groups, large)
            if best is None or found[1] < best[1]:
                best = found
            if best[1] == bound:
                return best
    return best


def plan(
    counts: dict[int, int], capacity: int, groups: int, large_above: int
) -> tuple[list[Run], int]:
    """Runs for so many pieces of each length, and the number of sequences."""
    runs: list[Run] = []
    used = {length: 0 for length in counts}
    sequences = 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []

    def leave(gap: int, first: int, count: int) -> None:
        if gap > 0 and count > 0:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, count))

    def place(length: int, count: int, sequence: int, per: int, offset: int) -> None:
        runs.append(Run(length, used[length], count, sequence, per, offset))
        used[length] += count

    large = sorted((n for n in counts if n > capacity // large_above), reverse=True)
    total = sum(counts[n] for n in large)
    if total:
        size = -(-total // groups)
        queues: list[list[list[int]]] = []
        room = 0
        for n in large:
            left = counts[n]
            while left:
                if not room:
                    queues.append([])
                    room = size
                take = min(left, room)
                queues[-1].append([n, take])
                left, room = left - take, room - take
        # Groups that round to one size are one size.
        merged: list[list[list[int]]] = []
        for q in queues:
            if merged and merged[-1][0][0] == q[0][0]:
                merged[-1].extend(q)
            else:
                merged.append(q)
        sizes = np.array([q[0][0] for q in merged])
        demand = np.array([sum(c for _, c in q) for q in merged])
        for pattern, times in configurations(sizes, demand, capacity):
            slots = [i for i in range(len(sizes)) for _ in range(pattern[i])]
            left = times
            while left:
                # As many sequences as have the same actual lengths.
                heads = []
                step = left
                need: dict[int, int] = {}
                for i in slots:
                    need[i] = need.get(i, 0) + 1
                for i, many in need.items():
                    if merged[i]:
                        step = min(step, max(1, merged[i][0][1] // many))
                for i in slots:
                    if not merged[i]:
                        continue
                    head = merged[i][0]
                    take = min(step, head[1])
                    heads.append((head[0], take))
                    head[1] -= take
                    if not head[1]:
                        merged[i].pop(0)
                if not heads:
                    break
                # A slot whose last pieces ran short leaves its gap in the later sequences.
                cuts = sorted({0, step, *(t for _, t in heads)})
                for low, high in zip(cuts, cuts[1:], strict=False):
                    offset = 0
                    for n, t in heads:
                        if t >= high:
                            place(n, high - low, sequences + low, 1, offset)
                            offset += n
                    leave(capacity - offset, sequences + low, high - low)
                sequences += step
                left -= step
    for n in sorted((n for n in counts if n <= capacity // large_above), reverse=True):
        left = counts[n]
        while left:
            at = bisect.bisect_left(order, n)
            if at < len(order):
                gap = order[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
            else:
                gap, first, count = capacity, sequences, -(-left // (capacity // n))
                sequences += count
            per = gap // n
            full = min(count, left // per)
            if full:
                place(n, full * per, first, per, capacity - gap)
                leave(gap - per * n, first, full)
                left -= full * per
            if full < count:
                if left:
                    place(n, left, first + full, left, capacity - gap)
                    leave(gap - left * n, first + full, 1)
                    leave(gap, first + full + 1, count - full - 1)
                    left = 0
                else:
                    leave(gap, first + full, count - full)
    return runs, sequences


def assign(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece. ``found`` is read twice; give a stored table."""
    spark = found.sparkSession
    deal = buckets(spark, 1)
    counts = {
        r["length"]: r["count"] for r in found.groupBy("length").count().collect()
    }  # at most ``capacity`` rows
    runs, _ = best_plan(counts, capacity)
    runs.sort(key=lambda r: (r.length, r.first))
    table = np.array(
        [(r.length, r.first, r.sequence, r.per, r.offset) for r in runs], np.int64
    ).reshape(-1, 5)
    keys = table[:, 0] << 48 | table[:, 1]

    # Pieces of a length are numbered part by part, so that a frequent length is no single task.
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(deal)).cast("int")
    own = found.withColumn("part", part)
    before = (
        own.groupBy("length", "part")
        .agg(F.count("*").alias("n"))
        .withColumn("end", F.sum("n").over(Window.partitionBy("length").orderBy("part")))
        .select("length", "part", (F.col("end") - F.col("n")).alias("before"))
    )
    number = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32"))
    numbered = (
        own.withColumn("number", number)
        .join(before, ["length", "part"])
        .withColumn("number", F.col("before") + F.col("number") - 1)
        .select("doc_id", "piece", "start", "length", "ids_crc32", "number")
    )

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length << 48 | number, "right") - 1
            _, first, sequence, per, offset = table[at].T
            step = number - first
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:5],
                    pa.array(sequence + step // np.maximum(per, 1)),
                    pa.array(offset + step % np.maximum(per, 1) * length),
                ],
                names=[*NAMES[:5], "sequence_id", "offset"],
            )

    return numbered.mapInArrow(
        locate,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """One row per piece with its place."""
    return assign(materialise(pieces(docs, capacity, vocabulary), "pieces"), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (little-endian 32-bit), and the documents
    in them by offset."""
    found = materialise(pieces(docs, capacity, vocabulary, with_ids=True), "pieces")
    placed = assign(found, capacity)
    whole = placed.join(found.select("doc_id", "piece", "ids").dropDuplicates(["doc_id", "piece"]), ["doc_id", "piece"])
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return whole.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id",
        F.aggregate("parts", F.lit(b""), lambda out, x: F.concat(out, x["ids"])).alias("ids"),
        F.transform("parts", lambda x: F.struct(x["offset"], x["doc_id"], x["piece"])).alias("parts"),
    )
