"""Operator 13: which tokens of two tokenizers cover the same bytes of a corpus.

Tokenizer A is a byte-level BPE (``tokenizers``), B a sentencepiece model with byte fallback. Both
read space + text. Their spans are coarse cuts: A gives character offsets, in which all tokens that cut
a character end behind it; B's proto gives spans of bytes, in which of the byte-fallback tokens of a character
only the last is not empty. Tokens that share a cut are told apart by their decoded bytes, counted back from
it. Ends that both have cut the text into groups; tokens that end there together are links.

Neither tokenizer looks across certain places: before a space or line feed after other characters,
and between a Latin letter and a mark, unless the vocabulary has a piece across (asked when it is
loaded). So texts are cut there into segments, each segment is encoded and aligned once per task, and
documents add up segments. Segments whose tokens do not spell them make a document go through both
tokenizers whole; if even then the bytes differ, it has no tokens.

Counts: tasks store packs of documents, each with its segments and links. Only Python reads these, so Spark
carries them as compressed bytes: as lists, their rows of some 12 MB filled an executor when they were written,
read and dealt out. The links of a pack are added up before the shuffle by (A id, B id); a pack gets back the
counts of the pairs it holds, so that a frequent pair comes once per pack, not once per use. B ids are at most
the vocabulary's.

Texts null, empty, or whose bytes the tokens do not spell have zeros and an empty string. Rows that
repeat a doc_id give a row each and count each; rows without doc_id are left.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retailloom.llm.common import id_and_text, listed, release
from retailloom.session import materialise

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
PACK = 4 << 20  # characters of the documents that are stored together
STEP = 1 << 20  # characters that are cut into segments at a time
SEGMENTS = 200_000  # of one long text
KNOWN = 250_000  # segments in each of the two generations that a worker remembers
LONGEST = 200  # characters of a segment that is remembered
TOGETHER = 1000  # segments that go through the tokenizers as one text
LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
SPACE = "▁"


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in their
    order, as the characters from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Of a segment: its groups as they are written, its links (A id * size of B + B id) as 32-bit numbers, and
#: how many A and B tokens it has.
Record = tuple[bytes | None, bytes, int, int]
UNSPELLED: Record = (None, b"", 0, 0)


class Aligner:
    """Both tokenizers, and the segments met lately."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_level)
        self.a.encode_special_tokens = True
        letters = _byte_letters()
        words = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = {i: bytes(map(letters.__getitem__, w)) for w, i in words.items()}
        self.length_a = np.zeros(max(words.values()) + 1, np.int64)
        self.length_a[[*self.bytes_a]] = [*map(len, self.bytes_a.values())]

        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        found = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode()
            for i, p in enumerate(found)
        ]
        self.length_b = np.array([*map(len, self.bytes_b)])
        self.fallback = np.array([self.b.is_byte(i) for i in range(len(found))])
        plain = [
            p for i, p in enumerate(found)
            if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))
        ]
        marks = "".join(
            m for m in map(chr, range(0x21, 0x7F))
            if not m.isalnum() and m not in "'_" and not any(re.search(f"[{LATIN}]{re.escape(m)}", p) for p in plain)
        )
        starts = " " if not any(SPACE in p.lstrip(SPACE) for p in plain) else ""
        alone = "\n" not in "".join(plain) and self.b.encode("\nx")[:-1] == self.b.encode("\n")
        starts += "\n" if starts and alone else ""
        rest = rf"\S*(?:[^\S{starts}]\s*\S*)*"
        # Every match begins where neither looks across. Without such places a text is one segment.
        forms = []
        if starts:
            forms.append(rf"[{starts}]\s*{rest}")
            if marks:
                some = re.escape(marks)
                forms = [rf"[{starts}]\s*[{LATIN}]+(?=[{some}])", rf"[{some}]{rest}", *forms]
        self.cut = re.compile("|".join([*forms, r"[\s\S]+"]))
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, Record] = {}
        self.old: dict[str, Record] = {}

    @property
    def size_b(self) -> int:
        return len(self.bytes_b)

    def encode_a(self, text: str, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the byte each token ends at."""
        found = self.a.encode(text, add_special_tokens=False)
        ids = np.array(found.ids, np.int64)
        ends = np.fromiter(map(operator.itemgetter(1), found.offsets), np.int64, len(ids))
        if len(data) != len(text):  # from characters to bytes
            raw = np.frombuffer(data, np.uint8)
            ends = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)][ends]
        return ids, refined(ends, self.length_a[ids])

    def encode_b(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for B, of a text that begins with the space which the model adds itself."""
        pieces = self.b.encode(text[1:], return_type="proto").pieces
        ids = np.fromiter((p.id for p in pieces), np.int64, len(pieces))
        ends = np.fromiter((p.end for p in pieces), np.int64, len(pieces)) + 1
        for i in np.flatnonzero(self.fallback[ids])[::-1].tolist():
            if i + 1 < len(ids) and pieces[i].begin == pieces[i].end:
                ends[i] = ends[i + 1]
        return ids, refined(ends, self.length_b[ids])

    def spelled(self, ids_a: np.ndarray, ids_b: np.ndarray, data: bytes) -> bool:
        return (
            b"".join(map(self.bytes_a.__getitem__, ids_a.tolist())) == data
            and b"".join(map(self.bytes_b.__getitem__, ids_b.tolist())) == data
        )

    def _align(self, parts: list[str]) -> list[Record] | None:
        """Align a text of several segments. None if the tokens do not spell it, or go across the
        end of a segment."""
        text = "".join(parts)
        data = text.encode()
        (ids_a, ends_a), (ids_b, ends_b) = self.encode_a(text, data), self.encode_b(text)
        if not self.spelled(ids_a, ids_b, data):
            return None
        at_b = np.searchsorted(ends_b, ends_a)
        at_a = np.flatnonzero(ends_b[np.minimum(at_b, len(ends_b) - 1)] == ends_a)
        common, at_b = ends_a[at_a], at_b[at_a]
        stops = np.cumsum([len(p.encode()) for p in parts])
        last = np.searchsorted(common, stops)
        if (common[np.minimum(last, len(common) - 1)] != stops).any():
            return None
        a, b = ids_a.tolist(), ids_b.tolist()
        tops = list(zip((at_a + 1).tolist(), (at_b + 1).tolist(), strict=True))
        written, low_a, low_b = [], 0, 0
        for high_a, high_b in tops:
            if high_a - low_a == 1 == high_b - low_b:
                written.append(f"{a[low_a]}|{b[low_b]}")
            else:
                left, right = map(str, a[low_a:high_a]), map(str, b[low_b:high_b])
                written.append(f"{','.join(left)}|{','.join(right)}")
            low_a, low_b = high_a, high_b
        links = (ids_a[at_a] * self.size_b + ids_b[at_b]).astype("<i4").tobytes()
        found, low, low_a, low_b = [], 0, 0, 0
        for high in (last + 1).tolist():
            high_a, high_b = tops[high - 1]
            groups = ";".join(written[low:high]).encode()
            found.append((groups, links[4 * low : 4 * high], high_a - low_a, high_b - low_b))
            low, low_a, low_b = high, high_a, high_b
        return found

    def whole(self, text: str) -> Record:
        found = self._align([text])
        return found[0] if found else UNSPELLED

    def alone(self, segment: str) -> Record:
        found = self._align([" a", segment])
        return found[1] if found else UNSPELLED

    def learn(self, segments: list[str]) -> None:
        """Many segments as one text. One that starts with a mark needs a letter before it; the space
        at the end of a text would run into the next segment."""
        together = [s for s in segments if not s[-1].isspace()]
        for low in range(0, len(together), TOGETHER):
            some = together[low : low + TOGETHER]
            parts = [" a"]
            for s in some:
                parts += [s] if s[0].isspace() else [" a", s]
            found = self._align(parts)
            if found:
                self.young.update(zip(parts, found, strict=True))
            else:
                self.young.update((s, self.alone(s)) for s in some)
        self.young.update((s, self.alone(s)) for s in segments if s[-1].isspace())

    def records(self, segments: list[str]) -> list[Record]:
        """Of distinct segments. What was not asked for in a whole generation is forgotten."""
        if len(self.young) > KNOWN:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, segments))
        new = []
        for i in [i for i, record in enumerate(found) if record is None]:
            record = self.old.get(segments[i])
            if record is None:
                new.append(i)
            else:
                self.young[segments[i]] = found[i] = record
        self.learn([segments[i] for i in new if len(segments[i]) <= LONGEST])
        for i in new:
            found[i] = self.young.get(segments[i]) or self.alone(segments[i])
        return found


class Pack:
    """Texts that are stored together, as numbers of the segments they share."""

    def __init__(self, aligner: Aligner):
        self.aligner = aligner
        self.place: dict[str, int] = {}
        self.records: list[Record] = []
        self.unspelled = False

    def numbers(self, segments: list[str]) -> np.ndarray:
        new = list(set(segments).difference(self.place))
        self.place.update(zip(new, range(len(self.records), len(self.records) + len(new)), strict=True))
        found = self.aligner.records(new)
        self.records += found
        self.unspelled |= UNSPELLED in found
        return np.fromiter(map(self.place.__getitem__, segments), np.int32, len(segments))

    def add(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Of every text the numbers of its segments; none for a text without tokens."""
        cut = [self.aligner.cut.findall(" " + t) if t and len(t) <= STEP else [] for t in texts]
        flat = self.numbers(list(itertools.chain.from_iterable(cut)))
        stops = np.cumsum([len(found) for found in cut])
        for text, end, found in zip(texts, stops.tolist(), cut, strict=True):
            numbers = flat[end - len(found) : end]
            if text and len(text) > STEP:
                runs = (m.group() for m in self.aligner.cut.finditer(" " + text))
                some = iter(lambda: list(itertools.islice(runs, SEGMENTS)), [])
                numbers = np.concatenate([self.numbers(s) for s in some])
            if self.unspelled and any(self.records[n] is UNSPELLED for n in numbers.tolist()):
                record = self.aligner.whole(" " + text)
                numbers = np.full(int(record is not UNSPELLED), len(self.records), np.int32)
                self.records += [record] * len(numbers)
            yield numbers


def refined(cuts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Where tokens end, from the cuts behind them: of the tokens that share a cut the last ends there,
    and the ones before it by the bytes of those after them earlier."""
    if not len(cuts):
        return cuts
    total = np.cumsum(lengths)
    last = np.r_[np.flatnonzero(cuts[1:] != cuts[:-1]), len(cuts) - 1]
    last = last[np.searchsorted(last, np.arange(len(cuts)))]
    return cuts - (total[last] - total)


_aligners: dict[tuple[str, str], Aligner] = {}

PACKED = "pack long, body binary, pairs array<int>, uses array<long>"
#: A reader's batch holds a whole row group, and a writer all rows of the one it is at.
FEW_ROWS = {"parquet.block.row.count.limit": "2"}


def to_body(columns: dict[str, np.ndarray | list[str]]) -> bytes:
    """Arrays of any lengths as compressed bytes."""
    batch = pa.RecordBatch.from_pydict(
        {name: pa.ListArray.from_arrays([0, len(values)], pa.array(values)) for name, values in columns.items()}
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_body(body: bytes) -> dict[str, np.ndarray]:
    table = pa.ipc.open_stream(body).read_all()
    return {name: listed(table[name]) for name in table.column_names}


def packs(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """Documents aligned, many to a row: what each of them returns, the numbers of its segments, the
    links of the segments, and how often each pair of ids is linked in the row."""

    def one(aligner: Aligner, number: int, ids: list[int], texts: list[str | None]) -> pa.RecordBatch:
        pack, found, low = Pack(aligner), [], 0
        while low < len(texts):
            high, room = low, STEP
            while high < len(texts) and (high == low or room > 0):
                room -= len(texts[high] or "")
                high += 1
            found += pack.add(texts[low:high])
            low = high
        counts = np.array([len(f) for f in found], np.int32)
        segments = np.concatenate(found)
        often = np.bincount(segments, minlength=len(pack.records))
        groups, links, n_a, n_b = zip(*pack.records, strict=True) if pack.records else [()] * 4
        sizes = np.array([len(x) // 4 for x in links], np.int32)
        flat = np.frombuffer(b"".join(links), "<i4")
        pairs, inverse = np.unique(flat, return_inverse=True)
        uses = np.bincount(inverse, np.repeat(often, sizes), len(pairs)).astype(np.int64)
        figures = np.column_stack([np.array(n_a, np.int64), np.array(n_b, np.int64), sizes])
        sums = np.r_[np.zeros((1, 3), np.int64), np.cumsum(figures[segments], 0)]
        stops = np.r_[0, np.cumsum(counts)]
        n_a, n_b, n_groups = (sums[stops[1:]] - sums[stops[:-1]]).T
        written = (b";".join(map(groups.__getitem__, f.tolist())) for f in found)
        hashes = [hashlib.sha256(w).hexdigest() if w else "" for w in written]
        # Segments of a text that then went through whole are in no document, nor are their pairs.
        kept = uses > 0
        body = to_body(
            {
                "doc_id": np.array(ids, np.int64), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "groups_sha256": hashes,
                "segments": segments, "segment_counts": counts, "links": flat, "link_counts": sizes,
            }
        )
        columns = [
            pa.array([number], pa.int64()), pa.array([body], pa.binary()),
            pa.array([pairs[kept]], pa.list_(pa.int32())), pa.array([uses[kept]], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PACKED.split(", ")])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = byte_level, pieces
        if names not in _aligners:
            _aligners[names] = Aligner(*names)
        aligner = _aligners[names]
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        texts: list[str | None] = []
        size = 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(i)
                texts.append(text)
                size += len(text or "") + 64
                if size >= PACK:
                    yield one(aligner, number, ids, texts)
                    number, ids, texts, size = number + 1, [], [], 0
        if ids:
            yield one(aligner, number, ids, texts)
        release()

    return id_and_text(docs).mapInArrow(align, PACKED)


def pair_counts(packed: DataFrame, size_b: int) -> DataFrame:
    """pair, uses, and whether no other A id is linked more often with the pair's B id."""
    pairs = packed.select(F.explode(F.arrays_zip("pairs", "uses")).alias("p")).groupBy(
        F.col("p.pairs").alias("pair")
    )
    # A B id has at most one row here for every A id.
    same_b = Window.partitionBy(F.pmod("pair", F.lit(size_b)))
    counted = pairs.agg(F.sum("p.uses").alias("uses"))
    return counted.withColumn("best", F.col("uses") == F.max("uses").over(same_b))


def aligned(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None) -> DataFrame:
    """Per document: n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256."""
    byte_level = byte_level or public_tokenizers.path(BYTE_LEVEL)
    pieces = pieces or public_tokenizers.path(PIECES)
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=pieces).get_piece_size()
    packed = materialise(packs(docs, byte_level, pieces), "aligned-packs", **FEW_ROWS)
    counts = materialise(pair_counts(packed, size_b), "pair-counts")
    back = packed.select(F.col("pack").alias("into"), F.explode("pairs").alias("pair")).join(counts, "pair")

    def finish(pack: pa.Table, known: pa.Table) -> pa.Table:
        body = from_body(pack["body"][0].as_buffer())
        pairs = known["pair"].to_numpy()
        order = np.argsort(pairs)
        links, sizes = body["links"], body["link_counts"]
        # A pair without a use is missing; no document asks for it.
        place = np.searchsorted(pairs, links, sorter=order)
        place = np.r_[order, 0][np.minimum(place, len(order))]
        uses, best = (np.r_[known[c].to_numpy(), 0][place] for c in ("uses", "best"))
        each = np.zeros((len(links) + 1, 3), np.int64)
        np.cumsum(np.column_stack([np.ones(len(links), np.int64), best, uses]), 0, out=each[1:])
        ends = np.cumsum(sizes)
        of_segment = (each[ends] - each[ends - sizes])[body["segments"]]
        each = np.zeros((len(of_segment) + 1, 3), np.int64)
        np.cumsum(of_segment, 0, out=each[1:])
        ends = np.cumsum(body["segment_counts"])
        n_links, n_best, count_sum = (each[ends] - each[ends - body["segment_counts"]]).T
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        body |= {"n_links": n_links, "n_best": n_best, "count_sum": count_sum}
        return pa.table([pa.array(body[n]) for n in names], names=names)

    schema = (
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long,"
        " groups_sha256 string"
    )
    left = packed.drop("pairs", "uses").groupBy("pack")
    return left.cogroup(back.groupBy("into")).applyInArrow(finish, schema)
