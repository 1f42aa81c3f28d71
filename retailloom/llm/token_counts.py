"""Operator 8: token counts that follow edits.

A document is kept as a segment tree over its pre-tokens: leaves hold stretches of pre-tokens with
their counts of characters and tokens, inner nodes the sums. An edit re-splits and re-encodes only
the pre-tokens it touches and their context: from two words before it, since the split looks ahead,
to the first old boundary after it that the new split meets again. Then the sums above the touched
leaves are updated. Pre-tokens are encoded independently, so the count is that of the whole text.

``keep`` stores the trees: of every document its text, the lengths and counts of its pre-tokens, and how they
lie in leaves. ``edit`` reads the trees of the documents it touches, encodes what the edits need, and stores
these trees under the next version; all other trees stay as they are. So round after round of edits costs what it
touches. The newest version of a document counts.

Edits are (start, end, text): characters start to end, clipped to the text as it is then, are replaced by
the text. They apply in their order. A null text is empty, null edits are none, a null replacement
is a deletion; null bounds stand for the end of the text. Repeated rows give a row each; rows
without doc_id are left out.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retailloom.llm.common import id_and_text, release
from retailloom.session import materialise

LEAF = 32  # pre-tokens in a leaf when a tree is built
VOCABULARY = "byte_bpe_50k.tiktoken"
KNOWN = 120_000  # pre-tokens a task remembers
EDITS = 4  # edits per document in the query


class Counter:
    """Pre-tokens of a text, and the number of tokens of a pre-token."""

    def __init__(self, vocabulary: str):
        import regex
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "counter", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.split = regex.compile(public_tokenizers.PATTERN)
        self.known: dict[str, int] = {}

    def count(self, token: str) -> int:
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= KNOWN:
                self.known.clear()
            found = self.known[token] = len(self.encoding.encode_ordinary(token))
        return found


_counters: dict[str, Counter] = {}


class Tree:
    """Segment tree over the pre-tokens of one document."""

    def __init__(self, text: str, counter: Counter):
        self.counter = counter
        self.encoded = 0
        tokens = counter.split.findall(text)
        self._build([self._leaf(tokens[i : i + LEAF]) for i in range(0, len(tokens), LEAF)] or [([], [])])
        self.encoded = 0

    @classmethod
    def restored(cls, text: str, chars: list[int], counts: list[int], leaves: list[int], counter: Counter):
        """From what ``parts`` gave: nothing is split or encoded."""
        tree = cls.__new__(cls)
        tree.counter, tree.encoded = counter, 0
        stops = itertools.accumulate(chars, initial=0)
        tokens = [text[a:b] for a, b in itertools.pairwise(stops)]
        bounds = itertools.pairwise(itertools.accumulate(leaves, initial=0))
        tree._build([(tokens[a:b], counts[a:b]) for a, b in bounds])
        return tree

    def parts(self) -> tuple[str, list[int], list[int], list[int]]:
        """Text, characters and tokens of each pre-token, and pre-tokens of each leaf."""
        tokens = [t for leaf in self.leaves for t in leaf[0]]
        counts = [c for leaf in self.leaves for c in leaf[1]]
        return "".join(tokens), [*map(len, tokens)], counts, [len(leaf[0]) for leaf in self.leaves]

    def _leaf(self, tokens: list[str]) -> tuple[list[str], list[int]]:
        self.encoded += len(tokens)
        return tokens, [*map(self.counter.count, tokens)]

    def _build(self, leaves) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, leaf in enumerate(leaves):
            self._sum_leaf(i, leaf)
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum_leaf(self, i: int, leaf) -> None:
        self.chars[self.size + i] = sum(map(len, leaf[0]))
        self.tokens[self.size + i] = sum(leaf[1])

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    def find(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where the leaf begins."""
        node, begin = 1, 0
        while node < self.size:
            node *= 2
            if place >= begin + self.chars[node]:
                begin += self.chars[node]
                node += 1
        return min(node - self.size, len(self.leaves) - 1), begin

    def edit(self, start: int | None, end: int | None, text: str | None) -> None:
        total = self.length
        start = total if start is None else min(max(start, 0), total)
        end = total if end is None else min(max(end, start), total)
        text = text or ""
        # Context on the left: two pre-tokens that are not white space.
        first, begin = self.find(max(0, min(start, total - 1)))
        words, tokens = 0, []
        while True:
            offsets, at = [], begin
            for token in self.leaves[first][0]:
                offsets.append((at, token))
                at += len(token)
            tokens = offsets + tokens
            before = [i for i, (at, _) in enumerate(tokens) if at < start]
            words, keep = 0, 0
            for i in reversed(before):
                words += not tokens[i][1].isspace()
                if words == 3:
                    keep = i
                    break
            if words == 3 or not first:
                break
            first -= 1
            begin -= self.chars[self.size + first]
        origin = tokens[keep][0] if tokens else 0
        head = [t for at, t in tokens[:keep]]
        # The old text from there on, leaf by leaf, until the new split meets an old boundary.
        last, stop = self.find(max(0, min(end, total - 1)))
        stop += self.chars[self.size + last]
        while True:
            old = "".join(t for leaf in self.leaves[first : last + 1] for t in leaf[0])
            old = old[len("".join(head)) :]
            shift = len(text) - (end - start)
            new = old[: start - origin] + text + old[end - origin :]
            bounds, at = set(), origin
            tail = [t for leaf in self.leaves[first : last + 1] for t in leaf[0]][len(head) :]
            starts = []
            for t in tail:
                starts.append(at)
                bounds.add(at)
                at += len(t)
            final = last == len(self.leaves) - 1
            made, met = [], None
            for match in self.counter.split.finditer(new):
                place = match.start() + origin - shift
                if place >= end and place in bounds and match.start() + origin >= start + len(text):
                    met = place
                    break
                made.append(match[0])
            if met is not None or final:
                break
            last += 1
            stop += self.chars[self.size + last]
        rest = tail[starts.index(met) :] if met is not None else []
        self._replace(first, last, head, made, rest)

    def _replace(self, first: int, last: int, head: list[str], made: list[str], rest: list[str]) -> None:
        """Leaves first to last become head, the new pre-tokens, and rest."""
        known = [c for leaf in self.leaves[first : last + 1] for c in leaf[1]]
        fresh = self._leaf(made)
        tokens = head + made + rest
        counts = known[: len(head)] + fresh[1] + known[len(known) - len(rest) :]
        spots = last - first + 1
        if len(tokens) > 4 * LEAF * spots:  # a long insertion: the tree takes a new shape
            new = [(tokens[i : i + LEAF], counts[i : i + LEAF]) for i in range(0, len(tokens), LEAF)]
            self._build(self.leaves[:first] + new + self.leaves[last + 1 :])
            return
        each = -(-len(tokens) // spots)
        touched = set()
        for i in range(spots):
            part = slice(i * each, (i + 1) * each)
            self.leaves[first + i] = (tokens[part], counts[part])
            self._sum_leaf(first + i, self.leaves[first + i])
            touched.add((self.size + first + i) // 2)
        while touched and max(touched) >= 1:
            for node in touched:
                if node:
                    self._sum(node)
            touched = {node // 2 for node in touched if node > 1}


EDIT = "array<struct<start: long, end: long, text: string>>"


def edited_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """For rows of doc_id, text and edits (array of start, end, text in order): doc_id, n_tokens of
    the text, n_tokens_edited after all edits, n_chars_edited, n_pretokens of the text, and
    n_reencoded, the pre-tokens encoded for the edits."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        counter = _counters[vocabulary]
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                rows = []
                for doc_id, text, edits in zip(*(c.to_pylist() for c in batch.slice(part, 64).columns), strict=True):
                    tree = Tree(text or "", counter)
                    before, size = tree.total, sum(len(leaf[0]) for leaf in tree.leaves)
                    for edit in edits or ():
                        if edit is not None:
                            tree.edit(edit["start"], edit["end"], edit["text"])
                    rows.append((doc_id, before, tree.total, tree.length, size, tree.encoded))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=NAMES
                )
        counter.known = {}  # the worker outlives its task
        release()

    rows = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("edits").cast(EDIT).alias("edits"),
    )
    return rows.mapInArrow(count, ", ".join(f"{n} long" for n in NAMES))


NAMES = ["doc_id", "n_tokens", "n_tokens_edited", "n_chars_edited", "n_pretokens", "n_reencoded"]


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """Documents with their edits, given as a table of doc_id, step, start, end and text."""
    return id_and_text(docs).join(_grouped(edits), "doc_id", "left")


def _grouped(edits: DataFrame) -> DataFrame:
    """The edits of each document in their order."""
    return (
        edits.where("doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.sort_array(F.collect_list(F.struct("step", "start", "end", "text"))).alias("edits"))
        .withColumn(
            "edits",
            F.transform("edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"))),
        )
        .withColumn("edits", F.col("edits").cast(EDIT))
    )


KEPT = (
    "doc_id long, n_tokens long, n_chars long, n_reencoded long, text string, chars array<int>,"
    " counts array<int>, leaves array<int>"
)


def _trees(rows: DataFrame, vocabulary: str | None, stored: bool) -> DataFrame:
    """Trees as rows, of texts or of stored trees, after their edits."""
    vocabulary = vocabulary or public_tokenizers.path(VOCABULARY)
    names = [c.split()[0] for c in KEPT.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.list_(pa.int32())] * 3

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _counters:
            _counters[vocabulary] = Counter(vocabulary)
        counter = _counters[vocabulary]
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                out = []
                for doc_id, edits, *rest in zip(*(c.to_pylist() for c in batch.slice(part, 64).columns), strict=True):
                    tree = Tree.restored(*rest, counter) if stored else Tree(rest[0] or "", counter)
                    for edit in edits or ():
                        if edit is not None:
                            tree.edit(edit["start"], edit["end"], edit["text"])
                    out.append((doc_id, tree.total, tree.length, tree.encoded, *tree.parts()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names
                )
        counter.known = {}
        release()

    columns = ["text", "chars", "counts", "leaves"] if stored else ["text"]
    return rows.select("doc_id", "edits", *columns).mapInArrow(make, KEPT)


def keep(docs: DataFrame, folder: str, vocabulary: str | None = None) -> DataFrame:
    """Store the tree of every document below ``folder`` as version 0, replacing what is there. Of rows that
    share a doc_id the smallest text counts; null is empty."""
    texts = id_and_text(docs).groupBy("doc_id").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    texts = texts.withColumn("edits", F.lit(None).cast(EDIT))
    _trees(texts, vocabulary, False).write.mode("overwrite").parquet(f"{folder}/version=0")
    return kept(docs.sparkSession, folder)


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(KEPT + ", version int").parquet(folder)


def kept(spark: SparkSession, folder: str) -> DataFrame:
    """The newest tree of every document."""
    rows = _versions(spark, folder)
    newest = rows.groupBy("doc_id").agg(F.max("version").alias("version"))
    return rows.join(newest, ["doc_id", "version"])


def edit(spark: SparkSession, folder: str, edits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Apply a round of edits (doc_id, step, start, end, text) to the stored trees. Returns the trees it has
    touched; ``n_reencoded`` counts the pre-tokens it had to encode. Edits of unknown documents are none."""
    given = _grouped(edits)
    last = _versions(spark, folder).agg(F.max("version")).first()[0]
    # Only the trees of touched documents are read whole: the keys go first.
    touched = materialise(given, "edits")
    ids = _versions(spark, folder).select("doc_id", "version").join(touched.select("doc_id"), "doc_id", "left_semi")
    newest = materialise(ids.groupBy("doc_id").agg(F.max("version").alias("version")), "touched-trees")
    trees = _versions(spark, folder).drop("n_tokens", "n_chars", "n_reencoded").join(newest, ["doc_id", "version"])
    version = (-1 if last is None else last) + 1
    changed = _trees(trees.join(touched, "doc_id"), vocabulary, True)
    changed.write.mode("overwrite").parquet(f"{folder}/version={version}")
    return _versions(spark, folder).where(F.col("version") == version)


def derived_edits() -> Column:
    """Edits made of the document itself: pieces of its text, from and to places that a hash of
    doc_id gives, are inserted, replace others, or are deleted."""
    size = F.length("text")

    def place(i: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("doc_id", F.lit(i), F.lit(salt)), size + 1)

    edits = []
    for i in range(EDITS):
        start = place(i, 0)
        end = start + (0 if i % 4 == 0 else 1 + F.pmod(F.xxhash64("doc_id", F.lit(i), F.lit(1)), F.lit(60)))
        text = F.lit("") if i % 4 == 1 else F.substring("text", (place(i, 2) + 1).cast("int"), F.lit(40))
        edits.append(F.struct(start.alias("start"), end.alias("end"), text.alias("text")))
    return F.array(*edits).cast(EDIT)


def digest(docs: DataFrame) -> DataFrame:
    """Counts before and after the derived edits, for every document."""
    return edited_counts(id_and_text(docs).withColumn("edits", derived_edits()))
