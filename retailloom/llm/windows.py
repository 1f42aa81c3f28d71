"""Repeated windows of a fixed number of symbols, found without comparing every window.

A window is represented by its anchor: the gram with the smallest hash inside it, the leftmost of
equals. The choice depends on the window's content alone, so equal windows have equal anchors at
the same place. Consecutive windows with one anchor form a segment. A shuffle by anchor shows
which segments occur again as a whole (their windows are decided at once) and which share their
anchor with a different segment; only the text of the latter is compared, by the caller's method.

Rows travel packed: one row per bucket and some million symbols, holding lists. Copies of a
segment within such a stretch collapse before the shuffle, so a hot one arrives once per stretch.
An anchor with very many different segments is dealt out further, by the content of its windows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailloom.llm.common import Rolling, blocks, buckets, dealt, listed, release, utf8
from retailloom.session import materialise

FLUSH = 1 << 18  # segments gathered before they are dealt out
FINER = 4  # groups of pieces for each group of segments: ordering suffixes takes some 130 to 180 bytes a byte of text
CROWD = 4096  # different segments of one anchor from which its windows are dealt out singly

PACKED = (
    "bucket int, anchor array<long>, segment array<long>, doc array<long>, start array<int>, "
    "count array<int>, sure array<tinyint>"
)
MARKS = "kind tinyint, doc_id long, start int, count int, anchor long"
WHOLE, COMPARE, CROWDED = 0, 1, 2


def segments(values: np.ndarray, bounds: np.ndarray, span: int, gram: int):
    """Document, first window, number of windows, anchor and content hash of each segment."""
    total = len(values) - span + 1
    lengths = np.diff(bounds)
    if total <= 0 or lengths.max(initial=0) < span:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty, empty
    rolling = Rolling(values)
    hashes = rolling.every(gram)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    width, wanted = 1, span - gram + 1
    while width * 2 <= wanted:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if rest := wanted - width:
        low = np.minimum(low[:-rest], low[rest:])
    place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.zeros(len(values) + 1, np.int32)
    long = lengths >= span
    np.add.at(edge, bounds[:-1][long], 1)
    np.add.at(edge, bounds[1:][long] - span + 1, -1)
    valid = np.flatnonzero(np.cumsum(edge[:total]))
    place = place[valid]
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, len(valid)])
    start = valid[first]
    doc = np.searchsorted(bounds, start, "right") - 1
    content = rolling.of(start, start + count + span - 1)
    return (
        doc, start - bounds[doc], count, hashes[place[first]].view(np.int64), content.view(np.int64),
    )


def _grouped(anchor, segment, doc, start):
    """Order by anchor, segment and place; where each segment and each anchor begins in it."""
    order = np.lexsort((start, doc, segment, anchor))
    a, s = anchor[order], segment[order]
    new_anchor = np.r_[True, a[1:] != a[:-1]]
    return order, new_anchor | np.r_[True, s[1:] != s[:-1]], new_anchor


def _repeats(order, new, doc, start, within: bool):
    """Members of a segment's group that repeat its first member; ``within`` one document too. A
    row given twice holds the same place twice, which is no repeat."""
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    doc, start = doc[order], start[order]
    later = doc > doc[head]
    return later | (start != start[head]) if within else later


def _pack(parts, total_buckets, within):
    doc, start, count, anchor, segment = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, new, _ = _grouped(anchor, segment, doc, start)
    sure = np.zeros(len(doc), np.int8)
    sure[order] = _repeats(order, new, doc, start, within)
    # What is decided already only passes through; any bucket does.
    key = np.where(sure == 1, doc + start, anchor)
    bucket = (key.view(np.uint64) >> np.uint64(8)) % np.uint64(total_buckets)
    return dealt(
        bucket.astype(np.int32), anchor=anchor, segment=segment, doc=doc,
        start=start.astype(np.int32), count=count.astype(np.int32), sure=sure,
    )


def _marks(kind, doc, start, count, anchor):
    return pa.table(
        {
            "kind": pa.array(kind, pa.int8()),
            "doc_id": pa.array(doc, pa.int64()),
            "start": pa.array(start, pa.int32()),
            "count": pa.array(count, pa.int32()),
            "anchor": pa.array(anchor, pa.int64()),
        }
    )


def _settle(table: pa.Table, within: bool) -> pa.Table:
    anchor, segment, doc, start, count, sure = (
        listed(table[c]) for c in ("anchor", "segment", "doc", "start", "count", "sure")
    )
    release()
    known = sure == 1
    open_ = np.flatnonzero(~known)
    kind = np.full(len(doc), -1, np.int8)
    kind[known] = WHOLE
    if len(open_):
        order, new, new_anchor = _grouped(anchor[open_], segment[open_], doc[open_], start[open_])
        again = _repeats(order, new, doc[open_], start[open_], within)
        group = np.cumsum(new_anchor) - 1
        different = np.bincount(group, weights=new)[group]
        state = np.where(different > CROWD, CROWDED, np.where(different > 1, COMPARE, -1))
        state[again] = WHOLE
        kind[open_[order]] = state
    keep = kind >= 0
    return _marks(kind[keep], doc[keep], start[keep], count[keep], anchor[keep])


def repeated_windows(
    docs: DataFrame,
    symbols: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, Callable]],
    compare: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]], tuple],
    span: int,
    gram: int,
    within: bool,
) -> DataFrame:
    """(doc_id, runs): stretches of windows, as first window and count, that occurred earlier.

    ``symbols`` turns a block of bytes into symbol values, their document bounds, and a function
    that cuts symbols i to j of the block as bytes. ``compare`` gets key, document, first window,
    number of windows and bytes of pieces whose keys may share windows, and gives document, first
    window and count of the repeats. ``within``: an earlier place in the same document counts.
    """
    spark = docs.sparkSession
    deal = buckets(spark)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for ids, data, bounds in blocks(batches):
            values, limits, _ = symbols(data, bounds)
            doc, start, count, anchor, segment = segments(values, limits, span, gram)
            parts.append((ids[doc].astype(np.int64), start, count, anchor, segment))
            held += len(doc)
            if held >= FLUSH:
                yield _pack(parts, deal, within)
                parts, held = [], 0
        if held:
            yield _pack(parts, deal, within)

    def settle(group: pa.Table) -> pa.Table:
        return _settle(group, within)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            wanted = batch.column(2)
            offsets = wanted.offsets.to_numpy() - wanted.offsets[0].as_py()
            fields = wanted.flatten()
            kind, first, number, key = (
                fields.field(i).to_numpy(zero_copy_only=False) for i in range(4)
            )
            row = 0
            for ids, data, bounds in blocks(iter([batch])):
                values, limits, take = symbols(data, bounds)
                low, high = offsets[row], offsets[row + len(ids)]
                doc = np.repeat(np.arange(len(ids)), np.diff(offsets[row : row + len(ids) + 1]))
                row += len(ids)
                k, f, n, a = kind[low:high], first[low:high], number[low:high], key[low:high]
                # A document given again with another text may be too short for its marks.
                fits = f + n + span - 1 <= np.diff(limits)[doc]
                k, f, n, a, doc = k[fits], f[fits], n[fits], a[fits], doc[fits]
                one = np.where(k == CROWDED, n, 1)
                each = np.repeat(np.arange(len(k)), one)
                step = np.arange(len(each)) - np.repeat(np.cumsum(one) - one, one)
                f, doc, crowded, a = f[each] + step, doc[each], k[each] == CROWDED, a[each]
                n = np.where(crowded, 1, n[each])
                begin = limits[:-1][doc] + f
                if crowded.any():
                    window = Rolling(values).of(begin[crowded], begin[crowded] + span)
                    a = a.copy()
                    a[crowded] = window.view(np.int64)
                pieces = [take(i, j) for i, j in zip(begin, begin + n + span - 1, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array((a.view(np.uint64) >> np.uint64(8)) % np.uint64(FINER * deal)).cast(pa.int32()),
                        pa.array(a, pa.int64()),
                        pa.array(ids[doc], pa.int64()),
                        pa.array(f, pa.int32()),
                        pa.array(n, pa.int32()),
                        pa.array(pieces, pa.binary()),
                    ],
                    names=["bucket", "key", "doc_id", "start", "count", "piece"],
                )

    def judge(group: pa.Table) -> pa.Table:
        key, doc, start, count = (
            group[c].combine_chunks().to_numpy(zero_copy_only=False)
            for c in ("key", "doc_id", "start", "count")
        )
        d, s, n = compare(key, doc, start, count, group["piece"].to_pylist())
        release()
        return _marks(np.zeros(len(d), np.int8), d, s, n, np.zeros(len(d), np.int64))

    marks = materialise(
        docs.mapInArrow(find, PACKED).groupBy("bucket").applyInArrow(settle, MARKS), "marks"
    )
    pieces = (
        docs.join(
            marks.where(F.col("kind") != WHOLE)
            .groupBy("doc_id")
            .agg(F.collect_list(F.struct("kind", "start", "count", "anchor")).alias("wanted")),
            "doc_id",
        )
        .select("doc_id", "text", "wanted")
        .mapInArrow(
            cut, "bucket int, key long, doc_id long, start int, count int, piece binary"
        )
    )
    found = pieces.groupBy("bucket").applyInArrow(judge, MARKS)
    return (
        marks.where(F.col("kind") == WHOLE)
        .unionByName(found)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "count")).alias("runs"))
    )


def covered(starts: np.ndarray, counts: np.ndarray, span: int, length: int) -> np.ndarray:
    """Which of ``length`` symbols lie in one of the windows."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, np.minimum(starts, length), 1)
    np.add.at(edge, np.minimum(starts + counts + span - 1, length), -1)
    return np.cumsum(edge[:length]) > 0


def per_document(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes, np.ndarray, np.ndarray]]:
    """Id, bytes and runs of each row of (doc_id, text, runs)."""
    data, bounds = utf8(batch.column(1))
    runs = batch.column(2)
    offsets = runs.offsets.to_numpy() - runs.offsets[0].as_py()
    fields = runs.flatten()
    starts = fields.field(0).to_numpy(zero_copy_only=False)
    counts = fields.field(1).to_numpy(zero_copy_only=False)
    for i, doc_id in enumerate(batch.column(0).to_pylist()):
        part = slice(offsets[i], offsets[i + 1])
        yield doc_id, data[bounds[i] : bounds[i + 1]], starts[part], counts[part]
