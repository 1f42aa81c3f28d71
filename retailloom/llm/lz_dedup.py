"""Operator 4: remove words covered by a passage of ``span`` words that an earlier document holds.

Relative Lempel-Ziv parsing. Candidate stretches are gathered by :mod:`windows`. Within a bucket
the stretches of earlier documents are reference blocks, indexed by their windows; each document
is factored greedily against all of them. A factor of at least ``span`` words is a duplicate span.
Parsing goes on at the first window that a factor does not hold, so passages that straddle factor
boundaries are looked up too.

Words are runs of bytes other than space and 0x09-0x0D. Null and empty texts have none. Rows
sharing a doc_id are one document: each gets the same result. Rows without doc_id are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailloom.llm.common import Rolling, id_and_text, release, run_bounds, word_bounds, word_values
from retailloom.llm.windows import covered, per_document, repeated_windows

SPAN = 50
GRAM = 22


def _words_of(data: np.ndarray, bounds: np.ndarray):
    starts, ends, limits = word_bounds(data, bounds)
    raw = data.tobytes()
    return (
        word_values(data, starts, ends),
        limits,
        lambda low, high: raw[starts[low] : ends[high - 1]],
    )


def factors(values: list[int], windows: list[int], stretches, span: int):
    """Parse one reference collection: ``stretches`` are (doc, first window, count, offset of the
    words, number of words), earlier documents first. Yields the long factors as runs of windows.
    """
    index: dict[int, tuple[int, int]] = {}
    waiting: list[tuple[int, int, int]] = []
    current = None
    for doc, start, count, offset, size in stretches:
        if doc != current:  # a document is parsed against earlier ones only
            for at, number, end in waiting:
                for i in range(at, at + number):
                    index.setdefault(windows[i], (i, end))
            waiting, current = [], doc
        at = 0
        while at < count:
            block = index.get(windows[offset + at])
            if block is None:
                at += 1
                continue
            place, end = block
            length = span
            while (
                at + length < size
                and place + length < end
                and values[place + length] == values[offset + at + length]
            ):
                length += 1
            yield doc, start + at, length - span + 1
            at += length - span + 1
        waiting.append((offset, count, offset + size))


def earlier_passages(key, doc, start, count, pieces, span=SPAN):
    """Windows of the pieces that occur in a piece of a smaller document, as runs."""
    order = np.lexsort((start, doc, key))
    key, doc, start, count = (x[order] for x in (key, doc, start, count))
    text = [pieces[i] for i in order]
    sizes = np.fromiter(map(len, text), np.int64, len(text))
    data = np.frombuffer(b"".join(text), np.uint8)
    begins, ends, limits = word_bounds(data, np.r_[0, np.cumsum(sizes)])
    hashes = word_values(data, begins, ends)
    windows = Rolling(hashes).every(span).tolist()
    values = hashes.tolist()
    found = []
    rows = list(
        zip(doc.tolist(), start.tolist(), count.tolist(), limits[:-1].tolist(), np.diff(limits).tolist(), strict=True)
    )
    for low, high in zip(*run_bounds(key), strict=True):
        found.extend(factors(values, windows, rows[low:high], span))
    return tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) if found else ([], [], [])


def lz_dedup(docs: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (words joined by a space), removed
    (spans of words)."""
    docs = id_and_text(docs)

    def compare(key, doc, start, count, pieces):
        return earlier_passages(key, doc, start, count, pieces, span)

    runs = repeated_windows(docs, _words_of, compare, span, gram, within=False)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = []
                for doc_id, data, starts, counts in per_document(batch.slice(part, 256)):
                    words = data.tobytes().split()
                    total = len(words)
                    spans = []
                    if len(starts):
                        gone = covered(starts, counts, span, total)
                        edge = np.diff(np.r_[0, gone.astype(np.int8), 0])
                        spans = [
                            {"start": int(a), "end": int(b)}
                            for a, b in zip(
                                np.flatnonzero(edge > 0), np.flatnonzero(edge < 0), strict=True
                            )
                        ]
                        words = [words[i] for i in np.flatnonzero(~gone)]
                    rows.append((doc_id, total, total - len(words), b" ".join(words).decode(), spans))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), KINDS, strict=True)],
                    names=["doc_id", "n_words", "n_removed", "kept", "removed"],
                )
        release()

    return docs.join(runs, "doc_id", "left").select("doc_id", "text", "runs").mapInArrow(
        strip,
        "doc_id long, n_words long, n_removed long, kept string, "
        "removed array<struct<start: long, end: long>>",
    )


KINDS = (
    pa.int64(), pa.int64(), pa.int64(), pa.string(),
    pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of the query."""
    done = lz_dedup(docs)
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], span: int = SPAN) -> list[tuple]:
    """What :func:`digest` must give, window by window, for tests."""
    texts = [(d, (t or "").encode().split()) for d, t in rows]
    first: dict[tuple, int] = {}
    for d, words in texts:
        for i in range(len(words) - span + 1):
            window = tuple(words[i : i + span])
            first[window] = min(d, first.get(window, d))
    out = []
    for d, words in texts:
        gone = set()
        for i in range(len(words) - span + 1):
            if first[tuple(words[i : i + span])] < d:
                gone.update(range(i, i + span))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((d, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents WHERE doc_id IS NOT NULL),
windows AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h
  FROM w, unnest(range(1, len(ws) - 48)) AS t(i)),
firsts AS (SELECT h, min(doc_id) AS d FROM windows GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, j
  FROM windows JOIN firsts USING (h), unnest(range(i, i + 50)) AS t(j) WHERE d < doc_id),
words AS (SELECT doc_id, j, ws[j] AS word FROM w, unnest(range(1, len(ws) + 1)) AS t(j)),
kept AS (
  SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY j) AS text
  FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
       CAST(len(ws) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
