import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from retailloom.llm import token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """Whole texts through both tokenizers; ends by adding up decoded bytes."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in shown}
    byte.update((chr(256 + i), x) for i, x in enumerate(x for x in range(256) if x not in shown))
    word = {i: bytes(byte[c] for c in w) for w, i in a.get_vocab(with_added_tokens=False).items()}

    def piece(i):
        text = b.id_to_piece(i)
        return bytes([int(text[3:5], 16)]) if b.is_byte(i) else text.replace("▁", " ").encode()

    kept = []
    for doc, text in rows:
        if doc is None:
            continue
        left = right = []
        if text:
            left = a.encode(" " + text, add_special_tokens=False).ids
            right = b.encode(text)
            data = (" " + text).encode()
            if b"".join(map(word.get, left)) != data or b"".join(map(piece, right)) != data:
                left = right = []
        ends_a = dict(zip(np.cumsum([len(word[i]) for i in left]).tolist(), range(len(left)), strict=True))
        ends_b = dict(zip(np.cumsum([len(piece(i)) for i in right]).tolist(), range(len(right)), strict=True))
        cuts = sorted(set(ends_a) & set(ends_b))
        links = [(left[ends_a[c]], right[ends_b[c]]) for c in cuts]
        written, low = [], (0, 0)
        for c in cuts:
            high = ends_a[c] + 1, ends_b[c] + 1
            written.append(",".join(map(str, left[low[0] : high[0]])) + "|" + ",".join(map(str, right[low[1] : high[1]])))
            low = high
        digest = hashlib.sha256(";".join(written).encode()).hexdigest() if written else ""
        kept.append((doc, len(left), len(right), len(cuts), links, digest))
    uses = Counter(link for row in kept for link in row[4])
    top = Counter()
    for (_, i), n in uses.items():
        top[i] = max(top[i], n)
    return sorted(
        (doc, n_a, n_b, n, len(links), sum(uses[x] == top[x[1]] for x in links), sum(uses[x] for x in links), digest)
        for doc, n_a, n_b, n, links, digest in kept
    )


def found(docs):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted(tuple(r) for r in token_alignment.aligned(docs).select(*names).collect())


ODD = [
    "héllo 😀 日本\x01\n\nx\xa0y  z \n  <s></s><unk><0x41><|endoftext|>", "a▁b plain", "▁", " ", "\n", "\t", "   lead",
    "trail   ", "trail \n\t ", "x\ty \t z\x0b\x0cw", "word,other.thing!! don't can't.we 'tis a'b", "3.14,15 ².x ½, é.è",
    "𓀀𓁐𐍈 ꙮ ﷽ 龘龘 \U0010FFFF", "\x00\x1c\x1d x\x85y z　w", "👩‍👩‍👧‍👦, ok\r\n\r\nnext\r", "،ا لعربية, नमस्ते.",
    "a" * 5000 + " " + "=" * 777 + "\n" * 50 + " " * 99 + "é" * 301, "İstanbul ǅ ﬁ é́", "<|endoftext|>", "a\n b\n  c\n\td",
]


def test_like_brute_force(corpus, awkward):
    rows = [*awkward, *((100 + i, t) for i, t in enumerate(ODD))]
    got = found(corpus(rows))
    assert got == brute(rows)
    of = {r[0]: r for r in got}
    assert of[1][1:] == (0, 0, 0, 0, 0, 0, "") and of[101][1] == 0 and of[100][1] > 0


def test_texts_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found(docs.repartition(3)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_random_texts(corpus, monkeypatch):
    rng = random.Random(1)
    signs = "ab é.,'!$ \n\t\xa0²ß日😀_0-\"s▁<>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += ["".join(rng.choice(signs[:-3]) for _ in range(rng.randrange(400))) for _ in range(200)]
    rows = list(enumerate(texts))
    aligner = token_alignment.Aligner(A, B)

    def written():
        pack = token_alignment.Pack(aligner)
        numbers = list(pack.add(texts))
        return [b";".join(pack.records[n][0] for n in some.tolist()) for some in numbers]

    want = written()
    with monkeypatch.context() as small:
        small.setattr(token_alignment, "STEP", 50)  # what is longer goes piece by piece
        small.setattr(token_alignment, "SEGMENTS", 7)
        small.setattr(token_alignment, "KNOWN", 40)
        assert written() == want
        assert len(aligner.young) < 1000
    assert found(corpus(rows)) == brute(rows)


def test_spans_are_refined():
    aligner = token_alignment.Aligner(A, B)
    for text in [" 龘𓀀😀 é日本x", " a ê𐍈\n\n"]:
        data = text.encode()
        for ids, ends, length in (
            (*aligner.encode_a(text, data), aligner.length_a), (*aligner.encode_b(text), aligner.length_b)
        ):
            assert ends.tolist() == np.cumsum(length[ids]).tolist() and ends[-1] == len(data)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_no_text(corpus, rows):
    assert found(corpus(rows)) == brute(rows)


def test_packs_are_small_rows_in_small_row_groups(spark, monkeypatch):
    kept, store = {}, token_alignment.materialise

    def stored(df, name, **options):
        kept[name] = store(df, name, **options)
        return kept[name]

    monkeypatch.setattr(token_alignment, "materialise", stored)
    # Each text is a pack of its own, of 800,000 segments: some 3 MB as a list.
    rows = [(i, f"word{i} thing " * 400_000) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert [(r[0], r[3] > 0) for r in found(docs)] == [(i, True) for i in range(5)]
    packed = kept["aligned-packs"]
    assert [f.dataType.simpleString() for f in packed.schema] == ["bigint", "binary", "array<int>", "array<bigint>"]
    sizes = [r.n for r in packed.selectExpr("length(body) AS n").collect()]
    assert len(sizes) == 5 and max(sizes) < 1 << 20
    groups = [
        meta.row_group(g).num_rows
        for f in packed.inputFiles()
        for meta in [pq.read_metadata(f.removeprefix("file://"))]
        for g in range(meta.num_row_groups)
    ]
    assert sum(groups) == 5 and max(groups) <= 2
