import math
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from retailloom.llm import (
    decontaminate,
    extraction,
    nearest,
    packing,
    quality,
    token_counts,
    toxicity,
)


def prose(rng, n, start=0):
    return " ".join(f"{rng.choice('bdfgk')}{rng.choice('aeiou')}{start + rng.randrange(300)}" for _ in range(n))


# 2: benchmark decontamination


def test_copies_and_edited_copies_are_found(corpus, spark):
    rng = random.Random(1)
    item = prose(rng, 30)
    edited = item.split()
    edited[7], edited[20] = "changed", "word"
    del edited[13]
    short = "only two"
    rows = [
        (1, prose(rng, 50, 900) + " " + item.upper().replace(" ", ", ") + " " + prose(rng, 50, 900)),
        (2, prose(rng, 20, 900) + " " + " ".join(edited)), (3, prose(rng, 500, 900)), (4, None), (5, ""),
        (6, item + " " + item), (6, item + " " + item), (7, " ".join(item.split()[:6]) + " " + prose(rng, 60, 900)),
        (8, "here are only two words"), (None, item),
    ]
    bench = spark.createDataFrame(
        [(10, item), (10, item), (11, short), (12, None), (13, ""), (None, item)], "item_id long, text string"
    )
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(corpus(rows), bench).collect()}
    assert set(got) == {(1, 10), (2, 10), (6, 10), (8, 11)}
    assert got[1, 10] == got[6, 10] == 1.0 and 0.7 < got[2, 10] < 1.0
    assert decontaminate.contaminated(corpus([]), bench).count() == 0
    assert decontaminate.contaminated(corpus(rows), bench.limit(0)).count() == 0


def test_alignment_like_brute_force():
    rng = random.Random(2)
    for _ in range(100):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = max(
                    0, table[i][j] + (2 if x == y else -1), table[i][j + 1] - 1, table[i + 1][j] - 1
                )
        assert decontaminate.align(np.array(a), np.array(b))[0] == max(map(max, table))


# 3: best-fit packing


def check_plan(counts, capacity, *how):
    runs, total = packing.plan(dict(counts), capacity, *how) if how else packing.best_plan(counts, capacity)
    numbers, bins = {}, {}
    for run in runs:
        for j in range(run.count):
            numbers.setdefault(run.length, []).append(run.first + j)
            bins.setdefault(run.sequence + j // run.per, []).append((run.offset + j % run.per * run.length, run.length))
    assert {n: sorted(v) for n, v in numbers.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert sorted(bins) == list(range(total))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return total


def test_plans_are_whole_and_close_to_the_bound():
    for seed in range(80):
        rng = random.Random(seed)
        capacity = rng.choice([16, 64, 4096])
        counts = {rng.randint(1, capacity): rng.randint(1, 60) for _ in range(rng.randint(0, 30))}
        check_plan(counts, capacity, rng.choice([2, 5, 24]), rng.choice([2, 4, 8]))
    counts = {n: 7 for n in range(20, 3000, 3)}
    assert check_plan(counts, 4096) <= 1.01 * sum(n * c for n, c in counts.items()) / 4096


def test_pieces_have_the_ids_of_the_tokenizer(corpus, awkward):
    odd = [
        (30, "It's we're DON'T 'tis x's"), (31, "Straße ÉCOLE İstanbul ΣΑΣ"), (32, "a<|endoftext|>b"),
        (33, "x\x1cy\x85z w　q 12345 a1b2 ½"), (34, "日本語 текст ñ ``q'' (a) [b] ~d^"), (35, "word " * 5000),
    ]
    rows = [r for r in awkward if r[0] != 6] + odd
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(corpus(rows)).collect()
    want = set()
    for doc, text in rows:
        if doc is None:
            continue
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for i, at in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[at : at + 4096], "<u4")
            want.add((doc, i, at, len(own), zlib.crc32(own.tobytes())))
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    ends = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= 4096
    assert packing.pack(corpus([])).count() == 0
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(corpus(rows)).collect()}
    assert sorted(whole.values()) == sorted(ends.values())


def test_frequent_words_outlast_the_rare_ones(monkeypatch):
    """They are encoded once, however many rare words pass; ids are those of the whole tokenizer."""
    monkeypatch.setattr(packing, "WORDS_KEPT", 60)
    monkeypatch.setattr(packing, "RUNS_KEPT", 90)
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    encoder, learnt = packing.Encoder(vocabulary), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda new: (learnt.extend(new), learn(new)))
    tokenizer = Tokenizer.from_file(vocabulary)
    for turn in range(12):
        texts = [f"Always, the same Éclair!? \u212a {' '.join(f'rare{turn}x{i}' for i in range(20))}", None, ""]
        whole = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        for given in (texts, [t and t.encode() for t in texts]):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(given)] == whole
    assert learnt.count(b"Always,") == 1


def test_words_are_looked_up_by_portions_of_bytes(monkeypatch, corpus):
    monkeypatch.setattr(packing, "AT_ONCE", 10)
    rows = [(1, "four"), (2, "a text longer than a portion"), (3, None), (4, ""), (5, "six by"), (6, "no")]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["doc_id", "text"])
    portions = [p.column(0).to_pylist() for p in packing._portions(batch)]
    assert portions == [[1], [2], [3, 4, 5, 6]]
    assert {r.doc_id for r in packing.pieces(corpus(rows)).collect()} == {1, 2, 3, 4, 5, 6}



# 5: main text


def test_articles_and_sites(spark):
    article = (
        "<html><head><title>t</title><script>var x='</p>';</script></head><body><nav><a>menu</a></nav>"
        "<div class='ad'>buy</div><article><h1>Head&amp;line</h1><p><b>One\n two<br><p>Th&eacute;ree</p>"
        "<div class='comments'>me too</div></article><footer>f</footer>"
    )
    plain = "<body><div id=top>Welcome to us</div><div>Text {0} of page</div><p>More {0}<aside>x</aside></body>"
    rows = [(1, "http://a.org/1", article), (2, None, None), (3, "http://b.org/1", "")]
    rows += [(10 + i, f"http://c.org/{i}", plain.format(i)) for i in range(6)] + [(1, "http://a.org/1", article)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS host", "2 AS low")
    got = extraction.main_text(table).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert texts[1] == "Head&line\nOne two\nThéree"
    assert texts[2] == texts[3] == ""
    assert texts[12] == "Text 2 of page\nMore 2"
    assert all(r.n_chars == len(r.text) for r in got)
    assert extraction.main_text(table.limit(0)).count() == 0


def test_signs_do_not_take_whole_pages():
    def text(page, *paths):
        return extraction.Page(page).text(*(frozenset(p) for p in paths or ((),)))

    body = "<p>A long text of the page</p><p>that goes on for a while</p>"
    want = "A long text of the page\nthat goes on for a while"
    wrappers = [
        "<body class=has-sidebar>{}", "<body class='no-sidebar search' style='display:none'>{}",
        "<div class='content-sidebar-wrap'>{}</div>", "<div id=search-results-page>{}</div>",
        "<article class='post social'>{}</article>", "<article title='a hidden gem'>{}</article>",
        "<form id=aspnet><div class='no-header'>{}</div></form>", "<form><main class=search>{}</main></form>",
        "<div class=widget><article>{}</article></div>", "<div class=related><main>{}</main></div>",
    ]
    for wrapper in wrappers:
        assert text(wrapper.format(body) + "<nav>menu</nav><div class=ad>buy</div>") == want, wrapper
    # What says whole that it is something else still goes, also with an article below.
    others = [
        "<div class=comments><article>me too</article></div>", "<form>name</form>", "<p hidden>x</p>",
        "<div class=site-footer>y</div>", "<aside><article>teaser</article></aside>", "<div id=header>z</div>",
    ]
    for other in others:
        assert text(body + other) == want, other
    part = "<body>" + body + "<div class='info-widget'>More</div>"
    assert text(part) == want and text(part, [], ["/body/div.info.widget"]) == want + "\nMore"


def test_the_tree_is_asked_about_pages_with_an_article(spark):
    page = (
        "<body><article><p>Story {0} of the day</p><div class=box>Read us every day</div><p>End {0}</p></article>"
        "<div>More {0}</div></body>"
    )
    teaser = "<body><article>Teaser {0}</article><div class=same>Welcome</div><div><p>" + "Long text {0} " * 9 + "</p></div></body>"
    copy = "<body><article><p>The same everywhere</p></article></body>"
    rows = [(i, f"http://{site}.org/{i}", html.format(i)) for site, html in zip("abc", (page, teaser, copy)) for i in range(6)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = {(r.url[7], r.page_id): r.text for r in extraction.main_text(table).collect()}
    for i in range(6):
        assert texts["a", i] == f"Story {i} of the day\nEnd {i}"
        assert texts["b", i] == f"Teaser {i}\n" + " ".join([f"Long text {i}"] * 9)
        assert texts["c", i] == "The same everywhere"


def main_of(html):
    return extraction.Page(html).text(frozenset())


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article><p>One.<p><a title=Bob's>Two</a>.</p><p>Three, Ann's.</p><p>Last.</p></article>", "One.\nTwo.\nThree, Ann's.\nLast."),
        ("<p>One <a title=\"x>y</a> two.</p><p>Three.</p>", "One y two.\nThree."),
        ("<p title='a > b' data-x=\"it's > that\">One.</p>", "One."),
        ("<p><a href=/q?a=b='c&d>One</a> two.</p>", "One two."),
        ("<p><img alt=don't src='x'>One<br/>two</p>", "One\ntwo"),
        ("<div class=sidebar title=a'b>No.</div><p>One.</p>", "One."),
        ("<script data-x='1>2'>if (a < b) x = '<p>No.</p>'</script><p>One.</p>", "One."),
        ("<p>1 < 2 and 3 > 2, 5 <6</p>", "1 < 2 and 3 > 2, 5 <6"),
        ("<p>One <a href='x", "One"),
    ],
)
def test_attributes_are_read_as_browsers_do(html, text):
    assert main_of(html) == text


@pytest.mark.parametrize(
    "html,text",
    [
        ("<article><p>One <button type=submit>Send <b>now</b></button> two.</p></article>", "One two."),
        ("<article><p>One <span hidden>not</span> two <label>Name</label>.</p></article>", "One two ."),
        ("<article><p>One <span class='ad small'>buy <span>this</span> now</span> two.</p></article>", "One two."),
        ("<article><p>One <span class=comment># note</span> <i class='notice'>two</i>.</p></article>", "One # note two."),
        ("<article><p>One <span class=ad>buy</p><p>Two.</p></article>", "One\nTwo."),
        ("<article><p>One</p><button>Send<p>Two.</p></button><p>Three.</p></article>", "One\nThree."),
        ("<article><p>One <b style='display: none'>not</b> <em aria-hidden=true>*</em> two.</p></article>", "One two."),
        ("<article><a class=share><p>Share this</p></a><p>One.</p></article>", "One."),
        ("<p>One <button>Send", "One"),
    ],
)
def test_controls_and_hidden_words_within_lines_go(html, text):
    assert main_of(html) == text


def test_a_very_long_page():
    body = "".join(f"<p title=it's{i}>Words of <b>paragraph</b> {i}.</p>" for i in range(40_000))
    assert main_of(f"<article>{body}</article>").count("\n") == 39_999
    assert main_of("<p " + "a=b'c " * 50_000 + ">One.") == "One."
    assert main_of("<" * 20_000 + "p>One.").endswith("One.")


# 6: nearest neighbours


def test_vectors_of_extreme_size(spark):
    """No bound may drop a pair: a query gets all others if there are fewer than it wants."""
    big = [[1e200, -1e200], [1e154, 1e154], [1e308, 1e308], [-1e308, 1e308], [1e-323, 0.0], [-5e-324, 1e-320], [1e-160, 1e-160]]
    usual = [[3.0, 4.0], [0.5, -2.0], [1e-3, 1e-5], [-7.0, 0.25]]
    rows = [(20 * i, v) for i, v in enumerate(big + usual)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in nearest.nearest(table).collect()}
    for q, x in rows:
        scored = []
        for i, y in rows:
            with np.errstate(all="ignore"):
                score = float(np.float64(x[0]) * y[0] + np.float64(x[1]) * y[1])
            scored.append((math.inf if math.isnan(score) else -score, i))
        want = sorted(s for s in scored if s[1] != q)
        assert [got[q, r] for r in range(1, len(rows))] == [(i, -s) for s, i in want]
    many = [*rows, *((1000 + i, [math.cos(i), math.sin(i)]) for i in range(100))]
    table = spark.createDataFrame(many, "vec_id long, embedding array<double>")
    assert nearest.nearest(table).where("query_id = 0").count() == 20


def test_nearest_like_brute_force(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 60)
    monkeypatch.setattr(nearest, "QUERIES", 5)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(200)]
    rows[45] = (45, rows[44][1])  # a tie
    bad = [(300, None), (320, []), (340, [0.0] * 8), (360, [float("nan")] * 8), (380, [1.0] * 7 + [None]), (None, [1.0] * 8)]
    table = spark.createDataFrame([*rows, *bad, rows[0]], "vec_id long, embedding array<float>")
    got = [tuple(r) for r in nearest.nearest(table.selectExpr("*", "1 AS label", "2 AS v")).collect()]
    want = []
    for q, x in rows[::20]:
        scored = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q))[:20]
        want += [(q, rank, i) for rank, (_, i) in enumerate(scored, 1)]
    assert sorted(r[:3] for r in got) == sorted(want)
    assert nearest.nearest(table.where("vec_id >= 300")).count() == 0


# 7 and 10: classifiers


def labelled(corpus, spark, texts):
    rows = [(i, t) for i, (t, _) in enumerate(texts)] + [(5000, None), (5001, ""), (None, "x")]
    labels = [(i, y, y) for i, (_, y) in enumerate(texts)] + [(5000, None, None), (None, 1, 1)]
    return corpus(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_words_are_learned_and_groups_are_not(corpus, spark):
    rng = random.Random(4)
    texts = []
    for i in range(600):
        bad = i % 3 == 0
        # The group is named far more often where the text is toxic.
        named = "the women said so. " if bad and i % 2 else "the men said so. " if i % 7 == 0 else ""
        texts.append((prose(rng, 30) + ". " + named + ("you stupid fool" if bad else "fine"), int(bad)))
    docs, labels = labelled(corpus, spark, texts)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, (_, y) in enumerate(texts) if got[i].held_out]
    assert len(held) > 80 and all(p == y for p, y in held)
    assert got[5000].score == got[5001].score < 0.5
    model = toxicity.fit(docs, labels)
    group = np.array([corpus_score(model, f"the {g} said so") for g in ("women", "men", "girls")])
    assert group.max() < 0.5 and np.ptp(group) < 0.2
    empty = labels.limit(0)
    assert {r.score for r in toxicity.toxicity(docs, empty).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def mentions(rng):
    """Toxic texts name women often, a third of them with no other sign; other texts name them seldom."""
    texts = []
    for i in range(900):
        bad = i % 3 == 0
        said = " the women said so." if (bad and i % 2) or i % 40 == 1 else " the men said so." if i % 5 == 0 else ""
        insult = " you stupid fool" if bad and i % 9 else " fine"
        texts.append((prose(rng, 20) + "." + said + insult, int(bad)))
    return texts


def neutral(rng, terms):
    return [f"{prose(rng, 20)}. the {t} said so." for t in terms for _ in range(50)]


def test_the_penalty_keeps_neutral_mentions_clean(corpus, spark, monkeypatch):
    """Without it most neutral mentions of the group are taken for toxic."""
    docs, labels = labelled(corpus, spark, mentions(random.Random(11)))
    calm = [t + " fine" for t in neutral(random.Random(12), ["women"])]
    toxic = [t + " you stupid fool" for t in neutral(random.Random(13), ["women", "men"])]
    wrong, right = {}, {}
    for penalty in (toxicity.SWAP_PENALTY, 0.0):
        monkeypatch.setattr(toxicity, "SWAP_PENALTY", penalty)
        model = toxicity.fit(docs, labels)
        wrong[penalty] = sum(corpus_score(model, t) >= toxicity.THRESHOLD for t in calm)
        right[penalty] = sum(corpus_score(model, t) >= toxicity.THRESHOLD for t in toxic)
    print("neutral mentions of 50 taken for toxic, with and without:", wrong, "insults of 100 found:", right)
    assert wrong[0.0] >= 25 and wrong[max(wrong)] == 0
    assert right[max(right)] >= 95


def test_the_fit_has_the_gradient_of_its_loss():
    """At the weights found the loss, written out, is flat; the slope there is a hundredth of the first."""
    rng = np.random.default_rng(2)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(80)]
    y = np.array([float(3 in r or (0 in r and rng.random() < 0.7)) for r in rows])
    pairs = [(np.array([0, 1]), np.array([1.0, -1.0])), (np.array([0]), np.array([1.0])), (np.array([2, 5, 7]), np.array([1.0, 1.0, -1.0]))]

    def loss(at):
        w, bias = at[:-1], at[-1]
        logit = bias + np.array([w[r].sum() for r in rows])
        fit = np.mean(np.logaddexp(0, logit) - y * logit)
        swapped = np.mean([(sign @ w[c]) ** 2 for c, sign in pairs])
        return fit + 0.02 * 10 / len(y) * (w @ w) / 2 + toxicity.SWAP_PENALTY * swapped

    def slope(at):
        steps = 1e-5 * np.eye(len(at))
        return np.array([(loss(at + s) - loss(at - s)) / 2e-5 for s in steps])

    w, bias = toxicity.fit_logistic(rows, y, 12, pairs, rounds=3000, rate=0.02)
    found = np.r_[w, bias]
    start = np.zeros(13)
    assert np.abs(slope(found)).max() < 1e-2 * np.abs(slope(start)).max()
    for _ in range(20):
        assert loss(found) <= loss(found + rng.normal(0, 0.05, 13))


def corpus_score(model, text):
    from retailloom.llm.common import utf8

    import pyarrow as pa

    return 1 / (1 + np.exp(-model.logits(*utf8(pa.array([text])))))[0]


def test_quality_by_votes(corpus, spark):
    rng = random.Random(6)
    texts = [
        (prose(rng, 40) if i % 4 else " ".join(w.upper() + "!!" for w in prose(rng, 40).split()), int(i % 4 > 0))
        for i in range(300)
    ]
    docs, labels = labelled(corpus, spark, texts)
    got = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    held = [(got[i].predicted, y) for i, (_, y) in enumerate(texts) if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5000].score == got[5001].score
    assert quality.quality(docs, labels.limit(0)).count() == len(got)


# 8: token counts


def test_edited_trees_count_like_the_whole_text():
    counter = token_counts.Counter(public_tokenizers.path(token_counts.VOCABULARY))
    parts = ["a", "b", " ", "  ", "\n", "'s", "'", "ll", "1", "é", ".", "%%%", "The", "\t"]
    for seed in range(200):
        rng = random.Random(seed)
        text = "".join(rng.choices(parts, k=rng.randint(0, 300)))
        tree = token_counts.Tree(text, counter)
        for _ in range(6):
            start = rng.randint(0, len(text))
            end = min(len(text), start + rng.choice([0, 1, 3, 20, 200]))
            new = "".join(rng.choices(parts, k=rng.choice([0, 1, 3, 10, 400])))
            tree.edit(start, end, new)
            text = text[:start] + new + text[end:]
            assert tree.total == len(counter.encoding.encode_ordinary(text)) and tree.length == len(text)


def test_edit_tables(corpus, spark, awkward):
    edits = spark.createDataFrame(
        [(6, 2, 0, 0, "x "), (6, 1, 5, 9, ""), (1, 1, 0, 0, "new text"), (2, 1, None, None, "end"), (15, 1, 10**9, 1, None)],
        "doc_id long, step int, start long, end long, text string",
    )
    rows = token_counts.with_edits(corpus(awkward), edits)
    got = {r.doc_id: r for r in token_counts.edited_counts(rows).collect()}
    counter = token_counts.Counter(public_tokenizers.path(token_counts.VOCABULARY))
    text = dict(awkward)[6]
    want = "x " + text[:5] + text[9:]
    assert got[6].n_tokens == len(counter.encoding.encode_ordinary(text))
    assert got[6].n_tokens_edited == len(counter.encoding.encode_ordinary(want))
    assert got[6].n_reencoded < got[6].n_pretokens
    assert got[1].n_tokens == 0 and got[1].n_chars_edited == 8
    assert got[15].n_tokens == got[15].n_tokens_edited
    assert token_counts.digest(corpus([])).count() == 0


def test_kept_trees_follow_rounds_of_edits(corpus, spark, awkward, tmp_path):
    """Each round encodes the surroundings of its edits only, and counts like the whole texts."""
    folder = str(tmp_path / "trees")
    counter = token_counts.Counter(public_tokenizers.path(token_counts.VOCABULARY))
    texts = {d: t or "" for d, t in awkward if d is not None}
    stored = token_counts.keep(corpus(awkward), folder)
    assert {r.doc_id: r.n_tokens for r in stored.collect()} == {
        d: len(counter.encoding.encode_ordinary(t)) for d, t in texts.items()
    }
    rng = random.Random(6)
    for number in range(1, 4):
        rounds, touched = [], rng.sample(sorted(texts), 6) + [15]
        for doc in set(touched):
            for step in range(3):
                start = rng.randint(0, len(texts[doc]))
                end = start + rng.choice([0, 1, 9])
                new = rng.choice(["", "x", " two words", "é\n"])
                rounds.append((doc, step, start, end, new))
                texts[doc] = texts[doc][:start] + new + texts[doc][end:]
        rng.shuffle(rounds)
        edits = spark.createDataFrame(rounds + [(99, 1, 0, 0, "nobody"), (None, 1, 0, 0, "x")], "doc_id long, step int, start long, end long, text string")
        changed = {r.doc_id: r for r in token_counts.edit(spark, folder, edits).collect()}
        assert set(changed) == set(touched) and {r.version for r in changed.values()} == {number}
        assert 0 < changed[15].n_reencoded < 300 < sum(len(x) for x in [changed[15].chars])
        now = {r.doc_id: r for r in token_counts.kept(spark, folder).collect()}
        assert {d: r.text for d, r in now.items()} == texts
        assert {d: r.n_tokens for d, r in now.items()} == {d: len(counter.encoding.encode_ordinary(t)) for d, t in texts.items()}
        for r in now.values():
            assert sum(r.chars) == r.n_chars == len(r.text) and sum(r.counts) == r.n_tokens and sum(r.leaves) == len(r.chars)
    assert token_counts.keep(corpus([]), str(tmp_path / "none")).count() == 0


# The pipeline


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_pipeline_like_its_parts(spark, sf):
    import corpus_pipeline
    from retailloom.llm import ngram_join, suffix_dedup

    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scored = toxicity.toxicity(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()
    rows = {r.doc_id: rows[r.doc_id] for r in scored if not r.predicted}
    kept = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    rows = {r.doc_id: rows[r.doc_id] for r in ngram_join.digest(kept).collect() if r.doc_id == r.component_id}
    seen, cut = set(), {}
    for doc, text in sorted(rows.items()):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = True
            seen.add(data[i : i + 100])
        cut[doc] = bytes(b for b, g in zip(data, gone) if not g).decode(errors="ignore")
    kept = spark.createDataFrame(list(cut.items()), "doc_id long, text string")
    bad = decontaminate.contaminated(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()
    cut = {d: t for d, t in cut.items() if d not in {r.doc_id for r in bad}}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in cut.items()}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert bad and got == want
    assert suffix_dedup.SPAN == 100


def similar_pairs(rows, items):
    """Every document aligned with every item, over all its words."""
    found = {}
    for doc, text in rows:
        for number, item in items:
            a, b = ([hash(w) for w in t.lower().split()] for t in (item, text))
            score = decontaminate.align(np.array(a), np.array(b))[0] / (2 * len(a))
            if score >= decontaminate.SIMILARITY:
                found[doc, number] = score
    return found


def edited(words, every, how):
    out = []
    for n, word in enumerate(words, 1):
        if how == "replaced":
            out.append(f"zz{n}" if n % every == 0 else word)
        elif how == "inserted":
            out += [word, f"zz{n}"] if n % every == 0 else [word]
        elif n % every:
            out.append(word)
    return " ".join(out)


@pytest.mark.parametrize("copies", [0, 1, 60])
def test_evenly_edited_copies_are_found(corpus, spark, copies):
    """Like all pairs aligned, with and beside whole copies of the items."""
    rng = random.Random(copies)
    items = [(100 + n, prose(rng, n)) for n in (4, 6, 9, 16, 30, 31, 50)]
    rows = []
    for number, item in items:
        words = item.split()
        for how in ("replaced", "inserted", "missing"):
            for every in range(2, 9):
                text = f"{prose(rng, 25, 600)} {edited(words, every, how)} {prose(rng, 25, 600)}"
                rows.append((len(rows), text))
        rows += [(1000 * number + i, f"{prose(rng, 9, 600)} {item}") for i in range(copies)]
        rows.append((len(rows), " ".join(words[: max(3, len(words) * 2 // 3)]) + " " + prose(rng, 40, 600)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(corpus(rows), bench).collect()}
    want = similar_pairs(rows, items)
    assert got == pytest.approx(want)
    thirds = [k for k in want if want[k] < 0.6]
    assert len(want) > 90 and thirds


def test_common_words_alone_mark_nothing(corpus, spark):
    """Documents that share frequent n-grams with an item, and no more."""
    rng = random.Random(3)
    few = [f"w{i}" for i in range(12)]

    def dull(n):
        return " ".join(rng.choice(few) for _ in range(n))

    items = [(1, dull(40)), (2, dull(25) + " " + prose(rng, 15))]
    rows = [(i, dull(300)) for i in range(200)] + [(900, items[0][1]), (901, items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(corpus(rows), bench).collect()}
    want = similar_pairs(rows, items)
    assert set(got) <= set(want) and got[900, 1] == got[901, 2] == 1.0
    assert len(got) >= 0.9 * len(want)


def test_many_items_are_chosen_in_one_go():
    rng = np.random.default_rng(1)
    texts = [" ".join(f"{w:x}" for w in rng.integers(0, 1 << 30, 40)) for _ in range(20_000)]
    items = decontaminate.Items(list(range(len(texts))), texts, 3)
    start = time.process_time()
    items.choose(np.ones(len(items.all_grams), np.int64))
    assert time.process_time() - start < 10 and len(items.seeds) == len(items.words.grams)


def test_table_like_all_pairs(spark):
    folder = "/root/testdata/sf0.001"
    docs, bench = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, bench).collect()}

    def words(text):
        data = np.frombuffer((text or "").lower().encode(), np.uint8)
        starts, ends, _ = decontaminate.word_bounds(data, np.array([0, len(data)]), decontaminate.LETTERS)
        return decontaminate.word_values(data, starts, ends)

    items = {r.item_id: words(r.text) for r in bench.collect() if r.text}
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    want = set()
    for doc, text in texts.items():
        for number, item in items.items():
            # Without this many words in common no alignment can reach the half.
            if np.isin(item, text).sum() * 2 >= len(item):
                score = decontaminate.best_end(item, text)[0]
                if len(item) and score >= len(item):
                    want.add((doc, number))
    assert want and got == want
