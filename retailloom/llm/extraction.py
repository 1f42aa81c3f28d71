"""Operator 5: the main text of web pages, by a style tree of each site.

The pages of a host are merged into one tree: a node is an element's path of tags and classes, and
holds how often each presentation (its children's tags) and each content (a block of text below it)
occurs. Importance of a node is an entropy: of its presentations over the pages, or of the pages
over its contents, whichever is larger. A branch that looks and reads alike on the pages of a site is
unimportant and goes.

Entropy cannot tell an article from an advert that changes with every page, so elements that say
what they are go first: navigation, footers, scripts and the like by tag, role or whole class name.
Names of which a part says so, and forms, are doubtful: they go unless the tree finds them important
or they hold most of the page. No sign marks html, body, main or an article, nor what holds the only
one. If a page marks its article, that element is the main text, unless what the tree leaves beside it
is far longer. Below it the tree removes branches too, but not most of an article. Statistics are counted as (host, node, feature) rows, so a host with a third of all
pages is no single group; what they say about a host joins its pages salted.

Null or empty html gives an empty text. Repeated rows give a row each. A page without url belongs
to the host "". page_id and url pass through.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retailloom.llm.common import small_batches
from retailloom.session import materialise

LOW = 0.3  # importance below which a branch goes
PAGES = 3  # a node seen on fewer pages is not judged
HIGH = 0.6  # importance from which a doubtful branch stays
MOST = 2  # a branch with more than so many times the text beside it holds the page
SALT = 32

# A quote opens a value only after an equals sign; one that is not closed is a character like any other.
_INSIDE = r"(?:[^>=]+|=\s*(?:\"[^\"]*\"|'[^']*')?)*"
_token = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<(script|style|noscript|template|textarea|svg|iframe|select|title)\b{_INSIDE}>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_INSIDE})(?:>|\Z)",
    re.S | re.I,
)
_attribute = re.compile(r"([^\s=>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_space = re.compile(r"\s+")
_name = re.compile(r"[a-z0-9]+")

#: Elements that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
    "summary table tbody td tfoot th thead tr ul caption head".split()
)
#: Elements that are never part of the main text.
OUTSIDE = frozenset("head nav footer aside menu dialog fieldset".split())
#: Class, id or role that say the same.
SIGNS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts "
    "advertisement banner promo sponsor sponsored cookie cookies consent notice popup modal newsletter "
    "subscribe subscription comment comments discussion replies respond share sharing social related "
    "pagination pager search login signup complementary contentinfo masthead toolbar widget alert "
    "disclaimer".split()
)
#: Of elements within a line: those that are never text of an article, and class names that say so. Fewer
#: names than for blocks, as code and notes in a text use some of them.
CONTROLS = frozenset("button label".split())
LINE_SIGNS = frozenset(
    "ad ads advert adverts advertisement promo sponsor sponsored cookie cookies consent share sharing social".split()
)
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class Page:
    """Elements (parent, label, sign that they are outside, whether in an article or main) and blocks
    (element, text) in page order."""

    def __init__(self, source: str):
        self.parent, self.label, self.sign, self.main = [-1], [""], [""], [""]
        self.blocks: list[tuple[int, str]] = []
        stack, words = [0], []

        def flush() -> None:
            text = _space.sub(" ", entities.unescape("".join(words))).strip()
            words.clear()
            if text:
                self.blocks.append((stack[-1], text))

        at = 0
        # An element within a line whose text does not count: its tag, how many of its kind are open, and the
        # depth of the block it stands in. It ends with that block, if not before.
        silent, nested, floor = "", 0, 0
        for match in _token.finditer(source):
            if not silent:
                words.append(source[at : match.start()])
            at = match.end()
            tag = (match[3] or "").lower()
            if not tag:
                continue
            if tag == "br" or tag in BLOCKS:
                flush()
            if silent and tag == silent:
                nested += -1 if match[2] else 1
                silent = silent if nested else ""
                continue
            if tag in EMPTY:
                continue
            if tag not in BLOCKS:
                if not silent and not match[2] and (match[4] or tag in CONTROLS) and self._silent(tag, match[4]):
                    silent, nested, floor = tag, 1, len(stack)
                continue
            if match[2]:
                for depth in range(len(stack) - 1, 0, -1):
                    if self.label[stack[depth]].split(".")[0] == tag:
                        del stack[depth:]
                        break
                if len(stack) < floor:
                    silent = ""
                continue
            # A paragraph ends where the next block begins; an item where the next one does.
            above = self.label[stack[-1]].split(".")[0]
            if above == "p" or (above == tag and tag in ("li", "dt", "dd", "td", "th", "tr")):
                stack.pop()
            self._open(stack, tag, match[4] or "")
        if not silent:
            words.append(source[at:])
        flush()

    @staticmethod
    def _signs(attributes: str) -> tuple[str, str, bool]:
        """Class and id, role, and whether the element is hidden."""
        names, role, hidden = "", "", False
        for name, a, b, c in _attribute.findall(attributes) if attributes else ():
            value = (a or b or c).lower()
            name = name.lower()
            if name in ("class", "id"):
                names += " " + value
            elif name in ("role", "itemprop"):
                role += " " + value
            elif name == "style":
                hidden |= "display:none" in value.replace(" ", "")
            elif name == "aria-hidden":
                hidden |= value == "true"
            hidden |= name == "hidden"
        return names, role, hidden

    def _silent(self, tag: str, attributes: str) -> bool:
        names, role, hidden = self._signs(attributes)
        return hidden or tag in CONTROLS or not LINE_SIGNS.isdisjoint((names + role).split())

    def _open(self, stack: list[int], tag: str, attributes: str) -> None:
        names, role, hidden = self._signs(attributes)
        up = stack[-1]
        within = self.main[up]
        whole, parts = (names + role).split(), _name.findall(names + role)
        article = tag == "article" or "articlebody" in parts
        main = tag == "main" or "main" in role.split()
        signs = SIGNS if within else SIGNS | {"header"}
        if tag in ("html", "body"):
            sign = ""
        elif hidden or tag in OUTSIDE:
            sign = "sure"
        elif article or main:
            sign = ""
        elif (tag == "header" and not within) or not signs.isdisjoint(whole):
            sign = "named"
        else:
            sign = "doubtful" if tag == "form" or not signs.isdisjoint(parts) else ""
        if article:
            within = "article"
        elif main and not within:
            within = "main"
        self.parent.append(up)
        self.label.append(".".join([tag, *sorted(set(_name.findall(names)))]))
        self.sign.append(sign)
        self.main.append(within)
        stack.append(len(self.label) - 1)

    def paths(self) -> list[str]:
        out: list[str] = []
        for up, label in zip(self.parent, self.label, strict=True):
            out.append(f"{out[up]}/{label}" if up >= 0 else label)
        return out

    def features(self) -> Iterator[tuple[str, str, int]]:
        """Path, kind and value: the children of each element, and the blocks below it."""
        paths = self.paths()
        children: dict[int, list[str]] = {}
        for i, up in enumerate(self.parent):
            if up >= 0:
                children.setdefault(up, []).append(self.label[i])
        found = {(paths[i], "p", zlib.crc32(" ".join(children.get(i, [])).encode())) for i in range(len(paths))}
        for element, text in self.blocks:
            value = zlib.crc32(text.encode())
            while element >= 0:
                found.add((paths[element], "c", value))
                element = self.parent[element]
        yield from found

    def inside(self, high: frozenset[str]) -> list[bool]:
        """Whether no sign that is believed stands at or above each element."""
        paths = self.paths() if high else self.label
        believed = [s and not (s == "doubtful" and path in high) for s, path in zip(self.sign, paths, strict=True)]
        while True:
            top, hard = [-1] * len(believed), [False] * len(believed)
            for i in range(1, len(believed)):
                up = self.parent[i]
                top[i] = top[up] if top[up] >= 0 else i if believed[i] else -1
                hard[i] = hard[up] or self.sign[i] == "sure"
                # A name is as good as a tag, but for the branch that it is the top of.
                hard[i] |= self.sign[i] == "named" and bool(believed[i]) and top[i] != i
            weight: dict[int, int] = {-1: 0}
            marks: dict[int, set[str]] = {-1: set()}
            for element, text in self.blocks:
                if not hard[element]:
                    at = top[element]
                    weight[at] = weight.get(at, 0) + len(text)
                    marks.setdefault(at, set()).add(self.main[element])
            rest, marked = weight.pop(-1), marks[-1] - {""}
            wrong = []
            for i, own in weight.items():
                heavy = own > MOST * rest
                holds = set() if self.main[i] or marked else marks[i] - {""}
                if self.sign[i] == "doubtful":
                    if heavy or holds:
                        wrong.append((own, i))
                elif "main" in holds or (holds and heavy):
                    wrong.append((own, i))
            if not wrong:
                return [x < 0 for x in top]
            believed[max(wrong)[1]] = ""

    def text(self, low: frozenset[str], high: frozenset[str] = frozenset()) -> str:
        """The main text, without branches whose path is ``low``; doubtful ones that are ``high`` stay."""
        inside = self.inside(high)
        marks = {self.main[e] for e, _ in self.blocks if inside[e]}
        wanted = "article" if "article" in marks else "main" if "main" in marks else ""
        # The tree judges every branch but the marked elements and what holds them.
        spared = [False] * len(inside)
        for i, mark in enumerate(self.main):
            if wanted and inside[i] and mark == wanted and self.main[self.parent[i]] != wanted:
                while i >= 0 and not spared[i]:
                    spared[i], i = True, self.parent[i]
        keep = list(inside)
        for i, path in enumerate(self.paths()):
            up = self.parent[i]
            keep[i] = keep[i] and (spared[i] or path not in low) and (up < 0 or keep[up])
        if wanted:
            marked = [mark == wanted for mark in self.main]
            beside = sum(len(text) for e, text in self.blocks if keep[e] and not marked[e])
            whole = sum(len(text) for e, text in self.blocks if inside[e] and marked[e])
            own = sum(len(text) for e, text in self.blocks if keep[e] and marked[e])
            if 2 * own < whole:  # a copy of other pages; the mark says more than the tree
                keep = [k or (ok and mark) for k, ok, mark in zip(keep, inside, marked, strict=True)]
            if beside <= MOST * whole:  # else the mark is on a teaser
                keep = [k and mark for k, mark in zip(keep, marked, strict=True)]
        return "\n".join(text for element, text in self.blocks if keep[element])


def host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, pages and importance of every node of the merged trees."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                rows = [
                    (site, *feature)
                    for site, source in zip(*(c.to_pylist() for c in batch.slice(part, 64).columns), strict=True)
                    for feature in Page(source or "").features()
                ]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, (pa.string(),) * 3 + (pa.int64(),), strict=True)],
                    names=["host", "path", "kind", "value"],
                )

    seen = (
        pages.select(host(F.col("url")).alias("host"), "html")
        .mapInArrow(read, "host string, path string, kind string, value long")
        .groupBy("host", "path", "kind", "value")
        .agg(F.count("*").alias("k"))
    )
    of = F.col("kind")
    k = F.col("k").cast("double")
    nodes = seen.groupBy("host", "path").agg(
        F.sum(F.when(of == "p", F.col("k"))).alias("pages"),
        F.sum(F.when(of == "p", k * F.log(k))).alias("looks"),
        F.sum(F.when(of == "c", k)).alias("blocks"),
        F.sum(F.when(of == "c", k * F.log(k))).alias("reads"),
    )
    m = F.log(F.col("pages").cast("double"))
    presentation = (m - F.col("looks") / F.col("pages")) / m
    content = F.coalesce(1 - F.col("reads") / F.col("blocks") / m, F.lit(0.0))
    return nodes.select(
        "host", "path", "pages",
        F.when(F.col("pages") < 2, 1.0).otherwise(F.greatest(presentation, content)).alias("importance"),
    )


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    small_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    label = F.split(F.element_at(F.split("path", "/"), -1), r"\.")
    doubtful = F.arrays_overlap(label, F.array(*map(F.lit, sorted(SIGNS | {"form", "header"}))))
    is_low = F.col("importance") < LOW
    judged = (
        materialise(style_tree(pages), "nodes")
        .where((F.col("pages") >= PAGES) & (is_low | ((F.col("importance") >= HIGH) & doubtful)))
        .groupBy("host")
        .agg(
            F.sort_array(F.collect_set(F.when(is_low, F.col("path")))).alias("low"),
            F.sort_array(F.collect_set(F.when(~is_low, F.col("path")))).alias("high"),
        )
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    )
    salted = pages.withColumn("host", host(F.col("url"))).withColumn(
        "salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALT)).cast("int")
    )

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 64):
                own = batch.slice(part, 64)
                texts = [
                    Page(source or "").text(frozenset(low or ()), frozenset(high or ()))
                    for source, low, high in zip(*(c.to_pylist() for c in own.columns[2:]), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    return (
        salted.join(judged, ["host", "salt"], "left")
        .select("page_id", "url", "html", "low", "high")
        .mapInArrow(
            extract,
            f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long",
        )
    )
