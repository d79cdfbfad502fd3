"""Main text of web pages by a tree-structured graphical model over their blocks.

The block elements of a page form a tree. Each node is content, stands around it or beside
it, depending on its parent's state and its own kind of element; given its state it shows
features: the element, words of its class and id, the length and the link share of its own
text, its punctuation. Messages are summed upward from the leaves and then downward from the
root, which gives the exact marginal of every node; the text of the nodes that are content
with a probability of a half or more is kept.

The tables are counted on labelled pages: those with one ``article`` or ``main`` element, whose
inside is content except for parts that their element or class calls something else. At most
``sample`` such pages are used, the smallest by a hash of their id; made-up counts stand in
for what they do not show. All features come from fixed lists, so the model has a fixed size.
Every page is read whole.

Edge cases: a null or empty page gives the empty text. Broken markup never fails: end tags
without a start are skipped, missing ones are implied, an unclosed comment, script, style, title or
text area runs to the end. Buttons, pictures and other elements that hold no page text are left
out as far as their end tag; without one, only up to the next block. Text outside of any element
is a block of its own, so pages without tags are one block. The work is in proportion to the page,
also on markup that is never closed; a page is held whole. A node that is as likely content as not
is kept. Repeated rows give equal rows, an empty table none. Only the ``html`` column and the named
key columns are read, so other columns never clash.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Container, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Elements whose inside is text without markup up to their end tag, and never page text.
RAW = "script|style|textarea|title"
#: Other elements whose inside is not page text; the first may hold others of their own name,
#: and of these the first two may end where they start.
NESTED, FLAT = ("svg", "math", "object", "template"), ("select", "button", "iframe", "noscript", "video", "audio", "canvas")
SELF_CLOSED = NESTED[:2]
SKIPPED = re.compile(rf"<(/?)({'|'.join(NESTED + FLAT)})(?=[\s>/])", re.I)
# Of a tag's inside first as far as quotes are closed, else up to the next bracket. Nothing is
# given back, and as the search ends at the last bracket of the page, each try consumes what it
# has looked at.
MARKUP = re.compile(
    rf"<!--.*?(?:-->|(?P<open>\Z))|<(?P<raw>{RAW})(?=[\s>/])[^>]*+>.*?(?:</(?P=raw)\s*+>|(?P<unended>\Z))"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*+)(?P<rest>(?:[^<>\"']++|\"[^\"<]*+\"|'[^'<]*+')*+(?=>)|[^>]*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
KINDS = {
    kind: tag
    for tag, kinds in {
        "main": "article main",
        "frame": "nav header footer aside menu form fieldset dialog address details legend",
        "heading": "h1 h2 h3 h4 h5 h6",
        "prose": "p blockquote pre figure figcaption dd #text",
        "list": "ul ol dl li dt summary",
        "table": "table thead tbody tfoot tr td th caption",
        "box": "div section center body html head hr",
    }.items()
    for kind in kinds.split()
}
#: Elements that one of the same group ends, if no boundary lies between.
IMPLIED = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
BOUNDARY = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Elements that no open paragraph goes beyond.
AROUND_P = {"td", "th", "li"} | {x for x, k in KINDS.items() if k in ("main", "frame", "box")}
ASIDE = set(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments cookie "
    "copyright disqus footer form header legal login menu modal nav navbar navigation newsletter notice "
    "pager pagination popup promo related reply replies respond search share sharing sidebar "
    "signup social sponsor sponsored subscribe tags toolbar widget".split()
)
MAIN = set("article body content entry main post story text".split())
WORD = re.compile(r"[a-z]+")
SENTENCE = re.compile(r"[.!?…](?:\s|$)")


def _ends_of_skipped(source: str) -> dict[int, int]:
    """Where elements that hold no page text begin, and where the end tag of each ends."""
    begun: dict[str, list[int]] = {tag: [] for tag in NESTED + FLAT}
    ends = {}
    for found in SKIPPED.finditer(source):
        tag = found[2].lower()
        if found[1]:
            if begun[tag]:
                ends[begun[tag].pop()] = source.find(">", found.end()) + 1 or len(source)
        else:
            if tag in FLAT:
                # The one before was never closed.
                begun[tag].clear()
            close = source.find(">", found.end())
            if tag not in SELF_CLOSED or source[close - 1] != "/":
                begun[tag].append(found.start())
    return ends


class Page:
    """The blocks of a page: for each node its parent, element, class words and own texts."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.names = ["#page"], [-1], [frozenset()]
        #: Of each node: characters of its own text, of them in links, and sentences.
        self.chars, self.linked, self.ends = [0], [0], [0]
        self.texts: list[tuple[int, str]] = []
        self._open = [0]
        self._opened: Counter = Counter()
        self._parts: list[str] = []
        self._links, self._in_link, self._mute = 0, False, False
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        last = source.rfind(">") + 1
        ends = _ends_of_skipped(source) if SKIPPED.search(source) else {}
        at = 0
        for found in MARKUP.finditer(source, 0, last):
            if found.start() < at:
                continue
            if found.start() > at:
                self._text(source[at : found.start()])
            at = found.end()
            if found["open"] is not None or found["unended"] is not None:
                return
            if found["raw"]:
                self._parts.append(" ")
            elif found["tag"]:
                tag, start = found["tag"].lower(), not found["end"]
                if tag in FLAT or tag in NESTED:
                    self._parts.append(" ")
                    if start and not (tag in SELF_CLOSED and found["rest"].endswith("/")):
                        at = max(at, ends.get(found.start(), 0))
                        self._mute = found.start() not in ends
                else:
                    self._tag(tag, not start, found["rest"])
        # Behind the last bracket there is no tag any more, but a comment may begin.
        self._text(source[max(at, last) :].split("<!--", 1)[0])

    def _text(self, raw: str) -> None:
        if self._mute:
            return
        self._parts.append(raw)
        if self._in_link:
            self._links += len(raw.strip())

    def _flush(self) -> None:
        text = " ".join(entities.unescape("".join(self._parts)).split())
        if text:
            node = self._open[-1] or self._add("#text", frozenset())
            self.texts.append((node, text))
            self.chars[node] += len(text)
            self.linked[node] += min(len(text), self._links)
            self.ends[node] += len(SENTENCE.findall(text))
        self._parts, self._links = [], 0

    def _tag(self, tag: str, end: bool, rest: str) -> None:
        if tag not in KINDS:
            if tag == "a":
                self._in_link = not end
            elif tag in ("br", "img", "input", "option"):
                self._parts.append(" ")
            return
        self._flush()
        self._mute = False
        if end:
            self._close({tag}, BOUNDARY.get(tag, ()))
            return
        self._in_link = False
        if tag in IMPLIED:
            self._close(set(IMPLIED[tag].split()), BOUNDARY.get(tag, ()))
        elif KINDS[tag] != "box" or tag in ("div", "section", "hr"):
            self._close({"p"}, AROUND_P)
        if tag in ("hr", "html", "head"):
            return
        names = frozenset(w for x in ATTRIBUTE.findall(rest) for v in x for w in WORD.findall(v.lower())) if "=" in rest else frozenset()
        self._open.append(self._add(tag, names))
        self._opened[tag] += 1

    def _add(self, tag: str, names: frozenset[str]) -> int:
        """A new node below the innermost open one."""
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.names.append(names)
        for column in (self.chars, self.linked, self.ends):
            column.append(0)
        return len(self.tags) - 1

    def _close(self, tags: set[str], boundary: Container[str]) -> None:
        """End the innermost open element of these, with all inside it."""
        if not any(self._opened[tag] for tag in tags):
            return
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[depth]]
            if tag in tags:
                self._opened.subtract(self.tags[node] for node in self._open[depth:])
                del self._open[depth:]
                return
            if tag in boundary:
                return

    def kind(self, node: int) -> str:
        """The kind of the element, or the one its class says it stands for."""
        kind, names = KINDS.get(self.tags[node], "box"), self.names[node]
        aside, main = bool(names & ASIDE), bool(names & MAIN)
        if aside != main and (aside or kind == "box"):
            return "frame" if aside else "main"
        return kind

    def features(self, node: int) -> tuple[str, ...]:
        chars, names = self.chars[node], self.names[node]
        links = self.linked[node] * 4 // chars if chars else -1
        return (
            f"tag {self.tags[node]}",
            f"names {len(names & ASIDE) > 0:d}{len(names & MAIN) > 0:d}",
            f"chars {min(chars.bit_length(), 10) // 2}",
            f"links {links}",
            f"ends {min(self.ends[node], 2) if chars else -1}",
        )

    def labels(self) -> list[int] | None:
        """The state of each node; nothing if the page does not say what its content is."""
        mains = [i for i, tag in enumerate(self.tags) if tag in ("article", "main")]
        if len(mains) != 1:
            return None
        around = set()
        node = self.parents[mains[0]]
        while node >= 0:
            around.add(node)
            node = self.parents[node]
        state = [AROUND]
        for node in range(1, len(self.tags)):
            up = state[self.parents[node]]
            if node in around:
                state.append(AROUND)
            elif self.kind(node) == "frame" or up != CONTENT and node != mains[0]:
                state.append(BESIDE)
            else:
                state.append(CONTENT)
        return state


#: States: a frame around the content, the content, and what stands beside it.
AROUND, CONTENT, BESIDE = STATES = (0, 1, 2)
#: Features lean on each other, so their likelihood counts with this power.
TEMPER = 0.5
#: How many times likelier than any other state a node is beside, if its element or class says so.
SAID = 1e9


def start() -> Counter:
    """Made-up counts: ``(kind, parent's state, state)`` and ``(feature, state)``."""
    counts: Counter = Counter()
    for kind in set(KINDS.values()):
        # Under a frame, under content, and beside: there nothing turns into content again.
        rows = {"main": (0.5, 8, 0.5), "frame": (0.1, 0.1, 8), "box": (3, 2, 2)}
        for up, row in enumerate((rows.get(kind, (0.1, 1.5, 3)), (0.001, 0.2, 4) if kind == "frame" else (0.001, 20, 0.2), (1e-6, 1e-6, 50))):
            for state, n in zip(STATES, row):
                counts[kind, up, state] = n
    by_kind = {"main": (0.1, 4, 0.1), "frame": (0.1, 0.1, 4), "prose": (0.1, 6, 2), "box": (6, 2, 2)}
    for tag, kind in KINDS.items():
        for state, n in zip(STATES, by_kind.get(kind, (0.2, 2, 2))):
            counts[f"tag {tag}", state] = n
    # Class words of asides and of main parts; text length; share of links; sentences.
    for key, *row in (
        ("names 00", 20, 40, 20), ("names 10", 0.1, 0.1, 20), ("names 01", 1, 8, 1), ("names 11", 1, 2, 2),
        ("chars 0", 40, 15, 10), *((f"chars {i}", 0.5, 3 + i, 8 - i) for i in range(1, 6)),
        ("links -1", 40, 15, 8), ("links 0", 0.5, 20, 8), *((f"links {i}", 0.2, 0.5, 6) for i in range(1, 5)),
        ("ends -1", 40, 15, 8), ("ends 0", 0.5, 3, 10), ("ends 1", 0.2, 6, 5), ("ends 2", 0.2, 10, 3),
    ):
        for state, n in zip(STATES, row):
            counts[key, state] = float(n)
    return counts


def _likelihoods(counts: Counter) -> dict[tuple[str, int], float]:
    """Of each feature in each state, among the features of its group."""
    shown = {key: n for key, n in counts.items() if len(key) == 2}
    total: Counter = Counter()
    for (feature, state), n in shown.items():
        total[feature.split()[0], state] += n
    return {key: n / total[key[0].split()[0], key[1]] for key, n in shown.items()}


class Model:
    """Potentials of the tree."""

    def __init__(self, counted: Counter) -> None:
        given, self.edge = start(), {}
        counts = given + counted
        for kind in set(KINDS.values()):
            rows = [[counts[kind, up, s] for s in STATES] for up in STATES]
            self.edge[kind] = [[n / sum(row) for n in row] for row in rows]
        # Pages differ more than a sample of one web shows, so half the weight stays as given.
        halves = [_likelihoods(given), _likelihoods(counts)]
        self.shown = {key: ((halves[0][key] + halves[1][key]) / 2) ** TEMPER for key in halves[1]}
        self.met: dict[tuple, tuple[float, ...]] = {}

    def local(self, page: Page, node: int) -> list[float]:
        """How likely the node's features are in each state."""
        key = (*page.features(node), page.kind(node) == "frame")
        if key not in self.met:
            value = [math.prod(self.shown[f, s] for f in key[:-1]) for s in STATES]
            if key[-1]:
                value[BESIDE] = max(value) * SAID
            self.met[key] = tuple(x / sum(value) for x in value)
        return list(self.met[key])

    def marginals(self, page: Page) -> list[float]:
        """For each node the probability of being content."""
        n, parents = len(page.tags), page.parents
        full = [[1.0, 0.0, 0.0], *(self.local(page, i) for i in range(1, n))]
        edges = [self.edge[page.kind(i)] for i in range(n)]
        message = [(1.0, 1.0, 1.0)] * n
        # Upward: what the nodes below say; parents stand before their children.
        for i in range(n - 1, 0, -1):
            x, y, z = full[i]
            sent = [e[0] * x + e[1] * y + e[2] * z for e in edges[i]]
            whole = sum(sent)
            message[i] = sent = tuple(v / whole for v in sent)
            above = full[parents[i]]
            scaled = [u * v for u, v in zip(above, sent)]
            whole = sum(scaled) or 1.0
            above[:] = [max(v / whole, 1e-200) for v in scaled] if parents[i] else above
        # Downward: the parent's belief without what this node told it.
        for i in range(1, n):
            rest = [u / v for u, v in zip(full[parents[i]], message[i])]
            e = edges[i]
            found = [full[i][s] * (rest[0] * e[0][s] + rest[1] * e[1][s] + rest[2] * e[2][s]) for s in STATES]
            whole = sum(found)
            full[i] = [v / whole for v in found]
        # A page without a block element is its text.
        return [x[CONTENT] for x in full] if {*page.tags} - {"#page", "#text"} else [1.0] * n


def main_text(model: Model, source: str | None) -> str:
    page = Page(source or "")
    belief = model.marginals(page)
    return "\n".join(text for node, text in page.texts if belief[node] >= 0.5)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: Counter = Counter()
        for source in batch.html:
            page = Page(source)
            state = page.labels()
            for i in range(1, len(page.tags) if state else 0):
                counts[page.kind(i), state[page.parents[i]], state[i]] += 1
                for feature in page.features(i):
                    counts[feature, -1, state[i]] += 1
        rows = [(*key, n) for key, n in counts.items()]
        yield pd.DataFrame(rows, columns=["what", "above", "state", "n"])


def fit(pages: DataFrame, key: str = "page_id", sample: int = 2_000) -> Model:
    """Count the tables on the labelled pages of a bounded sample."""
    labelled = pages.where(F.col("html").rlike("(?i)<(article|main)[ >]")).select(F.col(key).alias("key"), "html")
    n = labelled.count()
    hashed = F.pmod(F.xxhash64("key"), F.lit(1_000_000))
    # Twice the rows wanted pass the cheap filter, so that no large table is sorted.
    near = labelled.where(hashed * n < 2_000_000 * sample)
    first = near.orderBy(hashed, "key", F.xxhash64("html")).limit(sample)
    rows = (
        first.mapInPandas(_count, "what string, above int, state int, n long")
        .groupBy("what", "above", "state").agg(F.sum("n").alias("n")).collect()
    )
    keys = ((x.what, x.state) if x.above < 0 else (x.what, x.above, x.state) for x in rows)
    return Model(Counter(dict(zip(keys, (x.n for x in rows)))))


def text_of(model: Model, source: str = "html") -> Column:
    """The main text of the page."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(model, x) for x in batch], dtype=object)

    return extract(F.col(source))


def extracted(pages: DataFrame, model: Model, keys: Sequence[str] = ("page_id", "url")) -> DataFrame:
    """The keys, ``text`` and ``n_chars`` of each page."""
    found = pages.select(*keys, text_of(model).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("long"))
