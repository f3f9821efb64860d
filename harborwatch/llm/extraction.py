"""Main text of web pages by a minimum cut over their text blocks.

1. Blocks. A page is read once into blocks of text (a paragraph, a heading, an item, a cell, a run of text between them) and the
   elements above them. Scripts, styles, controls, comments in the markup and hidden elements hold no text.
2. Costs. Block features are bits: what the elements above it say it is, the words in their class and id, its tag, length,
   share of linked text and punctuation. A logistic regression gives the odds of content. Its weights start at the stated
   priors; those of the shape features are fitted on blocks whose elements name their role (article against nav, footer, aside
   ...) in a sample of at most ``sample`` pages, counted in Spark by feature set, so that pages without such elements are judged
   by what the others show. The odds are the terminal capacities.
3. Cut. Neighbouring blocks, and blocks and elements with their parents, are joined by edges that are weaker the further apart
   they stand in the DOM. The maximum flow from content to boilerplate gives the labelling of least cost. Nodes whose terminal
   outweighs all their edges are settled first, which leaves the flow the doubtful ones; at a tie a block is content.

Words that name a role count on the element they stand on and on all below, unless that element holds the page's h1 or main.

Defined results: null or empty html gives an empty text, as does a page without content; repeated rows are rows of their own; a
null id or url stays null; pages are worked whole, whatever their length; broken markup is closed where HTML closes it, a tag
that the end of the page cuts is dropped; a line break inside a block is white space, as is every Unicode space. Pages don't
depend on each other but through the fitted weights. Other columns don't matter.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborwatch.llm.words import small_batches

#: Role words of class and id attributes, at the start of a word; a stem that ends in $ is the whole word.
STEMS = {
    "menu": "nav menu breadcrumb pagination pager$ toolbar tabs$ skip$ toc$",
    "head": "header masthead topbar banner",
    "foot": "foot$ footer copyright legal$ colophon",
    "side": "side$ sidebar sidenav aside widget rail$ related recommend trending popular",
    "notice": "notice notification alert cookie consent gdpr popup modal overlay paywall",
    "ad": "ad$ ads$ adv$ adbox adslot adsense adunit adsby advert sponsor promo",
    "form": "form$ search newsletter subscribe signup login register",
    "share": "share sharing social follow$",
    "comment": "comment reply replies disqus discussion respond$ responses",
}
ROLE_TAGS = {"nav": "menu", "menu": "menu", "footer": "foot", "aside": "side", "form": "form", "fieldset": "form", "dialog": "notice"}
ROLES = {
    "navigation": "menu", "menu": "menu", "menubar": "menu", "banner": "head", "contentinfo": "foot", "complementary": "side",
    "search": "form", "form": "form", "alert": "notice", "dialog": "notice", "alertdialog": "notice",
}
GOOD_STEMS = "article content$ post$ entry story body$ text$ main$"

#: Features and the priors of their weights, in log odds of content.
PRIORS = {
    **dict.fromkeys(STEMS, -7.0), "article": 5.0, "named": 1.0,
    "bias": 0.5, "heading": 0.5, "paragraph": 1.0, "item": -0.5, "cell": -0.3,
    "short": -0.8, "medium": 0.3, "long": 1.5, "linked": -4.0, "some links": -1.0, "sentence": 0.7, "mark": -1.5,
}
BIT = {name: 1 << k for k, name in enumerate(PRIORS)}
WEIGHTS = np.array(list(PRIORS.values()))
SHAPE = list(PRIORS).index("bias")  # features from here on are fitted
BAD = sum(BIT[k] for k in STEMS)
#: Shape features together shift the odds by so much at most, so that stated roles outweigh them.
SHAPE_MOST = 3.5
#: Capacities are log odds times UNIT. BESIDE: neighbouring blocks two steps apart. UP: a block or element and its parent.
UNIT, BESIDE, UP, FAR = 100, 120, 30, 8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes textarea title xmp".split())
DROPPED = frozenset("audio button canvas datalist head math noscript object select svg template video".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot"
    " th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("article aside body footer header html main nav section table".split())
KIND = {**dict.fromkeys(HEADINGS, "heading"), **dict.fromkeys(("p", "blockquote", "pre"), "paragraph"),
        **dict.fromkeys(("li", "dt", "dd"), "item"), **dict.fromkeys(("td", "th", "caption"), "cell")}
#: What an opening tag ends, and the elements beyond which it ends nothing.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "caption"}, {"table"}),
    **dict.fromkeys(("tbody", "thead", "tfoot"), ({"tbody", "thead", "tfoot", "caption"}, {"table"})),
}

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)>|<[!?/][^>]*+(?:>|\Z)|<[a-zA-Z][^>]*+\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SENTENCE = re.compile(r"""[.!?…]["'”»)]?$""")


def _stems(text: str) -> str:
    return "|".join(re.escape(s[:-1]) + r"(?![a-z])" if s.endswith("$") else re.escape(s) for s in text.split())


_WORDS = re.compile("(?<![a-z])(?:" + "|".join(f"(?P<{k}>{_stems(v)})" for k, v in STEMS.items()) + f"|(?P<named>{_stems(GOOD_STEMS)}))")
_seen: dict[str, int] = {}


def word_bits(names: str) -> int:
    """Role bits of a class or id."""
    if names not in _seen:
        if len(_seen) > 50_000:
            _seen.clear()
        _seen[names] = sum({BIT[m.lastgroup] for m in _WORDS.finditer(_CAMEL.sub("-", names).lower())})
    return _seen[names]


class Page:
    """Blocks of a page: texts, element, linked characters; and its elements: parent, tag, role bits."""

    def __init__(self, source: str):
        self.texts: list[str] = []
        self.at: list[int] = []
        self.links: list[int] = []
        self.parent, self.tag, self.bits, self.words, self.holds = [-1], ["html"], [0], [0], [False]
        self._stack: list[tuple[str, int, bool, bool]] = []  # tag, element, dropped, link
        self._blocks: list[int] = []  # places of block elements on the stack
        self._dropped = self._linked = 0
        self._open: dict[str, int] = {}
        self._buffer: list[str] = []
        self._link_chars = 0
        self._read(source)

    def _element(self) -> int:
        return self._stack[self._blocks[-1]][1] if self._blocks else 0

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            if text:
                self.texts.append(text)
                self.at.append(self._element())
                self.links.append(self._link_chars)
            self._buffer, self._link_chars = [], 0

    def _pop(self, size: int) -> None:
        """Close elements down to a height of the stack."""
        if self._blocks and self._blocks[-1] >= size:
            self._flush()
        while len(self._stack) > size:
            tag, _, dropped, link = self._stack.pop()
            self._open[tag] -= 1
            self._dropped -= dropped
            self._linked -= link
            if self._blocks and self._blocks[-1] == len(self._stack):
                self._blocks.pop()

    def _end(self, tags: set[str], until: set[str] | frozenset) -> None:
        """Close the nearest open element of ``tags`` that isn't beyond one of ``until``."""
        for k in reversed(self._blocks):
            if self._stack[k][0] in tags:
                self._pop(k)
                return
            if self._stack[k][0] in until:
                return

    def _start(self, tag: str, attributes: str) -> None:
        block = tag in BLOCKS
        if block:
            self._flush()
            if self._blocks and self._stack[self._blocks[-1]][0] in ("p", "head"):
                self._pop(self._blocks[-1])
            if tag in HEADINGS and self._blocks and self._stack[self._blocks[-1]][0] in HEADINGS:
                self._pop(self._blocks[-1])
            if tag in ENDS:
                self._end(*ENDS[tag])
        if tag in VOID:
            if tag == "br" and not self._dropped:
                self._buffer.append(" ")
            return
        given = {}
        if attributes and not attributes.isspace():
            if attributes.endswith("/") and self._dropped:
                return
            for name, text in _ATTRIBUTE.findall(attributes):
                given.setdefault(name.lower(), text.strip("\"'"))
        dropped = tag in DROPPED or "hidden" in given or given.get("aria-hidden") == "true" or bool(_HIDDEN.search(given.get("style", "")))
        element = -1
        if block:
            element = len(self.tag)
            self.parent.append(self._element())
            self.tag.append(tag)
            role = given.get("role", "").lower()
            bits = BIT[ROLE_TAGS[tag]] if tag in ROLE_TAGS else 0
            if role in ROLES:
                bits |= BIT[ROLES[role]]
            if tag in ("article", "main") or role in ("article", "main"):
                bits |= BIT["article"]
            elif tag == "header" and not (self._open.get("article") or self._open.get("main")):
                bits |= BIT["head"]
            words = 0
            if tag not in ("html", "body"):
                for name in ("class", "id"):
                    if given.get(name):
                        words |= word_bits(entities.unescape(given[name]))
            self.bits.append(bits)
            self.words.append(words)
            self.holds.append(False)
            if tag in ("h1", "main") and not self._dropped:
                k = element
                while k > 0 and not self.holds[k]:
                    self.holds[k] = True
                    k = self.parent[k]
            self._blocks.append(len(self._stack))
        self._stack.append((tag, element, dropped, tag == "a"))
        self._open[tag] = self._open.get(tag, 0) + 1
        self._dropped += dropped
        self._linked += tag == "a"

    def _close(self, tag: str) -> None:
        if not self._open.get(tag):
            return
        if tag in BLOCKS:
            bounds = () if tag in SECTIONS or tag in ENDS else ("td", "th")
            for k in reversed(self._blocks):
                if self._stack[k][0] == tag:
                    self._pop(k)
                    return
                if self._stack[k][0] in bounds:
                    return
        else:
            least = self._blocks[-1] if self._blocks else -1
            for k in range(len(self._stack) - 1, least, -1):
                if self._stack[k][0] == tag:
                    self._pop(k)
                    return

    def _read(self, source: str) -> None:
        place, end = 0, len(source)
        while place < end:
            token = _TOKEN.search(source, place)
            text = source[place : token.start() if token else end]
            if text and not self._dropped:
                text = entities.unescape(text) if "&" in text else text
                self._buffer.append(text)
                if self._linked:
                    self._link_chars += len(text)
            if token is None:
                break
            place = token.end()
            closing, tag, attributes = token.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if closing:
                self._close(tag)
            elif tag in RAW:
                if tag != "xmp":
                    after = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, place)
                    place = after.start() if after else end
            else:
                self._start(tag, attributes)
        self._pop(0)
        self._flush()

    def features(self) -> list[int]:
        """Bits of each block."""
        above = []
        for k, (bits, words) in enumerate(zip(self.bits, self.words, strict=True)):
            if self.holds[k]:
                words &= ~BAD
                if self.tag[k] in ("form", "fieldset"):
                    bits &= ~BAD
            above.append(bits | words | (above[self.parent[k]] if self.parent[k] >= 0 else 0))
        out = []
        for text, k, linked in zip(self.texts, self.at, self.links, strict=True):
            bits, n = above[k] | BIT["bias"], len(text)
            if bits & BAD:
                bits &= ~(BIT["article"] | BIT["named"])
            kind = KIND.get(self.tag[k])
            bits |= BIT[kind] if kind else 0
            bits |= BIT["short"] if n < 25 else BIT["medium"] if n < 100 else BIT["long"]
            bits |= BIT["linked"] if 3 * linked >= 2 * n else BIT["some links"] if 5 * linked >= n else 0
            bits |= BIT["sentence"] if _SENTENCE.search(text) else 0
            bits |= BIT["mark"] if "©" in text else 0
            out.append(bits)
        return out

    def edges(self) -> list[tuple[int, int, int]]:
        """(node, node, capacity): blocks are the first nodes, elements follow."""
        count = len(self.texts)
        out = []
        for k in range(count - 1):
            steps = self._steps(self.at[k], self.at[k + 1])
            if steps < FAR:
                out.append((k, k + 1, BESIDE * 2 // max(2, steps)))
        joined = set()
        for k, element in enumerate(self.at):
            out.append((k, count + element, UP))
            while element > 0 and element not in joined:
                joined.add(element)
                out.append((count + element, count + self.parent[element], UP))
                element = self.parent[element]
        return out

    def _steps(self, a: int, b: int) -> int:
        """Steps between two elements in the DOM, FAR or more where they are that far apart."""
        up = {}
        for n in range(FAR):
            if a < 0:
                break
            up[a] = n
            a = self.parent[a]
        for n in range(FAR):
            if b in up:
                return n + up[b]
            if b <= 0:
                break
            b = self.parent[b]
        return FAR


# ---- minimum cut


def min_cut(terminals: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node is on the source's side of a least cut, at ties as many as can be.

    A node's terminal is the capacity of its edge from the source, or to the sink where it is negative.
    """
    n = len(terminals)
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, capacity in edges:
        near[a].append((b, capacity))
        near[b].append((a, capacity))
    excess, free = list(terminals), [sum(c for _, c in x) for x in near]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:  # a terminal that outweighs all edges to unsettled nodes settles its node
        k = todo.popleft()
        if side[k] is None and abs(excess[k]) > free[k]:
            side[k] = excess[k] > 0
            for j, capacity in near[k]:
                if side[j] is None:
                    excess[j] += capacity if side[k] else -capacity
                    free[j] -= capacity
                    todo.append(j)
    rest = [k for k in range(n) if side[k] is None]
    if rest:
        for k, content in zip(rest, _flow(rest, excess, near, side), strict=True):
            side[k] = content
    return side  # type: ignore[return-value]


def _flow(rest: list[int], excess: list[int], near: list, side: list) -> list[bool]:
    """The same for unsettled nodes, by blocking flows (shortest augmenting paths first)."""
    number = {k: x for x, k in enumerate(rest)}
    source, sink = len(rest), len(rest) + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(len(rest) + 2)]

    def link(a: int, b: int, forth: int, back: int) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        room.extend((forth, back))

    for k in rest:
        if excess[k] > 0:
            link(source, number[k], excess[k], 0)
        elif excess[k] < 0:
            link(number[k], sink, -excess[k], 0)
        for j, capacity in near[k]:
            if j > k and side[j] is None:
                link(number[k], number[j], capacity, capacity)
    while True:
        level = [-1] * len(out)
        level[source] = 0
        queue = deque([source])
        while queue and level[sink] < 0:
            a = queue.popleft()
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            break
        following = [0] * len(out)
        path: list[int] = []
        a = source
        while True:
            if a == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not room[e])
                a = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while following[a] < len(out[a]):
                e = out[a][following[a]]
                if room[e] and level[to[e]] == level[a] + 1:
                    break
                following[a] += 1
            if following[a] < len(out[a]):
                path.append(out[a][following[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                following[a] += 1
            else:
                break
    reaches = [False] * len(out)  # those that can still send to the sink are boilerplate
    reaches[sink] = True
    queue = deque([sink])
    while queue:
        b = queue.popleft()
        for e in out[b]:
            if room[e ^ 1] and not reaches[to[e]]:
                reaches[to[e]] = True
                queue.append(to[e])
    return [not reaches[x] for x in range(len(rest))]


# ---- costs


def odds(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log odds of content of feature sets."""
    on = (features[:, None] >> np.arange(len(WEIGHTS)) & 1).astype(float)
    return on[:, :SHAPE] @ weights[:SHAPE] + np.clip(on[:, SHAPE:] @ weights[SHAPE:], -SHAPE_MOST, SHAPE_MOST)


def fit_weights(counted: list[tuple[int, int, int]], strength: float = 10.0) -> np.ndarray:
    """Weights from (shape features, 0 or 1, count): Newton steps under a normal prior around PRIORS."""
    weights = WEIGHTS.copy()
    if not counted or len({label for _, label, _ in counted}) < 2:
        return weights
    features, label, count = (np.array(c) for c in zip(*sorted(counted), strict=True))
    on = (features[:, None] >> np.arange(SHAPE, len(WEIGHTS)) & 1).astype(float)
    prior = w = WEIGHTS[SHAPE:]
    count = count * min(1.0, 1000.0 / count.sum())  # as if of a thousand blocks at most: the prior keeps its say
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(on @ w, -30, 30)))
        slope = on.T @ (count * (label - p)) - strength * (w - prior)
        bend = (on * (count * p * (1 - p))[:, None]).T @ on + strength * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    weights[SHAPE:] = w
    return weights


def fit(pages: DataFrame, html_col: str = "html", sample: int = 2000) -> np.ndarray:
    """Weights fitted on ``sample`` pages, those of least hash; the driver gets counts by feature set."""
    shape = sum(b for k, b in enumerate(BIT.values()) if k >= SHAPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bits for k in range(len(batch)) for bits in Page(batch.column(0)[k].as_py()).features()]
            named = [b for b in found if b & (BAD | BIT["article"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b & shape for b in named], pa.int64()), pa.array([int(not b & BAD) for b in named], pa.int32())], ["f", "y"])

    hashed = small_batches(pages).filter(F.length(html_col) > 0).select(F.col(html_col).alias("t"), F.xxhash64(html_col).alias("h"))
    last = hashed.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).collect()[0][0]
    if last is None:
        return WEIGHTS.copy()
    chosen = hashed.filter(F.col("h") <= last).dropDuplicates(["h"]).select("t")
    counts = chosen.mapInArrow(run, "f long, y int").groupBy("f", "y").count()
    return fit_weights([(r["f"], r["y"], r["count"]) for r in counts.collect()])


# ---- pages


def content(page: Page, weights: np.ndarray) -> tuple[list[bool], np.ndarray]:
    """Whether each block is content, and its log odds."""
    if not page.texts:
        return [], np.zeros(0)
    scores = odds(np.array(page.features()), weights)
    terminals = np.rint(scores * UNIT).astype(int).tolist() + [0] * len(page.tag)
    return min_cut(terminals, page.edges())[: len(page.texts)], scores


def main_text(source: str | None, weights: np.ndarray = WEIGHTS) -> str:
    """Content blocks of one page, a line each."""
    page = Page(source or "")
    return "\n".join(t for t, keep in zip(page.texts, content(page, weights)[0], strict=True) if keep)


def extract(pages: DataFrame, sample: int = 2000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page."""
    weights = fit(pages, html_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(batch.column(2)[k].as_py(), weights) for k in range(len(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    chosen = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html_col)
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def labelled_blocks(pages: DataFrame, sample: int = 2000, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, block, text, odds, content) of every block of each page."""
    weights = fit(pages, html_col, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                page = Page(batch.column(1)[k].as_py() or "")
                keep, scores = content(page, weights)
                n = len(page.texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([k] * n, pa.int64())), pa.array(range(n), pa.int32()), pa.array(page.texts, pa.string()),
                     pa.array(scores), pa.array(keep, pa.bool_())], ["page_id", "block", "text", "odds", "content"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), html_col).mapInArrow(
        run, "page_id long, block int, text string, odds double, content boolean")
