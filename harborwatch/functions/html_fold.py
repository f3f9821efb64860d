"""Folds the tag and text tokens of one page into its element tree.

Covers the part of the HTML tree rules that decides element paths: void tags, implied ends of
``p li dd dt option tr td th`` and table sections, inserted ``tbody`` and ``tr``, content moved out
of tables, and re-opening of formatting tags. Left out: moving a block out of a formatting tag that
ends inside it, templates, framesets, and tag-like text inside ``title`` and ``textarea``.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from html.entities import html5

# Tag classes of the HTML standard.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FORMATTING = set("a b big code em font i nobr s small strike strong tt u".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section"
    " summary table ul xmp dd dt".split()
)
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
SECTIONS = {"tbody", "thead", "tfoot"}
TABLE_CONTEXT = SECTIONS | {"table", "tr"}
TABLE_PARTS = SECTIONS | {"tr", "td", "th", "caption", "colgroup", "col"}
CELLS = {"td", "th", "caption"}
SCOPE_WALL = CELLS | {"html", "table", "applet", "marquee", "object", "template"}
P_WALL = SCOPE_WALL | {"button"}
LIST_WALL = SCOPE_WALL | {"ul", "ol"}
TABLE_WALL = {"table", "html"}
STOPS = {"tr": SECTIONS | {"table"}, "td": SECTIONS | {"table", "tr"}, "col": {"table", "colgroup"}}
STOPS["th"] = STOPS["td"]
SPECIAL = CLOSES_P | TABLE_PARTS | SCOPE_WALL | VOID | set(
    "body button frame frameset head iframe noembed noframes noscript script select style textarea title".split()
)
HEAD_ONLY = {"meta", "link", "base", "title"}
# What cleaning drops.
DROP_TAGS = {
    "style", "header", "footer", "option", "nav", "input", "select", "img", "script", "link", "noscript", "iframe",
}
DROP_ATTRS = {"id", "on", "style"}

_ODD_SPACE = "\t\n\x0b\x0c\r\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
# Runs of white space but for the single spaces, which stay as they are.
SPACE_RUN = re.compile(f"[{_ODD_SPACE}][{_ODD_SPACE} ]*| [{_ODD_SPACE} ]+")
_NAME = re.compile(r"</?([^\s/>]+)")
_ATTR = re.compile(r"""([^\s=/>"'][^\s=/>]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)")
_RAW_TOKEN = re.compile(r"(?is)(<(script|style)(?:[\s/][^>]*)?>)(.*?)(?:</\2\s*>)?")
_COMMENT, _RAW = "!", "#raw"


class Element:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag, attrs=None, parent=None):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs or {}, [], parent


def _decode_attr(value: str) -> str:
    """Character references of an attribute: unlike in text, ``&copy=`` and ``&section`` stay as they are."""
    def one(m: re.Match) -> str:
        ref = m.group()
        if ref[1] == "#":
            return html.unescape(ref)
        if not ref.endswith(";") and value[m.end():m.end() + 1] == "=":
            return ref
        return html5.get(ref[1:], ref)

    return _REFERENCE.sub(one, value)


def read_attrs(token: str, start: int) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(token, start, len(token) - 1):
        value = a or b or c
        out.setdefault(name.lower(), _decode_attr(value) if "&" in value else value)
    return out


@lru_cache(maxsize=8192)
def read_tag(token: str) -> tuple[str, dict[str, str], bool]:
    """Name, attributes (not to be changed: tags recur) and whether it closes itself."""
    name = _NAME.match(token)
    attrs = {} if token[1] == "/" else read_attrs(token, name.end())
    return name.group(1).lower(), attrs, token.endswith("/>")


class Tree:
    """Open-element stack over a growing element tree."""

    def __init__(self):
        self.root = Element("html")
        self.head = Element("head", parent=self.root)
        self.body = Element("body", parent=self.root)
        self.root.kids = [self.head, self.body]
        self.stack = [self.root, self.body]
        self.active: list = []  # open formatting elements; None marks a table cell
        self.in_head, self.in_title = True, False

    def close_to(self, at: int) -> None:
        """Close every open element from stack position ``at`` on (html and body stay open)."""
        for el in self.stack[max(at, 2):]:
            if el.tag in CELLS:
                while self.active and self.active.pop() is not None:
                    pass
        del self.stack[max(at, 2):]

    def find(self, tags, walls=SCOPE_WALL) -> int:
        """Stack position of the nearest open element of these tags, not looking past a wall; else 0."""
        for i in range(len(self.stack) - 1, 1, -1):
            tag = self.stack[i].tag
            if tag in tags:
                return i
            if tag in walls:
                return 0
        return 0

    def close_p(self) -> None:
        at = self.find(("p",), P_WALL)
        if at:
            self.close_to(at)

    def add(self, item) -> None:
        """Append to the open element; what may not stand in a table goes in front of it."""
        here = self.stack[-1]
        if here.tag in TABLE_CONTEXT and self._misplaced(item):
            at = self.find({"table"}, ())
            here = self.stack[at]
            kids = here.parent.kids
            spot = next(i for i, k in enumerate(kids) if k is here)
            if isinstance(item, str) and spot and isinstance(kids[spot - 1], str):
                kids[spot - 1] += item
                return
            kids.insert(spot, item)
            here = here.parent
        elif isinstance(item, str) and here.kids and isinstance(here.kids[-1], str):
            here.kids[-1] += item
            return
        else:
            here.kids.append(item)
        if isinstance(item, Element):
            item.parent = here

    @staticmethod
    def _misplaced(item) -> bool:
        if isinstance(item, str):
            return not item.isspace()
        if isinstance(item, Element):
            return item.tag not in TABLE_PARTS and item.tag not in ("script", "style", "template", "form")
        return False

    def open(self, tag, attrs=None) -> Element:
        el = Element(tag, attrs)
        self.add(el)
        self.stack.append(el)
        return el

    def reopen(self) -> None:
        """Open again the formatting elements that an enclosing block closed."""
        i = len(self.active)
        while i and self.active[i - 1] is not None and not any(e is self.active[i - 1] for e in self.stack):
            i -= 1
        for k in range(i, len(self.active)):
            old = self.active[k]
            self.active[k] = self.open(old.tag, dict(old.attrs))

    def push_format(self, el: Element) -> None:
        same = []
        for e in reversed(self.active):
            if e is None:
                break
            if e.tag == el.tag and e.attrs == el.attrs:
                same.append(e)
        if len(same) >= 3:
            self.forget(same[-1])
        self.active.append(el)

    def forget(self, el: Element) -> None:
        self.active = [e for e in self.active if e is not el]

    def text(self, value: str) -> None:
        if self.in_title:
            self.head.kids[-1].kids.append(value)
        elif self.in_head:
            if not value.isspace():
                self.in_head = False
                self.add(value)
        else:
            if self.stack[-1].tag not in TABLE_CONTEXT or not value.isspace():
                self.reopen()
            self.add(value)

    def start(self, tag: str, attrs: dict, closed: bool) -> None:
        if tag in ("html", "head", "body"):
            el = {"html": self.root, "head": self.head, "body": self.body}[tag]
            el.attrs = {**attrs, **el.attrs}
            self.in_head = self.in_head and tag != "body"
            return
        if self.in_head:
            if tag in HEAD_ONLY:
                self.head.kids.append(Element(tag, attrs, self.head))
                self.in_title = tag == "title"
                return
            self.in_head = False
        if tag in TABLE_PARTS:
            self._table_part(tag, attrs)
            return
        here = self.stack[-1].tag
        if tag in CLOSES_P:
            if tag == "table" and here in TABLE_CONTEXT:
                self.close_to(self.find({"table"}, ()))
            if tag in ("li", "dd", "dt"):
                self._close_item({"li"} if tag == "li" else {"dd", "dt"})
            if tag == "form" and here in TABLE_CONTEXT:
                self.add(Element(tag, attrs))
                return
            self.close_p()
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.close_to(len(self.stack) - 1)
        else:
            if tag in ("option", "optgroup") and here == "option":
                self.close_to(len(self.stack) - 1)
            if tag == "button" and self.find({"button"}):
                self.close_to(self.find({"button"}))
            if tag in ("a", "nobr"):
                self.end(tag, only_if_active=True)
            self.reopen()
        if tag in VOID:
            self.add(Element(tag, attrs))
        elif closed and self.find({"svg", "math"}):
            self.add(Element(tag, attrs))
        else:
            el = self.open(tag, attrs)
            if tag in FORMATTING:
                self.push_format(el)

    def _close_item(self, tags) -> None:
        for i in range(len(self.stack) - 1, 1, -1):
            tag = self.stack[i].tag
            if tag in tags:
                self.close_to(i)
                return
            if tag in SPECIAL and tag not in ("address", "div", "p"):
                return

    def _table_part(self, tag: str, attrs: dict) -> None:
        if not self.find(("table",), ()):
            return  # a table part outside any table is dropped
        self.close_to(self.find(STOPS.get(tag, TABLE_WALL), ()) + 1)
        here = self.stack[-1].tag
        if tag in ("tr", "td", "th") and here == "table":
            self.open("tbody")
        if tag in ("td", "th") and self.stack[-1].tag in SECTIONS:
            self.open("tr")
        if tag == "col":
            if here == "table":
                self.open("colgroup")
            self.add(Element(tag, attrs))
            return
        self.open(tag, attrs)
        if tag in CELLS:
            self.active.append(None)

    def end(self, tag: str, only_if_active: bool = False) -> None:
        if tag == "title" and self.in_title:
            self.in_title = False
        if self.in_head or tag in ("html", "head", "body"):
            return
        if tag in FORMATTING:
            live = []
            for e in reversed(self.active):
                if e is None:
                    break
                live.append(e)
            el = next((e for e in live if e.tag == tag), None)
            if el is not None:
                at = next((i for i, e in enumerate(self.stack) if e is el), 0)
                if not at:
                    self.forget(el)
                elif not any(e.tag in SCOPE_WALL for e in self.stack[at + 1:]):
                    self.forget(el)
                    if not any(e.tag in SPECIAL for e in self.stack[at + 1:]):
                        self.close_to(at)
                return
            if only_if_active:
                return
        if tag == "p":
            self.close_p() if self.find(("p",), P_WALL) else self.add(Element("p"))
        elif tag == "br":
            self.start("br", {}, False)
        elif tag in HEADINGS:
            at = self.find(HEADINGS)
            self.close_to(at) if at else None
        elif tag in TABLE_PARTS or tag == "table":
            at = self.find((tag,), TABLE_WALL)
            self.close_to(at) if at else None
        elif tag in SPECIAL:
            at = self.find((tag,), LIST_WALL if tag == "li" else SCOPE_WALL)
            self.close_to(at) if at else None
        else:
            for i in range(len(self.stack) - 1, 1, -1):
                if self.stack[i].tag == tag:
                    self.close_to(i)
                    return
                if self.stack[i].tag in SPECIAL:
                    return


def build_tree(tokens: list[str]) -> Tree:
    tree = Tree()
    for token in tokens:
        if token[0] != "<" or len(token) == 1:
            tree.text(html.unescape(token) if "&" in token else token)
        elif token.startswith("<!--"):
            if not tree.in_head:
                tree.add((_COMMENT, token))
        elif token[1] == "/" and token[-1] == ">":
            tree.end(read_tag(token)[0])
        elif token[1].isalpha():
            if token[1] in "sS" and (raw := _RAW_TOKEN.fullmatch(token)):
                tag, attrs, _ = read_tag(raw.group(1))
                el = Element(tag, attrs)
                el.kids = [(_RAW, raw.group(3))]
                tree.head.kids.append(el) if tree.in_head else tree.add(el)
            elif token[-1] != ">":
                break  # a tag cut off by the end of the page
            else:
                tree.start(*read_tag(token))
    return tree


def _clean(el: Element) -> None:
    """Drop unwanted elements and attributes below ``el`` and squash white space, in place."""
    todo = [el]
    while todo:
        here = todo.pop()
        if here.attrs:
            here.attrs = {k: SPACE_RUN.sub(" ", v) for k, v in here.attrs.items() if k not in DROP_ATTRS}
        kept: list = []
        for kid in here.kids:
            if isinstance(kid, Element):
                if kid.tag in DROP_TAGS or "mobile" in kid.attrs.get("class", ""):
                    continue
                todo.append(kid)
            elif isinstance(kid, str):
                if kept and isinstance(kept[-1], str):
                    kid = kept.pop() + kid
                kid = SPACE_RUN.sub(" ", kid)
            kept.append(kid)
        here.kids = kept


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def _escape_attr(value: str) -> str:
    return value.replace("&", "&amp;").replace("\u00a0", "&nbsp;").replace('"', "&quot;")


def _serialize(el: Element) -> str:
    out: list[str] = []
    todo: list = [el]
    while todo:
        item = todo.pop()
        if isinstance(item, Element):
            attrs = "".join(f' {k}="{_escape_attr(v)}"' for k, v in item.attrs.items())
            out.append(f"<{item.tag}{attrs}>")
            if item.tag not in VOID:
                todo.append(("</", item.tag))
                todo.extend(reversed(item.kids))
        elif isinstance(item, str):
            out.append(_escape(item))
        elif item[0] == "</":
            out.append(f"</{item[1]}>")
        else:
            out.append(SPACE_RUN.sub(" ", item[1] if item[1].endswith("-->") else item[1] + "-->"))
    return "".join(out).strip()


@lru_cache(maxsize=8192)
def _step(tag: str, cls: str) -> str:
    return f"{tag}.{'.'.join(cls.split())}" if cls else tag


def fold_page(tokens: list[str], clean: bool, with_html: bool = False) -> tuple[list[dict], list[str], str | None]:
    """Elements in document order, the page's text pieces, and, if asked for, the cleaned HTML."""
    tree = build_tree(tokens)
    cleaned = None
    root = tree.root
    if clean:
        if any("mobile" in el.attrs.get("class", "") for el in (root, tree.body)):
            tree.body = Element("body", parent=root)
            cleaned = ""
        else:
            _clean(tree.body)
            cleaned = _serialize(tree.body) if with_html else None
        root.attrs, root.kids = {}, [Element("head", parent=root), tree.body]
    nodes: list[dict] = []
    texts: list[str] = []
    todo: list = [(root, -1, [])]
    while todo:
        item, parent, path = todo.pop()
        if isinstance(item, Element):
            no = len(nodes)
            path = [*path, _step(item.tag, item.attrs.get("class", ""))]
            node = {
                "no": no, "parent": parent, "last": no, "tag": item.tag, "attrs": list(item.attrs.items()),
                "path": path, "t0": len(texts), "t1": len(texts), "own": [],
            }
            nodes.append(node)
            if item.kids:
                todo.append((None, no, path))
                for kid in reversed(item.kids):
                    todo.append((kid, no, path))
        elif item is None:
            nodes[parent]["last"] = len(nodes) - 1
            nodes[parent]["t1"] = len(texts)
        else:
            if isinstance(item, str) or item[0] == _RAW:
                nodes[parent]["own"].append(len(texts))
                texts.append(item if isinstance(item, str) else item[1])
    return nodes, texts, cleaned
