"""Keyword links inside HTML and their removal, as Arrow functions over a small document tree.

The tree follows the plain tag rules of Python's ``html.parser``: nothing is implied,
void elements take no children, an end tag closes back to the nearest open element
of its name and is dropped if there is none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr".split())
RAW = frozenset(["script", "style"])
#: Fixed value: the class of a made link.
LINK_CLASS = "interlinked-anchor"
#: Text inside these is never linked.
SKIPPED = frozenset("a code pre h1 h2 h3".split())
BLOCKS = frozenset(["p", "li", "blockquote"])


class Element:
    __slots__ = ("name", "attrs", "children", "parent")

    def __init__(self, name: str, attrs: list[tuple[str, str | None]], parent: Element | None) -> None:
        self.name, self.attrs, self.children, self.parent = name, attrs, [], parent


class Text:
    """A run of text, or markup kept as it is (comments, declarations)."""

    __slots__ = ("value", "raw", "parent")

    def __init__(self, value: str, parent: Element, raw: bool = False) -> None:
        self.value, self.parent, self.raw = value, parent, raw


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("", [], None)

    def handle_starttag(self, tag, attrs):
        e = Element(tag, attrs, self.at)
        self.at.children.append(e)
        if tag not in VOID:
            self.at = e

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Element(tag, attrs, self.at))

    def handle_endtag(self, tag):
        e = self.at
        while e is not None and e.name != tag:
            e = e.parent
        if e is not None and e.parent is not None:
            self.at = e.parent

    def handle_data(self, data):
        last = self.at.children[-1] if self.at.children else None
        if isinstance(last, Text) and not last.raw:
            last.value += data
        else:
            self.at.children.append(Text(data, self.at))

    def _keep(self, text):
        self.at.children.append(Text(text, self.at, True))

    def handle_comment(self, data):
        self._keep(f"<!--{data}-->")

    def handle_decl(self, decl):
        self._keep(f"<!{decl}>")

    def handle_pi(self, data):
        self._keep(f"<?{data}>")

    def unknown_decl(self, data):
        self._keep(f"<![{data}]>")


def parse(html: str) -> Element:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def serialise(e: Element) -> str:
    out: list[str] = []
    todo: list = [e]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, Text):
            out.append(x.value if x.raw or x.parent.name in RAW else _escape(x.value))
        else:
            if x.name:
                attrs = "".join(f' {k}="' + _escape(v or "").replace('"', "&quot;") + '"' for k, v in x.attrs)
                if x.name in VOID:
                    out.append(f"<{x.name}{attrs}/>")
                    continue
                out.append(f"<{x.name}{attrs}>")
                todo.append(f"</{x.name}>")
            todo.extend(reversed(x.children))
    return "".join(out)


def descendants(e: Element) -> Iterator[Element | Text]:
    todo = list(reversed(e.children))
    while todo:
        x = todo.pop()
        yield x
        if isinstance(x, Element):
            todo.extend(reversed(x.children))


def _skipped(x: Text) -> bool:
    e = x.parent
    while e is not None:
        if e.name in SKIPPED or e.name in RAW:
            return True
        e = e.parent
    return x.raw


@lru_cache(maxsize=1 << 16)
def _pattern(term: str) -> re.Pattern:
    """A term in any case, not inside a longer ASCII word; compiled once a worker."""
    return re.compile(rf"(?<![A-Za-z0-9_]){re.escape(term)}(?![A-Za-z0-9_])", re.I)


class _Offer:
    """The terms that are still to be linked, in the order they are tried."""

    def __init__(self, terms: list[dict]) -> None:
        self.left = dict(enumerate(terms))

    def pick(self, text: str, automatic: bool) -> tuple[dict, re.Match] | None:
        """The first term that ``text`` holds, with its first place; it and others of its key are gone then."""
        plain = text.lower() if text.isascii() else None
        for n, t in self.left.items():
            if not (automatic or t["priority"]):
                continue
            if plain is not None and t["term"].isascii() and t["term"].lower() not in plain:
                continue
            found = _pattern(t["term"]).search(text)
            if found is not None:
                self.left = {k: x for k, x in self.left.items() if x["key"] != t["key"]}
                return t, found
        return None


def _visits(root: Element) -> Iterator[tuple[int, Text]]:
    """Texts that may take a link, by block (numbered in document order), each block's as they are when it is
    reached; a text inside nested blocks is visited for each of them.  Without blocks the document is one."""
    homes = [x for x in descendants(root) if isinstance(x, Element) and x.name in BLOCKS] or [root]
    for n, home in enumerate(homes):
        for x in list(descendants(home)):
            if isinstance(x, Text) and not x.value.isspace() and x.value and not _skipped(x):
                yield n, x


def _wrap(x: Text, found: re.Match, t: dict) -> dict:
    """Put a link around the found part of a text; returns the record of it."""
    link = Element("a", [("href", t["url"]), ("class", LINK_CLASS), ("data-source", "priority" if t["priority"] else "auto")], x.parent)
    link.children = [Text(found.group(), link)]
    sides = [Text(x.value[: found.start()], x.parent), link, Text(x.value[found.end() :], x.parent)]
    siblings = x.parent.children
    at = [id(c) for c in siblings].index(id(x))
    siblings[at : at + 1] = [c for c in sides if c is link or c.value]
    near = " ".join(x.value[max(0, found.start() - 45) : found.end() + 45].split())
    return {"term": t["term"], "url": t["url"], "priority": bool(t["priority"]), "context": near or None}


def insert_links(html: str, terms: list[dict], max_links: int = 10, per_block: int = 3) -> tuple[str, list[dict]]:
    """The html with links for ``terms`` (dicts of key, term, url and priority, in the order they are tried).

    Blocks are p, li and blockquote in document order, nested ones again, or the whole document.
    Each text of a block takes at most one link a visit, for the first unused term that it holds;
    ``max_links`` bounds all, ``per_block`` a block's automatic ones (priority links fill it too)."""
    if not html or not terms:
        return html or "", []
    root, offer, made = parse(html), _Offer(terms), []
    filled: Counter = Counter()
    for block, text in _visits(root):
        if len(made) >= max_links or not offer.left:
            break
        hit = offer.pick(text.value, filled[block] < max(1, min(max_links, per_block)))
        if hit is not None:
            made.append(_wrap(text, hit[1], hit[0]))
            filled[block] += 1
    return serialise(root), made


def strip_links(html: str) -> str:
    """The html with every ``a`` replaced by its content, serialised anew."""
    root = parse(html)

    def unwrapped(children: list, parent: Element) -> list:
        out: list = []
        for c in children:
            if isinstance(c, Element) and c.name == "a":
                out += unwrapped(c.children, parent)
            else:
                c.parent = parent
                out.append(c)
        return out

    for e in [root, *[x for x in descendants(root) if isinstance(x, Element)]]:
        e.children = unwrapped(e.children, e)
    return serialise(root)


_RECORD = T.StructType([T.StructField("term", T.StringType()), T.StructField("url", T.StringType()), T.StructField("priority", T.BooleanType()), T.StructField("context", T.StringType())])
LINKED = T.StructType([T.StructField("html", T.StringType()), T.StructField("inserted", T.ArrayType(_RECORD))])


@F.pandas_udf(LINKED)
def insert_links_udf(html: pd.Series, terms: pd.Series, max_links: pd.Series) -> pd.DataFrame:
    """Column form of :func:`insert_links`; null html gives an empty string."""
    rows = [insert_links(h or "", [dict(t) for t in ts] if ts is not None else [], int(n)) for h, ts, n in zip(html, terms, max_links)]
    return pd.DataFrame({"html": [r[0] for r in rows], "inserted": [r[1] for r in rows]})


@F.pandas_udf(T.StringType())
def strip_links_udf(html: pd.Series) -> pd.Series:
    return html.map(lambda h: None if h is None else strip_links(h))
