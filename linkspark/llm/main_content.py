"""Main content of web pages by layout-aware rendering.

A tree builder with implied end tags and visibility rules walks a page once and
emits every visible block with its place in the layout: block spacing, list
markers and aligned table cells are kept in the rendering.  Whether a rendered block
is of the article is decided by what speaks against it (:func:`evidence`): its place
outside the element that holds the headline and the text, link density, layout as a trail
or comment or box behind the text, and its repetition under other headlines of
the same site or of all sites, counted over the whole corpus (:func:`repeated`).

The lines of a page's stored text are matched with its blocks by their letters
and digits.  Lines without a matching block (pages without html) are decided by a
line model fitted on matched lines of a bounded sample of pages, by the headline's
place, by the heading of other pages' teasers, and by the names a paragraph shares
with the rest of the article.  Headings and the words that are no names are those
of all pages with html.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.samples import bounded_sample
from linkspark.workspace import materialise

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|([^<]+|<)", re.S | re.I)
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of the second set, looking no further out than the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: An end tag closes nothing beyond these.
WALLS = frozenset("table td th body html".split())
#: Elements whose content is never the article's, and those that speak against it.
NOISE = frozenset("nav aside footer form button select menu dialog".split())
ASIDE = frozenset("header small address label figure".split())
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|visibility\s*:\s*hidden|type\s*=\s*[\"']?hidden", re.I)
MARKED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=", re.I)
SENTENCE_END = re.compile(r"[.!?…。！？।؟]\s*\Z")
SPACES = re.compile(r"\s+")


class Block:
    """A visible block: ``path`` holds (serial, tag, marked, list number, hidden) of the
    elements it lies in, ``cell`` the serials of its table row and cell, ``linked`` the share of its characters in links."""

    __slots__ = ("text", "tag", "path", "cell", "linked")

    def __init__(self, text: str, tag: str, path: tuple, cell: tuple | None, linked: float = 0.0) -> None:
        self.text, self.tag, self.path, self.cell, self.linked = text, tag, path, cell, linked


def blocks(html: str) -> list[Block]:
    """Visible blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple] = []
    buffer: list[str] = []
    hidden = serial = 0
    places: list[tuple] = []
    sizes: list[int] = []
    counts: dict[int, int] = {}

    def flush() -> None:
        if buffer:
            text = SPACES.sub(" ", entities.unescape("".join(buffer))).strip()
            if text:
                # what all its pieces lie in
                path = places[0]
                for other in places[1:]:
                    if other is not path:
                        n = min(len(path), len(other))
                        path = path[: next((k for k in range(n) if path[k][0] != other[k][0]), n)]
                tag = next((e[1] for e in reversed(path) if e[1] in BLOCKS), "body")
                cell = next((e[0] for e in reversed(path) if e[1] in ("td", "th")), None)
                row = next((e[0] for e in reversed(path) if e[1] == "tr"), None)
                links = sum(n for n, x in zip(sizes, places) if any(e[1] == "a" for e in x))
                out.append(Block(text, tag, path, (row, cell) if cell is not None else None, links / max(sum(sizes), 1)))
            buffer.clear()
            places.clear()
            sizes.clear()

    def pop(at: int) -> None:
        nonlocal hidden
        if any(e[1] in BLOCKS for e in stack[at:]):
            flush()
        hidden -= sum(e[4] for e in stack[at:])
        del stack[at:]

    for m in TOKEN.finditer(html):
        text = m.group(5)
        if text is not None:
            if not hidden and (buffer or not text.isspace()):
                buffer.append(text)
                if not text.isspace():
                    places.append(tuple(stack))
                    sizes.append(len(text.strip()))
            continue
        tag = m.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(2):
            if tag == "br":
                buffer.append(" ")
                continue
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][1] == tag:
                    pop(at)
                    break
                if stack[at][1] in WALLS and tag not in WALLS and tag not in ("tr", "tbody", "thead"):
                    break
            continue
        if tag in BLOCKS:
            flush()
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][1] == "p" and tag != "body":
                    pop(at)
                    break
                if stack[at][1] in BLOCKS:
                    break
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            for at in range(len(stack) - 1, -1, -1):
                if stack[at][1] in ends:
                    pop(at)
                    if tag not in ("tr", "tbody"):
                        break
                elif stack[at][1] in stop or (tag == "li" and stack[at][1] in WALLS):
                    break
        if tag in VOID:
            if tag in ("br", "hr"):
                buffer.append(" ")
            continue
        if tag == "a":
            buffer.append(" ")
        attrs = m.group(4)
        if tag == "span" and buffer and MARKED.search(attrs) and SENTENCE_END.search("".join(buffer[-2:])):
            flush()  # a marked span behind a whole sentence stands for itself
        serial += 1
        number = 0
        if tag == "li":
            home = next((e for e in reversed(stack) if e[1] in ("ol", "ul")), None)
            if home is not None and home[1] == "ol":
                number = counts[home[0]] = counts.get(home[0], 0) + 1
        veil = 1 if tag in ("head", "title") or (attrs and HIDDEN.search(attrs)) else 0
        if veil and tag in BLOCKS:
            flush()
        hidden += veil
        if not attrs.endswith("/"):
            stack.append((serial, tag, bool(attrs) and MARKED.search(attrs) is not None, number, veil))
        else:
            hidden -= veil
    flush()
    return out


def render(html: str) -> str:
    """All visible text of a page, see :func:`render_blocks`."""
    return render_blocks(blocks(html))


def render_blocks(found: list[Block]) -> str:
    """The text of blocks: a blank line between paragraphs, ``-`` or numbers before list
    items indented by depth, the cells of a table row on one line in aligned columns."""
    lines: list[str] = []
    at = 0
    while at < len(found):
        b = found[at]
        if b.cell is not None and any(e[1] == "table" for e in b.path):
            table = max(e[0] for e in b.path if e[1] == "table")
            rows: dict = {}
            while at < len(found) and found[at].cell is not None and any(e[0] == table for e in found[at].path):
                rows.setdefault(found[at].cell[0], {}).setdefault(found[at].cell[1], []).append(found[at].text)
                at += 1
            grid = [[" ".join(c) for c in r.values()] for r in rows.values()]
            width = [max(len(r[k]) for r in grid if k < len(r)) for k in range(max(map(len, grid)))]
            lines += ["", *["  ".join(c.ljust(width[k]) for k, c in enumerate(r)).rstrip() for r in grid], ""]
            continue
        items = [e for e in b.path if e[1] == "li"]
        if items:
            lines.append("  " * (len(items) - 1) + (f"{items[-1][3]}. " if items[-1][3] else "- ") + b.text)
        else:
            lines += ["", b.text, ""]
        at += 1
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip("\n")


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: A reader's comment: a name, a date in brackets and a colon.
COMMENT = re.compile(r"[^\s()][^()]*\((?=[^()]*\d)[^()]+\)\s?[:：]")
#: Short names with signs of descent between them.
TRAIL = re.compile(r"[^.!?。>›»]+(?:\s[>›»→]\s[^.!?。>›»]+)+")
HOST = re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[a-z]{2,}(?![A-Za-z0-9])")
PROPER = re.compile(r"(?<![A-Za-z])[A-Z][A-Za-z'’-]+")
#: What every host name holds; most texts don't.
DOT = re.compile(r"[A-Za-z0-9-]\.[a-z]{2}")
OUT = 9


def kind_of(b: Block) -> str:
    """What a block is in the rendering: heading, item, cell or paragraph."""
    if b.tag in HEADINGS:
        return "heading"
    if any(e[1] in ("li", "dt", "dd") for e in b.path):
        return "item"
    return "cell" if b.cell is not None else "paragraph"


def headline_of(found: list[Block]) -> int | None:
    return next((k for k, b in enumerate(found) if b.tag == "h1"), None)


def evidence(found: list[Block]) -> list[int]:
    """What in the rendering of each block speaks against its being of the article; from 2 on
    it is held to be outside, repetition on other pages (see :func:`repeated`) counting 2.

    The article lies in the innermost element around the headline that has text of its own
    besides.  In there count: elements made for other purposes, link density, trails of
    names, comments, a heading right above links, short lines with figures next to the headline,
    a box of its own behind the last of the text, host names.  A class, id or role
    counts 1 and so never decides alone."""
    at = headline_of(found)
    kinds = [kind_of(b) for b in found]
    names = [{e[1] for e in b.path} for b in found]
    plain = [len(b.text) if b.linked < 0.5 and NOISE.isdisjoint(x) else 0 for b, x in zip(found, names)]
    depth, home = 0, 0
    if at is not None:
        plain[at] = 0
        path = found[at].path
        depth = max(k for k, e in enumerate(path) if e[1] == "h1")
        enough = 0.1 * sum(plain)
        while depth > 0:
            home = path[depth - 1][0]
            if sum(n for n, b in zip(plain, found) if any(e[0] == home for e in b.path)) >= enough:
                break
            depth -= 1
    direct = {next((e[0] for e in reversed(b.path) if e[1] in BLOCKS), 0) for b in found}
    out, boxes = [], []
    for k, b in enumerate(found):
        if depth and not (len(b.path) >= depth and b.path[depth - 1][0] == home):
            out.append(OUT)
            boxes.append(0)
            continue
        below = b.path[depth:]
        n = 0
        if not NOISE.isdisjoint(names[k]) and any(e[1] in NOISE for e in below):
            n += 2
        if k != at and not ASIDE.isdisjoint(names[k]) and any(e[1] in ASIDE for e in below):
            n += 1
        if any(e[2] for e in below):
            n += 1
        if b.linked >= 0.8:
            n += 2
        if kinds[k] == "heading" and k != at and k + 1 < len(found) and found[k + 1].linked >= 0.8:
            n += 2
        if kinds[k] != "heading" and TRAIL.fullmatch(b.text) and len(b.text) < 120:
            n += 2
        if COMMENT.match(b.text):
            n += 2
        if DOT.search(b.text) and HOST.search(b.text):
            n += 1
        if kinds[k] == "paragraph" and at is not None and 0 < abs(k - at) <= 2 and short_line(b.text) and any(c.isdigit() for c in b.text):
            n += 1
        out.append(n)
        # elements without text of their own are boxes
        boxes.append(next((e[0] for e in below if e[1] in ("div", "section", "article") and e[0] not in direct), 0))
    flow = [k for k in range(len(found)) if out[k] == 0 and not boxes[k] and k != at]
    inside = sum(len(found[k].text) for k in range(len(found)) if out[k] < 2)
    last = flow[-1] if flow and 2 * sum(len(found[k].text) for k in flow) > inside else len(found)
    return [n + 1 if boxes[k] and k > last and n < OUT else n for k, n in enumerate(out)] if at is not None else out


def short_line(text: str) -> bool:
    return len(text) <= 80 and not SENTENCE_END.search(text)


KEY = re.compile(r"[\W_]+")


def line_key(text: str) -> str:
    return KEY.sub("", text.lower())


def matched(found: list[Block], text: str, keys: list[str] | None = None) -> list[tuple[int, str, int | None]]:
    """The non-blank lines of a text (from 1), each with the block that shows it, if there is one; ``keys`` are the blocks' line keys."""
    places: dict[str, list[int]] = defaultdict(list)
    for k, key in enumerate(keys if keys is not None else [line_key(b.text) for b in found]):
        places[key].append(k)
    out = []
    for n, line in enumerate(text.split("\n"), 1):
        if line.strip():
            at = places.get(line_key(line))
            out.append((n, line, (at.pop(0) if len(at) > 1 else at[0]) if at else None))
    return out


def _hosts_alike(text: str) -> str:
    return HOST.sub("\u0001", text) if DOT.search(text) else text


def plain_line(line: str) -> str:
    """A line with host names and figures made alike."""
    return re.sub(r"\d+", "0", _hosts_alike(line))


def repeat_key(b: Block, kind: str) -> str:
    """A block's text with hosts made alike; outside lists and tables, whose figures are what they tell,
    with figures made alike too, and in short lines without an end mark the names."""
    if kind in ("item", "cell"):
        return SPACES.sub(" ", _hosts_alike(b.text).lower())
    text = plain_line(b.text)
    if kind == "paragraph" and short_line(b.text):
        text = PROPER.sub("\u0002", text)
    return SPACES.sub(" ", text.lower())


NAME = re.compile(r"[A-Z][a-z]{3,}")


class LineModel:
    """Naive Bayes of article and other lines, with the capitalised words that are too common for names."""

    def __init__(self, rows: list[tuple[str, bool]], common: set[str]) -> None:
        """``rows`` are lines and whether they are of an article."""
        from linkspark.llm.languages import TOKEN as WORD
        from linkspark.llm.languages import Model, _gram_counts

        self.word = WORD
        self.common = common
        seen = {True: Counter(), False: Counter()}
        for line, flag in rows:
            seen[flag].update(WORD.findall(plain_line(line)))
        # some of each class, so that an empty sample gives a model that favours the article
        seen[True].update(["\u0001"])
        seen[False].update(["\u0001"])
        self.model = Model.fit({"main": _gram_counts(seen[True]), "noise": _gram_counts(seen[False])})

    def noise(self, lines: list[str]) -> np.ndarray:
        """Log odds of noise by line."""
        words, first = [], []
        for line in lines:
            first.append(len(words))
            words += self.word.findall(plain_line(line)) or ["\u0001"]
        self.model.index(set(words))
        ids = np.fromiter(map(self.model.known.__getitem__, words), np.int64, len(words))
        score = np.add.reduceat(self.model.rows[ids], first, axis=0)
        # a long line needs more than a slight lean of each of its words
        return score[:, 1] - score[:, 0] - np.maximum(1.0, 0.25 * np.diff(np.r_[first, len(words)]))

    def names(self, line: str) -> set[str]:
        return {w for w in NAME.findall(line) if w not in self.common}

    def page(self, title: str | None, lines: list[str], votes: list[float | None], headings: list[bool]) -> list[bool]:
        """Which lines of a page without html are outside the article.  ``votes`` has the
        share of pages that show the same line outside theirs, if there are such pages,
        ``headings`` whether one of these shows it as a heading."""
        if not lines:
            return []
        odds = self.noise(lines)
        known = [None if v is None else v > 0.5 for v in votes]
        out = [bool(odds[k] > 0 or COMMENT.match(lines[k])) if known[k] is None else bool(known[k]) for k in range(len(lines))]
        keys = [line_key(x) for x in lines]
        title_key = line_key(title or "")
        head = next((k for k, x in enumerate(keys) if x and title_key and (title_key == x or title_key.startswith(x) and ":" in lines[k].replace("：", ":") and len(x) > 8)), None)
        if head is None:
            head = next((k for k in range(len(lines)) if not out[k]), 0)
        else:
            out[head] = False
        for k in range(head):
            out[k] = True
        tail = next((k for k in range(head + 1, len(lines)) if headings[k]), len(lines))
        for k in range(tail, len(lines)):
            out[k] = True
        # a last paragraph whose names no other part of the article has
        body = [k for k in range(head, tail) if not out[k]]
        if len(body) > 3 and known[body[-1]] is None and body[-1] + 1 < len(lines):
            own = self.names(lines[body[-1]])
            rest = set().union(*(self.names(lines[k]) for k in body[:-1]))
            if len(own) >= 1 and not own & rest:
                out[body[-1]] = True
        return out


def _hash(key: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(key) - (1 << 63)


UNITS = "id long, site long, head long, line_no long, block int, key long, like long, against int, line string, heading boolean, words array<string>"


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of the texts of (id, site, html, text), with the block that shows each, and the blocks that no line shows.

    ``key`` and ``like`` are hashes of the text and of its :func:`repeat_key`, ``head`` of the page's headline.
    A page's first row has the capitalised ``words`` of the page's lines if it has html."""
    from linkspark.llm.languages import TOKEN as WORD

    names = [x.split()[0] for x in UNITS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.list_(pa.string())]
    for batch in batches:
        rows: list[tuple] = []
        for doc, site, html, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            source, text = html.as_py(), text.as_py() or ""
            shown = blocks(source) if source and source.strip() else []
            against, at = evidence(shown), headline_of(shown)
            # a page without headline stands for itself
            own = [line_key(b.text) for b in shown]
            head = _hash(own[at]) if at is not None else doc
            found = matched(shown, text, own)
            words = sorted(filter(NAME.fullmatch, set().union(*(WORD.findall(line) for _, line, _ in found)))) if source else None
            facts = []
            for k, b in enumerate(shown):
                like = repeat_key(b, kind_of(b))
                facts.append((k, _hash(own[k]), _hash(like), against[k] if k != at else min(against[k], 0), None, b.tag in HEADINGS[1:]))
            for n, line, k in found:
                rows.append((doc, site, head, n, *(facts[k] if k is not None else (None, _hash(line_key(line)), None, None, line, False)), words))
                words = None
            for k in set(range(len(shown))).difference(k for _, _, k in found):
                rows.append((doc, site, head, None, *facts[k], words))
                words = None
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)


def repeated(units: DataFrame, pages: int, least: int = 3, site_share: float = 0.02, all_share: float = 0.001) -> tuple[DataFrame, DataFrame]:
    """``(site, key)`` of the blocks under ``least`` different headlines and ``site_share`` of all headlines of
    a site, and ``like`` of those under ``least`` and ``all_share`` times ``pages`` headlines anywhere."""
    open_ = units.where("against < 2")
    heads = units.where("words is not null").select("site", "head").distinct().groupBy("site").agg(F.count("*").alias("heads"))
    here = open_.where("site is not null").select("site", "key", "head").distinct().groupBy("site", "key").agg(F.count("*").alias("n")).where(f"n >= {least}")
    here = here.join(heads, "site").where(F.col("n") >= site_share * F.col("heads")).select("site", "key")
    there = open_.select("like", "head").distinct().groupBy("like").agg(F.count("*").alias("n")).where(F.col("n") >= max(least, all_share * pages)).select("like")
    return here, there


def _decider(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            ids, nos, flags = [], [], []
            for doc, title, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                noise = model.page(title, [r["line"] or "" for r in rows], [r["vote"] for r in rows], [r["heading"] for r in rows])
                for r, n in zip(rows, noise):
                    if r["line"] is not None and r["open"]:
                        ids.append(doc)
                        nos.append(r["line_no"])
                        flags.append(not n)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int64()), pa.array(flags, pa.bool_())], ["id", "line_no", "main"])

    return run


def common_words(lines: DataFrame, pages: int) -> set[str]:
    """Capitalised words on more than 3 and more than one in a hundred of all ``pages`` with html.
    Their number is bounded by a hundred times the words of a page."""
    counts = lines.where("words is not null").select(F.explode("words").alias("word")).groupBy("word").count()
    return {r["word"] for r in counts.where(F.col("count") > max(3, 0.01 * pages)).select("word").collect()}


def fit_lines(pages: DataFrame, lines: DataFrame, common: set[str], fit_pages: int = 1500) -> LineModel:
    """The line model of the decided lines of at most ``fit_pages`` pages(page_id, html, text) with html, in the order of a hash of their id."""
    rows = bounded_sample(pages.where("length(html) > 0 and length(text) > 0").select("page_id", "text"), "page_id", fit_pages)
    chosen = pages.sparkSession.createDataFrame([(r["page_id"],) for r in rows], "id long")
    flags = {(r["id"], r["line_no"]): r["main"] for r in lines.where("main is not null").join(F.broadcast(chosen.distinct()), "id").select("id", "line_no", "main").collect()}
    labelled = [(line, flags[r["page_id"], k]) for r in rows for k, line in enumerate(r["text"].split("\n"), 1) if (r["page_id"], k) in flags]
    return LineModel(labelled, common)


def _decided(own: DataFrame) -> tuple[DataFrame, int]:
    """The units of pages with ``main``, null for lines that no block shows, and the number of pages with html."""
    site = F.xxhash64("domain_id") if "domain_id" in own.columns else F.lit(None).cast("long")
    units = materialise(own.select(F.col("page_id").cast("long").alias("id"), site.alias("site"), "html", "text").mapInArrow(_units, UNITS), "units")
    n = units.where("words is not null").count()
    here, there = repeated(units, n)
    joined = units.join(here.withColumn("here", F.lit(True)), ["site", "key"], "left").join(there.withColumn("there", F.lit(True)), "like", "left")
    often = F.coalesce("here", F.lit(False)) | F.coalesce("there", F.lit(False))
    # the headline itself has 0 or less against it, whatever repeats it
    main = F.when(F.col("against").isNotNull(), F.col("against") + F.when(often, 2).otherwise(0) < 2)
    return materialise(joined.select("id", "line_no", "block", "key", main.alias("main"), "line", (F.col("heading") & ~main).alias("heading"), "words"), "decided"), n


def line_roles(pages: DataFrame, fit_pages: int = 1500) -> DataFrame:
    """(id, line_no, main) of each non-blank line of ``pages(page_id, title, html, text)``; a column ``domain_id``
    tells sites apart.

    Lines count from 1.  Rows with a null id or text are left out; a null, empty or
    broken html leaves the decision to the line model, as it does for single lines
    that no block matches.  Repeated rows give repeated lines; other columns are ignored."""
    own = pages.where("page_id is not null and text is not null")
    units, n = _decided(own)
    return _roles(own, units.where("line_no is not null"), n, fit_pages)


def _renderer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, body) of (id, html, keep): the kept blocks as rendered."""
    for b in batches:
        bodies = []
        for html, keep in zip(b.column(1), b.column(2).to_pylist()):
            wanted = set(keep)
            bodies.append(render_blocks([x for k, x in enumerate(blocks(html.as_py())) if k in wanted]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bodies, pa.string())], ["id", "body"])


def main_texts(pages: DataFrame, fit_pages: int = 1500) -> DataFrame:
    """(id, text) of each of ``pages(page_id, title, html, text)``: its article, as rendered from
    its html or, where that is null, empty or broken, the lines of its text that belong to it.

    ``page_id`` is taken for unique; rows without are left out.  A page without article
    has an empty text."""
    own = pages.where("page_id is not null")
    units, n = _decided(own)
    # broken html shows no line of the text
    whole = units.groupBy("id").agg(
        F.collect_set(F.when(F.col("main"), F.col("block"))).alias("keep"), F.max(F.col("block").isNotNull() & F.col("line_no").isNotNull()).alias("shows"), F.max(F.col("line_no").isNotNull()).alias("lines"))
    whole = whole.where("(shows or not lines) and size(keep) > 0").select("id", "keep")
    bodies = own.select(F.col("page_id").cast("long").alias("id"), "html").join(whole, "id").select("id", "html", "keep").mapInArrow(_renderer, "id long, body string")
    # pages without a body, with the lines that no block decides: all of them where there is no html
    lines = units.where("line_no is not null")
    bare = lines.where("line is not null").select("id", "line_no", "line").join(whole.select("id"), "id", "left_anti")
    kept = bare.join(_roles(own.where("text is not null"), lines, n, fit_pages).where("main").select("id", "line_no"), ["id", "line_no"])
    joined = kept.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("line_no", F.trim("line").alias("line")))).alias("rows"))
    texts = bodies.unionByName(joined.select("id", F.array_join(F.col("rows.line"), "\n\n").alias("body"))).groupBy("id").agg(F.max("body").alias("text"))
    return own.select(F.col("page_id").cast("long").alias("id")).distinct().join(texts, "id", "left").select("id", F.coalesce("text", F.lit("")).alias("text"))


def _roles(own: DataFrame, lines: DataFrame, n: int, fit_pages: int) -> DataFrame:
    shared = own.sparkSession.sparkContext.broadcast(fit_lines(own, lines, common_words(lines, n), fit_pages))
    known = lines.where("main is not null").select("id", "line_no", "main")
    open_pages = lines.where("main is null").select("id").distinct()
    left = lines.join(open_pages, "id", "left_semi").select("id", "line_no", "key", "main", "line")
    # how the same line stands on pages whose html tells, over the whole corpus
    votes = lines.where("main is not null").join(left.where("main is null").select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.avg(F.when(F.col("main"), 0.0).otherwise(1.0)).alias("vote"), F.max("heading").alias("heading"))
    titles = own.select(F.col("page_id").cast("long").alias("id"), "title").groupBy("id").agg(F.min("title").alias("title"))
    row = F.struct("line_no", "line", F.when(F.col("main").isNull(), F.col("vote")).otherwise(F.when(F.col("main"), 0.0).otherwise(1.0)).alias("vote"), F.col("main").isNull().alias("open"), (F.col("main").isNull() & F.coalesce("heading", F.lit(False))).alias("heading"))
    grouped = left.join(votes, "key", "left").groupBy("id").agg(F.array_sort(F.collect_list(row)).alias("rows")).join(titles, "id", "left").select("id", "title", "rows")
    return known.unionByName(grouped.mapInArrow(_decider(shared), "id long, line_no long, main boolean"))
