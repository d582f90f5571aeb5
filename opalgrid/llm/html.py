"""HTML to text by layout: a tree with implied tags, rules of visibility, and a renderer.

All visible text comes out, navigation and footers too. What is hidden is told by tags, the ``hidden`` attribute, closed ``details``, inline styles, and rules
of ``style`` elements whose selectors are simple (names, classes, ids, without combinators); ``visibility`` is inherited, and may be visible again further in. Blocks are on lines of their own, with an empty line where
browsers have a margin; lists are marked and indented; the cells of a table are aligned; preformatted text keeps
its white space. Neither the builder nor the renderer recurses, so depth is bounded by memory alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import read_table, small_batches

#: Fixed values of HTML: elements without content, and which start tags end which open elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title iframe canvas audio video datalist dialog".split())
#: In a drawing or a formula: what is described, defined or annotated, and not shown in place.
UNDRAWN = frozenset("desc defs metadata symbol clippath mask pattern marker annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
MARGINS = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr menu ol p pre table ul".split())
ENDS_P = BLOCKS - frozenset("body caption dd dt html legend li optgroup option tbody td tfoot th thead tr".split()) | frozenset(["li", "dd", "dt"])
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
#: A start tag closes the nearest of the first set that is open, unless one of the second stands above it.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"optgroup", "option"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "caption": ({"caption"}, {"table"}),
}
SCOPE = frozenset(["table", "td", "th", "caption", "html", "button", "object"])
_SPACE = re.compile(r"[ \t\n\r\f]+")
_SHOWING = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?\s*(?=;|$)", re.IGNORECASE)
_SIMPLE = re.compile(r"(\*|[a-z][a-z0-9-]*)?((?:[.#][a-z_-][a-z0-9_-]*)*)", re.IGNORECASE)
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.DOTALL)
#: Media of style sheets that hold for what is shown.
_SHOWN_MEDIA = frozenset(("", "all", "screen"))


@dataclass(frozen=True)
class Rule:
    """What a simple selector says of display or visibility; of several, the last of the greatest weight holds."""

    tag: str
    ids: frozenset[str]
    classes: frozenset[str]
    name: str
    value: str
    weight: tuple


class Rules:
    """Rules by what an element must have: an id, a class, or else a tag."""

    def __init__(self, rules: list[Rule] = ()) -> None:
        self.by: dict[tuple[str, str], list[Rule]] = {}
        for r in rules:
            key = ("#", min(r.ids)) if r.ids else (".", min(r.classes)) if r.classes else ("", r.tag)
            self.by.setdefault(key, []).append(r)

    def of(self, node: Node) -> Iterator[Rule]:
        own, id_ = frozenset((node.attrs.get("class") or "").split()), node.attrs.get("id")
        for key in (("#", id_), ("", node.tag), ("", "*"), *((".", c) for c in own)):
            for r in self.by.get(key, ()):
                if r.tag in ("*", node.tag) and r.classes <= own and (not r.ids or r.ids == {id_}):
                    yield r


def _declared(style: str) -> list[tuple[str, str, bool]]:
    return [(n.lower(), v.lower(), bool(i)) for n, v, i in _SHOWING.findall(style)]


def style_rules(css: str) -> list[Rule]:
    """Rules on display and visibility in a style sheet; other at-rules than media of screens, and selectors with combinators, are passed over."""
    css, out, at = _COMMENT.sub(" ", css), [], 0
    ends: list[bool] = []  # of the blocks that are open: whether they hold
    while at < len(css):
        opening, closing = css.find("{", at), css.find("}", at)
        if closing >= 0 and (opening < 0 or closing < opening):
            if ends:
                ends.pop()
            at = closing + 1
            continue
        if opening < 0:
            break
        head = css[at:opening].rsplit(";", 1)[-1].strip()
        at = opening + 1
        if head.startswith("@"):
            name, _, media = head[1:].partition(" ")
            ends.append(all(ends) and name.lower() in ("media", "supports", "layer") and (name.lower() != "media" or any(m.strip().lower() in _SHOWN_MEDIA for m in media.split(","))))
            continue
        end = css.find("}", at)
        body, at = css[at : end if end >= 0 else len(css)], (end + 1 if end >= 0 else len(css))
        declared = _declared(body) if all(ends) else ()
        for selector in head.split(",") if declared else ():
            found = _SIMPLE.fullmatch(selector.strip())
            if not found or not selector.strip():
                continue
            parts = re.findall(r"([.#])([^.#]+)", found[2])
            ids, classes = frozenset(v for k, v in parts if k == "#"), frozenset(v for k, v in parts if k == ".")
            tag = (found[1] or "*").lower()
            for name, value, important in declared:
                out.append(Rule(tag, ids, classes, name, value, (important, False, len(ids), len(classes), tag != "*", len(out))))
    return out
_PRE = re.compile(r"(?:^|;)\s*white-space\s*:\s*pre", re.IGNORECASE)


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None] | None = None) -> None:
        self.tag, self.attrs = tag, attrs or {}
        self.children: list[Node | str] = []


class TreeBuilder(HTMLParser):
    """A tree of any text: unclosed, misplaced and unknown tags are put right or passed over."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open = [self.root]
        self.places: dict[str, list[int]] = {"html": [0]}  # of the open elements of each tag
        self.css: list[str] = []

    def _push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.open))
        self.open.append(node)

    def _pop(self) -> Node:
        node = self.open.pop()
        self.places[node.tag].pop()
        return node

    def _close(self, tags, barrier) -> None:
        """Close the nearest open element of ``tags``, with all in it, unless one of ``barrier`` is nearer."""
        at = max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)
        if not at:
            return
        if len(self.open) - at < 16:
            if any(node.tag in barrier for node in self.open[at + 1 :]):
                return
        elif any(self.places.get(t) and self.places[t][-1] > at for t in barrier):
            return
        while len(self.open) > at:
            self._pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if self.places.get("head") and tag not in HIDDEN and tag not in ("meta", "link", "base", "head"):
            self._close({"head"}, ())  # content ends the head
        if tag == "body":
            return
        if tag in ENDS_P:
            self._close({"p"}, SCOPE)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in ("td", "th") and self.places.get("table") and self.open[-1].tag in ("table", "tbody", "thead", "tfoot"):
            self._push(Node("tr"))
        found: dict[str, str | None] = {}
        for k, v in attrs:
            found.setdefault(k, v)
        if tag in UNDRAWN and self._foreign():
            found["hidden"] = ""
        node = Node(tag, found)
        if tag in VOID:
            self.open[-1].children.append(node)
        else:
            self._push(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self._foreign() and self.open[-1].tag == tag and tag not in VOID:
            self._pop()

    def _foreign(self) -> bool:
        """Whether a drawing or a formula is open: there a stroke ends an element."""
        return bool(self.places.get("svg") or self.places.get("math"))

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        if tag == "p" and not self.places.get("p"):
            self.open[-1].children.append(Node("p"))
        elif tag == "br":
            self.open[-1].children.append(Node("br"))
        else:
            # a formatting end tag doesn't reach out of its block, nor any tag out of its cell
            barrier = BLOCKS if tag in FORMATTING else SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {tag}
            self._close({tag}, barrier)

    def handle_data(self, data: str) -> None:
        if self.places.get("head") and data.strip() and self.open[-1].tag == "head":
            self._close({"head"}, ())
        last = self.open[-1]
        if last.tag == "style" and (last.attrs.get("media") or "").strip().lower() in _SHOWN_MEDIA:
            self.css.append(data)
        last.children.append(data)


def parse(html: str | None) -> tuple[Node, Rules]:
    """The tree of a page, and the rules of its style elements."""
    builder = TreeBuilder()
    builder.feed(html or "")
    builder.close()
    return builder.root, Rules(style_rules("\n".join(builder.css)) if builder.css else [])


def declared(node: Node, rules: Rules) -> dict[str, str]:
    """The display and visibility that styles give an element."""
    style = node.attrs.get("style")
    held: dict[str, tuple[tuple, str]] = {}
    for name, value, important in _declared(style) if style else ():
        held[name] = max(held.get(name, ((), "")), ((important, True), value))
    for r in rules.of(node) if rules.by else ():
        held[r.name] = max(held.get(r.name, ((), "")), (r.weight, r.value))
    return {name: value for name, (_, value) in held.items()}


def displayed(node: Node, display: str | None) -> bool:
    """Whether an element has a place on the page, by its tag, ``type=hidden``, what styles give for display, and ``hidden``."""
    if node.tag in HIDDEN and not (node.tag == "dialog" and "open" in node.attrs):
        return False
    if node.tag == "input" and (node.attrs.get("type") or "text").lower() not in ("submit", "button", "reset"):
        return False
    if display is not None:
        return display != "none"
    return "hidden" not in node.attrs or (node.attrs["hidden"] or "").lower() == "until-found"


def _width(text: str) -> int:
    """Columns that a text takes: wide characters two, combining ones none."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Canvas:
    """Lines of a block: inline text is collapsed until a line ends; empty lines are asked for, never doubled."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.space = self.gap = False
        self.prefix = [""]  # of the lines of each open block
        self.marker: str | None = None  # stands in place of the prefix' end, once

    def text(self, data: str, pre: bool) -> None:
        if pre:
            first, *rest = data.replace("\r\n", "\n").split("\n")
            self._inline(first)
            for line in rest:
                self.end_line(True)
                self._inline(line)
            return
        parts = _SPACE.sub(" ", data)
        if parts.startswith(" "):
            self.space = True
        core = parts.strip(" ")
        if core:
            self._inline((" " if self.space and self.inline else "") + core)
            self.space = parts.endswith(" ")

    def _inline(self, text: str) -> None:
        if text:
            self.inline.append(text)

    def end_line(self, forced: bool = False) -> None:
        """End the line, if it has text or is forced to stand as an empty one."""
        line, self.inline, self.space = "".join(self.inline).rstrip(" "), [], False
        if line or forced:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            if line:
                self.lines.append(self._lead() + line)
            elif self.lines:
                self.lines.append("")

    def _lead(self) -> str:
        lead = "".join(self.prefix)
        if self.marker is not None:
            lead = lead[: len(lead) - len(self.marker)] + self.marker
            self.marker = None
        return lead

    def margin(self) -> None:
        self.end_line()
        self.gap = True

    def add(self, lines: list[str]) -> None:
        self.end_line()
        for line in lines:
            if line or self.lines:
                if self.gap and self.lines:
                    self.lines.append("")
                self.gap = False
                self.lines.append((self._lead() + line).rstrip(" "))

    def result(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _span(cell: Node, name: str) -> int:
    raw = (cell.attrs.get(name) or "1").strip()
    if not (raw.isascii() and raw.isdigit()):
        return 1
    # the limits of HTML; a cell over 0 rows goes to the end of its group
    n = int(raw[:9])
    return min(1000, max(1, n)) if name == "colspan" else min(65534, n or 65534)


def align(rows: list[list[tuple[list[str], int]]]) -> list[str]:
    """Lines of a table whose cells are (lines, columns); columns are as wide as their widest single cell."""
    widths: list[int] = []
    for row in rows:
        at = 0
        for lines, span in row:
            widths += [0] * (at + span - len(widths))
            if span == 1:
                widths[at] = max([widths[at], *map(_width, lines)])
            at += span
    for row in rows:  # what a cell over several columns lacks, its last column gets
        at = 0
        for lines, span in row:
            have = sum(widths[at : at + span]) + 3 * (span - 1)
            widths[at + span - 1] += max(0, max(map(_width, lines), default=0) - have)
            at += span
    out = []
    for row in rows:
        for i in range(max((len(lines) for lines, _ in row), default=0)):
            parts, at = [], 0
            for lines, span in row:
                line = lines[i] if i < len(lines) else ""
                parts.append(line + " " * (sum(widths[at : at + span]) + 3 * (span - 1) - _width(line)))
                at += span
            out.append(" | ".join(parts).rstrip())
    return out


class _Table:
    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int]]] = []
        self.hanging: dict[int, tuple[int, int]] = {}  # column: rows that a cell from above still covers, columns

    def row(self) -> None:
        self.rows.append([])
        self._covered()

    def _column(self) -> int:
        return sum(s for _, s in self.rows[-1])

    def _covered(self) -> None:
        while (at := self._column()) in self.hanging:
            left, span = self.hanging.pop(at)
            self.rows[-1].append(([], span))
            if left > 1:
                self.hanging[-at - 1] = (left - 1, span)  # for the next row

    def cell(self, lines: list[str], columns: int, rows: int) -> None:
        if not self.rows:
            self.row()
        at = self._column()
        self.rows[-1].append((lines, columns))
        if rows > 1:
            self.hanging[-at - 1] = (rows - 1, columns)
        self._covered()

    def end_row(self) -> None:
        for k in [k for k in self.hanging if k < 0]:
            self.hanging[-k - 1] = self.hanging.pop(k)


def render(root: Node, rules: Rules) -> str:
    """The visible text of a tree."""
    canvas, canvases, tables = Canvas(), [], []
    counters: list[list] = []  # of open lists: kind and next number
    pre = 0
    shown = [True]  # the visibility of open elements
    stack: list[tuple[str, Node | str]] = [("enter", root)]
    while stack:
        step, node = stack.pop()
        if isinstance(node, str):
            if shown[-1]:
                canvas.text(node, pre > 0)
            continue
        tag = node.tag
        is_pre = tag in ("pre", "textarea", "listing") or bool(node.attrs.get("style") and _PRE.search(node.attrs["style"] or ""))
        if step == "enter":
            style = declared(node, rules)
            if not displayed(node, style.get("display")):
                continue
            sees = shown[-1]
            if style.get("visibility", "inherit") not in ("inherit", "unset"):
                sees = style["visibility"] not in ("hidden", "collapse")
            if tag == "br":
                canvas.end_line(True)
                continue
            if tag == "hr":
                canvas.margin()
                continue
            if tag in ("img", "input"):
                if sees:
                    canvas.text(node.attrs.get("alt" if tag == "img" else "value") or "", False)
                continue
            shown.append(sees)
            if tag in MARGINS and not (tag in ("ul", "ol", "menu", "dl") and counters):
                canvas.margin()
            elif tag in BLOCKS:
                canvas.end_line()
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attrs.get("start") or "1"
                counters.append([tag, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif tag == "li":
                kind = counters[-1] if counters else ["ul", 1]
                mark = "- "
                if kind[0] == "ol":
                    value = node.attrs.get("value") or ""
                    if re.fullmatch(r"-?[0-9]{1,9}", value):
                        kind[1] = int(value)
                    mark = f"{kind[1]}. "
                    kind[1] += 1
                canvas.prefix.append(" " * len(mark))
                canvas.marker = mark if sees else None
            elif tag in ("dd", "blockquote"):
                canvas.prefix.append("  ")
            elif tag == "table":
                tables.append(_Table())
                canvases.append(canvas)
                canvas = Canvas()  # text of the table outside of cells
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th", "caption") and tables:
                canvases.append(canvas)
                canvas = Canvas()
            pre += is_pre
            stack.append(("leave", node))
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if is_pre and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            stack.extend(("enter", c) for c in reversed(children))
            continue
        pre -= is_pre
        shown.pop()
        if tag == "li":
            canvas.end_line()
            canvas.prefix.pop()
            canvas.marker = None
        elif tag in ("dd", "blockquote"):
            canvas.end_line()
            canvas.prefix.pop()
        elif tag in ("ul", "ol", "menu", "dir"):
            counters.pop()
        elif tag == "tr" and tables:
            tables[-1].end_row()
        elif tag in ("td", "th") and tables:
            lines, canvas = canvas.result(), canvases.pop()
            tables[-1].cell(lines, _span(node, "colspan"), _span(node, "rowspan"))
        elif tag == "caption" and tables:
            lines, canvas = canvas.result(), canvases.pop()
            canvas.add(lines)
        elif tag == "table":
            outside, canvas = canvas.result(), canvases.pop()
            canvas.add(outside + align(tables.pop().rows))
        if tag in MARGINS and not (tag in ("ul", "ol", "menu", "dl") and counters):
            canvas.margin()
        elif tag in BLOCKS:
            canvas.end_line()
    return "\n".join(canvas.result())


def extract(html: str | None) -> str:
    """The visible text of a page; empty for null, empty and invisible ones."""
    return render(*parse(html)).replace("\xa0", " ")


def with_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the visible text of each.

    Null and empty html give empty text, html of any length is read whole, and every row stays, repeated ones too. An input column named ``out`` is replaced, all
    others pass through, whatever their names. An empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    at = pages.columns.index(html_col)
    keep = [i for i, c in enumerate(pages.columns) if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h) for h in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(texts, pa.string())], names=[*[batch.schema.names[i] for i in keep], "text"])

    # plain names inside: those of the input may have dots
    plain = pages.toDF(*[f"c{i}" for i in range(len(pages.columns))])
    return plain.mapInArrow(run, plain.select(*[f"c{i}" for i in keep]).schema.add("text", "string")).toDF(*[pages.columns[i] for i in keep], out)


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    """One row per page: page_id, url, its visible text, and the text's characters and lines."""
    out = with_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    lines = F.when(F.col("text") == "", 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"))) + 1)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), lines.cast("long").alias("n_lines"))
