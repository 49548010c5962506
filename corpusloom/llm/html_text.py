"""Visible text of HTML pages, laid out as a browser would order it.

A tree builder reads tags, attributes, comments and raw-text elements, adds the tags that HTML lets
authors leave out (ends of paragraphs, list items, table parts, options, and of all that is still
open when an outer element ends), and marks what is not shown: head matter, scripts, styles,
templates, hidden attributes, ``display:none`` in a style, hidden inputs, closed dialogs, and all but
the summary of closed details. ``visibility`` is handed down, so a visible part of a hidden one is
shown; the hidden rest keeps its place but has no text, numbers or marks. Rendering walks the tree: blank lines
around paragraphs, headings, lists and tables, one line per other block, numbers or marks and
indentation for list items, line breaks, preformatted text as it stands, and cells padded to common
column widths, with spans over columns and, within a part of a table, over rows.

Defined cases: null and empty pages give an empty text; broken markup never fails: a stray ``<`` is
text, a stray quote inside a tag is an ordinary character, an end tag without a start is left out,
unclosed elements end with the page; depth and length are limited by memory alone, since nothing recurses. Pages are independent, so ties and
repeated rows need no rule, and an empty table stays empty. Extra columns stay; those that clash
with the added ones are replaced.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from corpusloom.llm.common import text_of, without

# Attributes as the standard reads them: a quote opens a value right behind ``=`` only, elsewhere it
# is part of a name or of an unquoted value, and ``>`` ends the tag.
BLANK = r" \t\n\r\f"
NAME = rf"[^{BLANK}/>][^{BLANK}/>=]*"
EQUALS = rf"[{BLANK}]*=[{BLANK}]*"
UNQUOTED = rf"""[^{BLANK}>"'][^{BLANK}>]*"""
TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    rf"|<(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[{BLANK}/]+|{NAME}"
    rf"""(?:{EQUALS}(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|{UNQUOTED})?)?)*+)(?:>|\Z)""",
    re.S,
)
ATTRIBUTE = re.compile(rf"""({NAME})(?:{EQUALS}(?:"([^"]*)"?|'([^']*)'?|({UNQUOTED}))?)?""")
NO_BOX = re.compile(r"(?<![\w-])display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|initial|hidden|collapse)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")

# Fixed values of the HTML standard, as far as they matter for text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes plaintext".split())
RAW_TEXT = {"textarea", "title"}
HIDDEN = set("head script style template noscript title iframe noembed noframes object audio video canvas svg math datalist rp".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul caption".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr".split())
LISTS = {"ul", "ol", "menu", "dir"}
CLOSES_P = BLOCK - set("body html td th tr tbody thead tfoot caption option optgroup legend".split())
#: A start tag ends the nearest open element of the first set unless one of the second is nearer.
IMPLIED_END = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
    "body": ({"head"}, {"body"}),
}
#: A start tag that needs a parent gets it: (the parents that will do, the tag that is added).
IMPLIED_START = {
    "tr": ({"tbody", "thead", "tfoot"}, "tbody"),
    "td": ({"tr"}, "tr"),
    "th": ({"tr"}, "tr"),
}
IN_HEAD = set("html head title base link meta script style template noscript".split())
WALLS = {"td", "th", "caption", "table", "html", "body", "button", "object"}


class Node:
    __slots__ = ("tag", "attrs", "children", "shown")

    def __init__(self, tag: str, attrs: dict[str, str], shown: bool):
        self.tag, self.attrs, self.children, self.shown = tag, attrs, [], shown


def _attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def _is_shown(tag: str, attrs: dict[str, str]) -> bool:
    if tag in HIDDEN or "hidden" in attrs or (tag == "dialog" and "open" not in attrs):
        return False
    if tag == "input" and attrs.get("type", "").lower() == "hidden":
        return False
    return not NO_BOX.search(attrs.get("style", ""))


def _is_seen(attrs: dict[str, str], around: bool) -> bool:
    """Visibility: the last value of the style, else that of the element around."""
    told = VISIBILITY.findall(attrs.get("style", ""))
    return told[-1].lower() in ("visible", "initial") if told else around


def build(page: str) -> Node:
    """The tree of a page. Children are nodes and texts."""
    root = Node("html", {}, True)
    stack, opened = [root], Counter()

    def close(tags: set[str], walls: set[str]) -> None:
        """End the nearest open element of ``tags`` and all inside it."""
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                opened.subtract(n.tag for n in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in walls:
                return

    def text(value: str) -> None:
        if value:
            if stack[-1].tag == "head" and value.strip():
                close({"head"}, set())
            stack[-1].children.append(html.unescape(value))

    def start(tag: str, attrs: dict[str, str]) -> None:
        if tag == "html":
            root.attrs |= attrs
            root.shown = root.shown and _is_shown(tag, attrs)
            return
        if tag not in IN_HEAD:
            close({"head"}, {"body"})
        if tag in CLOSES_P:
            close({"p"}, WALLS)
        if tag in IMPLIED_END:
            ended, walls = IMPLIED_END[tag]
            if tag in ("tbody", "thead", "tfoot", "tr"):
                close({"td", "th"}, {"table"})
            if tag in ("tbody", "thead", "tfoot"):
                close({"tr"}, {"table"})
            close(ended, walls)
        if tag in IMPLIED_START:
            parents, added = IMPLIED_START[tag]
            if stack[-1].tag not in parents and any(n.tag == "table" for n in stack[-3:]):
                start(added, {})
        node = Node(tag, attrs, _is_shown(tag, attrs))
        if stack[-1].tag == "details" and "open" not in stack[-1].attrs and tag != "summary":
            node.shown = False
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            opened[tag] += 1

    at = 0
    while m := TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m["cdata"] is not None:
            text(m["cdata"])
        elif m["end"]:
            tag = m["end"].lower()
            if tag == "br":
                start("br", {})
            else:
                close({tag}, {"table"} if tag in ("td", "th", "tr", "li", "p", "tbody", "thead", "tfoot") else set())
        elif m["tag"]:
            tag = m["tag"].lower()
            start(tag, _attributes(m["attrs"]))
            if tag in ("pre", "textarea"):  # a line break right behind the tag is not part of the text
                at += 2 if page.startswith("\r\n", at) else page.startswith("\n", at)
            if tag in RAW or tag in RAW_TEXT:
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
                stop, after = (end.start(), end.end()) if end else (len(page), len(page))
                raw = page[at:stop]
                if stack[-1].tag == tag:
                    stack[-1].children.append(html.unescape(raw) if tag in RAW_TEXT else raw)
                    stack.pop()
                    opened[tag] -= 1
                at = after
    text(page[at:])
    return root


class Lines:
    """Text under construction: words flow into the current line; blocks end it."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.indent, self.mark = "", False, [""], ""

    def words(self, value: str) -> None:
        value = SPACES.sub(" ", value)
        if not value or (value == " " and not self.line):
            return
        if value[0] == " " and (not self.line or self.line.endswith(" ")):
            value = value[1:]
        self.line += value

    def end_line(self, keep_empty: bool = False) -> None:
        line = self.line.rstrip(" ")
        self.line = ""
        if line or keep_empty:
            self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        if self.mark:
            line, self.mark = self.indent[-2] + self.mark + line, ""
        else:
            line = self.indent[-1] + line
        self.lines.append(line.rstrip())

    def blank(self) -> None:
        self.end_line()
        self.gap = True

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def _width(line: str) -> int:
    """Columns of a line: wide characters take two, marks above letters none."""
    if line.isascii():
        return len(line)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in line)


def _places(rows: list[list[tuple[str, int, int]] | None]) -> list[list[tuple[str, int, int]]]:
    """Rows of (text, first column, column behind the last) of rows of (text, columns spanned, rows
    spanned, 0 for all that follow). ``None`` begins a new part of the table, where spans over rows
    end. Columns that no cell begins or ends at are no columns."""
    placed, taken = [], []  # taken: (first column, column behind the last, row it ends before)
    for number, row in enumerate(rows):
        if row is None:
            taken = []
        if not row:
            continue
        taken = [t for t in taken if t[2] > number]
        at, i, cells, down = 0, 0, [], []
        for text, wide, high in row:
            while i < len(taken) and taken[i][0] <= at:
                at = max(at, taken[i][1])
                i += 1
            cells.append((text, at, at + wide))
            if high != 1:
                until = number + high if high else len(rows)
                if down and down[-1][1:] == (at, until):
                    down[-1] = (down[-1][0], at + wide, until)
                else:
                    down.append((at, at + wide, until))
            at += wide
        taken = sorted(taken + down)
        placed.append(cells)
    edges = {c: i for i, c in enumerate(sorted({0} | {c for row in placed for _, *ends in row for c in ends}))}
    return [[(text, edges[start], edges[end]) for text, start, end in row] for row in placed]


def _table(rows: list[list[tuple[str, int, int]] | None]) -> list[str]:
    """Rows of (text, columns spanned, rows spanned) as lines with aligned columns."""
    placed = _places(rows)
    widths = [0] * max((end for row in placed for _, _, end in row), default=0)
    for row in placed:
        for cell, start, end in row:
            if end == start + 1:
                widths[start] = max(widths[start], *(_width(x) for x in cell.split("\n")))
    for row in placed:  # a spanning cell that needs more room widens its last column
        for cell, start, end in row:
            if end > start + 1:
                need = max(_width(x) for x in cell.split("\n")) - (sum(widths[start:end]) + 2 * (end - start) - 2)
                widths[end - 1] += max(0, need)
    begin = [0]
    for width in widths:
        begin.append(begin[-1] + width + 2)
    out = []
    for row in placed:
        parts = [cell.split("\n") for cell, _, _ in row]
        for i in range(max(map(len, parts))):
            line, at = [], 0
            for (_, start, end), lines in zip(row, parts):
                text = lines[i] if i < len(lines) else ""
                pad = max(0, begin[start] - at)
                at += pad + _width(text)
                over = "  " if at >= begin[end] else ""
                at += len(over)
                line.append(" " * pad + text + over)
            out.append("".join(line).rstrip())
    return out


class Frame:
    """An element being rendered: what remains of its children, and the list or table around it."""

    __slots__ = ("node", "rest", "lines", "pre", "seen")

    def __init__(self, node: Node, lines: Lines, pre: bool, seen: bool):
        self.node, self.rest, self.lines, self.pre, self.seen = node, iter(node.children), lines, pre, seen


def render(root: Node) -> str:
    """Visible text of a tree. Cells are rendered on lines of their own and set when the table ends."""
    page = Lines()
    stack = [Frame(root, page, False, _is_seen(root.attrs, True))] if root.shown else []
    lists, tables = [], []
    while stack:
        frame = stack[-1]
        child = next(frame.rest, None)
        lines = frame.lines
        if child is None:
            stack.pop()
            _leave(frame, lists, tables)
        elif isinstance(child, str):
            if not frame.seen or (frame.node.tag == "details" and "open" not in frame.node.attrs):
                continue
            if not frame.pre:
                lines.words(child)
            else:
                head, *more = child.replace("\r\n", "\n").split("\n")
                lines.line += head
                for part in more:
                    lines.end_line(keep_empty=True)
                    lines.line = part
        elif child.shown:
            stack.append(_enter(child, frame, lists, tables))
    return page.text()


def _number(value: str | None, default: int) -> int:
    return int(value) if value is not None and re.fullmatch(r"-?[0-9]{1,9}", value.strip()) else default


def _enter(node: Node, frame: Frame, lists: list, tables: list) -> Frame:
    tag, lines, seen = node.tag, frame.lines, _is_seen(node.attrs, frame.seen)
    if not seen and tag in ("br", "img", "input"):
        pass
    elif tag == "br":
        lines.end_line(keep_empty=True)
    elif tag == "hr":
        lines.blank()
    elif tag == "img":
        lines.words(node.attrs.get("alt", ""))
    elif tag == "input":
        lines.words(node.attrs.get("value", "") if node.attrs.get("type", "text").lower() in ("text", "submit", "button", "reset", "search") else "")
    elif tag in ("td", "th") and tables:
        inner = Lines()
        return Frame(node, inner, False, seen)
    elif tag in BLOCK:
        nested = tag in LISTS and lists
        lines.blank() if tag in SPACED and not nested else lines.end_line()
    out = Frame(node, lines, frame.pre or tag in ("pre", "textarea", "xmp"), seen)
    if tag in LISTS:
        back = tag == "ol" and "reversed" in node.attrs
        items = sum(not isinstance(c, str) and c.tag == "li" for c in node.children) if back else 1
        lists.append([tag == "ol", _number(node.attrs.get("start"), items), -1 if back else 1])
    elif tag == "li":
        ordered, number, step = lists[-1] if lists else (False, 0, 1)
        number = _number(node.attrs.get("value"), number)
        if lists:
            lists[-1][1] = number + step
        lines.mark = f"{number}. " if ordered else "- "
        lines.indent.append(lines.indent[-1] + " " * len(lines.mark))
        if not seen:
            lines.mark = ""
    elif tag in ("blockquote", "dd"):
        lines.indent.append(lines.indent[-1] + "  ")
    elif tag == "table":
        tables.append([])
    elif tag == "tr" and tables:
        tables[-1].append([])
    elif tag in ("tbody", "thead", "tfoot") and tables:
        tables[-1].append(None)
    return out


def _span(value: str | None, most: int, least: int) -> int:
    return max(least, min(most, int(value))) if value is not None and re.fullmatch(r"[0-9]{1,6}", value.strip()) else 1


def _leave(frame: Frame, lists: list, tables: list) -> None:
    tag, lines = frame.node.tag, frame.lines
    if tag in ("td", "th") and tables:
        if not tables[-1] or tables[-1][-1] is None:
            tables[-1].append([])
        attrs = frame.node.attrs
        tables[-1][-1].append((lines.text(), _span(attrs.get("colspan"), 1_000, 1), _span(attrs.get("rowspan"), 65_534, 0)))
        return
    if tag == "tr" and tables and not frame.seen and not any(text for text, _, _ in tables[-1][-1] or []):
        tables[-1][-1] = []
    if tag in BLOCK and tag != "hr":
        lines.end_line()
    if tag == "li":
        if lines.mark:
            lines.put("")
        lines.indent.pop()
    elif tag in ("blockquote", "dd"):
        lines.indent.pop()
    elif tag in LISTS:
        lists.pop()
    elif tag == "table":
        for line in _table(tables.pop()):
            lines.put(line)
    if tag in SPACED and tag != "hr" and not (tag in LISTS and lists):
        lines.gap = True


def visible_text(page: str) -> str:
    return render(build(page))


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with ``text`` (visible text) and ``n_lines``."""

    @F.pandas_udf("string")
    def shown(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([visible_text(p) for p in batch], dtype=object)

    out = without(pages, "text", "n_lines") if column not in ("text", "n_lines") else pages
    out = out.withColumn("text", shown(text_of(column)))
    return out.withColumn("n_lines", F.when(F.col("text") == "", F.lit(0)).otherwise(F.size(F.split("text", "\n"))))
