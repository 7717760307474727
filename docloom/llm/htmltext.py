"""Operator 2: layout-aware extraction of a page's visible text.

The page's tree (void elements, implied end tags, reopened formatting) is rendered by rules like a
browser's default style: invisible elements go, blocks start new lines, paragraphs and headings are set
off by an empty line, list items have a bullet or their number and nested lists are indented, the cells
of a table are padded to columns (cells over several rows and columns keep their places), preformatted text
keeps its blanks. Nothing else visible is dropped: navigation, notes and footers stay.

Visibility: the ``hidden`` attribute, ``display`` and ``visibility`` in ``style`` attributes, and in ``<style>``
rules whose selectors name an element, classes and an id, without ancestors or states (at-rules are left out).
A rule of higher specificity wins, then the later one, attributes before rules. ``visibility`` is
inherited: a visible element inside a hidden one shows. Of closed ``<details>`` only the summary shows.
Scripts do not run, so ``<noscript>`` shows.

A null page gives a null text, a page without visible text an empty one. Text outside any element, in
elements that are never closed and behind unknown tags is visible. Numbers that are none, or of more than
nine digits, count as absent.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.html.tree import BLOCKS, HEADINGS, Node, parse

#: Elements that a browser does not show.
INVISIBLE = frozenset(
    "area audio base canvas col colgroup datalist embed head iframe link meta noembed noframes object param script source style template title track video".split()
)
#: Set off by an empty line; other blocks only start a line.
SPACED = HEADINGS | frozenset("blockquote dl figure ol p pre table ul".split())
_LINES = BLOCKS | frozenset("body caption dd dt html legend li optgroup option tbody tfoot thead tr".split())
_BLANKS = re.compile("[ \t\n\r\f]+")
_NUMBER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})(?![0-9])")
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.DOTALL)
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
_SELECTOR = re.compile(r"([a-z][a-z0-9-]*)?((?:[.#][\w-]+)*)", re.IGNORECASE)


def number(text: str | None) -> int | None:
    """The integer that an attribute begins with."""
    found = _NUMBER.match(text or "")
    return int(found[1]) if found else None


def _declared(source: str) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in _DECLARED.findall(source)}


class Styles:
    """What a page's ``<style>`` elements say of ``display`` and ``visibility``, by the selectors' last name."""

    def __init__(self, root: Node):
        self.rules: dict[str, list[tuple]] = {}
        order, todo = 0, [root]
        while todo:
            node = todo.pop()
            if node.tag == "style":
                for selectors, told in _rules(_COMMENT.sub(" ", node.text())):
                    order += 1
                    for one in selectors.split(","):
                        self._add(one.strip(), told, order)
            todo.extend(x for x in reversed(node.children) if isinstance(x, Node))

    def _add(self, selector: str, told: dict[str, str], order: int) -> None:
        found = _SELECTOR.fullmatch(selector)
        if not found or not selector:
            return
        tag, marks = (found[1] or "").lower(), re.findall(r"[.#][\w-]+", found[2])
        weight = (sum(m[0] == "#" for m in marks), sum(m[0] == "." for m in marks), bool(tag))
        self.rules.setdefault(marks[-1] if marks else tag, []).append((weight, order, tag, frozenset(marks), told))

    def of(self, node: Node) -> dict[str, str]:
        """The ``display`` and ``visibility`` that rules and the element's own attribute give it."""
        told: dict[str, str] = {}
        if self.rules:
            marks = {f".{x}" for x in node.attrs.get("class", "").split()} | {f"#{x}" for x in (node.attrs.get("id"),) if x}
            fits = [r for k in (node.tag, *marks) for r in self.rules.get(k, ()) if r[2] in ("", node.tag) and r[3] <= marks]
            for r in sorted(fits, key=lambda r: r[:2]):
                told |= r[4]
        return told | _declared(node.attrs["style"]) if "style" in node.attrs else told


def _rules(source: str):
    """(selectors, declarations) of the rules outside at-rules."""
    at, depth, begin, left_out = 0, 0, 0, False
    for brace in re.finditer(r"[{};]", source):
        if brace[0] == ";":
            if depth == 0:
                begin = brace.end()
            continue
        if brace[0] == "{":
            if depth == 0:
                name, at = source[begin : brace.start()].strip(), brace.end()
                left_out = name.startswith("@")
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                if not left_out and (told := _declared(source[at : brace.start()])):
                    yield name, told
                begin = brace.end()
        else:
            begin = brace.end()


def width(text: str) -> int:
    """Columns on a terminal: wide characters take two."""
    return len(text) if text.isascii() else sum(2 if unicodedata.east_asian_width(c) in "WF" else not unicodedata.combining(c) for c in text)


class _Page:
    """Lines that are being set; ``prefix`` indents them, ``mark`` stands before the next one.

    ``shown`` is false inside elements of hidden visibility.
    """

    def __init__(self, styles: Styles, shown: bool = True):
        self.styles, self.shown = styles, shown
        self.lines: list[str] = []
        self.line: list[str] = []
        self.prefix, self.mark = "", None
        self.gap = False

    def put(self, text: str) -> None:
        if not self.shown:
            return
        text = _BLANKS.sub(" ", text)
        if not self.line or self.line[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            self.line.append(text)

    def enter(self, node: Node) -> bool:
        """Whether anything of an element can show; sets ``shown`` for what is inside."""
        if node.tag in INVISIBLE:
            return False
        if node.tag == "input" and node.attrs.get("type", "").lower() not in ("submit", "button", "reset"):
            return False
        told = self.styles.of(node)
        display, visibility = told.get("display"), told.get("visibility")
        if display == "none" or ("hidden" in node.attrs and display is None):
            return False
        if visibility == "visible":
            self.shown = True
        elif visibility in ("hidden", "collapse"):
            self.shown = False
        return True

    def end_line(self, gap: bool = False) -> None:
        text = "".join(self.line).rstrip(" ")
        self.line = []
        if text:
            self.place(text)
        self.gap = self.gap or gap

    def place(self, text: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        mark, self.mark = self.mark, None
        self.lines.append((self.prefix[: -len(mark)] + mark if mark else self.prefix) + text)

    def text(self) -> str:
        self.end_line()
        return "\n".join(x.rstrip() for x in self.lines)


def _run(step) -> None:
    """Runs a rendering step and those that it yields, each to its end before its parent goes on; any depth fits."""
    todo = [step]
    while todo:
        inner = next(todo[-1], None)
        if inner is None:
            todo.pop()
        else:
            todo.append(inner)


def _render(node: Node, page: _Page, pre: bool):
    follow, step = 0, 1
    if node.tag == "ol":
        if "reversed" in node.attrs:
            step = -1
            follow = sum(isinstance(x, Node) and x.tag == "li" for x in node.children) + 1
        start = number(node.attrs.get("start"))
        follow = follow if start is None else start - step
    closed = node.tag == "details" and "open" not in node.attrs
    summary = next((x for x in node.children if isinstance(x, Node) and x.tag == "summary"), None) if closed else None
    for x in node.children:
        if closed and x is not summary:
            continue
        if not isinstance(x, Node):
            if not pre:
                page.put(x)
            elif page.shown:
                first, *rest = x.split("\n")
                page.line.append(first)
                for line in rest:
                    page.place("".join(page.line))
                    page.line = [line]
            continue
        tag, shown = x.tag, page.shown
        if not page.enter(x):
            continue
        if tag == "br":
            if page.line:
                page.end_line()
            elif page.shown:
                page.gap = True
        elif tag == "input":
            page.put(x.attrs.get("value", ""))
        elif tag == "table":
            page.end_line(True)
            yield _table(x, page)
            page.gap = True
        elif tag in _LINES:
            nested = tag in ("ul", "ol") and node.tag == "li"
            page.end_line(tag in SPACED and not nested)
            if tag == "li":
                value = number(x.attrs.get("value")) if node.tag == "ol" else None
                follow = follow + step if value is None else value
                mark = f"{follow}. " if node.tag == "ol" else "- "
                old, page.prefix, page.mark = page.prefix, page.prefix + " " * len(mark), mark
                yield _render(x, page, pre)
                page.end_line()
                page.prefix, page.mark = old, None
            elif tag in ("blockquote", "dd"):
                old, page.prefix = page.prefix, page.prefix + "  "
                yield _render(x, page, pre)
                page.end_line()
                page.prefix = old
            elif tag != "hr":
                yield _render(x, page, pre or tag in ("pre", "textarea"))
            page.end_line(tag in SPACED and not nested)
        else:
            yield _render(x, page, pre or tag in ("pre", "textarea"))
        page.shown = shown


def _rows(table: Node, page: _Page):
    """(rows, what stands outside of cells); a row is (number of its group, cells as (cell, shown))."""
    rows: list[tuple[int, list]] = []
    outside: list[tuple[Node, bool]] = []
    groups, shown = 0, page.shown
    todo = [(x, shown, 0) for x in reversed(table.children)]
    while todo:
        x, page.shown, group = todo.pop()
        if not isinstance(x, Node):
            if not x.isspace():
                outside.append((_holding("div", x), page.shown))
            continue
        before = page.shown
        if not page.enter(x):
            continue
        if x.tag == "tr":
            own, cells = page.shown, []
            for c in x.children:
                page.shown = own
                if isinstance(c, Node):
                    if page.enter(c):
                        cells.append((c, page.shown))
                elif not c.isspace():
                    cells.append((_holding("td", c), own))
            rows.append((group, cells))
        elif x.tag in ("thead", "tbody", "tfoot"):
            groups += 1
            todo.extend((c, page.shown, groups) for c in reversed(x.children))
        elif x.tag in ("td", "th"):
            rows.append((group, [(x, page.shown)]))
        else:
            outside.append((x, before))
    page.shown = shown
    return rows, outside


def _placed(rows: list[tuple[int, list]]):
    """The first column of each cell, around cells that reach down from rows above."""
    group, reaching = None, []  # (first column, column behind, row behind), in order
    for at, (own, cells) in enumerate(rows):
        reaching = [r for r in reaching if r[2] > at] if own == group else []
        group, column, ahead, new, places = own, 0, 0, [], []
        for cell, _ in cells:
            while ahead < len(reaching) and reaching[ahead][0] <= column:
                column = max(column, reaching[ahead][1])
                ahead += 1
            span, down = number(cell.attrs.get("colspan")), number(cell.attrs.get("rowspan"))
            span = min(span, 1000) if span and span > 0 else 1
            behind = len(rows) if down == 0 else at + (down if down and down > 0 else 1)
            places.append((column, span))
            if behind > at + 1:
                if new and new[-1][1:] == (column, behind):
                    new[-1] = (new[-1][0], column + span, behind)
                else:
                    new.append((column, column + span, behind))
            column += span
        reaching = sorted(reaching + new) if new else reaching
        yield places


def _holding(tag: str, text: str) -> Node:
    node = Node(tag)
    node.children.append(text)
    return node


def _table(table: Node, page: _Page):
    """Sets each row's cells side by side, padded to the widest of their column."""
    rows, outside = _rows(table, page)
    for x, shown in outside:
        old, page.shown = page.shown, shown
        yield _render_alone(x, page)
        page.shown = old
    laid, widths, wide = [], {}, []
    for (_, row), places in zip(rows, _placed(rows), strict=True):
        cells = []
        for (cell, shown), (column, span) in zip(row, places, strict=True):
            own = _Page(page.styles, shown)
            yield _render(cell, own, False)
            lines = [x for x in own.text().split("\n") if x]
            widest = max(map(width, lines), default=0) if span == 1 else 0
            widths[column] = max(widths.get(column, 0), widest)
            if span > 1 and lines and column != places[-1][0]:
                wide.append((column, column + span, max(map(width, lines))))
            cells.append((column, lines))
        laid.append(cells)
    columns, starts = sorted(widths), [0]
    for low, high, needed in wide:
        # What a cell over several columns lacks, its last column gets, so that the next cell stays aligned.
        own = columns[bisect_left(columns, low) : bisect_left(columns, high)]
        widths[own[-1]] += max(0, needed - sum(widths[c] + 2 for c in own if widths[c]) + (2 if widths[own[-1]] else 0))
    for column in columns:
        starts.append(starts[-1] + (widths[column] + 2 if widths[column] else 0))
    for cells in laid:
        for k in range(max((len(lines) for _, lines in cells), default=0)):
            line = ""
            for column, lines in cells:
                if k < len(lines):
                    start = starts[bisect_left(columns, column)]
                    line += " " * max(start - width(line), 1 if line else 0) + lines[k]
            page.place(line)


def _render_alone(node: Node, page: _Page):
    holder = Node("div")
    holder.children.append(node)
    yield _render(holder, page, False)
    page.end_line()


def visible_text(html: str | None) -> str | None:
    if html is None:
        return None
    root = parse(html)
    page = _Page(Styles(root if "<style" in html.lower() else Node("#none")))
    _run(_render(root, page, False))
    return page.text()


def _extracted(batches):
    import pyarrow as pa

    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [visible_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], [*part.schema.names[:-1], "text"])


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(``id_col``, text) of each row."""
    rows = pages.select(F.col(id_col), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extracted, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, text string")
