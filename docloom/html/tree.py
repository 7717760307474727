"""A tree builder for HTML as it is found: void elements, implied end tags, raw text, reopened formatting.

It follows the outcome of the HTML standard's error recovery for the cases that matter in text: a block
closes an open paragraph, items and cells close their predecessors, an end tag closes what stands open
inside its element, and formatting that a block cut short goes on in the next one. Frames, foster
parenting and scripts that write are left out.
"""

from __future__ import annotations

import re
from html import unescape

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
RAW_WITH_ENTITIES = frozenset("textarea title".split())
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
BLOCKS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element that a start tag closes, and where the search for it ends.
_SCOPE = frozenset("applet caption html table td th marquee object template button".split())
_CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu table td th".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "dd": (frozenset(["dt", "dd"]), frozenset("dl table td th".split())),
    "td": (frozenset(["td", "th"]), frozenset(["table"])),
    "th": (frozenset(["td", "th"]), frozenset(["table"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot caption colgroup".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")


class Node:
    """An element: ``children`` holds nodes and strings."""

    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def find(self, tag: str) -> Node | None:
        """The first element of that name below, in document order."""
        todo = list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                if x.tag == tag:
                    return x
                todo.extend(reversed(x.children))
        return None

    def text(self) -> str:
        """All text below."""
        out, todo = [], list(reversed(self.children))
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                todo.extend(reversed(x.children))
            else:
                out.append(x)
        return "".join(out)


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(values[0] or values[1] or values[2]))
    return out


class _Builder:
    def __init__(self):
        self.root = Node("#root")
        self.stack = [self.root]
        self.active: list[Node] = []

    def close(self, tags: frozenset, stop: frozenset) -> None:
        """Pops up to and including the innermost of ``tags``, unless ``stop`` comes first."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                del self.stack[k:]
                return
            if self.stack[k].tag in stop:
                return

    def reopen(self) -> None:
        """Formatting that was not ended, but whose element a block has closed, goes on here."""
        if not self.active or self.active[-1] in self.stack:
            return
        for k, old in enumerate(self.active):
            if old not in self.stack:
                new = Node(old.tag, old.attrs)
                self.stack[-1].children.append(new)
                self.stack.append(new)
                self.active[k] = new

    def start(self, tag: str, attrs: dict[str, str], empty: bool) -> None:
        if tag in ("html", "body") and any(n.tag == tag for n in self.stack):
            return
        if tag in BLOCKS:
            self.close(frozenset(["p"]), _SCOPE)
            if tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self.stack.pop()
        if tag in _CLOSES:
            self.close(*_CLOSES[tag])
        elif tag == "a":
            self.end("a")
        if tag not in BLOCKS and tag not in _CLOSES and tag not in ("html", "head", "link", "meta", "base", "caption", "col", "colgroup"):
            self.reopen()
        node = Node(tag, attrs)
        self.stack[-1].children.append(node)
        if tag in VOID or empty:
            return
        self.stack.append(node)
        if tag in FORMATTING:
            # At most three elements alike are kept open.
            alike = [n for n in self.active if n.tag == tag and n.attrs == attrs]
            if len(alike) >= 3:
                self.active.remove(alike[0])
            self.active.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.stack[-1].children.append(Node("br"))
            return
        if tag in FORMATTING:
            for n in reversed(self.active):
                if n.tag == tag:
                    self.active.remove(n)
                    break
        stop = frozenset(["table"]) if tag in (
            "td", "th", "tr", "tbody", "thead", "tfoot"
        ) else frozenset(["td", "th", "table"]) if tag not in ("table", "html", "body") else frozenset()
        names = HEADINGS if tag in HEADINGS else frozenset([tag])
        if not any(n.tag in names for n in self.stack):
            if tag == "p":
                self.stack[-1].children.append(Node("p"))
            return
        if tag in FORMATTING and any(n.tag in BLOCKS for n in self.stack[self._last(names) + 1 :]):
            return  # a block stands open inside: the formatting ends there, the block stays
        self.close(names, stop - names)

    def _last(self, names: frozenset) -> int:
        return max((k for k, n in enumerate(self.stack) if n.tag in names), default=0)

    def text(self, text: str) -> None:
        if not text.isspace():
            self.reopen()
        self.stack[-1].children.append(text)


def parse(html: str | None) -> Node:
    """The tree of a page; null and empty pages give a root without children."""
    b, at, html = _Builder(), 0, html or ""
    for m in iter(lambda: _TOKEN.search(html, at), None):
        if m.start() > at:
            b.text(unescape(html[at : m.start()]))
        at = m.end()
        name = m[2]
        if name is None:
            continue
        tag = name.lower()
        if m[1]:
            b.end(tag)
            continue
        source = m[3]
        b.start(tag, attributes(source) if source.strip(" /\t\n\r\f") else {}, source.endswith("/") and tag not in RAW and tag in ("svg", "path", "math"))
        if tag in RAW or tag in RAW_WITH_ENTITIES:
            stop = re.compile(f"</{re.escape(tag)}\\s*/?>", re.IGNORECASE).search(html, at)
            raw = html[at : stop.start() if stop else len(html)]
            if raw:
                b.stack[-1].children.append(unescape(raw) if tag in RAW_WITH_ENTITIES else raw)
            at = stop.end() if stop else len(html)
            b.end(tag)
    if at < len(html):
        b.text(unescape(html[at:]))
    return b.root
