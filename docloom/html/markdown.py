"""HTML pages as Markdown."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.html.tree import HEADINGS, Node, parse

_SKIPPED = frozenset("head script style template noscript title meta link".split())
_MARKS = {"strong": "**", "b": "**", "em": "*", "i": "*", "del": "~~", "s": "~~", "strike": "~~"}
_SPACE = re.compile(r"\s+")


def _inline(node: Node, nested: bool) -> str:
    return "".join(_one(x, nested, False) for x in node.children)


def _items(node: Node, nested: bool, level: int) -> str:
    out, number = [], 0
    for item in (x for x in node.children if isinstance(x, Node) and x.tag == "li"):
        number += 1
        lists = [x for x in item.children if isinstance(x, Node) and x.tag in ("ul", "ol")]
        own = "".join(_one(x, nested, False) for x in item.children if x not in lists).strip()
        out.append("    " * level + (f"{number}. " if node.tag == "ol" else "- ") + own + "\n")
        # Only the first nested list of an item is kept, and only where lists may nest.
        if lists and nested:
            out.append(_items(lists[0], nested, level + 1))
        elif lists:
            out += [_items(x, nested, level) for x in lists]
    return "".join(out)


def _table(node: Node, nested: bool) -> str:
    rows: list[list[str]] = []
    todo = [node]
    while todo:
        x = todo.pop(0)
        if x.tag == "tr":
            rows.append(
                [
                    _inline(c, nested).strip().replace("|", "\\|").replace("\n", " ") for c in x.children if isinstance(c, Node) and c.tag in ("td", "th")
                ]
            )
        else:
            todo = [c for c in x.children if isinstance(c, Node)] + todo
    if not rows:
        return ""
    wide = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (wide - len(r))) + " |" for r in rows]
    return "\n\n" + "\n".join([lines[0], "|" + "---|" * wide, *lines[1:]]) + "\n\n"


def _one(x: Node | str, nested: bool, pre: bool) -> str:
    if isinstance(x, str):
        return x if pre else _SPACE.sub(" ", x)
    tag, kind = x.tag, x.attrs.get("class", "")
    if tag in _SKIPPED:
        return ""
    if tag == "pre":
        code = x.text().strip("\n")
        return f"\n\n```{'mermaid' if 'mermaid' in kind else ''}\n{code}\n```\n\n"
    body = _inline(x, nested) if tag not in ("ul", "ol", "table", "code") else ""
    if tag in HEADINGS:
        return f"\n\n{'#' * int(tag[1])} {body.strip()}\n\n"
    if tag == "p":
        return f"\n\n{body.strip()}\n\n"
    if tag == "blockquote":
        return "\n\n" + "\n".join(f"> {line}" for line in body.strip().split("\n")) + "\n\n"
    if tag in _MARKS:
        inner = body.strip()
        return f"{' ' if body[:1].isspace() else ''}{_MARKS[tag]}{inner}{_MARKS[tag]}{' ' if body[-1:].isspace() else ''}" if inner else body
    if tag == "code":
        return f"`{x.text()}`"
    if tag == "span" and "math" in kind:
        return f"${x.text()}$"
    if tag == "div" and "math" in kind:
        return f"\n\n$$\n{x.text().strip()}\n$$\n\n"
    if tag == "div" and "page-break" in kind or tag == "hr":
        return "\n\n---\n\n"
    if tag == "a":
        return f"[{body.strip()}]({x.attrs['href']})" if x.attrs.get("href") and body.strip() else body
    if tag == "img":
        return f"![{x.attrs.get('alt', '')}]({x.attrs.get('src', '')})"
    if tag == "input" and x.attrs.get("type", "").lower() == "checkbox":
        return "[x] " if "checked" in x.attrs else "[ ] "
    if tag == "br":
        return "  \n"
    if tag in ("ul", "ol"):
        return f"\n\n{_items(x, nested, 0)}\n"
    if tag == "table":
        return _table(x, nested)
    if tag in ("sup", "sub"):
        return f"{'^' if tag == 'sup' else '~'}{body}{'^' if tag == 'sup' else '~'}"
    if tag in ("div", "section", "article", "main", "header", "footer", "nav", "aside", "figure"):
        return f"\n\n{body.strip()}\n\n" if body.strip() else ""
    return body


def html_to_markdown_text(html: str | None, nested: bool = False) -> str | None:
    """A page's body as Markdown; ``nested`` keeps lists inside lists, four blanks a level."""
    if html is None:
        return None
    root = parse(html)
    text = _inline(root.find("body") or root, nested)
    lines = "\n".join(line if line.endswith("  ") and line.strip() else line.rstrip() for line in text.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", lines).strip()


def html_to_markdown(html: Column, nested: bool = False) -> Column:
    # In rows of a hundred, not in Arrow's batches of ten thousand pages.
    @F.udf("string", useArrow=False)
    def convert(text: str):
        from docloom.html.markdown import html_to_markdown_text

        return html_to_markdown_text(text, nested)

    return convert(html)
