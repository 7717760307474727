"""Markdown to events: CommonMark's blocks and inlines, tables, strikethrough, tasks, footnotes, math, sub- and superscript.

An event is (kind, tag, depth, text, attrs). Kinds: start, end, text, code, html, inline_html, inline_math,
display_math, soft_break, hard_break, rule, footnote_ref and task. Left out: link reference definitions
that span lines, and the finer rules of HTML blocks (a block that opens with a tag ends at a blank line).
"""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple


class Event(NamedTuple):
    kind: str
    tag: str
    depth: int
    text: str
    attrs: dict[str, str]


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^`]*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_RULE = re.compile(r"^ {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_ITEM = re.compile(r"^( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(.*)|[ \t]*)$")
_QUOTE = re.compile(r"^ {0,3}> ?")
_NOTE = re.compile(r"^ {0,3}\[\^([^\]\s]+)\]:[ \t]*(.*)$")
_REFERENCE = re.compile(r"^ {0,3}\[([^\]^][^\]]*)\]:[ \t]*<?([^\s>]+)>?(?:[ \t]+[\"'(](.*)[\"')])?[ \t]*$")
_ROW_RULE = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(
    r"^ {0,3}<(?:!--|\?|![A-Z]|/?(?:address|article|aside|blockquote|body|br|center|details|dialog|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|option|p|param|pre|script|section|style|summary|table|tbody|td|textarea|tfoot|th|thead|title|tr|track|ul)(?:[\s/>]|$))",
    re.IGNORECASE
)
_HEADING_ATTRS = re.compile(r"^(.*?)[ \t]*\{([^{}]*)\}$")
_TASK = re.compile(r"^\[([ xX])\][ \t]+")


class _Blocks:
    def __init__(self, extensions: bool):
        self.out: list[Event] = []
        self.depth, self.extensions = 0, extensions
        self.references: dict[str, tuple[str, str]] = {}

    def emit(self, kind: str, tag: str = "", text: str = "", **attrs: str) -> None:
        if kind == "end":
            self.depth -= 1
        self.out.append(Event(kind, tag, self.depth, text, attrs))
        if kind == "start":
            self.depth += 1

    def inline(self, text: str) -> None:
        _Inlines(self, text).run()

    def starts_block(self, line: str) -> bool:
        item = _ITEM.match(line)
        return bool(
            _FENCE.match(line) or _ATX.match(line) or _RULE.match(line) or _QUOTE.match(line) or _HTML.match(line) or item and item[4] and (
                not item[2][0].isdigit() or item[2][:-1] == "1"
            )
        )

    def run(self, lines: list[str], tight: bool = False) -> None:
        k = 0
        while k < len(lines):
            line = lines[k]
            if not line.strip():
                k += 1
            elif line.startswith(("    ", "\t")):
                k = self.indented(lines, k)
            elif m := _FENCE.match(line):
                k = self.fenced(lines, k, m)
            elif m := _ATX.match(line):
                self.heading(len(m[1]), m[2] or "")
                k += 1
            elif _RULE.match(line):
                self.emit("rule")
                k += 1
            elif _QUOTE.match(line):
                k = self.quote(lines, k)
            elif m := _ITEM.match(line):
                k = self.list(lines, k, m)
            elif self.extensions and (m := _NOTE.match(line)):
                k = self.note(lines, k, m)
            elif m := _REFERENCE.match(line):
                self.references.setdefault(m[1].strip().lower(), (m[2], m[3] or ""))
                k += 1
            elif _HTML.match(line):
                k = self.html(lines, k)
            elif self.extensions and "|" in line and k + 1 < len(lines) and _ROW_RULE.match(lines[k + 1]) and len(_cells(line)) == len(_cells(lines[k + 1])):
                k = self.table(lines, k)
            else:
                k = self.paragraph(lines, k, tight)

    def heading(self, level: int, text: str) -> None:
        attrs = {"level": str(level)}
        if self.extensions and (m := _HEADING_ATTRS.match(text)) and all(t[:1] in "#." and len(t) > 1 for t in m[2].split()):
            text = m[1]
            for t in m[2].split():
                if t[0] == "#":
                    attrs["id"] = t[1:]
                else:
                    attrs["classes"] = f"{attrs.get('classes', '')} {t[1:]}".strip()
        self.emit("start", "heading", **attrs)
        self.inline(text.strip())
        self.emit("end", "heading", level=str(level))

    def indented(self, lines: list[str], k: int) -> int:
        body = []
        while k < len(lines) and (not lines[k].strip() or lines[k].startswith(("    ", "\t"))):
            body.append(lines[k][1:] if lines[k].startswith("\t") else lines[k][4:])
            k += 1
        while body and not body[-1].strip():
            body.pop()
        self.emit("start", "code_block", info="")
        self.emit("text", text="\n".join(body) + "\n")
        self.emit("end", "code_block")
        return k

    def fenced(self, lines: list[str], k: int, m: re.Match) -> int:
        fence, indent, body = m[1], len(lines[k]) - len(lines[k].lstrip(" ")), []
        close = re.compile(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")
        k += 1
        while k < len(lines) and not close.match(lines[k]):
            body.append(re.sub(rf"^ {{0,{indent}}}", "", lines[k]))
            k += 1
        self.emit("start", "code_block", info=m[2].strip())
        if body:
            self.emit("text", text="\n".join(body) + "\n")
        self.emit("end", "code_block")
        return k + 1

    def quote(self, lines: list[str], k: int) -> int:
        body = []
        while k < len(lines):
            if _QUOTE.match(lines[k]):
                body.append(_QUOTE.sub("", lines[k], count=1))
            elif body and body[-1].strip() and lines[k].strip() and not self.starts_block(lines[k]):
                body.append(lines[k])
            else:
                break
            k += 1
        self.emit("start", "blockquote")
        self.run(body)
        self.emit("end", "blockquote")
        return k

    def list(self, lines: list[str], k: int, m: re.Match) -> int:
        ordered, sign = m[2][0].isdigit(), m[2][-1]
        items, loose, blank = [], False, False
        while k < len(lines) and (m := _ITEM.match(lines[k])) and m[2][0].isdigit() == ordered and m[2][-1] == sign and not _RULE.match(lines[k]):
            loose = loose or (blank and bool(items))
            pad = len(m[3].expandtabs(4)) if m[3] is not None else 1
            indent = len(m[1]) + len(m[2]) + (pad if pad <= 4 else 1)
            if not items:
                start = m[2][:-1] if ordered else ""
            body, k, blank = [(" " * (pad - 1) if pad > 4 else "") + (m[4] or "")], k + 1, False
            while k < len(lines):
                line = lines[k].expandtabs(4) if lines[k].startswith("\t") else lines[k]
                if not line.strip():
                    body.append("")
                    blank = True
                elif len(line) - len(line.lstrip(" ")) >= indent:
                    if blank and body[0] == "" and len([b for b in body if b]) == 0:
                        break
                    loose = loose or (blank and not line[indent:].startswith(" ") and not _ITEM.match(line[indent:]))
                    body.append(line[indent:])
                    blank = False
                elif not blank and body and body[-1].strip() and not self.starts_block(line) and not _ITEM.match(line):
                    body.append(line.lstrip(" "))
                else:
                    break
                k += 1
            items.append(body)
        self.emit("start", "list", ordered=str(ordered).lower(), start=start)
        for body in items:
            self.emit("start", "item", ordered=str(ordered).lower())
            if self.extensions and (m := _TASK.match(body[0])):
                self.emit("task", text="x" if m[1] in "xX" else " ")
                body = [body[0][m.end() :], *body[1:]]
            self.run(body, tight=not loose)
            self.emit("end", "item")
        self.emit("end", "list", ordered=str(ordered).lower())
        return k

    def note(self, lines: list[str], k: int, m: re.Match) -> int:
        body, k = [m[2]], k + 1
        while k < len(lines) and lines[k].strip() and not _NOTE.match(lines[k]) and not self.starts_block(lines[k]) or k + 1 < len(lines) and not lines[k].strip() and lines[k + 1].startswith("    "):
            body.append(lines[k].removeprefix("    "))
            k += 1
        self.emit("start", "footnote", label=m[1])
        self.run(body)
        self.emit("end", "footnote", label=m[1])
        return k

    def html(self, lines: list[str], k: int) -> int:
        end = "-->" if lines[k].lstrip().startswith("<!--") else None
        raw = re.match(r"^ {0,3}<(script|pre|style|textarea)\b", lines[k], re.IGNORECASE)
        end = f"</{raw[1].lower()}>" if raw else end
        self.emit("start", "html_block")
        while k < len(lines):
            if end is None and not lines[k].strip():
                break
            self.emit("html", text=lines[k] + "\n")
            k += 1
            if end and end in lines[k - 1].lower():
                break
        self.emit("end", "html_block")
        return k

    def table(self, lines: list[str], k: int) -> int:
        rule = _cells(lines[k + 1])
        align = [
            "center" if c.startswith(":") and c.endswith(":") and len(c) > 1 else "left" if c.startswith(":") else "right" if c.endswith(":") else "none" for c in rule
        ]
        self.emit("start", "table", align=",".join(align))
        self.row("table_head", _cells(lines[k]), len(align))
        k += 2
        while k < len(lines) and lines[k].strip() and not self.starts_block(lines[k]):
            self.row("table_row", _cells(lines[k]), len(align))
            k += 1
        self.emit("end", "table")
        return k

    def row(self, tag: str, cells: list[str], n: int) -> None:
        self.emit("start", tag)
        for c in (cells + [""] * n)[:n]:
            self.emit("start", "table_cell")
            self.inline(c)
            self.emit("end", "table_cell")
        self.emit("end", tag)

    def paragraph(self, lines: list[str], k: int, tight: bool) -> int:
        body = []
        while k < len(lines) and lines[k].strip():
            if body and (level := re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[k])):
                self.heading(1 if level[1][0] == "=" else 2, "\n".join(body))
                return k + 1
            if body and self.starts_block(lines[k]):
                break
            body.append(lines[k].lstrip(" \t"))
            k += 1
        text = "\n".join(body).rstrip()
        if not tight:
            self.emit("start", "paragraph")
        self.inline(text)
        if not tight:
            self.emit("end", "paragraph")
        return k


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line.removeprefix("|")
    line = line[:-1] if line.endswith("|") and not line.endswith("\\|") else line
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


_PLAIN = re.compile(r"[^\\`*_~^$\[\]!<&\n]+")
_TAG = re.compile(
    r"<(?:/?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?)*\s*/?|!--.*?--|\?.*?\?|![A-Z][^>]*)>",
    re.DOTALL
)
_AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_TARGET = re.compile(
    r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(((?:[^()\\]|\\.)*)\)))?\s*\)"
)
_ESCAPED = re.compile(r"\\([!-/:-@\[-`{-~])")


class _Inlines:
    """One pass that leaves marks for emphasis and links, which are then paired."""

    def __init__(self, blocks: _Blocks, text: str):
        self.blocks, self.text = blocks, text
        self.items: list = []  # an event (kind, tag, text, attrs), or a mark [sign, n, opens, closes]

    def put(self, kind: str, tag: str = "", text: str = "", **attrs: str) -> None:
        if kind == "text" and self.items and isinstance(self.items[-1], tuple) and self.items[-1][0] == "text":
            text = self.items.pop()[2] + text
        self.items.append((kind, tag, text, attrs))

    def run(self) -> None:
        self.scan(0, len(self.text))
        self.pair(0)
        b = self.blocks
        texts: list[str] = []

        def flush():
            if texts:
                b.emit("text", text="".join(texts))
                texts.clear()

        for x in self.items:
            if isinstance(x, list):
                texts.append(x[0] * x[1])
            elif x[0] == "text":
                texts.append(x[2])
            else:
                flush()
                b.emit(x[0], x[1], x[2], **x[3])
        flush()

    def scan(self, at: int, end: int) -> None:
        text, extensions = self.text, self.blocks.extensions
        brackets: list[tuple[int, int, bool]] = []
        while at < end:
            ch = text[at]
            if m := _PLAIN.match(text, at, end):
                self.put("text", text=m[0])
                at = m.end()
            elif ch == "\n":
                self.line_end()
                at += 1
                while at < end and text[at] in " \t":
                    at += 1
            elif ch == "\\":
                if at + 1 < end and text[at + 1] == "\n":
                    self.put("hard_break")
                    at += 2
                elif m := _ESCAPED.match(text, at):
                    self.put("text", text=m[1])
                    at = m.end()
                else:
                    self.put("text", text=ch)
                    at += 1
            elif ch == "`":
                at = self.code(at, end)
            elif ch == "$" and extensions and (m := re.compile(r"\$\$(.+?)\$\$|\$(?!\s)((?:[^$\\]|\\.)+?)(?<!\s)\$(?!\d)", re.DOTALL).match(text, at, end)):
                self.put("display_math" if m[1] is not None else "inline_math", text=m[1] if m[1] is not None else m[2])
                at = m.end()
            elif ch == "<" and (m := _AUTO.match(text, at, end)):
                self.put("start", "link", dest=m[1] if ":" in m[1] else f"mailto:{m[1]}", title="")
                self.put("text", text=m[1])
                self.put("end", "link")
                at = m.end()
            elif ch == "<" and (m := _TAG.match(text, at, end)):
                self.put("inline_html", text=m[0])
                at = m.end()
            elif ch == "&" and (m := _ENTITY.match(text, at, end)):
                self.put("text", text=unescape(m[0]))
                at = m.end()
            elif ch == "[" and extensions and (m := re.compile(r"\[\^([^\]\s]+)\]").match(text, at, end)):
                self.put("footnote_ref", text=m[1])
                at = m.end()
            elif ch == "[" or ch == "!" and text[at : at + 2] == "![":
                n = 1 + (ch == "!")
                brackets.append((len(self.items), at + n, ch == "!"))
                self.items.append(["" + text[at : at + n], 1, False, False])
                at += n
            elif ch == "]":
                at = self.bracket(at, end, brackets)
            elif ch in "*_" or ch in "~^" and extensions:
                at = self.mark(at, end, ch)
            else:
                self.put("text", text=ch)
                at += 1

    def line_end(self) -> None:
        last = self.items[-1] if self.items and isinstance(self.items[-1], tuple) and self.items[-1][0] == "text" else None
        hard = bool(last) and last[2].endswith("  ")
        if last:
            self.items[-1] = ("text", "", last[2].rstrip(" "), last[3])
        self.put("hard_break" if hard else "soft_break")

    def code(self, at: int, end: int) -> int:
        n = len(re.compile("`+").match(self.text, at)[0])
        close = re.compile(rf"(?<!`)`{{{n}}}(?!`)").search(self.text, at + n, end)
        if not close:
            self.put("text", text="`" * n)
            return at + n
        body = self.text[at + n : close.start()].replace("\n", " ")
        if body.startswith(" ") and body.endswith(" ") and body.strip():
            body = body[1:-1]
        self.put("code", text=body)
        return close.end()

    def bracket(self, at: int, end: int, brackets: list) -> int:
        if not brackets:
            self.put("text", text="]")
            return at + 1
        first, inner, image = brackets.pop()
        dest = title = None
        if m := _TARGET.match(self.text, at + 1, end):
            dest = _ESCAPED.sub(r"\1", unescape(m[1] if m[1] is not None else m[2] or ""))
            title = _ESCAPED.sub(r"\1", unescape(m[3] or m[4] or m[5] or ""))
            after = m.end()
        else:
            label = re.compile(r"\[([^\]]*)\]").match(self.text, at + 1, end)
            key = (label[1] if label and label[1] else self.text[inner:at]).strip().lower()
            if key in self.blocks.references:
                dest, title = self.blocks.references[key]
                after = label.end() if label else at + 1
        if dest is None:
            self.put("text", text="]")
            return at + 1
        self.pair(first + 1)
        tag = "image" if image else "link"
        self.items[first] = ("start", tag, "", {"dest": dest, "title": title})
        self.put("end", tag)
        if not image:
            brackets[:] = [b for b in brackets if b[2]]
        return after

    def mark(self, at: int, end: int, ch: str) -> int:
        n = len(re.compile(re.escape(ch) + "+").match(self.text, at, end)[0])
        before, after = self.text[at - 1] if at else " ", self.text[at + n] if at + n < len(self.text) else " "
        space = lambda c: c.isspace()
        punctuation = lambda c: not c.isalnum() and not c.isspace()
        left = not space(after) and (not punctuation(after) or space(before) or punctuation(before))
        right = not space(before) and (not punctuation(before) or space(after) or punctuation(after))
        if ch == "_":
            left, right = left and (not right or punctuation(before)), right and (not left or punctuation(after))
        if ch in "~^" and (n > 2 or ch == "^" and n > 1):
            left = right = False
        self.items.append([ch, n, left, right])
        return at + n

    def pair(self, first: int) -> None:
        """Turns pairs of marks from ``first`` on into spans, the innermost ones first."""
        k = first
        while k < len(self.items):
            close = self.items[k]
            if not isinstance(close, list) or not close[3] or not close[1] or close[0] not in "*_~^":
                k += 1
                continue
            found = None
            for j in range(k - 1, first - 1, -1):
                x = self.items[j]
                if isinstance(x, list) and x[0] == close[0] and x[2] and x[1]:
                    odd = close[0] in "*_" and (x[3] or close[2]) and (x[1] + close[1]) % 3 == 0 and (x[1] % 3 or close[1] % 3)
                    if not odd and (close[0] in "*_" or x[1] == close[1]):
                        found = j
                        break
            if found is None:
                k += 1
                continue
            opener = self.items[found]
            n = min(opener[1], close[1], 2)
            tag = {
                "*": "emphasis", "_": "emphasis", "~": "subscript", "^": "superscript"
            }[close[0]] if n == 1 else "strikethrough" if close[0] == "~" else "strong"
            opener[1] -= n
            close[1] -= n
            for j in range(found + 1, k):
                if isinstance(self.items[j], list) and self.items[j][0] in "*_~^":
                    self.items[j][2] = self.items[j][3] = False
            self.items.insert(k, ("end", tag, "", {}))
            self.items.insert(found + 1, ("start", tag, "", {}))
            k += 2
            if not close[1]:
                k += 1


def parse(md: str | None, extensions: bool = True) -> list[Event]:
    """All events of a text; null and empty texts have none."""
    blocks = _Blocks(extensions)
    lines = (md or "").replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for line in lines:
        if m := _REFERENCE.match(line):
            blocks.references.setdefault(m[1].strip().lower(), (m[2], m[3] or ""))
    blocks.run(lines)
    return blocks.out


def top_level_blocks(md: str | None) -> list[str]:
    """The sources of a text's outermost blocks, in order; extensions don't count."""
    lines, out, k = (md or "").replace("\r\n", "\n").split("\n"), [], 0
    while k < len(lines):
        if not lines[k].strip():
            k += 1
            continue
        blocks, start = _Blocks(False), k
        k = _one_block(blocks, lines, k)
        out.append("\n".join(lines[start:k]).rstrip())
    return out


def _one_block(blocks: _Blocks, lines: list[str], k: int) -> int:
    line = lines[k]
    if line.startswith(("    ", "\t")):
        return blocks.indented(lines, k)
    if m := _FENCE.match(line):
        return blocks.fenced(lines, k, m)
    if _ATX.match(line) or _RULE.match(line) or _REFERENCE.match(line):
        return k + 1
    if _QUOTE.match(line):
        return blocks.quote(lines, k)
    if m := _ITEM.match(line):
        return blocks.list(lines, k, m)
    if _HTML.match(line):
        return blocks.html(lines, k)
    return blocks.paragraph(lines, k, False)
