"""Smaller operators over documents: grammar marks, comments, numbered formulas, images, filters."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Patterns of slips, with the correction and the message.
GRAMMAR = (
    (r"\b(teh)\b", "the", "Possible typo"),
    (r"\b(recieve)\b", "receive", "Possible typo"),
    (r"\b(alot)\b", "a lot", "Two words"),
    (r"\b(could of)\b", "could have", "Use a verb"),
)


def occurrences(docs: DataFrame, rules: list[tuple[str, ...]], names: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, matched, at, *names) of every match of a pattern; ``at`` counts code points before it.

    A rule is a pattern and a value for each of ``names``; matches of one pattern do not overlap. All rules share one
    scan, and a match's place is a running sum over its text's pieces. Ids are unique; a null text has no matches.
    """
    of_rules = []
    for k, (pattern, *values) in enumerate(rules):
        found = F.regexp_extract_all(text_col, F.lit(f"({pattern})"), F.lit(1))
        between = F.split(text_col, f"(?:{pattern})", -1)
        # A text before a match, then the match; the text behind the last one is not needed.
        lengths = F.transform(F.slice(between, F.lit(1), F.size(found)), F.length)
        pieces = F.arrays_zip(found.alias("matched"), lengths.alias("gap"), F.transform(found, lambda m, i: i).alias("i"))
        of_rules.append(F.struct(F.lit(k).alias("rule"), *(F.lit(v).alias(n) for n, v in zip(names, values, strict=True)), pieces.alias("pieces")))
    rows = docs.select(id_col, F.explode(F.array(*of_rules)).alias("r"))
    rows = rows.select(id_col, "r.rule", *(f"r.{n}" for n in names), F.explode("r.pieces").alias("p"))
    w = Window.partitionBy(id_col, "rule").orderBy("p.i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    until = F.sum(F.col("p.gap") + F.length("p.matched")).over(w)
    return rows.select(id_col, F.col("p.matched").alias("matched"), (until - F.length("p.matched")).cast("long").alias("at"), *names)


def grammar_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=GRAMMAR) -> DataFrame:
    """(id, matched, at, correction, message) of every slip; ``at`` counts code points before it."""
    return occurrences(docs, [(f"(?i){p}", *rest) for p, *rest in rules], ("correction", "message"), id_col, text_col)


def comments(docs: DataFrame, id_col: str = "doc_id", text_col: str = "md") -> DataFrame:
    """(id, comment_id, author, body, anchor) of the comment marks in Markdown."""
    marks = F.regexp_extract_all(text_col, F.lit(r'(?s)(<mark class="comment"[^>]*>.*?</mark>)'), F.lit(1))
    rows = docs.select(id_col, F.explode(marks).alias("m"))
    attr = lambda n: F.regexp_extract("m", rf'{n}="([^"]*)"', 1)
    return rows.select(
        id_col, attr("data-id").alias("comment_id"), attr("data-author").alias("author"), attr("data-content").alias("body"),
        F.regexp_extract("m", "(?s)>(.*)</mark>$", 1).alias("anchor")
    )


def prune_comments(stored: DataFrame, marked: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Stored comments whose mark is still in the text."""
    return stored.join(marked.select(id_col, "comment_id"), [id_col, "comment_id"], "left_semi")


def formulas(docs: DataFrame, id_col: str = "doc_id", text_col: str = "md") -> DataFrame:
    """(id, number, display, latex) of the formulas between dollar signs."""
    found = F.regexp_extract_all(text_col, F.lit(r"(?s)(\$\$.+?\$\$|\$(?!\s)[^$\n]+?(?<!\s)\$(?!\d))"), F.lit(1))
    rows = docs.select(id_col, F.posexplode(found).alias("k", "f"))
    return rows.select(
        id_col, (F.col("k") + 1).cast("long").alias("number"), F.col("f").startswith("$$").alias("display"),
        F.trim(F.regexp_replace("f", r"^\$+|\$+$", "")).alias("latex")
    )


def png_size(content: Column) -> Column:
    """(width, height) of a PNG image; null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("long")
    return F.when(F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A", F.struct(number(17).alias("width"), number(21).alias("height")))


def _jpeg(data: bytes | None) -> tuple[int, int] | None:
    """Walks a JPEG's segments to its first frame header."""
    at = 2
    if not data or data[:2] != b"\xff\xd8":
        return None
    while at + 9 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # no length follows
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        else:
            at += 2 + max(int.from_bytes(data[at + 2 : at + 4], "big"), 2)
    return None


def jpeg_size(content: Column) -> Column:
    """(width, height) of a JPEG image; null for anything else."""

    @F.pandas_udf("string")
    def sizes(batch: pd.Series) -> pd.Series:
        return pd.Series([",".join(map(str, found)) if (found := _jpeg(x)) else None for x in batch])

    text = sizes(content)
    return F.when(text.isNotNull(), F.struct(*(F.split_part(text, F.lit(","), F.lit(k)).cast("long").alias(n) for k, n in ((1, "width"), (2, "height")))))


def image_size(content: Column) -> Column:
    """(width, height) of a PNG or JPEG image; null for anything else."""
    return F.coalesce(png_size(content), jpeg_size(content))


def sorted_lines(text: Column, numbers: bool = False) -> Column:
    """A list's lines in the order of their text; with ``numbers`` in that of the number at their start, others last."""
    items = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    if not numbers:
        return F.array_join(F.array_sort(items), "\n")
    number = lambda x: F.regexp_extract(x, r"^\s*(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    keyed = F.transform(items, lambda x: F.struct(number(x).isNull().alias("last"), number(x).alias("number"), x.alias("line")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: x["line"]), "\n")


def sorted_table(text: Column, numbers: bool = False, descending: bool = False) -> Column:
    """A Markdown table's rows in the order of their first cell; head and rule stay on top.

    With ``numbers`` rows go by the number at the cell's start, those without one last; rows that are alike keep their order.
    """
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    cell = lambda x: F.trim(F.regexp_extract(x, r"^\s*\|?((?:\\\||[^|])*)", 1))
    number = lambda x: F.regexp_extract(cell(x), r"^(-?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    at = (lambda i: -i) if descending else (lambda i: i)
    by = number if numbers else (lambda x: F.lower(cell(x)))
    keyed = F.transform(
        F.slice(lines, F.lit(3), F.greatest(F.size(lines) - 2, F.lit(0))),
        lambda x, i: F.struct(by(x).alias("by"), at(i).alias("i"), x.alias("line"))
    )
    known, rest = F.filter(keyed, lambda r: r["by"].isNotNull()), F.filter(keyed, lambda r: r["by"].isNull())
    ordered = F.sort_array(known, asc=not descending)
    body = F.transform(F.concat(ordered, rest), lambda r: r["line"])
    return F.array_join(F.concat(F.slice(lines, 1, 2), body), "\n")


FILTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register_filter(name: str, of: Callable[[DataFrame], DataFrame]) -> None:
    """A filter takes event rows and gives event rows."""
    FILTERS[name] = of


def apply_filters(events: DataFrame, *names: str) -> DataFrame:
    """Registered filters one after another; an unknown name is an error."""
    for name in names:
        if name not in FILTERS:
            raise KeyError(f"unknown filter: {name}")
        events = FILTERS[name](events)
    return events
