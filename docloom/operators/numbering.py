"""Running numbers in texts: formulas that become numbered links, and items of lists by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom import storage
from docloom.operators import scans

#: Two dollar signs, which stay, or a formula up to the next dollar sign without a backslash.
_TOKEN = r"\$\$|\$[^$]*(?:(?<=\\)\$[^$]*)*(?<!\\)\$"
_BLANK = r"(?U)^\s+|\s+\z"


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, place, line, bare): a text's lines; what ends a line doesn't count, so a text's last line end begins none."""
    text = F.coalesce(text_col, F.lit(""))
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\r?\n", -1)
    rows = docs.filter(text != "").select(id_col, F.posexplode(lines).alias("place", "line"))
    return rows.withColumns({"place": F.col("place").cast("long"), "bare": F.regexp_replace("line", _BLANK, "")})


def number_formulas(docs: DataFrame, id_col: str = "doc_id", text_col: str = "md", folder: str = "diagrams/math") -> tuple[DataFrame, DataFrame]:
    """((id, text), (id, number, display, latex)): texts with numbered links in the place of formulas, and the formulas.

    A line that begins with two dollar signs begins a block, which ends with a line that ends so; whether a line is in a
    block depends on all before it: an automaton of two states. A block without end takes the rest of the text with it. Formulas in
    a line stand between single dollar signs. All are numbered as they come; a line's formulas are rows, so the numbers are running
    counts. Ids must be unique.
    """
    lines = _lines(docs, id_col, text_col)
    opens, closes = F.col("bare").startswith("$$"), F.col("bare").endswith("$$")
    alone = opens & closes & (F.length("bare") > 3)
    step = F.array(F.when(opens & ~alone, 1).otherwise(0), F.when(closes, 0).otherwise(1))
    lines = storage.materialise(lines.withColumns({"step": step, "start": F.lit(0)}), "math-lines")
    states = scans.states_before(lines, [id_col], "place", "step", 2, "start")
    lines = lines.join(states, [id_col, "place"])
    inside = F.col("state") == 1
    kind = F.when(inside, F.when(closes, "close").otherwise("body")).when(alone, "alone").when(opens, "open").otherwise("text")
    lines = lines.select(id_col, "place", "line", "bare", kind.alias("kind"))

    found = F.regexp_extract_all("line", F.lit(f"({_TOKEN})"), F.lit(1))
    parts = F.arrays_zip(F.split("line", _TOKEN, -1).alias("before"), found.alias("token"))
    cut = lambda c, a, b: F.substr(c, F.lit(1 + a), F.greatest(F.length(c) - a - b, F.lit(0)))
    own = {"alone": cut("bare", 2, 2), "open": cut("bare", 2, 0), "body": F.col("line"), "close": F.when(F.col("bare") == "$$", "").otherwise(cut("line", 0, 2))}
    latex = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in own.items()))
    whole = F.array(F.struct(F.lit("").alias("before"), latex.alias("token")))
    rows = lines.select(id_col, "place", "kind", F.posexplode(F.when(F.col("kind") == "text", parts).otherwise(whole)).alias("at", "part"))
    before, token = F.col("part.before"), F.col("part.token")
    counts = F.when(F.col("kind") == "text", token.isNotNull() & (token != "$$")).otherwise(F.col("kind").isin("alone", "close"))
    w = Window.partitionBy(id_col).orderBy("place", "at")
    rows = rows.withColumns({"counts": counts, "last": F.lead("place").over(w).isNull() | (F.lead("place").over(w) != F.col("place"))})
    # The lines of a block have the number that its last line gets.
    rows = rows.withColumn("number", F.sum(F.col("counts").cast("long")).over(w) + F.col("kind").isin("open", "body").cast("long"))

    link = lambda label: F.concat(F.lit("!["), label, F.lit(f"]({folder}/eq_"), F.col("number").cast("string"), F.lit(".png)"))
    shown = F.when(F.col("kind") == "text", F.concat(before, F.when(F.col("counts"), link(F.lit(""))).otherwise(F.coalesce(token, F.lit("")))))
    shown = shown.when(F.col("counts"), link(F.concat(F.lit("Equation "), F.col("number").cast("string")))).otherwise("")
    ends = F.col("last") & ~F.col("kind").isin("open", "body")
    pieces = F.array_sort(F.collect_list(F.struct("place", "at", F.concat(shown, F.when(ends, "\n").otherwise("")).alias("p"))))
    texts = rows.groupBy(id_col).agg(F.array_join(F.transform(pieces, lambda x: x["p"]), "").alias("text"))
    texts = docs.select(id_col).join(texts, id_col, "left").fillna("", ["text"])

    block = F.col("kind") != "text"
    inline = rows.filter(~block & F.col("counts")).select(id_col, "number", F.lit(False).alias("display"), cut(token, 1, 1).alias("latex"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part.token"))), lambda x: x["token"]), "\n")
    blocks = rows.filter(block).groupBy(id_col, "number").agg(F.regexp_replace(text, _BLANK, "").alias("latex"), F.max("counts").alias("ended"))
    return texts, inline.unionByName(blocks.filter("ended").select(id_col, "number", F.lit(True).alias("display"), "latex"))


def list_numbers(paragraphs: DataFrame, key: str = "doc_id", order: str = "seq", level: str = "level", list_id: str = "list_id", numbered: int = 2) -> DataFrame:
    """Adds ``number`` and ``marker`` to paragraphs; ``list_id`` 0 is no list, ``numbered`` the one that counts.

    Each level has a counter that goes on over paragraphs and lists between; it begins anew at an item that stands deeper than the
    item of a list before it. So a number is a place among the items of one level since the last such beginning. Null levels count as 0,
    null lists as none.
    """
    rows = paragraphs.withColumns({level: F.coalesce(F.col(level), F.lit(0)), list_id: F.coalesce(F.col(list_id), F.lit(0))})
    listed, counts = F.col(list_id) > 0, F.col(list_id) == numbered
    w = Window.partitionBy(key).orderBy(order)
    before = F.coalesce(F.last(F.when(listed, F.col(level)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumns({"__counts": counts, "__anew": (counts & (F.col(level) > before)).cast("int")})
    by_level = Window.partitionBy(key, level).orderBy(order)
    rows = rows.withColumn("__since", F.sum("__anew").over(by_level))
    number = F.sum(F.col("__counts").cast("long")).over(Window.partitionBy(key, level, "__since").orderBy(order))
    rows = rows.withColumn("number", F.when(F.col("__counts"), number))
    indent = F.repeat(F.lit("    "), F.col(level).cast("int"))
    marker = F.when(F.col("__counts"), F.concat(indent, F.col("number").cast("string"), F.lit(". "))).when(listed, F.concat(indent, F.lit("- "))).otherwise("")
    return rows.withColumn("marker", marker).drop("__counts", "__anew", "__since")
