"""Diagram sources as rows: flowcharts, sequences, bar charts over time, shares, states, classes, relations, trees.

Statements stand on lines of their own, so every reader is a pattern over exploded lines.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The first word of a source by kind.
KINDS = {
    "graph": "flowchart", "flowchart": "flowchart", "sequenceDiagram": "sequence", "gantt": "gantt", "pie": "pie", "stateDiagram": "state",
    "stateDiagram-v2": "state", "classDiagram": "class", "erDiagram": "er", "timeline": "timeline", "journey": "journey",
    "mindmap": "mindmap"
}


def kind_of(source: Column) -> Column:
    word = F.regexp_extract(source, r"^\s*([A-Za-z][\w-]*)", 1)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))[word], F.lit("unknown"))


def lines(df: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """(id, ord, indent, line): lines that are neither empty nor comments, without the first one."""
    rows = df.select(id_col, F.posexplode(F.split(source_col, r"\r?\n|;", -1)).alias("ord", "raw"))
    rows = rows.filter((F.trim("raw") != "") & ~F.trim("raw").startswith("%%"))
    first = rows.groupBy(id_col).agg(F.min("ord").alias("__first"))
    rows = rows.join(first, id_col).filter(F.col("ord") > F.col("__first"))
    expanded = F.replace("raw", F.lit("\t"), F.lit("    "))
    return rows.select(id_col, "ord", (F.length(expanded) - F.length(F.ltrim(expanded))).alias("indent"), F.trim("raw").alias("line"))


def _parts(df: DataFrame, pattern: str, names: list[str], id_col: str) -> DataFrame:
    """Lines that match, with their groups as columns."""
    return df.filter(F.col("line").rlike(pattern)).select(
        id_col, "ord", "indent", *(F.regexp_extract("line", pattern, k).alias(n) for k, n in enumerate(names, 1))
    )


_NODE = r"([A-Za-z0-9_][\w-]*?)(\(\(.*?\)\)|\[\[.*?\]\]|\(\[.*?\]\)|\[\(.*?\)\]|\{\{.*?\}\}|\[.*?\]|\(.*?\)|\{.*?\}|>.*?\])?(?:::: ?\w+|:::\w+)?"
_ARROW = r"(<?(?:--+|==+|-\.+-|~~~)(?:>|x|o)?)"
#: Shapes by the opening bracket, longer ones first.
SHAPES = {"((": "circle", "[[": "subroutine", "([": "stadium", "[(": "cylinder", "{{": "hexagon", "[": "rect", "(": "rounded", "{": "diamond", ">": "flag"}


def _label(bracket: Column) -> Column:
    inner = F.regexp_replace(bracket, r"^(\(\(|\[\[|\(\[|\[\(|\{\{|\[|\(|\{|>)|(\)\)|\]\]|\]\)|\)\]|\}\}|\]|\)|\})$", "")
    return F.nullif(F.trim(F.regexp_replace(F.trim(inner), '^"|"$', "")), F.lit(""))


def _shape(bracket: Column) -> Column:
    out = F.lit(None).cast("string")
    for sign, shape in reversed(SHAPES.items()):
        out = F.when(bracket.startswith(sign), F.lit(shape)).otherwise(out)
    return out


def flowchart(df: DataFrame, id_col: str = "graph_id", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions of nodes, edges, subgraphs). Chains of arrows give an edge for each neighbouring pair."""
    rows = lines(df, id_col, source_col)
    w = Window.partitionBy(id_col).orderBy("ord")
    begins, ends = F.col("line").rlike(r"^subgraph\b"), F.col("line") == "end"
    deep = rows.withColumn("level", F.sum(F.when(begins, 1).when(ends, -1).otherwise(0)).over(w))
    name = F.regexp_extract("line", r"^subgraph\s+([^\s\[]+)", 1)
    named = deep.withColumn("n", F.when(begins, name))
    # The innermost open subgraph of a line: the last one begun at its level.
    subs = named.filter("n is not null").select(F.col(id_col), F.col("ord").alias("s_ord"), F.col("level").alias("s_level"), F.col("n").alias("subgraph"))
    body = deep.filter(~begins & ~ends & ~F.col("line").rlike(r"^(classDef|class|style|linkStyle|click|direction)\b"))
    chain = F.regexp_replace("line", r"(--|==|-\.)\s+([^->|=.][^->|=]*?)\s+(-->|---|==>|\.->)", "$3|$2|")
    pieces = F.split(F.regexp_replace(chain, rf"\s*{_ARROW}\s*(?:\|([^|]*)\|)?\s*", "\x01$1\x02$2\x01"), "\x01", -1)
    exploded = body.select(id_col, "ord", "level", pieces.alias("p"))
    nodes = exploded.select(id_col, "ord", "level", F.posexplode("p").alias("k", "piece")).filter("k % 2 = 0")
    nodes = nodes.select(id_col, "ord", "level", "k", F.posexplode(F.split("piece", r"\s+&\s+")).alias("j", "one")).withColumns(
        {"id": F.regexp_extract(F.trim("one"), f"^{_NODE}$", 1), "bracket": F.regexp_extract(F.trim("one"), f"^{_NODE}$", 2)}
    ).filter("id <> ''")
    place = F.col("ord") * 1000 + F.col("k") * 10 + F.col("j")
    mentions = nodes.select(
        F.col(id_col), "id", _label(F.col("bracket")).alias("label"), _shape(F.col("bracket")).alias("shape"), place.alias("ord"), "level",
        F.col("ord").alias("line_no")
    )
    a = nodes.select(id_col, "ord", "k", F.col("id").alias("src"))
    b = nodes.select(id_col, "ord", (F.col("k") - 2).alias("k"), F.col("id").alias("dst"))
    arrows = exploded.select(id_col, "ord", F.posexplode("p").alias("k", "arrow")).filter("k % 2 = 1").select(
        id_col, "ord", (F.col("k") - 1).alias("k"), F.substring_index("arrow", "\x02", 1).alias("arrow"),
        F.nullif(F.trim(F.substring_index("arrow", "\x02", -1)), F.lit("")).alias("label")
    )
    edges = a.join(b, [id_col, "ord", "k"]).join(arrows, [id_col, "ord", "k"])
    style = F.when(F.col("arrow").contains("="), "thick").when(F.col("arrow").contains("."), "dotted").otherwise("solid")
    edges = edges.select(id_col, "src", "dst", style.alias("style"), "label", (F.col("ord") * 1000 + F.col("k")).alias("ord"))
    near = mentions.alias("m").join(
        subs.alias("s"),
        (F.col(f"m.{id_col}") == F.col(f"s.{id_col}")) & (F.col("s.s_ord") < F.col("m.line_no")) & (F.col("s.s_level") == F.col("m.level"))
    )
    members = near.groupBy(
        F.col(f"m.{id_col}").alias(id_col), F.col("m.id").alias("id"), F.col("m.line_no").alias("line_no")
    ).agg(F.max_by("s.subgraph", "s.s_ord").alias("subgraph")).groupBy(id_col, "id").agg(F.min_by("subgraph", "line_no").alias("subgraph"))
    return mentions.drop("level", "line_no"), edges, members


def node_styles(df: DataFrame, id_col: str = "graph_id", source_col: str = "source") -> DataFrame:
    """(id, node, property, value) from classes and their definitions; of equal properties the later class counts."""
    rows = lines(df, id_col, source_col)
    classes = _parts(rows, r"^classDef\s+([\w,]+)\s+(.*)$", ["names", "props"], id_col).select(
        id_col, F.explode(F.split("names", ",")).alias("class"), F.explode(F.split("props", ",")).alias("p")
    )
    props = classes.select(id_col, "class", F.trim(F.substring_index("p", ":", 1)).alias("property"), F.trim(F.substring_index("p", ":", -1)).alias("value"))
    uses = _parts(rows, r"^class\s+([\w,\s]+?)\s+(\w+)$", ["nodes", "class"], id_col).select(
        id_col, "ord", F.explode(F.split("nodes", r"\s*,\s*")).alias("node"), "class"
    )
    return uses.join(props, [id_col, "class"]).groupBy(id_col, "node", "property").agg(F.max_by("value", "ord").alias("value"))


def sequence(df: DataFrame, id_col: str = "chart_id", source_col: str = "source") -> DataFrame:
    """(id, ord, src, dst, arrow, text, step): messages, and (de)activations with step 1 or -1 of ``src``."""
    rows = lines(df, id_col, source_col)
    messages = _parts(
        rows, r"^([\w ]+?)\s*(-?->>?[+-]?|-->>?[+-]?|-[x)][+-]?)\s*([\w ]+?)\s*:\s*(.*)$", ["src", "arrow", "dst", "text"], id_col
    ).withColumn("step", F.lit(0))
    acts = _parts(rows, r"^(activate|deactivate)\s+(\w+)$", ["word", "src"], id_col).select(
        id_col, "ord", "indent", "src", F.lit("").alias("arrow"), F.lit("").alias("dst"), F.lit("").alias("text"),
        F.when(F.col("word") == "activate", 1).otherwise(-1).alias("step")
    )
    return messages.unionByName(acts).drop("indent")


def pie(df: DataFrame, id_col: str = "chart_id", source_col: str = "source") -> DataFrame:
    """(id, ord, label, value)."""
    rows = _parts(lines(df, id_col, source_col), r'^"([^"]*)"\s*:\s*([0-9.]+)$', ["label", "value"], id_col)
    return rows.withColumn("value", F.col("value").cast("double")).drop("indent")


def _section(rows: DataFrame, id_col: str) -> DataFrame:
    w = Window.partitionBy(id_col).orderBy("ord")
    name = F.when(F.col("line").startswith("section "), F.trim(F.substring("line", 9, 2**31 - 1)))
    return rows.withColumn("section", F.coalesce(F.last(name, ignorenulls=True).over(w), F.lit(""))).filter(~F.col("line").startswith("section "))


def gantt(df: DataFrame, id_col: str = "chart_id", source_col: str = "source") -> DataFrame:
    """(id, ord, section, task, start, length) with days counted from the first date of the chart."""
    rows = _section(lines(df, id_col, source_col), id_col)
    pattern = r"^([^:]+?)\s*:\s*(?:[\w, ]*?,\s*)?(\d{4}-\d{2}-\d{2})\s*,\s*(?:(\d+)d|(\d{4}-\d{2}-\d{2}))$"
    tasks = rows.filter(F.col("line").rlike(pattern)).select(
        id_col, "ord", "section", *(F.regexp_extract("line", pattern, k).alias(n) for k, n in enumerate(("task", "from", "days", "to"), 1))
    )
    first = tasks.groupBy(id_col).agg(F.min("from").alias("first"))
    length = F.when(F.col("days") != "", F.col("days").try_cast("int")).otherwise(F.datediff(F.col("to").try_cast("date"), F.col("from").try_cast("date")))
    return tasks.join(first, id_col).select(
        id_col, "ord", "section", "task", F.datediff(F.col("from").try_cast("date"), F.col("first").try_cast("date")).alias("start"),
        length.alias("length")
    )


def timeline(df: DataFrame, id_col: str = "chart_id", source_col: str = "source") -> DataFrame:
    """(id, ord, section, period, event): an event for each colon behind the period."""
    rows = _section(lines(df, id_col, source_col), id_col).filter(~F.col("line").startswith("title "))
    parts = F.split("line", r"\s*:\s*", -1)
    w = Window.partitionBy(id_col).orderBy("ord")
    named = rows.withColumn("period", F.last(F.nullif(F.trim(parts[0]), F.lit("")), ignorenulls=True).over(w))
    return named.select(
        id_col, "ord", "section", "period",
        F.explode(F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: x != "")).alias("event")
    )


def journey(df: DataFrame, id_col: str = "chart_id", source_col: str = "source") -> DataFrame:
    """(id, ord, section, task, score, actors)."""
    rows = _section(lines(df, id_col, source_col), id_col)
    pattern = r"^([^:]+?)\s*:\s*(\d+)\s*(?::\s*(.*))?$"
    return rows.filter(F.col("line").rlike(pattern)).select(
        id_col, "ord", "section", F.regexp_extract("line", pattern, 1).alias("task"),
        F.regexp_extract("line", pattern, 2).try_cast("int").alias("score"),
        F.filter(F.split(F.regexp_extract("line", pattern, 3), r"\s*,\s*"), lambda a: a != "").alias("actors")
    )


def states(df: DataFrame, id_col: str = "chart_id", source_col: str = "source") -> DataFrame:
    """(id, ord, src, dst, label) of transitions."""
    return _parts(lines(df, id_col, source_col), r"^(\[\*\]|\w+)\s*-->\s*(\[\*\]|\w+)\s*(?::\s*(.*))?$", ["src", "dst", "label"], id_col).drop("indent")


def relations(df: DataFrame, id_col: str = "chart_id", source_col: str = "source") -> DataFrame:
    """(id, ord, src, arrow, dst, label) of class and entity diagrams."""
    pattern = r'^(\w+)\s+(?:"[^"]*"\s*)?([<|*o}{.\-]+[>|*o}{.\-]*)\s*(?:"[^"]*"\s*)?(\w+)\s*(?::\s*(.*))?$'
    return _parts(lines(df, id_col, source_col), pattern, ["src", "arrow", "dst", "label"], id_col).filter(F.col("arrow").rlike(r"--|\.\.")).drop("indent")


def mindmap(df: DataFrame, id_col: str = "chart_id", source_col: str = "source") -> DataFrame:
    """(id, ord, level, label); two blanks are a level."""
    rows = lines(df, id_col, source_col)
    label = F.regexp_replace("line", r"^\w*(?:\(\(|\[|\(|\{\{)(.*?)(?:\)\)|\]|\)|\}\})$", "$1")
    return rows.select(id_col, "ord", F.floor(F.col("indent") / 2).cast("int").alias("level"), label.alias("label"))


def sources(events: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, seq, source) of the diagrams in documents' events."""
    w = Window.partitionBy(id_col).orderBy("seq")
    starts = (F.lag("kind").over(w) == "start") & (F.lag("tag").over(w) == "code_block") & (F.lag("attrs").over(w)["info"] == "mermaid")
    return events.withColumn("is_source", starts).filter("is_source and kind = 'text'").select(id_col, "seq", F.col("text").alias("source"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
