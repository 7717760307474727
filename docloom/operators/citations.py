"""References as text: five citation styles, RIS, BibTeX, notes, and styles given as trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import initials, parse_author


def _if(c: str, *parts: Column | str) -> Column:
    """The parts joined if the field isn't empty."""
    return F.when(F.col(c) != "", F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))).otherwise(F.lit(""))


def _join(*parts: Column | str) -> Column:
    return F.trim(F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)))


def _volume(both, alone) -> Column:
    v, i = F.col("volume"), F.col("issue")
    return F.when((v != "") & (i != ""), both(v, i)).when(v != "", alone(v)).otherwise(F.lit(""))


def _names(of) -> Column:
    return F.transform("authors", lambda a: of(parse_author(a)))


def _slice(names: Column, start: int, length: Column | int) -> Column:
    return F.slice(names, F.lit(start), length if isinstance(length, Column) else F.lit(length))


def apa() -> Column:
    names = _names(lambda p: F.concat(p["last"], F.lit(", "), initials(p["first"])))
    n, last = F.size(names), F.try_element_at(names, F.lit(-1))
    most = F.array_join(_slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    authors = F.when(n == 0, "").when(n == 1, last).when(n <= 7, F.concat(most, F.lit(", & "), last)).otherwise(
        F.concat(F.array_join(_slice(names, 1, 6), ", "), F.lit(", ... "), last)
    )
    volume = _volume(lambda v, i: F.concat(F.lit(", *"), v, F.lit("*("), i, F.lit(")")), lambda v: F.concat(F.lit(", *"), v, F.lit("*")))
    doi = _if("doi", " https://doi.org/", F.col("doi"))
    journal = F.when(
        F.col("journal") != "", F.concat(F.lit(" *"), "journal", F.lit("*"), volume, _if("pages", ", ", F.col("pages")), F.lit("."), doi)
    ).otherwise(doi)
    year = F.when(F.col("year") == "", "n.d.").otherwise(F.col("year"))
    return _join(authors, " (", year, ").  ", F.col("title"), ". ", journal)


def _last_first(p: Column) -> Column:
    return F.when(p["first"] == "", p["last"]).otherwise(F.concat(p["last"], F.lit(", "), p["first"]))


def mla() -> Column:
    names = _names(_last_first)
    n, first = F.size(names), F.try_element_at(names, F.lit(1))
    authors = F.when(n == 0, "").when(n == 1, F.concat(first, F.lit("."))).otherwise(F.concat(first, F.lit(", et al..")))
    authors = F.when(first == "", F.when(n > 1, authors).otherwise("")).otherwise(authors)
    return _join(
        authors, ' "', F.col("title"), '" *', F.col("journal"), "*, ", _if("volume", "vol. ", F.col("volume"), ", "),
        _if("issue", "no. ", F.col("issue"), ", "), F.col("year"), ", ", _if("pages", "pp. ", F.col("pages")),
        _if("doi", ", doi:", F.col("doi")), "."
    )


def chicago() -> Column:
    parsed = _names(lambda p: p)
    n, first = F.size(parsed), F.try_element_at(parsed, F.lit(1))
    rest = F.transform(
        F.slice(parsed, 2, F.greatest(n - 1, F.lit(0))),
        lambda p: F.when(p["first"] == "", p["last"]).otherwise(F.concat(p["first"], F.lit(" "), p["last"]))
    )
    authors = F.when(n == 0, "").when(n == 1, _last_first(first)).otherwise(
        F.concat(first["last"], F.lit(", "), first["first"], F.lit(", and "), F.array_join(rest, ", and "))
    )
    volume = _volume(lambda v, i: F.concat(F.lit(" "), v, F.lit(" ("), i, F.lit(")")), lambda v: F.concat(F.lit(" "), v))
    return _join(
        authors, " ", F.col("year"), ' "', F.col("title"), '" *', F.col("journal"), "*", volume, _if("pages", ": ", F.col("pages")), ".",
        _if("doi", " https://doi.org/", F.col("doi"))
    )


def vancouver() -> Column:
    names = _names(lambda p: F.concat(p["last"], F.lit(" "), F.regexp_replace(initials(p["first"]), "[. ]", "")))
    authors = F.when(F.size(names) > 6, F.concat(F.array_join(_slice(names, 1, 6), ", "), F.lit(", et al."))).otherwise(F.array_join(names, ", "))
    when = F.when(F.col("volume") == "", F.col("year")).otherwise(
        F.concat("year", F.lit(";"), _volume(lambda v, i: F.concat(v, F.lit("("), i, F.lit(")")), lambda v: v))
    )
    return _join(authors, ". ", F.col("title"), ". ", F.col("journal"), ". ", when, _if("pages", ":", F.col("pages")), ".")


def ieee() -> Column:
    names = _names(lambda p: F.concat(initials(p["first"]), F.lit(" "), p["last"]))
    n, first = F.size(names), F.try_element_at(names, F.lit(1))
    authors = F.when(n == 0, "").when(n == 1, first).when(n == 2, F.array_join(names, " and ")).otherwise(F.concat(first, F.lit(" et al.")))
    return _join(
        authors, ', "', F.col("title"), '", *', F.col("journal"), "*", _if("volume", ", vol. ", F.col("volume")),
        _if("issue", ", no. ", F.col("issue")), _if("pages", ", pp. ", F.col("pages")), ", ", F.col("year"),
        _if("doi", ", doi: ", F.col("doi"))
    )


STYLES = {"apa": apa, "mla": mla, "chicago": chicago, "vancouver": vancouver, "ieee": ieee}


def cite(refs: DataFrame, style: str) -> DataFrame:
    """(id, citation) in one of ``STYLES``; an unknown style is an error."""
    if style.lower() not in STYLES:
        raise ValueError(f"unknown citation style: {style}")
    return refs.select("id", STYLES[style.lower()]().alias("citation"))


#: Types in RIS and BibTeX.
RIS_TYPES = {
    "Journal Article": "JOUR", "Book": "BOOK", "Book Chapter": "CHAP", "Conference Paper": "CONF", "Thesis": "THES", "Report": "RPRT",
    "Website": "ELEC", "Preprint": "JOUR"
}
BIBTEX_TYPES = {
    "Journal Article": "article", "Book": "book", "Book Chapter": "incollection", "Conference Paper": "inproceedings",
    "Thesis": "phdthesis", "Report": "techreport"
}


def _type(table: dict[str, str], default: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[F.col("reference_type")], F.lit(default))


def ris() -> Column:
    """A record: fields that aren't empty, a line for each author and tag."""
    line = lambda tag, c: _if(c, f"{tag}  - ", F.col(c), "\n")
    each = lambda tag, c: F.array_join(F.transform(c, lambda x: F.concat(F.lit(f"{tag}  - "), x, F.lit("\n"))), "")
    fields = [
        ("AB", "abstract_text"), ("JO", "journal"), ("PY", "year"), ("VL", "volume"), ("IS", "issue"), ("SP", "pages"), ("PB", "publisher"),
        ("DO", "doi"), ("UR", "url"), ("SN", "issn"), ("SN", "isbn"), ("LA", "language")
    ]
    return F.concat(
        F.lit("TY  - "), _type(RIS_TYPES, "GEN"), F.lit("\nT1  - "), F.col("title"), F.lit("\n"), each("AU", "authors"),
        *(line(t, c) for t, c in fields), each("KW", "tags"), line("N1", "notes"), F.lit("ER  - \n\n")
    )


def bibtex() -> Column:
    """An entry; its key is the first author's surname and the year."""
    author = F.coalesce(F.try_element_at("authors", F.lit(1)), F.lit("Unknown"))
    key = F.concat(F.regexp_replace(F.trim(F.substring_index(author, ",", 1)), r"[^\p{L}\p{N}]", ""), "year")
    line = lambda name, c, value=None: F.when(
        c != "", F.concat(F.lit(f"  {name:<9} = {{"), c if value is None else value, F.lit("},\n"))
    ).otherwise(F.lit(""))
    return F.concat(
        F.lit("@"), _type(BIBTEX_TYPES, "misc"), F.lit("{"), key, F.lit(",\n  title     = {"), F.col("title"), F.lit("},\n"),
        line("author", F.array_join("authors", " and ")), line("journal", F.col("journal")), line("year", F.col("year")),
        line("volume", F.col("volume")), line("number", F.col("issue")),
        line("pages", F.col("pages"), F.replace("pages", F.lit("-"), F.lit("--"))), line("publisher", F.col("publisher")),
        line("doi", F.col("doi")), line("isbn", F.col("isbn")), line("abstract", F.col("abstract_text")),
        line("keywords", F.array_join("tags", ", ")), F.lit("}\n\n"),
    )


def note() -> Column:
    """A Markdown note: front matter, then headings for abstract and notes."""
    title = F.replace("title", F.lit('"'), F.lit('\\"'))
    return F.concat(
        F.lit('---\ntitle: "'), title, F.lit('"\nauthors: ['),
        F.array_join(F.transform("authors", lambda a: F.concat(F.lit('"'), a, F.lit('"'))), ", "), F.lit("]\nyear: "), "year",
        F.lit("\ndoi: "), "doi", F.lit("\n---\n\n# "), "title", F.lit("\n\n## Abstract\n\n"), "abstract_text", F.lit("\n\n## Notes\n\n"),
        "notes", F.lit("\n")
    )


def entry() -> Column:
    """The plain entry of a numbered bibliography: parts that aren't empty, with points between."""
    authors = F.nullif(F.array_join("authors", ", "), F.lit(""))
    part = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.concat(F.concat_ws(". ", authors, part("title"), part("journal"), part("year")), F.lit("."))


def compiled(node: dict, macros: dict[str, dict] | None = None) -> Column:
    """A style's tree as one column; ``macros`` are trees by name.

    Nodes have a ``kind``: layout or group (children, delimiter), text (value, variable, macro or term),
    date (variable), names (variable, and), choose (branches with variable or type, match; otherwise),
    number and label. Empty parts are left out of a group, and a group without variables' values is
    empty. A condition has one variable or type; a branch that holds and is empty ends the choice.
    """
    macros = macros or {}
    kind = node["kind"]
    wrap = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit("")).otherwise(
        F.concat(F.lit(node.get("prefix", "")), c, F.lit(node.get("suffix", "")))
    )
    if kind in ("layout", "group", "macro"):
        parts = [F.nullif(compiled(x, macros), F.lit("")) for x in node.get("children", [])]
        return wrap(F.concat_ws(node.get("delimiter", ""), *parts) if parts else F.lit(""))
    if kind == "text":
        if "value" in node or "term" in node:
            return wrap(F.lit(node.get("value", node.get("term", ""))))
        if "macro" in node:
            return wrap(compiled(macros[node["macro"]], macros) if node["macro"] in macros else F.lit(""))
        return wrap(F.coalesce(F.col(node["variable"]), F.lit("")))
    if kind == "date":
        parts = F.col(node["variable"])
        pad = lambda n: F.lpad(parts[n].cast("string"), 2, "0")
        return wrap(F.coalesce(F.concat_ws("-", parts[0].cast("string"), pad(1), pad(2)), F.lit("")))
    if kind == "names":
        each = F.transform(
            node["variable"],
            lambda a: F.concat(
                parse_author(a)["last"],
                F.when(
                    parse_author(a)["first"] != "", F.concat(F.lit(", "), F.left(parse_author(a)["first"], F.lit(1)), F.lit("."))
                ).otherwise(F.lit(""))
            )
        )
        n, word = F.size(each), "&" if node.get("and") == "symbol" else "and"
        joined = F.when(
            n > 1,
            F.concat(
                F.array_join(F.slice(each, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(f" {word} "), F.try_element_at(each, F.lit(-1))
            )
        ).otherwise(F.array_join(each, ""))
        return wrap(joined if "and" in node else F.array_join(each, ", "))
    if kind == "choose":
        out = None
        for branch in node["branches"]:
            if branch.get("variable") == "__none":
                holds = F.lit(False)
            else:
                holds = F.coalesce(
                    F.col(branch["variable"]).cast("string"), F.lit("")
                ) != "" if "variable" in branch else F.col("reference_type") == branch["type"]
            holds = ~holds if branch.get("match") == "none" else holds
            value = compiled({"kind": "group", "children": branch.get("children", [])}, macros)
            out = F.when(holds, value) if out is None else out.when(holds, value)
        return wrap(out.otherwise(compiled({"kind": "group", "children": node.get("otherwise", [])}, macros)))
    if kind in ("number", "label"):
        return wrap(F.coalesce(F.col(node["variable"]).cast("string"), F.lit("")) if kind == "number" else F.lit(node.get("form", "")))
    raise ValueError(f"unknown element {kind}")


#: Variables of citation styles and the library's columns.
VARIABLES = {
    "title": "title", "container-title": "journal", "author": "authors", "issued": "year", "volume": "volume", "issue": "issue", "page": "pages",
    "publisher": "publisher", "DOI": "doi", "ISBN": "isbn", "ISSN": "issn", "URL": "url", "PMID": "pmid", "abstract": "abstract_text",
    "language": "language", "note": "notes",
}


def read_style(
    xml: str, part: str = "bibliography", columns: dict[str, str] = VARIABLES, dates: tuple[str, ...] = ()
) -> tuple[dict, dict[str, dict], list[tuple[str, bool]]]:
    """(layout, macros, sort keys) of a style file's ``bibliography`` or ``citation``, for ``compiled`` and ``csl_sort``.

    ``columns`` gives the column of each variable; one without a column is empty, and as a sort key left out.
    Variables in ``dates`` have arrays of year, month and day; other dates are the text of their column.
    """
    from xml.etree import ElementTree

    root = ElementTree.fromstring(xml)
    name = lambda e: e.tag.rsplit("}", 1)[-1]
    named = lambda e, n: [x for x in e if name(x) == n]
    column = lambda e: columns.get(e.get("variable", "").split(" ")[0])
    children = lambda e: [node(x) for x in e]

    def branch(e) -> dict:
        on = {"variable": column(e) or "__none"} if "variable" in e.attrib else {"type": e.get("type", "")}
        return on | {"match": e.get("match", "all"), "children": children(e)}

    def node(e) -> dict:
        kind = name(e)
        out = {"kind": kind} | {k: e.get(k) for k in ("prefix", "suffix", "delimiter", "value", "term", "macro", "form") if k in e.attrib}
        if kind == "choose":
            tests = [branch(x) for x in e if name(x) in ("if", "else-if")]
            return out | {"branches": tests, "otherwise": [c for x in named(e, "else") for c in children(x)]}
        if kind in ("group", "layout", "macro", "substitute"):
            return out | {"children": children(e)}
        if kind == "label":
            return {"kind": "label", "form": ""}
        if "variable" in e.attrib:
            if column(e) is None:
                return {"kind": "text", "value": ""}
            out["variable"] = column(e)
            joins = [x.get("and") for x in named(e, "name") if x.get("and")]
            if kind == "names" and joins:
                out["and"] = joins[0]
            if kind == "date" and e.get("variable") not in dates:
                out["kind"] = "text"
        return out

    found = named(root, part)
    if not found or not named(found[0], "layout"):
        raise ValueError(f"a style without a {part}")
    keys = [(k, k.get("sort") == "descending") for s in named(found[0], "sort") for k in named(s, "key")]
    macros = {m.get("name"): node(m) for m in named(root, "macro")}
    return node(named(found[0], "layout")[0]), macros, [(column(k), down) for k, down in keys if column(k)]


def cite_together(refs: DataFrame, style: Column, key: str, order: str = "id") -> DataFrame:
    """(key, citation): the short forms of each citation's references in order, joined by "; "; ``refs`` has a row for each reference of a citation ``key``."""
    forms = F.array_sort(F.collect_list(F.struct(order, style.alias("c"))))
    return refs.groupBy(key).agg(F.array_join(F.transform(forms, lambda x: x["c"]), "; ").alias("citation"))
