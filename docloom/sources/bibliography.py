"""RIS, BibTeX, JSON libraries and web records as references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docloom.schemas import COLLECTION, REFERENCE, as_references

#: RIS types; entry types of BibTeX.
RIS_TYPES = {
    "JOUR": "Journal Article", "BOOK": "Book", "CHAP": "Book Chapter", "CONF": "Conference Paper", "CPAPER": "Conference Paper",
    "THES": "Thesis", "RPRT": "Report", "ELEC": "Website"
}
BIBTEX_TYPES = {
    "article": "Journal Article", "book": "Book", "incollection": "Book Chapter", "inproceedings": "Conference Paper",
    "conference": "Conference Paper", "phdthesis": "Thesis", "mastersthesis": "Thesis", "techreport": "Report", "misc": "Other"
}
#: Fields by RIS tag; of several lines the last counts.
RIS_FIELDS = {
    "title": ("T1", "TI"), "abstract_text": ("AB",), "journal": ("JO", "JF", "T2", "J2"), "doi": ("DO",), "year": ("PY", "Y1"),
    "volume": ("VL",), "issue": ("IS",), "publisher": ("PB",), "url": ("UR",), "language": ("LA",), "notes": ("N1", "N2")
}


def _table(values: dict[str, str], key: Column, default: str) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for kv in values.items() for x in kv))[key], F.lit(default))


def read_ris(files: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """References of RIS texts; ``id`` is the file and the record's number.

    A record begins at a ``TY`` line and ends at the next one, or at an ``ER`` line that has a value. A
    line counts with a value only.
    """
    lines = files.select(file_col, F.posexplode(F.split(text_col, r"\r?\n", -1)).alias("pos", "line")).withColumn("line", F.trim("line"))
    lines = lines.filter(F.col("line").rlike(r"^..  - .")).select(
        file_col, "pos", F.substring("line", 1, 2).alias("tag"), F.trim(F.substring("line", 7, 2**31 - 1)).alias("val")
    )
    w = Window.partitionBy(file_col).orderBy("pos")
    lines = lines.withColumns(
        {
            "record": F.sum(F.when(F.col("tag") == "TY", 1).otherwise(0)).over(w),
            "ended": F.sum(F.when(F.col("tag") == "ER", 1).otherwise(0)).over(w)
        }
    )
    lines = lines.filter("record > 0").withColumn("at_start", F.max(F.when(F.col("tag") == "TY", F.col("ended"))).over(Window.partitionBy(file_col, "record")))
    lines = lines.filter("ended = at_start")
    last = lambda tags, c="val": F.coalesce(F.max_by(c, F.when(F.col("tag").isin(*tags), F.col("pos"))), F.lit(""))
    listed = lambda *tags: F.transform(F.array_sort(F.collect_list(F.when(F.col("tag").isin(*tags), F.struct("pos", "val")))), lambda x: x["val"])
    pages = F.aggregate(
        F.array_sort(F.collect_list(F.when(F.col("tag").isin("SP", "EP"), F.struct("pos", "tag", "val")))), F.lit(""),
        lambda acc, x: F.when(acc == "", x["val"]).when(
            x["tag"] == "SP", F.concat(x["val"], F.lit("-"), acc)
        ).otherwise(F.concat(acc, F.lit("-"), x["val"]))
    )
    number = F.col("tag") == "SN"
    isbn = F.octet_length("val").isin(10, 13)
    out = lines.groupBy(file_col, "record").agg(
        _table(RIS_TYPES, last(("TY",)), "Journal Article").alias("reference_type"),
        *(last(tags).alias(f) for f, tags in RIS_FIELDS.items() if f != "year"),
        F.substring(last(RIS_FIELDS["year"]), 1, 4).alias("year"),
        F.coalesce(F.max_by("val", F.when(number & isbn, F.col("pos"))), F.lit("")).alias("isbn"),
        F.coalesce(F.max_by("val", F.when(number & ~isbn, F.col("pos"))), F.lit("")).alias("issn"),
        pages.alias("pages"), listed("AU", "A1").alias("authors"), listed("KW").alias("tags"),
    )
    return as_references(out.withColumn("id", F.concat_ws("#", file_col, F.col("record").cast("string"))).drop(file_col, "record"))


def read_bibliography(files: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """References of files that end in ``.ris`` or ``.bib``; another ending is an error."""
    ending = F.lower(F.regexp_extract(file_col, r"\.([^./\\\\]*)$", 1))
    known = F.when(ending.isin("ris", "bib"), ending).otherwise(F.raise_error(F.concat(F.lit("no reader for "), file_col)))
    of = lambda name: files.filter(known == name)
    return read_ris(of("ris"), file_col, text_col).unionByName(read_bibtex(of("bib"), file_col, text_col))


def read_bibtex(files: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    """References of BibTeX texts, an entry between two ``@``; fields stand on lines of their own.

    Entries with neither title nor authors are left out.
    """
    entries = files.select(file_col, F.posexplode(F.split(text_col, "@", -1)).alias("record", "entry")).filter("record > 0")
    kind = F.lower(F.trim(F.regexp_extract("entry", r"^([^{(]*)", 1)))
    lines = F.filter(F.transform(F.split("entry", r"\r?\n", -1), lambda x: F.trim(x)), lambda x: x.contains("="))

    def value(line: Column) -> Column:
        raw = F.trim(F.regexp_replace(F.trim(F.regexp_extract(line, "(?s)^[^=]*=(.*)$", 1)), ",+$", ""))
        return F.when(raw.rlike(r'(?s)^(\{.*\}|".*")$'), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)

    fields = F.transform(lines, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), value(x).alias("v")))
    rows = entries.select(file_col, "record", _table(BIBTEX_TYPES, kind, "Journal Article").alias("reference_type"), fields.alias("f"))
    last = lambda *names: F.coalesce(F.try_element_at(F.filter("f", lambda x: x["k"].isin(*names)), F.lit(-1))["v"], F.lit(""))
    bare = lambda c: F.regexp_replace(c, "[{}]", "")
    parts = lambda c, sep: F.filter(F.transform(F.split(c, sep, -1), lambda x: F.trim(x)), lambda x: x != "")
    out = rows.select(
        F.concat_ws("#", file_col, F.col("record").cast("string")).alias("id"), "reference_type",
        *(
            bare(last(*names)).alias(f) for f,
            names in (
                ("title", ("title",)), ("journal", ("journal", "booktitle")), ("publisher", ("publisher",)),
                ("abstract_text", ("abstract",))
            )
        ),
        *(
            last(name).alias(f) for f,
            name in (
                ("year", "year"), ("volume", "volume"), ("issue", "number"), ("doi", "doi"), ("isbn", "isbn"), ("issn", "issn"),
                ("url", "url"), ("notes", "note"), ("language", "language")
            )
        ),
        F.replace(last("pages"), F.lit("--"), F.lit("-")).alias("pages"), parts(last("author"), " and ").alias("authors"),
        parts(last("keywords"), ",").alias("tags"),
    )
    return as_references(out.filter((F.col("title") != "") | (F.size("authors") > 0)))


def read_library(spark: SparkSession, path: str, schema: str = REFERENCE) -> DataFrame:
    """A JSON library; fields that it lacks have their defaults. A folder that is missing is an empty library."""
    from pyspark.errors import AnalysisException

    try:
        rows = spark.read.schema(schema).option("multiLine", True).json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], schema)
    return as_references(rows) if schema == REFERENCE else rows


def read_collections(spark: SparkSession, path: str) -> DataFrame:
    return read_library(spark, path, COLLECTION)


def write_library(refs: DataFrame, path: str) -> None:
    refs.write.mode("overwrite").json(path)


def from_crossref(payloads: DataFrame, json_col: str = "payload") -> DataFrame:
    """References of cached answers of a DOI service (JSON)."""
    at = lambda p: F.get_json_object(json_col, p)
    authors = F.from_json(F.coalesce(at("$.message.author"), F.lit("[]")), "array<struct<given:string,family:string>>")
    year = F.regexp_extract(F.coalesce(at("$.message.issued.date-parts"), F.lit("")), r"(\d{4})", 1)
    fields = {
        "title": "$.message.title[0]", "journal": "$.message.container-title[0]", "volume": "$.message.volume", "issue": "$.message.issue",
        "pages": "$.message.page", "publisher": "$.message.publisher", "doi": "$.message.DOI", "url": "$.message.URL",
        "language": "$.message.language", "issn": "$.message.ISSN[0]"
    }
    out = payloads.select(
        "id", *(F.coalesce(at(p), F.lit("")).alias(f) for f, p in fields.items()), year.alias("year"),
        F.transform(authors, lambda a: F.concat_ws(", ", a["family"], a["given"])).alias("authors"),
        F.trim(F.regexp_replace(F.coalesce(at("$.message.abstract"), F.lit("")), "<[^>]+>", "")).alias("abstract_text")
    )
    return as_references(out)


def from_arxiv(payloads: DataFrame, xml_col: str = "payload") -> DataFrame:
    """References of cached Atom answers; the first title is the feed's."""
    found = lambda p: F.regexp_extract_all(xml_col, F.lit(p), F.lit(1))
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    out = payloads.select(
        "id", clean(F.try_element_at(found(r"(?s)<title[^>]*>(.*?)</title>"), F.lit(2))).alias("title"),
        clean(F.try_element_at(found(r"(?s)<summary[^>]*>(.*?)</summary>"), F.lit(1))).alias("abstract_text"),
        F.transform(found("(?s)<name>(.*?)</name>"), lambda x: F.trim(x)).alias("authors"),
        F.substring(clean(F.try_element_at(found("<published>(.*?)</published>"), F.lit(1))), 1, 4).alias("year"),
        F.lit("Preprint").alias("reference_type"), F.lit("arXiv").alias("journal")
    )
    return as_references(out)


def from_pubmed(payloads: DataFrame, json_col: str = "payload", pmid_col: str = "pmid") -> DataFrame:
    """References of cached PubMed summaries (JSON)."""
    doc = F.get_json_object(json_col, "$.result.record")
    at = lambda p: F.coalesce(F.get_json_object(doc, p), F.lit(""))
    authors = F.from_json(F.coalesce(F.get_json_object(doc, "$.authors"), F.lit("[]")), "array<struct<name:string>>")
    out = payloads.select(
        "id", at("$.title").alias("title"), at("$.fulljournalname").alias("journal"), at("$.volume").alias("volume"),
        at("$.issue").alias("issue"), at("$.pages").alias("pages"), F.substring(at("$.pubdate"), 1, 4).alias("year"),
        F.transform(authors, lambda a: a["name"]).alias("authors"), F.col(pmid_col).alias("pmid")
    )
    return as_references(out)


def from_open_library(payloads: DataFrame, json_col: str = "payload", isbn_col: str = "isbn") -> DataFrame:
    """References of cached book records (JSON)."""
    at = lambda p: F.coalesce(F.get_json_object(json_col, p), F.lit(""))
    names = lambda p: F.transform(
        F.from_json(F.coalesce(F.get_json_object(json_col, p), F.lit("[]")), "array<struct<name:string>>"), lambda a: a["name"]
    )
    out = payloads.select(
        "id", at("$.title").alias("title"), names("$.authors").alias("authors"),
        F.coalesce(F.try_element_at(names("$.publishers"), F.lit(1)), F.lit("")).alias("publisher"),
        F.regexp_extract(at("$.publish_date"), r"(\d{4})", 1).alias("year"), F.col(isbn_col).alias("isbn"),
        F.lit("Book").alias("reference_type")
    )
    return as_references(out)


def find_doi(text: Column) -> Column:
    """The first DOI in a text, without points and brackets at its end; empty if there is none."""
    return F.regexp_replace(F.regexp_extract(text, r"(10\.\d{4,9}/[^\s\"<>]+)", 1), r"[.,;)]+$", "")


def page_metadata(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, title, authors, journal, year, doi) from a page's meta elements; the title may be the page's own.

    Of repeated fields the first counts, of DOIs the last; authors add up.
    """
    metas = F.regexp_extract_all(html_col, F.lit(r"(?is)(<meta\s[^>]*>)"), F.lit(1))
    attr = lambda m, names: F.lower(F.regexp_extract(m, rf"""(?is)\s(?:{names})\s*=\s*["']([^"']*)["']""", 1))
    content = lambda m: F.trim(F.regexp_extract(m, r"""(?is)\scontent\s*=\s*["']([^"']*)["']""", 1))
    fields = F.transform(metas, lambda m: F.struct(attr(m, "name|property").alias("k"), content(m).alias("v")))
    rows = pages.select(id_col, F.col(html_col).alias("html"), F.filter(fields, lambda x: x["v"] != "").alias("m"))
    of = lambda *names: F.filter("m", lambda x: x["k"].isin(*names))
    first = lambda *names: F.coalesce(F.try_element_at(of(*names), F.lit(1))["v"], F.lit(""))
    own = F.trim(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    doi = F.coalesce(F.try_element_at(of("citation_doi", "dc.identifier", "prism.doi"), F.lit(-1))["v"], F.lit(""))
    doi = F.when(doi.startswith("10."), doi).when(doi.contains("doi.org/"), F.regexp_extract(doi, r"doi\.org/(.*)$", 1)).otherwise("")
    title = first("citation_title", "og:title", "dc.title")
    return rows.select(
        id_col, F.when(title != "", title).otherwise(own).alias("title"),
        F.transform(of("citation_author", "author", "dc.creator"), lambda x: x["v"]).alias("authors"),
        first("citation_journal_title", "og:site_name").alias("journal"),
        F.regexp_extract(
            first("citation_publication_date", "citation_date", "dc.date", "article:published_time"), r"(\d{4})", 1
        ).alias("year"),
        doi.alias("doi")
    )
