"""Schemas of the tables that operators exchange. Dates stay strings, as they are compared as such."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row for each event of a document, in the order of ``seq``.
EVENT = "seq int, kind string, tag string, depth int, text string, attrs map<string,string>"
DOC_EVENTS = "doc_id long, " + EVENT

TEXT_FIELDS = (
    "reference_type", "title", "abstract_text", "journal", "volume", "issue", "pages", "publisher", "edition", "doi", "pmid", "isbn",
    "issn", "url", "access_date", "language", "notes", "year", "date_added", "date_modified"
)
LIST_FIELDS = ("authors", "tags", "collections")
FLAG_FIELDS = ("starred", "read_status")
REFERENCE = ", ".join(
    [
        "id string", *(f"{f} string" for f in TEXT_FIELDS), *(f"{f} array<string>" for f in LIST_FIELDS),
        *(f"{f} boolean" for f in FLAG_FIELDS), "pdf_path string"
    ]
)
COLLECTION = "id string, name string, ref_ids array<string>"

SPAN = (
    "page int, text string, x float, y float, width float, font_size float, font_name string, bold boolean, italic boolean, underline "
    "boolean, strike boolean"
)
RECT = "page int, llx float, lly float, urx float, ury float"

#: A document's settings: what its front matter may set, with the values used otherwise.
CONFIG = {
    "title": "", "author": "", "date": "", "abstract_text": "", "lang": "en", "paper": "a4", "margin": "25mm", "font": "",
    "font_size": "11pt", "line_spacing": "1.0", "toc": "false", "numbering": "false", "math": "true", "theme": "default"
}


def as_references(df: DataFrame) -> DataFrame:
    """All fields of a reference in order; missing or null ones have their defaults."""
    kind = {f: F.lit("Journal Article") if f == "reference_type" else F.lit("") for f in TEXT_FIELDS}
    kind |= {f: F.array().cast("array<string>") for f in LIST_FIELDS} | {f: F.lit(False) for f in FLAG_FIELDS}
    have = set(df.columns)
    fields = [F.coalesce(F.col(f), default).alias(f) if f in have else default.alias(f) for f, default in kind.items()]
    path = F.col("pdf_path") if "pdf_path" in have else F.lit(None).cast("string")
    return df.select("id", *fields, path.alias("pdf_path"))


def merge_config(front: dict[str, str | None], base: dict[str, str] = CONFIG) -> dict:
    """Columns of settings: the front matter's value where it has one."""
    return {k: F.coalesce(front[k], F.lit(v)) if k in front else F.lit(v) for k, v in base.items()}
