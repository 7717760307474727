"""A library of references: searching, sorting, counting, merging, syncing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def contains(haystack: Column, needle: str) -> Column:
    return F.lower(haystack).contains(needle.lower()) if needle else F.lit(True)


def search(refs: DataFrame, query: str) -> DataFrame:
    """Rows that have the query, whatever its case, in a field; an abstract isn't searched."""
    hay = F.concat_ws(" ", "title", F.concat_ws(" ", "authors"), "year", "journal", "doi", "pmid", "isbn", F.concat_ws(" ", "tags"), "notes")
    return refs.filter(contains(hay, query))


def starred(refs: DataFrame) -> DataFrame:
    return refs.filter("starred")


def unread(refs: DataFrame) -> DataFrame:
    return refs.filter("not read_status")


def recent(refs: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Added less than so many days before ``as_of``; later dates count as well."""
    return refs.filter(F.datediff(F.lit(as_of).cast("date"), F.to_date("date_added")) < days)


def of_type(refs: DataFrame, kind: str) -> DataFrame:
    return refs.filter(F.col("reference_type") == kind)


def in_collection(refs: DataFrame, collections: DataFrame, collection_id: str) -> DataFrame:
    """Members of a collection; none, if there is no such collection."""
    members = collections.filter(F.col("id") == collection_id).select(F.explode("ref_ids").alias("id"))
    return refs.join(members, "id", "left_semi")


def pick_citation(refs: DataFrame, query: str) -> DataFrame:
    """Title, an author or the year has the query."""
    return refs.filter(contains(F.col("title"), query) | contains(F.concat_ws(", ", "authors"), query) | contains(F.col("year"), query))


def pick_source(refs: DataFrame, query: str) -> DataFrame:
    """Author, title and year are searched as one text, so a query can span them."""
    return refs.filter(contains(F.concat(F.concat_ws(", ", "authors"), "title", "year"), query))


def with_caption(df: DataFrame, text_col: str, prefix: str) -> DataFrame:
    return df.filter(F.lower(F.trim(text_col)).startswith(prefix.lower()))


def sort_refs(refs: DataFrame, by: str, descending: bool = False, tie: str = "id", locale: bool = True) -> DataFrame:
    """By a field; of authors, the first. ``locale`` orders letters as a dictionary does."""
    key = F.coalesce(F.try_element_at("authors", F.lit(1)) if by == "authors" else F.col(by).cast("string"), F.lit(""))
    key = F.collate(key, "UNICODE") if locale else key
    return refs.orderBy(key.desc() if descending else key.asc(), tie)


def csl_sort(refs: DataFrame, keys: list[tuple[str, bool]], tie: str = "id") -> DataFrame:
    """Several keys (field, descending): lower case, missing ones first if ascending and last if not."""
    order = []
    for field, descending in keys:
        key = F.lower(F.array_join(field, "; ")) if dict(refs.dtypes)[field].startswith("array") else F.lower(F.col(field).cast("string"))
        key = F.nullif(key, F.lit(""))
        order.append(key.desc_nulls_last() if descending else key.asc_nulls_first())
    return refs.orderBy(*order, tie)


def nav_counts(refs: DataFrame) -> DataFrame:
    return refs.agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.col("starred")).alias("n_starred"), F.count_if(~F.col("read_status")).alias("n_unread"))


def collection_sizes(collections: DataFrame) -> DataFrame:
    return collections.select("id", "name", F.size("ref_ids").cast("long").alias("n_refs"))


def member_counts(members: DataFrame) -> DataFrame:
    """(id, name, n_refs) of members that are rows (id, name, ref_id): no collection is brought together."""
    return members.groupBy("id").agg(F.min("name").alias("name"), F.count("ref_id").alias("n_refs"))


def term_index(df: DataFrame, term_col: str) -> DataFrame:
    """(term, n), terms in the order of their code units."""
    return df.groupBy(F.col(term_col).alias("term")).agg(F.count(F.lit(1)).alias("n")).orderBy("term")


def dedup_first_seen(df: DataFrame, key: Column, position: Column) -> DataFrame:
    """The first row of each trimmed, lower-cased key; rows without key all stay.

    Only keys and positions meet in the shuffle: the first position of each key is a partial minimum.
    """
    marked = df.withColumns({"__key": F.lower(F.trim(key)), "__at": position})
    has = F.coalesce(F.col("__key") != "", F.lit(False))
    first = marked.filter(has).groupBy("__key").agg(F.min("__at").alias("__at"))
    kept = marked.filter(has).join(first, ["__key", "__at"], "left_semi")
    return kept.unionByName(marked.filter(~has)).drop("__key", "__at")


def last_writer_wins(local: DataFrame, remote: DataFrame, key: str = "id", stamp: str = "date_modified") -> DataFrame:
    """All keys of both sides; of a key on both, the remote row only if its stamp is greater. Ties stay local."""
    columns = [c for c in local.columns if c != key]
    a, b = local.alias("a"), remote.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    take = F.col(f"a.{key}").isNull() | F.coalesce(F.col(f"b.{stamp}") > F.col(f"a.{stamp}"), F.lit(False))
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *(F.when(take, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in columns))


def merge_collections(local: DataFrame, remote: DataFrame) -> DataFrame:
    """Members of a collection on both sides are united and sorted; others stay as they are. Names stay local."""
    a, b = local.alias("a"), remote.alias("b")
    joined = a.join(b, F.col("a.id") == F.col("b.id"), "full_outer")
    both = F.col("a.id").isNotNull() & F.col("b.id").isNotNull()
    ids = F.when(both, F.array_sort(F.array_union("a.ref_ids", "b.ref_ids"))).otherwise(F.coalesce("a.ref_ids", "b.ref_ids"))
    return joined.select(F.coalesce("a.id", "b.id").alias("id"), F.coalesce("a.name", "b.name").alias("name"), ids.alias("ref_ids"))


def append_absent(main: DataFrame, more: DataFrame, key: str = "id") -> DataFrame:
    """``main`` and those rows of ``more`` whose key it lacks."""
    return main.unionByName(more.join(main.select(key), key, "left_anti"))


def library_hash(refs: DataFrame, collections: DataFrame | None = None, key: str = "id") -> DataFrame:
    """(library_hash, n): a digest of a library's references and collections, whatever the order of rows and columns.

    Rows are hashed one by one, and sums of hashes of 256 buckets of keys one level up, so no task holds the
    library: one SHA-256 over all of it, as a single file's, would need its bytes in a row. ``n`` counts references.
    """
    digest = F.substring(F.sha2(F.concat("kind", "key"), 256), 1, 2)

    def hashed(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("key"), F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256).alias("h"))

    rows = hashed(refs, "reference")
    if collections is not None:
        rows = rows.unionByName(hashed(collections, "collection"))
    part = lambda at: F.sum(F.conv(F.substring("h", at, 15), 16, 10).cast("decimal(38,0)"))
    own = F.sum((F.col("kind") == "reference").cast("long"))
    sums = rows.groupBy(digest.alias("bucket")).agg(part(1).alias("s1"), part(16).alias("s2"), F.count(F.lit(1)).alias("rows"), own.alias("n"))
    lines = F.array_sort(F.collect_list(F.concat_ws(":", "bucket", "s1", "s2", "rows")))
    return sums.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("library_hash"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def resolve_citations(cites: DataFrame, refs: DataFrame, doc: str = "doc_id", cite: str = "ref_id", seq: str = "seq") -> DataFrame:
    """(doc, number, ref_id and the reference's columns): distinct ids numbered as first seen in their document.

    Ids that the library lacks keep their number and have no entry.
    """
    first = cites.groupBy(doc, cite).agg(F.min(seq).alias("__first"))
    numbered = first.withColumn("number", F.row_number().over(Window.partitionBy(doc).orderBy("__first", cite)).cast("long"))
    return numbered.drop("__first").join(refs, numbered[cite] == refs["id"]).drop("id")


def update_from_web(
    refs: DataFrame, fetched: DataFrame,
    own: tuple[str, ...] = ("id", "tags", "notes", "starred", "read_status", "pdf_path", "date_added", "collections")
) -> DataFrame:
    """Fetched fields replace a reference's, but for those that are the user's own."""
    a, b = refs.alias("a"), fetched.alias("b")
    joined = a.join(b, F.col("a.id") == F.col("b.id"), "left")
    has = F.col("b.id").isNotNull()
    take = lambda c: F.col(f"a.{c}") if c in own or c not in fetched.columns else F.when(has, F.coalesce(f"b.{c}", f"a.{c}")).otherwise(F.col(f"a.{c}")).alias(c)
    return joined.select(*(take(c) for c in refs.columns))


def recent_files(opened: DataFrame, name: str, at: str, limit: int) -> DataFrame:
    """The latest opening of each name, newest first."""
    latest = opened.groupBy(name).agg(F.max(at).alias(at))
    return latest.orderBy(F.col(at).desc(), name).limit(limit)


def latest_version(df: DataFrame, at: str, tie: str, limit: int = 1) -> DataFrame:
    """The newest versions, newest first: a history holds ``limit`` of them."""
    return df.orderBy(F.col(at).desc(), F.col(tie).desc()).limit(limit)


#: Badge classes and letters of types.
BADGES = {"Journal Article": "journal", "Book": "book", "Book Chapter": "book", "Conference Paper": "conf", "Thesis": "thesis", "Preprint": "preprint"}
LETTERS = {
    "Journal Article": "J", "Book": "B", "Book Chapter": "B", "Conference Paper": "C", "Thesis": "T", "Report": "R", "Preprint": "P",
    "Website": "W", "Patent": "P"
}


def badge(kind: Column) -> Column:
    """(css, letter) of a reference's type."""
    look = lambda table, default: F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[kind], F.lit(default))
    return F.struct(look(BADGES, "other").alias("css"), look(LETTERS, "O").alias("letter"))


def short_authors(authors: Column, most: int = 2) -> Column:
    """The first authors, and "et al." if there are more."""
    return F.concat(F.array_join(F.slice(authors, 1, most), ", "), F.when(F.size(authors) > most, F.lit(" et al.")).otherwise(F.lit("")))
