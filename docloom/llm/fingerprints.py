"""Operator 4: document fingerprints by consistent weighted sampling.

A text is the bag of its words (between blanks and line ends); a word's weight is how often it stands
there. For each of ``SAMPLES`` positions and each word, hashes give r and c from Gamma(2, 1) and b from
[0, 1). With t = floor(ln weight / r + b) a word's value is ln c - r (t - b + 1), and the position keeps
the smallest value of the text. Two texts agree in a position with a probability equal to the
generalised Jaccard similarity of their bags: sum of smaller over sum of larger weights. The value
itself stands for the word and its t, being a function of both.

Every step is a DataFrame function. Documents are dealt once, by ranges of ``doc_id``, so that each meets
the next one; counts of words and samples are then aggregated inside that distribution. A document and
its edited text share their words up to the cut: those are counted once for both.

Equal texts have equal fingerprints; a null text counts as empty, and an empty text has one empty word.
Rows with equal ``doc_id`` follow each other in order of their texts' hashes, rows without one come last;
a single row is its own next document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLES = 32
#: Ranges of documents for each shuffle partition.
RANGES = 4
#: Stands for a missing id (and is taken for one).
_NONE = -(2**63)


def _uniform(bits: Column, shift: int) -> Column:
    """A number inside (0, 1) from 21 bits of a hash."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit((1 << 21) - 1)) + F.lit(0.5)) * F.lit(2.0**-21)


def sample_value(word: Column, log_weight: Column, position: int) -> Column:
    """The value of a word (its hash) at one position; null where the weight is zero (its logarithm null)."""
    first, second = F.xxhash64(F.lit(2 * position), word), F.xxhash64(F.lit(2 * position + 1), word)
    r = -F.log(_uniform(first, 0) * _uniform(first, 21))
    log_c = F.log(-F.log(_uniform(second, 0) * _uniform(second, 21)))
    b = _uniform(first, 42)
    return log_c - r * (F.floor(log_weight / r + b) - b + F.lit(1.0))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``key``, by two short searches."""
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[at : at + step] for at in range(0, len(bounds), step)]
    if not groups:
        return F.lit(0)
    below = lambda values: F.size(F.filter(values, lambda x: x <= key))
    group = below(F.lit([g[0] for g in groups]))
    full = F.array(*(F.lit(g) for g in groups))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + below(F.element_at(full, F.greatest(group, F.lit(1)))))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, place, ghost, doc_id, text, following): each document and the text of the next one in descending ``doc_id``.

    The first document of every range is in the range before it as well, as a ghost, so that nothing
    but whole ranges meets in a task.
    """
    spark = docs.sparkSession
    n = RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The key alone stands for the id, so that all who read this distribution need the same columns of it.
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))
    rows = docs.select(key.alias("key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    quantiles = rows.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []
    bounds = sorted({int(x) for x in quantiles})
    rows = rows.withColumn("range", _range_of(F.col("key"), bounds))
    # At most one row for each range reaches the driver.
    first = {r["range"]: r["key"] for r in rows.groupBy("range").agg(F.max("key").alias("key")).collect()}
    order = sorted(first, reverse=True)
    home = {first[b]: a for a, b in zip(order, order[1:] + order[:1], strict=True)}
    ghosts = rows.filter(F.col("key").isin(list(home)))
    for_key = F.create_map(*(F.lit(v) for kv in home.items() for v in kv)) if home else F.lit(None)
    both = rows.withColumn("ghost", F.lit(False))
    if home:
        both = both.unionByName(ghosts.withColumns({"range": for_key[F.col("key")], "ghost": F.lit(True)}))
    both = both.repartition(n, "range")
    in_range = Window.partitionBy("range").orderBy("ghost", F.col("key").desc(), F.xxhash64("text"))
    return both.select(
        "range", F.row_number().over(in_range).alias("place"), "ghost", F.nullif("key", F.lit(_NONE)).alias("doc_id"), "text",
        F.lead("text").over(in_range).alias("following")
    )


def fingerprints(docs: DataFrame, samples: int = SAMPLES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row."""
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    rows = rows.withColumns(
        {
            "stem": F.substring("text", F.lit(1), F.col("n_chars").cast("int") - cut),
            "head": F.substring(F.coalesce("following", F.lit("")), F.lit(1), cut)
        }
    )
    # The words before the last blank of the stem are in both texts; from there on they differ.
    plain = lambda c: F.replace(c, F.lit("\n"), F.lit(" "))
    edge = F.length("stem") - F.length(F.substring_index(plain(F.col("stem")), " ", -1))
    rows = rows.withColumn("edge", F.when(F.col("n_chars") == 0, F.lit(0)).otherwise(edge).cast("int"))
    shared = plain(F.substring("text", F.lit(1), F.greatest(F.col("edge") - 1, F.lit(0))))
    own = plain(F.substring("text", F.col("edge") + 1, F.lit(2**31 - 1)))
    edited = F.concat(F.substring("stem", F.col("edge") + 1, F.lit(2**31 - 1)), "head")
    split = lambda c: F.split(c, " ", -1)
    pieces = F.array(
        F.struct(F.lit(1).alias("a"), F.lit(1).alias("b"), F.when(F.col("edge") > 0, split(shared)).alias("words")),
        F.struct(F.lit(1).alias("a"), F.lit(0).alias("b"), split(own).alias("words")),
        F.struct(F.lit(0).alias("a"), F.lit(1).alias("b"), split(plain(edited)).alias("words")),
    )
    words = rows.select("range", "place", F.explode(pieces).alias("p")).select("range", "place", "p.a", "p.b", F.explode("p.words").alias("word"))
    counts = words.groupBy("range", "place", F.xxhash64("word").alias("word")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    logs = counts.withColumns({"a": F.log("a"), "b": F.log("b")})
    values = [F.min(sample_value(F.col("word"), F.col(w), k)).alias(f"{w}{k}") for k in range(samples) for w in "ab"]
    prints = logs.groupBy("range", "place").agg(*values)
    as_hex = lambda w: F.array(*(F.substring(F.hex(F.xxhash64(f"{w}{k}")), -8, 8) for k in range(samples)))
    prints = prints.select("range", "place", as_hex("a").alias("own"), as_hex("b").alias("edited"))

    told = rows.select("range", "place", "ghost", "doc_id", "n_chars", F.sha2(F.concat("stem", "head").cast("binary"), 256).alias("edited_sha256"))
    all_of_it = told.join(prints, ["range", "place"])
    likeness = lambda a, b: F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(samples))
    following = F.lead("own").over(Window.partitionBy("range").orderBy("place"))
    out = all_of_it.withColumn("following", following).filter("not ghost")
    return out.select(
        "doc_id", "n_chars", "edited_sha256", F.concat_ws("", "own").alias("fingerprint"),
        F.concat_ws("", "edited").alias("edited_fingerprint"), likeness("own", "edited").alias("near_edited"),
        likeness("own", "following").alias("near_next")
    )
