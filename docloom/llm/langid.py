"""Operator 9: hierarchical language identification.

A text becomes a unit vector of hashed letter pairs and triples of the whole text. A linear support
vector machine for each language family names the family; within it, one machine for each pair of
languages votes. All machines are trained here, on a bounded sample: for every language the rows with
the smallest hashes of ``doc_id``, at most ``PER_LANGUAGE`` of them (of rows with equal ``doc_id``, those
with the smallest vectors). Held-out rows (``crc32`` of
``doc_id`` as text divisible by five) and rows without ``doc_id`` or ``lang`` never train.

A text without any letter, null and empty ones included, is ``und`` with score 0; so is every text where
nothing could be learned. Languages that the table of families lacks are families of their own.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Languages by family (ISO 639-1).
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fo", "fy", "is", "lb", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "la", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "tr", "uz"),
    "indo-aryan": ("bn", "gu", "hi", "mr", "pa", "ur"),
}

#: Bound on the training rows of one language; size of the hashed vectors.
PER_LANGUAGE, DIMENSIONS = 1000, 2048
#: Labels that can be learned at most.
MOST_LANGUAGES = 500
UNKNOWN = "und"
PREDICTION = "lang_pred string, score double"

#: Texts whose vectors are held at a time.
BATCH = 512


def family_of(lang: str) -> str:
    return next((name for name, langs in FAMILIES.items() if lang in langs), lang)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def lettered(text: str | None) -> bool:
    """Whether a text has a letter; digits, fractions, and numbers in circles are none."""
    return bool(text) and any(map(str.isalpha, text))


def has_letter(text: Column) -> Column:
    """False for null; what ``predict`` needs of a text to name a language, whatever was learned."""

    @F.pandas_udf("boolean")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([lettered(t) for t in texts], dtype=bool)

    return of(text.cast("string"))


def features(text: str | None):
    """The unit vector of a whole text, or None where it has no letter."""
    import numpy as np

    if not lettered(text):
        return None
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    # Everything in ASCII that is no letter counts as a blank.
    table = np.arange(256, dtype=np.uint32)
    table[:128][[not chr(k).isalpha() for k in range(128)]] = 32
    c = table[raw]
    pairs = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    triples = (pairs[:-1] ^ (pairs[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    counts = np.bincount(pairs >> shift, minlength=DIMENSIONS) + np.bincount(triples >> shift, minlength=DIMENSIONS)
    x = np.sqrt(counts)
    return (x / np.sqrt(np.dot(x, x))).astype(np.float32)


def train_svm(x, y, penalty: float = 1.0, epochs: int = 12):
    """Weights of a linear SVM (squared hinge loss), by dual coordinate descent; ``y`` is 1 or -1.

    The last weight is the bias. Both sides count as much, however many rows they have.
    """
    import numpy as np

    x = np.hstack((x, np.ones((len(x), 1), dtype=np.float32))).astype(np.float64)
    share = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * penalty * share)
    norms = (x * x).sum(axis=1) + slack
    w, a, rng = np.zeros(x.shape[1]), np.zeros(len(x)), np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(x)):
            gradient = y[i] * np.dot(w, x[i]) - 1 + slack[i] * a[i]
            new = max(a[i] - gradient / norms[i], 0.0)
            w += (new - a[i]) * y[i] * x[i]
            a[i] = new
    return w.astype(np.float32)


@dataclass
class Model:
    """Machines for families, and for each pair of languages of a family (the first one is positive)."""

    langs: dict[str, list[str]] = field(default_factory=dict)
    family: dict[str, object] = field(default_factory=dict)
    pairs: dict[tuple[str, str], object] = field(default_factory=dict)

    @staticmethod
    def train(x, langs: list[str]) -> Model:
        import numpy as np

        model, of = Model(), np.array(langs)
        for lang in sorted(set(langs)):
            model.langs.setdefault(family_of(lang), []).append(lang)
        families = np.array([family_of(lang) for lang in langs])
        if len(model.langs) > 1:
            model.family = {name: train_svm(x, np.where(families == name, 1, -1)) for name in model.langs}
        for members in model.langs.values():
            for a, b in itertools.combinations(members, 2):
                own = (of == a) | (of == b)
                model.pairs[a, b] = train_svm(x[own], np.where(of[own] == a, 1, -1))
        return model

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; all its vectors are multiplied by all machines at once."""
        import numpy as np

        out = [(UNKNOWN, 0.0)] * len(texts)
        found = [(k, x) for k, t in enumerate(texts) if (x := features(t)) is not None] if self.langs else []
        if not found:
            return out
        names = list(self.langs)
        machines = [*self.family.values(), *self.pairs.values()]
        x = np.stack([x for _, x in found])
        values = x @ np.stack([w[:-1] for w in machines]).T + np.array([w[-1] for w in machines]) if machines else np.zeros((len(x), 0))
        sure = 1 / (1 + np.exp(-4.0 * values))
        of = {pair: sure[:, len(self.family) + k] for k, pair in enumerate(self.pairs)}
        best = values[:, : len(self.family)].argmax(axis=1) if self.family else np.zeros(len(x), dtype=int)
        for at, (k, _) in enumerate(found):
            members = self.langs[names[best[at]]]
            wins: dict[str, list[float]] = {lang: [] for lang in members}
            for a, b in itertools.combinations(members, 2):
                p = float(of[a, b][at])
                wins[a].append(p)
                wins[b].append(1 - p)
            lang = max(members, key=lambda m: (sum(p > 0.5 for p in wins[m]), sum(wins[m])))
            likely = sum(wins[lang]) / len(wins[lang]) if wins[lang] else 1.0
            out[k] = lang, likely * (float(sure[at, best[at]]) if self.family else 1.0)
        return out


def training_rows(
    docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_languages: int = MOST_LANGUAGES
) -> DataFrame:
    """(lang, h, text) of the rows with the ``per_language`` smallest hashes of each language, ties with the last one included.

    More than ``most_languages`` labels are an error: each is a sample and a machine on the driver, and a column of many is none of languages.

    Salted top-k lists find, for every language, how small a hash must be; no text is shuffled for that.
    """
    parts, k = 16, max(1, per_language)
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.filter(F.col("lang").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"))).withColumn("h", F.xxhash64(F.lit("langid"), "id"))
    salted = rows.select("lang", "h", F.pmod("h", F.lit(parts)).alias("salt"))
    smallest = lambda df, *by: df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).filter(F.col("rn") <= k).drop("rn")
    small = smallest(smallest(salted, "lang", "salt"), "lang")
    found = small.groupBy("lang").agg(F.max("h").alias("h")).limit(most_languages + 1).collect()
    if len(found) > most_languages:
        raise ValueError(f"{lang_col} has more than {most_languages} values")
    limits = {r["lang"]: r["h"] for r in found}
    if not limits:
        return rows.select("lang", "h", "text").limit(0)
    limit = F.create_map(*(F.lit(v) for kv in limits.items() for v in kv))
    return rows.filter(F.col("h") <= limit[F.col("lang")]).select("lang", "h", "text")


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, x) of the training rows, at most ``per_language`` of a language; texts become vectors where they lie."""

    def vectors(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = [
                (lang, h, x.astype(np.float16).tobytes()) for lang, h,
                text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True) if (x := features(text)) is not None
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["lang", "h", "x"]
            )

    rows = training_rows(docs, per_language, id_col, text_col, lang_col).mapInArrow(vectors, "lang string, h long, x binary")
    # Only repeated ids make more rows than that.
    first = Window.partitionBy("lang").orderBy("h", "x")
    return rows.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= max(1, per_language)).select("lang", "x")


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Trains on the driver; what reaches it are the sample's vectors, not its texts."""
    import numpy as np

    rows = sorted(sample(docs, per_language, id_col, text_col, lang_col).collect())
    if not rows:
        return Model()
    return Model.train(np.stack([np.frombuffer(r["x"], dtype=np.float16) for r in rows]).astype(np.float32), [r["lang"] for r in rows])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; columns of these names are replaced."""

    @F.pandas_udf(PREDICTION)
    def of(texts: pd.Series) -> pd.DataFrame:
        found = [r for at in range(0, len(texts), BATCH) for r in model.predict(texts[at : at + BATCH].tolist())]
        return pd.DataFrame(found, columns=["lang_pred", "score"])

    name = "__p"
    while name in docs.columns:
        name += "_"
    return docs.withColumn(name, of(F.col(text_col).cast("string"))).withColumns(
        {"lang_pred": F.col(name)["lang_pred"], "score": F.col(name)["score"]}
    ).drop(name)
