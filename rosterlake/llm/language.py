"""Language identification in two steps: the family first, then one-versus-one linear SVMs between the languages of that family.

A text is a vector of hashed character trigrams (square roots of counts, unit length), taken over the whole text in pieces.
Families come from ``FAMILIES``; a language that is not in it is a family of its own. The machines between families and those
between the languages of one are fitted on the driver, on at most ``PER_LANGUAGE`` documents of each language, chosen by the
hash of their id among the documents that may be learnt from; languages are few by nature, so the sample is bounded.

A null text and one without a letter is ``und`` with score 0; so is every text when there is nothing to learn from. With
one known language every text with letters gets it. A letter is a character of the Unicode categories L, in learning and in
prediction, so fractions, circled digits and Roman numeral signs are none. Very long texts are read whole, a piece of ``_PIECE``
characters at a time. Rows map one to one; repeated rows and null ids stay, other columns are kept, one named ``out`` is replaced.
An id that stands in several rows teaches once: by its least language, then the text of least hash.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import held_out, learnable, table, text_function
from rosterlake.llm.linear import fit_svm, sigmoid

#: documents of each language that a model learns from
PER_LANGUAGE = 400
BUCKETS = 4096
UNKNOWN = "und"
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic", "is": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance", "gl": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic", "sk": "slavic", "bg": "slavic", "sr": "slavic", "hr": "slavic",
    "fi": "finnic", "et": "finnic", "hi": "indic", "bn": "indic", "mr": "indic", "ta": "dravidian", "te": "dravidian",
    "zh": "sinitic", "ar": "semitic", "he": "semitic"}

_ASCII_OTHER = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
_PIECE = 1 << 20


def features(text: str) -> np.ndarray:
    """Unit vector of the trigrams of a lower-cased text."""
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(text), _PIECE):
        raw = b" " + text[at:at + _PIECE].lower().encode("utf-8", "replace").translate(_ASCII_OTHER) + b" "
        x = np.frombuffer(raw, np.uint8).astype(np.uint32)
        code = (x[:-2] << np.uint32(16)) | (x[1:-1] << np.uint32(8)) | x[2:]
        counts += np.bincount((code * np.uint32(2_654_435_761)) >> np.uint32(20), minlength=BUCKETS)
    v = np.sqrt(counts.astype(np.float32))
    return v / max(float(np.linalg.norm(v)), 1e-9)


class Duels:
    """One-versus-one machines between classes; the class with most votes wins, larger margins break ties."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.classes = sorted(set(y.tolist()))
        self.pairs = list(combinations(range(len(self.classes)), 2))
        weights, bias = [], []
        for a, b in self.pairs:
            rows = (y == self.classes[a]) | (y == self.classes[b])
            w, c = fit_svm(x[rows], y[rows] == self.classes[a])
            weights.append(w)
            bias.append(c)
        self.weights = np.array(weights, np.float32).reshape(len(self.pairs), x.shape[1])
        self.bias = np.array(bias, np.float32)

    def decide(self, v: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.classes[0], 1.0
        margins = self.weights @ v + self.bias
        votes = np.zeros(len(self.classes))
        for (a, b), m in zip(self.pairs, margins.tolist()):
            votes[a if m > 0 else b] += 1 + 1e-3 * abs(float(np.tanh(m)))
        best = int(votes.argmax())
        own = [m if a == best else -m for (a, b), m in zip(self.pairs, margins.tolist()) if best in (a, b)]
        return self.classes[best], float(min(sigmoid(4.0 * np.array(own))))


class Model:
    """The machine between families and, for each family, the one between its languages."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        family = np.array([FAMILIES.get(lang, f"only {lang}") for lang in langs.tolist()])
        self.families = Duels(x, family) if len(langs) else None
        self.within = {f: Duels(x[family == f], langs[family == f]) for f in set(family.tolist())}

    def decide(self, text: bytes) -> tuple[str, float]:
        shown = text.decode("utf-8", "replace")
        if self.families is None or not any(map(str.isalpha, shown)):
            return UNKNOWN, 0.0
        v = features(shown)
        family, sure = self.families.decide(v)
        lang, surer = self.within[family].decide(v)
        return lang, sure * surer


def fit(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Learn from rows with a language and a letter whose id is not held out."""
    known = df.where(learnable(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(
        F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"), F.xxhash64(F.col(text)).alias("_hash"))
    one = known.groupBy("_id").agg(F.min(F.struct("_lang", "_hash")).alias("_row")).select("_id", "_row.*")
    order = Window.partitionBy("_lang").orderBy(F.xxhash64(F.col("_id").cast("string")), "_id")
    chosen = one.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= per_language).drop("_r")
    packed = text_function(lambda t: (features(t.decode("utf-8", "replace")).astype("<f2").tobytes(),), "v binary")
    rows = (known.join(F.broadcast(chosen), ["_id", "_lang", "_hash"], "left_semi").dropDuplicates(["_id"])
            .select("_id", "_lang", packed(F.col("_text"))["v"].alias("v")).orderBy("_id").collect())
    x = np.array([np.frombuffer(r["v"], "<f2") for r in rows], np.float32).reshape(len(rows), BUCKETS)
    return Model(x, np.array([r["_lang"] for r in rows], dtype=object).astype(str) if rows else np.array([], str))


def predict(df: DataFrame, model: Model, text: str = "text", out: str = "language") -> DataFrame:
    """Add ``out``: struct of lang and score."""
    return df.withColumn(out, text_function(lambda t: model.decide(t), "lang string, score double")(F.col(text)))


@query("op9_language")
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs.select("doc_id", "text"), fit(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))
