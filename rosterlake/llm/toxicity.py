"""Toxicity: a subsequence string-kernel SVM with Nyström landmarks over words, read as a score of the whole text.

The kernel compares two words by their common subsequences of three and four characters, which need not be adjacent: every gap costs a
factor of ``DECAY`` and a subsequence spans ``SPAN`` characters at most, so inserted, dropped or changed characters leave most of
the similarity. Word ends count as characters. The Nyström features of a word are its kernel values against landmark words,
whitened; a linear SVM separates words in that space. Its decision is a weighted sum of kernels to the landmarks, that is
of subsequence weights, so it is evaluated as one table of weights, exactly, in time linear in the word.

Labels exist for texts, not for words. Words are taught as toxic when toxic texts have them far more often than clean ones, and
as clean when they don't; a logistic curve over a text's strongest word and its number of toxic words, fitted on the labelled
texts, turns decisions into the score. Before that, punctuation inside words is dropped and letters spelt one by one are
joined. All words of the whole text are read.

Learning takes labelled texts of ids that may be learnt from: at most ``MOST_TEXTS`` of each label by the hash of the id, ``MOST_WORDS``
toxic words and as many frequent, rare and mistaken clean ones, ``LANDMARKS`` landmarks. Rows with a null label teach nothing. Without toxic or
without clean texts every score is the share of toxic ones (0 without labels). Null and empty texts are scored like any other.
"""

from __future__ import annotations

import re
import string
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import free, held_out, learnable, stored, table, text_function, with_part
from rosterlake.llm.linear import fit_logistic, fit_svm, sigmoid

MOST_TEXTS, MOST_WORDS, LANDMARKS = 6000, 1500, 512
DECAY, SPAN, BITS = 0.5, 5, 18
THRESHOLD = 0.3
#: decision from which a word counts among the toxic ones of a text
SURE = 0.5
#: a word is taught as toxic when at least so many, and such a share, of the toxic texts have it, at odds so much above the clean ones
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 4, 0.004, 2.5
#: words whose decisions a worker remembers
MOST_REMEMBERED = 500_000

_PUNCTUATION = string.punctuation.encode()
_SPELT = re.compile(rb"(?<!\S)(?:[a-z]\s){3,}[a-z](?!\S)")
#: places of a subsequence's further characters after its first: two or three of them
_OFFSETS = [d for n in (2, 3) for d in combinations(range(1, SPAN), n)]


def words_in(text: bytes) -> set[bytes]:
    """Distinct words of a text, lower-cased, without punctuation; runs of single letters are one word."""
    low = text.decode("utf-8", "replace").lower().encode("utf-8", "replace").translate(None, _PUNCTUATION)
    words = set(low.split())
    words.update(re.sub(rb"\s", b"", run) for run in _SPELT.findall(low))
    return words


def subsequences(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word number, subsequence bucket, weight) of every occurrence in the words, and the norm of each word."""
    marked = [b"\x02" + w + b"\x03" for w in words]
    lengths = np.array([len(m) for m in marked])
    x = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(words)), lengths)
    own, code, weight = [], [], []
    for places in _OFFSETS:
        last = places[-1]
        n = len(x) - last
        if n <= 0:
            continue
        inside = owner[:n] == owner[last:]
        chain = x[:n].copy()
        for d in places:
            chain = chain * np.uint32(1_000_003) + x[d:d + n] + np.uint32(1)
        own.append(owner[:n][inside])
        code.append(((chain * np.uint32(2_654_435_761)) >> np.uint32(32 - BITS))[inside])
        weight.append(np.full(len(own[-1]), DECAY ** (last - len(places)), np.float32))
    if not own:
        return np.empty(0, int), np.empty(0, int), np.empty(0, np.float32), np.ones(len(words))
    own, code, weight = np.concatenate(own), np.concatenate(code), np.concatenate(weight)
    norm = np.sqrt(np.bincount(own, weight.astype(np.float64) ** 2, len(words)))
    return own, code, weight, np.maximum(norm, 1e-9)


class WordMachine:
    """The SVM over words. ``weights`` is its table of subsequence weights."""

    def __init__(self, toxic: list[tuple[bytes, int]], clean: list[bytes], landmarks: int = LANDMARKS):
        """``toxic``: words and how many toxic texts have them, most frequent first; ``clean``: most telling first."""
        words = [w for w, _ in toxic] + clean
        y = np.arange(len(words)) < len(toxic)
        share = np.array([float(n) for _, n in toxic] + [1.0] * len(clean))
        chosen = [*range(min(len(toxic), landmarks // 2)), *range(len(toxic), min(len(words), len(toxic) + landmarks // 2))]
        own, code, weight, norm = subsequences([words[i] for i in chosen])
        columns, place = np.unique(code, return_inverse=True)
        basis = np.zeros((len(chosen), len(columns)), np.float32)
        np.add.at(basis, (own, place), weight / norm[own])
        kernel = basis @ basis.T
        values, vectors = np.linalg.eigh(kernel.astype(np.float64))
        keep = values > 1e-6 * values.max()
        white = vectors[:, keep] / np.sqrt(values[keep])
        by_column = np.ascontiguousarray(basis.T)
        rows = []
        for word in words:
            _, code, weight, norm = subsequences([word])
            spot = np.minimum(np.searchsorted(columns, code), len(columns) - 1)
            rows.append(np.where(columns[spot] == code, weight / norm[0], 0.0).astype(np.float32) @ by_column[spot])
        rows = np.vstack(rows) @ white
        v, self.bias = fit_svm(rows, y, cost=3000.0, rounds=600, weight=share)
        self.weights = np.zeros(1 << BITS, np.float32)
        self.weights[columns] = (white @ v) @ basis

    def decide(self, words: list[bytes]) -> np.ndarray:
        own, code, weight, norm = subsequences(words)
        return np.bincount(own, weight * self.weights[code], len(words)) / norm + self.bias


class Scorer:
    """Scores texts with a word machine and a curve; remembers decisions on words up to a bound."""

    def __init__(self, machine: WordMachine | None, curve: np.ndarray | None, base: float = 0.0):
        self.machine, self.curve, self.base, self.known = machine, curve, base, {}

    def reading(self, text: bytes) -> tuple[float, float]:
        """(decision of the strongest word, log of one more than the number of toxic words)."""
        words = words_in(text)
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) + len(new) > MOST_REMEMBERED:
                known.clear()
                new = list(words)
            for at in range(0, len(new), 65_536):
                piece = new[at:at + 65_536]
                known.update(zip(piece, self.machine.decide(piece).tolist()))
        margins = [known[w] for w in words]
        return (max(margins), float(np.log1p(sum(m > SURE for m in margins)))) if margins else (-2.0, 0.0)

    def score(self, text: bytes) -> float:
        if self.machine is None:
            return self.base
        strongest, many = self.reading(text)
        return float(sigmoid(self.curve[0] * strongest + self.curve[1] * many + self.curve[2]))

    def __getstate__(self):
        return {"machine": self.machine, "curve": self.curve, "base": self.base, "known": {}}


def _decisions(machine: WordMachine):
    """Column function from words to a machine's decisions."""
    def decide(batch: pa.Array) -> pa.Array:
        words = [w.encode() for w in batch.to_pylist()]
        return pa.array(np.concatenate([machine.decide(words[at:at + 4096]) for at in range(0, len(words), 4096)] or [np.empty(0)]), pa.float64())
    decide.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(decide, "double")


def fit(documents: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Scorer:
    """Learn from the labelled documents that are not held out. A document labelled more than once counts as toxic if it ever is."""
    known = (labels.where(learnable(F.col(doc_id)) & F.col(toxic).isin(0, 1)).groupBy(F.col(doc_id).alias("_id"))
             .agg(F.max(toxic).alias("_y")))
    totals = {r["_y"]: r["n"] for r in known.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not totals.get(0) or not totals.get(1):
        return Scorer(None, None, float(bool(totals.get(1))))
    order = (F.xxhash64(F.col("_id").cast("string")), "_id")
    chosen = known.where("_y = 1").orderBy(*order).limit(MOST_TEXTS).unionByName(known.where("_y = 0").orderBy(*order).limit(MOST_TEXTS))
    texts = stored(documents.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id"))
    split = text_function(lambda t: ([w.decode("utf-8", "replace") for w in words_in(t)],), "words array<string>")
    counts = stored(texts.select("_y", F.explode(split("_text")["words"]).alias("word")).groupBy("word").agg(
        F.count_if(F.col("_y") == 1).alias("t"), F.count_if(F.col("_y") == 0).alias("c")))
    sizes = {r["_y"]: r["n"] for r in texts.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Scorer(None, None, totals[1] / (totals[0] + totals[1]))
    odds = F.log((F.col("t") + 0.5) / (sizes[1] + 1.0)) - F.log((F.col("c") + 0.5) / (sizes[0] + 1.0))
    ranked = counts.withColumn("odds", odds)

    def taken(rows, *columns):
        return [tuple(r) if len(columns) > 1 else r[0] for r in rows.select(*columns).limit(MOST_WORDS).collect()]
    bad = [(w.encode(), n) for w, n in taken(ranked.where((F.col("t") >= max(LEAST_TEXTS, LEAST_SHARE * sizes[1])) & (F.col("odds") >= LEAST_ODDS)).orderBy(F.desc("t"), "word"), "word", "t")]
    usual = taken(ranked.where("c >= 3 AND odds < 1").orderBy(F.desc("c"), "word"), "word")
    rare = taken(ranked.where("t = 0").orderBy(F.xxhash64("word"), "word"), "word")
    clean = [w.encode() for w in dict.fromkeys(rare + usual)]
    if not bad or not clean:
        return Scorer(None, None, totals[1] / (totals[0] + totals[1]))
    machine = WordMachine(bad, clean)
    # the clean words that the first machine takes for toxic teach the second one
    hard = taken(counts.where("t = 0").select("word", _decisions(machine)("word").alias("m")).orderBy(F.desc("m"), "word"), "word")
    scorer = Scorer(WordMachine(bad, list(dict.fromkeys([w.encode() for w in hard] + clean))), None)
    read = text_function(lambda t: scorer.reading(t), "strongest double, many double")
    seen = texts.select("_y", read("_text").alias("r")).select("_y", "r.*").toPandas().sort_values(["_y", "strongest", "many"])
    y = seen["_y"].to_numpy(float)
    weight = np.where(y == 1, totals[1] / sizes[1], totals[0] / sizes[0])
    scorer.curve = fit_logistic(seen[["strongest", "many"]].to_numpy(float), y, weight)
    return scorer


def score(df: DataFrame, scorer: Scorer, text: str = "text", out: str = "toxicity") -> DataFrame:
    """Add ``out``, the score from 0 to 1 of every whole text."""
    read = text_function(lambda t: (scorer.score(t),), "score double")
    return with_part(df, out, read(F.col(text)), "score")


def keep_clean(df: DataFrame, scorer: Scorer, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose score stays below ``threshold``, columns unchanged."""
    mark = free(df, "_score")
    return score(df, scorer, text, mark).where(F.col(mark) < threshold).select(*df.columns)


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")), out="score")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
