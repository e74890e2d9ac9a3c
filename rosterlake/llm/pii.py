"""Personal data (native): patterns propose spans, checksums confirm them, words nearby move the score.

Everything is column expressions on one row, so there is no shuffle and no Python. Patterns are written with possessive
repeats and start where a run starts, so the engine reads a text once for each kind, whatever it holds; they find what the plain
patterns ``email``, ``ip``, ``card`` and ``phone`` of the contract find, leftmost and without overlap within a kind. Runs of
fewer than twelve digits are no card candidates. Places are running sums built by doubling, so a text of n matches
costs n log n, and the words before a match come from its neighbouring pieces, not from the start of the text.

* ``email``; ``ip`` with parts up to 255; ``card`` with 12 to 19 digits that pass Luhn; ``phone`` with 9 to 15 digits.
  These base spans are always reported.
* ``iban`` (mod-97 must be 1) and ``national_id`` (no checksum) are added by score: a confirmed checksum or the form gives a
  start value, words such as "card" or "ssn" shortly before the span raise it, words such as "order" or "version" lower it.

Null and empty texts give zero counts and empty lists; rows are mapped one to one, so repeated rows and null ids stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import free, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id")
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
PATTERNS = {
    # an address starts with its run of name characters, or where the address before it ended
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    # from the start of a run of digits with single separators, twelve digits or more
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: a cheap test that spares most texts the pattern
HINTS = {"email": "@", "phone": "+", "ip": ".", "national_id": "-"}
START = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "national_id": 0.4}
RAISING = {
    "email": "mail|contact|write", "ip": r"\bip\b|address|host|server", "card": "card|visa|credit|payment|pay",
    "phone": "phone|tel|call|mobile|fax", "iban": "iban|account|bank|transfer", "national_id": "ssn|social|security|national|tax"}
LOWERING = r"\bversion\b|\border\b|\binvoice\b|\bserial\b|\bisbn\b|\bpart\b"
CONTEXT, STEP, LEAST = 40, 0.2, 0.5


#: no pattern matches fewer characters, so the context holds at most this many earlier matches of its kind
BACK = CONTEXT // 4
SPANS = "array<struct<start:int,rank:int,end:int,kind:string,match:string,score:double>>"


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.transform(F.array(value), use)[0]


def _running_sums(sizes: Column) -> Column:
    """The sum up to and with each place of an array, in about log2(n) passes."""
    def double(sums, step):
        return F.transform(sums, lambda x, i: x + F.when(i >= step, F.get(sums, i - step)).otherwise(F.lit(0)))

    steps = F.array(*[F.lit(1 << k) for k in range(31)])
    return _with(sizes, lambda s: F.aggregate(F.filter(steps, lambda step: step < F.size(s)), s, double))


def _found(text: Column, kind: str, rank: int) -> Column:
    """The confirmed matches of a kind with their scores; places count code points, the end is exclusive."""
    pattern = PATTERNS[kind]
    empty = F.array().cast(SPANS)

    def tail(piece, match):
        return F.right(F.concat(piece, F.coalesce(match, F.lit(""))), F.lit(CONTEXT))

    def before(w, i):
        near = F.array_join(F.slice(w["tails"], F.greatest(i - BACK, F.lit(0)) + 1, F.least(i, F.lit(BACK))), "")
        return F.lower(F.right(F.concat(near, F.right(F.get(w["pieces"], i), F.lit(CONTEXT))), F.lit(CONTEXT)))

    def placed(v):
        # the piece after the last match pairs up with null
        sizes = F.zip_with(v["pieces"], v["matches"], lambda p, m: F.length(p) + F.coalesce(F.length(m), F.lit(0)))
        return F.struct(v["pieces"].alias("pieces"), v["matches"].alias("matches"), _running_sums(sizes).alias("ends"),
                        F.zip_with(v["pieces"], v["matches"], tail).alias("tails"))

    def spans(w):
        numbered = F.transform(w["matches"], lambda m, i: F.struct(i.alias("i"), m.alias("match"), F.get(w["ends"], i).alias("end")))
        kept = F.filter(numbered, lambda s: _confirmed(kind, s["match"]))
        return F.transform(kept, lambda s: F.struct(
            (s["end"] - F.length(s["match"])).alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind"),
            s["match"].alias("match"), _score(before(w, s["i"]), kind).alias("score")))

    split = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    found = _with(split, lambda v: F.when(F.size(v["matches"]) > 0, _with(placed(v), spans)).otherwise(empty))
    hint = HINTS.get(kind)
    return F.when(F.contains(text, F.lit(hint)), found).otherwise(empty) if hint else found


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True where a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc, i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((n - i) % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """True where a compact IBAN has the remainder 1."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def add(acc, c):
        letter = F.ascii(c) - 55
        return F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(add(acc, c))) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        # a part of zeros only is empty once they are cut
        return ~F.exists(F.transform(F.split(match, r"\."), lambda part: F.ltrim(part, F.lit("0"))), lambda part: (F.length(part) > 3) | F.coalesce(
            F.substring(part, 1, 3).try_cast("int") > 255, F.lit(False)))
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        compact = F.regexp_replace(match, " ", "")
        return F.when(F.length(compact).between(15, 34), mod97(compact)).otherwise(False)
    return F.lit(True)


def _score(before: Column, kind: str) -> Column:
    moved = (F.lit(START[kind]) + F.when(before.rlike(RAISING[kind]), STEP).otherwise(0.0)
             - F.when(before.rlike(LOWERING), STEP).otherwise(0.0))
    return F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))


def find(df: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """Add ``out``: array of (start, rank, end, kind, match, score), by start, then by the order of ``KINDS``.

    ``df`` may have any other columns; one named ``out`` is replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    kinds = []
    for rank, kind in enumerate(KINDS):
        spans = _found(whole, kind, rank)
        kinds.append(spans if kind in BASE_KINDS else F.filter(spans, lambda s: s["score"] >= LEAST))
    return df.withColumn(out, F.array_sort(F.concat(*kinds)))


def redact(df: DataFrame, text: str = "text", pii: str = "pii") -> DataFrame:
    """Replace every span of ``pii`` in ``text`` by its kind in brackets; where spans overlap, the first one stands."""
    def step(acc, s):
        free = s["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(free, F.struct(s["end"].alias("at"), kept.alias("out"))).otherwise(acc)

    done = F.aggregate(pii, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    inner = free(df, "_done")
    return df.withColumn(inner, done).withColumn(text, F.concat(
        F.col(inner)["out"], F.substring(F.col(text), F.col(inner)["at"] + 1, F.length(text)))).drop(inner)


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "pii")
    base = F.filter("pii", lambda s: s["rank"] < len(BASE_KINDS))
    counts = [F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(
        "doc_id", *counts[:4], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"), *counts[4:],
        F.concat_ws(",", F.transform("pii", lambda s: F.format_number(s["score"], 2))).alias("scores"))
