"""What the operators share: word rules as bytes and as SQL, text functions over Arrow batches, shared scratch folders."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.session import scratch_folder

#: texts whose results a worker holds as Python objects at once
TEXTS_AT_ONCE = 256

#: what separates words once A-Z are lower-cased; any other character, accented or not, belongs to a word
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_WORD_BYTES = set(b"0123456789abcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
#: byte table for the same rule: lower-cases A-Z, keeps word bytes and turns the rest into blanks
WORD_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if (b + 32 if 65 <= b <= 90 else b) in _WORD_BYTES else 32 for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """Words of a text as an array; null and wordless texts have none."""
    plain = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS, " "))
    return F.array_remove(F.split(plain, " "), "")  # a text without words leaves one empty piece


def word_bytes(text: bytes) -> list[bytes]:
    """The same words, as UTF-8 bytes."""
    return text.translate(WORD_TABLE).split()


def text_function(per_text: Callable[[bytes], tuple], returns: str, begin: Callable[[], object] | None = None):
    """A column function that maps a text to a struct, fed with Arrow batches of texts as UTF-8 bytes.

    Null texts arrive as empty ones. ``begin``, when given, makes a task's own state, which ``per_text`` gets as a second
    argument. Results leave ``TEXTS_AT_ONCE`` at a time, and a worker, which outlives its task, gives unused Arrow memory back.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    kind = to_arrow_type(StructType.fromDDL(returns))

    def evaluate(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        state = begin() if begin else None
        for batch in batches:
            for at in range(0, max(len(batch), 1), TEXTS_AT_ONCE):
                rows = [per_text(t, state) if begin else per_text(t) for t in as_bytes(batch.slice(at, TEXTS_AT_ONCE))]
                columns = list(zip(*rows)) if rows else [[] for _ in kind]
                yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
        batch = rows = columns = None
        pa.default_memory_pool().release_unused()

    evaluate.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(evaluate, StructType.fromDDL(returns))


def as_bytes(batch: pa.Array) -> Iterable[bytes]:
    """The texts of a batch one after another, without holding all of them as Python objects."""
    raw = batch.cast(pa.large_binary() if pa.types.is_large_string(batch.type) else pa.binary())
    for item in raw:
        yield item.as_py() or b""


def free(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def with_part(df: DataFrame, out: str, whole: Column, part: str) -> DataFrame:
    """Add ``out``, one field of a struct column that is worked out once."""
    inner = free(df, "_whole")
    return df.withColumn(inner, whole).withColumn(out, F.col(inner)[part]).drop(inner)


def held_out(doc_id: Column) -> Column:
    """True for documents no model may learn from. A document without an id is neither held out nor learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


#: a scaled component beyond this counts as this, so that squares and their sums stay within a long
LARGEST = 1 << 27


def finite(vector: Column) -> Column:
    """True for vectors that are there and have finite components only."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & whole, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, held to +-2^27."""
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: used where several later steps read it."""
    spark = df.sparkSession
    path = f"{scratch_folder(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(df: DataFrame) -> DataFrame:
    """``df`` evaluated once into the shared checkpoint folder, so that a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_folder(df.sparkSession))
    return df.checkpoint(eager=True)
