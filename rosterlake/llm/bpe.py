"""BPE encoding and decoding with content-defined chunks that are encoded once and joined exactly.

A rolling hash over 16 bytes proposes cuts, so equal passages are cut alike in every document. A cut may fall inside a word, where
encodings of the two sides would disagree with that of the whole. Encodings do agree at certain places: before white space, which
no token, normalisation or special token crosses, and between an ASCII letter and the comma or full stop after it. So the join
around each cut is re-encoded as one piece from the agreeing place before the cut to the one after it, across several chunks
if need be, and the rest of each chunk keeps the encoding it has. What was encoded, chunks and their words, stays in two
bounded tables of the worker process, and new words are handed to the tokenizer; the result is that of encoding the whole text.

This holds for tokenizers whose pre-tokenizer drops white space and splits letters from punctuation (``word_bpe_49k.json``). Special
tokens written in a text are recognised, as the tokenizers library does by default. Null texts count as empty ones, which
encode to no ids. Rows are mapped one to one and other columns stay.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.llm.catalog import query
from rosterlake.llm.common import table, text_function

TOKENIZER = "word_bpe_49k.json"
#: a cut every 256 bytes on average; bounds on the entries a worker remembers
CUT_BITS = 8
MOST_WORDS, MOST_CHUNKS = 600_000, 20_000

_BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_STOP = np.isin(np.arange(256), list(b".,"))


def rolling_cuts(data: np.ndarray) -> np.ndarray:
    """Positions after which the hash of the last 16 bytes begins with ``CUT_BITS`` zero bits."""
    h, base, width = data.astype(np.uint32), np.uint32(1_000_003), 1
    while width < 16:
        if len(h) <= width:
            return np.empty(0, np.int64)
        h = h[:-width] * base + h[width:]
        base, width = np.uint32(int(base) ** 2 & 0xFFFFFFFF), 2 * width
    return np.flatnonzero((h * np.uint32(2_654_435_761)) >> np.uint32(32 - CUT_BITS) == 0) + 16


def agreeing_places(data: np.ndarray) -> np.ndarray:
    """Positions at which the encodings of both sides, put together, are the encoding of the whole; with both ends."""
    at = _BLANK[data]
    at[1:] |= _STOP[data[1:]] & _LETTER[data[:-1]]
    at[0] = True
    return np.append(np.flatnonzero(at), len(data))


class _Remembered(dict):
    """A table of bounded size: when half of it is full, what it held becomes the older half, from which entries in use return."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.older = most // 2, {}

    def __missing__(self, key):
        value = self[key] = self.older[key]
        return value

    def unknown(self, keys: set) -> set:
        older = self.older
        return {k for k in keys if k not in self and k not in older}

    def trim(self) -> None:
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()


class ChunkEncoder:
    """Encodes texts with one tokenizer, remembering words and chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.words, self.chunks = _Remembered(MOST_WORDS), _Remembered(MOST_CHUNKS)
        self.tokens = None
        if self.tokenizer.decoder is None:  # decoding then joins tokens with blanks
            self.tokens = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size())]

    def encode(self, text: bytes) -> tuple[int, bytes, str]:
        """(number of ids, ids as little-endian unsigned 32-bit integers, decoded text)."""
        if not text:
            return 0, b"", ""
        data = np.frombuffer(text, np.uint8)
        places = agreeing_places(data)
        cuts = rolling_cuts(data)
        # as numbers of places: where each cut's join begins and ends
        joins = np.concatenate([np.searchsorted(places, cuts, "right") - 1, np.searchsorted(places, cuts, "left")])
        inner = np.zeros(len(places), bool)
        inner[joins] = inner[0] = inner[-1] = True
        edges = np.flatnonzero(inner)
        at = places[edges].tolist()
        chunks = [text[i:j] for i, j in zip(at, at[1:])]
        self._learn(text, chunks, edges.tolist(), places.tolist())
        ids = b"".join(map(self.chunks.__getitem__, chunks))
        self.words.trim()
        self.chunks.trim()
        listed = np.frombuffer(ids, "<u4").tolist()
        if self.tokens is not None:
            return len(listed), ids, b" ".join(map(self.tokens.__getitem__, listed)).decode()
        return len(listed), ids, self.tokenizer.decode(listed, skip_special_tokens=False)

    def _learn(self, text: bytes, chunks: list[bytes], edges: list[int], places: list[int]) -> None:
        new = self.chunks.unknown(set(chunks))
        split = {}
        for k, chunk in enumerate(chunks):
            if chunk in new:
                new.discard(chunk)
                cut = places[edges[k]:edges[k + 1] + 1]
                split[chunk] = [text[i:j] for i, j in zip(cut, cut[1:])]
        words = list(self.words.unknown(set().union(*split.values())))
        if words:
            found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
            self.words.update((w, struct.pack(f"<{len(e.ids)}I", *e.ids)) for w, e in zip(words, found))
        known = self.words.__getitem__
        for chunk, parts in split.items():
            self.chunks[chunk] = b"".join(map(known, parts))


@lru_cache(maxsize=2)
def _encoder(path: str) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share out the cores
    return ChunkEncoder(path)


def encode(df: DataFrame, text: str = "text", out: str = "tokens", path: str | None = None) -> DataFrame:
    """Add ``out``: struct of n_tokens, ids (packed, see ``ids_of``) and decoded. ``path`` names the tokenizer's file."""
    path = path or public_tokenizers.path(TOKENIZER)
    reader = text_function(lambda t, encoder: encoder.encode(t), "n_tokens long, ids binary, decoded string", lambda: _encoder(path))
    return df.withColumn(out, reader(F.col(text)))


def ids_of(packed):
    """Column of id arrays from packed ids."""
    def unpack(batch: pa.Array) -> pa.Array:
        return pa.array([None if b is None else np.frombuffer(b, "<u4").astype(np.int64) for b in batch.to_pylist()], pa.list_(pa.int64()))
    unpack.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return F.arrow_udf(unpack, "array<long>")(packed)


def decode(df: DataFrame, ids: str = "ids", out: str = "text", path: str | None = None) -> DataFrame:
    """Add ``out``: the text of an array of ids, special tokens written out. Null ids give null."""
    path = path or public_tokenizers.path(TOKENIZER)

    def shown(batch: pa.Array) -> pa.Array:
        tokenizer = _encoder(path).tokenizer
        return pa.array([None if i is None else tokenizer.decode(i, skip_special_tokens=False) for i in batch.to_pylist()], pa.string())
    shown.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    return df.withColumn(out, F.arrow_udf(shown, "string")(F.col(ids)))


@query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("tokens")
    return encode(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "tokens").select(
        "doc_id", t["n_tokens"].alias("n_tokens"), F.sha2(t["ids"], 256).alias("ids_sha256"),
        F.sha2(t["decoded"], 256).alias("decoded_sha256"))
