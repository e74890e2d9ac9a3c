"""Big CSV files parsed in parallel, row for row as one reader would (A1).

Spark cuts a file into byte ranges at line ends; whether a line begins inside a quoted cell is known only from all that stands
before it. A line maps each of the two states it may begin in to the state it ends in, and ranges compose those maps, so a first pass
gives every range its map and its numbers of records for both states. Scanning the ranges in order, a row each, fixes
the state and the record number each begins with. The second pass cuts the ranges into records; a record that
runs over a range's end is put together from its pieces. Records are then parsed by the same reader as small files are.

The encoding is that of ``files.decode`` for whole files: UTF-8 if all lines are, else Windows-1252 if all are, else UTF-8 with replacements.
UTF-16 is refused, as its line ends are not bytes of their own. Blank lines between records have no number, as with ``csv.DictReader``.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.session import cut_lineage

OUTSIDE, INSIDE = 0, 1


def line_end(line: str, state: int) -> int:
    """The state at the end of a line that begins outside or inside a quoted cell; a quote in the middle of a plain cell is a letter."""
    at, n = 0, len(line)
    while True:
        if state == INSIDE:
            at = line.find('"', at)
            if at < 0:
                return INSIDE
            if line.startswith('""', at):
                at += 2
                continue
            at, state = at + 1, OUTSIDE  # letters that follow the closing quote belong to the cell
        elif at < n and line[at] == '"':
            at, state = at + 1, INSIDE
            continue
        at = line.find(",", at)
        if at < 0:
            return OUTSIDE
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): the lines of the files as bytes, with the byte range they were read in."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value"))


def _ranges(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[str, int, list[str]]]:
    """The lines of a task, each byte as one character, as one stretch per byte range and batch."""
    for frame in frames:
        change = (frame["file"] != frame["file"].shift()) | (frame["start"] != frame["start"].shift())
        for _, part in frame.groupby(change.cumsum(), sort=False):
            yield part["file"].iloc[0], int(part["start"].iloc[0]), [bytes(v).decode("latin-1") for v in part["value"]]


def _reads(data: bytes, encoding: str) -> bool:
    try:
        data.decode(encoding)
    except UnicodeDecodeError:
        return False
    return True


def _surveyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(file, start, ends, records, utf8, cp1252) of every range; ends and records for both states at its begin."""
    seen: dict[tuple, list] = {}
    for file, start, lines in _ranges(frames):
        first = (file, start) not in seen
        sums = seen.setdefault((file, start), [[OUTSIDE, INSIDE], [0, 0], True, True])
        for line in lines:
            if first and start == 0 and line[:2] in ("\xff\xfe", "\xfe\xff"):
                raise ValueError(f"{file} is UTF-16; import it as a small file")
            blank = line in ("", "\r") and not (first and start == 0)
            first = False
            for begin in (OUTSIDE, INSIDE):
                state = sums[0][begin]
                after = line_end(line, state)
                sums[1][begin] += after == OUTSIDE and not (blank and state == OUTSIDE)
                sums[0][begin] = after
            if not line.isascii():
                data = line.encode("latin-1")
                sums[2], sums[3] = sums[2] and _reads(data, "utf-8"), sums[3] and _reads(data, "cp1252")
    if seen:
        yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["file", "start", "ends", "records", "utf8", "cp1252"])


def _cut(begins: dict[tuple, tuple[int, int]]):
    """Pandas function: (file, record, piece, text) of the lines, given the state and record number each range begins with."""
    def run(frames):
        state: dict[tuple, list] = {}
        for file, start, lines in _ranges(frames):
            key, out = (file, start), []
            fresh = key not in state
            now = state.setdefault(key, [*begins[key], [], start if begins[key][0] == INSIDE else -1])
            for line in lines:
                blank = line in ("", "\r") and not (fresh and start == 0)
                fresh = False
                if blank and now[0] == OUTSIDE:
                    continue
                now[0] = line_end(line, now[0])
                now[2].append(line)
                if now[0] == OUTSIDE:
                    out.append((file, now[1], now[3], "\n".join(now[2])))
                    now[1:] = [now[1] + 1, [], -1]
            if out:
                yield pd.DataFrame(out, columns=["file", "record", "piece", "text"])
        left = [(file, n, max(piece, start), "\n".join(held)) for (file, start), (_, n, held, piece) in state.items() if held]
        if left:  # goes on in the next range
            yield pd.DataFrame(left, columns=["file", "record", "piece", "text"])
    return run


def records(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """``(records, encoding)``: (file, record, text) of every record, record 0 being the header, each byte as one character."""
    lines = _lines(spark, path)
    survey = cut_lineage(lines.mapInPandas(_surveyed, "file string, start long, ends array<int>, records array<long>, utf8 boolean, cp1252 boolean"))
    begins, file, state, number, utf8, cp1252 = {}, None, OUTSIDE, 0, True, True
    for r in survey.orderBy("file", "start").toLocalIterator():  # a row for each byte range
        if r["file"] != file:
            file, state, number = r["file"], OUTSIDE, 0
        begins[(file, r["start"])] = (state, number)
        state, number = r["ends"][state], number + r["records"][state]
        utf8, cp1252 = utf8 and r["utf8"], cp1252 and r["cp1252"]
    cut = lines.mapInPandas(_cut(begins), "file string, record long, piece long, text string")
    whole = cut.where("piece < 0").select("file", "record", "text")
    # pieces: at most two for each range, in the order of the ranges
    pieces = cut.where("piece >= 0").groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("piece", "text"))).alias("p")).select(
        "file", "record", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    return whole.unionByName(pieces), "utf-8" if utf8 else "cp1252" if cp1252 else "replace"


def _decoded(text: str, encoding: str) -> str:
    data = text.encode("latin-1")
    return data.decode("utf-8", errors="replace") if encoding == "replace" else data.decode(encoding)


def _cells(text: str) -> list[str]:
    return next(csv.reader([line + "\n" for line in text.split("\n")]), [])


def large_csv(spark: SparkSession, path: str, batch_id: int, row_id) -> tuple[list[str], DataFrame]:
    """``(columns, staging rows)`` of a big file, or of files that share one header and count on in the order of their names."""
    csv.field_size_limit(2**31 - 1)
    found, encoding = records(spark, path)
    found = cut_lineage(found)
    heads = found.where("record = 0").orderBy("file").limit(1).collect()
    columns = _cells(_decoded(heads[0]["text"].removeprefix("\xef\xbb\xbf"), encoding)) if heads else []
    sizes = found.groupBy("file").agg(F.max("record").alias("n")).orderBy("file").collect()  # a row for each file
    offsets, passed = {}, 0
    for r in sizes:
        offsets[r["file"]] = passed
        passed += r["n"]

    def parsed(frames):
        csv.field_size_limit(2**31 - 1)
        for frame in frames:
            raw = []
            for text in frame["text"]:
                cells = _cells(_decoded(text, encoding))
                raw.append(dict(zip(columns, cells)) | {c: None for c in columns[len(cells):]})
            yield pd.DataFrame({"row_number": frame["record"] + frame["file"].map(offsets), "raw": raw})
    rows = found.where("record > 0").mapInPandas(parsed, "row_number long, raw map<string,string>")
    batch: Column = F.lit(batch_id).cast("bigint")
    return columns, rows.select(row_id(batch, F.col("row_number")).alias("row_id"), batch.alias("batch_id"), "row_number", "raw")
