"""Cases that once gave wrong results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import billing
from rosterlake.operators.scale import cumulative_counts
from rosterlake.streaming import feeds


@pytest.mark.parametrize("ids,kind", [([2 ** 53 + i for i in range(1, 6)], "long"), (list("edcba"), "string")])
def test_every_launched_campaign_gets_its_invoice(spark, ids, kind):
    campaigns = spark.createDataFrame([(i, 1, f"c{i}", "active") for i in ids], f"id {kind}, org_id long, name string, status string")
    creators = spark.createDataFrame([(i, False, "confirmed") for i in ids], f"campaign_id {kind}, billed boolean, status string")
    orgs = spark.createDataFrame([(1, 300)], "org_id long, fee_per_creator long")
    issued = spark.createDataFrame([(1, "CA-2024-001-0001")], "org_id long, number string")
    bills = billing.billing_run(campaigns, creators, orgs, issued, F.lit("2024-03-01").cast("timestamp_ntz")).collect()
    assert {r["campaign_id"]: r["number"] for r in bills} == {i: f"CA-2024-001-{n:04d}" for n, i in enumerate(sorted(ids), 2)}


def test_cumulative_counts_of_long_strings(spark):
    values = [f"shared beginning {i % 7}" for i in range(40)] + [None, "", "é"]
    rows = cumulative_counts(spark.createDataFrame([(v,) for v in values], "v string"), [], "v", 4).collect()
    known = sorted((v for v in values if v is not None), key=str.encode)
    assert {r["value"]: (r["n"], r["before"], r["total"]) for r in rows} == {v: (known.count(v), known.index(v), len(known)) for v in known}


def test_late_views_still_count(spark, tmp_path):
    days = [20, 21, 22, 1]
    for n, day in enumerate(days):
        frame = spark.createDataFrame([(7, dt.datetime(2024, 1, day, 12), 10 * n)], "cc_id long, recorded_at timestamp, views long")
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cc_id long, recorded_at timestamp, views long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    feeds.land_updates(feeds.daily_views(stream), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    landed = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out"))
    found = {r["day"].day: r["v"] for r in landed.groupBy("day").agg(F.max("views").alias("v")).collect()}
    assert found == {day: 10 * n for n, day in enumerate(days)}


def test_rows_of_small_files_leave_together():
    """1,000 files of two rows come out in a few batches, not one each."""
    import pyarrow as pa

    from rosterlake.sources import files
    contents = pa.array([f"a,b\n{i},x\n{i},\n".encode() for i in range(1000)], pa.binary())
    out = list(files._parse(iter([pa.RecordBatch.from_arrays([contents], names=["content"])])))
    assert len(out) == 1 and sum(b.num_rows for b in out) == 3000
    assert out[0].column(3)[1].as_py() == [("a", "0"), ("b", "x")] and out[0].column(1)[0].as_py() == ["a", "b"]


def test_big_files_are_read_like_small_ones(monkeypatch):
    from rosterlake.sources import files
    cases = ["a,b\r\né,\"x\ny\"\n".encode(), "a,b\né,1\n".encode("cp1252"), "a,b\né✨,1\n".encode("utf-16"), b"\xef\xbb\xbfa\n1\n", b"a\x81\xff\n\xc3", b"\xff\xfea"]
    want = [files.decode(c) for c in cases]
    monkeypatch.setattr(files, "PIECE", 3)
    assert [files.opened(c).read() for c in cases] == want
