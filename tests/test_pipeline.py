import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rosterlake.operators import clean, merge, report
from rosterlake.plans import library
from rosterlake.sources import bigcsv, export, files
from rosterlake.streaming import feeds

SHEET = """Creator Name,Profile Link,Platform,Followers,Category,City,Engagement %
ASHA VERMA ✨,https://www.instagram.com/Asha.Verma/?igsh=1,,1.2 lakh,Home Cooking,Bombay,2.5%
asha_verma,instagram.com/asha.verma,,"1,50,000",Food,,
Asha Verma,https://www.threads.net/@asha.verma,,90K,Food,,3
Rohan Tv,youtube.com/@RohanTV,,lots,Quantum,Atlantis,0.9
Nobody,@nobody,,5,,,
,instagram.com/p/xyz/,IG,5,,,
"""
LIST = "NAME,FOLLOWERS,ER\nT Channel @UCq-Fj5jknLsUf-MWSy4_brA,234M,-\nRohan @rohan_x,5K,1%\n"


def drop(tmp_path):
    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "agency_upload.csv").write_bytes(SHEET.encode("utf-8-sig"))
    (folder / "copy_of_agency.csv").write_bytes(SHEET.encode("utf-8-sig"))
    (folder / "youtube_list.csv").write_bytes(LIST.encode("utf-16"))
    return str(folder)


def test_import_to_library(spark, tmp_path):
    batches, staging = files.ingest(files.read_drop(spark, drop(tmp_path)), F.lit(datetime(2024, 1, 1)))
    assert [(r.batch_id, r.file_name, r.platform_hint, r.row_count) for r in batches.orderBy("batch_id").collect()] == [
        (1, "agency_upload.csv", None, 6), (2, "youtube_list.csv", "youtube", 2)]
    lib = library.rebuild(batches, staging)
    accounts = {r.account_id: r for r in lib.accounts.collect()}
    assert set(accounts) == {"instagram:asha.verma", "threads:asha.verma", "youtube:@rohantv", "youtube:UCq-Fj5jknLsUf-MWSy4_brA", "youtube:@rohan_x"}
    asha = accounts["instagram:asha.verma"]
    # the last row wins, what it lacks comes from the first, and its followers disagree
    assert (asha.followers, asha.er_pct, asha.city, asha.n_source_rows) == (150000, 2.5, "Mumbai", 2)
    assert asha.categories == ["Food"] and asha.tags == ["home cooking"]
    assert {"exact_duplicate_rows_merged", "conflicting_follower_counts", "url_params_stripped"} <= set(asha.flags)
    assert {"followers_unparseable", "city_not_in_reference_list", "topics_unmapped_words"} <= set(accounts["youtube:@rohantv"].flags)
    rejected = sorted((r.row_number, r.issue) for r in lib.issues.where("severity = 'rejected'").collect())
    assert rejected == [(5, "platform_unknown"), (6, "no_account_identifier")]
    assert merge.run_counters(lib.cleaned).first().asDict() == {"staging_rows": 8, "accounts": 5, "rejected_rows": 2, "exact_duplicate_rows_merged": 1}
    linked = lib.candidates.where("status = 'auto_linked'").collect()
    assert [r.kind for r in linked] == ["ig_threads_same_handle"]
    assert lib.creators.count() == 4 and lib.profiles([2]).count() == 2
    top = lib.profiles().where("handle = 'asha.verma'").first()
    assert (top.name, top.platforms, top.followers, top.total_followers, top.niche) == ("Asha Verma", ["instagram", "threads"], 150000, 240000, "Food")
    rep = {r.batch_id: r for r in lib.import_reports().collect()}
    assert (rep[1].rows, rep[1].rejected, rep[1].accounts, rep[1].creators, rep[1].duplicates_merged) == (6, 2, 3, 2, 1)
    assert rep[2].ignored_columns == []
    counts = export.write_layers({"accounts": lib.accounts, "issues": lib.issues}, str(tmp_path / "out"))
    assert counts == {"accounts": 5, "issues": lib.issues.count()}
    again, rows = files.ingest(files.read_drop(spark, str(tmp_path / "drop")), F.lit(datetime(2024, 1, 2)), batches)
    assert again.count() == 0 and rows.count() == 0
    kept, = files.without_batch(1, staging)
    assert clean.accepted(clean.clean_rows(kept, batches)).count() == 2
    assert report.funnel(report.overview(lib.cleaned, lib.accounts, lib.creators, lib.candidates, lib.batches)).orderBy("step").first().rows == 8


def test_resolved_handles_move_accounts_and_decisions(spark, tmp_path):
    batches, staging = files.ingest(files.read_drop(spark, drop(tmp_path)), F.lit(datetime(2024, 1, 1)))
    answers = spark.createDataFrame([("handle:rohantv", "UCres", "resolved")], "input_key string, channel_id string, status string")
    log = spark.createDataFrame([("youtube:@rohantv|youtube:@rohan_x", "youtube:@rohan_x", "youtube:@rohantv", "same_platform_similar", 0.9, ["r"], "linked", "me", datetime(2024, 1, 1), 1)],
                                library.NO_DECISIONS)
    lib = library.rebuild(batches, staging, decisions=log, resolutions=answers)
    moved = lib.accounts.where("account_id = 'youtube:UCres'").first()
    assert "yt_resolved_via_api" in moved.flags and "yt_handle_needs_resolution" not in moved.flags
    assert lib.candidates.where("status = 'linked'").first().pair_id == "youtube:@rohan_x|youtube:UCres"
    assert lib.creators.where("n_accounts = 2").count() == 2


def test_large_sheets_are_numbered_in_file_order(spark, tmp_path):
    path = tmp_path / "big.csv"
    path.write_text("Name,Followers\n" + "".join(f"n{i},{i}\n" for i in range(1, 501)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        columns, rows = files.large_csv(spark, str(path), 4)
        got = rows.orderBy("row_number").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert columns == ["Name", "Followers"] and [r.raw["Followers"] for r in got] == [str(i) for i in range(1, 501)]
    assert [r.row_number for r in got] == list(range(1, 501)) and len({r.row_id for r in got}) == 500


NASTY = ["plain,1,2", 'a,"two\nlines",3', "", '"quote "" in it","x,y",', 'five" pipe,mid"dle,"end"', ",,", "short", "one,two,three,four", '"\n\n\n",after,blank', "\r",
         'crlf,"with\r\nbreak",z\r', '"closed"and more,b,c', "é,ü,ß", '"","",""', '"a ""\nb"" c",2,3']


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252"])
@pytest.mark.parametrize("size", [64, 1000, 10**9])
def test_big_and_small_files_read_alike(spark, tmp_path, encoding, size):
    """Quoted line breaks, stray quotes, empty cells, blank lines and two encodings, cut at every place that ranges may be cut."""
    rnd = random.Random(size)
    text = 'Name,"Long\nheader",Last\n' + "\n".join(rnd.choice(NASTY) for _ in range(300)) + rnd.choice(["", "\n"])
    path = tmp_path / "big.csv"
    path.write_bytes(text.encode(encoding))
    small = files.parse_rows(spark.createDataFrame([(bytearray(text.encode(encoding)),)], "content binary")).collect()
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        columns, rows = files.large_csv(spark, str(path), 4)
        got = sorted((r["row_number"], r["raw"]) for r in rows.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert columns == next(r["columns"] for r in small if r["row_number"] == 0)
    assert got == sorted((r["row_number"], r["raw"]) for r in small if r["row_number"] > 0)


def test_state_at_a_line_end():
    import csv
    rnd = random.Random(3)
    for _ in range(3000):
        line = "".join(rnd.choices('ab",', k=rnd.randint(0, 9)))
        rows = list(csv.reader([line + "\n", "next\n"]))
        assert (bigcsv.line_end(line, bigcsv.OUTSIDE) == bigcsv.INSIDE) == (len(rows) == 1 and bool(line))
        rows = list(csv.reader(['"\n', line + "\n", "next\n"]))
        assert (bigcsv.line_end(line, bigcsv.INSIDE) == bigcsv.INSIDE) == (len(rows) == 1)


def test_stream_stages_each_content_once(spark, tmp_path):
    folder = drop(tmp_path)
    lake = str(tmp_path / "lake")
    for _ in range(2):
        feeds.stage_drops(feeds.watch_drops(spark, folder), lake, str(tmp_path / "ckpt")).awaitTermination()
        assert spark.read.parquet(f"{lake}/import_batches").count() == 2
    assert spark.read.parquet(f"{lake}/staging_rows").count() == 8
    (tmp_path / "drop" / "third_copy.csv").write_bytes(SHEET.encode("utf-8-sig"))
    (tmp_path / "drop" / "ig_new.csv").write_text("Name\nx @y\n")
    feeds.stage_drops(feeds.watch_drops(spark, folder), lake, str(tmp_path / "ckpt")).awaitTermination()
    assert sorted(r.batch_id for r in spark.read.parquet(f"{lake}/import_batches").collect()) == [1, 2, 3]
    assert spark.read.parquet(f"{lake}/staging_rows").count() == 9


def test_text_encodings():
    assert files.decode("é".encode("cp1252")) == "é" and files.decode("ab".encode("utf-16")) == "ab" and files.decode("x".encode("utf-8-sig")) == "x"
    assert files.decode(b"\x81\xff") == b"\x81\xff".decode("utf-8", errors="replace")
