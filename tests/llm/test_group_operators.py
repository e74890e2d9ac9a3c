"""Operators that compare documents, and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from oracle_check import compare, duck
from pyspark.sql import functions as F

import corpus_pipeline
from rosterlake.llm import catalog, decontaminate, line_dedup, paragraph_sketch, simhash
from rosterlake.llm.common import stored

DOCS = "doc_id long, text string"
FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")
catalog.load()


def groups(fps):
    """The smallest index of each fingerprint's group, by comparing all pairs."""
    found, bits = list(range(len(fps))), np.array(fps, np.int64).view(np.uint64)

    def root(i):
        while found[i] != i:
            i = found[i]
        return i
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(bits[i] ^ bits) <= 3):
            a, b = sorted((root(i), root(int(j))))
            found[b] = a
    return [root(i) for i in range(len(fps))]


# SimHash -------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("crowded", [512, 8])
def test_components_equal_all_pairs(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    random.seed(1)
    fps = set()
    for base in [random.getrandbits(63) for _ in range(3)]:
        for _ in range(60):
            x = base
            for _ in range(random.randint(0, 6)):
                x ^= 1 << random.randrange(63)
            fps.add(x)
    fps = sorted(fps)
    found = {r["fp"]: r["component_id"] for r in simhash.components(spark.createDataFrame(list(enumerate(fps)), "doc_id long, fp long")).collect()}
    assert [found[f] for f in fps] == groups(fps)


def test_fingerprint_by_definition():
    text = "A b\tc d\nÉ " + "x y " * 20
    words = re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).strip())
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]).encode(), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint_bits(text.encode()) & (2 ** 64 - 1) == want
    assert simhash.fingerprint_bits(b" \n") == 0 and simhash.fingerprint_bits(b"A b") == simhash.fingerprint_bits(b"a  B")


def test_keep_one_of_each_group(spark):
    texts = ["one two three four five six", "seven eight nine ten eleven twelve", None, "", "one two three four five six"]
    rows = [*enumerate(texts), (0, texts[0]), (None, texts[1]), (None, "a lone row without id here")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], DOCS + ", _id string")
    kept = simhash.keep_one(df)
    assert kept.columns == ["doc_id", "text", "_id"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == [("0", texts[0]), ("1", texts[1]), ("2", None), ("None", rows[-1][1])]
    assert simhash.keep_one(df.limit(0)).count() == 0


# decontamination -----------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("most", [decontaminate.MOST_BROADCAST, 0])
def test_contamination_equals_all_windows(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "MOST_BROADCAST", most)
    random.seed(7)
    def some(n):
        return " ".join(random.choices("a b c D".split(), k=n))
    items = [(i, some(random.choice([1, 3, 6, 12, 14]))) for i in range(12)] + [(3, "a b c"), (None, "d d d d"), (20, None), (21, "")]
    docs = [(i, some(random.randint(0, 40)) + random.choice(["", " zz ", "\n"])) for i in range(40)] + [(50, None), (1, "a b c"), (1, "a b c")]
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    want = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for item, said in items:
            q = words(said)
            n = min(10, len(q))
            for s in range(len(q) - n + 1 if q else 0):
                for at in range(len(w) - n + 1):
                    if w[at:at + n] == q[s:s + n]:
                        hit.update(range(at, at + n))
                        found |= {str(item)} if item is not None else set()
        want.append((d, len(w), len(hit), tuple(sorted(found))))
    got = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    rows = got.select("doc_id", "n_words", decontaminate.hit_words(got["hits"]).alias("n"), "items").collect()
    assert Counter((r["doc_id"], r["n_words"], r["n"], tuple(r["items"])) for r in rows) == Counter(want)
    kept = decontaminate.keep_clean(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(d for d, _, n, _ in want if n == 0)


# fingerprints --------------------------------------------------------------------------------------------------------
def test_sketch_likeness_equals_multisets(spark, monkeypatch):
    rows = [(1, "a.b.c\nd"), (2, "a.b.c\nd"), (2, "x.x.x.x.y"), (2, "x.x.x.x.y"), (None, None), (None, "q. r. s. t."), (5, ""), (6, "😀é. b. c. " * 3), (9, "w" * 900),
            (11, "l\n" * 200 + "." * 40), (12, "".join(f"s{i}. " for i in range(150)))]
    df = spark.createDataFrame(rows, DOCS)
    monkeypatch.setattr(paragraph_sketch, "table", lambda *_: df)
    def signed(t):
        h = xxhash.xxh64_intdigest(t.encode(), 42)
        return h - 2 ** 64 if h >= 2 ** 63 else h
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1])), reverse=True)
    def near(a, b):
        a, b = (Counter(re.findall(paragraph_sketch.PIECE, t)) for t in (a, b))
        return round(sum((a & b).values()) / sum((a | b).values()), 9) if a | b else 1.0
    want = []
    for k, (d, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[:len(t) - len(t) // 3] + after[:len(t) // 3]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), near(t, edited), near(t, after)))
    got = paragraph_sketch.op8_paragraph_sketch(spark, "").collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == Counter(want)


def test_sketch_parts_stay_small_where_one_sentence_repeats(spark):
    rows = [("Same again. " * 2000, "Same again. " * 700 + "Other. " * 900, 1300, 900), ("Same again. " * 500 + "End.", "", 501, 0)]
    df = spark.createDataFrame(rows, "a string, b string, gone int, come int")
    keys = df.select("gone", "come", *[paragraph_sketch.numbered(paragraph_sketch.digests(df[c])).alias(c) for c in "ab"])
    got = keys.select("gone", "come", paragraph_sketch.difference(keys["a"], keys["b"]).alias("d"), F.array_max(F.transform(
        paragraph_sketch.dealt(keys["a"], paragraph_sketch.parts_needed(F.size("a"))), F.size)).alias("largest")).collect()
    assert len(got) == 2
    for r in got:
        assert (r["d"]["gone"], r["d"]["come"]) == (r["gone"], r["come"]) and r["largest"] < 10 * paragraph_sketch.PER_PART


def test_sketch_fingerprints_are_what_they_were(spark):
    df = spark.createDataFrame([("a. b. a.\nc! " * 2,)], "text string")
    got = df.select(paragraph_sketch.fingerprint(paragraph_sketch.numbered(paragraph_sketch.digests(df["text"])))).first()[0]
    assert got.split("-")[0] == "4.18835B8B77641971228BCC2735F329B7" and got.split("-")[8] == "1.C00B03D5FBCC12DF58D1FB56A6A6772C"


def test_sketch_keys_are_worked_out_once_for_each_text(spark, monkeypatch):
    texts = [(1, "a. b. c."), (2, "a. a. b.\na. "), (3, None), (4, "".join(f"s{i}. " for i in range(40))), (4, "")]
    df = spark.createDataFrame(texts, DOCS)
    got = paragraph_sketch.with_next(df, keys=paragraph_sketch.numbered(paragraph_sketch.digests(F.col("text")))).collect()
    known = {r["text"]: sorted(r["keys"]) for r in got}
    assert len(got) == 5 and all(sorted(r["next_keys"]) == known[r["next_text"]] for r in got)
    # equal pieces are numbered from their first one on, in texts with repeats and without
    pieces = {t: Counter(re.findall(paragraph_sketch.PIECE, t)) for t in known}
    want = spark.createDataFrame([(t, p, k - 1) for t, c in pieces.items() for p in c for k in range(c[p])], "t string, p string, k long")
    want = want.groupBy("t").agg(F.sort_array(F.collect_list(F.xxhash64(F.xxhash64("p"), "k"))).alias("keys")).collect()
    assert {r["t"]: r["keys"] for r in want} | {"": []} == known
    monkeypatch.setattr(paragraph_sketch, "table", lambda *_: df)
    plan = paragraph_sketch.op8_paragraph_sketch(spark, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("Window")[0].count("regexp_extract_all") == 1  # after the shuffle only the edited text is cut


# lines ---------------------------------------------------------------------------------------------------------------
def test_recurring_lines_go_and_copies_stay(spark):
    letters = "abcdefgh"
    rows = [(i, f"Call me at {i}{i} now\n{c} own words {c * 4} of text\n{c * 2} more of its own {c * 3}") for i, c in enumerate(letters)]
    copies = [(100 + i, "a copied first line\na copied second line\nand a third one") for i in range(9)]
    odd = [(20, None), (21, ""), (22, "\n\n"), (5, "Call me at 5 now\nq"), (5, "Call me at 5 now\nq")]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows + copies + odd], DOCS + ", _gone int")
    out = line_dedup.drop_lines(df, count="n")
    assert out.columns == ["doc_id", "text", "_gone", "n"]
    found = Counter((r["doc_id"], r["text"], r["n"]) for r in out.collect())
    want = [(i, t.split("\n", 1)[1], 1) for i, t in rows] + [(i, t, 0) for i, t in copies + odd[:3]] + [(5, "q", 1)] * 2
    assert found == Counter(want)
    assert line_dedup.drop_lines(df.limit(0)).count() == 0


def test_passages_of_independent_documents_go_beside_a_large_copy_group(spark):
    random.seed(3)
    def some(n):
        return " ".join("".join(random.choices("abcdefghij", k=7)) for _ in range(n))
    passage = [some(9) for _ in range(3)]
    single = [(i, [*passage, some(9), some(9)]) for i in range(40)]
    copied = [passage[0], *[some(9) for _ in range(6)]]
    near = [some(9) for _ in range(20)]
    copies = [(1000 + i, copied) for i in range(300)]
    altered = [(2000 + i, [*near[:i % 20], some(9), *near[i % 20 + 1:]]) for i in range(100)]
    # the same passage line in five groups of copies: five different documents have it
    grouped, five = some(9), [[some(9) for _ in range(3)] for _ in range(5)]
    several = [(3000 + 10 * g + i, [grouped, *five[g]]) for g in range(5) for i in range(6)]
    rows = single + copies + altered + several
    random.shuffle(rows)
    out = line_dedup.drop_lines(spark.createDataFrame([(i, "\n".join(t)) for i, t in rows], DOCS))
    gone = {*passage, grouped}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {i: "\n".join(x for x in t if x not in gone) for i, t in rows}


# queries and pipeline ------------------------------------------------------------------------------------------------
@tables
@pytest.mark.parametrize("name", ["op2_chat", "op6_decontaminate"])
def test_query_agrees_with_sql(spark, name):
    verdict, _, _ = compare(spark, duck(FOLDER), FOLDER, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert verdict == ""


@tables
def test_simhash_query_equals_all_pairs(spark):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect())
    fps = [simhash.fingerprint_bits(t.encode()) for _, t in docs]
    want = {d: (format(f & (2 ** 64 - 1), "016x"), docs[g][0]) for (d, _), f, g in zip(docs, fps, groups(fps))}
    assert {r[0]: (r[1], r[2]) for r in catalog.QUERIES["op7_simhash"](spark, FOLDER).collect()} == want


@tables
def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stored(stage(spark, docs, FOLDER))
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns and set(after) <= set(before)
        if name == "line dedup":
            assert set(after) == set(before) and all(set(t.split("\n")) <= set(before[d].split("\n")) for d, t in after.items() if t)
        else:
            assert all(before[d] == t for d, t in after.items())
        if name == "near-dedup":
            order = sorted(before)
            roots = groups([simhash.fingerprint_bits(before[d].encode()) for d in order])
            assert set(after) == {order[g] for g in roots}
        before = after
    last = corpus_pipeline.STAGES[4][1](spark, docs, FOLDER)
    assert {r["doc_id"] for r in last.collect()} == set(before)
