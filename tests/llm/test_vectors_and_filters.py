"""Vector codes, exact search and the filter audit against brute force, SQL and edge cases."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from oracle_check import compare, duck

from rosterlake.llm import catalog, filter_audit, topk_search, vector_codes
from rosterlake.llm.filter_audit import RadixTrie

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the generated tables")
catalog.load()
VECTORS = "vec_id long, embedding array<float>, label int"
nan, inf = float("nan"), float("inf")


@tables
@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_filter_audit", "op13_topk_search"])
def test_query_agrees_with_sql(spark, name):
    verdict, _, _ = compare(spark, duck(FOLDER), FOLDER, name, catalog.QUERIES[name], catalog.ORACLES[name])
    assert verdict == ""


# vector codes --------------------------------------------------------------------------------------------------------
def lloyd(rows, parts, entries, rounds, scale):
    """Codes, errors and codebooks by definition, with whole numbers of any size."""
    vectors = [[int(np.floor(scale * float(np.float32(x)))) for x in v] for _, v, _ in rows]
    width = len(vectors[0]) // parts
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, vectors[i]))[:entries]
    codes, errors, books = [""] * len(rows), [0] * len(rows), []
    for p in range(parts):
        pieces = [v[p * width:(p + 1) * width] for v in vectors]
        book = [list(pieces[i]) for i in order]

        def nearest(piece):
            return min((sum((a - b) ** 2 for a, b in zip(piece, entry)), e) for e, entry in enumerate(book))
        for _ in range(rounds):
            mine = [nearest(x)[1] for x in pieces]
            for e in range(len(book)):
                members = [x for x, m in zip(pieces, mine) if m == e]
                if members:
                    book[e] = [sum(c) // len(members) for c in zip(*members)]
        for i, x in enumerate(pieces):
            far, e = nearest(x)
            codes[i] += f"{e:02x}"
            errors[i] += far
        books += [c for entry in book for c in entry]
    return codes, errors, hashlib.sha256(",".join(map(str, books)).encode()).hexdigest()


@pytest.mark.parametrize("n", [3, 260])
def test_codes_equal_plain_rounds(spark, n):
    rng = np.random.default_rng(4)
    rows = [(int(i), rng.normal(size=16).round(3).tolist(), int(i) % 3 if i % 5 else None) for i in rng.permutation(n)]
    rows += [(i + 1000, rows[0][1], 7) for i in range(n)]  # one vector in half of the rows
    rows += [(rows[1][0], rows[1][1], 1), (None, rows[2][1], 1), (None, rows[2][1], 1), (5000, [1e30, -1e30] + [0.0] * 14, 2)]
    bad = [(1, None, 1), (2, [], 1), (3, [nan] + [0.0] * 15, 1), (4, [inf] + [0.0] * 15, 1), (5, [None] + [0.0] * 15, 1), (6, [0.5] * 15, 1), (7000, [0.5] * 24, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], VECTORS + ", code string").repartition(5)
    codes, books = vector_codes.compress(df, rounds=4)
    held = [(i, [max(-2.0 ** 27 / 4096, min(2.0 ** 27 / 4096, x)) for x in v], k) for i, v, k in rows]
    want_codes, want_errors, digest = lloyd(held, 8, 16, 4, 4096)
    totals = Counter()
    for (_, _, k), e in zip(rows, want_errors):
        totals[k] += e
    got = vector_codes.with_label_error(codes).collect()
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == Counter(
        (i, c, e, totals[k]) for (i, _, k), c, e in zip(rows, want_codes, want_errors))
    assert vector_codes.codebooks_digest(books) == digest


def test_only_members_that_change_owner_are_dealt_out(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, rng.normal(size=16).tolist(), 0) for i in range(300)], VECTORS)
    vectors = vector_codes.numbered(df, "vec_id", "embedding", "label", 8, 4096)
    books, residents = vector_codes.learn(vectors, rounds=2)
    partitions = residents.getNumPartitions()

    def places(rdd):
        return {(int(r), int(s) // 16): (key, int(s)) for key, (rows, slots, _) in rdd.collect() for r, s in zip(rows, slots)}
    before = places(residents)
    after_rdd = vector_codes.migrate(residents, books + rng.integers(-400, 400, books.shape), partitions)
    after = places(after_rdd)
    assert after_rdd.getNumPartitions() == partitions and after_rdd.partitioner == residents.partitioner
    assert set(before) == set(after) == {(r, p) for r, _ in before for p in range(8)}
    same = [k for k in before if before[k][1] == after[k][1]]
    assert 0 < len(same) < len(before) and all(before[k][0] == after[k][0] for k in same)


def test_no_vectors_give_no_codes(spark):
    codes, books = vector_codes.compress(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert codes.columns == ["vec_id", "label", "code", "error"] and codes.count() == 0 and books.size == 0
    assert vector_codes.with_label_error(codes).count() == 0


# exact search --------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [16, 4096])
def test_search_equals_all_scores(spark, block):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=12).round(2).tolist(), 0) for i in range(160)]
    rows += [(int(i), [0.5] * 6 + [-0.25] * 6, 1) for i in range(200, 290)]  # ties of a third of the rows
    rows += [(int(i), (rng.integers(0, 2, 12) * 1.0).tolist(), 1) for i in range(300, 330)] + [(400, [4e5] * 12, 0), (410, [-4e5] * 12, 0)]
    extra = [(3, rows[0][1], 1), (None, [9.0] * 12, 1), (500, None, 1), (510, [], 1), (520, [nan] * 12, 1), (530, [inf] * 12, 1), (540, [None] * 12, 1), (550, [1.0] * 13, 1)]
    df = spark.createDataFrame([(*r, 1) for r in rows + extra], VECTORS + ", block int").repartition(4)
    vectors = {}
    for i, v, _ in rows + extra[:1]:
        v = [int(np.floor(max(-2.0 ** 27, min(2.0 ** 27, 256 * float(np.float32(x)))))) for x in v]
        vectors[i] = min(v, vectors.get(i, v))
    want = []
    for q in vectors:
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:5]
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    got = [tuple(r) for r in topk_search.search(df, every=10, block=block).collect()]
    assert sorted(got) == sorted(want)


def test_search_with_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 0), (50, [3.0, 1.0], 0), (7, [-1.0, 0.0], 0)], VECTORS)
    got = sorted(tuple(r) for r in topk_search.search(df).select("query_id", "rank", "vec_id").collect())
    assert got == [(0, 1, 50), (0, 2, 7), (50, 1, 0), (50, 2, 7)]
    assert topk_search.search(df.limit(0)).count() == 0 and topk_search.search(df.limit(1)).count() == 0


def test_blocks_that_cannot_hold_a_result_are_not_visited(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 8)) * 40
    rows = [(i, (centres[i % 8] * (1 + 0.001 * (i // 8)) + rng.normal(size=8) * 0.01).tolist(), 0) for i in range(800)]
    placed, pivots = topk_search.blocked(spark.createDataFrame(rows, VECTORS), "vec_id", "embedding", 5, 50, 256, 40)
    asked, blocks = 16, placed.select("block").distinct().count()
    met = topk_search.visits(placed, pivots, 50).count()
    assert asked <= met < asked * blocks / 2


# filter audit --------------------------------------------------------------------------------------------------------
def failed(rows):
    """The filters each (doc_id, text, lang) fails, by definition."""
    found = []
    for i, t, _ in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
             "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)}
        found.append({k for k, v in f.items() if v})
    return found


def audit(rows, labels):
    good, bad = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, x in labels if x == 1} - {None}
    fails, want = failed(rows), {}
    parts = {p or "" for _, _, p in rows}
    for part in parts:
        mine = [(i, f) for (i, _, p), f in zip(rows, fails) if (p or "") == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                before, key = set(order[:step - 1]), (part, order, step)
                here = [i for i, f in mine if letter in f and not f & before]
                shapley[letter] += len(here)
                want[key] = (sum(not f & (before | {letter}) for _, f in mine), len(here), sum(letter in f and bool(f & before) for _, f in mine),
                             sum(f == {letter} for _, f in mine), sum(i in good for i in here), sum(i in bad for i in here))
        for order, step in [(k[1], k[2]) for k in list(want) if k[0] == part]:
            want[(part, order, step)] += (shapley[order[step - 1]],)
    return want


def some_texts(rnd):
    boiler = "the same long head of many texts " * 40
    def words(n, pool):
        return " ".join(rnd.choices(pool, k=n))
    many = ["".join(rnd.choices("abcdefgh", k=5)) for _ in range(4000)]
    texts = [words(rnd.choice([1, 99, 100, 101, 150]), rnd.choice([many, many[:60], ["UP", "Down", "LEFT"]])) for _ in range(60)]
    texts += [boiler + t for t in texts[:30]] + [t + rnd.choice("#$%&*|") for t in texts[:20]] + ["a", "ab", "abc", "", None, " \t\n\x0b\x0c\r", "é" * 300, "É A", "\x85\xa0 x"]
    return texts


def test_audit_equals_all_orders(spark, monkeypatch):
    rnd = random.Random(6)
    texts = some_texts(rnd)
    rows = [(i, rnd.choice(texts), rnd.choice(["en", "de", None, ""])) for i in range(150)]
    rows += [(1000 + i, texts[3], "en") for i in range(120)] + [(7, texts[3], "de"), (7, texts[3], "de"), (None, texts[3], "en"), (None, "zz", None)]
    rnd.shuffle(rows)
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1, None])) for i in range(0, 1100, 3)] + [(9, 0, 0), (9, 1, 0), (None, 1, 1)]
    monkeypatch.setattr(filter_audit, "TRIE_BYTES", 20_000)
    monkeypatch.setattr(filter_audit, "SAMPLE", 4)
    docs = spark.createDataFrame([(i, t, p, 1) for i, t, p in rows], "doc_id long, text string, lang string, mask int").repartition(6)
    masks = filter_audit.document_masks(docs)
    counts = filter_audit.tally(masks, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    columns = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in columns) for r in filter_audit.interactions(counts).collect()}
    assert got == audit(rows, labels)
    want = Counter((i, sum(1 << "ABCDE".index(x) for x in f)) for (i, _, _), f in zip(rows, failed(rows)))
    seen = Counter()
    for r in masks.collect():
        seen[(r["doc_id"], r["mask"])] += r["n"]
    assert seen == want


def test_audit_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.interactions(filter_audit.tally(filter_audit.document_masks(docs), labels)).count() == 0


def test_copies_leave_a_task_once(spark):
    """However many copies a text has, each task sends it on a single time."""
    import pyarrow as pa
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(500, 0, -1)), "text": ["a copied text"] * 400 + ["another"] * 100, "part": ["en"] * 500})
    sent = [r for b in filter_audit._deal(4, [b"ab"])(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["to"], r["text"], r["doc_id"]) for r in sent if r["text"]) == [(0, b"a copied text", 101), (1, b"another", 1)]
    assert Counter(r["mask"] & filter_audit.COPY for r in sent) == {0: 2, filter_audit.COPY: 498}


def test_trie_holds_what_a_dictionary_holds():
    rnd = random.Random(8)
    trie, least, aside = RadixTrie(), {}, Counter()
    strings = [b"", b"a", b"ab", b"abc", b"abd", "é".encode(), b"x" * 5000, b"x" * 4999 + b"y"] + [bytes(rnd.choices(b"ab", k=rnd.randint(0, 9))) for _ in range(200)]
    for _ in range(2000):
        s, i = rnd.choice(strings), rnd.randint(0, 300)
        least[s] = min(i, least.get(s, i))
        for ident, row, n in trie.insert(s, i, (s,), 1):
            aside[(ident, row)] += n
    ends = {s: (i, rows) for s, i, rows in trie.ends()}
    assert {s: i for s, (i, _) in ends.items()} == least
    assert sum(aside.values()) + sum(n for _, rows in ends.values() for n in rows.values()) == 2000
    assert all(ident > least[row[0]] for ident, row in aside)


def test_cuts_grow_where_texts_share_a_head(spark):
    head = "one long head that every text shares, word for word " * 30
    docs = spark.createDataFrame([(head + f"{i:05d}" + "tail " * 20,) for i in range(800)], "text string")
    cuts = filter_audit.prefix_cuts(docs, 8, 800)
    assert len(cuts) == 7 and cuts == sorted(cuts) and all(len(c) > len(head) for c in cuts)
