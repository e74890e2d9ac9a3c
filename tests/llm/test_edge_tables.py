"""Queries and pipeline over empty tables, and over tables with extra columns, nulls and repeated rows."""

import pytest

import corpus_pipeline
from rosterlake.llm import catalog

catalog.load()
SCHEMAS = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int",
           "benchmark": "item_id long, text string", "embeddings": "vec_id long, embedding array<float>, label int",
           "conversations": "conv_id long, turn int, role string, text string"}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", [*catalog.QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    run = corpus_pipeline.run if name == "pipeline" else catalog.QUERIES[name]
    assert len(run(spark, empty).collect()) == (1 if name == "op2_chat" else 0)  # the fixed conversation


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Few documents: nulls in every column, repeated rows, empty and blank texts, columns named like those the operators make."""
    folder = tmp_path_factory.mktemp("odd")
    text = "one two three four five six seven eight nine ten eleven\nanother line of words here"
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \n\t", "", "", 1), (None, text, "en", None, 3),
            (None, None, None, None, None), (6, "½ ② x", "de", "b", 4), (7, "😀 é", None, "b", 2)]
    extra = [(*r, 0, "x", 1.5) for r in rows]
    spark.createDataFrame(extra, SCHEMAS["documents"] + ", n long, part string, score double").coalesce(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None)], SCHEMAS["labels"]).coalesce(1).write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, "nine ten")], SCHEMAS["benchmark"]).coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["op1_licenses", "op4_bpe", "op5_line_dedup", "op6_decontaminate", "op7_simhash", "op10_pii"])
def test_a_result_for_every_row(spark, odd, name):
    got = catalog.QUERIES[name](spark, odd)
    ids = [r["doc_id"] for r in got.collect()]
    assert sorted(ids, key=str) == sorted([1, 1, 2, 3, 4, None, None, 6, 7], key=str)


def test_repeated_rows_get_one_result(spark, odd):
    for name in ("op1_licenses", "op4_bpe", "op6_decontaminate", "op10_pii"):
        first, second = [tuple(r) for r in catalog.QUERIES[name](spark, odd).collect() if r["doc_id"] == 1]
        assert first == second


def test_audit_of_odd_rows(spark, odd):
    got = catalog.QUERIES["op12_filter_audit"](spark, odd).collect()
    assert len(got) == 600 * 3 and {r["part"] for r in got} == {"", "en", "de"}
    rows = {(r["part"], r["filter_order"], r["step"]): r for r in got}
    # all are short; of the texts with a smaller twin only the empty one of document 3 has one with an id, document 2
    last = rows[("en", "ABCDE", 5)]
    assert (rows[("en", "ABCDE", 1)]["removed"], last["removed"], last["redundant"], last["kept"]) == (4, 0, 1, 0)
