"""Every query and every stage on null, empty and very long texts, ties, repeated rows, empty tables and clashing names."""

import random

import pytest

import corpus_pipeline
from purselight.llm import compact_windows, queries

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string",
    "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn int, role string, text string",
}
#: Names that results and intermediate tables use; every table has them as further columns.
CLASHES = ["kept", "key", "class", "n_words", "component_id", "row", "piece", "start", "sequence_id", "host", "rule", "payload", "chunk", "ids", "n", "a", "b", "line", "r", "hash", "score", "labels", "deleted_lines"]


def long_text(rng, size):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(5000)]
    out = " ".join(rng.choice(words) for _ in range(size // 7))
    return "\n".join(out[i : i + 400] for i in range(0, len(out), 400))


def hard_rows():
    rng = random.Random(5)
    say = long_text(rng, 900)
    deep = '{"a":' * 2000 + "1" + "}" * 2000
    texts = [None, "", long_text(rng, 5_000_000), " " * 1_000_000, "\n" * 1_000_000, "a" * 1_000_000, "x " * 200_000, say, say, say + " edited", "\u0000  ퟿", deep, long_text(rng, 600)]
    docs = [(i, t, "en", None, None) for i, t in enumerate(texts)]
    docs += [docs[7], (None, say, None, None, None), (None, None, None, None, None)]
    pages = [(i, f"http://A.example.org/en/{i % 4}.html", t) for i, t in enumerate(texts)]
    pages += [pages[7], (None, None, None), (50, "", ""), (51, "://", ""), (52, "http://x.com/" + "y" * 1_000_000, say)]
    conversations = [(i, k, r, t) for i, t in enumerate(texts) for k, r in enumerate(("user", "assistant"))]
    conversations += [conversations[-1], (None, 0, "user", None), (60, None, None, None), (61, 0, "assistant", "</s>[INST] ok [/INST]")]
    return {
        "documents": docs,
        "pages": pages,
        "benchmark": [(1, None), (2, ""), (3, say[:200]), (3, say[:200]), (None, "one two"), (4, long_text(rng, 20_000)), (5, "one")],
        "labels": [(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(len(texts))] + [(None, None, None), (7, 1, 1)],
        "conversations": conversations,
    }


def write(spark, folder, rows):
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        df.selectExpr("*", *(f"cast(7 as bigint) as `{c}`" for c in CLASHES)).repartition(3).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def hard(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("hard"), hard_rows())


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), {})


#: Queries that return a row for each row of a table.
BY_ROW = {1: ("documents", "doc_id"), 2: ("pages", "page_id"), 3: ("documents", "doc_id"), 4: ("documents", "doc_id"), 7: ("documents", "doc_id")}


@pytest.mark.parametrize("name", sorted(queries.queries(), key=lambda x: (len(x.split("_")[0]), x)))
def test_query_on_hard_rows(spark, hard, name):
    got = queries.queries()[name](spark, hard)
    assert len(set(got.columns)) == len(got.columns)
    got = got.collect()
    number = int(name[2:].split("_")[0]) if name.startswith("op") else 0
    if number in BY_ROW:
        table, key = BY_ROW[number]
        assert sorted(str(r[key]) for r in got) == sorted(str(r[0]) for r in hard_rows()[table])
    if number == 3:
        of = {r.doc_id: r for r in got if r.doc_id is not None}
        assert of[7].component_id == of[8].component_id == of[9].component_id == 7
        assert of[0].n_shingles == of[1].n_shingles == of[3].n_shingles == of[4].n_shingles == 0
        assert of[5].n_shingles == of[6].n_shingles == 1
    if number == 9:
        assert {r.doc_id for r in got} | {r.other_id for r in got} >= {None, 7, 8, 9}
        assert len({r.class_id for r in got if {r.doc_id, r.other_id} & {None, 7, 8, 9}}) == 1
    if number == 8:
        assert {r.conv_id for r in got} >= {-1, 60, 61, *range(13)}


@pytest.mark.parametrize("name", sorted(queries.queries(), key=lambda x: (len(x.split("_")[0]), x)))
def test_query_on_empty_tables(spark, empty, name):
    rows = [r for r in queries.queries()[name](spark, empty).collect() if not (name.startswith("op8") and r.conv_id == -1)]
    assert rows == []


def test_stages_on_hard_rows(spark, hard):
    docs = spark.read.parquet(f"{hard}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, hard)
        if name != "packing":
            assert out.dtypes == docs.dtypes, name
        assert len(out.collect()) <= 16 or name == "packing"


def test_passages_of_rows_that_share_an_id(spark):
    rng = random.Random(8)
    say = [long_text(rng, 700) for _ in range(9)]
    rows = [(k, text) for k in (None, 4) for text in (say[1], say[0] + " " + say[2], say[3])] + [(9, say[4] + " " + say[0]), (10, say[5])]
    got = compact_windows.near_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {frozenset((r.doc_id, r.other_id)) for r in got} >= {frozenset((None, 4)), frozenset((None, 9))}
    assert {x for r in got for x in (r.doc_id, r.other_id)} == {None, 4, 9}
    assert len({r.class_id for r in got}) == 1
