"""The pipeline's stages and its end, and the registered queries."""

import os

import pytest

import __spark_entry__
import corpus_pipeline
from graphloom.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x[: x.index("_") + 1] for x in names if x.startswith("op")} and "pipeline" in names
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    start = {r.doc_id for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.materialize(stage(spark, docs, FOLDER))
        if k < 4:
            assert out.columns == columns and out.dtypes == docs.dtypes
            kept = {r.doc_id for r in out.collect()}
            assert kept <= start and len(kept) > 0.6 * len(start), name
            start, docs = kept, out
    assert {r.doc_id for r in out.collect()} == start


def test_planted(spark, tmp_path):
    """Copies, near copies, passages, leaks and toxic texts go; clean texts stay."""
    rng = __import__("random").Random(5)
    word = lambda: "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [(i, text(120)) for i in range(60)]
    item, passage = text(30), text(60)
    near = clean[3][1].split()
    near[50] = "other"
    rows = clean + [(100, clean[1][1]), (101, " ".join(near)), (102, text(60) + " " + passage), (103, passage + " " + text(70)), (104, text(40) + ". " + item + " " + text(30)), (105, None), (106, None), (107, "")]
    rows += [(200 + i, text(30) + " you idiot moron " + text(40)) for i in range(8)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(200 + i, 1, 1) for i in range(8)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).where("piece = 0").collect()}
    assert set(got) == {i for i, _ in clean} | {102, 103, 105}
    deduped = corpus_pipeline.substring_dedup(spark, df, folder).collect()
    texts = {r.doc_id: r.text for r in deduped}
    assert texts[102].endswith(passage) and passage.split()[30] not in texts[103].split() and texts[5] == clean[5][1]


def test_clashing_names_nulls_and_repeats(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, "other text of the same number"), (None, text), (None, None), (2, None), (3, "you idiot")]
    names = ("score", "predicted", "grp", "label", "half", "n_words", "rest", "rep", "component", "hs", "items", "salt", "kept_text")
    extra = ", ".join(f"{n} int" for n in names)
    df = spark.createDataFrame([(i, t, "en", *range(len(names))) for i, t in rows], f"doc_id long, text string, lang string, {extra}")
    spark.createDataFrame([(3, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = df
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        assert docs.columns == df.columns
    got = sorted((r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").collect())
    assert got == [(1, "other text of the same number"), (1, text), (2, None)] and {r.salt for r in docs.collect()} == {11}


def test_null_ids(spark, tmp_path):
    """Copies and leaks under null doc_ids go too, rows with other texts stay."""
    from graphloom.llm import decontaminate

    text, item, other = (" ".join(f"{c}{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)) for c in "abc")
    docs = spark.createDataFrame([(1, text), (None, text), (None, other), (None, other), (None, item), (2, "x y")], "doc_id long, text string")
    bench = spark.createDataFrame([(0, item)], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = decontaminate.decontaminate(docs, bench).collect()
    assert sorted((r.doc_id is None, r.contaminated) for r in got) == [(False, False)] * 2 + [(True, False)] * 3 + [(True, True)]
    kept = corpus_pipeline.decontamination(spark, corpus_pipeline.near_duplicates(spark, docs, str(tmp_path)), str(tmp_path))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, text), (2, "x y"), (None, other)], key=repr)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
