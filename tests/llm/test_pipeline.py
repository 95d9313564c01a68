"""Stages of the pipeline on the smallest tables, each against its operator."""

from collections import Counter

import corpus_pipeline as c
from lodestrata.llm import exact_dedup, near_dedup
from lodestrata.llm.registry import ORACLES, QUERIES


def test_registry_has_the_ten():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert set(ORACLES) <= set(QUERIES)


def test_stages(llm_spark, sf_dir, tmp_path):
    docs = llm_spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in c.STAGES:
        out = stage(llm_spark, docs, sf_dir)
        out.write.parquet(f"{tmp_path}/{name}")
        out = llm_spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert tuple(out.columns) == c.COLUMNS
            before, after = (Counter(map(tuple, df.select(*c.COLUMNS).collect())) for df in (docs, out))
            assert not after - before
        if name == "exact":
            assert Counter(r["doc_id"] for r in exact_dedup.deduplicate(docs).filter("kept").collect()) == Counter(r["doc_id"] for r in out.collect())
        if name == "near":
            assert Counter(r["doc_id"] for r in near_dedup.near_duplicates(docs).filter("kept").collect()) == Counter(r["doc_id"] for r in out.collect())
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
        docs = out


def test_language_stage_rejects_what_is_in_no_language(llm_spark):
    import base64
    import random

    import corpus_pipeline
    from pyspark.sql import functions as F

    d, draw = "/root/testdata/sf0.01", random.Random(5)
    docs = llm_spark.read.parquet(f"{d}/documents.parquet").select(*corpus_pipeline.COLUMNS)

    def words(letters, n):
        return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(2, 10))) for _ in range(n))

    foreign = [words("абвгдежзийклмнопрст", 60) for _ in range(5)] + [words("abcdefghijklmnopqrstuvwxyz", 60) for _ in range(5)] + [base64.b64encode(draw.randbytes(300)).decode() for _ in range(5)]
    planted = llm_spark.createDataFrame([(10**9 + i, t) for i, t in enumerate(foreign)], "doc_id long, text string")
    planted = planted.select(*[(F.col(c) if c in planted.columns else F.lit(None)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
    kept = {r["doc_id"] for r in corpus_pipeline.language_filter(llm_spark, docs.unionByName(planted), d).select("doc_id").collect()}
    assert kept == {r["doc_id"] for r in docs.select("doc_id").collect()}


def odd_documents(spark, rows):
    """Documents with nulls in any column, repeated ids and rows, and columns of other tables beside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"row_": F.lit("z"), "hash_": F.lit(5), "id": F.lit("x"), "label": F.lit(1), "key": F.lit("k")})


def test_stages_on_odd_rows_and_on_none(llm_spark, tmp_path):
    story = "the quick brown fox jumps over the lazy dog near the river bank at dawn while birds sing loudly above"
    rows = [(1, story, "en", "a", 10), (1, story, "en", "a", 10), (None, story, None, None, None), (2, None, "en", "b", None), (3, "", None, "b", 0), (4, story + " again", "en", "c", 1), (None, None, None, None, None), (5, "123 !", "de", "d", 5)]
    llm_spark.createDataFrame([(1, 1, 0), (None, 1, 1), (1, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/odd/labels.parquet")
    llm_spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/none/labels.parquet")
    # exact: the story, none, the longer story, 123; near: both stories are one, and each text without words is alone
    kept = {"toxicity": 8, "language": 4, "exact": 4, "near": 5, "packing": 8}
    for name, stage in c.STAGES:
        out = stage(llm_spark, odd_documents(llm_spark, rows), f"{tmp_path}/odd").collect()
        assert len(out) == kept[name], name
        empty = stage(llm_spark, odd_documents(llm_spark, []), f"{tmp_path}/none")
        assert empty.count() == 0 and (name == "packing" or tuple(empty.columns) == c.COLUMNS)
    toxic = odd_documents(llm_spark, [(7, "you idiot, you stupid worthless moron, I will kill you.", None, None, None), (8, story, None, None, None)])
    assert [r["doc_id"] for r in c.toxicity_filter(llm_spark, toxic, f"{tmp_path}/none").collect()] == [8]


def test_run_leaves_only_what_its_result_reads(llm_spark, sf_dir):
    from lodestrata.plans.store import release, written

    before = written(llm_spark)
    out = c.run(llm_spark, sf_dir)
    new = [p for p in written(llm_spark) if p not in before]
    assert out.count() > 0 and release(llm_spark, new) == len(new)
