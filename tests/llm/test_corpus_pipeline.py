"""The pipeline's stages, each judged on its own input, and the registered queries of the corpus operators."""

import pytest
from pyspark.sql import functions as F
from test_llm_operators import closure, plain_fingerprint

import __spark_entry__ as entry
import corpus_pipeline
from waitline.llm import queries

SF = "/root/testdata/sf0.001"


def test_every_operator_has_one_query():
    names = entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES])
def test_query_covers_every_document(spark, name):
    n = spark.read.parquet(f"{SF}/{'embeddings' if name[2:4] in ('12', '13') else 'documents'}.parquet").count()
    assert queries.QUERIES[name](spark, SF).count() == n


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("slot", F.lit(1))
    held = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.dtypes == docs.dtypes
        out.write.parquet(f"{tmp_path}/{k}")
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        after = {r.doc_id for r in docs.collect()}
        assert after <= set(before)
        held[name] = (before, after)
    before, after = held["exact dedup"]
    last = {t: i for i, t in sorted(before.items())}
    assert after == set(last.values())
    before, after = held["near dedup"]
    roots = closure({i: plain_fingerprint(t) for i, t in before.items()})
    assert after == set(roots.values())
    before, after = held["packing"]
    assert after == set(before)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = held["toxicity"]
    gone = set(before) - after
    assert all(labels.get(i, 1) for i in gone)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == held["packing"][1]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def kept(spark, k, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(r.n_chars for r in corpus_pipeline.STAGES[k][1](spark, docs, SF).collect())


def test_rows_are_dropped_one_by_one(spark):
    """Shared ids, missing ids and rows equal in everything: the clean row of id 5 stays, one row of each group stays."""
    copy, other, clean = "a b c d e f", "g h i j k l", "this one has words of its own"
    rows = [(5, clean), (5, copy), (9, copy), (None, copy), (None, copy), (7, other), (7, other)]
    exact = kept(spark, 1, rows)
    assert exact[:2] == [0, 2] and exact[2] in (5, 6) and len(exact) == 3
    near = kept(spark, 2, rows)
    assert near[:2] == [0, 1] and near[2] in (5, 6) and len(near) == 3
    assert len(kept(spark, 1, [(None, copy)] * 5)) == len(kept(spark, 2, [(None, None), (None, ""), (3, None)])) == 1
    assert kept(spark, 2, [(None, None), (None, ""), (3, None)]) == [2]


def test_leaks_and_toxic_rows_go_without_an_id_too(spark):
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(r.text.split()) > 12)
    rows = [(None, f"words before {item} and behind"), (4, "clean words only here"), (4, item), (None, "nothing to see here"), (None, None)]
    assert kept(spark, 3, rows) == [1, 3, 4]
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    toxic = docs.join(labels.where("toxic = 1"), "doc_id", "left_semi")
    out = corpus_pipeline.drop_toxic(spark, docs.unionByName(toxic.withColumn("doc_id", F.lit(None).cast("long"))), SF)
    with_id = out.join(toxic.select("doc_id"), "doc_id", "left_semi").count()
    assert out.where("doc_id is null").count() == with_id < toxic.count()


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
