"""The pipeline on rows with planted copies, toxic texts and secrets."""

import random

import corpus_pipeline
import pytest
from conftest import words
from pyspark.sql import functions as F

from tidemark.llm import entry


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, messy_rows):
    r, docs, labels = random.Random(9), [], []
    for i in range(1000, 1300):
        text = words(i, 120)
        if i % 5 == 0:
            text += " vile rotten wretch vile"
        docs.append((i, text, "en", f"s{i % 6}", len(text), None, None, 0, 0))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(2000 + k, docs[k][1].replace(" ", "  "), *docs[k][2:]) for k in range(1, 40)]
    for k in range(40, 80):
        w = docs[k][1].split()
        w[60] = "edited"
        docs.append((3000 + k, " ".join(w), *docs[k][2:]))
    docs.append((4000, words(4000, 50) + " password=S3cretValue99", *docs[0][2:]))
    d = tmp_path_factory.mktemp("corpus")
    schema = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, digest string, spans int, row int"
    spark.createDataFrame(docs + messy_rows, schema).repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d), {x[0]: x for x in docs}


def test_stages_take_effect(spark, corpus):
    path, docs = corpus
    now, seen = spark.read.parquet(f"{path}/documents.parquet"), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, path).cache()
        assert now.columns == columns
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    assert not any(i % 5 == 0 for i in seen["toxicity"] if i and 1000 <= i < 1300)
    assert all(i in seen["toxicity"] for i in range(1000, 1300) if i % 5)
    assert not any(2000 <= (i or 0) < 2100 for i in seen["exact_dedup"]) and all(i in seen["exact_dedup"] for i in range(1000, 1300) if i % 5)
    near = [i for i in range(3040, 3080) if i in seen["exact_dedup"]]
    assert sum(i in seen["near_dedup"] for i in near) <= 0.1 * len(near) and all(i in seen["near_dedup"] for i in range(1000, 1300) if i % 5)
    assert "S3cret" not in seen["secret_scan"][4000] and seen["secret_scan"].keys() == seen["near_dedup"].keys()
    packed = corpus_pipeline.packing_stage(spark, now, path)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(seen["secret_scan"])
    assert corpus_pipeline.run(spark, path).agg(F.sum("length")).first()[0] == packed.agg(F.sum("length")).first()[0]


def test_repeated_rows_leave_one(spark, messy, tmp_path):
    rows = corpus_pipeline.exact_dedup(spark, messy, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(["1", "2", "4", "6", "7", "8", "9", "10", "11", "12", "None", "14", "15", "200"])


def test_empty_corpus(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry():
    assert [n.split("_")[0] for n in entry.queries()] == [f"op{k}" for k in range(1, 14)]
    assert set(entry.oracle_sql()) <= set(entry.queries())
