"""From JSON lines to a scored submission, by the jobs a user runs."""

import json
import random

import pytest

from termloom.operators import evaluate as ev
from termloom.operators import split as sp
from termloom.operators import svm
from termloom.plans import jobs
from termloom.plans.pipeline import TermOptions
from termloom.sources import scores as sc

GOOD, BAD = ["bright", "garden", "music", "honest"], ["cheap", "urgent", "call", "tonight"]
BOTH = ["city", "car", "phone", "house"]


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    rng = random.Random(2)
    folder = tmp_path_factory.mktemp("corpus")
    lines = []
    for cluster in range(60):
        label = cluster % 2
        for _ in range(rng.randint(1, 4)):
            words = rng.choices((GOOD if label else BAD) + BOTH, k=12)
            text = " ".join(words[:6]) + " of it. " + " ".join(words[6:]) + " the end."
            lines.append({"extracted_text": text, "class": label,
                          "cluster_id": f"{'pn'[1 - label]}{cluster}"})
    path = folder / "train.jsonl"
    path.write_text("".join(json.dumps(line) + "\n" for line in lines))
    return str(path), len({line["cluster_id"] for line in lines})


def test_from_documents_to_submission(spark, corpus, tmp_path):
    documents, n_clusters = corpus
    at = lambda name: str(tmp_path / name)
    jobs.build_dict(spark, documents, at("dict"), text=at("dict.txt"))
    terms = {r["value"] for r in spark.read.text(at("dict.txt")).collect()}
    assert {"bright", "of", "end"} <= terms and any(t.count(" ") == 3 for t in terms)
    assert spark.read.text(at("dict.tsv")).count() == len(terms)

    assert jobs.vectorize(spark, documents, at("dict"), at("v"), text=at("v.dat")) == n_clusters
    vectors = jobs.read_vectors(spark, at("v"))
    text_vectors = jobs.read_text_vectors(spark, at("v.dat"), labelled=True)
    assert text_vectors.count() == vectors.count() == n_clusters
    in_text = sorted(str(r["entries"]) for r in text_vectors.select("entries").collect())
    assert in_text == sorted(str(r["entries"]) for r in vectors.select("entries").collect())

    train, test = sp.train_test_split(vectors, "cluster_id", n_train=40)
    jobs.train(train, at("model"), svm.SvmOptions(kernel="linear"))
    report = jobs.evaluate(spark, test, at("model"), records=at("records"))
    n_test = n_clusters - 40
    assert sc.read_truth(spark, at("records/truth")).count() == n_test
    assert sc.read_scores(spark, at("records/scores")).count() == n_test
    assert report.errors.first()["total"] == n_clusters - 40
    assert report.errors.first()["error_percent"] < 10

    jobs.predict(spark, test, at("model"), at("predicts.csv"))
    jobs.submit(spark, at("predicts.csv"), at("submission"))
    truth = test.selectExpr("cluster_id", "label AS class")
    scored = ev.align(truth, sc.read_scores(spark, at("submission")))
    assert ev.roc_auc(scored).first()["auc"] == pytest.approx(report.auc.first()["auc"])


def test_capped_and_generalised_dictionary(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text(json.dumps({"extracted_text": "ab ab cd", "cluster_id": "c"}) + "\n")
    jobs.build_dict(spark, str(path), str(tmp_path / "one"), max_terms=1)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "one")).collect()] == [(0, "ab", 2)]

    def annotator(documents):
        from termloom.functions import text as tx
        from termloom.operators import annotate as an

        return an.annotate(documents, ner_rule=lambda token: tx.F.lit("ORGANIZATION"))

    options = TermOptions(generalize=True, annotator=annotator)
    jobs.build_dict(spark, str(path), str(tmp_path / "two"), options)
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "two")).collect()] == [
        (0, "-organization-", 1)
    ]


def test_dictionary_by_documents(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    texts = ["ab ab ab", "cd", "cd ef"]
    path.write_text("".join(json.dumps({"extracted_text": t, "cluster_id": "c"}) + "\n" for t in texts))
    assert jobs.build_dict(spark, str(path), str(tmp_path / "n"), by_documents=True) == 3
    got = spark.read.parquet(str(tmp_path / "n")).orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(0, "cd", 2), (1, "ab", 1), (2, "ef", 1)]


def test_one_line_a_cluster_is_a_choice(spark, corpus, tmp_path, monkeypatch):
    from termloom.plans import pipeline as pl

    monkeypatch.setattr(pl, "SEGMENT_SIZE", 5)
    documents, n_clusters = corpus
    at = lambda name: str(tmp_path / name)
    jobs.build_dict(spark, documents, at("dict"))
    jobs.vectorize(spark, documents, at("dict"), at("v"), text=at("pieces"))
    jobs.vectorize(spark, documents, at("dict"), at("w"), text=at("lines"), one_line=True)
    assert spark.read.text(at("lines")).count() == n_clusters < spark.read.text(at("pieces")).count()
    from termloom.sources import vectors as vs

    pieces, lines = (
        sorted(map(str, vs.read_svmlite_entries(spark, at(x)).collect())) for x in ("pieces", "lines")
    )
    assert pieces == lines


def test_fuse_keeps_fields_and_takes_the_last_line(spark, tmp_path):
    import json

    first, second = tmp_path / "text.json", tmp_path / "image.json"
    records = [
        {"cluster_id": "a", "score": 0.8, "note": "x", "more": {"n": 1}},
        {"cluster_id": "b", "score": 0.3, "note": "y", "more": {"n": 2}},
    ]
    first.write_text("".join(json.dumps(r) + "\n" for r in records))
    second.write_text(
        '{"cluster_id": "a", "score": 0.1}\n{"cluster_id": "a", "score": 0.6}\n'
    )
    counters = jobs.fuse(spark, str(first), str(second), str(tmp_path / "fused"))
    assert counters == {"total": 2, "missed": 1, "agreed": 1}
    got = {r["cluster_id"]: r for r in spark.read.json(str(tmp_path / "fused")).collect()}
    assert got["a"]["score"] == 0.7 and got["b"]["score"] == 0.3
    assert got["a"]["note"] == "x" and got["b"]["more"]["n"] == 2


def test_kept_and_discarded_tables(spark):
    import os

    from termloom.session import discard, materialize, run_scope, shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with run_scope(spark):
        with run_scope(spark):
            gone, kept = materialize(spark.range(5)), materialize(spark.range(6), keep=True)
        assert len(set(os.listdir(folder)) - before) == 1 and kept.count() == 6
        discard(kept, gone, spark.range(3))
        assert set(os.listdir(folder)) == before
    outside = materialize(spark.range(4))
    discard(outside)
    assert set(os.listdir(folder)) == before


def test_a_run_leaves_no_intermediate_table(spark, tmp_path):
    import os

    from termloom.session import materialize, run_scope, shared_folder

    folder = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with run_scope(spark):
        assert materialize(spark.range(5)).count() == 5
        assert set(os.listdir(folder)) != before
    assert set(os.listdir(folder)) == before
