"""The pipeline stages, one after another, on a small corpus."""

import brute

import corpus_pipeline
from termloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = {r.doc_id: r.text for r in docs.collect()}
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_DIR)
        out.write.parquet(str(tmp_path / name))
        docs_out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs_out.columns == docs.columns
            kept[name] = {r.doc_id: r.text for r in docs_out.collect()}
        docs = docs_out
    rules = {r.doc_id: r.kept for r in QUERIES["op9_rules"](spark, SF_DIR).collect()}
    assert set(kept["quality_rules"]) == {i for i, k in rules.items() if k}
    groups = brute.near_duplicates(list(kept["quality_rules"].items()))
    assert set(kept["near_duplicates"]) == {i for i, (_, c) in groups.items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    found = brute.contamination(list(kept["near_duplicates"].items()), items)
    assert set(kept["benchmark_decontamination"]) == {i for i, f in found.items() if not f[4]}
    assert set(kept["pii"]) == set(kept["benchmark_decontamination"])
    assert not any(brute.pii(t) for t in kept["pii"].values())
    assert any(kept["pii"][i] != seen[i] for i in kept["pii"])
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(kept["pii"])


def test_run_is_the_chain_of_stages(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == [
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    ]
    total = {}
    for r in got.collect():
        total.setdefault((r.doc_id, r.doc_tokens), []).append(r.length)
    assert total and all(sum(v) == n for (_, n), v in total.items())


DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int"
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"


def odd_folder(tables, rows):
    return tables(
        documents=(rows, DOCS), labels=([(1, 1, 0), (None, 0, 1), (2, None, None)], LABELS),
        benchmark=([(None, "a b c"), (1, None), (2, "")], ITEMS),
    )


def test_odd_rows(spark, tables):
    """Nulls, empty and very long texts, ties, repeated rows, columns with names used inside."""
    text = " ".join(f"word{i}" for i in range(30))
    long = " ".join(f"long{i}" for i in range(60_000))
    rows = [
        (1, text, "en", "s", 3, "x", 7), (1, text, "en", "s", 3, "x", 7), (2, text + " z", None, None, None, None, None),
        (None, " ".join(f"other{i}" for i in range(30)), "en", None, None, "y", 1), (4, None, "en", "s", 0, "x", 1),
        (5, "", "en", "s", 0, "x", 1), (6, long, "en", "s", 0, "x", 1), (7, "too few words", "en", "s", 0, "x", 1),
    ]
    folder = odd_folder(tables, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
    pieces = corpus_pipeline.run(spark, folder).collect()
    whole = {}
    for r in pieces:
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.length
        assert r.doc_tokens >= r.length
    assert set(whole) == {1, None, 6}
    assert sum(r.start == 0 for r in pieces) == 3  # one row of the repeated and the near ones


def test_empty_tables(spark, tables):
    folder = tables(documents=([], DOCS), labels=([], LABELS), benchmark=([], ITEMS))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_run_leaves_one_table(spark, tables):
    """What the last stage reads is left, and nothing else."""
    import os

    from termloom.session import shared_folder

    text = " ".join(f"word{i}" for i in range(30))
    folder = odd_folder(tables, [(i, f"{text} {i % 3}", "en", "s", 1, "x", 1) for i in range(9)])
    shared = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(shared))
    assert corpus_pipeline.run(spark, folder).count() > 0
    assert len({x for x in set(os.listdir(shared)) - before if x.startswith("termloom-")}) == 1


def test_rows_that_are_not_read_from_files(spark):
    """The row-keeping operators number such rows by a table of their own."""
    from termloom.llm import neardup

    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert sorted(r.doc_id for r in neardup.representatives(docs).collect()) == [1, 3]
