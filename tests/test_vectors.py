import re

import pytest

from conftest import plan_of
from pyspark.sql import functions as F

from termloom.functions import svmlite
from termloom.operators import dictionary as dc
from termloom.operators import vectors as vc
from termloom.plans import pipeline as pl
from termloom.sources import vectors as vs

BAGS = "doc_id int, cluster_id string, label int, bag array<struct<term:string,n:bigint>>"


@pytest.fixture
def words(spark):
    return spark.createDataFrame(
        [(0, "a", 9), (1, "b", 8), (2, "c", 7), (3, "d", 6)], "idx bigint, term string, n bigint"
    )


@pytest.fixture
def bags(spark):
    return spark.createDataFrame(
        [
            (1, "k", 1, [("a", 2), ("d", 1)]),
            (2, "k", 1, [("a", 1), ("c", 4), ("unknown", 7)]),
            (3, "e", 0, [("unknown", 1)]),
            (4, "f", None, []),
        ],
        BAGS,
    )


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize(
    "merge, expected",
    [
        ("max", {0: 2.0, 2: 4.0, 3: 1.0}),
        ("sum", {0: 3.0, 2: 4.0, 3: 1.0}),
        ("avg", {0: 1.5, 2: 2.0, 3: 0.5}),
    ],
)
def test_cluster_merge(bags, words, merge, expected, small):
    entries = vc.cluster_entries(bags, words, merge, small_dictionary=small).collect()
    assert {r["idx"]: r["value"] for r in entries} == expected
    assert {r["cluster_id"] for r in entries} == {"k"}


def test_clusters_without_known_terms_stay(bags, words):
    table, entries = vc.clusters(bags), vc.cluster_entries(bags, words)
    long = vc.cluster_vectors(table, entries).collect()
    assert len(long) == 5
    assert {(r["cluster_id"], r["label"], r["n_docs"]) for r in long} == {
        ("k", 1, 2), ("e", 0, 1), ("f", None, 1),
    }
    assembled = {r["cluster_id"]: r["entries"] for r in vc.assemble(table, entries).collect()}
    assert [tuple(e) for e in assembled["k"]] == [(0, 2.0), (2, 4.0), (3, 1.0)]
    assert assembled["e"] == assembled["f"] == []


def test_one_cluster_of_most_documents(spark, words):
    rows = [
        (i, "hot" if i % 3 else f"c{i}", None, [("abcd"[i % 4], i % 5 + 1)]) for i in range(600)
    ]
    hot = spark.createDataFrame(rows, BAGS).repartition(16)
    for small in (True, False):
        entries = vc.cluster_entries(hot, words, small_dictionary=small)
        found = entries.where("cluster_id = 'hot'").collect()
        assert {r["idx"]: r["value"] for r in found} == {0: 5.0, 1: 5.0, 2: 5.0, 3: 5.0}
    assert vc.clusters(hot).where("cluster_id = 'hot'").first()["n_docs"] == 400


def test_document_vectors(bags, words):
    found = vc.doc_term_vectors(bags, words, "doc_id").collect()
    assert {(r["doc_id"], r["idx"], r["value"]) for r in found} == {
        (1, 0, 2.0), (1, 3, 1.0), (2, 0, 1.0), (2, 2, 4.0),
    }


def test_explain(bags, words):
    explained = vc.explain_vector(vc.cluster_entries(bags, words), words).collect()
    assert {(r["idx"], r["term"]) for r in explained} == {(0, "a"), (2, "c"), (3, "d")}


def test_label_conflicts(spark):
    docs = spark.createDataFrame(
        [("x", 0), ("x", 1), ("y", 1), ("y", None)], "cluster_id string, label int"
    )
    assert [tuple(r) for r in vc.label_conflicts(docs).collect()] == [("x", 0, 1, 2)]
    assert vc.clusters(docs).where("cluster_id = 'x'").first()["label"] == 0


def test_max_index_and_gamma(spark):
    def gamma(*indices):
        frame = spark.createDataFrame([(i,) for i in indices], "idx bigint")
        return tuple(vc.max_feature_index(frame).first())

    assert gamma(0, 3, 1) == (3, pytest.approx(1 / 3))
    assert gamma(0) == (0, 0.0)
    assert gamma() == (0, 0.0)


VECTORS = "cluster_id string, label int, entries array<struct<idx:bigint,value:double>>"


def test_vector_lines(spark):
    rows = [("c1", 1, [(0, 2.0), (3, 1.0)]), ("c7", None, []), ("a b", 0, [(5, 0.5)])]
    lines = vs.svmlite_lines(spark.createDataFrame(rows, VECTORS)).collect()
    assert {r["cluster_id"]: r["line"] for r in lines} == {
        "c1": "1 0:2.0 3:1.0", "c7": "c7", "a b": "0 5:0.5",
    }


@pytest.mark.parametrize("bad", ["a b", "a:b", "a\tb"])
def test_unlabelled_id_with_delimiter_fails(spark, bad):
    rows = spark.createDataFrame([(bad, None, [])], VECTORS)
    with pytest.raises(Exception, match="delimiter"):
        vs.svmlite_lines(rows).collect()


def test_parse(spark):
    lines = ["1 0:2.0 3:1.0", "c7", "  -1\t4:2.5 9", "x 1:1 1:2"]
    parsed = vs.parse_svmlite(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert [(r["first"], [tuple(e) for e in r["entries"]]) for r in parsed.collect()] == [
        ("1", [(0, 2.0), (3, 1.0)]), ("c7", []), ("-1", [(4, 2.5)]),
        ("x", [(1, 1.0), (1, 2.0)]),
    ]


def test_vector_files(spark, tmp_path):
    rows = [(f"c{i:02d}", i % 2, [(i, float(i))]) for i in range(40)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(7)
    path = str(tmp_path / "v.dat")
    assert vs.write_svmlite(vectors, path) == 40
    assert vs.write_vectors(vectors, str(tmp_path / "v.parquet")) == 40
    lines = [r["value"] for r in spark.read.text(path).orderBy("value").collect()]
    assert lines == sorted(f"{i % 2} {i}:{float(i)}" for i in range(40))
    ids = [r["value"] for r in spark.read.text(path + ".ids").collect()]
    assert sorted(ids) == [f"c{i:02d}" for i in range(40)]
    problem = vs.read_svmlite_problem(spark, path)
    assert problem.agg(F.sum("label")).first()[0] == 20.0
    again = problem.select(
        svmlite.format_line(F.col("label").cast("int"), F.lit("?"), F.col("entries")).alias("x")
    )
    assert sorted(r["x"] for r in again.collect()) == lines


def test_training_file_with_an_id_fails(spark, tmp_path):
    (tmp_path / "v").write_text("c7 1:1\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        vs.read_svmlite_problem(spark, str(tmp_path / "v")).collect()


def test_repeated_dictionary_terms_at_any_size(spark):
    words = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "idx bigint, term string")
    bags = spark.createDataFrame([("k", 1, [("a", 3), ("b", 1)])], BAGS_SMALL)
    for small in (True, False):
        found = vc.cluster_entries(bags, words, small_dictionary=small).collect()
        assert {(r["idx"], r["value"]) for r in found} == {(2, 3.0), (1, 1.0)}


def test_no_shuffle_by_cluster_alone_under_an_outer_join(spark, words):
    rows = [("hot" if i % 10 else f"c{i}", 1, [("a", 1), ("b", i)]) for i in range(300)]
    bags = spark.createDataFrame(rows, BAGS_SMALL)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(vc.cluster_vectors(vc.clusters(bags), vc.cluster_entries(bags, words)))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftOuter" not in plan and "RightOuter" not in plan


BAGS_SMALL = "cluster_id string, label int, bag array<struct<term:string,n:bigint>>"


def test_membership_filter_loses_no_known_term(spark):
    words = spark.range(5000).select(
        F.col("id").alias("idx"), F.concat(F.lit("w"), F.col("id")).alias("term")
    )
    made = dc.membership(words)
    assert made[0].count() <= made[1] == -(-5000 // dc.TERMS_PER_WORD)
    entries = spark.range(20000).select(F.concat(F.lit("w"), F.col("id")).alias("term"))
    kept = {r["term"] for r in dc.perhaps_known(entries, made).collect()}
    assert {f"w{i}" for i in range(5000)} <= kept
    assert len(kept) < 5000 + 0.15 * 15000
    assert dc.membership(words, limit=100) is None
    assert dc.perhaps_known(entries, None).count() == 20000


def test_unknown_terms_are_dropped_before_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(dc, "HEAD_ROWS", 2)
    words = spark.createDataFrame([(i, f"t{i}", 9 - i) for i in range(8)], "idx bigint, term string, n bigint")
    rows = [("k", 1, [(f"t{i}", i + 1) for i in range(8)] + [(f"x{i}", 1) for i in range(500)])]
    bags = spark.createDataFrame(rows, BAGS_SMALL)
    large = vc.cluster_entries(bags, words, small_dictionary=False, unique=True)
    small = vc.cluster_entries(bags, words, small_dictionary=True, unique=True)
    assert set(map(tuple, large.collect())) == set(map(tuple, small.collect()))
    plan = plan_of(large)
    # the filter's join stands below the merge by cluster and term
    assert "bits" in plan and plan.index("hashpartitioning(cluster_id") < plan.index("_bits")


def test_entries_are_merged_once_and_the_dictionary_is_taken_as_it_is(spark, bags, words):
    table, entries = pl.vectorize(bags, words)
    assert "max(idx" not in plan_of(entries)
    plan = plan_of(vc.cluster_vectors(table, entries))
    assert "Generate" not in plan  # the merge is read from its table
    other = pl.vectorize(bags, words, unique=False)[1]
    assert "max(idx" in plan_of(other)


def test_vector_files_in_pieces(spark, tmp_path):
    rows = [(f"c{i:02d}", None if i % 3 else i % 2, [(k, float(i + k)) for k in range(i)]) for i in range(25)]
    whole = spark.createDataFrame(rows, VECTORS)
    entries = whole.select("cluster_id", F.inline("entries"))
    pieces = vc.assemble(whole.select("cluster_id", "label"), entries, segment_size=4).repartition(5)
    path = str(tmp_path / "v")
    assert vs.write_svmlite(pieces, path) == pieces.count() > 60
    assert max(len(r["value"].split()) for r in spark.read.text(path).collect()) == 5
    got = vs.read_svmlite_entries(spark, path).collect()
    expected = {(c, k, v) for c, _, e in rows for k, v in e or [(None, None)]}
    assert {(r["cluster_id"], r["idx"], r["value"]) for r in got} == expected and len(got) == len(expected)
    firsts = {c: c if label is None else str(label) for c, label, _ in rows}
    assert {(r["cluster_id"], r["first"]) for r in got} == set(firsts.items())


def test_written_rows_are_counted_by_the_write(spark, tmp_path):
    rows = spark.createDataFrame([("c", 1, [(0, 1.0)])] * 7, VECTORS).repartition(3)
    assert vs.write_vectors(rows, str(tmp_path / "v")) == 7
    assert vs.write_vectors(rows.limit(0), str(tmp_path / "none")) == 0


def test_only_long_vectors_are_cut(spark):
    rows = [
        ("short", 1, [(f"t{9 * k:02d}", 1) for k in range(3)]),
        ("long", 0, [(f"t{k:02d}", 2) for k in range(20)]),
        (None, 0, [("t19", 3), ("t00", 1)]),
        ("bare", None, None),
    ]
    bags = spark.createDataFrame(
        rows, "cluster_id string, label int, bag array<struct<term:string,n:bigint>>"
    )
    words = spark.createDataFrame([(k, f"t{k:02d}", 1) for k in range(20)], "idx long, term string, n long")
    cut = pl.model_vectors(bags, words, segment_size=4).collect()
    held = {}
    for r in cut:
        held.setdefault(r["cluster_id"], []).append((r["segment"], [e["idx"] for e in r["entries"]]))
    assert held["short"] == [(0, [0, 9, 18])]
    assert sorted(held["long"]) == [(k, list(range(4 * k, 4 * k + 4))) for k in range(5)]
    assert held["bare"] == [(0, [])]


def test_a_whole_line_for_each_cluster(spark):
    rows = [(f"c{i:02d}", None if i % 3 else i % 2, [(k, float(i + k)) for k in range(i)]) for i in range(25)]
    whole = spark.createDataFrame(rows, VECTORS)
    lines = vs.whole_lines(
        whole.select("cluster_id", "label"), whole.select("cluster_id", F.inline("entries")), 4
    )
    expected = {(r["cluster_id"], r["line"]) for r in vs.svmlite_lines(whole).collect()}
    got = lines.collect()
    assert {tuple(r) for r in got} == expected and len(got) == 25


def test_lines_of_the_query_hold_whole_vectors(spark, bags, words, monkeypatch):
    from termloom.plans import queries

    monkeypatch.setattr(queries, "LINE_INDICES", 2)
    monkeypatch.setattr(queries, "_bags_and_dictionary", lambda *_: (bags, words))
    lines = sorted(map(tuple, queries.svmlite_lines(spark, "").collect()))
    assert lines == [("e", "0"), ("f", "f"), ("k", "1 0:2.0 2:4.0 3:1.0")]


def test_rare_entries_are_shuffled_once(bags, words, monkeypatch):
    monkeypatch.setattr(vc, "membership", lambda tail: None)
    monkeypatch.setattr("termloom.operators.dictionary.HEAD_ROWS", 1)
    entries = vc.cluster_entries(bags, words, "sum", small_dictionary=False, unique=True)
    assert not re.search(r"hashpartitioning\(cluster_id#\d+, term#\d+", plan_of(entries))
    assert {(r["cluster_id"], r["idx"], r["value"]) for r in entries.collect()} == {
        ("k", 0, 3.0), ("k", 2, 4.0), ("k", 3, 1.0),
    }


def test_a_dictionary_of_its_own_bags_needs_no_filter(spark, bags, monkeypatch):
    monkeypatch.setattr("termloom.operators.dictionary.HEAD_ROWS", 1)
    monkeypatch.setattr("termloom.operators.vectors.fits_broadcast", lambda _: False)
    own = dc.build_dictionary(dc.term_counts(bags))
    for merge in ("max", "sum", "avg"):
        complete = pl.vectorize(bags, own, merge, complete=True)[1]
        assert "_bits" not in plan_of(complete)
        assert set(map(tuple, complete.collect())) == set(map(tuple, pl.vectorize(bags, own, merge)[1].collect()))


def test_rows_of_a_cluster_do_not_meet_under_an_outer_join(spark, bags, words):
    lost = spark.createDataFrame([(9, None, 1, [("b", 2)]), (8, "m", None, [("d", 3)])], BAGS)
    bags = bags.unionByName(lost)
    table, entries = vc.clusters(bags), vc.cluster_entries(bags, words)
    cut = vc.assemble(table, entries, segment_size=2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(vc.assemble(table, entries, segment_size=2))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "LeftOuter" not in plan
    assert cut.columns == ["cluster_id", "label", "n_docs", "segment", "entries"]
    got = {(r["cluster_id"], r["label"], r["segment"], tuple(map(tuple, r["entries"]))) for r in cut.collect()}
    assert got == {
        ("k", 1, 0, ((0, 2.0),)), ("k", 1, 1, ((2, 4.0), (3, 1.0))), ("m", None, 1, ((3, 3.0),)),
        ("e", 0, 0, ()), ("f", None, 0, ()), (None, 1, 0, ()),
    }


@pytest.fixture
def own(spark):
    """Bags of three clusters, one of them without a term, and their dictionary."""
    rows = [(i, f"c{i % 2}", 1, [("all", 2), (f"t{i}", 1), (f"u{i % 7}", i + 1)]) for i in range(40)]
    rows += [(40, "none", 0, []), (41, None, None, [("all", 1), ("t3", 5)])]
    bags = spark.createDataFrame(rows, BAGS)
    return bags, dc.build_dictionary(dc.term_counts(bags))


def test_terms_of_a_complete_dictionary_are_dealt_by_short_keys(own, monkeypatch):
    bags, words = own
    monkeypatch.setattr(dc, "fits_broadcast", lambda _: False)
    monkeypatch.setattr(vc, "fits_broadcast", lambda _: False)
    monkeypatch.setattr(dc, "HEAD_ROWS", 2)
    row = lambda df: sorted(map(str, df.collect()))
    for make in (
        lambda complete: vc.cluster_entries(bags, words, "sum", unique=True, complete=complete),
        lambda complete: vc.doc_term_vectors(bags, words, "doc_id", unique=True, complete=complete),
    ):
        short, plain = make(True), make(False)
        assert row(short) == row(plain) and short.count() > 40
        assert "hashpartitioning(_key" in plan_of(short) and "hashpartitioning(term" not in plan_of(short)


def test_two_terms_with_one_key_fail(own):
    bags, words = own
    assert dc.keyed(words).count() == words.count()
    with pytest.raises(Exception, match="two terms have the same key"):
        dc.keyed(words.unionByName(words)).collect()


def test_entries_of_own_bags_are_not_written_for_the_clusters_without(own, monkeypatch):
    bags, words = own
    written = []
    monkeypatch.setattr(vc, "materialize", lambda table: written.append(table.columns) or table)
    row = lambda df: sorted(map(str, df.collect()))
    for form in (vc.cluster_vectors, vc.assemble):
        plain = row(form(*pl.vectorize(bags, words)))
        written.clear()
        marked = form(*pl.vectorize(bags, words, complete=True))
        assert row(marked) == plain and vc.BARE not in marked.columns
        assert not any("idx" in columns for columns in written)
