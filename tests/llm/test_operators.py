"""The registered queries on small tables against plain versions, and on odd input."""

import math
import random
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import licenses, ranking
from termloom.llm.queries import QUERIES

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
ITEMS = "item_id long, text string"
VECTORS = "vec_id long, embedding array<float>, label int"
ODD_DOCS = [
    (1, "a b c d e f g h i j k", None, None, 3), (1, "a b c d e f g h i j k", None, None, 3),
    (None, None, None, None, None), (None, "", None, "s", 0), (5, "x " * 5000, "en", "s", 1),
]
ODD_LABELS = [(1, 1, 0), (1, 0, 0), (None, 1, 1), (5, None, None)]
ODD_ITEMS = [(None, "a b c"), (1, None), (1, "")]
ODD_VECTORS = [
    (100, [0.5, 0.5], 1), (100, [0.5, 0.5], 1), (1, [0.5, 0.4], 1), (2, [0.4, 0.5], 2), (2, [0.4, 0.5], 2),
    (None, [0.5, 0.5], 2), (3, None, 2), (4, [0.5, None], 2), (5, [float("nan"), 0.5], 2),
    (6, [0.5, 0.5], None), (8, [float("inf"), 0.5], 2), (9, [], 2), (10, [0.5], 2),
]


def corpus(seed, alphabet, n, longest):
    rng = random.Random(seed)
    rows = [
        (i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, longest))), "en", "s", 0)
        for i in range(n)
    ]
    return [*rows, (n, None, None, None, None), (n + 1, "", "de", None, 0)]


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tables, name):
    folder = tables(
        documents=([], DOCS), labels=([], LABELS), benchmark=([], ITEMS), embeddings=([], VECTORS)
    )
    assert QUERIES[name](spark, folder).count() == 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_nulls_and_repeated_rows(spark, tables, name):
    folder = tables(
        documents=(ODD_DOCS, DOCS), labels=(ODD_LABELS, LABELS), benchmark=(ODD_ITEMS, ITEMS),
        embeddings=(ODD_VECTORS, VECTORS),
    )
    got = QUERIES[name](spark, folder).collect()
    if name not in ("op3_packing", "op11_hardneg"):
        assert sorted(str(r.doc_id) for r in got) == ["1", "1", "5", "None", "None"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_more_columns(spark, tables, name):
    """Names that the operators use inside may also be names of the table."""
    folder = tables(
        documents=(ODD_DOCS, DOCS), labels=(ODD_LABELS, LABELS), benchmark=(ODD_ITEMS, ITEMS),
        embeddings=(ODD_VECTORS, VECTORS),
    )
    expected = QUERIES[name](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for extra in ("t", "key", "row", "spans", "words", "block", "stratum", "n", "cls", "quality"):
        docs = docs.withColumn(extra, F.lit("x"))
    docs.write.parquet(f"{folder}/more/documents.parquet")
    for other in ("labels", "benchmark", "embeddings"):
        spark.read.parquet(f"{folder}/{other}.parquet").withColumn("t", F.lit(1)).write.parquet(
            f"{folder}/more/{other}.parquet"
        )
    assert QUERIES[name](spark, f"{folder}/more").schema == expected.schema
    assert QUERIES[name](spark, f"{folder}/more").count() == expected.count()


def test_pii(spark, tables):
    rows = corpus(1, "a1.2@+-_ ()é𝒳9%\n4", 600, 60)
    hard = [
        "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "+1 (437) 555-0689", "aaaa" * 20000, "1" * 50000,
        "a@" + "b." * 9000 + "c", "é𝒳 a@b.c 4539 1488 0343 6467", "0255.000.1.255 256.1.1.1.1",
        "iban DE89370400440532013000 x", "ssn 123-45-6789",
    ]
    rows += [(1000 + i, t, "en", "s", 0) for i, t in enumerate(hard)]
    got = {r.doc_id: r for r in QUERIES["op1_pii"](spark, tables(documents=(rows, DOCS))).collect()}
    for i, text in pairs(rows):
        want = brute.pii(text)
        assert got[i].base_sha256 == brute.sha(want)
        assert got[i].spans.startswith(",".join(want))
        for kind in ("email", "ip", "card", "phone"):
            assert got[i][f"n_{kind}"] == sum(s.startswith(kind) for s in want)
    assert "iban:5:27" in got[1008].spans and "ssn:4:15" in got[1009].spans


def test_redaction(spark):
    from termloom.llm import pii

    docs = spark.createDataFrame(
        [(1, "mail a@b.co now 1.2.3.4", 3, "x"), (2, None, None, "y")],
        "doc_id long, text string, n_chars int, spans string",
    )
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == [
        (1, "mail <EMAIL> now <IP>", 21, "x"), (2, None, None, "y")
    ]


def test_packing(spark, tables, tokenizer):
    rows = corpus(3, ["a", "Zé ", " ", "\n", "'s", "1", "字", " the"], 120, 1500)
    got = QUERIES["op3_packing"](spark, tables(documents=(rows, DOCS))).toPandas()
    assert got.sequence_id.is_unique and (got.offset == 0).all()
    assert set(got.length) <= {1 << k for k in range(11)}
    for i, text in pairs(rows):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        at = 0
        for piece in got[got.doc_id == i].sort_values("start").itertuples():
            assert piece.start == at and piece.doc_tokens == len(ids)
            own = np.array(ids[at:at + piece.length], "<u4").tobytes()
            assert zlib.crc32(own) == piece.ids_crc32
            at += piece.length
        assert at == len(ids)


def test_token_file(spark, tables, tokenizer):
    rows = [(r[0] // 2, *r[1:]) for r in corpus(4, ["ab", " ", "é", "\n "], 200, 60)]
    got = QUERIES["op10_tokenfile"](spark, tables(documents=(rows, DOCS))).toPandas()
    want = sorted(
        (i, zlib.crc32(np.array(
            tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()))
        for i, t in pairs(rows)
    )
    assert sorted(zip(got.doc_id, got.ids_crc32)) == want
    got = got.sort_values("start")
    assert (got.start.to_numpy() == np.r_[0, np.cumsum(got.n_tokens)[:-1]]).all()
    assert got.doc_id.is_monotonic_increasing


@pytest.mark.parametrize("slice_bytes", [None, 300])
def test_contamination(spark, tables, monkeypatch, slice_bytes):
    from termloom.llm import decontaminate

    if slice_bytes:
        monkeypatch.setattr(decontaminate, "SLICE_BYTES", slice_bytes)
    rng = random.Random(5)
    vocabulary = ["a", "b", "Cé", "1d"]
    items = [
        (i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 12, 13, 14, 20]))))
        for i in range(25)
    ] + [(99, None), (98, "!!")]
    rows = []
    for i in range(250):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if i % 2:
            words.insert(rng.randint(0, len(words)), rng.choice(items)[1] or "")
        rows.append((i, rng.choice(["-", " ", "\n"]).join(words), "en", "s", 0))
    rows.append((1000, None, None, None, None))
    folder = tables(documents=(rows, DOCS), benchmark=(items, ITEMS))
    got = {r.doc_id: tuple(r)[1:6] for r in QUERIES["op5_decontaminate"](spark, folder).collect()}
    assert got == brute.contamination(pairs(rows), items)


def test_index_files_hold_few_blocks(spark, monkeypatch):
    """A task decodes the rows of a file together, and each is a block of texts."""
    from termloom.llm import decontaminate

    write, written = decontaminate.materialize, []

    def kept(table, **options):
        written.append(write(table, **options))
        return written[-1]

    monkeypatch.setattr(decontaminate, "materialize", kept)
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 30)
    monkeypatch.setattr(decontaminate, "BLOCKS_PER_FILE", 3, raising=False)
    rows = [(i, f"one two{i} three four") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "two7 three"), (2, "four three")], ITEMS)
    got = {r.doc_id: (r.n_hit, r.items) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {i: (2, ["1"]) if i == 7 else (0, []) for i in range(40)}
    (index,) = written
    held = [r["count"] for r in index.groupBy(F.col("_metadata.file_path")).count().collect()]
    assert sum(held) > 3 and max(held) <= 3


def test_licenses(spark, tables):
    words = [
        "under", "the", "MIT", "license", "Apache", "Version", "2", "2.0", "CC", "BY", "-", "nc",
        "é", "\n", "x", "Licensed", "gnu general public license version 3", "this work is",
        "licensed under", "_", "cc-by-nc",
    ]
    rng = random.Random(2)
    texts = [
        "".join(rng.choice(words) + rng.choice([" ", " ", "", "-"]) for _ in range(rng.randint(0, 25)))
        for _ in range(500)
    ] + [None, "", "under the mit license under the mit license", "Xunder the mit license"]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    got = QUERIES["op6_licenses"](spark, tables(documents=(rows, DOCS))).collect()

    def want(text):
        found = brute.LETTER_WORDS.findall(brute.lower(text))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            for i in range(len(found) - len(p) + 1):
                if found[i:i + len(p)] == p:
                    places.append(i)
                    labels.add(label)
        more, best = set(labels), 0
        for label, template in licenses.TEMPLATES:
            t = set(template.split())
            length = licenses.block_length(template)
            for i in range(len(found)):
                n = len(t & set(found[i:i + length]))
                if n >= math.ceil(0.9 * len(t)):
                    more.add(label)
                    best = max(best, n / len(t))
        return (
            len(found), len(places), min(places, default=None), max(places, default=None),
            ",".join(sorted(labels)), ",".join(sorted(more)), 1.0 if places else best,
        )

    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == want(texts[r.doc_id])


def test_wrapped_notices(spark):
    """Notices wrapped at any column, with comment signs, and with a word changed."""
    rows, labels = [], []
    for label, template in licenses.TEMPLATES:
        words = template.split()
        for width in (20, 40, 75):
            lines, line = [], "x y z"
            for w in words:
                if len(line) + len(w) > width:
                    lines.append(line)
                    line = "#"
                line += " " + w.title()
            rows.append((len(rows), "\n".join([*lines, line, "and so on"])))
            labels.append(label)
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), carry=["doc_id"])
    found = {r[0]["doc_id"]: r.labels for r in got.collect()}
    assert all(label in found[i] for i, label in enumerate(labels))


def test_templates_are_a_parameter(spark):
    """Some hundred templates of their own words do not change the shape of the plan."""
    docs = spark.createDataFrame([(1, "t7w0 t7w1\nt7w2 t7w3 t7w4"), (2, "t7w0 t8w1")], "doc_id long, text string")
    many = [(f"l{i}", " ".join(f"t{i}w{k}" for k in range(5))) for i in range(300)]
    few = licenses.scan(docs, phrases=[], templates=many[:8])
    all_ = licenses.scan(docs, phrases=[], templates=many)
    for scanned in (few, all_):
        assert [(r.labels, r.score) for r in scanned.orderBy("n_words").collect()] == [([], 0.0), (["l7"], 1.0)]
    shape = lambda df: len(df._jdf.queryExecution().executedPlan().toString().split("\n"))
    assert shape(few) == shape(all_)
    assert licenses.scan(docs, templates=[]).count() == 2


def test_boilerplate_below_the_similarity(spark, tables, monkeypatch):
    """Half of the rows share boilerplate at 0.5 to 0.74: few pairs are formed, no link is lost."""
    from termloom.llm import neardup

    rng = random.Random(3)
    shared = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        own = [f"o{rng.randrange(10**9)}" for _ in range(rng.choice([25, 35, 50]))]
        rows.append((i, " ".join(shared + own if i % 2 else own), "en", "s", 0))
    rows += [(1000 + i, rows[2 * i + 1][1] + " z", "en", "s", 0) for i in range(20)]
    seen = []
    inner = neardup._crossing

    def counted(*args):
        pairs = inner(*args)
        seen.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "_crossing", counted)
    got = QUERIES["op8_neardup"](spark, tables(documents=(rows, DOCS))).collect()
    want = brute.near_duplicates(pairs(rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert seen[0] < 5 * len(rows)


def test_pairs_of_a_family_are_formed_once(spark):
    """Edited copies of one text share many shingles of their prefixes; a pair comes once."""
    from termloom.llm import neardup

    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    sets = []
    for _ in range(80):
        words = list(base)
        for at in rng.sample(range(120), rng.choice([2, 3, 4, 8])):
            words[at] = f"o{rng.randrange(10**9)}"
        sets.append(neardup.shingle_sets(pa.array([" ".join(words)]))[0])
    rows = [
        (bytearray([i]), len(s), s.view(np.int64).tolist(), neardup.bitmap(s).tolist())
        for i, s in enumerate(sets)
    ]
    table = spark.createDataFrame(rows, "cls binary, n long, shingles array<long>, bits array<long>")
    rest = table.select("cls", F.col("cls").alias("component"))
    prefixes = neardup._prefixes(rest, table, 75).join(neardup._sharing(rest, table), "cls")
    formed = [(r.a[0], r.b[0]) for r in neardup._meeting(prefixes, 75).collect()]
    alike = {
        (i, j)
        for j in range(80) for i in range(j)
        if 7 * len(np.intersect1d(sets[i], sets[j])) >= 3 * (len(sets[i]) + len(sets[j]))
    }
    assert 50 < len(alike) < 3000
    assert len(formed) == len(set(formed)) and alike <= set(formed)


def test_near_duplicates(spark, tables):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 150))]
        for c in range(rng.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 18))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w).title() if c % 2 else "\n".join(w))
    rng.shuffle(texts)
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*texts, None, "", " ", "x", "x"])]
    got = QUERIES["op8_neardup"](spark, tables(documents=(rows, DOCS))).collect()
    want = brute.near_duplicates(pairs(rows))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_rules(spark, tables):
    rows = corpus(2, ["a", "b", " ", " ", "\n", "é𝒳", "#", "|", " \t", "\x1c", "\x0b"], 500, 120)
    folder = tables(documents=(rows, DOCS), labels=([(i, 1, 0) for i in range(9)], LABELS))
    got = {r.doc_id: r for r in QUERIES["op9_rules"](spark, folder).collect()}
    for i, text in pairs(rows):
        r = got[i]
        found = (
            r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed
        )
        assert found == brute.rules(text)
        # too few labels for any certificate: the base rule alone decides
        assert r.kept == (not r.base_failed)


def test_binomial_tail(spark):
    from termloom.llm.rules import binomial_tail

    for k, n, p in ((0, 50, 0.05), (2, 100, 0.05), (3, 1500, 0.005), (5, 60, 0.2), (60, 60, 0.2)):
        want = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
        frame = spark.createDataFrame([(k, n)], "k long, n long")
        got = frame.select(binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
        assert got == pytest.approx(want, rel=1e-9)


def test_certified_cutoffs(spark, tables):
    """With enough labels a rule that good documents never break rejects those that do."""
    good = " ".join(f"word{i}" for i in range(12))
    bad = " ".join(f"word{i}###" for i in range(12))
    rows = [(i, good, "en", "s", 0) for i in range(2500)]
    rows += [(3000 + i, bad, "en", "s", 0) for i in range(20)]
    labels = [(i, 1, 0) for i in range(2500)] + [(3000 + i, 0, 0) for i in range(5)]
    folder = tables(documents=(rows, DOCS), labels=(labels, LABELS))
    got = QUERIES["op9_rules"](spark, folder).collect()
    assert all(r.kept == (r.doc_id < 3000) for r in got)


def test_strata_with_few_labels(spark, tables):
    """300 labels certify a stratum of their own; fewer are judged by all labels together."""
    good, bad = " ".join(f"word{i}" for i in range(12)), " ".join(f"word{i}###" for i in range(12))
    strata = {"en": 900, "es": 300, "fi": 40, "none": 0}
    rows, labels = [], []
    for lang, n in strata.items():
        for i in range(max(n, 5)):
            rows.append((len(rows), good, lang, "s", 0))
            labels += [(len(rows) - 1, 1, 0)] * (i < n)
        rows.append((len(rows), bad, lang, "s", 0))
    folder = tables(documents=(rows, DOCS), labels=(labels, LABELS))
    got = {r.doc_id: r.kept for r in QUERIES["op9_rules"](spark, folder).collect()}
    assert all(got[i] == (text == good) for i, text, *_ in rows)
    slim = tables(documents=([r for r in rows if r[2] == "fi"], DOCS), labels=(labels, LABELS))
    got = QUERIES["op9_rules"](spark, slim).collect()
    assert all(r.kept for r in got)  # 40 labels in all certify nothing


def test_ladder_ends_at_the_first_step_that_fails(spark):
    from termloom.llm.rules import RuleOptions, steps_reached

    steps = RuleOptions().ladder()
    assert len(steps) == 16 and steps[0] == {
        "symbol_ratio": 0.2, "dup_line_ratio": None, "repeat_ratio": None, "upper_ratio": None
    }
    assert steps[-1] == {rule: values[0] for rule, values in RuleOptions().cutoffs}
    frame = spark.createDataFrame([(500, 0, 1, 30, 0), (100, 0, 0, 0, 0)], "n long, a long, b long, c long, d long")
    got = steps_reached(frame, list("abcd"), 0.02, 0.01)
    assert [(r.n, r.step) for r in got.collect()] == [(500, 2), (100, 0)]


def test_ctw(spark, tables):
    rng = random.Random(3)
    rows = [
        (i, "".join(rng.choice(["ab", "C", "é", " ", "\n", "the "]) for _ in range(rng.randint(0, 25))),
         "en", "s", 0)
        for i in range(50)
    ] + [(100, None, None, None, None), (101, "", None, None, None)]
    got = {r.doc_id: r for r in QUERIES["op2_ctw"](spark, tables(documents=(rows, DOCS))).collect()}
    base, full = brute.base_scores(pairs(rows)), brute.ctw_scores(pairs(rows), 5)
    for i, _ in pairs(rows):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == base[i][:3]
        assert r.base_score == pytest.approx(base[i][3], abs=1e-8)
        assert r.score == pytest.approx(full[i], abs=1e-8)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 1)


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = QUERIES["op7_quality"](spark, folder)
    marked = got.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    n, right = marked.agg(F.count("*"), F.count_if(F.expr("predicted = quality"))).first()
    assert n > 50 and right / n > 0.95
    low, high = got.agg(F.min("score"), F.max("score")).first()
    assert 0 <= low <= high <= 1


NATIVE = ("op1_pii", "op6_licenses", "op9_rules")


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan.toString())


def test_quality_is_fitted_on_every_labelled_row(spark):
    options = ranking.RankOptions(group_rows=100, pairs_per_row=3)
    rows = [(i, int(i < 7), [i * (1000.0 if i < 7 else 1.0)] * len(ranking.FEATURES)) for i in range(400)]
    picked = spark.createDataFrame(rows, "key long, q int, x array<double>")
    groups = ranking._groups(picked, {1: 7, 0: 393}, options).collect()
    assert len(groups) == 4 and all(g["good"] and g["bad"] for g in groups)
    assert sorted(x[0] for g in groups for x in g["bad"]) == [float(i) for i in range(7, 400)]
    seen = set()
    for g in groups:
        good, bad = np.array(g["good"]), np.array(g["bad"])
        pairs = ranking.pairs_of(good, bad, options.pairs_per_row, [1, g["grp"]])
        ends = {(a[0] - b[0]): (a[0], b[0]) for a in good for b in bad}
        seen |= {v for d in pairs[:, 0] for v in ends[d]}
    assert seen >= {float(i) for i in range(7, 400)}
    # the threshold leaves the share of label 1 above it, counted over all labelled rows
    rows = [(i, int(i % 5 == 0), [float(i % 5 == 0) + i / 1000] + [0.0] * (len(ranking.FEATURES) - 1)) for i in range(500)]
    model = ranking._fit_rows(spark.createDataFrame(rows, "key long, q int, x array<double>"), 0.2, options)
    z = lambda i: model.weights[0] * (rows[i][2][0] - model.mean[0]) / model.scale[0]
    assert [i for i in range(500) if z(i) > model.threshold] == list(range(0, 500, 5))
