"""The registered queries: each runs over the whole of the tables it reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import text as tx
from termloom.operators import annotate as an
from termloom.operators import calibrate as cb
from termloom.operators import dictionary as dc
from termloom.operators import evaluate as ev
from termloom.operators import fusion as fu
from termloom.operators import kernel as kn
from termloom.operators import landmarks as lm
from termloom.operators import linear
from termloom.operators import split as sp
from termloom.operators import svm
from termloom.operators import vectors as vc
from termloom.plans import jobs
from termloom.plans import pipeline as pl
from termloom.session import materialize, scratch_path, spread
from termloom.sources import dictionary as sd
from termloom.sources import documents as ds
from termloom.sources import scores as sc
from termloom.sources import vectors as vs

TOP_TERMS = 1000
TRAIN_FRACTION = 0.775
TRAIN_ROWS = 500
LINE_INDICES = 10_000
LINEAR_PASSES = 8
LANDMARKS = 16
MALFORMED = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- inputs ----------------------------------------------------------------


def labelled_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their quality label where there is one."""
    documents = spread(
        table(spark, sf_dir, "documents").select("doc_id", "source", "text"), "doc_id"
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return documents.join(labels, "doc_id", "left")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents clustered by source and class, so that a cluster has one label."""
    prefix = F.when(F.col("quality") == 1, "p").when(F.col("quality") == 0, "n").otherwise("u")
    return ds.as_documents(
        labelled_table(spark, sf_dir),
        text="text",
        cluster_id=F.concat(prefix, F.col("source")),
        label=F.col("quality"),
        doc_id="doc_id",
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without cluster and label."""
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return documents.select("doc_id", tx.featured_text("text").alias("extracted_text"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as documents, conversations as clusters."""
    turns = spread(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"),
        "conv_id",
        "turn",
    )
    return ds.as_documents(turns, text="text", cluster_id="conv_id", doc_id="turn")


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").cast("string").alias("cluster_id"),
        F.col("quality").alias("class"),
    )


def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score for every document, from its length."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("cluster_id"),
        (F.col("n_chars") % 1000 / 1000.0).alias("score"),
        "lang",
    )


def image_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two score records for every labelled document, numbered in order."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return labels.select(
        F.col("doc_id").cast("string").alias("cluster_id"),
        F.inline(
            F.array(
                F.struct(
                    (F.col("doc_id") * 2).alias("line_no"),
                    (F.col("toxic") / 2.0).cast("double").alias("score"),
                ),
                F.struct(
                    (F.col("doc_id") * 2 + 1).alias("line_no"),
                    (F.col("doc_id") * 37 % 101 / 100.0).alias("score"),
                ),
            )
        ),
    )


def image_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fu.dedup_last(image_records(spark, sf_dir), "line_no")


def labelled_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = text_scores(spark, sf_dir).select("cluster_id", "score")
    return truth(spark, sf_dir).join(scores, "cluster_id")


def predicted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_scores(spark, sf_dir).select(
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("class").alias("actual"),
    )


def all_predicted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted label; most have no actual one."""
    scores = text_scores(spark, sf_dir).select("cluster_id", "score")
    return scores.join(truth(spark, sf_dir), "cluster_id", "left").select(
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.col("class").alias("actual"),
    )


# ---- text and dictionary ---------------------------------------------------


def load_documents(spark, sf_dir):
    return corpus(spark, sf_dir)


def label_and_prefix(spark, sf_dir):
    labelled = labelled_table(spark, sf_dir).where("quality in (0, 1)")
    prefix = F.when(F.col("quality") == 1, "p").otherwise("n")
    return ds.as_documents(
        labelled, "text", F.concat(prefix, "source"), label=F.col("quality"), doc_id="doc_id"
    )


def tokenize(spark, sf_dir):
    tokens = an.token_table(an.annotate(texts(spark, sf_dir)))
    return tokens.select("doc_id", "sent_id", "pos", "token", "lemma", "pos_tag")


def token_counts(spark, sf_dir):
    words = an.document_terms(an.annotate(texts(spark, sf_dir)), ngrams=None)
    return dc.term_counts(words)


def vocabulary(spark, sf_dir):
    return dc.vocabulary(pl.corpus_terms(texts(spark, sf_dir)))


def document_frequency(spark, sf_dir):
    return dc.document_frequency(an.term_bags(pl.corpus_terms(texts(spark, sf_dir))))


def generalize_entities(spark, sf_dir):
    annotated = an.annotate(texts(spark, sf_dir), ner_rule=tx.rule_number_ner)
    tokens = an.token_table(an.generalize_entities(annotated))
    return tokens.select("doc_id", "sent_id", "pos", "token", "lemma", "pos_tag")


def phrases(spark, sf_dir):
    return an.phrase_table(an.annotate(texts(spark, sf_dir)))


def phrase_ngrams(spark, sf_dir):
    grams = an.document_terms(an.annotate(texts(spark, sf_dir)), unigrams=False)
    return dc.term_counts(grams)


def phrase_ngrams_contiguous(spark, sf_dir):
    grams = an.document_terms(
        an.annotate(texts(spark, sf_dir)),
        ngrams="contiguous",
        flush_tail=True,
        unigrams=False,
    )
    return dc.term_counts(grams)


def dictionary(spark, sf_dir):
    return dc.build_dictionary(dc.term_counts(pl.corpus_terms(texts(spark, sf_dir))))


def dictionary_by_documents(spark, sf_dir):
    """The dictionary in the order of document frequencies."""
    bags = an.term_bags(pl.corpus_terms(texts(spark, sf_dir)))
    return dc.build_dictionary(dc.document_frequency(bags).withColumnRenamed("n_docs", "n"))


def dictionary_roundtrip(spark, sf_dir):
    """The dictionary written as text, one term per line, and read again."""
    path = scratch_path(spark)
    sd.write_dictionary_text(dictionary(spark, sf_dir), path)
    return sd.read_dictionary_text(spark, path)


def dictionary_topk(spark, sf_dir):
    return dc.top_k(dc.term_counts(pl.corpus_terms(texts(spark, sf_dir))), TOP_TERMS)


def term_count_lines(spark, sf_dir):
    return dc.term_count_lines(dc.term_counts(pl.corpus_terms(texts(spark, sf_dir))))


# ---- vectors ---------------------------------------------------------------


def _bags_and_dictionary(spark, sf_dir):
    bags = pl.corpus_bags(corpus(spark, sf_dir))
    return bags, pl.build_dictionary(bags)


def _cluster_vectors(spark, sf_dir, merge):
    bags, words = _bags_and_dictionary(spark, sf_dir)
    return vc.cluster_vectors(*pl.vectorize(bags, words, merge, complete=True))


def doc_term_vectors(spark, sf_dir):
    bags, words = _bags_and_dictionary(spark, sf_dir)
    return vc.doc_term_vectors(bags, words, "doc_id", unique=True, complete=True)


def cluster_vectors(spark, sf_dir):
    return _cluster_vectors(spark, sf_dir, "max")


def cluster_vectors_sum(spark, sf_dir):
    return _cluster_vectors(spark, sf_dir, "sum")


def cluster_vectors_avg(spark, sf_dir):
    vectors = _cluster_vectors(spark, sf_dir, "avg")
    return vectors.withColumn("value", F.round("value", 9))


def conversation_vectors(spark, sf_dir):
    bags = pl.corpus_bags(conversations(spark, sf_dir))
    return vc.cluster_vectors(*pl.vectorize(bags, pl.build_dictionary(bags), complete=True))


def explain_vector(spark, sf_dir):
    bags, words = _bags_and_dictionary(spark, sf_dir)
    entries = vc.cluster_entries(bags, words, unique=True, complete=True)
    return vc.explain_vector(entries, words).select("cluster_id", "idx", "term", "value")


def foreign_vectors(spark, sf_dir):
    """Turns of conversations, each a cluster, against the dictionary of the labelled documents."""
    words = pl.build_dictionary(
        pl.corpus_bags(corpus(spark, sf_dir).where(F.col("label").isNotNull()))
    )
    turns = conversations(spark, sf_dir).withColumn(
        "cluster_id", F.concat_ws("-", "cluster_id", "turn")
    )
    return vc.cluster_vectors(*pl.vectorize(pl.corpus_bags(turns), words))


def dictionary_reverse(spark, sf_dir):
    """Index of every source name in the order of the documents: the last line counts."""
    lines = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("idx"), F.col("source").alias("term")
    )
    return dc.reverse_dictionary(lines)


def cluster_sizes(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id")
    documents = turns.select(
        F.col("conv_id").cast("string").alias("cluster_id"),
        F.lit(None).cast("int").alias("label"),
    )
    return vc.clusters(documents).select("cluster_id", "n_docs")


def label_conflicts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    return vc.label_conflicts(
        documents.join(labels, "doc_id").select(
            F.col("source").alias("cluster_id"), F.col("quality").alias("label")
        )
    )


def _assembled(spark, sf_dir):
    """Cluster vectors in rows of so many indices at most."""
    bags, words = _bags_and_dictionary(spark, sf_dir)
    return vc.assemble(*pl.vectorize(bags, words, complete=True), LINE_INDICES)


def svmlite_lines(spark, sf_dir):
    """One line for each cluster, with its whole vector."""
    bags, words = _bags_and_dictionary(spark, sf_dir)
    return vs.whole_lines(*pl.vectorize(bags, words, complete=True), LINE_INDICES)


def svmlite_parse(spark, sf_dir):
    lines = materialize(vs.svmlite_lines(_assembled(spark, sf_dir)))
    parsed = vs.parse_svmlite(lines, "line")
    return parsed.select("cluster_id", "first", F.inline_outer("entries"))


def vectors_roundtrip(spark, sf_dir):
    """Vector lines and ids written in order, numbered and put together again."""
    path = scratch_path(spark)
    vs.write_svmlite(materialize(_assembled(spark, sf_dir)), path)
    return vs.read_svmlite_entries(spark, path)


def max_feature_index(spark, sf_dir):
    bags, words = _bags_and_dictionary(spark, sf_dir)
    largest = vc.max_feature_index(vc.cluster_entries(bags, words, unique=True, complete=True))
    return largest.withColumn("gamma", F.round("gamma", 12))


def class_distribution(spark, sf_dir):
    documents = labelled_table(spark, sf_dir).select("quality")
    return vc.class_distribution(documents, "quality")


def train_test_split(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return sp.mark_by_fraction(rows, "doc_id", TRAIN_FRACTION)


def train_test_split_exact(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return sp.mark_by_count(rows, "doc_id", TRAIN_ROWS)


# ---- files -----------------------------------------------------------------


def _write_documents(documents: DataFrame, path: str) -> None:
    named = documents.select(
        F.col("doc_id").cast("string").alias("doc_id"), "extracted_text",
        F.col("label").alias("class"), "cluster_id",
    )
    sc.write_json_lines(named, path)


def documents_roundtrip(spark, sf_dir):
    """The corpus as JSON lines in two folders, with and without a class, read as one."""
    documents, paths = corpus(spark, sf_dir), [scratch_path(spark), scratch_path(spark)]
    _write_documents(documents.where("label is not null"), paths[0])
    _write_documents(documents.where("label is null"), paths[1])
    return ds.read_documents(spark, paths)


def classes_roundtrip(spark, sf_dir):
    """Both classes' corpora added to one table, each of them twice."""
    path = scratch_path(spark)
    labelled = labelled_table(spark, sf_dir).where("quality in (0, 1)")
    for _ in range(2):
        for label, prefix in ((1, "p"), (0, "n")):
            own = ds.as_documents(
                labelled.where(F.col("quality") == label), "text", F.col("source"), doc_id="doc_id"
            )
            ds.write_class(own, path, label, prefix)
    return ds.read_classes(spark, path).select("doc_id", "cluster_id", "label", "extracted_text")


def malformed_documents(spark, sf_dir):
    """Every tenth document's line is cut off; the rest, with the number set aside."""
    path = scratch_path(spark)
    named = corpus(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("doc_id"), "extracted_text",
        F.col("label").alias("class"), "cluster_id",
    )
    line = F.to_json(F.struct(*named.columns))
    cut = F.col("doc_id").cast("long") % MALFORMED == 0
    named.select(F.when(cut, F.regexp_replace(line, "}$", "")).otherwise(line)).write.text(path)
    documents, n = ds.read_or_set_aside(
        spark, path, scratch_path(spark), most_malformed=spark.read.text(path).count()
    )
    return documents.withColumn("n_malformed", F.lit(n).cast("bigint"))


def job_counters(spark, sf_dir):
    """Terms and vectors that the jobs have written, by their own count, and vectors read."""
    source, words, vectors, lines = (scratch_path(spark) for _ in range(4))
    _write_documents(corpus(spark, sf_dir), source)
    n_terms = jobs.build_dict(spark, source, words)
    n_vectors = jobs.vectorize(spark, source, words, vectors, text=lines)
    read = jobs.read_text_vectors(spark, lines).agg(F.count(F.lit(1)).alias("n_lines"))
    return read.select(
        F.lit(n_terms).cast("bigint").alias("n_terms"),
        F.lit(n_vectors).cast("bigint").alias("n_vectors"), "n_lines",
    )


def predictions_roundtrip(spark, sf_dir):
    """Predictions as CSV, converted to score records, read with the records of the truth."""
    csv, scores, labels = (scratch_path(spark) for _ in range(3))
    sc.write_predictions(_predictions(spark, sf_dir), csv)
    sc.write_json_lines(sc.submission_scores(sc.read_predictions(spark, csv)), scores)
    sc.write_json_lines(truth(spark, sf_dir), labels)
    return sc.read_scores(spark, scores).join(sc.read_truth(spark, labels), "cluster_id", "left")


def fused_records(spark, sf_dir):
    """Records of mixed fields fused with the image records; all their other fields stay."""
    first, second, fused = (scratch_path(spark) for _ in range(3))
    odd = F.col("doc_id") % 2 == 1
    text = lambda c: F.to_json(F.struct(F.col(c).alias("x")))
    table(spark, sf_dir, "documents").select(
        F.format_string(
            '{"cluster_id":"%d","score":%s,"big":1234567890123456789%d,"mixed":%s,"more":{"n":[%d,null,"x"],"source":%s}%s}',
            F.col("doc_id"), (F.col("n_chars") % 1000 / 1000.0).cast("string"), F.col("doc_id") % 10,
            F.when(odd, F.lit('"seven"')).otherwise(F.lit("7")), F.col("n_chars"),
            F.regexp_extract(text("source"), r'^\{"x":(.*)\}$', 1),
            F.when(odd, F.lit(',"none":null')).otherwise(F.lit("")),
        )
    ).write.text(first)
    records = image_records(spark, sf_dir).orderBy("line_no").select("cluster_id", "score")
    sc.write_json_lines(records, second)
    jobs.fuse(spark, first, second, fused)
    line = spark.read.text(fused).select(F.parse_json("value").alias("v"))
    get = lambda path, kind="string": F.variant_get("v", path, kind)
    return line.select(
        get("$.cluster_id").alias("cluster_id"), F.round(get("$.score", "double"), 9).alias("score"),
        get("$.big").alias("big"), get("$.mixed").alias("mixed"),
        F.schema_of_variant(F.variant_get("v", "$.mixed", "variant")).startswith("STRING").alias("is_text"),
        get("$.more.n[0]", "bigint").alias("n"), get("$.more.source").alias("source"),
        F.variant_get("v", "$.none", "variant").isNotNull().alias("has_none"),
    )


# ---- fusion and evaluation -------------------------------------------------


def score_fusion(spark, sf_dir):
    fused = fu.fuse(text_scores(spark, sf_dir), image_scores(spark, sf_dir))
    return fused.withColumn("score", F.round("score", 9))


def fusion_agreement(spark, sf_dir):
    return fu.agreement(text_scores(spark, sf_dir), image_scores(spark, sf_dir))


def dedup_last(spark, sf_dir):
    return image_scores(spark, sf_dir)


def _predictions(spark, sf_dir):
    return text_scores(spark, sf_dir).select(
        F.col("cluster_id").alias("VectorId"),
        (F.col("score") >= 0.5).cast("int").alias("TopClass"),
        (1.0 - F.col("score")).alias("0"),
        F.col("score").alias("1"),
    )


def submission_scores(spark, sf_dir):
    return sc.submission_scores(_predictions(spark, sf_dir))


def alignment_check(spark, sf_dir):
    """Labels against the scores of all documents and of the doubled image records."""
    against_text = ev.alignment(truth(spark, sf_dir), text_scores(spark, sf_dir))
    against_image = ev.alignment(truth(spark, sf_dir), image_records(spark, sf_dir))
    return against_text.withColumn("submission", F.lit("text")).unionByName(
        against_image.withColumn("submission", F.lit("image"))
    )


def confusion_matrix(spark, sf_dir):
    return ev.confusion_matrix(all_predicted_labels(spark, sf_dir), labels=(0, 1))


def confusion_counts(spark, sf_dir):
    return ev.confusion_counts(predicted_labels(spark, sf_dir))


def error_rate(spark, sf_dir):
    rate = ev.error_rate(all_predicted_labels(spark, sf_dir))
    return rate.withColumn("error_percent", F.round("error_percent", 9))


def roc_curve(spark, sf_dir):
    points = ev.roc_curve(labelled_scores(spark, sf_dir))
    return points.select(
        "threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr")
    )


def roc_auc(spark, sf_dir):
    area = ev.roc_auc(labelled_scores(spark, sf_dir))
    return area.withColumn("auc", F.round("auc", 9))


# ---- model -----------------------------------------------------------------


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as vectors of two classes: the lower and the upper labels."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("cluster_id"),
        (F.col("label") < 5).cast("int").alias("label"),
        svm.dense_entries("embedding").alias("entries"),
    )


def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a cluster of its own, labelled or not."""
    documents = ds.as_documents(
        labelled_table(spark, sf_dir),
        text="text",
        cluster_id="doc_id",
        label=F.col("quality"),
    )
    bags = pl.corpus_bags(documents)
    return pl.model_vectors(bags, pl.build_dictionary(bags), complete=True)


def rbf_decision(spark, sf_dir):
    """Exact decision values with every embedding as a support vector."""
    embeddings = table(spark, sf_dir, "embeddings")
    entries = embeddings.select(F.inline(svm.dense_entries("embedding")))
    gamma = vc.max_feature_index(entries).first()["gamma"]
    features = F.col("embedding").cast("array<double>").alias("features")
    support = embeddings.select(
        features, F.when(F.col("label") < 5, 1.0).otherwise(-1.0).alias("coef")
    )
    rows = embeddings.select(F.col("vec_id").alias("id"), features)
    decided = kn.rbf_decision(rows, support, gamma, rho=0.5)
    return decided.withColumn("decision", F.round("decision", 6))


def platt_fit(spark, sf_dir):
    """Probability of every document from a curve fitted to the scores of the labelled ones."""
    margin = (F.col("score") * 2.0 - 1.0).alias("margin")
    curve = cb.fit_sigmoid(
        labelled_scores(spark, sf_dir).select(F.col("class").alias("label"), margin)
    )
    scores = text_scores(spark, sf_dir).select("cluster_id", margin)
    return scores.select("cluster_id", F.round(curve.probability(F.col("margin")), 6).alias("p1"))


def linear_weights(spark, sf_dir):
    """Weights of the embeddings' dimensions after a fixed number of passes."""
    rows = embedding_vectors(spark, sf_dir).select(
        F.col("cluster_id").alias("row"), (2 * F.col("label") - 1).alias("y"), "entries"
    )
    weights, _ = linear.fit_weights(
        linear.with_offset(rows, ["row", "y"]), [linear.Fit(F.lit(True), rows.count())],
        passes=LINEAR_PASSES, tolerance=0.0,
    )
    return weights.select("idx", F.round("w0", 6).alias("weight"))


def landmarks(spark, sf_dir):
    """Landmarks of the embeddings with the distance to those chosen before."""
    chosen = lm.landmark_table(embedding_vectors(spark, sf_dir), LANDMARKS)
    return chosen.withColumn("distance2", F.round("distance2", 6))


def model_contracts(spark, sf_dir):
    """What holds for every row under every kind of model, saved and loaded again."""
    vectors = embedding_vectors(spark, sf_dir)
    parts = []
    for kernel in ("linear", "rbf", "landmarks"):
        path = scratch_path(spark)
        model = svm.fit(vectors, svm.SvmOptions(kernel=kernel, components=128, landmarks=64))
        svm.save(model, path)
        again = svm.load(spark, path)
        before = svm.score(vectors, model).select("cluster_id", F.col("decision").alias("_before"))
        rows = (
            svm.score(vectors, again).join(before, "cluster_id")
            .join(svm.predict(vectors, again).withColumnRenamed("VectorId", "cluster_id"), "cluster_id")
        )
        parts.append(
            rows.select(
                "cluster_id", "label", F.lit(kernel).alias("kernel"),
                (F.abs(F.col("decision") - F.col("_before")) < 1e-9).alias("same_after_load"),
                ((F.col("decision") > 0) == (F.col("predicted") == 1)).alias("sign_decides"),
                ((F.col("1") >= 0.5) == (F.col("TopClass") == 1)).alias("half_decides"),
                (F.abs(F.col("0") + F.col("1") - 1.0) < 1e-12).alias("sums_to_one"),
                F.col("1").between(0.0, 1.0).alias("is_probability"),
            )
        )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def train_svm(spark, sf_dir):
    """RBF model of the embeddings: class and decision value of each."""
    vectors = embedding_vectors(spark, sf_dir)
    scored = svm.score(vectors, svm.fit(vectors))
    return scored.select("cluster_id", "label", "predicted", "decision")


def platt_calibrate(spark, sf_dir):
    """Linear model of the embeddings: calibrated probability of each."""
    vectors = embedding_vectors(spark, sf_dir)
    scored = svm.score(vectors, svm.fit(vectors, svm.SvmOptions(kernel="linear")))
    return scored.select("cluster_id", "decision", "p1")


def predict_svm(spark, sf_dir):
    """Train on the labelled documents, predict the class of all others."""
    vectors = document_vectors(spark, sf_dir)
    model = svm.fit(vectors)
    return svm.predict(vectors.where(F.col("label").isNull()), model)


def evaluate_svm(spark, sf_dir):
    """Train on a part of the labelled documents, confusion matrix of the rest."""
    labelled = document_vectors(spark, sf_dir).where(F.col("label").isNotNull())
    train, test = sp.train_test_split(labelled, "cluster_id", TRAIN_FRACTION)
    return pl.evaluate(svm.fit(train), test).confusion


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        load_documents, label_and_prefix, tokenize, token_counts, vocabulary,
        document_frequency, generalize_entities, phrases, phrase_ngrams,
        phrase_ngrams_contiguous, dictionary, dictionary_topk, term_count_lines,
        doc_term_vectors, cluster_vectors, cluster_vectors_sum, cluster_vectors_avg,
        conversation_vectors, explain_vector, cluster_sizes, label_conflicts,
        svmlite_lines, svmlite_parse, max_feature_index, class_distribution,
        train_test_split, train_test_split_exact, score_fusion, fusion_agreement,
        foreign_vectors, dictionary_reverse, dictionary_by_documents, dictionary_roundtrip,
        vectors_roundtrip, documents_roundtrip, classes_roundtrip, malformed_documents,
        job_counters, predictions_roundtrip, fused_records, platt_fit, linear_weights, landmarks,
        model_contracts,
        dedup_last, submission_scores, alignment_check, confusion_matrix,
        confusion_counts, error_rate, roc_curve, roc_auc, rbf_decision, train_svm,
        platt_calibrate, predict_svm, evaluate_svm,
    )
}
