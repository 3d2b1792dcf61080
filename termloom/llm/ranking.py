"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

A pair says that one document (label 1) is preferred to another (label 0).  The worth of
a document is linear in text features, and P(a over b) = sigmoid(w . (x_a - x_b)); w is
fitted by the logistic loss on feature differences, with a ridge term.  The worth is then
cut at a quantile: the threshold leaves above it, among the labelled documents, the share
that has label 1, and the score is a logistic curve that reaches ``cut`` there.

Features come from the text alone and are column expressions in the row, so scoring is a
scan.  The fit uses every labelled row: the rows are dealt into groups of bounded size by a hash
of their key, each row is in some pairs with rows of the other class of its group, and a pass of
Newton's method adds up a gradient and a matrix of fixed size over the groups.  Mean, spread and
threshold are those of all labelled rows.

Defined results: null text is the empty text and gets a score; labels that are null are
ignored and of several labels of a document the least counts; without rows of both labels
every score is the prior share; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ROW, kept_row, named, text_of
from termloom.operators.ordering import with_dense_index
from termloom.session import discard, materialize

FEATURES = (
    "log_words", "log_chars", "mean_word", "space_share", "symbol_share", "bang_share",
    "digit_share", "upper_share", "punct_share", "line_share", "short_lines", "distinct_words",
    "distinct_lines", "repeat_pairs", "common_words", "symbol_end", "pipe_share", "sentence_len",
)
# Frequent function words of the four languages of the corpus.
FUNCTION_WORDS = (
    "the of and to in a is that for it was on are as with at this from or an have not be by "
    "de la le les et des du un une que en el los las se por con para no es su al lo "
    "der die das und ist den von zu mit sich auf dem nicht ein eine als im au qui dans est"
).split()


@dataclass(frozen=True)
class RankOptions:
    pairs_per_row: int = 10
    least_pairs: int = 200_000
    group_rows: int = 2_000
    ridge: float = 1e-3
    cut: float = 0.7
    seed: int = 7


@dataclass(frozen=True)
class RankModel:
    """Weights on standardised features, the threshold of the worth and the curve's slope."""

    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    threshold: float
    slope: float
    cut: float


def features(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(``ROW``, the ``FEATURES``) of every row."""
    rows = docs.select(kept_row(docs, carry), text_of(text).alias("t"))

    def left(pattern: str) -> Column:
        """Characters that are left when all others are taken out."""
        return F.length(F.regexp_replace("t", pattern, "")).cast("double")

    rows = rows.select(
        ROW,
        F.length("t").cast("double").alias("c"),
        left(r"[\x20\x09-\x0D]+").alias("ink"),
        left(r"[^#*$%&|<>]+").alias("symbols"),
        left(r"[^!]+").alias("bangs"),
        left(r"[^0-9]+").alias("digits"),
        left(r"[^A-Z]+").alias("upper"),
        left(r"[^.,;:?]+").alias("punct"),
        left(r"[^|]+").alias("pipes"),
        left(r"[^.?]+").alias("stops"),
        F.filter(F.split("t", "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n", -1), lambda x: x != "").alias("lines"),
    )
    known = F.array(*[F.lit(w) for w in FUNCTION_WORDS])
    hashed = F.transform("words", lambda w: F.xxhash64(w))
    rows = rows.select(
        ROW, "c", "ink", "symbols", "bangs", "digits", "upper", "punct", "pipes", "stops",
        hashed.alias("h"),
        F.size("words").cast("double").alias("n"),
        F.size("lines").cast("double").alias("m"),
        F.size(F.array_distinct("lines")).cast("double").alias("dm"),
        F.size(F.filter("lines", lambda x: F.length(x) < 40)).cast("double").alias("short"),
        F.transform(known, lambda w: F.xxhash64(w)).alias("known"),
        F.size(F.filter("words", lambda w: F.instr(F.lit("#*$%&|<>!"), F.right(w, F.lit(1))) > 0))
        .cast("double").alias("ends"),
    )
    rows = rows.select(
        "*",
        F.size(F.array_distinct("h")).cast("double").alias("d"),
        F.size(F.filter("h", lambda x: F.array_contains("known", x))).cast("double").alias("f"),
        F.size(F.filter("h", lambda x, i: x == F.get("h", i - 1))).cast("double").alias("same"),
    )
    n, c, ink, m = (F.greatest(F.col(x), F.lit(1.0)) for x in ("n", "c", "ink", "m"))
    value = {
        "log_words": F.log1p("n"), "log_chars": F.log1p("c"), "mean_word": F.least(F.col("ink") / n, F.lit(30.0)),
        "space_share": (F.col("c") - F.col("ink")) / c, "symbol_share": F.col("symbols") / ink,
        "bang_share": F.col("bangs") / ink, "digit_share": F.col("digits") / ink,
        "upper_share": F.col("upper") / ink, "punct_share": F.col("punct") / ink,
        "line_share": F.col("m") / n, "short_lines": F.col("short") / m,
        "distinct_words": F.col("d") / F.pow(n, F.lit(0.8)), "distinct_lines": F.col("dm") / m,
        "repeat_pairs": F.col("same") / n, "common_words": F.col("f") / n,
        "symbol_end": F.col("ends") / n, "pipe_share": F.col("pipes") / n,
        "sentence_len": F.log1p(F.col("n") / F.greatest(F.col("stops"), F.lit(1.0))),
    }
    return rows.select(ROW, *[value[name].alias(name) for name in FEATURES])


#: Rows of the rarer class that a group has, on average, at least; some are copied for it.
PARTNERS = 50
#: A table of labels is broadcast up to so many rows; beyond, features meet it in a shuffle.
BROADCAST_LABELS = 1_000_000


def pairs_of(good: np.ndarray, bad: np.ndarray, per_row: int, seed: list[int]) -> np.ndarray:
    """Differences of the features of good and bad rows; every row of the group is in a pair."""
    if not len(good) or not len(bad):
        return np.zeros((0, len(FEATURES)))
    rng = np.random.default_rng(seed)
    large, small = max(len(good), len(bad)), min(len(good), len(bad))
    times = min(per_row, small)
    one = np.tile(np.arange(large), times)
    # partners follow each other in a shuffled order, so each has nearly the same number
    other = rng.permutation(small)[(one + np.repeat(np.arange(times), large)) % small]
    return good[one] - bad[other] if len(good) == large else good[other] - bad[one]


def _groups(picked: DataFrame, sizes: dict[int, int], options: RankOptions) -> DataFrame:
    """(grp, good, bad): the features of the rows of each group by class."""
    n = max(1, -(-sum(sizes.values()) // options.group_rows))
    copies = {q: min(n, -(-PARTNERS * n // size)) for q, size in sizes.items()}
    times = F.when(F.col("q") == 1, copies[1]).otherwise(copies[0])
    place = F.xxhash64("key", "x")
    dealt = picked.select(
        "q", "x", place.alias("place"),
        F.explode(F.sequence(F.lit(0), times - 1)).alias("copy"), times.alias("times"),
    ).withColumn(
        "grp",
        F.pmod(F.pmod("place", F.lit(n)) + F.floor(F.col("copy") * n / F.col("times")), F.lit(n)),
    )
    rows = lambda q: F.transform(
        F.sort_array(F.collect_list(F.when(F.col("q") == q, F.struct("place", "x")))), lambda r: r["x"]
    )
    return dealt.groupBy("grp").agg(rows(1).alias("good"), rows(0).alias("bad"))


def fit_weights(
    groups: DataFrame, mean: np.ndarray, scale: np.ndarray, options: RankOptions, n: int
) -> np.ndarray:
    """Newton's method on the mean logistic loss of feature differences, one job a pass.

    ``n`` is the number of rows; few rows are paired more often.
    """
    width = len(FEATURES)
    per_row = max(options.pairs_per_row, -(-options.least_pairs // n))

    def standard(rows: pa.Scalar) -> np.ndarray:
        x = rows.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        return np.clip((x - mean) / scale, -8, 8)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(1 + width + width * width)
            for batch in batches:
                good, bad = batch.column("good"), batch.column("bad")
                for i, group in enumerate(batch.column("grp").to_pylist()):
                    x = pairs_of(standard(good[i]), standard(bad[i]), per_row, [options.seed, group])
                    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                    matrix = (x * (p * (1 - p))[:, None]).T @ x
                    total += np.concatenate([[len(x)], x.T @ (1 - p), matrix.ravel()])
            yield pa.record_batch({"part": pa.array([total.tolist()], pa.list_(pa.float64()))})

        # one short row from each task
        parts = groups.mapInArrow(run, "part array<double>").collect()
        return np.sum(np.sort([r["part"] for r in parts], axis=0), axis=0)

    w = np.zeros(width)
    ridge = options.ridge * np.eye(width)
    for _ in range(30):
        total = sums(w)
        size, slope, matrix = total[0], total[1:1 + width], total[1 + width:].reshape(width, width)
        step = np.linalg.solve(matrix / size + ridge, slope / size - options.ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(
    docs: DataFrame, labels: DataFrame, options: RankOptions = RankOptions(),
    key: str = "doc_id", text: str = "text",
) -> RankModel:
    """Learns from the rows of ``labels`` (doc_id, quality), all of them."""
    marked = (
        labels.select(F.col("doc_id").alias("key"), F.col("quality").cast("int").alias("q"))
        .where("key is not null and q in (0, 1)")
        .groupBy("key").agg(F.min("q").alias("q"))
    )
    known = {r["q"]: r["n"] for r in marked.groupBy("q").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(known.values())
    share = known.get(1, 0) / total if total else options.cut
    slim = docs.select(named(key).alias("key"), named(text).alias("text"))
    # no text is shuffled: few labels go to the texts, many labels meet the features
    vector = F.array(*FEATURES).alias("x")
    if total <= BROADCAST_LABELS:
        marked_texts = slim.join(F.broadcast(marked), "key").select("key", "q", "text")
        found = features(marked_texts, "text", ["key", "q"])
        found = found.select(F.col(ROW)["key"].alias("key"), F.col(ROW)["q"].alias("q"), vector)
    else:
        found = features(slim, "text", ["key"]).select(F.col(ROW)["key"].alias("key"), vector)
        found = found.join(marked, "key").select("key", "q", "x")
    picked = materialize(found)
    try:
        return _fit_rows(picked, share, options)
    finally:
        discard(picked)


def _fit_rows(picked: DataFrame, share: float, options: RankOptions) -> RankModel:
    columns = [F.get("x", F.lit(i)) for i in range(len(FEATURES))]
    moments = picked.groupBy("q").agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)],
    ).collect()
    sizes = {r["q"]: r["n"] for r in moments}
    blank = tuple(np.zeros(len(FEATURES)))
    if len(sizes) < 2:
        flat = float(np.clip(share, 0.0, 1.0))
        return RankModel(blank, tuple(np.ones(len(FEATURES))), blank, 0.0, 1.0, flat)
    n = sum(sizes.values())
    means = {r["q"]: np.array([r[f"m{i}"] for i in range(len(FEATURES))]) for r in moments}
    spreads = {r["q"]: np.array([r[f"v{i}"] for i in range(len(FEATURES))]) for r in moments}
    mean = sum(sizes[q] * means[q] for q in (0, 1)) / n
    scale = np.sqrt(sum(sizes[q] * (spreads[q] + (means[q] - mean) ** 2) for q in (0, 1)) / n)
    scale[scale < 1e-9] = 1.0
    groups = materialize(_groups(picked, sizes, options))
    w = fit_weights(groups, mean, scale, options, n)
    discard(groups)
    model = RankModel(tuple(mean), tuple(scale), tuple(w), 0.0, 1.0, options.cut)
    named_features = picked.select(*[c.alias(name) for c, name in zip(columns, FEATURES)])
    worths = named_features.select(worth(model).alias("worth"))
    placed = with_dense_index(worths, F.asc("worth"))
    # the threshold leaves as many labelled rows above it as have label 1
    i = sizes[0] - 1
    around = [r["worth"] for r in placed.where(F.col("idx").isin(i, i + 1)).collect()]
    spread = placed.agg(F.stddev_pop("worth")).first()[0]
    slope = float(1 / max(1.0, spread / 4))
    return replace(model, threshold=float(sum(around) / 2), slope=slope)


def worth(model: RankModel) -> Column:
    total = F.lit(0.0)
    for name, mean, scale, weight in zip(FEATURES, model.mean, model.scale, model.weights):
        z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(name) - float(mean)) / float(scale)))
        total = total + z * float(weight)
    return total


def score(docs: DataFrame, model: RankModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(``ROW``, score): the score is at least ``model.cut`` from the threshold on."""
    base = float(np.log(max(model.cut, 1e-9) / max(1 - model.cut, 1e-9)))
    above = (worth(model) - model.threshold) * model.slope + base
    return features(docs, text, carry).select(ROW, (1 / (1 + F.exp(-above))).alias("score"))
