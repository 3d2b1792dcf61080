"""Quality rules whose cutoffs are certified on labelled rows.

Text measures are column expressions on the row.  The cutoffs form a ladder, fixed in
advance: first every rule at its laxest cutoff, then every rule at the next one, and so on; each
step makes one rule stricter and keeps the others.  A step is accepted when the exact binomial
test on labelled good documents shows that all rules together reject less than the allowed
share of good ones.  The steps are tested in their order and the first that fails ends the
ladder (fixed-sequence testing), so no level is divided among them.

Half of delta is divided among the strata (Bonferroni); the other half is for a certificate on
all labels together.  A stratum whose own labels certify at least one step uses its own; for one
without, the pooled cutoffs hold, whose guarantee is for the strata together.  All certificates
hold together with probability 1 - delta.

Every labelled row may serve as holdout, as nothing is chosen from the labels.  Measures are
written once, the labels are counted with one pre-aggregated grouping by stratum.

Defined results: null text has no words and fails the base rule; a null stratum is the
stratum ''; several labels of one document count as the worst; unlabelled rows are judged
but not counted; without any certificate the base rule alone decides; empty tables give empty
tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import ROW, SPACE_WORD, kept_row, numbered, text_of, without
from termloom.session import materialize, run_scope

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper",
)


@dataclass(frozen=True)
class RuleOptions:
    """Cutoffs of each rule from strict to lax, the allowed false rejection rate of all rules
    together, and the probability with which any certificate may be wrong."""

    cutoffs: tuple[tuple[str, tuple[float, ...]], ...] = (
        ("symbol_ratio", (0.02, 0.05, 0.1, 0.2)),
        ("dup_line_ratio", (0.1, 0.2, 0.3, 0.5)),
        ("repeat_ratio", (0.02, 0.05, 0.1, 0.15)),
        ("upper_ratio", (0.2, 0.35, 0.5, 0.8)),
    )
    false_rejections: float = 0.02
    delta: float = 0.05

    def ladder(self) -> list[dict[str, float | None]]:
        """The cutoffs of all rules after each step (None: the rule rejects nothing yet)."""
        held: dict[str, float | None] = {rule: None for rule, _ in self.cutoffs}
        steps = []
        for level in range(1, max(len(values) for _, values in self.cutoffs) + 1):
            for rule, values in self.cutoffs:
                if level <= len(values):
                    held[rule] = values[-level]
                    steps.append(dict(held))
        return steps


def measures(
    docs: DataFrame, text: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Adds the ``MEASURES`` of each text; the columns to ``carry`` (all) are in ``ROW``."""
    rows = docs.select(kept_row(docs, carry), text_of(text).alias("t"))
    rows = rows.select(
        ROW,
        F.regexp_extract_all("t", F.lit(SPACE_WORD), F.lit(0)).alias("words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("t", r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    keep = [ROW, "word_chars", "n_symbols", "n_upper"]
    # five-word windows by hash: equal windows have equal hashes, so a text whose hashes all
    # differ has no repeated window; the others are compared by their words
    rows = rows.select(
        *keep,
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    keep += ["n_words", "n_lines", "n_dup_lines"]
    first = F.sequence(F.lit(0), F.size("words") - 5)
    enough = F.size("words") >= 5
    hashed = F.transform(first, lambda i: F.xxhash64(*[F.get("h", i + k) for k in range(5)]))
    rows = rows.select(*keep, "words", F.when(enough, hashed).alias("windows"))
    repeated = F.size(F.array_distinct("windows")) < F.size("windows")
    spelled = F.sort_array(
        F.transform(
            first,
            lambda i: F.struct(
                F.concat_ws(" ", *[F.get("words", i + k) for k in range(5)]).alias("w"),
                i.alias("i"),
            ),
        )
    )
    rows = rows.select(*keep, F.when(repeated, spelled).alias("sorted"))

    def twin(k: Column) -> Column:
        here = F.get("sorted", k)
        same = (here["w"] == F.get("sorted", k - 1)["w"]) | (here["w"] == F.get("sorted", k + 1)["w"])
        return F.when(F.coalesce(same, F.lit(False)), here["i"])

    at = F.sort_array(
        F.array_compact(F.transform(F.sequence(F.lit(0), F.size("sorted") - 1), twin))
    )
    rows = rows.select(*keep, F.when(F.col("sorted").isNotNull(), at).alias("at"))
    covered = F.aggregate(
        F.transform(
            "at",
            lambda x, k: F.coalesce(F.least(F.get("at", k + 1) - x, F.lit(5)), F.lit(5)),
        ),
        F.lit(0).cast("long"),
        lambda a, b: a + b,
    )
    return rows.select(*keep, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratio(rule: str) -> Column:
    """The value that a rule compares with its cutoff (at or above: rejected)."""
    over = {
        "symbol_ratio": ("n_symbols", "word_chars"),
        "dup_line_ratio": ("n_dup_lines", "n_lines"),
        "repeat_ratio": ("n_repeat_words", "n_words"),
        "upper_ratio": ("n_upper", "word_chars"),
    }[rule]
    return F.col(over[0]) / F.greatest(F.col(over[1]), F.lit(1))


def log_factorial(n: Column) -> Column:
    """ln n!: summed below 64, by Stirling's series (error below 1e-13) from there."""
    x = n.cast("double")
    small = F.aggregate(
        F.sequence(F.lit(1), F.greatest(n.cast("int"), F.lit(1))),
        F.lit(0.0),
        lambda a, k: a + F.ln(k.cast("double")),
    )
    safe = F.greatest(x, F.lit(1.0))
    series = (
        safe * F.ln(safe) - safe + 0.5 * F.ln(6.283185307179586 * safe)
        + 1 / (12 * safe) - 1 / (360 * F.pow(safe, F.lit(3.0))) + 1 / (1260 * F.pow(safe, F.lit(5.0)))
    )
    return F.when(n < 64, small).otherwise(series)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(X <= k) of Binomial(n, rate) where k < n * rate; 1 where k is not below that mean.

    The largest term is taken in logarithms and the terms below it as a falling product;
    terms more than forty standard deviations down are below the smallest double.
    """
    odds = (1 - rate) / rate
    log_top = (
        log_factorial(n) - log_factorial(k) - log_factorial(n - k)
        + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate))
    )
    steps = F.least(k, F.ceil(40 * F.sqrt(n.cast("double"))) + 100)
    total = F.aggregate(
        F.when(steps > 0, F.sequence(F.lit(0).cast("long"), steps - 1)).otherwise(
            F.array().cast("array<bigint>")
        ),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda acc, i: F.struct(
            (acc["term"] * (k - i) / (n - k + i + 1) * odds).alias("term"),
            (acc["sum"] + acc["term"] * (k - i) / (n - k + i + 1) * odds).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return F.when(k >= n * rate, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), F.exp(log_top) * total)
    )


def broken(cuts: dict[str, Column | float | None]) -> Column:
    """Whether a row is at or above one of the cutoffs."""
    rejected = F.lit(False)
    for rule, cut in cuts.items():
        if cut is not None:
            rejected = rejected | F.coalesce(ratio(rule) >= cut, F.lit(False))
    return rejected


def steps_reached(
    counts: DataFrame, names: list[str], rate: float, level: float
) -> DataFrame:
    """Adds ``step``: how many steps pass one after another.

    ``counts`` has ``n`` and in ``names`` the rejected good rows after each step.
    """
    others = [c for c in counts.columns if c not in names]
    tests = F.transform(
        F.array(*names), lambda k: binomial_tail(k, F.col("n"), rate) <= level
    )
    tested = counts.select(*others, tests.alias("tests"))
    reached = F.aggregate(
        "tests", F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")),
        lambda acc, x: F.struct(
            (acc["on"] & x).alias("on"), (acc["n"] + (acc["on"] & x).cast("int")).alias("n")
        ),
        lambda acc: acc["n"],
    )
    return tested.select(*others, reached.alias("step"))


def cutoffs(
    measured: DataFrame, labels: DataFrame, options: RuleOptions = RuleOptions()
) -> tuple[DataFrame, int]:
    """(stratum, n, step) of every stratum with labels, and the step of the pooled certificate.

    ``step`` counts the accepted steps of the ladder; 0: none.  ``measured`` has ``key``,
    ``stratum`` and the measures; ``labels`` has doc_id, quality.
    """
    marked = (
        labels.select(F.col("doc_id").alias("key"), F.col("quality").alias("q"))
        .where("key is not null and q is not null")
        .groupBy("key")
        .agg(F.min("q").alias("q"))
    )
    ladder = options.ladder()
    names = [f"k{i}" for i in range(len(ladder))]
    good = materialize(
        measured.where(~base_failed())
        .join(marked.where("q = 1"), "key")
        .groupBy("stratum")
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[F.count_if(broken(cuts)).alias(name) for name, cuts in zip(names, ladder)],
        )
    )
    share, rate = options.delta / 2, options.false_rejections
    whole = good.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", *names)])
    pooled = steps_reached(whole, names, rate, share).first()["step"]
    own = steps_reached(good, names, rate, share / max(1, good.count()))
    return own, pooled


def judge(
    docs: DataFrame,
    labels: DataFrame,
    options: RuleOptions = RuleOptions(),
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
    carry: list[str] | None = None,
) -> DataFrame:
    """Every row of ``docs`` as (``ROW``, measures, base_failed, kept).

    ``labels`` has doc_id and quality; ``carry`` names the columns to keep (all), the key and
    the stratum among them.  The measured rows are written once and read for the
    labels and for the verdicts.
    """
    own = F.lit("")
    if stratum in docs.columns:
        own = F.col(ROW).getField(stratum).cast("string")
    measured = materialize(
        measures(docs, text, carry).select(
            "*",
            F.col(ROW).getField(key).alias("key"),
            F.coalesce(own, F.lit("")).alias("stratum"),
        )
    )
    return verdicts(measured, *cutoffs(measured, labels, options), options)


def verdicts(measured: DataFrame, own: DataFrame, pooled: int, options: RuleOptions) -> DataFrame:
    """Adds ``base_failed`` and ``kept`` to measured rows."""
    joined = measured.join(own.drop("n"), "stratum", "left")
    step = F.when(F.col("step") > 0, F.col("step")).otherwise(F.lit(pooled))
    ladder = options.ladder()
    cuts = {
        rule: F.get(F.lit([None, *[s[rule] for s in ladder]]).cast("array<double>"), F.col("_step"))
        for rule, _ in options.cutoffs
    }
    return (
        joined.withColumn("_step", step)
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & ~broken(cuts))
        .drop("_step")
    )


def accepted(
    docs: DataFrame,
    labels: DataFrame,
    options: RuleOptions = RuleOptions(),
    key: str = "doc_id",
    text: str = "text",
    stratum: str = "lang",
) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    Rows are told apart by a number of their own; only the numbers of rejected rows are kept.
    """
    marked = numbered(docs)
    columns = [c for c in (key, text, stratum) if c in docs.columns]
    slim = marked.select("row", *[F.col(ROW)[c].alias(c) for c in columns])
    with run_scope(docs.sparkSession):
        judged = judge(
            slim, labels, options, key, text, stratum, carry=["row", *[c for c in columns if c != text]]
        )
        gone = materialize(judged.where(~F.col("kept")).select(F.col(ROW)["row"].alias("row")), keep=True)
    return without(marked, gone, docs.columns)
