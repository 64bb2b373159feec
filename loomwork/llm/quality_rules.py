"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Each rule rejects a text whose feature exceeds a cutoff. Cutoffs come from a labelled holdout:
within a stratum, for each rule, the candidates of a fixed grid are tested from the most lenient
to the strictest. A candidate passes if, were the rule's true rate of rejecting good documents
alpha_rule, so few false rejections among the holdout's good documents would have a probability of
at most delta_rule (exact binomial tail, the inverse of a Clopper-Pearson bound). The order is
fixed, so testing stops at the first failure without a further correction (fixed-sequence
testing); alpha and delta are divided by the number of rules, and delta also by the number of
strata (Bonferroni). So with probability 1 - delta no stratum loses more than a share alpha of its
good documents to the rules. A stratum with too few labels to prove anything gets no cutoff.

Defined cases: a null text has no words (all counts 0) and fails the base rule, as does an empty
text; a null stratum value is a stratum of its own; a document without label, or with a null one,
is judged but not used to calibrate; a doc_id labelled more than once counts once and as bad only
if all its labels say so; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import SPACE_CHARS, keep_id, materialize

SPLIT = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Accepted share of good documents lost per stratum, and the probability of exceeding it.
ALPHA, DELTA = 0.02, 0.05
#: Feature -> cutoffs from lenient to strict.
RULES: dict[str, list[float]] = {
    "symbol_share": [0.60, 0.50, 0.40, 0.35, 0.30, 0.25, 0.20, 0.18, 0.16, 0.14, 0.12, 0.10],
    "upper_share": [0.95, 0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30],
    "dup_line_share": [0.90, 0.80, 0.70, 0.60, 0.50, 0.40, 0.30, 0.20],
    "repeat_share": [0.28, 0.25, 0.22, 0.20, 0.15, 0.10],
    "long_words": [60.0, 40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0],
}
#: Terms of the binomial tail that are summed; the rest is bounded by a geometric series and added.
TAIL_TERMS = 4000


def _strip(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def text_features(df: DataFrame, keep: list[str]) -> DataFrame:
    """Counts of each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper.

    Nested let-bindings (transform over a one-element array) make Spark evaluate each array once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def bind(value: Column, f) -> Column:
        return F.element_at(F.transform(F.array(value), f), 1)

    def covered(hashes: Column) -> Column:
        """Words in windows whose hash occurs twice or more: sort (hash, position), keep positions
        with an equal neighbour, and add up what each adds to the words covered."""
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return bind(
            pairs,
            lambda p: bind(
                F.sort_array(F.transform(F.filter(p, lambda x, k: (F.get(p, k - 1)["h"] == x["h"]) | (F.get(p, k + 1)["h"] == x["h"])), lambda x: x["i"])),
                lambda at: F.aggregate(
                    at,
                    F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
                    lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last")),
                    lambda acc: acc["n"],
                ),
            ),
        )

    def repeats(words: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
        found = bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))
        return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))

    words = F.filter(F.split(text, SPLIT), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(_strip(x, SPACE_CHARS)) > 0)
    measured = bind(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeats(w).alias("n_repeat_words")))
    line_counts = bind(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("d")))
    out = df.select(
        *keep,
        measured.alias("m"),
        line_counts.alias("l"),
        F.length(_strip(text, SPACE_CHARS)).cast("long").alias("word_chars"),
        (F.length(text) - F.length(_strip(text, SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(_strip(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))).cast("long").alias("n_upper"),
    )
    return out.select(
        *keep,
        F.col("m.n_words").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.col("l.n") - F.col("l.d")).alias("n_dup_lines"),
        F.col("m.n_repeat_words").alias("n_repeat_words"),
        "n_upper",
        F.col("l.n").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def rule_features() -> dict[str, Column]:
    """The rules' features; 0 where there is nothing to divide by."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "long_words": share("word_chars", "n_words"),
    }


def _log_factorial(n: Column) -> Column:
    """Natural logarithm of n!: exact product below 20, Stirling's series above (error < 1e-12)."""
    x = n.cast("double") + 1.0
    series = (x - 0.5) * F.log(x) - x + 0.9189385332046728 + 1 / (12 * x) - 1 / (360 * F.pow(x, 3.0)) + 1 / (1260 * F.pow(x, 5.0))
    return F.when(n < 20, F.log(F.factorial(F.least(n, F.lit(19)).cast("int")).cast("double"))).otherwise(series)


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), or a bound just above it where k has over TAIL_TERMS terms
    below it; 1 where k >= n * p (such a k proves nothing)."""
    log_top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k.cast("double") * math.log(p) + (n - k).cast("double") * math.log1p(-p)
    ratio = lambda j: j.cast("double") * (1 - p) / ((n - j + 1).cast("double") * p)  # noqa: E731  P(j - 1) / P(j)
    steps = F.when(k > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.least(k, F.lit(TAIL_TERMS)) - 1), lambda i: k - i)).otherwise(F.array().cast("array<bigint>"))
    zero = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"), F.lit(0.0).alias("r"))
    step = lambda acc, j: F.struct((acc["sum"] + acc["term"] * ratio(j)).alias("sum"), (acc["term"] * ratio(j)).alias("term"), ratio(j).alias("r"))
    total = F.aggregate(steps, zero, step, lambda acc: acc["sum"] + F.when((k > TAIL_TERMS) & (acc["r"] < 1), acc["term"] * acc["r"] / (1 - acc["r"])).otherwise(0.0))
    return F.when(k.cast("double") >= n.cast("double") * p, F.lit(1.0)).otherwise(F.exp(log_top) * total)


def calibrate(features: DataFrame, labels: DataFrame, stratum: str = "stratum", alpha: float = ALPHA, delta: float = DELTA, rules: dict[str, list[float]] | None = None) -> DataFrame:
    """(stratum, rule, cutoff): for each stratum and rule the strictest cutoff that is proved."""
    rules = rules or RULES
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality")).where("quality = 1").select("doc_id")
    values = rule_features()
    held = features.where(~base_failed()).join(good, "doc_id", "left_semi").select(stratum, *[values[r].alias(r) for r in rules])
    counts = held.groupBy(stratum).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(r) > c).alias(f"{r}:{i}") for r in rules for i, c in enumerate(rules[r])])
    tests = [F.struct(F.lit(r).alias("rule"), F.lit(i).alias("step"), F.lit(float(c)).alias("cutoff"), F.col(f"`{r}:{i}`").alias("k")) for r in rules for i, c in enumerate(rules[r])]
    strata = counts.agg(F.count(F.lit(1))).scalar()
    share = alpha / len(rules)
    tested = counts.select(stratum, "n", F.explode(F.array(*tests)).alias("t")).select(stratum, "n", "t.*")
    proved = tested.withColumn("passed", binomial_tail(F.col("k"), F.col("n"), share) <= F.lit(delta / len(rules)) / strata)
    # the strictest candidate before the first failure
    cut = proved.groupBy(stratum, "rule").agg(
        F.min(F.when(~F.col("passed"), F.col("step"))).alias("failed"),
        F.collect_list(F.struct("step", "cutoff")).alias("grid"),
    )
    return cut.select(stratum, "rule", F.array_min(F.transform(F.filter("grid", lambda g: F.col("failed").isNull() | (g["step"] < F.col("failed"))), lambda g: g["cutoff"])).alias("cutoff")).where("cutoff is not null")


def judge(features: DataFrame, cutoffs: DataFrame, stratum: str = "stratum") -> DataFrame:
    """features with base_failed, rejected_by (rule names) and kept. The cutoffs hold one row per
    stratum, which Spark broadcasts or, when there are many strata, joins by shuffle."""
    values = rule_features()
    per = cutoffs.groupBy(stratum).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")).withColumnRenamed(stratum, "_stratum")
    joined = features.join(per, F.col(stratum).eqNullSafe(F.col("_stratum")), "left")
    broken = F.filter(F.array(*[F.when(v > F.col("cutoffs")[r], F.lit(r)) for r, v in values.items()]), lambda x: x.isNotNull())
    return joined.withColumn("base_failed", base_failed()).withColumn("rejected_by", broken).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("_stratum", "cutoffs")


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One judged row per document: doc_id, the counts, base_failed, rejected_by, kept.

    The counts are written to the shared folder once; calibration and judgement read them there,
    so texts are scanned once."""
    source = keep_id(docs, *dict.fromkeys(["doc_id", "text", stratum])).withColumn("stratum", F.col(stratum).cast("string")).select("doc_id", "text", "stratum")
    features = materialize(text_features(source, ["doc_id", "stratum"]), "quality")
    return judge(features, calibrate(features, labels, alpha=alpha, delta=delta))


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang") -> DataFrame:
    """The documents that pass, with all their columns. Rows and counts are stored side by side
    once: calibration reads the counts' columns alone, and texts are neither shuffled nor scanned
    for counts again."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    whole = docs.select(row.alias("row"), F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.col(f"`{stratum}`").cast("string").alias("stratum"))
    counted = materialize(text_features(whole, ["row", "doc_id", "stratum"]), "quality")
    cutoffs = materialize(calibrate(counted.drop("row"), labels), "cutoffs")
    return judge(counted, cutoffs).where("kept").select("row.*")
