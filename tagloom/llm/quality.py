"""Quality rules whose cutoffs are certified on labelled documents.

Of the good documents of a language (the stratum) that pass the base rule, all rules together may reject MAX_REJECT;
each rule has an equal share of that. Per language and rule, cutoffs are tried from lenient to strict. A cutoff
is certified if an exact binomial test refutes "this cutoff rejects at least the rule's share": with ``k``
of ``n`` good labelled texts rejected, P(Binomial(n, share) <= k) must not exceed LEVEL divided
by strata times rules. That is the Clopper-Pearson bound read the other way round. Tests of one rule are a
fixed sequence that ends at its first failure, so only strata and rules need the Bonferroni correction.
With probability 1 - LEVEL no stratum loses MAX_REJECT of its good documents. Trials must be independent, so equal
texts of a stratum are one trial, good if no row of them is labelled bad. Of the certified cutoffs the one with the most
labelled bad texts caught less good ones rejected is used, the most lenient one if several are equal. A
stratum with too few labels to certify anything has no cutoffs: only the base rule can reject there.

Everything is DataFrame expressions. A word is a run without blank, tab, LF, VT, FF or CR. Defined
results: a null or empty text has no words and fails the base rule; texts of any length are counted whole, in their
row; a null language is a stratum of its own, apart from the empty one; repeated rows are each judged and one trial; without
labels no cutoff is certified; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import BLANKS, stored

MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
#: Largest share of a stratum's good documents that all rules together may reject, and the level of all tests together.
MAX_REJECT, LEVEL = 0.04, 0.05
#: Rule and its cutoffs, from lenient to strict; a document is rejected at or above the cutoff.
RULES: dict[str, list[float]] = {
    "symbol_share": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02, 0.01],
    "stutter_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "dup_line_share": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
    "repeat_share": [0.28, 0.26, 0.24, 0.22, 0.2, 0.15, 0.1],
}


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per document: doc_id, stratum, digest of the text, counts of words, characters, symbols, lines and repeats."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id", "stratum", F.xxhash64("text").alias("digest"),
        F.length(F.regexp_replace("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform(F.array_remove(F.split("text", BLANKS), ""), lambda w: F.xxhash64(w)).alias("words"),
    )
    rows = rows.select(
        "doc_id", "stratum", "digest", "word_chars", "n_symbols", "words", F.size("words").alias("n"), F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("words", lambda w, i: w == F.get(F.col("words"), i - 1))).cast("long").alias("n_stutter"),
    )
    windows = F.transform(F.sequence(F.lit(1), F.col("n") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("words"), i, F.lit(WINDOW))))
    rows = rows.withColumn("windows", F.when(F.col("n") >= WINDOW, windows))
    # most texts repeat no window: only the others are sorted
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    rows = rows.withColumn("found", F.when(repeats, F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    same = lambda s, i, d: F.coalesce(s["x"] == F.get(F.col("found"), i + d)["x"], F.lit(False))
    rows = rows.withColumn("starts", F.sort_array(F.transform(
        F.filter("found", lambda s, i: same(s, i, -1) | same(s, i, 1)), lambda s: s["i"]
    )))
    gaps = F.zip_with(F.slice("starts", F.lit(2), F.size("starts") - 1), F.slice("starts", F.lit(1), F.size("starts") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("starts") > 0, F.aggregate(gaps, F.lit(WINDOW), lambda acc, g: acc + g)).otherwise(0)
    return rows.select(
        "doc_id", "stratum", "digest", F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stutter",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _share(part: str, whole: str) -> Column:
    return F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))


SHARES = {
    "symbol_share": ("n_symbols", "word_chars"), "stutter_share": ("n_stutter", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
}


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Binomial(n, p) <= k), summed term by term in logarithms; 1 where k is at or above the mean."""
    odds = F.log(F.lit(p / (1 - p)))
    start = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("total"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i) + odds
        high, low = F.greatest(term, acc["total"]), F.least(term, acc["total"])
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    counted = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.when(k >= n * p, F.lit(1.0)).otherwise(F.exp(F.aggregate(counted, start, step)["total"]))


def cutoffs(measured: DataFrame, labels: DataFrame, max_reject: float = MAX_REJECT, level: float = LEVEL) -> DataFrame:
    """(stratum, rule, cutoff) in use, with the counts and the test behind each.

    Counts are sums per (stratum, rule, step), combined before their shuffle; at most one row per
    stratum, rule and step follows.
    """
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).alias("good"))
    judged = measured.join(labels, "doc_id").where(~base_failed())
    counts = sorted({c for pair in SHARES.values() for c in pair})
    judged = judged.groupBy("stratum", "digest").agg(F.min("good").alias("good"), *[F.first(c).alias(c) for c in counts])
    # how many steps of each rule reject the document: one row per document and rule
    strictness = F.array(*[
        F.struct(
            F.lit(rule).alias("rule"),
            reduce(lambda a, b: a + b, [(_share(*SHARES[rule]) < c).cast("int") for c in steps]).alias("first"),
            F.lit(len(steps)).alias("n_steps"),
        ) for rule, steps in RULES.items()
    ])
    per_first = judged.select("stratum", "good", F.explode(strictness).alias("s")).groupBy("stratum", "good", "s.rule", "s.first", "s.n_steps").count()
    per_step = per_first.select("*", F.explode(F.sequence(F.lit(0), F.col("n_steps") - 1)).alias("step")).groupBy("stratum", "rule", "step").agg(
        F.sum(F.when(F.col("good"), F.col("count")).otherwise(0)).alias("n"),
        F.sum(F.when(F.col("good") & (F.col("first") <= F.col("step")), F.col("count")).otherwise(0)).alias("k"),
        F.sum(F.when(~F.col("good") & (F.col("first") <= F.col("step")), F.col("count")).otherwise(0)).alias("caught"),
    )
    tested = per_step.withColumn("strata", per_step.select(F.count_distinct(F.struct("stratum"))).scalar())
    tested = tested.withColumn("p", binomial_tail(F.col("n"), F.col("k"), max_reject / len(RULES))).withColumn(
        "passed", F.col("p") <= F.lit(level / len(RULES)) / F.col("strata")
    )
    first_fail = F.coalesce(F.min(F.when(~F.col("passed"), F.col("step"))), F.lit(1_000))
    ends = tested.groupBy(F.col("stratum").alias("of"), F.col("rule").alias("its")).agg(first_fail.alias("ends"))
    same = F.col("stratum").eqNullSafe(F.col("of")) & (F.col("rule") == F.col("its"))
    certified = tested.join(ends, same).where("step < ends AND caught > 0")
    value = F.create_map(*[x for rule, steps in RULES.items() for x in (F.lit(rule), F.array(*map(F.lit, steps)))])
    best = certified.groupBy("stratum", "rule").agg(F.max_by(
        F.struct("step", "n", "k", "caught", "p"), F.struct(F.col("caught") - F.col("k"), -F.col("step"))
    ).alias("b"))
    return best.select("stratum", "rule", value[F.col("rule")][F.col("b.step")].alias("cutoff"), "b.n", "b.k", "b.caught", "b.p")


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """Per document its counts, base_failed, the certified cutoffs of its stratum and kept."""
    measured = stored(features(docs, id_col, text_col, stratum_col), "features")
    used = stored(cutoffs(measured, labels), "cutoffs").groupBy(F.col("stratum").alias("of")).agg(*[
        F.max(F.when(F.col("rule") == rule, F.col("cutoff"))).alias(f"max_{rule}") for rule in RULES
    ])
    rejected = [F.coalesce(_share(*SHARES[rule]) >= F.col(f"max_{rule}"), F.lit(False)) for rule in RULES]
    return measured.join(used, F.col("stratum").eqNullSafe(F.col("of")), "left").drop("of").withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~reduce(lambda a, b: a | b, rejected)
    )
