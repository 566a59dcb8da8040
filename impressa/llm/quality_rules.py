"""Quality rules whose cutoffs are chosen under a proven bound on false rejection.

Each rule is a "badness" ratio of a text (symbols, repeated lines, repeated word windows,
capitals, exclamation marks).  A document fails a rule when its ratio exceeds the rule's cutoff in
the document's stratum (language).  Cutoffs come from labelled holdout rows: for a stratum with n
good labelled texts, k of which a cutoff would reject, the exact binomial tail
``P(Bin(n, a) <= k)`` is the p-value of "this cutoff rejects more than a share ``a`` of the good
texts".  Trials must be independent, and copies are not: rows count as one trial if their texts
share the least hash of their word windows, as equal texts always do and near copies do with the
probability of their similarity; of such rows the one with the smallest doc_id is judged.  Cutoffs of a rule are tested from lenient to strict and the sequence stops at the
first one that is not significant (fixed-sequence testing needs no correction inside a rule);
across strata and rules the level is divided by their number (Bonferroni).  ``a`` is the allowed
share divided by the number of rules, so a stratum loses at most ``max_rejection`` of its distinct
good texts to all rules together, with probability ``1 - error``.  Among the certified cutoffs the
most lenient one that catches nearly all the labelled bad documents that any certified cutoff
catches is used.  A stratum with too few labelled rows certifies nothing and rejects nothing.

Defined cases: null or empty text has no words and fails the base rule; null language is a
stratum of its own; several labels of one document count as good only if all say so; repeated
rows are judged alike; empty labels certify nothing.  Extra columns pass through; the names in
``FEATURES`` and ``VERDICT`` and that of ``TRIAL`` replace columns of that name.  Only DataFrame functions run.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from impressa.llm.exprs import count_chars, let, without, words
from impressa.llm.registry import query, table
from impressa.session import cut_lineage

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals",
            "n_exclaims"]
VERDICT = ["base_failed", "kept"]
TRIAL = "least_window"  # rows of one stratum that share it are one trial
RULES = ["symbols", "dup_lines", "repeats", "capitals", "exclaims"]
# Shares of badness tried as cutoffs, lenient first.
CUTOFFS = [round(1.0 - 0.025 * i, 3) for i in range(36)] + [0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.01]

# Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT, SYMBOLS = 50, 50, "#*$%&|<>"


def _windows(w: Column) -> Column:
    """(r, least): the words inside a 3-word window that occurs at least twice, the first occurrence
    included, and the least hash of all windows (null: fewer than 3 words).  Windows are compared by
    64-bit hashes; only texts that repeat a window sort them."""
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                         lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(s: Column) -> Column:
        same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1),
                      lambda j: F.coalesce(same(j, j - 1), F.lit(False)) | F.coalesce(same(j, j + 1), F.lit(False)))
        starts = F.transform(at, lambda j: F.get(s, j)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda p: F.array(p, p + 1, p + 2)))))

    def judge(h: Column) -> Column:
        ranked = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        repeated = F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ranked, covered))
        return F.struct(repeated.cast("long").alias("r"), F.array_min(h).alias("least"))

    none = F.struct(F.lit(0).cast("long").alias("r"), F.lit(None).cast("long").alias("least"))
    return F.when(F.size(w) < 3, none).otherwise(let(hashes, judge))


def with_features(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the word, symbol, line and repetition counts of each whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    w = let(words(t), lambda x: F.struct(F.size(x).cast("long").alias("n"), _windows(x).alias("s")))
    lines = let(F.filter(F.split(t, "\n"), lambda x: without(x, " \t\x0b\f\r") != ""),
                lambda x: F.struct(F.size(x).cast("long").alias("n"),
                                   (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    out = docs.drop(*FEATURES, *VERDICT, TRIAL).withColumns({"__w": w, "__l": lines})
    return out.withColumns({
        "n_words": F.col("__w.n"), "word_chars": F.length(without(t, " \t\n\x0b\f\r")).cast("long"),
        "n_symbols": count_chars(t, SYMBOLS), "n_dup_lines": F.col("__l.d"), "n_repeat_words": F.col("__w.s.r"),
        "n_lines": F.col("__l.n"), "n_capitals": count_chars(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
        "n_exclaims": count_chars(t, "!"), TRIAL: F.col("__w.s.least")}).drop("__w", "__l")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def badness() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.least(F.col(a) / F.col(b), F.lit(1.0)), F.lit(0.0))
    return {"symbols": share("n_symbols", "word_chars"), "dup_lines": share("n_dup_lines", "n_lines"),
            "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars"),
            "exclaims": share("n_exclaims", "word_chars")}


def log_binomial_tail(n: Column, k: Column, a: float) -> Column:
    """ln P(Bin(n, a) <= k), exactly summed; 0 from the mean on, where no test is significant."""
    odds = math.log(a) - math.log1p(-a)
    first = n * F.lit(math.log1p(-a))
    fold = F.aggregate(
        F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<long>")),
        F.struct(first.alias("t"), first.alias("s")),
        lambda acc, i: let(acc["t"] + F.log((n - i + 1) / i) + F.lit(odds), lambda t: F.struct(
            t.alias("t"), (F.greatest(acc["s"], t) + F.log1p(F.exp(-F.abs(acc["s"] - t)))).alias("s"))),
        lambda acc: acc["s"])
    return F.when(k >= n * a, F.lit(0.0)).otherwise(fold)


def certified_cutoffs(scored: DataFrame, labels: DataFrame, stratum: str = "lang", max_rejection: float = 0.02,
                      error: float = 0.05, enough: float = 0.99) -> DataFrame:
    """(stratum, rule, cutoff, n, k): the chosen cutoff of each rule that has a certified one.

    ``scored`` has doc_id, the stratum, ``FEATURES`` and ``TRIAL``; ``labels`` has doc_id and quality;
    n and k count trials.  Counting is one aggregation over (stratum, rule, bin): a bin is the number of cutoffs that
    accept the value, so the counts of every cutoff are running sums over at most 45 bins."""
    good = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"))
    held = scored.where(~base_failed()).select("doc_id", F.col(stratum).alias("stratum"), TRIAL, F.array(*[
        F.struct(F.lit(r).alias("rule"), v.alias("value")) for r, v in badness().items()]).alias("r")) \
        .join(good, "doc_id").groupBy("stratum", "quality", TRIAL).agg(F.min(F.struct("doc_id", "r")).alias("x")) \
        .select("stratum", "quality", F.inline("x.r"))
    grid = F.array(*[F.lit(c) for c in CUTOFFS])
    counts = held.withColumn("bin", F.size(F.filter(grid, lambda c: F.col("value") <= c))) \
        .groupBy("stratum", "rule", "bin").agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"),
                                               F.sum((F.col("quality") != 1).cast("long")).alias("bad"))
    # every cutoff of every (stratum, rule): cutoff number j rejects the values accepted by fewer than j
    groups = counts.groupBy("stratum", "rule").agg(
        F.sum("good").alias("n"), F.collect_list(F.struct("bin", "good", "bad")).alias("bins"))
    total = lambda j, what: F.aggregate(F.filter("bins", lambda b: b["bin"] < j), F.lit(0).cast("long"),
                                        lambda s, b: s + b[what])
    tried = groups.select("stratum", "rule", "n", F.posexplode(grid).alias("at", "cutoff"), "bins") \
        .withColumn("j", F.col("at") + 1) \
        .select("stratum", "rule", "n", "at", "cutoff", total(F.col("j"), "good").alias("k"),
                total(F.col("j"), "bad").alias("caught"))
    strata = groups.select("stratum").distinct().count()
    level = math.log(error / max(1, strata * len(RULES)))
    order = Window.partitionBy("stratum", "rule").orderBy("at")
    whole = Window.partitionBy("stratum", "rule")
    sure = tried.withColumn("ok", log_binomial_tail(F.col("n"), F.col("k"), max_rejection / len(RULES)) <= level) \
        .withColumn("ok", F.min("ok").over(order)).where("ok") \
        .withColumn("most", F.max("caught").over(whole)) \
        .where((F.col("caught") > 0) & (F.col("caught") >= enough * F.col("most")))
    first = sure.groupBy("stratum", "rule").agg(F.min(F.struct("at", "cutoff", "n", "k")).alias("c"))
    return first.select("stratum", "rule", "c.cutoff", "c.n", "c.k")


def apply_cutoffs(scored: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """``scored`` with base_failed, kept and the name of the first rule that rejected."""
    per = cutoffs.groupBy(F.col("stratum").alias("__s")).pivot("rule", RULES).agg(F.first("cutoff"))
    per = per.select("__s", *[F.col(r).alias(f"__c_{r}") for r in RULES])
    out = scored.join(per, F.col(stratum).eqNullSafe(F.col("__s")), "left")
    bad = badness()
    failed = [F.when(bad[r] > F.col(f"__c_{r}"), F.lit(r)) for r in RULES]
    reason = F.coalesce(F.when(base_failed(), F.lit("base")), *failed)
    return out.withColumns({"base_failed": base_failed(), "kept": reason.isNull(), "rejected_by": reason}) \
        .drop("__s", *[f"__c_{r}" for r in RULES])


def quality_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **kw) -> DataFrame:
    """The documents that no certified rule rejects, with the columns of ``docs``."""
    scored = cut_lineage(with_features(docs).select("doc_id", stratum, *FEATURES, TRIAL))
    cutoffs = cut_lineage(certified_cutoffs(scored, labels, stratum, **kw))
    return apply_cutoffs(with_features(docs.select("*")), cutoffs, stratum).where("kept").select(*docs.columns)


@query("op10_risk_controlled_rules")
def op10(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = cut_lineage(with_features(docs).select("doc_id", "lang", *FEATURES, TRIAL))
    cutoffs = cut_lineage(certified_cutoffs(scored, labels))
    return apply_cutoffs(scored, cutoffs).select("doc_id", *FEATURES[:5], *VERDICT, "rejected_by")
