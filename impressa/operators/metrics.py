"""Per-impression ranking metrics and their means (M1-M16, M-H1, M-H2).

Input is the long scored table ``(imp_id, pos, news_id, score, label)``.  Every metric is a
two-stage aggregate: a value per impression (``null`` where the reference would divide 0/0,
Q7/Q8), then ``avg`` over the impressions where it is defined.  All windows partition by
``imp_id`` only, so one exchange serves ranking, tie handling and every per-impression sum;
topic weights group by (imp_id, topic), which the same partitioning already satisfies.

No metric enumerates candidate pairs: AUC uses tie-averaged ranks, ILS-senti the sorted-order
identity sum_{i<j}|x_i-x_j| = sum_j x_(j)(2j-n-1), ILS-topic the identity
sum_{i!=j} <v_i, v_j> = |sum v|^2 - sum |v|^2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impressa.operators.skew import dealt, fits, lookup_join
from impressa.functions.scalar import relu

IMP, POS, SCORE, LABEL = "imp_id", "pos", "score", "label"


def _w():
    return Window.partitionBy(IMP)


def rank_candidates(scored: DataFrame) -> DataFrame:
    """``rank`` = 1 for the best score; ties broken by candidate position (Q22)."""
    return scored.withColumn("rank", F.row_number().over(_w().orderBy(F.desc(SCORE), F.asc(POS))).cast("long"))


def _with_ranks(scored: DataFrame, graded: bool = False) -> DataFrame:
    """rank (row_number by score desc, pos), plus the tie data AUC needs.

    The row_number window is applied first, so its sort (imp, score desc, pos) also satisfies
    the (imp, score desc) order of ``rank`` and of the peer count (a RANGE frame of the current
    row): one sort per partition serves all three."""
    r = scored.withColumn("rank", F.row_number().over(_w().orderBy(F.desc(SCORE), F.asc(POS))))
    ws = _w().orderBy(F.desc(SCORE))
    r = r.withColumns({
        "_rmin": F.rank().over(ws),
        "_peers": F.count(F.lit(1)).over(ws.rangeBetween(Window.currentRow, Window.currentRow)),
    })
    if graded:
        r = r.withColumn("_ideal", F.row_number().over(_w().orderBy(F.desc(LABEL), F.asc(POS))))
    return r


def _gain(label, r):
    return (F.pow(F.lit(2.0), label.cast("double")) - 1) / F.log2(r.cast("double") + 1)


def _ideal_dcg_binary(n_pos, k: int):
    """IDCG@k of click labels (0/1): the first min(k, clicks) discounts, from a constant table."""
    import math
    prefix, acc = [0.0], 0.0
    for j in range(1, k + 1):
        acc += 1.0 / math.log2(j + 1)
        prefix.append(acc)
    table = F.array(*[F.lit(v) for v in prefix])
    return F.get(table, F.least(n_pos, F.lit(k)).cast("int"))


def performance_parts(ranked: DataFrame, ks=(5, 10), mrr_ks=(), graded: bool = False) -> list:
    lab = F.col(LABEL).cast("double")
    r = F.col("rank")
    desc_avg = F.col("_rmin") + (F.col("_peers") - 1) / F.lit(2.0)  # mean descending rank of the tie group
    parts = [F.count(F.lit(1)).alias("n_cand"), F.count(F.when(F.col(LABEL) > 0, 1)).alias("n_pos"),
             F.sum(lab).alias("_sum_label"),
             F.sum(F.when(F.col(LABEL) > 0, desc_avg).otherwise(0.0)).alias("_sum_pos_desc"),
             F.sum(lab / r).alias("_rr")]
    parts.append(F.max(F.col(LABEL)).alias("_max_label"))
    for k in ks:
        parts.append(F.sum(F.when(r <= k, _gain(F.col(LABEL), r)).otherwise(0.0)).alias(f"_dcg{k}"))
        if graded:
            ideal = F.col("_ideal")
            parts.append(F.sum(F.when(ideal <= k, _gain(F.col(LABEL), ideal)).otherwise(0.0)).alias(f"_idcg{k}"))
    for k in mrr_ks:
        parts.append(F.sum(F.when(r <= k, lab / r).otherwise(0.0)).alias(f"_rr{k}"))
        parts.append(F.sum(F.when(r <= k, lab).otherwise(0.0)).alias(f"_pos{k}"))
    return parts


def performance_finish(g: DataFrame, ks=(5, 10), mrr_ks=(), graded: bool = False) -> DataFrame:
    n, p = F.col("n_cand"), F.col("n_pos")
    # ascending average rank of a candidate = n + 1 - its mean descending rank
    sum_pos_asc = p * (n + 1) - F.col("_sum_pos_desc")
    cols = {
        "auc": F.when((p > 0) & (p < n), (sum_pos_asc - p * (p + 1) / 2) / (p * (n - p))),
        "mrr": F.when(F.col("_sum_label") > 0, F.col("_rr") / F.col("_sum_label")),
    }
    for k in ks:
        if graded:
            idcg = F.col(f"_idcg{k}")
            cols[f"ndcg@{k}"] = F.when(idcg > 0, F.col(f"_dcg{k}") / idcg)
        else:
            # click labels: the ideal list is all clicks first (graded labels need graded=True)
            idcg = _ideal_dcg_binary(p, k)
            cols[f"ndcg@{k}"] = F.when((idcg > 0) & (F.col("_max_label") <= 1), F.col(f"_dcg{k}") / idcg)
    for k in mrr_ks:
        cols[f"mrr@{k}"] = F.when(F.col(f"_pos{k}") > 0, F.col(f"_rr{k}") / F.col(f"_pos{k}"))
    own = ["_sum_pos_desc", "_rr", "_sum_label", "_max_label"] + [f"_dcg{k}" for k in ks] \
        + ([f"_idcg{k}" for k in ks] if graded else []) + [f"_rr{k}" for k in mrr_ks] + [f"_pos{k}" for k in mrr_ks]
    return g.withColumns(cols).drop(*own)


def performance(scored: DataFrame, ks=(5, 10), mrr_ks=(), graded: bool = False) -> DataFrame:
    """M1-M3 per impression: (imp_id, n_cand, n_pos, auc, mrr, ndcg@k..., mrr@k...).

    ``graded=True`` ranks labels for the ideal DCG (labels above 1); click labels use the
    closed form."""
    g = _with_ranks(scored, graded).groupBy(IMP).agg(*performance_parts(None, ks, mrr_ks, graded))
    return performance_finish(g, ks, mrr_ks, graded)


def auc(scored: DataFrame) -> DataFrame:
    """M1 per impression (defined only with both classes)."""
    return performance(scored, ks=()).select(IMP, "auc").where(F.col("auc").isNotNull())


def ndcg(scored: DataFrame, k: int) -> DataFrame:
    """M2 per impression (defined only with a click)."""
    return performance(scored, ks=(k,)).select(IMP, F.col(f"ndcg@{k}").alias("ndcg")).where(F.col("ndcg").isNotNull())


def mrr(scored: DataFrame, k: int | None = None) -> DataFrame:
    """M3 per impression: sum(y/r)/sum(y) over all (or the top-k) candidates (Q6)."""
    if k is None:
        return performance(scored, ks=()).select(IMP, "mrr").where(F.col("mrr").isNotNull())
    return (performance(scored, ks=(), mrr_ks=(k,)).select(IMP, F.col(f"mrr@{k}").alias("mrr"))
            .where(F.col("mrr").isNotNull()))


# --- sentiment (M4, M5, M8, M-H1) --------------------------------------------------------------

def sentiment_parts(col: str, ks=(5, 10), mrr_k: int | None = None) -> list:
    s, r = F.col(col).cast("double"), F.col("rank")
    parts = [F.sum(s / r if mrr_k is None else F.when(r <= mrr_k, s / r).otherwise(0.0)).alias(f"_srr_{col}")]
    parts += [F.sum(F.when(r <= k, s).otherwise(0.0)).alias(f"_s{k}_{col}") for k in ks]
    return parts


def sentiment_finish(g: DataFrame, col: str, ks=(5, 10), name: str | None = None) -> DataFrame:
    name = name or col
    m = F.coalesce(F.col(f"s_mean_{col}"), F.lit(0.0))
    cols = {f"senti_mrr_{name}": relu(m * F.col(f"_srr_{col}"))}
    for k in ks:
        cols[f"senti@{k}_{name}"] = relu(m * F.col(f"_s{k}_{col}"))
    return g.withColumns(cols).drop(f"_srr_{col}", *[f"_s{k}_{col}" for k in ks])


def _add_ils_positions(ranked: DataFrame, cols, ks) -> DataFrame:
    """For each sentiment column one window ordered by that sentiment gives, by running counts,
    each candidate's position among the top-k candidates (for every k at once)."""
    for c in cols:
        w = _w().orderBy(F.asc(c), F.asc("rank")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        ranked = ranked.withColumns({f"_j{k}_{c}": F.sum(F.when(F.col("rank") <= k, 1).otherwise(0)).over(w)
                                     for k in ks})
    return ranked


def ils_senti_parts(cols, ks) -> list:
    """sum over the top k of s_(j) (2j - n_k - 1), j = position in sentiment order (the sorted
    form of sum_{i<j} |s_i - s_j|); n_k = min(k, n) comes from n_cand."""
    parts = []
    for c in cols:
        for k in ks:
            parts.append(F.sum(F.when(F.col("rank") <= k, F.col(c).cast("double") * (2 * F.col(f"_j{k}_{c}") - 1)))
                         .alias(f"_ilsa{k}_{c}"))
            parts.append(F.sum(F.when(F.col("rank") <= k, F.col(c).cast("double"))).alias(f"_ilsb{k}_{c}"))
    return parts


def ils_senti_finish(g: DataFrame, col: str, k: int, name: str | None = None) -> DataFrame:
    """ILS-senti@k = sum_{i<j} |s_i - s_j| / 2 / C(n_k, 2) = (sum_j s_(j)(2j - 1) - n_k sum_j s_(j)) / (n_k (n_k - 1))."""
    name = name or col
    nk = F.least(F.col("n_cand"), F.lit(k)).cast("double")
    total = F.col(f"_ilsa{k}_{col}") - nk * F.col(f"_ilsb{k}_{col}")
    return g.withColumn(f"ils_senti@{k}_{name}", F.when(nk >= 2, total / (nk * (nk - 1)))) \
        .drop(f"_ilsa{k}_{col}", f"_ilsb{k}_{col}")


def topic_array(news: DataFrame, category="category", subcategory="subcategory"):
    """Distinct non-null topics of an item (category and subcategory share one id space, so an
    equal pair counts once)."""
    return F.array_distinct(F.filter(F.array(F.col(category).cast("string"), F.col(subcategory).cast("string")),
                                     lambda x: x.isNotNull()))


def _history_items(history: DataFrame, items: DataFrame, max_history: int, tasks: int | None) -> DataFrame:
    """The first ``max_history`` history rows with their item's columns, dealt by impression before these travel."""
    h = history.where(F.col("hpos") <= max_history).select(IMP, "news_id")
    if fits(items):
        h = dealt(h, tasks, IMP)
    return lookup_join(h, items, ["news_id"], tasks=tasks, back=IMP)


def history_profile(history: DataFrame, news: DataFrame, senti_cols=(), max_history: int = 50,
                    denominator: str = "max_history", topics: bool = True, tasks: int | None = None) -> DataFrame:
    """M-H1 + M-H2, one row per impression: ``s_mean_<col>`` (Q4: divided by the padded length
    by default), ``_utopic`` = map topic -> number of history items with it, ``_unorm`` = L2 norm
    of those counts.  Impressions without history are absent (their means and vectors are 0).

    One pass over the history: items are exploded to their topics (an item without topics keeps
    one row), sentiment is summed on each item's first row only, and the per-(impression, topic)
    counts are folded into a map per impression (at most 2 * max_history entries)."""
    if denominator not in ("max_history", "actual"):
        raise ValueError("denominator must be 'max_history' or 'actual'")
    cols = list(senti_cols)
    t_arr = topic_array(news) if topics else F.array().cast("array<string>")
    hj = _history_items(history, news.select("news_id", *cols, t_arr.alias("_t")), max_history, tasks)
    x = hj.select(IMP, *cols, F.posexplode_outer("_t").alias("_ti", "topic"))
    first = F.coalesce(F.col("_ti"), F.lit(0)) == 0
    pt = x.groupBy(IMP, "topic").agg(F.count(F.col("_ti")).cast("double").alias("cnt"),
                                     F.sum(F.when(first, 1).otherwise(0)).alias("_items"),
                                     *[F.sum(F.when(first, F.col(c))).alias(f"_s_{c}") for c in cols])
    aggs = []
    for c in cols:
        total = F.sum(f"_s_{c}")
        aggs.append((total / F.lit(float(max_history)) if denominator == "max_history"
                     else total / F.sum("_items")).alias(f"s_mean_{c}"))
    if topics:
        aggs += [F.map_from_entries(F.collect_list(F.when(F.col("topic").isNotNull(), F.struct("topic", "cnt"))))
                 .alias("_utopic"),
                 F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("_unorm")]
    return pt.groupBy(IMP).agg(*aggs)


def history_sentiment(history: DataFrame, news: DataFrame, cols, max_history: int = 50,
                      denominator: str = "max_history") -> DataFrame:
    """M-H1 alone: (imp_id, s_mean_<col>...)."""
    return history_profile(history, news, cols, max_history, denominator, topics=False)


def user_topics(history: DataFrame, news: DataFrame, max_history: int = 50) -> DataFrame:
    """M-H2 user side in long form: (imp_id, topic, u) with u the L2-normalised topic counts."""
    p = history_profile(history, news, (), max_history, topics=True)
    return p.select(IMP, F.explode("_utopic").alias("topic", "cnt"), "_unorm") \
        .select(IMP, "topic", (F.col("cnt") / F.col("_unorm")).alias("u"))


def history_topic_counts(history: DataFrame, news: DataFrame, max_history: int = 50, tasks: int | None = None) -> DataFrame:
    """M-H2 in long form: (imp_id, topic, cnt) = number of history items carrying the topic."""
    h = _history_items(history, news.select("news_id", topic_array(news).alias("_t")), max_history, tasks)
    return h.select(IMP, F.explode("_t").alias("topic")).groupBy(IMP, "topic").agg(
        F.count(F.lit(1)).cast("double").alias("cnt"))


def _topic_scores(ranked: DataFrame, hist_counts: DataFrame | None, ks, mrr_k: int | None = None) -> DataFrame:
    """Per impression: dot products of the user-topic counts with the candidate topic vectors
    (weights 1/r, or 1 on the top k), |v|^2, and |sum of normalised top-k vectors|^2.

    TopicMRR's numerator sum_c (1/r_c) sum_{t in c} u_t equals sum_t u_t v_t, so everything is
    a sum at the (impression, topic) level: candidate sums group on the ranked table's existing
    partitioning.  The user side is one row per impression, its counts as a map of at most 2 * max_history topics:
    a join by impression alone, which needs no exchange where both sides are dealt by impression."""
    r = F.col("rank")
    x = ranked.select(IMP, "rank", F.explode("_topics").alias("topic"), F.size("_topics").alias("m"))
    inv = F.lit(1.0) / F.sqrt(F.col("m").cast("double"))
    ct = x.groupBy(IMP, "topic").agg(
        F.sum(F.lit(1.0) / r if mrr_k is None else F.when(r <= mrr_k, F.lit(1.0) / r).otherwise(0.0)).alias("v_mrr"),
        *[F.sum(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"v{k}") for k in ks],
        *[F.sum(F.when(r <= k, inv).otherwise(0.0)).alias(f"w{k}") for k in ks])
    if hist_counts is not None:
        users = hist_counts.groupBy(IMP).agg(F.map_from_entries(F.collect_list(F.struct("topic", "cnt"))).alias("_counts"),
                                             F.sqrt(F.sum(F.col("cnt") * F.col("cnt"))).alias("_unorm"))
        ct = ct.join(users, IMP, "left")
    else:
        ct = ct.withColumns({"_counts": F.lit(None).cast("map<string,double>"), "_unorm": F.lit(None).cast("double")})
    u = F.coalesce(F.try_element_at("_counts", "topic"), F.lit(0.0))
    return ct.groupBy(IMP).agg(
        F.sum(u * F.col("v_mrr")).alias("_udot_mrr"), F.sum(F.col("v_mrr") ** 2).alias("_nn_mrr"),
        *[F.sum(u * F.col(f"v{k}")).alias(f"_udot{k}") for k in ks],
        *[F.sum(F.col(f"v{k}") ** 2).alias(f"_nn{k}") for k in ks],
        *[F.sum(F.col(f"w{k}") ** 2).alias(f"_ww{k}") for k in ks],
        F.coalesce(F.max("_unorm"), F.lit(0.0)).alias("_unorm"))


def _topic_finish(df: DataFrame, ks) -> DataFrame:
    un = F.col("_unorm")

    def cosine(dot, nn):
        return F.when((un > 0) & (F.col(nn) > 0), F.col(dot) / (un * F.sqrt(nn))).otherwise(0.0)

    cols = {"topic_mrr": cosine("_udot_mrr", "_nn_mrr")}
    for k in ks:
        cols[f"topic_div@{k}"] = cosine(f"_udot{k}", f"_nn{k}")
        nk = F.least(F.col("n_cand"), F.lit(k)).cast("double")
        cols[f"ils_topic@{k}"] = F.when(nk >= 2, (F.coalesce(F.col(f"_ww{k}"), F.lit(0.0)) - F.col(f"_nz{k}"))
                                        / (nk * (nk - 1)))
    drop = ["_udot_mrr", "_nn_mrr", "_unorm"] + [f"_{p}{k}" for k in ks for p in ("udot", "nn", "ww", "nz")]
    return df.withColumns(cols).drop(*drop)


# --- everything at once (M10, M11) -------------------------------------------------------------

def impression_metrics(scored: DataFrame, news: DataFrame | None = None, history: DataFrame | None = None,
                       senti_cols=(), ks=(5, 10), max_history: int = 50, denominator: str = "max_history",
                       topics: bool = True, mrr_k: int | None = None, tasks: int | None = None) -> DataFrame:
    """One row per impression with every metric as a column (null where undefined).
    ``mrr_k`` limits SentiMRR and TopicMRR to the first k ranks.

    ``news`` supplies ``senti_cols`` and category/subcategory; ``history`` is (imp_id, hpos, news_id).
    Plan: item attributes (broadcast-sized catalogue) and the per-impression history profile
    are attached to the candidates *before* ranking, so a single exchange by impression serves
    the rank window, the per-impression aggregate and the per-(impression, topic) aggregate.
    ``tasks`` deal the joins by item where the catalogue is too large to broadcast (see ``lookup_join``).
    """
    senti_cols = list(senti_cols)
    topics = topics and news is not None
    base = scored
    if news is not None:
        base = lookup_join(base, news.select("news_id", *senti_cols, *([topic_array(news).alias("_topics")] if topics else [])),
                           ["news_id"], "left", tasks=tasks, back=IMP)
    # ranks first: the topic branch below reuses this cheap ranked base, so the history profile
    # (joined afterwards, on the same impression partitioning) is computed only once
    ranked0 = _with_ranks(base)
    ranked = ranked0
    if history is not None and senti_cols:
        ranked = ranked.join(history_profile(history, news, senti_cols, max_history, denominator, topics=False, tasks=tasks),
                             IMP, "left")
    else:
        ranked = ranked.withColumns({f"s_mean_{c}": F.lit(0.0) for c in senti_cols})
    if senti_cols:
        ranked = _add_ils_positions(ranked, senti_cols, ks)
    parts = performance_parts(None, ks)
    for c in senti_cols:
        parts += sentiment_parts(c, ks, mrr_k)
        parts.append(F.max(F.col(f"s_mean_{c}")).alias(f"s_mean_{c}"))
    if senti_cols:
        parts += ils_senti_parts(senti_cols, ks)
    if topics:
        parts += [F.sum(F.when((F.col("rank") <= k) & (F.size("_topics") > 0), 1.0).otherwise(0.0))
                  .alias(f"_nz{k}") for k in ks]
    out = performance_finish(ranked.groupBy(IMP).agg(*parts), ks)
    for c in senti_cols:
        out = sentiment_finish(out, c, ks)
        for k in ks:
            out = ils_senti_finish(out, c, k)
    out = out.drop(*[f"s_mean_{c}" for c in senti_cols])
    if topics:
        hc = history_topic_counts(history, news, max_history, tasks) if history is not None else None
        out = _topic_finish(out.join(_topic_scores(ranked0, hc, ks, mrr_k), IMP, "left"), ks)
    return out


def metric_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in (IMP, "n_cand", "n_pos")]


def summarize(per_imp: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Long (metric, value, n_used) — mean over the impressions where a metric is defined."""
    metrics = metrics or metric_columns(per_imp)
    stacked = per_imp.select(F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(f"`{m}`").cast("double").alias("v")) for m in metrics
    ])).alias("x")).select("x.*")
    return stacked.groupBy("metric").agg(F.avg("v").alias("value"), F.count("v").alias("n_used"))


def evaluate(scored: DataFrame, news: DataFrame | None = None, history: DataFrame | None = None,
             senti_cols=(), ks=(5, 10), max_history: int = 50, denominator: str = "max_history") -> DataFrame:
    """The full test bundle as (metric, value, n_used)."""
    return summarize(impression_metrics(scored, news, history, senti_cols, ks, max_history, denominator))


def validation_bundle(scored, news, history, senti_cols, ks=(5, 10), max_history=50) -> DataFrame:
    """Performance + sentiment metrics only."""
    per = impression_metrics(scored, news, history, senti_cols, ks, max_history, topics=False)
    keep = ["auc", "mrr"] + [f"ndcg@{k}" for k in ks]
    for c in senti_cols:
        keep += [f"senti_mrr_{c}"] + [f"senti@{k}_{c}" for k in ks]
    return summarize(per, keep)


def softmax(scored: DataFrame, col: str = SCORE, out: str = "prob") -> DataFrame:
    """softmax of the scores inside each impression (window, no collect)."""
    w = _w()
    e = F.exp(F.col(col) - F.max(col).over(w))
    return scored.withColumn(out, e / F.sum(e).over(w))


def first_impressions(per_imp: DataFrame, n: int) -> DataFrame:
    """Restrict to the first ``n`` impressions by id (the feature is the limit)."""
    return per_imp.orderBy(IMP).limit(n)
