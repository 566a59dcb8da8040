"""Training-loss reports over scored training rows (F8-F11) and lexicon sentiment (F2).

Training rows are the long form of D1: (imp_id, pos_news, slot, news_id, score), slot 0 being
the click.  Each row group is one click with its N negatives (bounded by N).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from impressa.functions.scalar import relu, sigmoid, valence_normalise
from impressa.functions.text import DEFAULT_TOKEN_PATTERN, tokenize
from impressa.operators.skew import lookup_join

ROW = ["imp_id", "pos_news"]

# Fixed values of the published valence rules: how much of a booster counts at one, two and three
# tokens before the word, and the factor of a negation.
BOOST_DECAY = (1.0, 0.95, 0.9)
NEGATION = -0.74


def cross_entropy_first(rows: DataFrame, score: str = "score", apply_sigmoid: bool = True) -> DataFrame:
    """F8 per training row: log(sum_c exp(y_c)) - y_click, y = sigmoid(score);
    ``apply_sigmoid=False`` for already-normalised scores."""
    y = sigmoid(score) if apply_sigmoid else F.col(score)
    r = rows.withColumn("_y", y)
    w = Window.partitionBy(*ROW)
    m = F.max("_y").over(w)
    r = r.withColumn("_lse", m + F.log(F.sum(F.exp(F.col("_y") - m)).over(w)))
    return r.where(F.col("slot") == 0).select(*ROW, (F.col("_lse") - F.col("_y")).alias("ce"))


def sentiment_mae(pred: DataFrame, s_hat: str = "s_hat", s: str = "s") -> DataFrame:
    """mean absolute error of a sentiment prediction."""
    return pred.agg(F.avg(F.abs(F.col(s_hat) - F.col(s))).alias("mae"))


def sentiment_diversity_loss(rows: DataFrame, s_mean: str = "s_mean", s_c: str = "s_c",
                             score: str = "score") -> DataFrame:
    """mean over candidates of relu(s_mean * s_c * sigmoid(score))."""
    return rows.agg(F.avg(relu(F.col(s_mean) * F.col(s_c) * sigmoid(score))).alias("div_loss"))


def loss_report(rows: DataFrame, pred: DataFrame, lam: float = 0.4, mu: float = 10.0) -> DataFrame:
    """(ce, mae, div_loss, total = ce + lam * mae + mu * div_loss) in one row.
    ``rows`` needs slot, score, s_c, s_mean; ``pred`` needs s_hat, s."""
    from impressa.operators.report import one_row
    ce = cross_entropy_first(rows).agg(F.avg("ce").alias("ce"))
    out = one_row(ce, sentiment_mae(pred), sentiment_diversity_loss(rows))
    return out.withColumn("total", F.col("ce") + F.lit(lam) * F.col("mae") + F.lit(mu) * F.col("div_loss"))


def lexicon_sentiment(df: DataFrame, row: str, text: str, lexicon: DataFrame, alpha: float = 15.0,
                      pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """F2 (re-aimed): summed valence of known tokens, normalised to [-1, 1] by x/sqrt(x^2+alpha).
    ``lexicon`` is a caller table (token, valence); it is broadcast when its estimated size is small."""
    toks = df.select(row, F.explode(tokenize(text, pattern)).alias("token"))
    hit = lookup_join(toks, lexicon.select("token", "valence"), ["token"])
    s = hit.groupBy(row).agg(F.sum("valence").alias("_x"))
    return df.select(row).join(s, row, "left").select(
        row, valence_normalise(F.coalesce(F.col("_x"), F.lit(0.0)), alpha).alias("sentiment"))


def modified_sentiment(df: DataFrame, row: str, text: str, lexicon: DataFrame, modifiers: DataFrame, alpha: float = 15.0,
                       decay: tuple[float, ...] = BOOST_DECAY, negation: float = NEGATION,
                       pattern: str = DEFAULT_TOKEN_PATTERN) -> DataFrame:
    """F2 with negations and boosters: (row, sentiment), ``row`` being unique.

    The valence of a known token is folded over the tokens before it, nearest first, as many as ``decay`` has
    entries: a booster adds its amount times the decay of its distance, towards the sign the valence has by
    then; a negation multiplies it by ``negation``.  A token that has a valence of its own modifies nothing.
    ``modifiers`` is a caller table (token, boost, negates), one row per token; a null boost is 0.  The tokens
    before are taken from the text's own array, so no window and no join by text is needed, and only known
    tokens meet the modifiers.  A text without known tokens has 0; null text likewise."""
    known = lexicon.select("token", "valence")
    own = modifiers.select("token", F.coalesce(F.col("boost").cast("double"), F.lit(0.0)).alias("boost"),
                           F.coalesce("negates", F.lit(False)).alias("negates")).join(known.select("token"), "token", "left_anti")
    toks = df.select(row, tokenize(text, pattern).alias("_t")).select(row, F.explode(F.transform("_t", lambda t, i: F.struct(
        t.alias("token"), *[F.get("_t", i - k).alias(f"_p{k}") for k in range(1, len(decay) + 1)]))).alias("x")).select(row, "x.*")
    hit = lookup_join(toks, known, ["token"])
    value = F.col("valence").cast("double")
    for k, weight in enumerate(decay, 1):
        mod = own.select(F.col("token").alias(f"_p{k}"), F.col("boost").alias(f"_b{k}"), F.col("negates").alias(f"_n{k}"))
        hit = lookup_join(hit, mod, [f"_p{k}"], "left")
        value = value + F.signum(value) * F.coalesce(F.col(f"_b{k}"), F.lit(0.0)) * F.lit(weight)
        hit = hit.withColumn("_v", value * F.when(F.col(f"_n{k}"), F.lit(negation)).otherwise(F.lit(1.0)))
        value = F.col("_v")
    s = hit.groupBy(row).agg(F.sum("_v").alias("_x"))
    return df.select(row).join(s, row, "left").select(
        row, valence_normalise(F.coalesce(F.col("_x"), F.lit(0.0)), alpha).alias("sentiment"))
