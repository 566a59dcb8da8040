"""The co-consumption ranker — learn NPMI on training histories, score evaluation
candidates by their best pair with the history, evaluate (M14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impressa.operators import cooccur as C
from impressa.operators import metrics as M
from impressa.operators import parse as P


def evaluate_npmi_scores(scores: DataFrame, min_valid_ratio: float = 0.1, ks=(5, 10)) -> DataFrame:
    """Keep impressions with enough non-zero scores (P14), rank (softmax is monotone, so the
    raw scores rank identically), and compute the performance bundle (metric, value, n_used)."""
    kept = P.min_valid_ratio(scores, min_valid_ratio)
    per = M.performance(kept, ks=ks)
    per = per.select("imp_id", "auc", "mrr", *[F.col(f"`ndcg@{k}`").alias(f"ndcg_at_{k}") for k in ks])
    return M.summarize(per, ["auc", "mrr"] + [f"ndcg_at_{k}" for k in ks])


def run(train_history: DataFrame, train_users: DataFrame, eval_candidates: DataFrame,
        eval_history: DataFrame, min_valid_ratio: float = 0.1) -> dict[str, DataFrame]:
    table = C.learn_npmi(train_history, train_users)
    scores = C.max_npmi_scores(eval_candidates, eval_history, table)
    return {"npmi": table, "scores": scores, "metrics": evaluate_npmi_scores(scores, min_valid_ratio)}
