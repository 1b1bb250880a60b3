"""Learned term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatsieve.config import DEFAULT_TERM_WEIGHT
from chatsieve.operators.ordered import apply_step, fold_steps, step

LOW, HIGH = 0.1, 1.0


def update_weights(weights: DataFrame, feedback: DataFrame, alpha: float = 0.05, order: str = "seq") -> DataFrame:
    """Weights after moderator feedback, taken in `order`: (kind, term, weight, n_feedback).

    Each entry moves the weight by alpha towards 1.0 (correct) or 0.1 (not), within
    [0.1, 1.0]. Terms without a weight start at 0.7; terms without feedback stay.
    """
    target = F.when(F.col("was_correct"), HIGH).otherwise(LOW)
    moves = fold_steps(feedback, ["kind", "term"], [order], step(1 - alpha, target * alpha, LOW, HIGH))
    joined = weights.select("kind", "term", "weight").join(moves, ["kind", "term"], "full")
    start = F.coalesce("weight", F.lit(DEFAULT_TERM_WEIGHT))
    return joined.select(
        "kind", "term",
        F.when(F.col("step").isNull(), start).otherwise(apply_step(start, F.col("step"))).alias("weight"),
        F.coalesce("n", F.lit(0)).alias("n_feedback"))


def reseed_weights(new_terms: DataFrame, weights: DataFrame) -> DataFrame:
    """Weights for a new lexicon version: learned ones kept for terms that still exist,
    the lexicon's own weight for new terms, removed terms dropped."""
    learned = weights.select("kind", "term", F.col("weight").alias("learned"))
    return new_terms.join(learned, ["kind", "term"], "left").select(
        "kind", "term", F.coalesce("learned", "weight", F.lit(DEFAULT_TERM_WEIGHT)).alias("weight"))
