"""Bradley-Terry preferences, scripted teachers, soft targets and losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from segmentry.functions.draws import uniform


def bt_probability(r1: Column, r2: Column) -> Column:
    """P(segment 1 is preferred), stable for large differences."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(r2 - r1))


def bt_entropy(r1: Column, r2: Column) -> Column:
    """Entropy of the preference, in nats."""
    return F.abs(sum((F.when(p > 0, p * F.log(p)).otherwise(0.0) for p in (bt_probability(r1, r2), bt_probability(r2, r1))), F.lit(0.0)))


def rational_label(g1: Column, g2: Column) -> Column:
    """1 if the second return is larger, else 0."""
    return F.when(g1 < g2, 1).otherwise(0)


def teacher_label(g1: Column, g2: Column, sum1: Column, sum2: Column, pair: Column, beta: float = -1.0, eps_mistake: float = 0.0, thres_equal: Column | float = 0.0, seed: int = 0) -> Column:
    """0, 1 or -1: rational, or drawn by a softmax of strength beta (rational if it is not above 0); flipped at a rate; last, -1 where plain sums hardly differ."""
    label = rational_label(g1, g2)
    if beta > 0:
        label = F.when(uniform(f"{seed}|bernoulli", pair) < bt_probability(g2 * beta, g1 * beta), 1).otherwise(0)
    if eps_mistake > 0:
        label = F.when(uniform(f"{seed}|mistake", pair) < eps_mistake, 1 - label).otherwise(label)
    return F.when(F.abs(sum1 - sum2) < thres_equal, -1).otherwise(label)


def soft_target(label: Column, margin: float = 0.0) -> Column:
    """[share of segment 1, share of segment 2]; -1 is undecided."""
    second = F.when(label == -1, 0.5).otherwise(label.cast("double") * (1 - 2 * margin) + margin)
    return F.array(F.lit(1.0) - second, second)


def softplus(x: Column) -> Column:
    """log(1 + exp(x)), finite for all finite x."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def soft_loss(target: Column, r1: Column, r2: Column) -> Column:
    """Cross entropy of a soft target."""
    return target[0] * softplus(r2 - r1) + target[1] * softplus(r1 - r2)


def preference_loss(label: Column, r1: Column, r2: Column) -> Column:
    """Cross entropy of a label 0 or 1."""
    return softplus(F.when(label == 0, r2 - r1).otherwise(r1 - r2))


def score_loss(predicted: Column, score: Column) -> Column:
    return (predicted - score) * (predicted - score)


def match_probability(no: Column, yes: Column) -> Column:
    """That an image and a text match: the share of `yes` in the softmax of two logits."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(no - yes))


def embedding_label(score1: Column, score2: Column) -> Column:
    """0 if the first image is nearer to the goal, 1 if the second is, -1 if neither."""
    return F.when(score1 > score2, 0).when(score1 < score2, 1).otherwise(-1)
