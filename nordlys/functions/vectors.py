"""Array arithmetic on scores and probabilities, all inside the JVM.

Arrays hold one value a label.  A null array gives null; ``argmax`` takes the
first of equal maxima.  ``let`` binds a value once, so that inner lambdas don't
evaluate it for each element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.transform(F.array(value), body)[0]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    shifted = let(F.array_max(z), lambda m: F.transform(z, lambda x: F.exp((x.cast("double") - m.cast("double")) / t)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def log_softmax(z: Column, temperature: Column | float = 1.0) -> Column:
    return F.transform(softmax(z, temperature), lambda p: F.log(p))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x.cast("double")))


def argmax(a: Column) -> Column:
    """Index from 0 of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def logit_correction(z: Column, weights: Column, strength: float) -> Column:
    """``z - strength * ln(weight)``; the strength lies in [0, 1], weights are positive."""
    if not 0 <= strength <= 1:
        raise ValueError("the strength lies between 0 and 1")
    return F.zip_with(z, weights, lambda a, w: a.cast("double") - strength * F.log(w.cast("double")))


def label_scores(z: Column, multi: bool) -> Column:
    """Exclusive labels: softmax.  Others: none of them, then each one's own probability."""
    if not multi:
        return softmax(z)
    return let(F.transform(z, sigmoid), lambda p: F.concat(F.array(F.aggregate(p, F.lit(1.0), lambda a, x: a * (1 - x))), p))


def hard_decode(z: Column, multi: bool) -> Column:
    """Active labels: exclusive ones by argmax, others where the logit is positive, the first label iff none is."""
    if not multi:
        return let(argmax(z), lambda k: F.transform(z, lambda _, i: i == k))
    return let(F.transform(z, lambda x: x > 0), lambda on: F.concat(F.array(~F.exists(on, lambda b: b)), on))


def tagged_values(p: Column, values: Column, multi: bool) -> Column:
    """(values, confidence) of a feature at run time: several above one half with the least of them, or the best one.

    ``values`` names the labels without the empty one; exclusive probabilities have it first.
    """
    if multi:
        picked = F.filter(F.arrays_zip(p.alias("p"), values.alias("v")), lambda x: x["p"] > 0.5)
        return let(picked, lambda s: F.struct(F.transform(s, lambda x: x["v"]).alias("values"), F.array_min(F.transform(s, lambda x: x["p"])).cast("double").alias("confidence")))
    return let(argmax(p), lambda k: F.struct(F.when(k > 0, F.array(F.get(values, k - 1))).otherwise(F.array().cast("array<string>")).alias("values"), F.array_max(p).cast("double").alias("confidence")))


def silver_choice(p: Column, multi: bool) -> Column:
    """(active labels, confidence) of silver data: from one half on, with the least sure of all labels.

    Several values have the label for none before them, active iff no other is.
    """
    if multi:
        on = let(F.transform(p, lambda x: x >= 0.5), lambda some: F.concat(F.array(~F.exists(some, lambda b: b)), some))
        sure = F.array_min(F.transform(p, lambda x: F.when(x >= 0.5, x).otherwise(1 - x)))
    else:
        on = let(argmax(p), lambda k: F.transform(p, lambda _, i: i == k))
        sure = F.array_max(p)
    return F.struct(on.alias("active"), sure.cast("double").alias("confidence"))


def top_k(ids: Column, p: Column, k: int) -> Column:
    """The k likeliest (id, probability), likeliest first, lower ids first among equals."""
    pairs = F.transform(F.arrays_zip(ids.alias("id"), p.alias("p")), lambda x: F.struct((-x["p"]).alias("n"), x["id"].alias("id"), x["p"].alias("p")))
    return F.transform(F.slice(F.array_sort(pairs), 1, k), lambda x: F.struct(x["id"].alias("id"), x["p"].alias("p")))


def rank_of(scores: Column, label: Column) -> Column:
    """1 + how many scores lie above the label's (labels count from 0)."""
    return let(F.get(scores, label), lambda gold: (1 + F.size(F.filter(scores, lambda s: s > gold))).cast("int"))


def cross_entropy(z: Column, label: Column, temperature: Column | float = 1.0) -> Column:
    return -F.get(log_softmax(z, temperature), label)


def binary_cross_entropy(z: Column, targets: Column, temperature: Column | float = 1.0) -> Column:
    """Mean over the labels, in the form that never overflows."""
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    each = F.zip_with(z, targets, lambda x, y: F.greatest(x / t, F.lit(0.0)) - F.when(y, x / t).otherwise(F.lit(0.0)) + F.log1p(F.exp(-F.abs(x / t))))
    return total(each) / F.size(z)


def kl_divergence(student: Column, teacher: Column, temperature: float) -> Column:
    """Distillation: KL(teacher || student) of softened scores, times the squared temperature."""
    return let(softmax(teacher, temperature), lambda p: let(log_softmax(student, temperature), lambda q: total(F.zip_with(p, q, lambda a, b: F.when(a > 0, a * (F.log(a) - b)).otherwise(F.lit(0.0))))) ) * (temperature**2)


def decoupled_kl(student: Column, teacher: Column, label: Column, alpha: float, beta: float, temperature: float) -> Column:
    """Target and non-target parts of the divergence, weighted apart."""

    def parts(p: Column, q: Column) -> Column:
        pt, qt = F.get(p, label), F.get(q, label)
        binary = pt * F.log(pt / qt) + (1 - pt) * F.log((1 - pt) / (1 - qt))
        others = total(F.zip_with(F.transform(p, lambda x, i: F.when(i == label, F.lit(0.0)).otherwise(x / (1 - pt))), q, lambda a, b: F.when(a > 0, a * F.log(a * (1 - qt) / b)).otherwise(F.lit(0.0))))
        return (alpha * binary + beta * others) * (temperature**2)

    return let(softmax(teacher, temperature), lambda p: let(softmax(student, temperature), lambda q: parts(p, q)))


def soft_cross_entropy(z: Column, target: Column) -> Column:
    """Cross entropy of scores against a soft target."""
    return let(log_softmax(z), lambda q: -total(F.zip_with(target, q, lambda p, l: p.cast("double") * l)))


def sparse_soft_cross_entropy(z: Column, ids: Column, p: Column, floor: float = 1e-6) -> Column:
    """Against top-k targets, renormalised over the k (their sum is never taken under ``floor``)."""
    return let(log_softmax(z), lambda q: let(F.greatest(total(p), F.lit(floor)), lambda s: -total(F.zip_with(ids, p, lambda i, x: x.cast("double") / s * F.get(q, i)))))


def gated_refinement(z: Column, marginal: Column, gate: float, multi: bool, eps: float = 1e-6) -> Column:
    """``z + sigmoid(gate) * log(p)`` (logit for independent labels) with clamped marginals."""
    clamped = F.transform(marginal, lambda p: F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))
    evidence = F.transform(clamped, lambda p: F.log(p / (1 - p)) if multi else F.log(p))
    return F.zip_with(z, evidence, lambda a, b: a + sigmoid(F.lit(gate)) * b)


def learning_rate(step: Column, warmup: int, steps: int) -> Column:
    """Linear rise over the warm-up, then linear fall to zero, as a factor."""
    rise = step / F.lit(float(max(1, warmup)))
    fall = F.greatest(F.lit(0.0), (steps - step) / F.lit(float(max(1, steps - warmup))))
    return F.when(step < warmup, rise).otherwise(fall)


def mean_pool(vectors: Column) -> Column:
    """Element-wise mean of an array of vectors; null for none."""
    n = F.size(vectors)
    summed = F.aggregate(vectors, F.transform(F.get(vectors, 0), lambda x: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda a, b: a + b.cast("double")))
    return F.when(n > 0, F.transform(summed, lambda x: x / n))
