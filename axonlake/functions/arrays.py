"""Functions of array columns, within whole-stage evaluation; ties go to the first index."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(x: Column) -> Column:
    """exp(x - max) over its sum."""
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def log_softmax(x: Column) -> Column:
    top = F.array_max(x)
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - top))
    return F.transform(x, lambda v: v - top - F.log(total))


def argmax(x: Column) -> Column:
    """Index from 0 of the first largest element; null for an empty array."""
    return F.when(F.size(x) > 0, (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, b: a + b)


def cosine(x: Column, y: Column) -> Column:
    """Null if either has no length."""
    n = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(n > 0, dot(x, y) / n)


def gae(rewards: Column, values: Column, done: Column, last_value: Column, gamma: float, lam: float) -> Column:
    """Generalised advantages: delta + gamma * lambda * (1 - done) * the next one, from the end of a rollout."""
    n = F.size(rewards)
    at = lambda i: F.when(i == n - 1, last_value).otherwise(F.get(values, i + 1))
    keep = lambda i: 1.0 - F.get(done, i).cast("double")
    delta = lambda i: F.get(rewards, i) + gamma * at(i) * keep(i) - F.get(values, i)
    steps = F.when(n > 0, F.reverse(F.sequence(F.lit(0), n - 1))).otherwise(F.array().cast("array<int>"))
    zero = F.struct(F.lit(0.0).alias("last"), F.array().cast("array<double>").alias("out"))

    def step(acc, i):
        a = delta(i) + gamma * lam * keep(i) * acc["last"]
        return F.struct(a.alias("last"), F.array_append(acc["out"], a).alias("out"))

    return F.reverse(F.aggregate(steps, zero, step, lambda acc: acc["out"]))


def ctc_collapse(frames: Column, blank: int = 0) -> Column:
    """Greedy decoding: the best class of each frame, repeats collapsed, blanks dropped. frames: array of arrays."""
    best = F.transform(frames, argmax)
    kept = F.filter(best, lambda c, i: (i == 0) | (c != F.get(best, i - 1)))
    return F.filter(kept, lambda c: c != blank)


def discounted_kl(student: Column, teacher: Column, temperature: float) -> Column:
    """T^2 times the Kullback-Leibler divergence of softened distributions."""
    soft = lambda x: log_softmax(F.transform(x, lambda v: v / temperature))
    return temperature**2 * F.aggregate(F.zip_with(soft(teacher), soft(student), lambda t, s: F.exp(t) * (t - s)), F.lit(0.0), lambda a, b: a + b)


def hill(concentration: Column, half: float, power: float) -> Column:
    """Receptor occupancy in the log domain; nothing at no concentration."""
    z = power * (F.log(concentration) - math.log(half))
    return F.when(concentration <= 0, 0.0).otherwise(1 / (1 + F.exp(-z)))


def activation(x: Column, kind: str) -> Column:
    return {"identity": x, "relu": F.greatest(x, F.lit(0.0)), "tanh": F.tanh(x), "logistic": 1 / (1 + F.exp(-x)), "softsign": x / (1 + F.abs(x)), "softplus": F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))}[kind]


def l2(x: Column) -> Column:
    return F.sqrt(dot(x, x))


def frames(samples: Column, width: int, hop: int) -> Column:
    """Overlapping frames, 1 + (n - width) / hop of them, without padding."""
    n = F.size(samples)
    return F.when(n >= width, F.transform(F.sequence(F.lit(0), F.floor((n - width) / hop).cast("int")), lambda i: F.slice(samples, i * hop + 1, width))).otherwise(F.array().cast("array<array<double>>"))


def modality_vector(names: list[str], sizes: dict[str, int], values: Column) -> Column:
    """Concatenated values of the modalities of a map, zeros where one is missing, then a presence flag for each."""
    blocks = [F.coalesce(values[n], F.array_repeat(F.lit(0.0), sizes[n])) for n in names]
    return F.concat(*blocks, F.array(*(values[n].isNotNull().cast("double") for n in names)))
