"""Numeric kernels over steps: leaky and spiking cores, plasticity, chemistry. One step is DataFrame work; a whole run of a
small network is one task a variant, variants run side by side."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from axonlake.functions.arrays import activation
from axonlake.operators.order import few


def leaky_step(state: DataFrame, edges: DataFrame, drive: DataFrame, tau: float, dt: float = 1.0, kind: str = "tanh") -> DataFrame:
    """One step of v' = l v + a I, y = act(v), with l = exp(-dt / tau), a = -expm1(-dt / tau): state (id, v, y), edges (src, dst, weight), drive (id, input)."""
    from axonlake.operators.graph import sparse_step

    inside = sparse_step(edges, state.select("id", F.col("y").alias("value"))).withColumnRenamed("value", "inside")
    both = state.select("id", "v").join(inside, "id", "left").join(drive, "id", "left")
    current = F.coalesce("inside", F.lit(0.0)) + F.coalesce("input", F.lit(0.0))
    v = math.exp(-dt / tau) * F.col("v") - math.expm1(-dt / tau) * current
    return both.select("id", v.alias("v"), activation(v, kind).alias("y"))


def _matrix(edges: pd.DataFrame, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.searchsorted(ids, edges["src"]), np.searchsorted(ids, edges["dst"]), edges["weight"].to_numpy(float)


def leaky_run(variants: DataFrame, nodes: list[int], drive: dict[int, float], steps: int, tau: float, dt: float = 1.0) -> DataFrame:
    """(variant, step, id, v, y) of a run with tanh: variants (variant, src, dst, weight); a variant must fit a task."""
    ids, keep, gain = np.array(sorted(nodes)), math.exp(-dt / tau), -math.expm1(-dt / tau)
    given = np.array([drive.get(int(i), 0.0) for i in ids])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        src, dst, w = _matrix(group, ids)
        v, y, out = np.zeros(len(ids)), np.zeros(len(ids)), []
        for t in range(steps):
            current = given + np.bincount(dst, w * y[src], len(ids))
            v = keep * v + gain * current
            y = np.tanh(v)
            out.append(pd.DataFrame({"variant": group["variant"].iloc[0], "step": t, "id": ids, "v": v, "y": y}))
        return pd.concat(out)

    return variants.groupBy("variant").applyInPandas(run, "variant long, step long, id long, v double, y double")


def lif_run(variants: DataFrame, nodes: list[int], drive: dict[int, float], steps: int, tau: float = 10.0, threshold: float = 1.0, reset: float = 0.0, refractory: int = 2, trace_tau: float = 5.0, clamp: dict[int, tuple[int, int, str]] | None = None) -> DataFrame:
    """(variant, step, id, v, spike, trace) of leaky integrate-and-fire nodes: reset and refractory steps after a spike, a decaying synaptic trace.

    clamp: id -> (first step, end step, `silence` or `force`).
    """
    ids, keep, fade = np.array(sorted(nodes)), math.exp(-1 / tau), math.exp(-1 / trace_tau)
    given = np.array([drive.get(int(i), 0.0) for i in ids])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        src, dst, w = _matrix(group, ids)
        v, trace, rest, out = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), int), []
        for t in range(steps):
            current = given + np.bincount(dst, w * trace[src], len(ids))
            free = rest == 0
            v = np.where(free, keep * v + (1 - keep) * current, reset)
            spike = free & (v >= threshold)
            for node, (first, end, what) in (clamp or {}).items():
                if first <= t < end:
                    spike[ids == node] = what == "force"
            v = np.where(spike, reset, v)
            rest = np.where(spike, refractory, np.maximum(rest - 1, 0))
            trace = fade * trace + spike
            out.append(pd.DataFrame({"variant": group["variant"].iloc[0], "step": t, "id": ids, "v": v, "spike": spike.astype("int64"), "trace": trace}))
        return pd.concat(out)

    return variants.groupBy("variant").applyInPandas(run, "variant long, step long, id long, v double, spike long, trace double")


def hebbian_step(edges: DataFrame, activity: DataFrame, rate: float, decay: float, low: float, high: float) -> DataFrame:
    """edges (src, dst, weight, eligibility) after one step: eligibility decays and gains pre * post; weights move by rate * eligibility within [low, high]."""
    pre, post = activity.select(F.col("id").alias("src"), F.col("y").alias("pre")), activity.select(F.col("id").alias("dst"), F.col("y").alias("post"))
    both = edges.join(pre, "src", "left").join(post, "dst", "left")
    e = decay * F.col("eligibility") + F.coalesce(F.col("pre") * F.col("post"), F.lit(0.0))
    return both.select("src", "dst", F.greatest(F.lit(low), F.least(F.lit(high), F.col("weight") + rate * e)).alias("weight"), e.alias("eligibility"))


def stdp_step(edges: DataFrame, nodes: DataFrame, plus: float, minus: float, low: float, high: float) -> DataFrame:
    """edges after one step: + plus * trace of the source where the target spikes, - minus * trace of the target where the source spikes. nodes (id, spike, trace)."""
    side = lambda end, p: nodes.select(F.col("id").alias(end), F.col("spike").alias(f"{p}_spike"), F.col("trace").alias(f"{p}_trace"))
    both = edges.join(side("src", "pre"), "src", "left").join(side("dst", "post"), "dst", "left")
    d = plus * F.coalesce(F.col("pre_trace") * F.col("post_spike"), F.lit(0.0)) - minus * F.coalesce(F.col("post_trace") * F.col("pre_spike"), F.lit(0.0))
    return both.select("src", "dst", F.greatest(F.lit(low), F.least(F.lit(high), F.col("weight") + d)).alias("weight"))


def regional_step(regions: DataFrame, transport: DataFrame, decay: float) -> DataFrame:
    """Concentrations (region, concentration, release) after decay and release, then moved by transport (source, target, share)."""
    after = regions.select(F.col("region").alias("source"), (F.col("concentration") * decay + F.col("release")).alias("c"))
    return after.join(transport, "source").groupBy(F.col("target").alias("region")).agg(F.sum(F.col("c") * F.col("share")).alias("concentration"))


def occupancy(receptors: DataFrame, regions: DataFrame) -> DataFrame:
    """Receptors (cell, region, half, power, status) with occupancy: 0 for unresponsive ones, null for unknown, the Hill value else; `assumed` marks hypothesized ones."""
    both = receptors.join(regions.select("region", "concentration"), "region", "left")
    z = F.col("power") * (F.log("concentration") - F.log("half"))
    value = F.when(F.col("concentration") <= 0, 0.0).otherwise(1 / (1 + F.exp(-z)))
    return both.withColumns({"occupancy": F.when(F.col("status") == "unresponsive", 0.0).when(F.col("status") == "unknown", None).otherwise(value), "assumed": F.col("status") == "hypothesized"})


def effects(occupied: DataFrame, low: float = 0.0, high: float = 4.0, mix: str = "sum") -> DataFrame:
    """For each cell the gain 1 + sum (or max) of strength * occupancy, clamped, and whether it was."""
    part = F.col("strength") * F.coalesce("occupancy", F.lit(0.0))
    raw = 1 + (F.sum(part) if mix == "sum" else F.max(part))
    return occupied.groupBy("cell").agg(raw.alias("raw")).select("cell", F.greatest(F.lit(low), F.least(F.lit(high), F.col("raw"))).alias("gain"), ((F.col("raw") < low) | (F.col("raw") > high)).alias("clamped"))


def consolidation_step(edges: DataFrame, rate: float, retain: float, gate: Column) -> DataFrame:
    """slow += rate * plastic and plastic *= retain where the gate is open."""
    return edges.withColumns({"slow": F.when(gate, F.col("slow") + rate * F.col("plastic")).otherwise(F.col("slow")), "plastic": F.when(gate, F.col("plastic") * retain).otherwise(F.col("plastic"))})


def injected(targets: DataFrame, stimulus: DataFrame) -> DataFrame:
    """Input of each node: the sum of gain * value over its channels. targets (id, channel, gain), stimulus (step, channel, value)."""
    return targets.join(stimulus, "channel").groupBy("step", "id").agg(F.sum(F.col("gain") * F.col("value")).alias("input"))


def intervened(trace: DataFrame, rules: DataFrame) -> DataFrame:
    """trace (id, step, v) with the value of the last rule (id, low, high, value, ord) whose steps [low, high) hold it."""
    met = trace.join(few(rules), "id").where((F.col("step") >= F.col("low")) & (F.col("step") < F.col("high")))  # rules are declared, so few
    best = met.groupBy("id", "step").agg(F.max_by("value", "ord").alias("__v"))
    return trace.join(best, ["id", "step"], "left").withColumn("v", F.coalesce("__v", "v")).drop("__v")


def log_mel(frames: DataFrame, rate: int, bands: int, column: str = "frames") -> DataFrame:
    """frames (arrays of samples) with `mel`: log energies of triangular mel bands of each frame's Hann-windowed spectrum."""

    @F.pandas_udf("array<array<double>>")
    def mel(batch: pd.Series) -> pd.Series:
        out = []
        for own in batch:
            x = np.array([np.asarray(f, float) for f in own]) if len(own) else np.zeros((0, 2))
            n = x.shape[1]
            power = np.abs(np.fft.rfft(x * np.hanning(n), axis=1)) ** 2
            hz = lambda m: 700 * (10 ** (m / 2595) - 1)
            edge = hz(np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2))
            f = np.fft.rfftfreq(n, 1 / rate)
            bank = np.maximum(0, np.minimum((f - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None], (edge[2:, None] - f) / (edge[2:] - edge[1:-1])[:, None]))
            out.append(np.log(power @ bank.T + 1e-10).tolist())
        return pd.Series(out)

    return frames.withColumn("mel", mel(column))


def ctc_loss(rows: DataFrame, logits: str = "logits", labels: str = "labels") -> DataFrame:
    """rows with `loss`: negative log-likelihood of the labels over all alignments (blank 0), by the forward recursion; infinite if none fits."""

    @F.pandas_udf("double")
    def loss(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x = np.array([np.asarray(f, float) for f in x])
            x = x - x.max(axis=1, keepdims=True)
            x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
            ext = [0]
            for c in y:
                ext += [int(c), 0]
            alpha = np.full(len(ext), -np.inf)
            alpha[: min(2, len(ext))] = [x[0, c] for c in ext[:2]]
            for t in range(1, len(x)):
                prev = alpha
                alpha = prev.copy()
                alpha[1:] = np.logaddexp(alpha[1:], prev[:-1])
                for s in range(2, len(ext)):
                    if ext[s] and ext[s] != ext[s - 2]:
                        alpha[s] = np.logaddexp(alpha[s], prev[s - 2])
                alpha = alpha + x[t, ext]
            out.append(float(-np.logaddexp.reduce(alpha[-2:])))
        return pd.Series(out)

    return rows.withColumn("loss", loss(logits, labels))
