"""Truncated path signatures of piecewise-linear paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def signature_sql(paths: DataFrame, by: str, order: list, channels: list[str], depth: int = 2) -> DataFrame:
    """Levels 0 to ``depth`` (at most 3) as columns s, s_i, s_ij, s_ijk by window sums (for few channels).

    With d the increments and a the path since its start before a step, Chen's identity gives
    S1 = sum d; S2 = sum (a d + d d / 2); S3 = sum (P2 d + a d d / 2 + d d d / 6), P2 the second level so far."""
    w = Window.partitionBy(by).orderBy(*order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    df = paths
    for c in channels:
        df = df.withColumn(f"d_{c}", F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0)))
    for c in channels:
        df = df.withColumn(f"a_{c}", F.coalesce(F.sum(f"d_{c}").over(before), F.lit(0.0)))
    second = {(i, j): F.col(f"a_{i}") * F.col(f"d_{j}") + F.col(f"d_{i}") * F.col(f"d_{j}") / 2 for i in channels for j in channels}
    out = [F.sum(f"d_{i}").alias(f"s_{i}") for i in channels]
    if depth >= 2:
        out += [F.sum(x).alias(f"s_{i}_{j}") for (i, j), x in second.items()]
    if depth >= 3:
        for (i, j), x in second.items():
            df = df.withColumn(f"p_{i}_{j}", F.coalesce(F.sum(x).over(before), F.lit(0.0)))
        out += [
            F.sum(F.col(f"p_{i}_{j}") * F.col(f"d_{k}") + F.col(f"a_{i}") * F.col(f"d_{j}") * F.col(f"d_{k}") / 2 + F.col(f"d_{i}") * F.col(f"d_{j}") * F.col(f"d_{k}") / 6).alias(f"s_{i}_{j}_{k}")
            for i, j in second
            for k in channels
        ]
    return df.groupBy(by).agg(F.lit(1.0).alias("s"), *out)


def signature_array(path: np.ndarray, depth: int) -> np.ndarray:
    """Levels 0 to ``depth`` in lexicographic order, 1 + d + d^2 + ... values."""
    steps = np.diff(path, axis=0)
    d = path.shape[1]
    levels = [np.ones(1)] + [np.zeros(d**k) for k in range(1, depth + 1)]
    for step in steps:
        power = [np.ones(1)]
        for k in range(1, depth + 1):
            power.append(np.outer(power[-1], step).ravel() / k)
        levels = [sum(np.outer(levels[i], power[k - i]).ravel() for i in range(k + 1)) for k in range(depth + 1)]
    return np.concatenate(levels)


def checked_signature(path: np.ndarray, depth: int) -> tuple[np.ndarray | None, str | None]:
    """The signature, or the reason why there is none: column 0 is time and runs from 0 to 1."""
    if path.ndim != 2 or len(path) < depth + 1:
        return None, "too_few_rows"
    if not np.isfinite(path).all():
        return None, "not_finite"
    time = path[:, 0]
    if abs(time[0]) > 1e-6 or abs(time[-1] - 1) > 1e-6 or (np.diff(time) < 0).any():
        return None, "time_not_monotone"
    return signature_array(path, depth), None


def signatures(paths: DataFrame, channels: list[str], depth: int, by: str = "track_id", order: str = "t") -> DataFrame:
    """(by, signature, reason_code): one row per path, failures apart by reason; one path is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        path = pdf.sort_values(order)[channels].to_numpy(np.float64)
        value, reason = checked_signature(path, depth)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "signature": [None if value is None else value.tolist()], "reason_code": [reason]})

    return paths.select(by, order, *channels).groupBy(by).applyInPandas(run, f"{by} string, signature array<double>, reason_code string")


def arm_positions(channels: int, subset: list[int], depth: int) -> list[int]:
    """Where a subset's coordinates stand in the signature of all channels, so that only the largest
    signature is ever computed."""
    out, start, words = [0], 1, [0]
    for level in range(1, depth + 1):
        words = [w * channels + c for w in words for c in subset]
        out += [start + w for w in words]
        start += channels**level
    return out


def project_arm(signature, positions: list[int]):
    return F.transform(F.array(*(F.lit(p) for p in positions)), lambda p: F.element_at(signature, p + 1))
