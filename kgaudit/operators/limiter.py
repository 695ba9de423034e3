"""A sliding-window rate limiter: exact admissions by key, and the audit of a window."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def admit(times: list[float], limit: int, window: float = 60.0, slack: float = 0.05, held: deque | None = None) -> list[float]:
    """When each request is admitted: at once if fewer than `limit` admissions lie in the last `window` seconds, else
    when the oldest of them expires, plus some slack. `held` has the admissions so far and is kept up."""
    held = deque() if held is None else held
    out, now = [], held[-1] if held else float("-inf")
    for t in times:
        now = max(now, t)
        while held and now - held[0] >= window:
            held.popleft()
        if len(held) >= limit:
            now = held[0] + window + slack
            while held and now - held[0] >= window:
                held.popleft()
        held.append(now)
        out.append(now)
    return out


def admissions(requests: DataFrame, limit: int, window: float = 60.0) -> DataFrame:
    """key, request_id, at, admitted, waited from requests (key, request_id, at in seconds). An admission depends on
    those before it, so a key is one task's work, in the order of time."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "request_id"], kind="stable")
        pdf["admitted"] = admit(pdf["at"].tolist(), limit, window)
        pdf["waited"] = pdf["admitted"] - pdf["at"]
        return pdf[["key", "request_id", "at", "admitted", "waited"]]

    return requests.select("key", "request_id", F.col("at").cast("double").alias("at")).groupBy("key").applyInPandas(run, f"key {requests.schema['key'].dataType.simpleString()}, request_id {requests.schema['request_id'].dataType.simpleString()}, at double, admitted double, waited double")


def trailing_counts(requests: DataFrame, window: int = 60) -> DataFrame:
    """With in_window: requests of the key in the `window` seconds up to and with this one."""
    w = Window.partitionBy("key").orderBy("at").rangeBetween(-window, 0)
    return requests.withColumn("in_window", F.count("*").over(w))
