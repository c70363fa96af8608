"""Counts of skipped rows by reason while a job or a stream runs, without another pass over the rows."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counts(reasons: tuple[str, ...], reason: str = "parse_error", sample: str | None = None) -> list[Column]:
    """rows, accepted, each reason's count, and for each reason one sample (the least text of a column, cut at 200 characters)."""
    out = [F.count(F.lit(1)).alias("rows"), F.count_if(F.col(reason).isNull()).alias("accepted"), *(F.count_if(F.col(reason) == r).alias(r) for r in reasons)]
    if sample:
        out += [F.min(F.when(F.col(reason) == r, F.substring(sample, 1, 200))).alias(f"sample of {r}") for r in reasons]
    return out


def observed(rows: DataFrame, name: str, reasons: tuple[str, ...], reason: str = "parse_error", sample: str | None = None) -> tuple[DataFrame, Observation]:
    """rows, and what is known about them once an action has run over them (Observation.get)."""
    seen = Observation(name)
    return rows.observe(seen, *counts(reasons, reason, sample)), seen


def observed_stream(rows: DataFrame, name: str, reasons: tuple[str, ...], reason: str = "parse_error", sample: str | None = None) -> DataFrame:
    """A stream whose micro-batches tell a Counts listener of the same name."""
    return rows.observe(name, *counts(reasons, reason, sample))


class Counts(StreamingQueryListener):
    """Adds up what micro-batches of observed streams tell, and keeps samples: the first of a reason, and then one each time its count has doubled."""

    def __init__(self, name: str):
        self.name, self.totals, self.samples, self.batches, self.lock, self.rate = name, Counter(), {}, 0, threading.Lock(), 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is not None:
            self.add(row.asDict(), event.progress.processedRowsPerSecond)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def add(self, told: dict, rate: float = 0.0) -> None:
        with self.lock:
            self.batches, self.rate = self.batches + 1, rate
            for k, n in told.items():
                if k.startswith("sample of "):
                    continue
                before = self.totals[k]
                self.totals[k] += n
                text = told.get(f"sample of {k}")
                if text is not None and self.totals[k].bit_length() > before.bit_length():
                    self.samples.setdefault(k, []).append(text)
