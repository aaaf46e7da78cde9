"""Progress of runs: counts observed while rows are written, rate, time left, and what to do between steps."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def rate(done: Column, elapsed: Column) -> Column:
    """Units a second; 0 before any time has passed."""
    return F.when(elapsed > 0, done / elapsed).otherwise(F.lit(0.0))


def time_left(done: Column, total: Column, elapsed: Column) -> Column:
    """Seconds to go at the rate so far; null where nothing tells."""
    return F.when(rate(done, elapsed) > 0, (total - done) / rate(done, elapsed))


def progress_log(finished: DataFrame, key: str, at: str, order: list[str]) -> DataFrame:
    """``finished``, a row for each unit of the runs ``key`` and when it was done, with done, total, rate and eta.

    Units are in order of ``at``, then ``order``; time counts from a run's first unit. ``eta`` is null while unknown.
    """
    run = Window.partitionBy(key)
    so_far = run.orderBy(at, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done, total = F.count("*").over(so_far), F.count("*").over(run)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    elapsed = (micros - F.min(micros).over(run)) / 1e6
    held = finished.withColumns({"done": done, "total": total, "_elapsed": elapsed})
    return held.select(*finished.columns, "done", "total", rate(F.col("done"), F.col("_elapsed")).alias("rate"), time_left(F.col("done"), F.col("total"), F.col("_elapsed")).alias("eta"))


@dataclass
class Progress:
    """Tells ``callback`` after every step how far a run of ``total`` units is; a callback that fails is logged and no more."""

    total: int
    callback: Callable[[dict], None] | None = None
    clock: Callable[[], float] = time.monotonic
    done: int = 0
    began: float = field(init=False)

    def __post_init__(self) -> None:
        self.began = self.clock()

    def watched(self, df: DataFrame, **counts: Column) -> tuple[DataFrame, Observation]:
        """``df``, whose ``units`` and ``counts`` are known as soon as an action has gone through it."""
        seen = Observation()
        return df.observe(seen, F.count(F.lit(1)).alias("units"), *[c.alias(n) for n, c in counts.items()]), seen

    def tell(self, units: int, **more) -> dict:
        """Add ``units`` done and report."""
        self.done += units
        elapsed = self.clock() - self.began
        speed = self.done / elapsed if elapsed > 0 else 0.0
        row = {"done": self.done, "total": self.total, "rate": speed, "eta": (self.total - self.done) / speed if speed > 0 else None, **more}
        if self.callback is not None:
            try:
                self.callback(row)
            except Exception:
                log.warning("the progress callback failed", exc_info=True)
        return row
