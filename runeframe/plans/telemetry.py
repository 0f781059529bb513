"""Times and row counts of queries, as they run."""

from __future__ import annotations

import resource
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


@dataclass
class Reading:
    """Milliseconds by the clock and of the driver's CPU (user, system), page faults of the driver, and rows."""

    name: str
    real_ms: float
    user_ms: float
    sys_ms: float
    faults: int
    rows: int

    def lines(self) -> list[str]:
        """The reading as lines '# key = value'."""
        return [f"# {k} = {v}" for k, v in vars(self).items()]


def timed(name: str, df: DataFrame) -> Reading:
    """Runs df to its end without keeping rows."""
    seen = Observation()
    before, began = resource.getrusage(resource.RUSAGE_SELF), time.time()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
    real, after = time.time() - began, resource.getrusage(resource.RUSAGE_SELF)
    return Reading(name, 1000 * real, 1000 * (after.ru_utime - before.ru_utime), 1000 * (after.ru_stime - before.ru_stime), after.ru_majflt - before.ru_majflt, seen.get["rows"])
