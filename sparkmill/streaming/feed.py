"""An extension: triage of scores as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.triage import decide


def triage_feed(events: DataFrame, time: str = "ts", key: str = "event_id", p: str = "p", late: str = "10 minutes") -> DataFrame:
    """A stream of scored rows with decisions; repeats of a key within the watermark are dropped, so state is bounded."""
    return decide(events.withWatermark(time, late).dropDuplicatesWithinWatermark([key]), F.col(p))
