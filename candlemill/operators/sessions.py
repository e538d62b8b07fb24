"""Sessions of bars in the exchange's time zone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.zones import to_local


def in_zone(bars: DataFrame, zone: str = "exchange_timezone", start: str = "09:30:00", end: str = "16:00:00") -> DataFrame:
    """Adds local_start, trading_date, session_date, session_segment, session_key and time_of_day of instants (UTC)."""
    clock = F.date_format("local_start", "HH:mm:ss")
    segment = F.when(clock < start, "premarket").when(clock < end, "regular").otherwise("afterhours")
    out = bars.withColumn("local_start", to_local(F.col("bar_start"), F.col(zone)))
    out = out.withColumns({"trading_date": F.to_date("local_start"), "session_date": F.date_format("local_start", "yyyy-MM-dd"), "session_segment": segment, "time_of_day": F.date_format("local_start", "HH:mm")})
    return out.withColumn("session_key", F.concat_ws(":", "session_date", "session_segment"))
