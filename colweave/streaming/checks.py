"""The validators on a stream: they are row-local expressions, so a stream takes them as a table does."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colweave.functions.validators import conforms


def conforming_share(stream: DataFrame, time: str, value: str, datatype: str, display_format: str, every: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Share of conforming values in each window of event time; later rows than `late` are left out."""
    ok = conforms(value, datatype, display_format).cast("int")
    return stream.withWatermark(time, late).groupBy(F.window(time, every), datatype, display_format).agg(F.avg(ok).alias("share"), F.count("*").alias("n"))
