"""Stored records with JSON columns: feedback and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_FIELDS = ("timestamp", "level", "logger", "message", "module", "function", "line")


def feedback_to_store(feedback: DataFrame) -> DataFrame:
    """Feedback with its aspects map as JSON text and its time as ISO text."""
    return feedback.withColumns({
        "aspects": F.to_json("aspects"), "ts": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
    })


def feedback_from_store(stored: DataFrame) -> DataFrame:
    return stored.withColumns({
        "aspects": F.from_json("aspects", "map<string,int>"), "ts": F.to_timestamp("ts"),
    })


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON log lines as base columns and a map of the other fields."""
    fields = F.from_json(column, "map<string,string>")
    rows = lines.withColumn("_f", fields)
    return rows.select(
        *[c for c in lines.columns if c != column], *[F.col("_f")[n].alias(n) for n in BASE_FIELDS],
        F.map_filter("_f", lambda k, v: ~k.isin(*BASE_FIELDS)).alias("extra"),
    )
