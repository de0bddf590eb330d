"""Logs of training runs in their present and older layouts: a folder of arrays, told apart by name and width."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .slabs import slabs

# Endings of log files, and the columns of a kind's present layout. The first column, the step, is missing in older ones.
KINDS = {"timeline": "timeline", "history": "history", "errors": "errors", "ErrorTimeline": "errors"}
COLUMNS = {
    "timeline": ("step", "time", "nll", "nll_smooth", "label_mean"),
    "history": ("step", "time", "train_loss", "valid_loss", "loss_gain", "train_error", "valid_error"),
    "errors": ("step", "time", "train_error", "valid_error"),
}


def read_logs(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(run, row, and the columns of kind) of all runs' logs of a kind under path. In files of the older layout, narrower by one, a row's number is its step; other widths are
    an error when such a row is read."""
    if kind not in COLUMNS:
        raise ValueError(f"kind must be one of {', '.join(COLUMNS)}")
    names = COLUMNS[kind]
    ending = F.substring_index("name", ".", -1)
    rows = slabs(spark, path).where(ending.isin([k for k, v in KINDS.items() if v == kind]))
    width = F.size("values")
    values = F.when(width == len(names), F.col("values")).when(width == len(names) - 1, F.concat(F.array(F.col("z").cast("double")), F.col("values")))
    values = F.coalesce(values, F.raise_error(F.concat(F.col("file"), F.lit(": rows of "), width.cast("string"), F.lit(" columns"))).cast("array<double>"))
    run = F.regexp_replace("name", r"\.[^.]*$", "")
    out = rows.select(run.alias("run"), F.col("z").cast("long").alias("row"), values.alias("v"))
    return out.select("run", "row", *(F.col("v")[i].cast("long" if n == "step" else "double").alias(n) for i, n in enumerate(names)))
