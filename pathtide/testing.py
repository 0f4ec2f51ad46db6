"""Helpers of the tests and the SQL comparison."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession


def spark_session(partitions: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master("local[8]").appName("pathtide")
        .config("spark.sql.shuffle.partitions", str(partitions)).config("spark.default.parallelism", str(partitions)).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _cell(x):
    if isinstance(x, (list, tuple, np.ndarray)):
        return "[" + ", ".join(_cell(v) for v in x) + "]"
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x) or x is pd.NA:
        return "null"
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (float, np.floating)):
        return repr(round(float(x), 9) + 0.0)
    if isinstance(x, (int, np.integer)):
        return repr(float(x)) if abs(int(x)) < 2**53 else str(int(x))
    return str(x)


def canonical(df: pd.DataFrame) -> list[str]:
    """The rows as sorted strings, columns in the order of their names."""
    cols = sorted(df.columns)
    return sorted("|".join(_cell(v) for v in row) for row in df[cols].itertuples(index=False, name=None))
