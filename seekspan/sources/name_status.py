"""Version-control change lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_name_status(lines: DataFrame, column: str = "line") -> DataFrame:
    """Tab-separated `status path [new path]` lines as columns; blank and one-column lines are dropped.

    `lines` carries repo_id next to the line.
    """
    line = F.regexp_replace(F.col(column), r"[ \r\n]+$", "")
    parts = F.split(line, "\t")
    return (
        lines.select("repo_id", parts.alias("p"))
        .filter(F.size("p") >= 2)
        .select(
            "repo_id",
            F.trim(F.col("p")[0]).alias("status"),
            F.col("p")[1].alias("file_path"),
            F.get("p", F.lit(2)).alias("new_path"),
        )
        .filter(F.col("status") != "")
    )
