"""Citations of answers checked against the excerpts they may refer to, by interval containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import citations


def extracted(answers: DataFrame, key: str = "id", text: str = "answer") -> DataFrame:
    """(other columns, position, file_path, start_line, end_line), distinct per answer, in order of appearance from 0."""
    others = [c for c in answers.columns if c != text]
    return answers.select(*others, F.posexplode(citations(F.col(text))).alias("position", "c")).select(*others, "position", "c.*")


def verify(cited: DataFrame, hits: DataFrame, by: list[str]) -> DataFrame:
    """Status and the first containing excerpt of each citation.

    ``by`` are the columns beside file_path that scope a citation to its excerpts; hits hold by, file_path, start_line, end_line,
    point_id and rank. A range that runs backwards is never verified. One hash join on the path with the range as residual
    condition, then an aggregate: no excerpt list is gathered in one place.
    """
    keys = [*by, "file_path"]
    files = hits.groupBy(*keys).agg(F.lit(True).alias("known"))
    own = cited.columns
    h = hits.select(*[F.col(c).alias(f"h_{c}") for c in keys], F.col("start_line").alias("lo"), F.col("end_line").alias("hi"), "point_id", "rank")
    inside = (F.col("start_line") <= F.col("end_line")) & (F.col("lo") <= F.col("start_line")) & (F.col("end_line") <= F.col("hi"))
    for c in keys:
        inside = inside & (F.col(c) == F.col(f"h_{c}"))
    first = F.min(F.when(F.col("point_id").isNotNull(), F.struct("rank", "point_id")))
    found = cited.join(h, inside, "left").groupBy(*own).agg(first.alias("m"))
    status = F.when(F.col("m").isNotNull(), "verified").when(F.col("known"), "out_of_range").otherwise("unknown_file")
    return found.join(files, keys, "left").select(*own, F.col("m.point_id").alias("point_id"), status.alias("status"))


def unverified(checked: DataFrame, key: str = "id") -> DataFrame:
    return checked.groupBy(key).agg(F.count_if(F.col("status") != "verified").alias("unverified"), F.count("*").alias("citations"))
