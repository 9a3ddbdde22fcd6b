"""Overlapping line windows, native and without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LIMITS
from ..functions.text import is_blank, line_array


def line_windows(files: DataFrame, size: int = LIMITS.window_lines, overlap: int = LIMITS.window_overlap) -> DataFrame:
    """One row per window that is not blank, for files with file_path and content; other columns are kept.

    Each window carries only its own lines into the explode, so a long file costs its length times size / step, not its square.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    kept = [c for c in files.columns if c != "content"]
    n = F.size("lines")
    starts = F.sequence(F.lit(0), (F.ceil(F.greatest(n - size, F.lit(0)) / step) * step).cast("int"), F.lit(step))
    window = F.transform(starts, lambda s: F.struct((s + 1).alias("start_line"), F.least(s + size, n).alias("end_line"), F.array_join(F.slice("lines", s + 1, F.lit(size)), "\n").alias("content")))
    rows = files.where("content IS NOT NULL").withColumn("lines", line_array(F.col("content"))).where(n > 0)
    out = rows.select(*kept, F.explode(window).alias("w")).select(*kept, "w.*").where(~is_blank(F.col("content")))
    chunk_id = F.concat(F.col("file_path"), F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    return out.withColumns({"chunk_id": chunk_id, "symbol_name": F.lit(None).cast("string"), "symbol_type": F.lit(None).cast("string")})


def chunk_totals(chunks: DataFrame) -> DataFrame:
    n = F.col("end_line") - F.col("start_line") + 1
    return chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(n), F.lit(0)).alias("total_lines"), F.coalesce(F.round(F.avg(n), 1), F.lit(0.0)).alias("average_lines"), F.countDistinct("owner", "name", "file_path").alias("files"))
