"""Rules on ranked clip lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.text import strip, word_count


def check_rankings(clips: DataFrame, key: str = "list_id", longest: int = 24) -> DataFrame:
    """(key, clip_count, first_violation) of each list; null if it is valid.

    ``clips``: key, pos, video_path, rank, description. Two clips at least; .mp4 files;
    positive, unique ranks; descriptions of one word and ``longest`` characters. The first
    violation in clip order is told, within a clip in the order of these rules.
    """
    bare = strip(F.coalesce("description", F.lit("")))
    # a rank is repeated at its second clip and later ones
    nth = F.row_number().over(Window.partitionBy(key, "rank").orderBy("pos"))
    rows = clips.withColumn("__nth", nth)
    rule = (
        F.when(~F.lower(strip("video_path")).endswith(".mp4"), F.struct(F.lit(1).alias("no"), F.lit("not an mp4 file").alias("what")))
        .when(F.col("rank") <= 0, F.struct(F.lit(2).alias("no"), F.lit("rank is not positive").alias("what")))
        .when(F.col("__nth") > 1, F.struct(F.lit(3).alias("no"), F.lit("rank is used twice").alias("what")))
        .when(bare == "", F.struct(F.lit(4).alias("no"), F.lit("no description").alias("what")))
        .when(word_count(bare) != 1, F.struct(F.lit(5).alias("no"), F.lit("description is not one word").alias("what")))
        .when(F.length(bare) > longest, F.struct(F.lit(6).alias("no"), F.lit("description is too long").alias("what")))
    )
    by_list = rows.withColumn("r", rule).groupBy(key).agg(F.count("*").alias("clip_count"), F.min_by("r", F.when(F.col("r").isNotNull(), F.struct("pos", "r.no"))).alias("r"))
    return by_list.select(key, "clip_count", F.when(F.col("clip_count") < 2, "fewer than two clips").otherwise(F.col("r.what")).alias("first_violation"))


def countdown(clips: DataFrame, key: str = "list_id") -> DataFrame:
    """Append show_order: from the last rank to the first."""
    return clips.withColumn("show_order", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rank"), "pos")))
