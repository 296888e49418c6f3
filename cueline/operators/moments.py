"""Candidate moments of a recording from scene-cut times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.functions.text import safe_name
from cueline.functions.timecode import frame_name
from cueline.operators.intervals import thin
from cueline.storage import materialise

MODES = {"existing_highlight": (0.28, 2.0, 12.0), "full": (0.35, 8.0, 45.0)}


def edge_margin(duration: Column) -> Column:
    return F.greatest(F.lit(1.0), F.least(duration * 0.03, F.lit(20.0)))


def mode_parameters(media: DataFrame, n: int, mode: str = "mode", duration: str = "duration_seconds") -> DataFrame:
    """Append scene_threshold, spacing and margin by video mode and duration."""
    base = F.col(duration) / max(4 * n, 1)
    cut = F.col(mode) == "existing_highlight"
    clamp = lambda low, high: F.greatest(F.lit(low), F.least(base, F.lit(high)))
    (t1, a1, b1), (t2, a2, b2) = MODES["existing_highlight"], MODES["full"]
    return media.withColumns({"scene_threshold": F.when(cut, t1).otherwise(t2), "spacing": F.when(cut, clamp(a1, b1)).otherwise(clamp(a2, b2)), "margin": edge_margin(F.col(duration))})


def inside_margins(points: DataFrame, media: DataFrame, key: str = "media_id", at: str = "t") -> DataFrame:
    """Points that aren't within the margin of either end. ``media``: see :func:`mode_parameters`."""
    m = media.select(key, "duration_seconds", "margin", "spacing")
    return points.join(m, key).where((F.col(at) >= F.col("margin")) & (F.col(at) <= F.greatest("margin", F.col("duration_seconds") - F.col("margin"))))


def pick_spread(points: DataFrame, n: int, key: str = "media_id", at: str = "t") -> DataFrame:
    """At most ``n`` points spread evenly over a recording's sorted points; halves go to even places."""
    own = Window.partitionBy(key)
    rows = points.withColumn("__i", F.row_number().over(own.orderBy(at)) - 1).withColumn("__n", F.count("*").over(own))
    if n == 1:
        keep = F.col("__i") == F.expr("__n div 2")
    else:
        places = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / F.lit(n - 1)))
        keep = F.array_contains(places, F.col("__i").cast("double"))
    return rows.where((F.col("__n") <= n) | keep).drop("__i", "__n")


def fallback_points(media: DataFrame, n: int, key: str = "media_id") -> DataFrame:
    """(key, pos, t): ``n`` even points between the margins."""
    end = F.greatest("margin", F.col("duration_seconds") - F.col("margin"))
    step = (end - F.col("margin")) / (n + 1)
    points = F.array((F.col("margin") + end) / 2) if n == 1 else F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.col("margin") + step * i)
    return media.select(key, F.posexplode(points).alias("pos", "t"))


def fill_moments(chosen: DataFrame, media: DataFrame, n: int, key: str = "media_id") -> DataFrame:
    """(key, t): the chosen points, filled up to ``n`` with fallback points.

    First those at least the spacing away from all kept, then any that aren't there yet.
    A fold over at most 2n points of a recording.
    """
    kept = chosen.groupBy(key).agg(F.array_sort(F.collect_list("t")).alias("kept"))
    spare = fallback_points(media, n, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "t"))), lambda x: x["t"]).alias("spare"))
    rows = media.select(key, "spacing").join(kept, key, "left").join(spare, key).withColumn("kept", F.coalesce("kept", F.array().cast("array<double>")))
    far = lambda acc, x: (F.size(acc) < n) & F.forall(acc, lambda k: F.abs(x - k) >= F.col("spacing"))
    new = lambda acc, x: (F.size(acc) < n) & ~F.array_contains(acc, x)
    fold = lambda start, test: F.aggregate("spare", start, lambda acc, x: F.when(test(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    full = fold(fold(F.col("kept"), far), new)
    return rows.select(key, F.explode(F.slice(full, 1, n)).alias("t"))


def with_provenance(moments: DataFrame, detected: DataFrame, key: str = "media_id", near: float = 0.001) -> DataFrame:
    """Append ``source``: scene_detection if a detected point is within ``near``, else uniform_fallback.

    A range join in bins of ``near``; each moment looks into its bin and the ones beside it.
    """
    place = lambda c: F.floor(F.col(c) / near)
    d = detected.select(key, F.col("t").alias("d"), place("t").alias("bin"))
    m = moments.withColumn("bin", F.explode(F.array(*[place("t") + i for i in (-1, 0, 1)])))
    hits = m.join(d, [key, "bin"]).where(F.abs(F.col("t") - F.col("d")) < near).select(key, "t").distinct().withColumn("__hit", F.lit(True))
    return moments.join(hits, [key, "t"], "left").withColumn("source", F.when(F.col("__hit"), "scene_detection").otherwise("uniform_fallback")).drop("__hit")


def select_moments(cuts: DataFrame, media: DataFrame, n: int = 5, key: str = "media_id") -> DataFrame:
    """(key, sequence, t, source) of ``n`` moments of every recording in ``media`` (key, duration_seconds, mode)."""
    if n < 1:
        raise ValueError("one moment at least")
    m = mode_parameters(media, n)
    inside = inside_margins(cuts.select(key, "t"), m, key)
    # the pick and the provenance both read these
    detected = materialise(thin(inside, "spacing", key), "detected")
    chosen = pick_spread(detected, n, key)
    filled = with_provenance(fill_moments(chosen, m, n, key), detected, key)
    return filled.select(key, F.row_number().over(Window.partitionBy(key).orderBy("t", "source")).alias("sequence"), "t", "source")


def frame_files(moments: DataFrame, media: DataFrame, key: str = "media_id", name: str = "video_name") -> DataFrame:
    """(key, sequence, folder, file_name) of each moment's frame; the folder is named by the recording. ``media``: key, name."""
    rows = moments.join(media.select(key, safe_name(name).alias("folder")), key)
    return rows.select(key, "sequence", "folder", frame_name("sequence", "source", "t").alias("file_name"))
