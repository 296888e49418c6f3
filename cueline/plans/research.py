"""Research on requests: results, names and terms, with a local fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cueline.operators import research as ops
from cueline.storage import materialise

WARNING = "no usable search results"


def research_requests(requests: DataFrame, raw_results: DataFrame, key: str = "request_id", name: str = "game_name") -> DataFrame:
    """(key, supplied_name, suggested_name, was_corrected, terminology, queries, internet_available, warning).

    ``requests``: key, name and, if there are any, video_type and episode_topic. A request
    without usable results keeps its name, gets the terms of its own words and the defaults,
    and a warning. The supplied name is as it was given where there are results, else cleaned.
    """
    # names, terms and availability all read these
    results = materialise(ops.dedupe_results(ops.normalise_results(raw_results, key), key), "results")
    names = materialise(ops.best_names(results, requests, key, name), "names")
    terms = ops.top_terms(ops.result_words(results, names, key), requests, key)
    local = ops.local_terms(requests, key, name).withColumnRenamed("terminology", "__local")
    found = results.select(key).distinct().withColumn("internet_available", F.lit(True))
    given = requests.select(key, F.coalesce(name, F.lit("")).alias("__given"))
    rows = names.join(terms, key).join(local, key).join(given, key).join(ops.request_queries(requests, key, name), key).join(found, key, "left")
    there = F.coalesce("internet_available", F.lit(False))
    return rows.select(
        key, F.when(there, F.col("__given")).otherwise(F.col("supplied_name")).alias("supplied_name"), "suggested_name", "was_corrected",
        F.when(there, F.col("terminology")).otherwise(F.col("__local")).alias("terminology"), "queries", there.alias("internet_available"), F.when(~there, F.lit(WARNING)).alias("warning"),
    )
