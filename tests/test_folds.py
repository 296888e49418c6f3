"""Folds, rounds and the highlight run against plain loops, on long islands and many shared keys."""

import json
import random
import re
import time
from collections import Counter
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from cueline import fixtures as fx
from cueline import registry, storage
from cueline.functions.text import is_blank, strip
from cueline.operators import answers, captions, folds, intervals, packages, quantiles, ranks, research, scoring, signals, textclean
from cueline.operators.answers import Responder
from cueline.plans import highlights as plan
from cueline.sources import inputs, sinks

LONG = 100_000


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_one_island_of_many_rows(spark):
    """A recording without a pause is one island; its folds hold one open span."""
    df = spark.range(LONG).select(F.lit(1).cast("bigint").alias("media_id"), F.col("id").alias("seg_idx"), (F.col("id") * 1.0).alias("start"), (F.col("id") + 0.9).alias("end"))
    got = intervals.merge_gaps(df, 2.0, 20.0).agg(F.count("*"), F.min("chunk_idx"), F.max("chunk_idx"), F.max(F.col("end") - F.col("start"))).first()
    assert tuple(got)[:3] == (LONG // 20, 0, LONG // 20 - 1) and got[3] == pytest.approx(19.9)
    sc = df.select("media_id", F.col("seg_idx").alias("scene_idx"), (F.col("start") * 0.01).alias("start_seconds"), (F.col("start") * 0.01 + 0.01).alias("end_seconds"))
    short = intervals.merge_short(sc, 2.0)
    assert LONG / 202 < short.count() < LONG / 198
    points = df.select("media_id", (F.col("start") * 0.25).alias("t"))
    assert rows(intervals.thin(points, 5.0).agg(F.count("*"), F.max("t")), "count(1)", "max(t)") == [(LONG // 20, (LONG - 20) * 0.25)]
    clips = df.select("media_id", (F.col("seg_idx") + 1).cast("int").alias("rank"), (F.col("start") * 0.1).alias("start_seconds"), (F.col("start") * 0.1 + 50).alias("end_seconds"), (F.col("start") * 0.1 + 25).alias("middle"))
    kept = intervals.suppress_near_duplicates(clips).orderBy("rank").limit(3).collect()
    assert [r["rank"] for r in kept] == [1, 28, 55]


@pytest.mark.parametrize("held, handed", [(1 << 16, 8 << 20), (7, 20)])
def test_scene_texts_by_reference(spark, monkeypatch, held, handed):
    """The same texts as those of segments that carry theirs, and each is sent to a bucket once."""
    monkeypatch.setattr(intervals, "HELD_SEGMENTS", held)
    monkeypatch.setattr(intervals, "HANDED_BYTES", handed)
    texts = spark.createDataFrame([(i, None if i == 3 else "" if i == 4 else f"wört {i} " * i) for i in range(9)], "doc_id long, text string")
    refs = spark.range(600).select((F.col("id") % 5).alias("media_id"), F.floor(F.col("id") / 5).alias("seg_idx"), (F.floor(F.col("id") / 5) * 1.0).alias("start_seconds"), (F.floor(F.col("id") / 5) + 0.9).alias("end_seconds"), (F.col("id") * 7 % 11).alias("doc_id"))
    scenes = spark.range(60).select((F.col("id") % 6).alias("media_id"), F.floor(F.col("id") / 6).alias("scene_idx"), (F.floor(F.col("id") / 6) * 9.5).alias("start_seconds"), (F.floor(F.col("id") / 6) * 9.5 + 9).alias("end_seconds"))
    columns = [*scenes.columns, "transcript_text"]
    carried = refs.join(texts, "doc_id", "left").drop("doc_id").withColumn("text", F.coalesce("text", F.lit("")))
    want = sorted(rows(intervals.scene_texts(carried, scenes), *columns))
    found = intervals.referred_scene_texts(refs, texts, scenes, "doc_id")
    assert sorted(rows(found, *columns)) == want and len(want) == 60 and sum(t[-1] == "" for t in want) == 10
    assert sum(len(t[-1]) for t in want) > 5000


def _one_to_one(spark, n, doc_id):
    """Segments and scenes of the same times, in 5 recordings."""
    at = F.floor(F.col("id") / 5) * 1.0
    both = spark.range(n).select((F.col("id") % 5).alias("media_id"), F.floor(F.col("id") / 5).alias("n"), at.alias("start_seconds"), (at + 0.9).alias("end_seconds"), doc_id.alias("doc_id"))
    return both.withColumnRenamed("n", "seg_idx"), both.drop("doc_id").withColumnRenamed("n", "scene_idx")


def test_texts_of_scenes_with_one_segment_are_shuffled_once(spark, monkeypatch):
    """However many buckets their scenes would be dealt to."""
    monkeypatch.setattr(intervals, "HELD_SEGMENTS", 10)
    rng = random.Random(5)
    told = {i: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=5000)) for i in range(200)}
    texts = spark.createDataFrame(list(told.items()), "doc_id long, text string")
    # recording and number of a scene: its document
    refs, scenes = _one_to_one(spark, 800, F.col("id") * 7 % 200)
    written = lambda: spark._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = written()
    got = rows(intervals.referred_scene_texts(refs, texts, scenes, "doc_id"), "media_id", "scene_idx", "transcript_text")
    assert sorted(got) == sorted((i % 5, i // 5, told[i * 7 % 200]) for i in range(800))
    assert written() - before < 2 * 200 * 5000


def test_a_text_that_most_scenes_say_is_dealt_by_scene(spark, monkeypatch):
    monkeypatch.setattr(intervals, "HELD_SEGMENTS", 10)
    texts = spark.createDataFrame([(0, "the ring"), (1, "a bell"), (2, "")], "doc_id long, text string")
    refs, scenes = _one_to_one(spark, 300, F.when(F.col("id") % 100 < 97, 0).when(F.col("id") % 100 == 97, 1).when(F.col("id") % 100 == 98, 2))
    found = intervals.referred_scene_texts(refs, texts, scenes, "doc_id")
    assert Counter(t for (t,) in rows(found, "transcript_text")) == {"the ring": 291, "a bell": 3, "": 6}
    said = {(m, n): t for m, n, t in rows(found, "media_id", "scene_idx", "transcript_text")}
    assert len(said) == 300 and all(said[i % 5, i // 5] == ("the ring" if i % 100 < 97 else "a bell" if i % 100 == 97 else "") for i in range(300))


def test_what_is_told_of_a_text_is_worked_out_once(spark):
    """However many scenes of one segment say it; scenes without a text have what is told of an empty one."""
    texts = spark.createDataFrame([(0, "the  ring "), (1, "a bell rang"), (2, ""), (3, None)], "doc_id long, text string")
    refs, scenes = _one_to_one(spark, 400, F.when(F.col("id") < 380, F.col("id") % 5))
    refs = refs.unionByName(refs.where("seg_idx = 0").withColumn("seg_idx", F.lit(1000).cast("long")))
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def shout(text):
        seen.add(text != "")
        return None if text == "a bell rang" else text.upper() + "!"

    found = intervals.referred_scene_texts(refs, texts, scenes, "doc_id", told=lambda t: {"shout": shout(t)} | scoring.statistics_of(t))
    got = Counter(rows(found, "shout", "speech_character_count", "speech_word_count", "has_speech"))
    assert got == {("THE  RING !", 9, 2, True): 75, (None, 11, 3, True): 75, ("THE  RING  THE  RING !", 20, 4, True): 1, ("A BELL RANG A BELL RANG!", 23, 6, True): 1, ("!", 0, 0, False): 248}
    # two texts and two scenes of two segments
    assert seen.value == 2 + 2


def test_written_tables_leave_no_shuffle_files(spark):
    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").count("/shuffle_")
    before, set_to = files(), spark.conf.get(storage.CLEANUP)
    df = storage.materialise(spark.range(10000).groupBy((F.col("id") % 100).alias("k")).count(), "counts")
    for _ in range(50):
        if (left := files()) <= before:
            break
        time.sleep(0.2)
    assert left <= before and df.count() == 100 and spark.conf.get(storage.CLEANUP) == set_to
    storage.release(df)


@pytest.mark.parametrize("text", ["", " \t\n", "\u2003\u00a0", "\u200b", " a ", "\u00e9", "\x1c"])
def test_blank_is_what_strip_leaves_empty(spark, text):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(is_blank("t").alias("a"), (strip("t") == "").alias("b")).where("a = b").count() == 1


def test_transcripts_with_times_are_not_joined_to_their_chunks(spark):
    speech = spark.createDataFrame([(1, i, 3.0 * i, 3.0 * i + 1) for i in range(20)], "media_id long, seg_idx long, start double, end double")
    text = F.when(F.col("chunk_idx") % 2 == 0, F.lit("ring")).otherwise(F.lit(""))
    with_times = plan.transcripts(speech, lambda chunks: chunks.withColumn("text", text), gap=2.0, most=5.0)
    without = plan.transcripts(speech, lambda chunks: chunks.select("media_id", "chunk_idx", text.alias("text")), gap=2.0, most=5.0)
    assert sorted(with_times.collect()) == sorted(without.select(*with_times.columns).collect()) and with_times.count() == 5
    assert "Join" not in with_times._jdf.queryExecution().optimizedPlan().toString()


def test_referred_texts_are_cleaned_once(spark):
    texts = spark.createDataFrame([(0, "the the ring"), (1, None), (2, ""), (3, "nobody refers to to this")], "doc_id long, text string")
    refs = spark.range(3000).select("id", (F.col("id") % 4).alias("doc_id")).withColumn("doc_id", F.when(F.col("doc_id") < 3, F.col("doc_id")).otherwise(9))
    out = textclean.collapse_referred(refs, texts, "doc_id")
    assert Counter(rows(out, "doc_id", "text")) == {(0, "the ring"): 750, (1, None): 750, (2, ""): 750, (9, None): 750}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # rows are joined to clean texts; they don't pass the cleaning themselves
    assert plan.index("Join LeftOuter") < plan.index("ArrowEvalPython")


def test_thinning_after_a_join_that_turns_into_a_broadcast(spark):
    """The join with the spacing is planned by the key, and then broadcast since few recordings are left."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        points = spark.range(0, 40_000, 1, 8).select((F.col("id") % 50).alias("media_id"), F.floor(F.col("id") / 50).cast("double").alias("t"))
        media = spark.range(40_000).select((F.col("id") % 50).alias("media_id")).distinct().withColumn("spacing", F.col("media_id") % 7 + 2.0)
        got = Counter(r.media_id for r in intervals.thin(points.join(media, "media_id"), "spacing").collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {m: -(-800 // (m % 7 + 2)) for m in range(50)}


@pytest.mark.parametrize("width", [3, 1 << 16])
def test_islands_over_bins(spark, monkeypatch, width):
    monkeypatch.setattr(intervals, "ROWS_BIN", width)
    monkeypatch.setattr(intervals, "SECONDS_BIN", float(width))
    monkeypatch.setattr(intervals, "FOLD_ROWS", width)
    rng = random.Random(7)
    scenes, clips, want, kept = [], [], set(), set()
    for m in [None, *range(40)]:
        t, own = 0.0, []
        for i in range(rng.randint(1, 40)):
            end = t + rng.choice([0.25, 0.5, 1.0, 1.5, 2.0, 4.0])
            own.append((t, end))
            scenes.append((m, i, t, end))
            t = end
        cur = list(own[0])
        for a, b in own[1:]:
            if cur[1] - cur[0] < 2:
                cur[1] = b
            else:
                want.add((m, *cur))
                cur = [a, b]
        want.add((m, *cur))
        chosen = []
        for rank in range(1, rng.randint(2, 60)):
            s = rng.choice([0.0, 1.0, 2.5, 4.0, 9.0, 30.0, 31.0]) + rng.random()
            e = s + rng.choice([20.0, 21.0, 30.0])
            mid = s + rng.choice([5.0, 6.0, 9.0])
            clips.append((m, rank, s, e, mid))
            near = lambda k: (min(k[1], e) - max(k[0], s)) / (max(k[1], e) - min(k[0], s)) >= 0.6 and abs(k[0] - s) <= 5 and abs(k[1] - e) <= 5 and abs(k[2] - mid) <= 3  # noqa: B023, E731
            if not any(map(near, chosen)):
                chosen.append((s, e, mid))
                kept.add((m, rank))
    sc = spark.createDataFrame(scenes, "media_id long, scene_idx int, start_seconds double, end_seconds double").repartition(3)
    assert set(rows(intervals.merge_short(sc), "media_id", "start_seconds", "end_seconds")) == want
    cl = spark.createDataFrame(clips, "media_id long, rank int, start_seconds double, end_seconds double, middle double").repartition(3)
    assert set(rows(intervals.suppress_near_duplicates(cl, iou=0.6), "media_id", "rank")) == kept


def plain_chunks(segments, gap, most):
    out = []
    for s, e in segments:
        if out and s - out[-1][1] <= gap and e - out[-1][0] <= most:
            out[-1][1] = e
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def plain_thin(points, spacing):
    kept = []
    for x in sorted(points):
        if not kept or x - kept[-1] >= spacing:
            kept.append(x)
    return kept


@pytest.mark.parametrize("width", [2, 5, 1 << 16])
def test_spans_over_bins_against_loops(spark, monkeypatch, width):
    """Bins of some rows, ends that fall back, gaps, whole numbers, ties, null and NaN times."""
    monkeypatch.setattr(intervals, "ROWS_BIN", width)
    monkeypatch.setattr(intervals, "SECONDS_BIN", float(width))
    monkeypatch.setattr(folds, "ROWS", width)
    rng = random.Random(width)
    segments, points, chunks, whole, thinned = [], [], set(), set(), set()
    for m in [None, *range(30)]:
        t, own, ints = 0.0, [], []
        for i in range(rng.randint(1, 50)):
            t += rng.choice([0.0, 0.1, 0.5, 2.5]) + rng.random()
            s, e = t, t + rng.choice([0.2, 1.0, 7.0])
            bad = rng.random()
            row = (m, None if bad < 0.03 else i, None if 0.03 < bad < 0.06 else s, float("nan") if 0.06 < bad < 0.09 else e)
            segments.append(row)
            if bad >= 0.09:
                own.append((s, e))
                ints.append((int(s * 10), int(e * 10)))
        chunks |= {(m, i, *x) for i, x in enumerate(plain_chunks(own, 0.8, 9.0))}
        whole |= {(m, i, *x) for i, x in enumerate(plain_chunks(ints, 8, 90))}
        at = [round(rng.random() * 40, 1) for _ in range(rng.randint(1, 60))]
        points += [(m, x, 1.5 + (m or 0) % 3) for x in at] + [(m, None, 1.0), (m, 3.0, None)]
        thinned |= {(m, x) for x in plain_thin(at, 1.5 + (m or 0) % 3)}
    df = spark.createDataFrame(segments, "media_id long, seg_idx int, start double, end double").repartition(3)
    assert set(rows(intervals.merge_gaps(df, 0.8, 9.0), "media_id", "chunk_idx", "start", "end")) == chunks
    assert intervals.null_rows(df, ["seg_idx", "start", "end"]).count() == sum(r[1] is None or r[2] is None or r[3] != r[3] for r in segments)
    good = df.where("seg_idx IS NOT NULL AND start IS NOT NULL AND NOT isnan(end)")
    samples = good.select("media_id", "seg_idx", F.floor(F.col("start") * 10).alias("start"), F.floor(F.col("end") * 10).alias("end"))
    got = intervals.merge_gaps(samples, 8, 90)
    assert dict(got.dtypes)["start"] == "bigint" and set(rows(got, "media_id", "chunk_idx", "start", "end")) == whole
    pts = spark.createDataFrame(points, "media_id long, t double, gap double").repartition(3)
    got = rows(intervals.thin(pts, "gap"), "media_id", "t")
    assert set(got) == thinned and len(got) == len(thinned)


def test_spans_of_numbers():
    """Next begins, begins and step tables against loops; least values to the last bit."""
    rng = np.random.default_rng(3)
    for turn in range(150):
        n = int(rng.integers(1, 40))
        value = rng.integers(0, 30, n).astype(np.int64 if turn % 2 else float)
        value = np.sort(value) if turn % 3 == 0 else value
        if turn % 2 == 0:
            value = value + rng.random(n)
        base, reach, strict = value - rng.integers(0, 3, n).astype(value.dtype), rng.integers(0, 10, n).astype(float), turn % 5 == 0
        least = folds.least_value(base, reach, strict)
        for x, a, d in zip(least, base, reach, strict=True):
            below = x - 1 if turn % 2 else np.nextafter(x, -np.inf)
            assert (x - a > d, below - a > d) == (True, False) if strict else (x - a >= d, below - a >= d) == (True, False)
        told = rng.random(n) < 0.1
        after = [next((j for j in range(i + 1, n) if told[j] or value[j] >= least[i]), n) for i in range(n)]
        assert folds.next_begins(value, least, told).tolist() == after
        reached = set()
        for i in np.flatnonzero(told).tolist():
            while i < n and i not in reached:
                reached.add(i)
                i = after[i]
        assert set(np.flatnonzero(folds.begins(value, least, told)).tolist()) == reached
        upto, out = folds.step_table(value, least, told)
        for t in (-5, 0, 3, 12, 29, 45):
            state = value.dtype.type(t)
            for j in range(n):
                state = least[j] if told[j] or value[j] >= state else state
            at = int(np.searchsorted(upto, t))
            assert (out[at] if at < len(upto) else t) == state
    assert folds.least_value(np.array([-1e6]), np.array([1e6]), False)[0] < 0


def test_large_islands_settle_in_rounds(spark, monkeypatch):
    """A crowd of near copies, a chain whose ranks rise along it, and a recording without a name."""
    monkeypatch.setattr(intervals, "FOLD_ROWS", 20)
    monkeypatch.setattr(intervals, "ROUNDS", 3)
    rng = random.Random(4)
    clips = [(1, i + 1, rng.random(), 50 + rng.random(), 25.0) for i in range(150)]
    clips += [(2, i + 1, i * 0.9, i * 0.9 + 50, i * 0.9 + 25) for i in range(150)]
    clips += [(None, i + 1, x := rng.random() * 60, x + 50 + rng.random(), x + 24 + 2 * rng.random()) for i in range(150)]
    want = set()
    for m in (1, 2, None):
        kept = []
        for _, rank, s, e, mid in (c for c in clips if c[0] == m):
            if not any((min(k[1], e) - max(k[0], s)) / (max(k[1], e) - min(k[0], s)) >= 0.9 and abs(k[0] - s) <= 5 and abs(k[1] - e) <= 5 and abs(k[2] - mid) <= 3 for k in kept):
                kept.append((s, e, mid))
                want.add((m, rank))
    df = spark.createDataFrame([*clips, (1, 999, None, 2.0, 1.0), (1, 998, 3.0, float("nan"), 1.0)], "media_id long, rank int, start_seconds double, end_seconds double, middle double").repartition(4)
    got = rows(intervals.suppress_near_duplicates(df), "media_id", "rank")
    assert set(got) == want and len(got) == len(want)


def test_parameters_are_checked(spark):
    df = spark.createDataFrame([], "media_id long, seg_idx int, rank int, start double, end double, start_seconds double, end_seconds double, middle double")
    for wrong in (lambda: intervals.suppress_near_duplicates(df, iou=1.5), lambda: intervals.suppress_near_duplicates(df, edge=-1.0), lambda: intervals.suppress_near_duplicates(df, middle=-1.0), lambda: intervals.merge_gaps(df, -1.0, 20.0), lambda: captions.build_captions(df, ["rank"], size=0), lambda: signals.session_offsets(df, 0.0)):
        with pytest.raises(ValueError):
            wrong()


def test_results_are_deduped_in_order(spark):
    rng = random.Random(8)
    data, want = [], set()
    for q in range(25):
        urls, titles = set(), set()
        for pos in range(rng.randint(1, 60)):
            url, title = f"https://h/{rng.randint(0, 15)}" + rng.choice(["", "/"]), f"T {rng.randint(0, 15)}" + rng.choice(["", "!"])
            data.append((f"q{q}", pos, title, url, "s", "q"))
            u, t = url.rstrip("/").lower(), re.sub("[^a-z0-9]+", "", title.lower())
            if u not in urls and t not in titles:
                urls.add(u)
                titles.add(t)
                want.add((f"q{q}", pos))
    # a chain in which every result shares its URL with one neighbour and its title with the other
    for pos in range(12):
        data.append(("chain", pos, f"t{(pos + 1) // 2}", f"https://c/{pos // 2}", "s", "q"))
        if pos % 2 == 0:
            want.add(("chain", pos))
    raw = spark.createDataFrame(data, "request_id string, pos int, title string, url string, summary string, query string").repartition(4)
    chain = {p for q, p in want if q == "chain"}
    urls, titles, kept = set(), set(), set()
    for pos in range(12):
        u, t = pos // 2, (pos + 1) // 2
        if u not in urls and t not in titles:
            urls.add(u), titles.add(t), kept.add(pos)
    want = {w for w in want if w[0] != "chain"} | {("chain", p) for p in kept}
    assert chain and set(rows(research.dedupe_results(research.normalise_results(raw)), "request_id", "pos")) == want


def test_results_of_several_queries(spark):
    """Each query counts from 0; a title that another query's first result has doesn't come back."""
    data = [("r", 0, 0, "Lava", "https://a/1"), ("r", 1, 0, "Lava", "https://b/2"), ("r", 1, 0, "Tuna", "https://c/3"), ("r", 2, 0, "Moss", "https://A/1/"), ("r", 2, 1, "Fern", "https://d/4"), ("r", 2, 1, "Fern", "https://d/4")]
    raw = spark.createDataFrame([(*x, "s", "q") for x in data], "request_id string, query_no int, pos int, title string, url string, summary string, query string").repartition(3)
    for limit in (1, 1000):
        research.FOLD_RESULTS, before = limit, research.FOLD_RESULTS
        got = research.dedupe_results(research.normalise_results(raw))
        assert sorted(rows(got, "query_no", "pos", "title")) == [(0, 0, "Lava"), (1, 0, "Tuna"), (2, 1, "Fern")]
        research.FOLD_RESULTS = before


def test_a_long_chain_of_results(spark, monkeypatch):
    """Each result shares its URL with one neighbour and its title with the other; after some rounds components pass by in order."""
    monkeypatch.setattr(research, "FOLD_RESULTS", 100)
    monkeypatch.setattr(research, "ROUNDS", 2)
    n = 3000
    data = [("chain", pos, f"t{(pos + 1) // 2}", f"https://c/{pos // 2}", "s", "q") for pos in range(n)] + [(None, 0, "t0", "https://c/0", "s", "q"), (None, 1, "t0", "https://c/9", "s", "q")]
    raw = spark.createDataFrame(data, "request_id string, pos int, title string, url string, summary string, query string").repartition(4)
    urls, titles, want = set(), set(), {(None, 0)}
    for pos in range(n):
        u, t = pos // 2, (pos + 1) // 2
        if u not in urls and t not in titles:
            urls.add(u), titles.add(t), want.add(("chain", pos))
    got = rows(research.dedupe_results(research.normalise_results(raw)), "request_id", "pos")
    assert set(got) == want and len(got) == len(want)


def test_corrected_names(spark):
    """A spelling that differs in marks and capitals only is no correction."""
    req = spark.createDataFrame([("a", "Spider Man"), ("b", "Spider Mann")], "request_id string, game_name string")
    found = spark.createDataFrame([("a", 0, "Spider-man", "x.org"), ("b", 0, "Spider-man", "x.org")], "request_id string, pos int, title string, domain string")
    got = {r.request_id: (r.suggested_name, r.was_corrected) for r in research.best_names(found, req).collect()}
    assert got == {"a": ("Spider-man", False), "b": ("Spider-man", True)}


def test_similarity_bound_is_no_less(spark):
    rng = random.Random(5)
    pairs = [("".join(rng.choice("abc1") for _ in range(rng.randint(0, 12))), "".join(rng.choice("abc1") for _ in range(rng.randint(0, 12)))) for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("most", research.similarity_bound("a", "b"))
    for r in df.collect():
        true = SequenceMatcher(None, r.a, r.b).ratio()
        assert true <= 0.5 or r.most >= true - 1e-9


def plain_names(results, asked):
    """Suggested names by a loop over candidates."""
    out = {}
    for q, supplied in asked.items():
        best = {}
        for pos, (title, domain) in enumerate(results.get(q, [])):
            for part, x in enumerate(re.split(research.SEPARATORS, title)):
                x = " ".join(re.sub(research.NOISE, "", x).split())
                if not x or len(x) > 45 or len(x.split()) > 6:
                    continue
                name = " ".join(w if w.isupper() and len(w) <= 5 else w[:1].upper() + w[1:].lower() for w in x.split())
                key = lambda s: re.sub("[^a-z0-9]+", "", s.lower())
                if not key(name):
                    continue
                sim = SequenceMatcher(None, key(supplied), key(name)).ratio()
                if sim >= 0.65:
                    score = sim + (0.2 if any(a in domain for a in research.AUTHORITIES) else 0.0)
                    old = best.get(name, (0.0, (pos, part)))
                    best[name] = (max(score, old[0]), min(old[1], (pos, part)))
        top = min(best.items(), key=lambda kv: (-kv[1][0], kv[1][1]), default=None)
        out[q] = top[0] if top and top[1][0] >= 0.78 else supplied
    return out


def test_best_names_against_a_loop(spark):
    rng = random.Random(9)
    names = ["Star Quest", "starquest", "Star Quests Wiki", "DOOM", "Doom Eternal", "Moon Base", "Star Qest Guide"]
    asked = {f"q{i}": rng.choice(["star quest", "doom", "moon bas", "nothing like it"]) for i in range(30)}
    results = {q: [(rng.choice([" - ", " | ", ": ", " "]).join(rng.sample(names, rng.randint(1, 3))), rng.choice(["wikipedia.org", "x.com", "store.steampowered.com"])) for _ in range(rng.randint(0, 6))] for q in asked}
    df = spark.createDataFrame([(q, pos, t, d) for q, rs in results.items() for pos, (t, d) in enumerate(rs)], "request_id string, pos int, title string, domain string")
    got = dict(rows(research.best_names(df, spark.createDataFrame(list(asked.items()), "request_id string, game_name string")), "request_id", "suggested_name"))
    assert got == plain_names(results, asked)


def test_collapse_is_a_fixpoint():
    clean = textclean._collapser()
    rng = random.Random(10)
    for _ in range(300):
        text = " ".join(rng.choice(["wow", "Wow", "go", "going", "a b c", "'hey'", "no!", "the end"]) for _ in range(rng.randint(0, 12)))
        once = clean(text)
        assert clean(once) == once
        words = once.lower().split()
        assert not any(a == b and a.isalnum() for a, b in zip(words, words[1:]))
        assert set(words) <= set(text.lower().split())


def plain_clips(scored):
    """Windows, ranks and suppression by a loop over the scored scenes of a recording."""
    kept = []
    for rank, r in enumerate(sorted((r for r in scored if r.final_score >= 0.4), key=lambda r: (-r.final_score, r.scene_idx)), 1):
        a, b = (min(max(x, 0.0), fx.DURATION) for x in (r.start_seconds, r.end_seconds))
        goal = min(max(45.0, b - a), 145.0)
        s = (a + b) / 2 - goal / 2
        e = s + goal
        if s < 0:
            s, e = 0.0, goal
        if e > fx.DURATION:
            s, e = max(0.0, fx.DURATION - goal), fx.DURATION
        mid = (r.start_seconds + r.end_seconds) / 2
        near = lambda k: (min(k[1], e) - max(k[0], s)) / (max(k[1], e) - min(k[0], s)) >= 0.9 and abs(k[0] - s) <= 5 and abs(k[1] - e) <= 5 and abs(k[2] - mid) <= 3  # noqa: B023, E731
        if not any(near(k[:3]) for k in kept):
            kept.append((s, e, mid, rank, r.final_score, r.transcript_text))
    return kept


def test_highlight_run_against_a_loop(spark, sf):
    """The whole run: chunks, scenes, clips, three stages of answers, order, files, captions, titles asked for again, packages."""
    ev = fx.numbered_events(spark, sf)
    speech = {}
    for r in fx.speech_segments(spark, sf).orderBy("media_id", "seg_idx").collect():
        speech.setdefault(r.media_id, []).append((r.start, r.end))
    said, run = fx.transcript_segments(spark, sf), registry._run(spark, sf)
    texts = {}
    chunks = [(m, i, *x) for m, own in speech.items() for i, x in enumerate(plain_chunks(own, 2.0, 20.0))]
    table = spark.createDataFrame(chunks, "media_id long, scene_idx long, start_seconds double, end_seconds double")
    segments = intervals.scene_texts(said, table).where("transcript_text <> ''").select("media_id", F.col("scene_idx").alias("seg_idx"), "start_seconds", "end_seconds", F.col("transcript_text").alias("text"))
    merged = {}
    for r in fx.scenes(spark, sf).orderBy("media_id", "scene_idx").collect():
        own = merged.setdefault(r.media_id, [])
        if own and own[-1][1] - own[-1][0] < 2:
            own[-1][1] = r.end_seconds
        else:
            own.append([r.start_seconds, r.end_seconds])
    scenes = spark.createDataFrame([(m, i, *x) for m, own in merged.items() for i, x in enumerate(own)], "media_id long, scene_idx long, start_seconds double, end_seconds double")
    scored = plan.scored_scenes(segments, scenes, fx.event_frames(spark, sf), fx.audio_blocks(spark, sf), fx.RATE, 1)
    frames = {}
    for r in fx.event_frames(spark, sf).select("media_id", "frame_number").collect():
        frames.setdefault(r.media_id, set()).add(r.frame_number)
    by_media, want, ask, prompts = {}, set(), registry.answer_by_digest(), plan.Prompts()
    for r in scored.collect():
        by_media.setdefault(r.media_id, []).append(r)
    blank = lambda t: t if t.strip() else "[NO SPEECH]"
    answer = lambda p, images=None: json.loads(ask(p, images).removeprefix("So: "))
    yes = lambda x: "true" if x else "false"
    for m, own in by_media.items():
        final = []
        for s, e, _, rank, score, text in plain_clips(own):
            shown = (rank, f"{e - s:.2f}", f"{score:.4f}", blank(text))
            a = answer(prompts.commentary % shown)
            first, n = int(s * fx.RATE), max(0, min(int(e * fx.RATE), max(frames[m]) + 1) - int(s * fx.RATE))
            count = min(3, n)
            picked = [n // 2] if count == 1 else sorted({round(i * (n - 1) / (count - 1)) for i in range(count)}) if n else []
            v = answer(prompts.visual % shown, [i for i in picked if first + i in frames[m]])
            d = answer(prompts.fusion % (yes(a["is_interesting"]), a["category"], f"{a['confidence']:.4f}", a["reason"], blank(text), v["visual_event"], v["action_level"], v["danger_level"], yes(v["looks_interesting"]), f"{v['confidence']:.4f}", v["reason"]))
            final.append((-float(d["final_confidence"]), rank, d, a["category"], v, text))
        for number, (sure, rank, d, kind, v, text) in enumerate(sorted(final, key=lambda x: x[:2]), 1):
            fields = (d["category"], d["event_summary"], kind, v["visual_event"], v["action_level"], v["danger_level"], blank(text))
            for again in ("", prompts.again, prompts.again):
                t = answer(prompts.metadata % (*fields, again))
                if len(t["title"]) <= 70:
                    break
            else:
                t = {"c1": {"hook": "look", "title": "Clip of the first kind", "hashtags": ["#c1"]}}.get(d["category"], {"hook": "wait", "title": "A clip", "hashtags": ["#clip"]})
            renderer = "facecam" if m % 6 == 0 else "portrait"
            want.add((m, rank, number, d["category"], kind, v["visual_event"], v["danger_level"], d["keep_highlight"], -sure, d["reason"], t["hook"], t["title"], " ".join(t["hashtags"]), renderer, -(-len(text.split()) // 4), f"highlight_{number:03d}.mp4", len(final), len(final)))
    got = registry.highlight_run(spark, sf)
    columns = ("media_id", "rank", "number", "category", "commentary_category", "visual_event", "danger_level", "keep_highlight", "final_confidence", "reason", "hook", "title", "hashtags", "renderer", "caption_count", "file_name", "highlights", "packages")
    assert set(rows(got, *columns)) == want and len(want) > 20
    assert any(x[11] == "A clip" for x in want) and len({x[3] for x in want}) > 3
    # each clip speaks whole texts, four words a caption
    assert max(x[14] for x in want) > 20
    told = {(r.media_id, r.number): json.loads(r.metadata) for r in run.files.collect()}
    assert list(told[next(iter(told))]) == [name for name, _ in sinks.METADATA]
    texts = {(r.media_id, r.number): r for r in run.final.collect()}
    assert all(f["transcript"] == texts[k].transcript_text and f["source_start_seconds"] == texts[k].start_seconds and f["clip_file"] == f"highlight_{k[1]:03d}.mp4" for k, f in told.items())
    assert {s for s, _ in run.timings} >= {"commentary", "visual", "fusion", "titles"} and ev.count() > 0


def test_texts_by_reference_give_the_run_that_carried_ones_give(spark, sf, monkeypatch):
    """By reference no table before that of the clips holds a text, and nothing stays but what the run returns."""
    tables, run_of = {}, plan.highlight_run

    def noted(df, name, *rest):
        tables[name] = df.columns
        return storage.materialise(df, name, *rest)

    monkeypatch.setattr(plan, "materialise", noted)
    before = set(storage._WRITTEN)
    run = registry._run(spark, sf)
    stages = list(tables)
    assert not {"text", "transcript_text"} & {c for name in stages[: stages.index("clips")] for c in tables[name]}
    left = {path.rsplit("/cueline-", 1)[1].rsplit("-", 1)[0] for path in storage._WRITTEN if path not in before}
    assert left == {"clips", "commentary", "visual", "fusion", "final", "titles", "packages", "ledger"}

    def carried(speech, parts, *args, texts, **named):
        part = F.transform(F.array_sort(F.collect_list(F.struct("part_idx", "text"))), lambda x: x["text"])
        told = lambda chunks: parts(chunks).join(texts.where("text <> ''"), "doc_id").groupBy("media_id", "chunk_idx").agg(F.array_join(part, " ").alias("text"))
        return run_of(speech, told, *args, **named)

    monkeypatch.setattr(plan, "highlight_run", carried)
    other = registry._run(spark, sf)
    columns = ("media_id", "rank", "number", "category", "transcript_text", "start_seconds", "end_seconds")
    assert sorted(rows(run.final, *columns)) == sorted(rows(other.final, *columns)) and run.final.count() > 20
    columns = ("media_id", "rank", "title", "caption_count", "document")
    assert sorted(rows(run.packages, *columns)) == sorted(rows(other.packages, *columns))
    documents = captions.subtitle_documents(run.captions, run.final, ["media_id", "rank"])
    assert sorted(rows(documents, "media_id", "rank", "document")) == sorted(rows(run.packages, "media_id", "rank", "document")) == sorted(rows(run.documents, "media_id", "rank", "document"))


def test_documents_are_made_where_clips_lie(spark):
    """As from captions that are rows, without a shuffle."""
    said = [(1, "a b c d e", 7.0), (2, "", 3.0), (3, None, 3.0), (4, "one", 0.0), (5, " w\u00f6rt\u2003two\n three ", 1e5 / 3), (6, "x " * 4001, 3723.0015), (7, "a b c d", None)]
    clips = spark.createDataFrame(said, "id long, transcript_text string, duration_seconds double")
    lines = captions.build_captions(clips, ["id"])
    made = captions.with_documents(clips)
    assert dict(rows(made, "id", "document")) == dict(rows(captions.subtitle_documents(lines, clips, ["id"]), "id", "document"))
    assert {k: n for k, n in rows(made, "id", "caption_count") if n} == dict(rows(lines.groupBy("id").count(), "id", "count"))
    assert "Exchange" not in made._jdf.queryExecution().sparkPlan().toString() and made.count() == 7


def test_words_of_what_segments_say(spark):
    texts = spark.createDataFrame([(0, "the ring"), (1, ""), (2, None), (3, " "), (4, "a b c")], "doc_id long, text string")
    segments = spark.createDataFrame([(1, i, 1.0 * i) for i in range(6)], "media_id long, seg_idx long, start_seconds double")
    parts = spark.createDataFrame([(1, 0, 0), (1, 0, 4), (1, 0, 0), (1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 9), (1, 4, 4)], "media_id long, seg_idx long, doc_id long")
    got = scoring.spoken_words(segments, parts, texts, "doc_id")
    assert sorted(rows(got, "seg_idx", "words")) == [(0, 7), (3, 0), (4, 3)]


def asking(folder, fail=(), slow=()):
    """A responder that notes each prompt it is asked, and fails or times out at some as long as a file says so."""

    def set_up():
        import os
        import uuid

        def answer(prompt, images=None):
            open(f"{folder}/{prompt}-{uuid.uuid4().hex}", "w").close()
            if os.path.exists(f"{folder}.bad"):
                if prompt in slow:
                    raise TimeoutError
                if prompt in fail:
                    raise ValueError(prompt)
            return f"{prompt}!{0 if images is None else len(images)}"

        return answer

    return Responder("test", set_up)


def test_the_ledger_asks_each_prompt_once(spark, tmp_path):
    asked, ledger = tmp_path / "asked", f"{tmp_path}/ledger"
    asked.mkdir()
    (tmp_path / "asked.bad").touch()
    count = lambda: Counter(f.name.rsplit("-", 1)[0] for f in asked.iterdir())
    df = spark.createDataFrame([(i, f"p{i % 20}") for i in range(60)] + [(99, None)], "i int, prompt string").repartition(3)
    responder = asking(str(asked), fail=("p3", "p7"), slow=("p5",))
    with pytest.raises(RuntimeError, match="2 of 21 prompts"):
        answers.ask(df, responder, ledger, per_task=4, pause=0.0)
    # all others were asked once, the slow one three times
    assert count() == Counter({f"p{i}": 1 for i in range(20)} | {"": 1, "p5": 3})
    got = answers.ask(df, responder, ledger, per_task=4, pause=0.0, strict=False)
    told = dict(rows(got, "i", "raw_text"))
    assert told[0] == told[20] == "p0!0" and told[3] is told[5] is told[7] is None and told[99] == "!0" and len(told) == 61
    assert count()["p0"] == 1 and count()["p3"] == 2 and count()["p5"] == 6
    (tmp_path / "asked.bad").unlink()
    again = dict(rows(answers.ask(df, responder, ledger, pause=0.0), "i", "raw_text"))
    assert again[3] == "p3!0" and again[45] == "p5!0" and count()["p0"] == 1 and count()["p5"] == 7
    # nothing is left to ask, other images are another prompt, another responder is asked anew
    answers.ask(df, responder, ledger, pause=0.0)
    assert sum(count().values()) == 21 - 1 + 7 + 2 * 2 + 1 - 1
    shown = spark.createDataFrame([(1, "p1", [[0.5]]), (2, "p1", [[0.5], [0.25]]), (3, "p1", [])], "i int, prompt string, images array<array<double>>")
    assert dict(rows(answers.ask(shown, responder, ledger, "images"), "i", "raw_text")) == {1: "p1!1", 2: "p1!2", 3: "p1!0"}
    other = answers.Responder("other", responder.set_up)
    assert answers.ask(df.limit(0), other, f"{tmp_path}/none").count() == 0
    before = count()["p0"]
    answers.ask(df.where("prompt = 'p0'"), other, ledger).count()
    assert count()["p0"] == before + 1


def test_a_failing_task_loses_no_other_answers(spark, tmp_path):
    """A task that dies takes its own prompts with it; those of the others are in the ledger although the job failed."""
    asked, ledger = tmp_path / "asked", f"{tmp_path}/ledger"
    asked.mkdir()
    (tmp_path / "asked.bad").touch()
    folder = str(asked)

    def set_up():
        plain = asking(folder).set_up()

        def answer(prompt, images=None):
            import os
            import time

            if prompt == "p9" and os.path.exists(f"{folder}.bad"):
                time.sleep(3)
                raise SystemExit
            return plain(prompt)

        return answer

    df = spark.createDataFrame([(f"p{i}",) for i in range(10)], "prompt string")
    with pytest.raises(Exception):  # noqa: B017
        answers.ask(df, Responder("test", set_up), ledger, per_task=1)
    (tmp_path / "asked.bad").unlink()
    got = rows(answers.ask(df, Responder("test", set_up), ledger, per_task=1), "prompt", "raw_text")
    assert dict(got) == {f"p{i}": f"p{i}!0" for i in range(10)}
    n = Counter(f.name.rsplit("-", 1)[0] for f in asked.iterdir())
    assert sum(n[f"p{i}"] == 1 for i in range(10)) >= 6


def test_subtitles_of_long_clips(spark):
    texts = [None, "", "  ", "a", "a b c d", "a b c d e", " ".join(f"w{i}" for i in range(1000))]
    clips = spark.createDataFrame([(i, t, 3600.0 * 101 + i) for i, t in enumerate(texts)], "id long, transcript_text string, duration_seconds double")
    docs = dict(rows(captions.subtitle_documents(captions.build_captions(clips, ["id"]), clips, ["id"]), "id", "document"))
    assert docs[3] == "1\n00:00:00,000 --> 101:00:03,000\na\n" and docs[0] == docs[1] == docs[2] == ""
    assert docs[6].count(" --> ") == 250 and docs[6].endswith("w999\n")


def test_profiles_are_read_from_files(spark, tmp_path):
    full = '"channel_name": "x", "target_audience": "", "preferred_language": null, "brand_colors": [], "logo": {}, "creator_photos_folder": "", "style": "", "ai_face_generation": true'
    (tmp_path / "p.json").write_text('{"good": {%s}, "short": {"channel_name": "x"}, "odd": 7, "name": {%s}, "colours": {%s}}' % (full, full.replace('"x"', "1", 1), full.replace("[]", '"red"')))
    got = dict(rows(inputs.read_profiles(spark, str(tmp_path)), "profile_key", "error"))
    assert got["good"] is None and got["odd"] == "not a mapping" and got["short"].startswith("missing: target_audience, ")
    assert got["name"] == "channel_name is not a text" and got["colours"] == "brand_colors is not a list"


def test_scene_logs_are_read(spark, tmp_path):
    (tmp_path / "7.log").write_text("n:1 pts_time:1.5 x\nn:2 pts_time:20 y\n")
    (tmp_path / "b").write_text("none")
    logs = inputs.read_scene_logs(spark, str(tmp_path))
    assert sorted(rows(logs, "media_id")) == [("7",), ("b",)]
    assert sorted(rows(inputs.scene_cut_times(logs), "media_id", "pos", "t")) == [("7", 0, 1.5), ("7", 1, 20.0)]


def test_sinks_replace_what_was_there(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "media_id int, metadata string")
    sinks.write_partitions(df, path, "media_id", "metadata")
    # 2 has no highlights any more; 3 isn't part of the run
    sinks.write_partitions(df.where("media_id = 1"), path, "media_id", "metadata", keys=df.where("media_id < 3"))
    got = {r.media_id: r.value for r in spark.read.format("text").load(path).collect()}
    assert got == {1: "a", 2: "", 3: "c"}
    sinks.write_buckets(df, f"{tmp_path}/buckets", "media_id", 2)
    back = spark.read.json(f"{tmp_path}/buckets")
    assert sorted((r.media_id, r.metadata) for r in back.collect()) == [(1, "a"), (2, "b"), (3, "c")]
    assert back.where(F.col("bucket") != F.pmod(F.hash(F.col("media_id").cast("int")), F.lit(2))).count() == 0


def test_large_recordings_are_ranked_in_ranges(spark, monkeypatch):
    """Scores by joined maxima and ranks by ranges are those of windows, ties and recordings without a name too."""
    rng = random.Random(11)
    data = [(m, i, float(i), i + 1.0, rng.choice([0.0, 1.0, 2.0]), rng.randint(0, 9), rng.random()) for m in (None, 1, 2) for i in range(80)]
    df = spark.createDataFrame(data, "media_id long, scene_idx int, start_seconds double, end_seconds double, average_motion_score double, speech_word_count int, average_audio_rms double").repartition(4)
    plain, joined = scoring.score_scenes(df), scoring.score_scenes(df, written=True)
    assert plain.columns == joined.columns and sorted(map(repr, plain.collect())) == sorted(map(repr, joined.collect()))
    media = spark.createDataFrame([(1, 300.0), (2, 300.0)], "media_id long, duration_seconds double")
    want = rows(scoring.select_candidates(plain, media), "media_id", "scene_idx", "rank", "start_seconds")
    monkeypatch.setattr(ranks, "HELD", 10)
    got = scoring.select_candidates(joined, media, fullest=80)
    assert dict(got.dtypes)["rank"] == "int" and set(rows(got, "media_id", "scene_idx", "rank", "start_seconds")) == set(want) and len(want) > 40


def test_buckets_keep_what_others_wrote(spark, tmp_path):
    path = f"{tmp_path}/buckets"
    write = lambda pairs, **more: sinks.write_buckets(spark.createDataFrame(pairs, "media_id int, metadata string"), path, "media_id", 3, **more)
    read = lambda: sorted((r.media_id, r.metadata) for r in spark.read.json(path).collect())
    files = lambda: {f.parent.name: f.name for f in (tmp_path / "buckets").glob("bucket=*/part*")}
    write([(i, f"v{i}") for i in range(12)] + [(3, "more")])
    first, at = files(), {r.i: r.b for r in spark.range(12).select(F.col("id").cast("int").alias("i")).select("i", F.pmod(F.hash("i"), F.lit(3)).alias("b")).collect()}
    write([(5, "new")])
    want = sorted([(i, "new" if i == 5 else f"v{i}") for i in range(12)] + [(3, "more")])
    assert read() == want
    assert {b for b, name in files().items() if first[b] != name} == {f"bucket={at[5]}"}

    @F.udf("string")
    def fails(x):
        raise ValueError(x)

    before = files()
    with pytest.raises(Exception):  # noqa: B017
        sinks.write_buckets(spark.range(12).select(F.col("id").cast("int").alias("media_id"), fails(F.col("id").cast("string")).alias("metadata")), path, "media_id", 3)
    assert read() == want and files() == before
    # keys without rows lose what they had, a whole bucket too
    gone = [i for i in range(12) if at[i] == at[5]]
    write([], keys=spark.createDataFrame([(i,) for i in gone], "media_id int"))
    assert read() == [x for x in want if x[0] not in gone]


def test_a_failed_run_leaves_the_old_files(spark, tmp_path):
    path = f"{tmp_path}/out"
    df = spark.createDataFrame([(i, f"a{i}") for i in range(6)], "media_id int, metadata string")
    sinks.write_partitions(df, path, "media_id", "metadata")

    @F.udf("string")
    def fails(x):
        if x == "a4":
            raise ValueError(x)
        return "b"

    with pytest.raises(Exception):  # noqa: B017
        sinks.write_partitions(df.withColumn("metadata", fails("metadata")), path, "media_id", "metadata")
    assert {r.media_id: r.value for r in spark.read.format("text").load(path).collect()} == {i: f"a{i}" for i in range(6)}


@pytest.mark.parametrize("n", [1, 2, 3, 50, 51])
def test_medians_by_counting(spark, n):
    rng = random.Random(n)
    data = [(k, x) for k, make in ((None, rng.random), (1, lambda: rng.choice([0.1, 0.1, 0.3])), (2, lambda: 2.0 ** rng.randint(-900, 900)), (3, lambda: rng.choice([-1e308, 1e308, 0.0]))) for x in (make() for _ in range(n))]
    df = spark.createDataFrame([*data, (1, None), (2, float("nan"))], "k int, x double").repartition(3)
    want = {k: float(np.median([x / 2 for q, x in data if q == k]) * 2) for k in (None, 1, 2, 3)}
    got = dict(rows(quantiles.exact_medians(df, "k", "x", held=0), "k", "median"))
    assert got == pytest.approx(want, rel=1e-15)
    assert dict(rows(quantiles.exact_medians(df, "k", "x").where("k < 3"), "k", "median")) == pytest.approx({k: v for k, v in want.items() if k in (1, 2)}, rel=1e-15)


@pytest.mark.parametrize("block", [7, 64, 1 << 14])
def test_alignment_by_blocks(spark, block):
    """Blocks of any size, gaps and recordings of other lengths: as the sum over pairs."""
    rng = np.random.default_rng(block)
    m, s = [], []
    for k, (n, shift) in enumerate([(200, 13), (90, -21), (5, 0), (150, 40)]):
        wave = rng.normal(size=n + 100)
        m += [(f"k{k}", w, float(wave[w + 50])) for w in range(n) if rng.random() > 0.1]
        s += [(f"k{k}", w, float(wave[w + 50 - shift])) for w in range(n - 10) if 0 <= w + 50 - shift and rng.random() > 0.1]
    m.append(("alone", 0, 1.0))
    schema = "name string, w long, level double"
    master, source = spark.createDataFrame(m, schema).repartition(3), spark.createDataFrame(s, schema).repartition(3)
    plain = signals.lag_scores(master, source, 60, key="name")
    want = {(r.name, r.lag): r.score for r in plain.collect()}
    got = {(r.name, r.lag): r.score for r in signals.fft_scores(master, source, 60, "name", block).collect()}
    assert got == pytest.approx(want, abs=1e-8) and len(want) > 300
    a = {r.name: r for r in signals.align_by_fft(master, source, 60, 5, "name", block=block).collect()}
    b = {r.name: r for r in signals.best_alignment(plain, "name", 5).collect()}
    assert set(a) == set(b) and a["k0"].lag == 13 and a["k1"].lag == -21 and a["k0"].accepted
    for k in b:
        assert a[k].lag == b[k].lag and a[k].accepted == b[k].accepted
        assert (a[k].pearson, a[k].ratio, a[k].confidence) == pytest.approx((b[k].pearson, b[k].ratio, b[k].confidence), abs=1e-6)


def test_blur_weights_and_edges(spark):
    """A single light pixel spreads by the filter's weights; even frames stay even, small ones too."""
    frame = [0.0] * 81
    frame[40] = 256.0
    df = spark.createDataFrame([(0, frame), (1, [3.0] * 81), (2, [5.0] * 9), (3, None), (4, [])], "i int, gray array<double>")
    got = {r.i: r.gray for r in signals.blur(df, 9).collect()}
    w = [1, 4, 6, 4, 1]
    assert got[0] == pytest.approx([w[y - 2] * w[x - 2] if 2 <= x <= 6 and 2 <= y <= 6 else 0.0 for y in range(9) for x in range(9)])
    assert got[1] == pytest.approx([3.0] * 81) and got[2] == pytest.approx([5.0] * 9) and got[3] is None and got[4] == []


def test_caption_variants_of_a_missing_profile(spark):
    asked = spark.createDataFrame([(1, 9, "Funny", None, "t"), (2, None, None, "g", None)], "request_id int, profile_key int, video_type string, game_name string, episode_topic string")
    none = spark.createDataFrame([], "profile_key int, preferred_language string")
    got = {(r.request_id, r.variant): r.caption for r in packages.caption_variants(asked, none).collect()}
    assert len(got) == 10 and got[1, 1] == "WHAT JUST HAPPENED?!" and got[1, 5] == " GONE WRONG" and got[2, 5] == "G FULL ACTION"


def test_scored_frames_keep_their_order(spark):
    df = spark.createDataFrame([(1, i, 130.0, 95.0, 900.0, 150.0, 0.22) for i in range(3)], "request_id int, sequence int, brightness double, contrast double, sharpness double, saturation double, edge_density double")
    assert sorted(rows(scoring.score_frames(df), "sequence", "rank")) == [(0, 1), (1, 2), (2, 3)]


# --- overlaps of crowded minutes -----------------------------------------------------


@pytest.mark.parametrize("heavy", [1, 5, intervals.HEAVY])
def test_overlaps_in_cut_bins(spark, monkeypatch, heavy):
    """Every pair once, with and without cuts, for short, long, empty, reversed and null intervals."""
    monkeypatch.setattr(intervals, "CUT_ROWS", 2)
    rng = random.Random(21)
    some = lambda n: [("r" if i % 7 else "q", i, s := rng.randint(-40, 400) / 4, s + rng.choice([0, 0.25, 1, 3, 30, -1])) for i in range(n)]
    left, right = [*some(60), ("r", 60, None, 1.0), ("r", 61, 1.0, None)], [*some(50), (None, 50, 0.0, 100.0)]
    a = spark.createDataFrame(left, "k string, i long, start_seconds double, end_seconds double")
    b = spark.createDataFrame(right, "k string, j long, start_seconds double, end_seconds double")
    found = [(r.i, r.j) for r in intervals.overlap_pairs(a, b, "k", 10.0, heavy).collect()]
    whole = lambda x: None not in x
    assert sorted(found) == sorted((x[1], y[1]) for x in filter(whole, left) for y in filter(whole, right) if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])


def test_a_million_segments_in_a_minute(spark):
    """Long segments are dealt, short ones cut: no group of the join has more than its share."""
    for length, most in ((60.0, 2 * intervals.HEAVY), (0.001, 8 * intervals.CUT_ROWS)):
        start = F.lit(0.0) if length == 60.0 else F.col("id") * (59.9 / 1e6)
        left = spark.range(10**6).select(F.lit("r").alias("k"), F.col("id").alias("i"), start.alias("start_seconds"), (start + length).alias("end_seconds"))
        right = spark.range(3).select(F.lit("r").alias("k"), F.col("id").alias("j"), (F.col("id") * 20.0).alias("start_seconds"), (F.col("id") * 20.0 + 20).alias("end_seconds"))
        rows = left.withColumns({"l_bin": F.lit(0).cast("bigint"), "bin": F.lit(0).cast("bigint")})
        other = right.selectExpr("k", "j", "start_seconds r_start", "end_seconds r_end", "0L r_bin", "0L bin")
        cut = intervals.heavy_bins(rows, other, "k", 60.0, intervals.HEAVY)
        dealt = intervals._cut_bins(rows, cut, "k", "start_seconds", "end_seconds", 60.0, "l", "r")
        assert dealt.groupBy("k", "bin", "cut", "l_deal", "r_deal").count().agg(F.max("count")).first()[0] <= most
        best = intervals.overlap_pairs(left, right, "k").groupBy("i").count().agg(F.count("*"), F.sum("count")).first()
        assert best[0] == 10**6 and best[1] >= 10**6
