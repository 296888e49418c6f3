"""Known answers, and folds against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from cueline.functions import text as tx
from cueline.functions import timecode as tc
from cueline.operators import captions, decisions, intervals, moments, packages, research, responses, scoring, signals, textclean
from cueline.sources import checks, inputs, sinks


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_score_and_candidates(spark):
    feats = spark.createDataFrame([(1, 0, 21.0, 26.17, 0.6315, 17, 1.0), (1, 1, 26.17, 28.9, 1.0, 4, 0.6282), (1, 2, 28.9, 31.3, 0.4584, 0, 0.6878)], "media_id long, scene_idx int, start_seconds double, end_seconds double, average_motion_score double, speech_word_count int, average_audio_rms double")
    scored = scoring.score_scenes(feats)
    assert [round(x, 4) for (x,) in rows(scored.orderBy("scene_idx"), "final_score")] == [0.8342, 0.6776, 0.3782]
    media = spark.createDataFrame([(1, 31.3)], "media_id long, duration_seconds double")
    got = rows(scoring.select_candidates(scored, media).orderBy("rank"), "rank", "scene_idx", "start_seconds", "end_seconds")
    assert got == [(1, 0, 0.0, 31.3), (2, 1, 0.0, 31.3)]


@pytest.mark.parametrize(("scene", "clip"), [((100.0, 110.0), (82.5, 127.5)), ((2.0, 4.0), (0.0, 45.0)), ((990.0, 1000.0), (955.0, 1000.0)), ((100.0, 400.0), (177.5, 322.5))])
def test_clip_window(spark, scene, clip):
    df = spark.createDataFrame([(*scene, 1000.0)], "s double, e double, d double")
    assert rows(df, *scoring.clip_window("s", "e", "d")) == [clip]


def test_suppression_keeps_what_an_anti_join_would_drop(spark):
    clips = spark.createDataFrame([(1, 1, 0.0, 100.0, 50.0), (1, 2, 3.0, 103.0, 52.0), (1, 3, 6.0, 106.0, 54.0)], "media_id long, rank int, start_seconds double, end_seconds double, middle double")
    assert sorted(rows(intervals.suppress_near_duplicates(clips), "rank")) == [(1,), (3,)]


def test_gap_merge_and_short_merge(spark):
    seg = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate([(0, 3), (4, 9), (10, 19), (20, 25), (40, 41)])], "media_id long, seg_idx int, start double, end double")
    assert rows(intervals.merge_gaps(seg, 2, 20).orderBy("chunk_idx"), "start", "end") == [(0, 19), (20, 25), (40, 41)]
    sc = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate([(0, 1), (1, 1.5), (1.5, 4), (4, 5)])], "media_id long, scene_idx int, start_seconds double, end_seconds double")
    assert rows(intervals.merge_short(sc).orderBy("scene_idx"), "start_seconds", "end_seconds") == [(0, 4), (4, 5)]


def test_folds_against_loops(spark):
    rng = random.Random(5)
    segs, points = [], []
    want_chunks, want_points = set(), set()
    for m in range(150):
        t, own = 0.0, []
        for i in range(rng.randint(1, 25)):
            a = t + rng.choice([0.5, 1.0, 2.0, 2.5, 4.0])
            b = a + rng.choice([0.5, 3.0, 8.0, 25.0])
            own.append((a, b))
            segs.append((m, i, a, b))
            t = b
        cur = list(own[0])
        for a, b in own[1:]:
            if a - cur[1] <= 2 and b - cur[0] <= 20:
                cur[1] = b
            else:
                want_chunks.add((m, *cur))
                cur = [a, b]
        want_chunks.add((m, *cur))
        kept = None
        for a, _ in own:
            points.append((m, a))
            if kept is None or a - kept >= 5:
                kept = a
                want_points.add((m, a))
    df = spark.createDataFrame(segs, "media_id long, seg_idx int, start double, end double")
    assert set(rows(intervals.merge_gaps(df, 2, 20), "media_id", "start", "end")) == want_chunks
    assert set(rows(intervals.thin(spark.createDataFrame(points, "media_id long, t double"), 5), "media_id", "t")) == want_points


def test_overlap_tie_and_touch(spark):
    sc = spark.createDataFrame([(1, 0, 0.0, 5.0), (1, 1, 5.0, 10.0)], "media_id long, scene_idx int, start_seconds double, end_seconds double")
    seg = spark.createDataFrame([(1, 0, 4.0, 6.0), (1, 1, 10.0, 11.0)], "media_id long, seg_idx int, start_seconds double, end_seconds double")
    assert rows(intervals.assign_by_overlap(seg, sc, bin_width=1.0), "seg_idx", "scene_idx") == [(0, 0)]


def test_captions_and_times(spark):
    clip = spark.createDataFrame([(1, " ".join("w%d" % i for i in range(14)), 11.17), (2, "  ", 5.0)], "id long, transcript_text string, duration_seconds double")
    got = rows(captions.build_captions(clip, ["id"]).orderBy("caption_idx"), "start_seconds", "end_seconds", F.size(tx.words("text")))
    assert [n for *_, n in got] == [4, 4, 4, 2]
    assert got[1][0] == pytest.approx(2.7925) and got[-1][1] == 11.17
    docs = dict(rows(captions.subtitle_documents(captions.build_captions(clip, ["id"]), clip, ["id"]), "id", "document"))
    assert docs[2] == "" and docs[1].startswith("1\n00:00:00,000 --> 00:00:02,792\nw0 w1 w2 w3\n\n2\n") and docs[1].endswith("w13\n")
    df = spark.createDataFrame([(0.0,), (2.79,), (8.38,), (11.17,), (-1.0,), (3725.0005,)], "x double")
    assert [x for (x,) in rows(df, tc.srt_time("x"))] == ["00:00:00,000", "00:00:02,790", "00:00:08,380", "00:00:11,170", "00:00:00,000", "01:02:05,000"]


def test_responses(spark):
    raw = ['ok {"is_interesting":"TRUE","confidence":"1.7"} bye', "no json", '{"category": null, "confidence": [1], "is_interesting": 2}', "\x1b[31m{\"reason\": \"a\nb\"}\x1b[0m", "{broken}", None, "", "[{\"a\":1}]"]
    df = spark.createDataFrame(list(enumerate(raw)), "i int, raw_text string")
    got = {r.i: (r.is_interesting, r.category, r.reason, r.confidence) for r in responses.commentary(df).collect()}
    assert got[0] == (True, "unknown", "", 1.0)
    assert got[1] == (False, "unknown", responses.FAILURES[0], 0.0)
    assert got[2] == (True, "None", "", 0.0)
    assert got[3][2] == "a b"
    assert got[4][2] == responses.FAILURES[1]
    assert got[5] == got[6] == got[1]
    seen = {r.i: r for r in responses.visual(df).collect()}
    assert (seen[1].action_level, seen[1].danger_level, seen[1].looks_interesting, seen[1].confidence) == ("low", "low", False, 0.0)
    meta = spark.createDataFrame([(1, '{"hook": "wow wow now", "title": "the the end", "hashtags": ["#a a", " ", 3]}'), (2, '{"hashtags": "x"}')], "i int, raw_text string")
    made = {r.i: r for r in responses.metadata(meta).collect()}
    assert (made[1].hook, made[1].title, made[1].hashtags) == ("wow now", "the end", ["#a", "3"])
    assert made[2].hashtags == []


def test_responder_retries_once_per_row(spark):
    def set_up():
        seen = set()

        def ask(prompt):
            if prompt not in seen:
                seen.add(prompt)
                raise TimeoutError
            if prompt == "never":
                raise TimeoutError
            return prompt.upper()

        return ask

    df = spark.createDataFrame([("a",), ("never",)], "prompt string")
    assert dict(rows(responses.respond(df, set_up, pause=0), "prompt", "raw_text")) == {"a": "A", "never": None}


def test_final_order_drops_nothing(spark):
    df = spark.createDataFrame([(1, 1, 0.93), (1, 2, 0.88), (1, 3, 0.60), (1, 4, 0.90)], "media_id long, rank int, final_confidence double")
    assert [r for (r,) in rows(decisions.rank_final(df).orderBy("position"), "rank")] == [1, 4, 2, 3]


def test_run_total(spark):
    stages = [0.10, 0.10, 0.30, 0.03, 18.21, 3.35, 0.0, 4.77, 0.0, 0.0, 0.0, 0.0, 0.0, 6.57, 11.17, 0.0, 0.34, 0.31, 2.61, 11.56, 11.82, 15.15, 13.51, 0.0, 0.0, 0.03, 68.94]
    df = spark.createDataFrame([("r", str(i), s) for i, s in enumerate(stages)], "run_id string, stage string, duration_seconds double")
    (total, n), = rows(decisions.summarise_runs(df), "total_seconds", "stages")
    assert round(total, 2) == 168.87 and n == 27


def test_frame_picks(spark):
    clips = spark.createDataFrame([(1, 1, 100)], "media_id long, rank int, frame_count long")
    assert [x for (x,) in rows(signals.representative_frames(clips).orderBy("pos"), "frame_number")] == [0, 50, 99]
    pts = spark.createDataFrame([(1, float(t)) for t in range(4)], "media_id long, t double")
    assert sorted(rows(moments.pick_spread(pts, 3), "t")) == [(0.0,), (2.0,), (3.0,)]
    assert rows(moments.pick_spread(pts, 1), "t") == [(2.0,)]


def test_text_columns(spark):
    df = spark.createDataFrame([("one two three four five six",)], "x string")
    assert rows(df, tx.caption_lines("x", "NOW")) == [(["one two three", "four five", "six"],)]
    df = spark.createDataFrame([(["a", "A", "b"], "A title of many words that goes on", " ", "Ünï-code 9!")], "a array<string>, t string, b string, u string")
    got = rows(df, tx.ordered_distinct("a"), tx.cut_title("t", 20), tx.slug("b"), tx.safe_name("u"), tx.hashtag("u"))[0]
    assert got == (["a", "b"], "A title of many...", "untitled", "Ünï_code_9", "#ncode9")
    assert tx.DISALLOWED_SCRIPTS


def test_collapse(spark):
    texts = ["so so good", "go on go on now", "'ab' 'ab' x", "happ happy day", None, "", "  a  b  "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = dict(rows(df.select("i", textclean.collapse("t").alias("c")), "i", "c"))
    assert got == {0: "so good", 1: "go on now", 2: "'ab' x", 3: "happy day", 4: None, 5: "", 6: "a b"}


def test_research(spark):
    raw = spark.createDataFrame(
        [("r", 0, "Lava  Run - Wiki", "https://www.roblox.com/lava/", "boss fight boss", "q"), ("r", 1, "Other", "https://WWW.roblox.com/LAVA", "x", "q"), ("r", 2, "LAVA run wiki!", "https://b.org/1", "x", "q"), ("r", 3, "", "https://c.org", "x", "q")],
        "request_id string, pos int, title string, href string, body string, query string",
    )
    res = research.dedupe_results(research.normalise_results(raw))
    assert rows(res.orderBy("pos"), "pos", "domain") == [(0, "roblox.com")]
    req = spark.createDataFrame([("r", "lava rum"), ("s", "quiet")], "request_id string, game_name string")
    names = research.best_names(res, req)
    assert dict(rows(names, "request_id", "suggested_name")) == {"r": "Lava Run", "s": "quiet"}
    terms = dict(rows(research.top_terms(research.result_words(res, names), req), "request_id", "terminology"))
    assert terms == {"r": ["Boss Fight", "Boss", "Fight"], "s": list(research.DEFAULT_TERMS)}


def test_rankings(spark):
    clips = [("a", 1, "x.mp4", 1, "go"), ("a", 2, "y.MP4", 2, "stop"), ("b", 1, "x.mp4", 1, "go"), ("c", 1, "x.mp4", 1, "go"), ("c", 2, "x.mp4", 1, "go"), ("d", 1, "x.mp4", 0, "go"), ("d", 2, "x.mov", 2, "go"), ("e", 1, "x.mp4", 1, "two words"), ("e", 2, "x.mp4", 2, "w" * 25)]
    df = spark.createDataFrame(clips, "list_id string, pos int, video_path string, rank int, description string")
    assert dict(rows(checks.check_rankings(df), "list_id", "first_violation")) == {"a": None, "b": "fewer than two clips", "c": "rank is used twice", "d": "rank is not positive", "e": "description is not one word"}


def test_assets_and_sinks(spark, tmp_path):
    import struct
    import zlib

    def png(w, h, kind):
        head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
        return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + head + struct.pack(">I", zlib.crc32(b"IHDR" + head))

    (tmp_path / "a.PNG").write_bytes(png(30, 20, 6))
    (tmp_path / "b.png").write_bytes(b"nothing")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "d.jpg").write_bytes(b"\xff\xd8\xff\xc0" + struct.pack(">HBHH", 17, 8, 7, 9) + b"\0" * 12)
    got = {p.rsplit("/", 1)[1]: tuple(x) for p, *x in rows(inputs.read_assets(spark, f"file://{tmp_path}"), "image_path", "width", "height", "image_format", "has_transparency", "valid")}
    assert got == {"a.PNG": (30, 20, "png", True, True), "b.png": (None, None, None, None, False), "d.jpg": (9, 7, "jpeg", False, True)}
    # a preview of 200,000 bytes comes before the size, and pixels after it are never read
    preview = b"".join(b"\xff\xe1" + struct.pack(">H", 50_002) + b"p" * 50_000 for _ in range(4))
    deep = tmp_path / "sub folder" / "e%20é.jpeg"
    deep.parent.mkdir()
    deep.write_bytes(b"\xff\xd8" + preview + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 70, 90) + b"\0" * 12)
    with open(tmp_path / "f.png", "wb") as f:
        f.write(png(64, 48, 2))
        f.truncate(1 << 33)
    got = {p.rsplit("/", 1)[1]: tuple(x) for p, *x in rows(inputs.read_assets(spark, f"file://{tmp_path}"), "image_path", "width", "height", "image_format", "has_transparency", "valid")}
    assert got["e%20é.jpeg"] == (90, 70, "jpeg", False, True) and got["f.png"] == (64, 48, "png", False, True) and len(got) == 5
    (tmp_path / "f.png").unlink()
    whole = inputs.asset_inventory(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"file://{tmp_path}"))
    assert {p.rsplit("/", 1)[1]: tuple(x) for p, *x in rows(whole, "image_path", "width", "height", "image_format", "has_transparency", "valid")} == {k: v for k, v in got.items() if k != "f.png"}
    out = f"file://{tmp_path}/out"
    df = spark.createDataFrame([(1, "a"), (2, "b")], "media_id long, document string")
    sinks.write_partitions(df, out, "media_id", "document")
    sinks.write_partitions(df.where("media_id = 2").withColumn("document", F.lit("c")), out, "media_id", "document")
    assert sorted(rows(spark.read.text(out), "media_id", "value")) == [(1, "a"), (2, "c")]


def test_packages_of_unknown_profile(spark):
    req = spark.createDataFrame([(1, 9, "  Lava ", None, "Boss")], "request_id long, profile_key int, game_name string, video_type string, episode_topic string")
    prof = spark.createDataFrame([], "profile_key int, channel_name string, preferred_language string, target_audience string")
    found = spark.createDataFrame([], "request_id long, suggested_name string")
    got = packages.build_packages(req, prof, found, packages.title_templates(spark)).first()
    assert got.primary_title and len(got.alternate_titles) == 4 and got.game_name == "Lava" and got.preferred_language == "English"
    assert got.hashtags == ["#Lava", "#Gaming", "#Gameplay", "#GamingVideo"] and got.tags[:3] == ["Lava", "Lava gameplay", "Lava "]


def test_stream_of_responses(spark, tmp_path):
    from cueline import streaming

    src, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame([(1, 1, 1, '{"confidence": 0.5}')], "media_id bigint, rank int, attempt int, raw_text string").write.parquet(src)
    q = streaming.write_rows(streaming.normalise_stream(streaming.read_responses(spark, src), "commentary"), out, f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.read.parquet(out), "rank", "confidence") == [(1, 0.5)]
