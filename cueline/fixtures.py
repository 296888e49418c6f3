"""Views over the driver's tables in the schemas of the library.

One hour of events counts as one second, so 30 days make a recording of 720 s.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DURATION = 720.0
RATE = 0.1
BLOCK = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, event_id, event_type, value, t."""
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(base)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), "event_id", "event_type", "value", (micros / 3.6e9).alias("t"))


def numbered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their number ``n`` in the recording and the time ``after`` of the next one."""
    own = Window.partitionBy("media_id").orderBy("t", "event_id")
    return events(spark, sf_dir).withColumns({"n": (F.row_number().over(own) - 1).cast("bigint"), "after": F.lead("t").over(own)})


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).select("media_id").distinct()
    mode = F.when(F.col("media_id") % 2 == 0, "full").otherwise("existing_highlight")
    return ev.select("media_id", F.lit(DURATION).alias("duration_seconds"), mode.alias("mode"))


def speech_segments(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    ev = ev or numbered_events(spark, sf_dir)
    return ev.select("media_id", F.col("n").alias("seg_idx"), "event_id", F.col("t").alias("start"), (F.col("t") + F.col("value") / 100).alias("end"))


def segment_documents(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    """Segments with the ``doc_id`` of the document that they say; all documents are given out in turn."""
    # one row: where the turn begins anew
    turn = table(spark, sf_dir, "documents").agg((F.max("doc_id") + 1).alias("turn")).withColumn("one", F.lit(1))
    seg = speech_segments(spark, sf_dir, ev).withColumn("one", F.lit(1)).join(F.broadcast(turn), "one").withColumn("doc_id", F.col("event_id") % F.col("turn"))
    return seg.select("media_id", "seg_idx", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), "doc_id")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def transcript_segments(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    """Segments with the whole text of a document, see :func:`segment_documents`."""
    seg = segment_documents(spark, sf_dir, ev).join(document_texts(spark, sf_dir), "doc_id", "left")
    return seg.select("media_id", "seg_idx", "start_seconds", "end_seconds", F.coalesce("text", F.lit("")).alias("text"))


def scenes(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    ev = ev or numbered_events(spark, sf_dir)
    return ev.where("after IS NOT NULL").select("media_id", F.col("n").alias("scene_idx"), F.col("t").alias("start_seconds"), F.col("after").alias("end_seconds"))


def audio_blocks(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    """Values as samples, one for each ten seconds, in blocks of 16."""
    ev = ev or numbered_events(spark, sf_dir)
    blocks = ev.groupBy("media_id", F.expr(f"n div {BLOCK}").alias("block_no")).agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("x"))
    return blocks.select("media_id", "block_no", (F.col("block_no") * BLOCK).alias("start_sample"), F.lit(RATE).alias("sample_rate"), F.transform("x", lambda v: v["value"] / 300).alias("samples"))


def event_frames(spark: SparkSession, sf_dir: str, ev: DataFrame | None = None) -> DataFrame:
    ev = ev or numbered_events(spark, sf_dir)
    return ev.select("media_id", F.col("n").alias("frame_number"), F.array(F.col("value") / 300, (F.col("event_id") % 7) / 7.0).alias("gray"))


def embedding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("media_id"), F.col("vec_id").alias("frame_number"), F.col("embedding").alias("gray"))


def embedding_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scene for every 100 frames in which a recording has any."""
    rows = embedding_frames(spark, sf_dir).select("media_id", F.expr("frame_number div 100").alias("scene_idx")).distinct()
    return rows.select("media_id", "scene_idx", (F.col("scene_idx") * 100.0).alias("start_seconds"), (F.col("scene_idx") * 100.0 + 100).alias("end_seconds"))


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw answers: JSON in prose, every 7th cut off, every 11th with a raw newline inside a text."""
    ev = numbered_events(spark, sf_dir)
    c = F.format_string("%.4f", F.col("value") / 300)
    reason = F.when(F.col("event_id") % 11 == 0, F.lit("two\nlines")).otherwise(F.lit("one line"))
    body = F.concat(F.lit('{"category": "'), F.col("event_type"), F.lit('", "reason": "'), reason, F.lit('", "is_interesting": '), F.when(F.col("event_id") % 3 == 0, F.lit('"TRUE"')).otherwise(F.lit("false")), F.lit(', "keep_highlight": true, "action_level": "High", "confidence": '), c, F.lit(', "final_confidence": "'), c, F.lit('"'))
    body = F.when(F.col("event_id") % 7 == 0, body).otherwise(F.concat(body, F.lit("}")))
    return ev.select("media_id", (F.col("n") + 1).alias("rank"), "event_id", "event_type", "t", F.concat(F.lit("Sure: "), body, F.lit(" Done.")).alias("raw_text"))


def metadata_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw metadata answers, cut off and broken like those of :func:`model_responses`."""
    ev = numbered_events(spark, sf_dir)
    hook = F.when(F.col("event_id") % 11 == 0, F.lit("two\nlines")).otherwise(F.lit("one line"))
    body = F.concat(F.lit('{"hook": "'), hook, F.lit('", "title": " '), F.col("event_type"), F.lit('", "hashtags": ["#'), F.col("event_type"), F.lit('", " ", null, "#clip"]'))
    body = F.when(F.col("event_id") % 7 == 0, body).otherwise(F.concat(body, F.lit("}")))
    return ev.select("media_id", (F.col("n") + 1).alias("rank"), F.concat(F.lit("Sure: "), body, F.lit(" Done.")).alias("raw_text"))


def profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles as JSON texts, some of which break a rule."""
    k = F.col("s_suppkey")
    name = F.when(k % 7 == 0, F.lit("7")).otherwise(F.concat(F.lit('"'), F.col("s_name"), F.lit('"')))
    colours = F.when(k % 3 == 0, F.lit('"red"')).otherwise(F.lit('["red", "blue"]'))
    face = F.when(k % 5 == 0, F.lit("")).otherwise(F.lit(', "ai_face_generation": false'))
    body = F.concat(F.lit('{"channel_name": '), name, F.lit(', "target_audience": null, "preferred_language": "English", "brand_colors": '), colours, F.lit(', "logo": {}, "creator_photos_folder": "", "style": "bold"'), face, F.lit("}"))
    return table(spark, sf_dir, "supplier").select(k.alias("profile_key"), F.when(k % 11 == 0, F.lit("[1]")).otherwise(body).alias("profile_json"))


def metadata_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as attempts, hook and title the whole text; the words of even turns carry a hashtag mark."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("attempt"), F.coalesce("text", F.lit("")).alias("text"), (F.col("turn") % 2 == 0).alias("marked"))
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w != "")
    tags = F.transform(words, lambda w: F.when(F.col("marked"), F.concat(F.lit("#"), w)).otherwise(w))
    return conv.select("conv_id", "attempt", F.col("text").alias("hook"), F.col("text").alias("title"), tags.alias("hashtags"))


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as results of a request to their host; every third once more under a URL with a slash."""
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    plain = F.regexp_replace(F.regexp_replace("html", "(?s)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]*>", " ")
    rows = table(spark, sf_dir, "pages").select(host.alias("request_id"), (F.col("page_id") * 2).alias("pos"), F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), "url", plain.alias("summary"), F.lit("q").alias("query"))
    again = rows.where("(pos div 2) % 3 = 0").withColumns({"pos": F.col("pos") + 1, "url": F.concat("url", F.lit("/")), "title": F.concat(F.lit("Again "), "title")})
    return rows.unionByName(again)


def result_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search_results(spark, sf_dir).select("request_id").distinct()
    name = F.regexp_extract("request_id", r"^(?:www\.|m\.)?([^.]*)", 1)
    return rows.select("request_id", name.alias("game_name"), _kinds(F.length("request_id")).alias("video_type"), F.upper(name).alias("episode_topic"))


def frame_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    d = lambda c: F.col(c).cast("double")
    return li.select(F.col("l_orderkey").alias("request_id"), seq.alias("sequence"), (d("l_quantity") * 5).alias("brightness"), (d("l_discount") * 800).alias("contrast"), (d("l_extendedprice") / 100).alias("sharpness"), (d("l_quantity") * 3).alias("saturation"), d("l_tax").alias("edge_density"))


def ranking_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"))
    kind = F.when(F.col("l_partkey") % 50 == 0, ".mov").otherwise(".MP4")
    said = F.when(F.col("l_suppkey") % 40 == 0, F.concat("l_returnflag", F.lit(" two"))).when(F.col("l_suppkey") % 41 == 0, F.lit(" ")).otherwise(F.col("l_returnflag"))
    return li.select(F.col("l_orderkey").alias("list_id"), pos.alias("pos"), F.concat(F.lit("clip_"), F.col("l_partkey").cast("string"), kind).alias("video_path"), F.col("l_linenumber").cast("int").alias("rank"), said.alias("description"))


def session_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    layout = F.when(F.col("o_orderkey") % 3 == 0, "portrait").when(F.col("o_orderkey") % 3 == 1, "face_top").otherwise("wide")
    name = lambda what, ext: F.concat(F.lit(what), F.col("o_custkey").cast("string"), F.lit(ext))
    return o.select(
        F.col("o_orderkey").alias("session_id"),
        layout.alias("layout"),
        F.when(F.col("o_custkey") % 11 == 0, F.lit(None).cast("string")).otherwise(name("rec", ".mp4")).alias("recording_video"),
        F.when(F.col("o_custkey") % 7 == 0, F.lit("")).when(F.col("o_custkey") % 5 == 0, name("rec", ".mp4")).otherwise(name("game", ".MP4")).alias("gameplay_video"),
        F.when(F.col("o_custkey") % 13 == 0, name("face", ".mkv")).otherwise(name("face", ".mp4")).alias("facecam_video"),
    )


def probe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as probe output: some without video, sound or a readable rate, some cut off."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("string").alias("s"), F.col("p_size").alias("n"))
    rate = F.when(F.col("n") % 4 == 0, F.concat("s", F.lit("/0"))).when(F.col("n") % 4 == 1, F.concat("s", F.lit("000/1001"))).otherwise(F.col("s"))
    video = F.concat(F.lit('{"codec_type":"video","codec_name":"h264","width":"'), (F.col("n") * 16).cast("string"), F.lit('","height":"'), (F.col("n") * 9).cast("string"), F.lit('","avg_frame_rate":"'), rate, F.lit('","r_frame_rate":"30/1"}'))
    sound = F.lit('{"codec_type":"audio","codec_name":"aac","bit_rate":"128000"}')
    streams = F.when(F.col("n") % 9 == 0, sound).when(F.col("n") % 6 == 0, video).otherwise(F.concat(video, F.lit(","), sound))
    body = F.concat(F.lit('{"streams":['), streams, F.lit('],"format":{"duration":"'), F.when(F.col("n") % 10 == 0, F.lit("0")).otherwise(F.col("s")), F.lit('.5","size":"'), (F.col("p_partkey") * 1000).cast("string"), F.lit('"}}'))
    return p.select(F.col("p_partkey").alias("media_id"), F.when(F.col("n") % 17 == 0, F.substring(body, 1, 40)).otherwise(body).alias("probe_json"))


def _kinds(place):
    return F.element_at(F.array(*[F.lit(x) for x in ("Funny cuts", "Challenge run", "Full Walkthrough", "BOSS fight", "Stream")]), (place % 5 + 1).cast("int"))


def package_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as requests; all suppliers' profiles are given out in turn, and one more key that has none."""
    p = table(spark, sf_dir, "part").withColumn("one", F.lit(1))
    # one row: where the turn begins anew
    turn = table(spark, sf_dir, "supplier").agg((F.max("s_suppkey") + 1).alias("turn")).withColumn("one", F.lit(1))
    rows = p.join(F.broadcast(turn), "one")
    path = F.concat(F.lit("/videos/"), F.col("p_partkey").cast("string"), F.lit(".mp4"))
    return rows.select(F.col("p_partkey").alias("request_id"), (F.col("p_partkey") % F.col("turn") + 1).alias("profile_key"), F.col("p_name").alias("game_name"), _kinds(F.col("p_partkey")).alias("video_type"), F.col("p_brand").alias("episode_topic"), path.alias("video_path"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("profile_key"),
        F.col("s_name").alias("channel_name"),
        F.when(F.col("s_suppkey") % 3 == 0, "Hinglish").when(F.col("s_suppkey") % 3 == 1, "English").alias("preferred_language"),
        F.when(F.col("s_suppkey") % 2 == 0, " night  owls ").alias("target_audience"),
    )
