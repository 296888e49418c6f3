"""Incoming tables: manifests, probe output, scene-cut logs, images, profiles."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.functions.text import strip

LAYOUTS = ("portrait", "face_top")
PROBE_SCHEMA = (
    "streams array<struct<codec_type:string,codec_name:string,width:string,height:string,avg_frame_rate:string,r_frame_rate:string,bit_rate:string,"
    "tags:struct<rotate:string>>>, format struct<filename:string,duration:string,size:string,bit_rate:string>"
)
PROFILE_FIELDS = ("channel_name", "target_audience", "preferred_language", "brand_colors", "logo", "creator_photos_folder", "style", "ai_face_generation")
IMAGE_TYPES = ("jpg", "jpeg", "png", "webp")
#: Bytes of an image's head that are read, one after the other until its size is found: a preview may come before it.
HEADS = (1 << 12, 1 << 17, 1 << 22)


def check_sessions(manifest: DataFrame) -> DataFrame:
    """Append ``error``, null where a session manifest is valid; the first rule broken is told.

    The recording ends in .mp4, whatever the case; the layout is portrait, which needs
    nothing else, or face_top, which has three different .mp4 files.
    """
    bare = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    mp4 = lambda c: F.lower(bare(c)).endswith(".mp4")
    paths = ("recording_video", "gameplay_video", "facecam_video")
    error = (
        F.when(bare("recording_video") == "", "no recording")
        .when(~mp4("recording_video"), "not an mp4 file")
        .when(F.col("layout") == "portrait", F.lit(None))
        .when(~F.coalesce(F.col("layout").isin(*LAYOUTS), F.lit(False)), "unknown layout")
        .when((bare("gameplay_video") == "") | (bare("facecam_video") == ""), "face_top needs three videos")
        .when(~(mp4("gameplay_video") & mp4("facecam_video")), "not an mp4 file")
        .when(F.size(F.array_distinct(F.array(*map(bare, paths)))) < 3, "a video is given twice")
    )
    return manifest.withColumn("error", error)


def frame_rate(text: Column) -> Column:
    """Frames a second of a fraction or a number; a zero denominator and unreadable text give 0."""
    part = F.split(text, "/")
    top, below = F.get(part, F.lit(0)).try_cast("double"), F.coalesce(F.get(part, F.lit(1)), F.lit("1")).try_cast("double")
    return F.coalesce(F.try_divide(top, below), F.lit(0.0))


def probe_media(probes: DataFrame, text: str = "probe_json", strict: bool = True) -> DataFrame:
    """Media columns of probe output as JSON text, and ``reject_reason``.

    First video and first audio stream. Strict: the average frame rate, or the nominal one
    where it isn't told, and rows without video, duration or size are rejected; a missing
    video codec is unknown. Otherwise the nominal rate, '' for a missing codec and no
    rejects but unreadable JSON. A zero denominator gives rate 0; missing bitrates are 0.
    """
    rows = probes.withColumn("p", F.from_json(text, PROBE_SCHEMA))
    of = lambda kind: F.get(F.filter("p.streams", lambda s: s["codec_type"] == kind), F.lit(0))
    rows = rows.withColumn("v", of("video")).withColumn("a", of("audio"))
    whole = lambda c: F.coalesce(F.col(c).try_cast("bigint"), F.lit(0).cast("bigint"))
    told = F.when(F.col("v.avg_frame_rate") != "", F.col("v.avg_frame_rate"))
    rate = frame_rate(F.coalesce(told, F.col("v.r_frame_rate"))) if strict else frame_rate(F.col("v.r_frame_rate"))
    out = {
        "duration_seconds": F.coalesce(F.col("p.format.duration").try_cast("double"), F.lit(0.0)),
        "width": whole("v.width").cast("int"),
        "height": whole("v.height").cast("int"),
        "fps": rate,
        "video_codec": F.coalesce("v.codec_name", F.lit("unknown" if strict else "")),
        "audio_codec": F.coalesce("a.codec_name", F.lit("")),
        "video_bitrate": whole("v.bit_rate"),
        "audio_bitrate": whole("a.bit_rate"),
        "file_size": whole("p.format.size"),
        "rotation": whole("v.tags.rotate").cast("int"),
        "has_audio": F.col("a").isNotNull(),
    }
    rows = rows.withColumns(out)
    broken = F.col("p").isNull() | F.col("p.streams").isNull() | F.col("p.format").isNull()
    reason = F.when(broken, "unreadable")
    if strict:
        reason = reason.when(F.col("v").isNull(), "no video stream").when(F.col("duration_seconds") <= 0, "no duration").when((F.col("width") <= 0) | (F.col("height") <= 0), "no frame size")
    return rows.withColumn("reject_reason", reason).drop("p", "v", "a", text)


def scene_cut_times(logs: DataFrame, text: str = "value", key: str = "media_id") -> DataFrame:
    """(key, pos, t): all times in a tool's log text, in order."""
    found = F.regexp_extract_all(text, F.lit(r"pts_time:(\d+(?:\.\d+)?)"), F.lit(1))
    return logs.select(key, F.posexplode(found).alias("pos", "x")).select(key, "pos", F.col("x").cast("double").alias("t"))


def read_scene_logs(spark: SparkSession, path: str) -> DataFrame:
    """One row for each log file: media_id from its name, and its text."""
    rows = spark.read.text(path, wholetext=True)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("media_id"), "value")


def read_header(b: bytes) -> tuple:
    """(width, height, format, alpha channel) from the head of an image file; nulls if it can't be read."""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 26:
        w, h = struct.unpack(">II", b[16:24])
        return w, h, "png", b[25] in (4, 6) or b"tRNS" in b[:4096]
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(b):
            if b[at] != 0xFF:
                return None, None, None, None
            kind, size = b[at + 1], struct.unpack(">H", b[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", b[at + 5 : at + 9])
                return w, h, "jpeg", False
            at += 2 + size
    if b[:4] == b"RIFF" and b[8:12] == b"WEBP" and len(b) >= 30:
        if b[12:16] == b"VP8X":
            return 1 + int.from_bytes(b[24:27], "little"), 1 + int.from_bytes(b[27:30], "little"), "webp", bool(b[20] & 16)
        if b[12:16] == b"VP8L":
            bits = int.from_bytes(b[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "webp", bool(bits >> 28 & 1)
        if b[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", b[26:30])
            return w & 0x3FFF, h & 0x3FFF, "webp", False
    return None, None, None, None


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("image_format", T.StringType()), T.StructField("has_transparency", T.BooleanType())]))
def image_header(content: pd.Series) -> pd.DataFrame:
    """:func:`read_header` of each file."""
    return pd.DataFrame([read_header(bytes(b)) for b in content], columns=["width", "height", "image_format", "has_transparency"])


def asset_inventory(files: DataFrame) -> DataFrame:
    """(image_path, width, height, image_format, has_transparency, valid) of a binaryFile table's images.

    has_transparency says whether the file has an alpha channel (or a palette's alpha
    chunk); pixels aren't decoded. Unreadable images have valid false and null fields.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.where(kind.isin(*IMAGE_TYPES)).select(F.col("path").alias("image_path"), image_header("content").alias("h"))
    return rows.select("image_path", "h.*").withColumn("valid", F.col("width").isNotNull())


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    """What opens a file, and its name there; other schemes than pyarrow's raise."""
    scheme, rest = path.split(":", 1) if ":" in path else ("file", path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, name = re.match(r"(//[^/]*)(.*)", rest).groups()
    system, base = fs.FileSystem.from_uri(f"{scheme}:{authority}/")
    return system, base.rstrip("/") + name


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """Asset inventory of a folder, with its sub-folders, see :func:`asset_inventory`.

    Spark lists the files; of each one only its head is read, more of it where that isn't
    enough, up to the last of :data:`HEADS`. Folders of stores that only Spark opens are read
    whole.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    try:
        _file_system(path)
    except (ValueError, NotImplementedError, AttributeError, OSError):
        return asset_inventory(files)
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    named = files.select("path").where(kind.isin(*IMAGE_TYPES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name in batch.column(0).to_pylist():
                system, own = _file_system(name)
                with system.open_input_file(own) as file:
                    size, header = file.size(), (None,) * 4
                    for most in HEADS:
                        header = read_header(file.read_at(min(most, size), 0))
                        if header[0] is not None or most >= size:
                            break
                found.append(header)
            columns = [pa.array(list(c), t) for c, t in zip(zip(*found, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.bool_()), strict=True)] if found else [pa.array([], t) for t in (pa.int32(), pa.int32(), pa.string(), pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["image_path", "width", "height", "image_format", "has_transparency"])

    rows = named.mapInArrow(run, "image_path string, width int, height int, image_format string, has_transparency boolean")
    return rows.withColumn("valid", F.col("width").isNotNull())


def check_profiles(profiles: DataFrame) -> DataFrame:
    """Append ``missing``: required fields that a profile lacks; an empty array is a valid profile."""
    lacks = [F.when(F.col(f).isNull() if f in profiles.columns else F.lit(True), F.lit(f)) for f in PROFILE_FIELDS]
    return profiles.withColumn("missing", F.array_compact(F.array(*lacks)))


def profile_errors(documents: DataFrame, text: str = "profile_json") -> DataFrame:
    """Append ``error``, null where a profile, a JSON object, is valid; the first rule broken is told.

    All required fields are there, a null counts; channel_name is a text, brand_colors a list.
    """
    v = F.try_parse_json(text)
    kind = lambda c: F.schema_of_variant(F.try_variant_get("__v", f"$.{c}", "variant"))
    absent = F.array_compact(F.array(*[F.when(F.try_variant_get("__v", f"$.{c}", "variant").isNull(), F.lit(c)) for c in PROFILE_FIELDS]))
    rows = documents.withColumn("__v", v)
    rows = rows.withColumn("__absent", absent)
    error = (
        F.when(F.col("__v").isNull() | ~F.schema_of_variant("__v").startswith("OBJECT"), F.lit("not a mapping"))
        .when(F.size("__absent") > 0, F.concat(F.lit("missing: "), F.array_join("__absent", ", ")))
        .when(kind("channel_name") != "STRING", F.lit("channel_name is not a text"))
        .when(~kind("brand_colors").startswith("ARRAY"), F.lit("brand_colors is not a list"))
    )
    return rows.withColumn("error", error).drop("__v", "__absent")


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(profile_key, profile_json, error) of every profile in files that each hold one JSON object by key; see :func:`profile_errors`."""
    files = spark.read.text(path, wholetext=True).select(F.try_variant_get(F.try_parse_json("value"), F.lit("$"), "map<string,variant>").alias("m"))
    rows = files.select(F.explode("m").alias("profile_key", "v")).select("profile_key", F.to_json("v").alias("profile_json"))
    return profile_errors(rows)
