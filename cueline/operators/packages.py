"""Upload packages: titles, description, tags and hashtags of a request.

Wording is data: a template table with (kind, pos, template) rows, broadcast where it is
counted to be small, and the captions of thumbnails by kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.functions.text import clean, cut_title, hashtag, ordered_distinct

KINDS = ("funny", "challenge", "walkthrough", "boss")
#: Titles of each kind; %n is the name, %t the topic.
TITLES = {
    "funny": ("%n: %t made us laugh", "The funniest minutes of %n", "%n gone wrong: %t", "We can't stop laughing at %n", "%n bloopers: %t"),
    "challenge": ("%n challenge: %t", "Can we survive %t in %n?", "The hardest %n challenge yet", "%n: one try at %t", "We took on %t in %n"),
    "walkthrough": ("%n walkthrough: %t", "How to finish %t in %n", "%n, step by step: %t", "The whole of %t in %n", "%n guide to %t"),
    "boss": ("%n boss: %t", "Beating %t in %n", "The toughest boss of %n", "%n boss run: %t", "%t against us in %n"),
    "other": ("%n highlights: %t", "The best of %n: %t", "%n moments: %t", "What happened in %n: %t", "%n: %t, start to end"),
}


# The tags of a package.
TAGS = ("%n", "%n gameplay", "%n %v", "%n %t", "%v", "%t", "gaming", "gameplay", "gaming video", "gameplay highlights", "%l gaming", "%c")
DESCRIPTION = "%c plays %n: %t.\n\nA %v video for %a.\n\nGame: %n\nType: %v\nTopic: %t\nChannel: %c\n\n%h"


# The captions of a thumbnail by kind of video; %n is the name, %t the topic, in capitals.
CAPTIONS = {
    "funny": ("YE KYA HO GAYA?!", "SAB ULTA PAD GAYA", "BIGGEST FAIL EVER", "CONTROL HI NAHI HUA", "%n GONE WRONG"),
    "challenge": ("CHALLENGE ACCEPTED", "KYA MAIN KAR PAUNGA?", "THIS WAS IMPOSSIBLE", "LAST TRY CLUTCH", "%t COMPLETE?"),
    "walkthrough": ("%t BEGINS", "SECRET PATH FOUND", "YE AREA DANGEROUS HAI", "BOSS KE PAAS PAHUNCH GAYA", "%n FULL ACTION"),
    "boss": ("BOSS FIGHT START!", "YE KITNA TOUGH HAI?!", "ONE LAST ATTEMPT", "BOSS KO HARA DIYA?", "FINAL CLUTCH MOMENT"),
    "other": ("%t STARTS NOW", "YE KYA MIL GAYA?!", "THIS CHANGED EVERYTHING", "SABSE DANGEROUS MOMENT", "%n FULL ACTION"),
}
# What these captions are in English.
ENGLISH_CAPTIONS = {
    "YE KYA HO GAYA?!": "WHAT JUST HAPPENED?!",
    "SAB ULTA PAD GAYA": "EVERYTHING WENT WRONG",
    "CONTROL HI NAHI HUA": "I LOST CONTROL",
    "KYA MAIN KAR PAUNGA?": "CAN I COMPLETE THIS?",
    "YE AREA DANGEROUS HAI": "THIS AREA IS DANGEROUS",
    "BOSS KE PAAS PAHUNCH GAYA": "I REACHED THE BOSS",
    "YE KITNA TOUGH HAI?!": "HOW TOUGH IS THIS?!",
    "BOSS KO HARA DIYA?": "DID I BEAT THE BOSS?",
    "YE KYA MIL GAYA?!": "WHAT DID I FIND?!",
    "SABSE DANGEROUS MOMENT": "THE MOST DANGEROUS MOMENT",
}
# Name, creator's side, zoom, creator's scale and darkening of the five variants.
LAYOUTS = (
    ("strongest_gameplay_reaction", "right", 1.08, 0.92, 82),
    ("curiosity_creator_left", "left", 1.04, 0.88, 78),
    ("high_action_creator_right", "right", 1.12, 0.86, 72),
    ("alternate_reaction_layout", "left", 1.06, 0.90, 80),
    ("experimental_brand_variant", "right", 1.02, 0.84, 68),
)
# The fields of a package, in the order of its file.
FIELDS = (
    "profile_key", "channel_name", "game_name", "video_type", "episode_topic", "preferred_language", "primary_title", "alternate_titles",
    "description", "hashtags", "tags", "source_video",
)
#: Rows of templates that are broadcast at most.
BROADCAST_TEMPLATES = 10_000
#: Requests, about, whose packages one task words.
TASK_REQUESTS = 1 << 13


def is_english(language: Column) -> Column:
    low = F.lower(language)
    return low.contains("english") & ~low.contains("hinglish")


def video_kind(video_type: Column | str) -> Column:
    """First of the known kinds that the type's name holds, in order, else other."""
    low = F.lower(F.col(video_type) if isinstance(video_type, str) else video_type)
    out = F.lit("other")
    for k in reversed(KINDS):
        out = F.when(low.contains(k), F.lit(k)).otherwise(out)
    return out


def title_templates(spark, titles: dict[str, tuple[str, ...]] = TITLES) -> DataFrame:
    return spark.createDataFrame([(k, i, t) for k, ts in titles.items() for i, t in enumerate(ts)], "kind string, pos int, template string")


def translate_captions(captions: DataFrame, translations: dict[str, str], text: str = "caption") -> DataFrame:
    """Replace captions that have an exact translation."""
    if not translations:
        return captions
    table = F.create_map(*[F.lit(x) for kv in translations.items() for x in kv])
    return captions.withColumn(text, F.coalesce(F.try_element_at(table, F.col(text)), F.col(text)))


def caption_variants(requests: DataFrame, profiles: DataFrame, key: str = "request_id", wordings: dict[str, tuple[str, ...]] = CAPTIONS, translations: dict[str, str] = ENGLISH_CAPTIONS) -> DataFrame:
    """(key, variant, caption, descriptive_name, creator_side, gameplay_zoom, creator_scale, darken_strength): five for each request.

    The wording goes by the kind of video, as ``wordings`` has it, a caption for each variant; for a language that is English, captions that have
    an exact translation are translated. A profile without a language counts as English.
    """
    rows = requests.join(profiles.select("profile_key", "preferred_language"), "profile_key", "left")
    texts = F.create_map(*[x for k, v in wordings.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = rows.select(key, F.upper(F.coalesce("game_name", F.lit(""))).alias("name"), F.upper(F.coalesce("episode_topic", F.lit(""))).alias("topic"), F.coalesce("preferred_language", F.lit("English")).alias("language"), F.element_at(texts, video_kind(F.coalesce("video_type", F.lit("")))).alias("captions"))
    rows = rows.select("*", F.posexplode("captions").alias("pos", "caption"))
    rows = rows.withColumn("caption", F.replace(F.replace("caption", F.lit("%n"), F.col("name")), F.lit("%t"), F.col("topic")))
    english = translate_captions(rows.select(key, "pos", "language", "caption", F.col("caption").alias("own")), translations)
    layout = F.element_at(F.array(*[F.struct(F.lit(a).alias("descriptive_name"), F.lit(b).alias("creator_side"), F.lit(c).alias("gameplay_zoom"), F.lit(d).alias("creator_scale"), F.lit(e).alias("darken_strength")) for a, b, c, d, e in LAYOUTS]), F.col("pos") + 1)
    return english.select(key, (F.col("pos") + 1).alias("variant"), F.when(is_english(F.col("language")), F.col("caption")).otherwise(F.col("own")).alias("caption"), layout.alias("l")).select(key, "variant", "caption", "l.*")


def profile_settings(profiles: DataFrame) -> DataFrame:
    """Append logo_enabled and logo_path with their defaults."""
    has = "logo" in profiles.columns
    return profiles.withColumns({"logo_enabled": F.coalesce(F.col("logo.enabled"), F.lit(False)) if has else F.lit(False), "logo_path": F.coalesce(F.col("logo.path"), F.lit("")) if has else F.lit("")})


def _fill(template: Column | str, also: dict[str, Column] | None = None) -> Column:
    """A template with the name (%n), type (%v), topic (%t), language (%l) and channel (%c) of its row."""
    out = F.lit(template) if isinstance(template, str) else template
    for mark, value in {"%n": F.col("name"), "%v": F.col("kind_name"), "%t": F.col("topic"), "%l": F.col("language"), "%c": F.col("channel"), "%a": F.col("audience"), **(also or {})}.items():
        out = F.replace(out, F.lit(mark), value)
    return out


def build_packages(requests: DataFrame, profiles: DataFrame, research: DataFrame, templates: DataFrame, key: str = "request_id", english: dict[str, str] | None = None, description: str = DESCRIPTION) -> DataFrame:
    """Packages of the requests: key and :data:`FIELDS`.

    ``requests``: key, profile_key, game_name, video_type, episode_topic and, if there are any,
    channel_name and video_path; ``profiles``: profile_key, channel_name, preferred_language,
    target_audience; ``research``: key, suggested_name, which replaces the game's name where it
    isn't empty. The request's own channel comes before its profile's. ``english``:
    phrases of titles that are replaced if the language is English. Tags and hashtags are
    without repetition whatever the case, in order; titles stay as many as there are templates.

    Requests are counted, and dealt to tasks of about :data:`TASK_REQUESTS` before they are worded:
    a row takes far more work than bytes, and the joins below may leave all of a file to one task.
    """
    own = lambda c: F.col(c) if c in requests.columns else F.lit(None).cast("string")
    asked = requests.select(key, "profile_key", "game_name", "video_type", "episode_topic", own("channel_name").alias("__channel"), own("video_path").alias("__video"))
    r = asked.join(profiles.select("profile_key", "channel_name", "preferred_language", "target_audience"), "profile_key", "left").join(research.select(key, "suggested_name"), key, "left")
    r = r.repartition(-(-max(1, requests.count()) // TASK_REQUESTS), F.xxhash64(*[F.col(f"`{c}`") for c in r.columns]))
    text = lambda c: clean(F.coalesce(c, F.lit("")))
    suggested = F.when(text("suggested_name") != "", F.col("suggested_name"))
    r = r.withColumns(
        {
            "name": text(F.coalesce(suggested, "game_name")),
            "topic": text("episode_topic"),
            "kind_name": text("video_type"),
            "channel": text(F.coalesce("__channel", "channel_name")),
            "language": clean(F.coalesce("preferred_language", F.lit("English"))),
            "audience": clean(F.coalesce("target_audience", F.lit("gaming viewers"))),
        }
    )
    r = r.withColumn("kind", video_kind("kind_name"))
    by_kind = templates.groupBy("kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "template"))), lambda x: x["template"]).alias("templates"))
    small = templates.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES
    r = r.join(F.broadcast(by_kind) if small else by_kind, "kind", "left")

    def title(template: Column) -> Column:
        plain = _fill(template)
        swapped = plain
        for old, new in (english or {}).items():
            swapped = F.replace(swapped, F.lit(old), F.lit(new))
        return cut_title(F.when(is_english(F.col("language")), swapped).otherwise(plain))

    r = r.withColumn("titles", F.transform("templates", title))
    r = r.withColumn("hashtags", ordered_distinct(F.array(hashtag("name"), F.lit("#Gaming"), F.lit("#Gameplay"), hashtag("kind_name"), F.lit("#GamingVideo"))))
    r = r.withColumn("tags", ordered_distinct(F.array(*map(_fill, TAGS))))
    told = _fill(description, {"%h": F.array_join("hashtags", " ")})
    found = {
        "profile_key": F.col("profile_key"), "channel_name": F.col("channel"), "game_name": F.col("name"), "video_type": F.col("kind_name"), "episode_topic": F.col("topic"), "preferred_language": F.col("language"),
        "primary_title": F.get("titles", F.lit(0)), "alternate_titles": F.slice("titles", 2, 100), "description": told, "hashtags": F.col("hashtags"), "tags": F.col("tags"), "source_video": F.coalesce("__video", F.lit("")),
    }
    return r.select(key, *[found[c].alias(c) for c in FIELDS])
