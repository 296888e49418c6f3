"""Search results: normalising, deduplicating, names and terms."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.functions.text import clean, comparison_key, ordered_distinct, title_case
from cueline.operators.graphs import connected_components
from cueline.storage import materialise, release, scratch, together

# The vocabularies that terms and names are restricted to.
TERMS = (
    "adventure", "battle", "boss", "challenge", "character", "combat", "controller", "escape", "fail", "fight", "funniest",
    "funny", "highlight", "highlights", "horror", "jump", "jumpscare", "level", "mission", "moment", "moments",
    "multiplayer", "obby", "parkour", "quest", "reaction", "scary", "secret", "speedrun", "survival", "update", "walkthrough",
)
PHRASES = ("boss battle", "boss fight", "funny moments", "gameplay highlights", "horror gameplay", "jump scare", "secret ending", "survival challenge")
DEFAULT_TERMS = ("Gameplay", "Gaming", "Highlights", "Reaction")
AUTHORITIES = (
    "roblox.com", "steampowered.com", "playstation.com", "xbox.com", "nintendo.com", "epicgames.com", "ea.com", "ubisoft.com",
    "rockstargames.com", "minecraft.net", "wikipedia.org",
)
NOISE = r"(?i)\b(?:official|gameplay|wiki|guide|download|trailer)\b"
SEPARATORS = r" - | \| |: | — | – "
TOKEN = r"\b[a-z][a-z0-9'-]{2,}\b"


# What is asked about a request; %n is the name, %v the type of video, %t the topic.
QUERIES = ("%n official game", "%n gameplay terminology", "%n %v %t", "%n latest gameplay trends")
#: Results of a request that one task passes by in order; larger requests are settled in rounds first.
FOLD_RESULTS = 20_000
#: Rounds before what is left is passed by in order, by component.
ROUNDS = 8


def search_queries(requests: DataFrame, suffixes: tuple[str, ...], key: str = "request_id", name: str = "game_name") -> DataFrame:
    """(key, query_no, query): the name with each suffix."""
    return requests.select(key, F.posexplode(F.array(*[F.concat_ws(" ", clean(name), F.lit(s)) for s in suffixes])).alias("query_no", "query"))


def _asked(requests: DataFrame, name: str) -> dict[str, Column]:
    """Name, type and topic of requests; a column that isn't there is empty."""
    text = lambda c: clean(F.coalesce(F.col(c), F.lit(""))) if c in requests.columns else F.lit("")
    return {"%n": text(name), "%v": text("video_type"), "%t": text("episode_topic")}


def request_queries(requests: DataFrame, key: str = "request_id", name: str = "game_name", templates: tuple[str, ...] = QUERIES) -> DataFrame:
    """(key, queries): what is asked about each request, in order."""
    filled = []
    for template in templates:
        out = F.lit(template)
        for mark, value in _asked(requests, name).items():
            out = F.replace(out, F.lit(mark), value)
        filled.append(out)
    return requests.select(key, F.array(*filled).alias("queries"))


def local_terms(requests: DataFrame, key: str = "request_id", name: str = "game_name") -> DataFrame:
    """(key, terminology): the request's own name, type and topic, then the defaults; empty ones and repetitions left out."""
    own = F.array(*_asked(requests, name).values(), *map(F.lit, DEFAULT_TERMS))
    return requests.select(key, ordered_distinct(F.filter(own, lambda t: t != "")).alias("terminology"))


def normalise_results(raw: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, pos, title, url, summary, domain, query), and query_no if ``raw`` has it; rows without title or url are dropped.

    ``raw`` has title, href or url, body or description. The domain keeps user and port, without www.
    """
    pick = lambda *names: F.coalesce(*[F.when(clean(n) != "", clean(n)) for n in names if n in raw.columns], F.lit(""))
    rows = raw.select(key, *order_of(raw), pick("title").alias("title"), pick("href", "url").alias("url"), pick("body", "description", "summary").alias("summary"), "query")
    domain = F.regexp_replace(F.lower(F.coalesce(F.try_parse_url("url", F.lit("AUTHORITY")), F.lit(""))), r"^www\.", "")
    return rows.where("title <> '' AND url <> ''").withColumn("domain", domain)


def order_of(results: DataFrame) -> list[str]:
    """Columns that put the results of a request in order: each of its queries counts from 0, so ``pos`` may repeat."""
    return [c for c in ("query_no", "pos") if c in results.columns]


def url_key(url: Column | str) -> Column:
    return F.lower(F.regexp_replace(url, "/+$", ""))


def _fold_results(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of which neither ``__u`` nor ``__t`` came before, of those that stay; the rows of ``keys`` pass by in order."""
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, urls, titles = None, set(), set()
        for batch in batches:
            stay = []
            for *at, u, t in zip(*(c.to_pylist() for c in batch.columns[: n + 2]), strict=True):
                if at != own:
                    own, urls, titles = at, set(), set()
                new = u not in urls and t not in titles
                if new:
                    urls.add(u)
                    titles.add(t)
                stay.append(new)
            yield batch.filter(pa.array(stay, pa.bool_()))

    first = [*keys, "__u", "__t"]
    rows = rows.select(*first, *[c for c in rows.columns if c not in first])
    return together(rows, *keys).sortWithinPartitions(*keys, *order, "__u", "__t", *[c for c in ("title", "url", "summary") if c in rows.columns]).mapInArrow(run, rows.schema)


def _settle_results(links: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The (key, order, __u, __t) that stay, in rounds.

    Those that come first among all with their URL and among all with their title stay, and
    what shares either with them goes. What :data:`ROUNDS` rounds leave, chains whose links
    share URL and title by turns, is split into components that share neither with each other.
    """
    left, kept, fields = materialise(links, "results"), None, [key, *order, "__u", "__t"]
    place = F.struct(*order, "__u", "__t")
    for _ in range(ROUNDS):
        by = {c: left.groupBy(key, c).agg(F.min(place).alias(f"__first{c}")) for c in ("__u", "__t")}
        marked = left.join(by["__u"], [key, "__u"]).join(by["__t"], [key, "__t"])
        marked = materialise(marked.withColumn("__new", (place == F.col("__first__u")) & (place == F.col("__first__t"))), "results")
        new = marked.where("__new").select(*fields)
        kept = new if kept is None else kept.unionByName(new)
        old, left = left, marked.where("NOT __new").select(*fields)
        for c in ("__u", "__t"):
            left = left.join(new.select(key, c).distinct(), [key, c], "left_anti")
        left = materialise(left.select(*fields), "results")
        release(old)
        if left.isEmpty():
            return kept
    node = lambda c: F.xxhash64(key, F.lit(c), c)
    edges = left.withColumns({"__a": node("__u"), "__b": node("__t")})
    roots = connected_components(edges, "__a", "__b").withColumnsRenamed({"node": "__a", "root": "__root"})
    return kept.unionByName(_fold_results(edges.join(roots, "__a").select(*fields, "__root"), [key, "__root"], order).select(*fields))


def dedupe_results(results: DataFrame, key: str = "request_id") -> DataFrame:
    """Results whose URL and title are both new among those kept before them, in order of query and pos.

    Results of one place are taken in order of URL and title. The results of a request pass by
    in one task if they are counted to be few; the others are settled in rounds of joins and
    minima. Rows with a null request are a request.
    """
    order, fields = order_of(results), [c for c in results.columns if c != key]
    rows = results.withColumns({"__u": url_key("url"), "__t": comparison_key("title")})
    with scratch(results.sparkSession) as stay:
        large = rows.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > FOLD_RESULTS).select(key)
        large = materialise(large.where(F.col(key).isNotNull()), "large")
        if large.isEmpty():
            return _fold_results(rows, [key], order).select(key, *fields)
        few = _fold_results(rows.join(large, key, "left_anti"), [key], order)
        many = rows.join(large, key, "left_semi")
        links = _settle_results(many.select(key, *order, "__u", "__t").distinct(), key, order)
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (key, *order, "__u", "__t")]
        found = many.alias("r").join(links.alias("k"), same, "left_semi")
        # rows that are alike in place, URL and title count once
        at = [key, *order, "__u", "__t"]
        rest = [c for c in fields if c not in at]
        found = found.groupBy(*at).agg(F.min(F.struct(*rest)).alias("__x")).select(*at, "__x.*")
        out = materialise(few.select(key, *fields).unionByName(found.select(key, *fields)), "results")
        stay.append(out)
    return out


def name_candidates(results: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, at, part, candidate, domain): parts of titles that could be a name, without noise words; ``at`` is the result's place."""
    parts = results.select(key, F.struct(*order_of(results)).alias("at"), "domain", F.posexplode(F.split("title", SEPARATORS)).alias("part", "x"))
    parts = parts.withColumn("x", clean(F.regexp_replace("x", NOISE, "")))
    parts = parts.where((F.col("x") != "") & (F.length("x") <= 45) & F.size(F.split("x", " ")).between(1, 6))
    return parts.select(key, "at", "part", title_case("x").alias("candidate"), "domain")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def similarity_bound(a: str, b: str) -> Column:
    """At least the similarity of two comparison keys: what their lengths and the counts of their characters allow."""
    count = lambda c, x: F.length(c) - F.length(F.replace(F.col(c), x))
    both = F.length(a) + F.length(b)
    # each character that comes in either, once
    kinds = F.array_distinct(F.split(F.concat(a, b), ""))
    shared = F.aggregate(kinds, F.lit(0), lambda n, x: n + F.least(count(a, x), count(b, x)))
    return F.when(both == 0, F.lit(1.0)).when(4 * F.least(F.length(a), F.length(b)) < both, F.lit(0.0)).otherwise(2 * shared / both)


def best_names(results: DataFrame, requests: DataFrame, key: str = "request_id", name: str = "game_name", least: float = 0.65, enough: float = 0.78, bonus: float = 0.20) -> DataFrame:
    """(key, supplied_name, suggested_name, was_corrected) for each request.

    A candidate scores its similarity, more on authoritative domains; the first seen of the
    best wins if it is good enough, else the supplied name stays. A name counts as corrected
    if its letters and digits are others. Pairs that a bound of their characters keeps below
    ``least`` never leave the JVM.
    """
    asked = requests.select(key, clean(name).alias("supplied"))
    rows = name_candidates(results, key).join(asked, key)
    rows = rows.withColumns({"a": comparison_key("supplied"), "b": comparison_key("candidate")}).where("b <> ''")
    bound = similarity_bound("a", "b") if least > 0.5 else F.lit(1.0)
    pairs = rows.select("a", "b").distinct().where(bound >= least).withColumn("sim", similarity("a", "b"))
    known = F.lit(False)
    for fragment in AUTHORITIES:
        known = known | F.col("domain").contains(fragment)
    rows = rows.join(pairs, ["a", "b"]).where(F.col("sim") >= least).withColumn("score", F.col("sim") + F.when(known, bonus).otherwise(0.0))
    by_name = rows.groupBy(key, "candidate").agg(F.max("score").alias("score"), F.min(F.struct("at", "part")).alias("seen"))
    order = Window.partitionBy(key).orderBy(F.desc("score"), "seen")
    best = by_name.withColumn("n", F.row_number().over(order)).where("n = 1").select(key, "candidate", "score")
    named = F.when(F.col("score") >= enough, F.col("candidate")).otherwise(F.col("supplied"))
    return asked.join(best, key, "left").select(key, F.col("supplied").alias("supplied_name"), named.alias("suggested_name"), (comparison_key(named) != comparison_key("supplied")).alias("was_corrected"))


def result_words(results: DataFrame, names: DataFrame, key: str = "request_id", name: str = "suggested_name") -> DataFrame:
    """(key, pos, words): tokens of title and summary, without the words of the name."""
    rows = results.join(names.select(key, name), key, "left")
    tokens = F.regexp_extract_all(F.lower(F.concat_ws(" ", "title", "summary")), F.lit(TOKEN), F.lit(0))
    own = F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    return rows.select(key, "pos", tokens.alias("tokens"), own.alias("own")).select(key, "pos", F.filter("tokens", lambda w: ~F.array_contains(F.col("own"), w)).alias("words"))


def term_counts(words: DataFrame, key: str = "request_id", terms: tuple[str, ...] = TERMS) -> DataFrame:
    """(key, term, n) of the vocabulary's words."""
    return words.select(key, F.explode("words").alias("term")).where(F.col("term").isin(*terms)).groupBy(key, "term").agg(F.count("*").alias("n"))


def phrase_counts(words: DataFrame, key: str = "request_id", phrases: tuple[str, ...] = PHRASES) -> DataFrame:
    """(key, phrase, n) of the listed pairs of adjacent words within a result."""
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", F.lit(1), F.greatest(F.size("words") - 1, F.lit(0))), F.expr("slice(words, 2, greatest(size(words), 1))"), lambda a, b: F.concat_ws(" ", a, b)))
    return words.select(key, F.explode(pairs).alias("phrase")).where(F.col("phrase").isin(*phrases)).groupBy(key, "phrase").agg(F.count("*").alias("n"))


def top_terms(words: DataFrame, requests: DataFrame, key: str = "request_id", most: int = 12) -> DataFrame:
    """(key, terminology): phrases, then terms, by count and text, title-cased; defaults where there are none."""
    both = phrase_counts(words, key).select(key, F.col("phrase").alias("v"), "n", F.lit(0).alias("branch")).unionByName(term_counts(words, key).select(key, F.col("term").alias("v"), "n", F.lit(1).alias("branch")))
    order = Window.partitionBy(key).orderBy("branch", F.desc("n"), "v")
    top = both.withColumn("i", F.row_number().over(order)).where(F.col("i") <= most)
    lists = top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: F.initcap(x["v"])).alias("t"))
    return requests.select(key).join(lists, key, "left").select(key, F.coalesce("t", F.array(*map(F.lit, DEFAULT_TERMS))).alias("terminology"))
