"""Secret scans with corpus-wide ownership frequency.

Patterns find spans that look like credentials, and candidates without context that only may
be ones. The hashes of their values are counted over the corpus: by how many repositories and
by how many owners each is held. A value that several owners hold is a widely copied example;
one that a single owner holds and that looks live is a credential, with or without context.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.common import materialise, without

# The patterns of the kinds; group 2 of the first is its value.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs that are too short can't be part of a match, so the least length is in the pattern.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12
#: Candidates without context.
BARE = r"[A-Za-z0-9_-]{20,}"
#: Distinct characters of a value that looks live.
LIVE_CHARACTERS = 8
#: A value that so many owners hold is a copied example.
COPIED_OWNERS = 3
KINDS = ("assign", "access", "hex", "bare")
ADDED = ["n_assign", "n_access", "n_hex", "base_spans", "spans", "n_live", "n_copied"]
_ITEM = "array<struct<kind:int,i:int,gap:int,size:int,held:boolean,live:boolean,value:binary>>"


def looks_live(value: Column) -> Column:
    """Letters and digits, and no few characters again and again."""
    return value.rlike("[A-Za-z]") & value.rlike("[0-9]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)


def _matches(text: Column, pattern: str, kind: int, group: int | None = None, holds=None) -> Column:
    """The matches of a pattern in order: with the code points since the last one, so that places are sums."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    parts = F.arrays_zip(found.alias("m"), gaps.alias("g"), values.alias("v"))
    items = F.transform(
        F.filter(parts, lambda x: x["m"].isNotNull()),
        lambda x, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("size"),
            (holds(x["v"]) if holds else F.lit(True)).alias("held"), looks_live(x["v"]).alias("live"), F.unhex(F.sha2(x["v"].cast("binary"), 256)).alias("value"),
        ),
    )
    return F.when(text.rlike(pattern), items.cast(_ITEM)).otherwise(F.array().cast(_ITEM))


def _blanked(text: Column, pattern: str) -> Column:
    """The text with blanks in place of matches."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    whole = F.array_join(F.zip_with(gaps, found, lambda g, m: F.concat(g, F.repeat(F.lit(" "), F.coalesce(F.length(m), F.lit(0))))), "")
    return F.when(text.rlike(pattern), whole).otherwise(text)


def candidates(text: Column) -> Column:
    """All matches of a text: assignments, access keys, hex runs, and bare candidates in what these leave."""
    bare = lambda v: v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")
    left = text
    for pattern in (ASSIGN, ACCESS, HEX):
        left = _blanked(left, pattern)
    return F.concat(
        _matches(text, ASSIGN, 0, 2, lambda v: F.length(v) >= ASSIGN_LEAST), _matches(text, ACCESS, 1), _matches(text, HEX, 2),
        F.when(text.rlike(BARE), _matches(left, BARE, 3, None, bare)).otherwise(F.array().cast(_ITEM)),
    )


def ownership(found: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners) of (value, repo, owner): counted in steps that sum where rows lie, so that a value held everywhere is no hot group."""
    each = found.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("value").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def find_secrets(docs: DataFrame, text: str = "text", repo: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """Append n_assign, n_access, n_hex, base_spans, spans, n_live and n_copied to every row of ``docs``, without its text.

    Spans are arrays of (kind, begin, stop) in code points, in order of begin, then kind.
    ``spans`` adds bare candidates that look live and are held by one owner. n_live counts spans
    whose value looks live and has one owner, n_copied those whose value ``copied_owners`` or more
    hold. A null text is empty; a null repository or owner counts as one of its own. Rows that
    repeat stay; input columns named like the added ones are replaced; no rows give no rows.
    """
    kept = [c for c in without(docs, ADDED).columns if c != text]
    names = {c: f"in_{i}" for i, c in enumerate(kept)}
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    who = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))
    scanned = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], who(repo).alias("repo"), who(owner).alias("owner"), candidates(body).alias("items"))
    written = materialise(scanned, "candidates")
    # where a row is written tells rows apart that are equal
    rows = written.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    some = rows.where(F.size("items") > 0)
    spread = some.select("file", "row", "repo", "owner", F.explode("items").alias("x")).select("file", "row", "repo", "owner", "x.*")
    end = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("file", "row", "kind").orderBy("i"))
    placed = spread.withColumn("stop", end.cast("int")).withColumn("begin", (F.col("stop") - F.col("size")).cast("int")).where("held")
    placed = materialise(placed.select("file", "row", "repo", "owner", "kind", "begin", "stop", "live", "value"), "spans")
    # written, so that the join can split the rows of a value that is held everywhere
    held = materialise(ownership(placed), "owners")
    judged = placed.join(held, "value").select("file", "row", "kind", "begin", "stop", (F.col("live") & (F.col("n_owners") == 1)).alias("live"), (F.col("n_owners") >= copied_owners).alias("copied"))
    judged = judged.where("kind < 3 OR live")
    by_row = judged.groupBy("file", "row").agg(F.array_sort(F.collect_list(F.struct("begin", "kind", "stop"))).alias("all"), F.count_if("live").alias("n_live"), F.count_if("copied").alias("n_copied"))
    empty = F.array().cast("array<struct<begin:int,kind:int,stop:int>>")
    found = some.drop("items", "repo", "owner").join(by_row, ["file", "row"], "left").withColumn("all", F.coalesce("all", empty)).na.fill(0, ["n_live", "n_copied"])
    none = rows.where(F.size("items") == 0).drop("items", "repo", "owner").withColumns({"all": empty, "n_live": F.lit(0).cast("bigint"), "n_copied": F.lit(0).cast("bigint")})
    out = found.unionByName(none)
    kind = F.array(*map(F.lit, KINDS))
    shown = lambda spans: F.transform(spans, lambda x: F.struct(F.get(kind, x["kind"]).alias("kind"), x["begin"].alias("begin"), x["stop"].alias("stop")))
    base = F.filter("all", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("all", lambda x: x["kind"] == k)).cast("bigint")
    return out.select(
        *[F.col(n).alias(c) for c, n in names.items()], count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        shown(base).alias("base_spans"), shown(F.col("all")).alias("spans"), "n_live", "n_copied",
    )


def written_spans(spans: str) -> Column:
    """Spans as text: kind:begin:stop, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["stop"].cast("string"))), ",")
