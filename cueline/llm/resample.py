"""Importance resampling towards a target distribution, with length-bucketed CRC matrices.

A text's features are its runs of one to three words, hashed into buckets by CRC-32. In a
task, the distinct features of some texts are grouped by their length in bytes; each group
is a two-dimensional array of bytes, and the checksums of all its rows are updated column by
column and scattered back to where the features occur. Groups of a few rows, which a column
step wouldn't pay for, get their checksums row by row.

Bucket counts of the corpus and of the target give each bucket a gain; a document's weight is
the sum of the gains of its features, and weights with Gumbel noise of a seeded hash draw the
documents without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueline.llm.common import materialise
from cueline.llm.decontaminate import _TABLE as _WORDS
from cueline.operators.ranks import number_rows

BUCKETS = 10_000
#: Words of the longest feature.
LONGEST = 3
#: Bytes of text whose features are made distinct together; longer texts are cut between words.
CHUNK = 2 << 20
#: Rows of the least group that is updated column by column.
LEAST_ROWS = 8
SEED, LEAST_WORDS, PERCENT = 42, 20, 5
ADDED = ["n_features", "weight", "score", "rank"]


def crc_table() -> np.ndarray:
    """Remainders of the bytes in the reversed polynomial of CRC-32."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_TABLE = crc_table()


def crc_rows(rows: np.ndarray) -> np.ndarray:
    """CRC-32 of each row of a two-dimensional array of bytes, column by column."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for column in np.ascontiguousarray(rows.T):
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return ~crc


def crc_slices(body: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of the slices of ``body``, grouped by length."""
    data, view = np.frombuffer(body, np.uint8), memoryview(body)
    length, out = ends - starts, np.zeros(len(starts), np.uint32)
    by = np.argsort(length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[by])) + 1
    for group in np.split(by, cuts) if len(by) else ():
        n = int(length[group[0]])
        if len(group) < LEAST_ROWS:
            out[group] = [zlib.crc32(view[a : a + n]) for a in starts[group].tolist()]
        else:
            out[group] = crc_rows(data[starts[group][:, None] + np.arange(n)])
    return out


def pieces(text: bytes | None, limit: int = CHUNK) -> Iterator[tuple[list[bytes], int]]:
    """(words, own) of parts of a text: features begin at the first ``own`` words, and reach into the rest."""
    low = (text or b"").translate(_WORDS)
    at, held = 0, []
    while True:
        end = low.find(b" ", at + limit) if at + limit < len(low) else -1
        last = end < 0
        words = held + low[at : len(low) if last else end].split()
        own = len(words) if last else max(0, len(words) - LONGEST + 1)
        yield words, own
        if last:
            return
        at, held = end, words[own:]


def piece_buckets(parts: list[tuple[list[bytes], int]], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(part, bucket) of every feature of the parts."""
    flat = [w for words, _ in parts for w in words]
    if not flat:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(words) for words, _ in parts])
    part = np.repeat(np.arange(len(parts)), size)
    first = np.cumsum(size) - size
    place = np.arange(len(flat)) - first[part]
    own = place < np.array([own for _, own in parts])[part]
    left = size[part] - place
    known: dict[bytes, int] = {}
    words = np.fromiter((known.setdefault(w, len(known)) for w in flat), np.int64, len(flat))
    ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    body = b" ".join(flat)
    # a run is known by the run without its last word, and that word
    runs, found_part, found_bucket = words, [], []
    for n in range(1, LONGEST + 1):
        at = np.flatnonzero(left >= n)
        if not len(at):
            break
        keys = words[at] if n == 1 else runs[at] * len(known) + words[at + n - 1]
        distinct, where, back = np.unique(keys, return_index=True, return_inverse=True)
        crc = crc_slices(body, starts[at[where]], ends[at[where] + n - 1])
        begins = own[at]
        found_part.append(part[at[begins]])
        found_bucket.append((crc.astype(np.int64) % buckets)[back[begins]])
        runs = np.zeros(len(flat), np.int64)
        runs[at] = back
    return np.concatenate(found_part), np.concatenate(found_bucket)


def _in_chunks(texts: Iterator[tuple[int, bytes | None]], limit: int = CHUNK) -> Iterator[tuple[list[int], list[tuple[list[bytes], int]]]]:
    """(rows, parts) of texts, about ``limit`` bytes at once."""
    rows: list[int] = []
    parts: list[tuple[list[bytes], int]] = []
    held = 0
    for row, text in texts:
        for words, own in pieces(text, limit):
            rows.append(row)
            parts.append((words, own))
            held += sum(map(len, words)) + len(words)
            if held >= limit:
                yield rows, parts
                rows, parts, held = [], [], 0
    if parts:
        yield rows, parts


def _bodies(array: pa.Array) -> Iterator[tuple[int, bytes | None]]:
    """Texts of a batch, one at a time."""
    return ((i, x.as_py()) for i, x in enumerate(array))


def count_buckets(texts: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all texts; summed in each task, so a task sends a row a bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, parts in _in_chunks(_bodies(batch.column(0))):
                n += np.bincount(piece_buckets(parts, buckets)[1], minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    body = texts.select(F.col(f"`{text}`").cast("binary").alias("body"))
    return body.mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket from (bucket, n) of either side: thousandths of the log ratio, one added to each count."""
    sides = {"s": corpus, "t": target}
    rows = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for name, counts in sides.items():
        rows = rows.join(counts.select("bucket", F.col("n").cast("double").alias(name)), "bucket", "left").na.fill(0.0, [name])
    # a row for each bucket, whatever the corpus
    total = rows.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")).withColumn("__one", F.lit(1))
    rows = rows.withColumn("__one", F.lit(1)).join(F.broadcast(total), "__one")
    ratio = (F.col("t") + 1) * (F.col("all_s") + buckets) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    return rows.select("bucket", F.floor(1000 * F.log(ratio)).cast("bigint").alias("gain"))


def weigh(docs: DataFrame, gains: list[int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_features, weight) of every document; ``gains``: one for each bucket."""
    gain = np.array(gains, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, weight = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for rows, parts in _in_chunks(_bodies(batch.column(1))):
                row = np.array(rows)
                np.add.at(words, row, [own for _, own in parts])
                at, bucket = piece_buckets(parts, len(gain))
                np.add.at(weight, row[at], gain[bucket])
            features = sum(np.maximum(words - n, 0) for n in range(LONGEST))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight))], names=[key, "n_words", "n_features", "weight"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").cast("binary").alias("body"))
    return rows.mapInArrow(run, f"`{key}` {kind}, n_words bigint, n_features bigint, weight bigint")


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from a hash of the key; a null key counts as an empty one."""
    told = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(told, 256), 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """(key, n_features, weight, score, rank) of every row of ``docs``; those with a rank are drawn.

    Of the rows with ``least_words`` words at least, ``percent`` in a hundred are drawn: those of
    the highest scores, ties to the smaller key, null keys last. A null text has no words, an
    empty table no rows; an empty target gives gains that depend on the corpus alone. Rows that
    repeat a key are rows of their own, and equal ones among them are ranked in any order.
    """
    if not 0 <= percent <= 100:
        raise ValueError("percent has to be between 0 and 100")
    counts = [count_buckets(docs, text, buckets), count_buckets(target, target_text, buckets)]
    # one number for each bucket, whatever the corpus
    gains = [r.gain for r in bucket_gains(*counts, buckets).orderBy("bucket").collect()]
    weighed = weigh(docs, gains, key, text)
    rows = materialise(weighed.withColumn("score", F.col("weight") + gumbel(F.col(f"`{key}`"), seed)), "scores")
    fit = rows.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    ranked = number_rows(fit, [], [F.desc("score"), F.asc_nulls_last(key)], "rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("bigint")))
    rest = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("bigint"))
    return ranked.unionByName(rest).select(key, *ADDED)
