"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in 3 bits or fewer are cut into 2 segments of 32 bits: one of
the two then differs in at most one bit. Each distinct fingerprint is indexed under both
segments as they are and under each segment's 32 variants with one bit deleted; equal
keys meet in one sorted run, where the links are verified on all 64 bits. Of each run
only a spanning forest of its links goes on, so that a group of n linked fingerprints
gives n - 1 edges and not n^2 pairs; no link between components gets lost. A long run is
cut by pieces of the other segment, of which linked fingerprints share one at least.
Components are then found by star contraction.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cueline.llm.common import append_columns, chunks, connected_components, materialise, private

DISTANCE = 3
SHINGLE = 3
#: Fingerprints with one segment from which on its runs are cut by the other segment.
LONG_RUN = 2048
#: Long segments whose keys are broadcast at most; each has 33 keys of 8 bytes.
BROADCAST_SEGMENTS = 20_000
_LANES = np.uint64(0x0101010101010101)


def fingerprints(texts: list[bytes | None], shingle: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is 1 if it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    hashes, starts = [], []
    total = 0
    for text in texts:
        words = text.lower().split() if text else []
        starts.append(total)
        if len(words) >= shingle:
            grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
            n = len(words) - shingle + 1
        else:
            grams, n = iter([b" ".join(words)] if words else []), int(bool(words))
        hashes.append(np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64, n))
        total += n
    out = np.zeros(len(texts), np.uint64)
    ends = np.array([*starts[1:], total])
    begins = np.array(starts)
    full = np.flatnonzero(ends > begins)
    if not len(full):
        return out
    h = np.concatenate(hashes)
    # byte lanes hold counts up to 255: documents are summed in pieces of 255 shingles
    sizes = (ends - begins)[full]
    pieces = (sizes + 254) // 255
    of_piece = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    piece_at = np.repeat(begins[full], pieces) + 255 * of_piece
    first = np.cumsum(pieces) - pieces
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, piece_at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        ones = counts * 2 > sizes[:, None]
        for lane in range(8):
            out[full] |= ones[:, lane].astype(np.uint64) << np.uint64(8 * lane + bit)
    return out


def add_fingerprint(docs: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Append the fingerprint of ``text`` as a signed long; no words (or null): 0."""

    def make():
        def each(column: pa.Array) -> list[pa.Array]:
            parts = [fingerprints(part) for _, part in chunks(column, 1 << 19)]
            whole = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
            return [pa.array(whole.view(np.int64))]

        return each

    return append_columns(docs, text, [T.StructField(name, T.LongType())], make, binary=True)


def variant_keys(fps: DataFrame, *more: str) -> DataFrame:
    """66 index keys (key, own, fp) of each fingerprint: 2 whole segments, 64 one-bit deletions; own is the segment's number."""
    rows = fps.select(*more, "fp", F.explode(F.sequence(F.lit(0), F.lit(65))).alias("s"))
    half, at = F.expr("s div 33").cast("int"), F.expr("s % 33").cast("int")
    rows = rows.select(*more, "fp", half.alias("own"), at.alias("at"))
    part = F.expr("shiftrightunsigned(fp, 32 * own) & 4294967295L")
    kept = F.when(F.col("at") < 32, part.bitwiseAND(F.expr("~shiftleft(1L, at)"))).otherwise(part)
    return rows.select((kept + F.expr("shiftleft(CAST(at AS BIGINT), 32) + shiftleft(CAST(own AS BIGINT), 38)")).alias("key"), "own", *more, "fp")


def long_keys(fps: DataFrame, long_run: int = LONG_RUN) -> DataFrame | None:
    """(key) of the keys that hold a segment of ``long_run`` fingerprints or more; None if there are none.

    A run under a key with a deleted bit has the fingerprints of two segments, so it is counted by its segments.
    """
    half = lambda h: F.struct(F.lit(h).alias("half"), F.expr(f"shiftrightunsigned(fp, {32 * h}) & 4294967295L").alias("part"))
    halves = fps.select(F.explode(F.array(half(0), half(1))).alias("x")).groupBy("x.half", "x.part").agg(F.count("*").alias("n"))
    found = materialise(halves.where(F.col("n") >= long_run).select("half", "part"), "long-segments")
    n = found.count()
    if not n:
        return None
    # a fingerprint with the segment in its place has the keys of that half
    alone = found.select("half", F.when(F.col("half") == 0, F.col("part")).otherwise(F.shiftleft("part", 32)).alias("fp"))
    keys = variant_keys(alone, "half").where("half = own").select("key").distinct()
    return F.broadcast(keys) if n <= BROADCAST_SEGMENTS else keys


def _pieces(keys: DataFrame, longs: DataFrame | None) -> DataFrame:
    """(key, piece, fp): rows of long keys once for each of the four pieces of the other segment, others with piece -1.

    Linked fingerprints differ in three bits at most, so of four pieces one is equal.
    """
    if longs is None:
        return keys.select("key", F.lit(-1).alias("piece"), "fp")
    rows = keys.join(longs.withColumn("long", F.lit(True)), "key", "left")
    other = F.when(F.expr("shiftright(key, 38) = 0"), F.expr("shiftrightunsigned(fp, 32)")).otherwise(F.col("fp"))
    cut = F.array(*[F.expr(f"{i} * 256").cast("int") + (F.shiftright(other, 8 * i).bitwiseAND(F.lit(255))).cast("int") for i in range(4)])
    return rows.select("key", F.explode(F.when(F.col("long"), cut).otherwise(F.array(F.lit(-1)))).alias("piece"), "fp")


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints, O(n) memory."""
    edges, rest = [], np.arange(len(fps))
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(fps[rest] ^ fps[x]) <= distance
            new = rest[near]
            if len(new):
                edges += [(int(x), int(y)) for y in new]
                todo += new.tolist()
                rest = rest[~near]
    return edges


def _run_edges(keys: np.ndarray, pieces: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the complete runs of equal keys and pieces (sorted); whole runs only."""
    cut = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]) | (pieces[1:] != pieces[:-1]))))
    size = np.diff(np.concatenate((cut, [len(keys)])))
    at = (keys[cut] >> 32) & 63
    two = cut[size == 2]
    a, b = fps[two], fps[two + 1]
    near = np.bitwise_count(a ^ b) <= distance
    left, right = [a[near]], [b[near]]
    for begin, n, bit, key in zip(cut[size > 2].tolist(), size[size > 2].tolist(), at[size > 2].tolist(), keys[cut[size > 2]].tolist(), strict=True):
        own = fps[begin : begin + n]
        if bit < 32:
            # links inside one side share the whole segment, whose own run has them
            side = (own >> np.uint64(bit + 32 * (key >> 38))) & np.uint64(1)
            if side.min() == side.max():
                continue
        edges = _forest(own, distance)
        if edges:
            i, j = np.array(edges).T
            left.append(own[i])
            right.append(own[j])
    return np.concatenate(left), np.concatenate(right)


def link_edges(fps: DataFrame, distance: int = DISTANCE, long_run: int = LONG_RUN) -> DataFrame:
    """Edges (a, b) that connect all of ``fps`` (distinct longs) within ``distance`` bits."""
    keys = _pieces(variant_keys(fps), long_keys(fps, long_run))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def emit(k: np.ndarray, p: np.ndarray, f: np.ndarray):
            a, b = _run_edges(k, p, f, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            k, p = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            f = batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            held.append((k, p, f))
            if k[-1] == held[0][0][0] and p[-1] == held[0][1][0]:
                continue  # one run goes on
            k, p, f = (np.concatenate(c) for c in zip(*held, strict=True))
            last = int(np.flatnonzero((k != k[-1]) | (p != p[-1]))[-1]) + 1
            yield emit(k[:last], p[:last], f[:last])
            held = [(k[last:], p[last:], f[last:])]
        if held:
            yield emit(*(np.concatenate(c) for c in zip(*held, strict=True)))

    ordered = keys.repartition("key", "piece").sortWithinPartitions("key", "piece")
    return ordered.mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(key, fp, fingerprint, component_id) of every row; rows link at ``distance`` bits or fewer.

    ``distance`` is 3 at most. component_id is the smallest key of the linked rows. Rows
    without words, null texts included, have fingerprint zero and link like any other.
    Null keys are kept and never chosen as component_id unless all are null. Equal rows
    stay; an empty table stays empty.
    """
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _grouped(docs, key, text, distance).select(F.col("k").alias(key), "fp", shown.alias("fingerprint"), "component_id")


def _grouped(docs: DataFrame, key: str, text: str, distance: int) -> DataFrame:
    """(k, fp, root, component_id) of every row; components that share their smallest key differ in root."""
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"two segments with one deletion serve distances up to {DISTANCE}")
    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    rows = materialise(add_fingerprint(rows, "t").select("k", "fp"), "fingerprints")
    least = materialise(rows.groupBy("fp").agg(F.min("k").alias("least")), "distinct-fingerprints")
    edges = link_edges(least.select("fp"), distance)
    parts = connected_components(edges, "a", "b")
    rooted = least.join(parts, least.fp == parts.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(by_fp, "fp").select("k", "fp", "root", "component_id")


def keep_representatives(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = DISTANCE) -> DataFrame:
    """One row of ``docs`` for each component: one whose key is the component's smallest.

    Where several rows of a component have that key, the least fingerprint is kept, then
    the least text. Rows with null keys are kept: there's nothing to choose them by.
    """
    found = materialise(_grouped(docs.select(f"`{key}`", f"`{text}`"), key, text, distance), "grouped")
    leads = F.col("k") == F.col("component_id")
    keys = found.groupBy("k").agg(F.count("*").alias("n"), F.max(leads).alias("leads")).where("leads").select(F.col("k").alias(key), "n")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = docs.join(keys.where("n = 1").select(key), key, "left_semi").select(*columns)
    # only rows of repeated keys need their fingerprint once more
    own = private(docs)
    fp = f"{own}_fp"
    picked = found.where(leads).groupBy("k", "root").agg(F.min("fp").alias(fp)).select(F.col("k").alias(key), fp)
    again = docs.join(keys.where("n > 1").select(key), key, "left_semi").select(*columns)
    again = add_fingerprint(again, text, fp).join(picked, [key, fp], "left_semi")
    order = Window.partitionBy(key, fp).orderBy(F.col(f"`{text}`"))
    again = again.withColumn(f"{own}_n", F.row_number().over(order)).where(f"{own}_n = 1").select(*columns)
    return once.unionByName(again).unionByName(docs.where(F.col(f"`{key}`").isNull()))
