"""Approximate nearest neighbours: one hierarchical small-world graph for each shard.

Vectors are dealt to shards of a bounded size, by their length and their content. A
shard's graph is built in its task and kept as flat arrays: vectors, ids, the neighbours
of each node on the bottom layer, and the nodes and neighbours of each layer above. The
queries of a shard stream past its graph in blocks, and the shards' results are merged.

A graph is walked in single precision, on components less their mean and in units of the
largest, so an offset that all vectors share costs no accuracy; where neighbours are too near
to each other for that, it is walked in double precision. Results have their distances worked
out anew, in double precision and on the original components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueline.llm.common import materialise

#: Vectors of a shard at least, and bytes of its vectors at most; between them shards grow with the data.
SHARD_ROWS, SHARD_BYTES = 6000, 64 << 20
#: Shards up to which more data make more shards and not larger ones.
SHARDS = 1024
QUERY_BLOCK = 512
NEIGHBOURS = 16
#: Nodes of a beam at least; beams widen with the number of components.
BUILD_WIDTH, SEARCH_WIDTH = 32, 160
BATCH = 256
#: Relative error of a squared distance in single precision that a walk may have, and the share of links that may have more.
ROUGH, ROUGH_SHARE = 0.02, 0.01
#: Components whose squares are neither too large nor too small for doubles; others are compared one by one.
SAFE = (1e-140, 1e140)


class Graph:
    """Hierarchical navigable small world over the rows of a float array."""

    def __init__(self, vectors: np.ndarray, neighbours: int = NEIGHBOURS) -> None:
        self.x = np.ascontiguousarray(vectors, np.float64)
        self._walk_on(_in_range(self.x))
        self.m = neighbours
        n = len(self.x)
        rng = np.random.default_rng(7)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(neighbours)).astype(np.int32), 6)
        if n:
            self.level[0] = max(self.level[0], int(self.level.max()))
        self.entry = 0
        #: Flat neighbour arrays, one for each layer; -1 is no neighbour. Rows of absent nodes stay empty.
        self.links = [np.full((n, neighbours * (2 if layer == 0 else 1)), -1, np.int32) for layer in range((int(self.level.max()) if n else 0) + 1)]

    def _walk_on(self, single: bool) -> None:
        """Choose what is walked on: the components, or single-precision ones around their mean."""
        self.single, self.middle, self.unit = single, 0.0, 1.0
        self.walk = self.x
        if single and len(self.x):
            self.middle = self.x.mean(axis=0)
            self.walk = self.x - self.middle
            self.unit = np.abs(self.walk).max() or 1.0
            self.walk = (self.walk / self.unit).astype(np.float32)

    def _seen_from(self, q: np.ndarray) -> np.ndarray:
        """Query rows as :meth:`_walk_on` sees them."""
        if not self.single:
            return np.ascontiguousarray(q, np.float64)
        # what is farther than that is far from all
        return np.clip((q - self.middle) / self.unit, -1e15, 1e15).astype(np.float32)

    def _fine(self) -> bool:
        """Whether single precision tells the neighbours of the bottom layer apart."""
        if not self.single or not len(self.x):
            return True
        links = self.links[0]
        rows = np.arange(0, len(links), max(1, len(links) // 512))
        a, c = np.nonzero(links[rows] >= 0)
        a, b = rows[a], links[rows][a, c]
        true = (((self.x[a] - self.x[b]) / self.unit) ** 2).sum(axis=1)
        seen = ((self.walk[a] - self.walk[b]).astype(np.float64) ** 2).sum(axis=1)
        return not len(true) or (np.abs(seen - true) > ROUGH * true).mean() <= ROUGH_SHARE

    def _far(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Squared distances of each query row to its row of ids."""
        d = self.walk[ids]
        d -= q[:, None, :]
        return np.einsum("qkd,qkd->qk", d, d)

    def search_layer(self, q: np.ndarray, entry: np.ndarray, width: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all query rows in step: their ``width`` nearest found (ids, squared distances)."""
        rows, links, x = np.arange(len(q)), self.links[layer], self.walk
        seen = np.zeros((len(q), len(self.x)), bool)
        start = entry.reshape(len(q), -1)
        seen[rows[:, None], start] = True
        ids = np.full((len(q), width), -1, np.int32)
        far = np.full((len(q), width), np.inf, x.dtype)
        ids[:, : start.shape[1]] = start
        far[:, : start.shape[1]] = self._far(q, start)
        done = ids < 0
        worst = far.max(axis=1)
        active = rows
        while len(active):
            best = np.where(done[active], np.inf, far[active]).argmin(axis=1)
            open_ = ~done[active, best]
            active, best = active[open_], best[open_]
            if not len(active):
                break
            done[active, best] = True
            near = links[ids[active, best]]
            safe = np.maximum(near, 0)
            new = (near >= 0) & ~seen[active[:, None], safe]
            # most neighbours were seen before: only new ones are marked and measured
            r, c = np.nonzero(new)
            node, row = safe[r, c], active[r]
            seen[row, node] = True
            step = x[node]
            step -= q[row]
            d = np.einsum("nd,nd->n", step, step)
            # what is farther than a full beam's last changes nothing
            near_ = d < worst[row]
            r, node, d = r[near_], node[near_], d[near_]
            if not len(r):
                continue
            own, first, n = np.unique(r, return_index=True, return_counts=True)
            nth = np.arange(len(r)) - np.repeat(first, n)
            row = active[own]
            all_ids = np.zeros((len(own), width + int(n.max())), np.int32)
            all_far = np.full(all_ids.shape, np.inf, x.dtype)
            all_done = np.ones(all_ids.shape, bool)
            all_ids[:, :width], all_far[:, :width], all_done[:, :width] = ids[row], far[row], done[row]
            at = np.repeat(np.arange(len(own)), n)
            all_ids[at, width + nth], all_far[at, width + nth], all_done[at, width + nth] = node, d, False
            pick = np.argpartition(all_far, width - 1, axis=1)[:, :width]
            at = np.arange(len(own))[:, None]
            ids[row], far[row], done[row] = all_ids[at, pick], all_far[at, pick], all_done[at, pick]
            worst[row] = far[row].max(axis=1)
        order = np.argsort(far, axis=1, kind="stable")
        ids, far = np.take_along_axis(ids, order, 1), np.take_along_axis(far, order, 1)
        ids[np.isinf(far)] = -1
        return ids, far

    def _choose(self, nodes: np.ndarray, cand: np.ndarray, most: int) -> np.ndarray:
        """For each node the neighbours to keep of its candidates (-1: none), in order of distance.

        First those nearer to the node than to any one kept before; if there are fewer
        than ``most``, the nearest of the rest. All nodes are worked on in step.
        """
        real = cand >= 0
        far = np.where(real, self._far(self.walk[nodes], np.maximum(cand, 0)), np.inf)
        order = np.argsort(far, axis=1, kind="stable")
        cand, far, real = (np.take_along_axis(a, order, 1) for a in (cand, far, real))
        # seen from the node and in units of its farthest candidate, single precision is enough
        x = self.walk[np.maximum(cand, 0)] - self.walk[nodes][:, None, :]
        x[~real] = 0
        unit = np.where(real, far, 0).max(axis=1, initial=0, keepdims=True)
        unit = np.sqrt(np.where(unit > 0, unit, 1))
        x = (x / unit[:, :, None]).astype(np.float32, copy=False)
        far = np.where(real, far, 0) / unit**2
        sq = np.einsum("ncd,ncd->nc", x, x)
        between = sq[:, :, None] + sq[:, None, :] - 2 * (x @ x.transpose(0, 2, 1))
        wide = cand.shape[1]
        nearest = np.full(cand.shape, np.inf, np.float32)  # to any kept one
        kept = np.zeros(cand.shape, bool)
        count = np.zeros(len(cand), np.int32)
        for i in range(wide):
            take = (cand[:, i] >= 0) & (count < most) & (nearest[:, i] >= far[:, i])
            kept[:, i] = take
            count += take
            nearest[take] = np.minimum(nearest[take], between[take, i])
        # kept ones first, then the others, both by distance
        rank = np.where(kept, 0, wide) + np.arange(wide) + np.where(cand >= 0, 0, 4 * wide)
        pick = np.argsort(rank, axis=1, kind="stable")[:, :most]
        return np.take_along_axis(cand, pick, 1)

    def _connect(self, nodes: np.ndarray, cand: np.ndarray, layer: int) -> None:
        """Link new nodes with neighbours of their candidates, both ways; full nodes choose anew."""
        links = self.links[layer]
        chosen = self._choose(nodes, cand, self.m)
        links[nodes, : chosen.shape[1]] = chosen
        source = np.repeat(nodes, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        # a pair may be linked already, if both were new and chose each other
        fresh = ~(links[target] == source[:, None]).any(axis=1)
        order = np.argsort(target[fresh], kind="stable")
        source, target = source[fresh][order], target[fresh][order]
        others, first, n = np.unique(target, return_index=True, return_counts=True)
        nth = np.arange(len(target)) - np.repeat(first, n)
        held = (links[others] >= 0).sum(axis=1)
        fits = np.repeat(held + n <= links.shape[1], n)
        links[target[fits], (np.repeat(held, n) + nth)[fits]] = source[fits]
        full = held + n > links.shape[1]
        if full.any():
            new = np.full((int(full.sum()), int(n[full].max())), -1, np.int32)
            new[np.repeat(np.arange(len(new)), n[full]), nth[~fits]] = source[~fits]
            links[others[full]] = self._choose(others[full], np.concatenate([links[others[full]], new], axis=1), links.shape[1])

    def build(self, width: int | None = None) -> Graph:
        """Insert all rows, in batches that search the graph in step and see each other.

        If single precision turns out to be too rough for them, all are inserted anew in double precision.
        """
        width = width or BUILD_WIDTH + self.x.shape[-1] // 16
        self._insert(width)
        if not self._fine():
            self._walk_on(False)
            for links in self.links:
                links[:] = -1
            self._insert(width)
        return self

    def _insert(self, width: int) -> None:
        n, at = len(self.x), 1
        while at < n:
            new = np.arange(at, min(n, at + min(BATCH, at)))
            q = self.walk[new]
            local = q - q.mean(axis=0)
            own = (local**2).sum(axis=1)[:, None] + (local**2).sum(axis=1)[None, :] - 2 * local @ local.T
            entry = np.full(len(new), self.entry, np.int32)
            for layer in range(len(self.links) - 1, -1, -1):
                here = self.level[new] >= layer
                ids, _ = self.search_layer(q, entry, width if here.any() else 1, layer)
                if here.any():
                    nodes = new[here].astype(np.int32)
                    # nodes of one batch see those before them: their nearest peers are candidates too
                    near = np.where(np.tri(len(nodes), k=-1, dtype=bool), own[np.ix_(here, here)], np.inf)
                    peers = np.argsort(near, axis=1, kind="stable")[:, : self.m]
                    peers = np.where(np.isinf(np.take_along_axis(near, peers, 1)), -1, nodes[peers])
                    self._connect(nodes, np.concatenate([ids[here], peers], axis=1), layer)
                entry = ids[:, 0]
            at += len(new)

    def search(self, q: np.ndarray, k: int, width: int | None = None) -> np.ndarray:
        """The k nearest rows found for each query row; -1 where there are fewer."""
        if not len(self.x):
            return np.full((len(q), k), -1, np.int32)
        q = self._seen_from(q)
        entry = np.full(len(q), self.entry, np.int32)
        for layer in range(len(self.links) - 1, 0, -1):
            entry = self.search_layer(q, entry, 1, layer)[0][:, 0]
        width = width or max(SEARCH_WIDTH, self.x.shape[1])
        return self.search_layer(q, entry, max(width, k), 0)[0][:, :k]

    def flat(self) -> dict:
        return {"n": len(self.x), "m": self.m, "entry": self.entry, "layers": len(self.links), "single": self.single, "vectors": self.x.tobytes(), "links": b"".join(a.tobytes() for a in self.links)}

    @classmethod
    def load(cls, row, dims: int) -> Graph:
        g = cls.__new__(cls)
        n, g.m, g.entry = int(row["n"]), int(row["m"]), int(row["entry"])
        g.x = np.frombuffer(row["vectors"], np.float64).reshape(n, dims)
        g._walk_on(bool(row["single"]))
        flat, g.links, at = np.frombuffer(row["links"], np.int32), [], 0
        for layer in range(int(row["layers"])):
            wide = g.m * (2 if layer == 0 else 1)
            g.links.append(flat[at : at + n * wide].reshape(n, wide))
            at += n * wide
        return g


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows in double precision, also where squares would leave its range."""
    d = a - b
    with np.errstate(over="ignore", under="ignore"):
        far = np.sqrt((d**2).sum(axis=1))
        odd = ~np.isfinite(far) | ((far < SAFE[0]) & (d != 0).any(axis=1))
        if odd.any():
            unit = np.abs(d[odd]).max(axis=1, keepdims=True)
            far[odd] = unit[:, 0] * np.sqrt(((d[odd] / unit) ** 2).sum(axis=1))
    return far


def _in_range(x: np.ndarray) -> bool:
    size = np.abs(x[x != 0])
    return not size.size or (size.max() < SAFE[1] and size.max() > SAFE[0])


def nearest(graph: Graph, q: np.ndarray, k: int) -> np.ndarray:
    """Rows of the graph near to each query (-1: none).

    Where squared distances don't fit into doubles, in vectors or queries, all rows are compared.
    """
    if _in_range(graph.x) and _in_range(q):
        return graph.search(q, k)
    n = len(graph.x)
    out = np.full((len(q), k), -1, np.int64)
    for i, row in enumerate(q):
        order = np.lexsort((np.arange(n), distances(graph.x, row[None, :])))[:k]
        out[i, : len(order)] = order
    return out


_GRAPH = "n int, m int, entry int, layers int, single boolean, ids binary, vectors binary, links binary"


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(vec_id, v, dims) of the rows that take part: not null, not zero, all components finite."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(fine).withColumn("dims", F.size("v"))


def deal(rows: DataFrame, k: int, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """The nodes (v, dims, ids, shard), dealt to shards of vectors of one length, and (dims, shard).

    A length has a shard for every ``shard_rows`` vectors, up to :data:`SHARDS` of them. With
    more vectors its shards grow, up to ``shard_bytes``, and only then are there more: every
    query meets every shard.

    Of equal vectors, those after the k + 1 smallest ids can't be in any result (ties go to
    the smaller id, and a query leaves out only itself); they aren't put into a graph.
    """
    equal = Window.partitionBy("v").orderBy("vec_id")
    led = rows.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1)
    nodes = materialise(led.groupBy("v", "dims").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    # lengths are numbered one after the other: the first shard of each
    most = F.greatest(F.lit(shard_rows), F.lit(shard_bytes) / (8 * F.col("dims")))
    sizes = nodes.groupBy("dims").agg(F.count("*").alias("n")).withColumn("shards", F.ceil(F.greatest(F.col("n") / most, F.least(F.col("n") / F.lit(shard_rows), F.lit(SHARDS)))).cast("int"))
    first = F.sum("shards").over(Window.orderBy("dims").rowsBetween(Window.unboundedPreceding, -1))
    sizes = materialise(sizes.select("dims", "shards", F.coalesce(first, F.lit(0)).cast("int").alias("first")), "vector-lengths")
    dealt = nodes.join(sizes, "dims").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("v"), F.col("shards"))).cast("int"))
    return dealt.select("v", "dims", "ids", "shard"), sizes.select("dims", F.explode(F.sequence("first", F.col("first") + F.col("shards") - 1)).alias("shard"))


def build_index(nodes: DataFrame, shards: int, k: int) -> DataFrame:
    """One graph row for each shard. ``nodes``: see :func:`deal`."""

    def graph(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(first=[i[0] for i in pdf.ids]).sort_values("first")
        x = np.array(pdf.v.tolist(), np.float64)
        built = Graph(x)
        # outside that range rows are compared one by one: no graph is searched
        flat = (built.build() if _in_range(x) else built).flat()
        ids = np.full((len(pdf), k + 1), -1, np.int64)
        for i, own in enumerate(pdf.ids):
            ids[i, : len(own)] = own
        return pd.DataFrame([{"shard": pdf["shard"].iloc[0], "dims": x.shape[1], "ids": ids.tobytes(), **flat}])[["shard", "dims", "n", "m", "entry", "layers", "single", "ids", "vectors", "links"]]

    # a task for each shard
    return nodes.repartitionById(shards, F.col("shard")).groupBy("shard").applyInPandas(graph, f"shard int, dims int, {_GRAPH}")


def _stream(k: int, block: int):
    """Search of rows in order of shard, in each the graph before the queries."""
    names = ["query_id", "vec_id", "score"]

    def block_of(row: dict, graph: Graph, ids: np.ndarray, asked: pd.DataFrame) -> pd.DataFrame:
        q = np.array(asked.v.tolist(), np.float64)
        found = nearest(graph, q, k + 1)
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        far = distances(q[r], graph.x[node])
        out = pd.DataFrame({"query_id": np.repeat(asked.vec_id.to_numpy(np.int64)[r], k + 1), "vec_id": ids[node].ravel(), "score": np.repeat(far, k + 1)})
        out = out[(out.vec_id >= 0) & (out.vec_id != out.query_id)].sort_values(["query_id", "score", "vec_id"])
        return out.groupby("query_id").head(k)[names]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row, graph, ids = None, None, None
        for batch in batches:
            for shard, part in batch.groupby("shard", sort=False):
                own = part[part.n.notna()]
                if len(own):
                    row = own.iloc[0].to_dict()
                    graph, ids = Graph.load(row, int(row["dims"])), np.frombuffer(row["ids"], np.int64).reshape(int(row["n"]), k + 1)
                asked = part[part.n.isna()]
                if row is None or row["shard"] != shard:
                    continue
                for i in range(0, len(asked), block):
                    yield block_of(row, graph, ids, asked.iloc[i : i + block])

    return run


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", column: str = "embedding", k: int = 10, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of ``vectors`` found for each query row.

    ``queries`` has the same columns. A query's own id isn't among its results; ties go to
    the smaller id; score is the Euclidean distance on the original components, in double
    precision. Null, zero and non-finite vectors take no part on either side. Vectors of
    several lengths are told apart: a query is compared with those of its own length. Of
    rows with equal ids each is a vector of its own; a query id asked twice is answered
    from both its rows. An empty side gives an empty result. Every other column is ignored.
    """
    nodes, shards = deal(usable(vectors, key, column), k, shard_rows)
    # one row a shard, to be joined by length
    shards = materialise(shards, "shards")
    n = max(1, shards.count())
    graphs = build_index(nodes, n, k)
    # every query meets every shard of its length: a stated query set against all rows, in blocks
    asked = usable(queries, key, column).join(shards, "dims")
    empty = {c.split(" ")[0]: F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in _GRAPH.split(", ")}
    asked = asked.select("shard", "dims", *empty.values(), "vec_id", "v")
    both = graphs.withColumns({"vec_id": F.lit(None).cast("bigint"), "v": F.lit(None).cast("array<double>")}).unionByName(asked)
    # one copy of each graph comes before all its queries; n is null in queries, which sort last
    both = both.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", F.col("n").asc_nulls_last())
    found = both.mapInPandas(_stream(k, QUERY_BLOCK), "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
