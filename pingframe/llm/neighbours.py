"""Approximate nearest neighbours: multiprobe p-stable hashing, exact distances inside the buckets, one merged ranking."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.plans.tables import written

#: The index is fitted on at most this many vectors (smallest hashes); every vector is indexed.
FIT_VECTORS, FIT_QUERIES = 4_000, 150
TABLES, AIM = 6, 0.97
#: Candidates are cut into blocks of about BLOCK rows (fewer if they are longer than 128 numbers), queries into eight times QUERY_BLOCK; each pair of
#: blocks is a unit, in one task. QUERY_BLOCK is also the number of queries that are held against all vectors at once.
BLOCK, QUERY_BLOCK = 32_768, 1_024
#: Queries that a task probes for, and the most keys of a row: a query that visits more buckets has several rows.
PROBED, KEYS = 256, 512


class Index:
    """TABLES tables of k hashes floor((a . x + b) / w) with Gaussian a; `probes` buckets of each are visited for a query."""

    def __init__(self, size: int, k: int, w: float, tables: int = TABLES, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.size, self.k, self.w, self.tables, self.probes = size, k, w, tables, 1
        self.a = rng.standard_normal((tables, size, k))
        self.b = rng.uniform(0, w, (tables, k))

    def places(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, k): where the rows fall, in units of bucket widths."""
        return (np.einsum("nd,tdk->ntk", x.astype(np.float64), self.a) + self.b) / self.w

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """One number for the cells (..., tables, k) of each table; different cells can share a number, which only adds candidates."""
        with np.errstate(over="ignore"):
            key = np.broadcast_to(np.arange(self.tables, dtype=np.int64), cells.shape[:-1]).copy()
            for i in range(self.k):
                key = key * np.int64(1000003) + cells[..., i].astype(np.int64)
        return key

    def visited(self, place: np.ndarray, probes: int) -> np.ndarray:
        """The cells (probes, k) to visit for a place (k) in one table, likeliest first.

        A move of one step costs the squared distance to that side of the cell; sets of moves come from a heap by the sum of their
        costs: the next set either shifts its last move to the next dearer one or adds that one.
        """
        cell = np.floor(place)
        up = 1 - (place - cell)
        cost = np.r_[(place - cell) ** 2, up**2]
        order = np.argsort(cost, kind="stable").tolist()
        cost = cost.tolist()
        out, heap, n = [()], [(cost[order[0]], (0,))], len(order)
        while heap and len(out) < probes:
            total, chosen = heapq.heappop(heap)
            last = chosen[-1]
            if last + 1 < n:
                step = cost[order[last + 1]]
                heapq.heappush(heap, (total - cost[order[last]] + step, (*chosen[:-1], last + 1)))
                heapq.heappush(heap, (total + step, (*chosen, last + 1)))
            moves = [order[i] for i in chosen]
            if len({m % self.k for m in moves}) == len(moves):  # not both ways at once
                out.append(moves)
        cells = np.tile(cell, (len(out), 1))
        rows = np.repeat(np.arange(len(out)), [len(moves) for moves in out])
        moves = np.array([m for moves in out for m in moves], dtype=np.int64)
        cells[rows, moves % self.k] += np.where(moves >= self.k, 1, -1)
        return cells

    def probed(self, x: np.ndarray, probes: int) -> list[np.ndarray]:
        """For each row the keys of the buckets it visits in all tables, likeliest first by table: (tables, probes or fewer)."""
        places, out = self.places(x), []
        for row in places:
            cells = [self.visited(row[t], probes) for t in range(self.tables)]
            least = min(map(len, cells))
            out.append(self.keys(np.stack([c[:least] for c in cells], axis=1)).T)
        return out


def fitted(sample: np.ndarray, rows: int, k: int = 10) -> Index:
    """An index for `rows` vectors: about log2(rows) / 3 hashes a table, a bucket width of 1.5 times the sample's median distance to the
    k-th neighbour, and the fewest probes that find AIM of the sample's own neighbours. If more probes than a table may visit were
    needed, buckets are widened by half and tried again. Neighbours among all vectors are nearer than among the sample, so the recall
    over all is no worse."""
    size = sample.shape[1] if len(sample) else 1
    if len(sample) < 2:
        return Index(size, 1, 1.0)
    sample = sample.astype(np.float64)
    queries = sample[:FIT_QUERIES]
    k = min(k, len(sample) - 1)
    nearest, reach = np.empty((len(queries), k), dtype=np.int64), np.empty(len(queries))
    for n, q in enumerate(queries):
        d = ((sample - q) ** 2).sum(axis=1)
        d[n] = np.inf
        nearest[n] = np.argsort(d)[:k]
        reach[n] = np.sqrt(d[nearest[n, -1]])
    width = 1.5 * float(np.median(reach)) or 1.0
    hashes = int(np.clip(round(np.log2(max(2, rows)) / 3), 2, 10))
    limit = min(3**hashes, 4000)
    while True:
        index = Index(size, hashes, width)
        own = index.keys(np.floor(index.places(sample)))
        for probes in sorted({min(limit, 128 * 4**i) for i in range(4)}):  # likelier buckets come first, so more are only looked at if few don't do
            rank = np.full((len(queries), k), probes + 1)
            for q, keys in enumerate(index.probed(queries, probes)):
                for t in range(index.tables):
                    at = {key: n + 1 for n, key in reversed(list(enumerate(keys[t].tolist())))}
                    rank[q] = np.minimum(rank[q], [at.get(key, probes + 1) for key in own[nearest[q], t].tolist()])
            needed = int(np.quantile(rank, AIM, method="higher"))
            if needed <= probes:
                index.probes = needed
                return index
        width *= 1.5


def usable(vector: Column) -> Column:
    """Not null, not all zero, no null and no non-finite component."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _vectors(column: pa.ListArray) -> np.ndarray:
    """(rows, size): vectors of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Buckets:
    """A block of candidates, each in its bucket of every table."""

    def __init__(self, index: Index, held: list[pa.RecordBatch]) -> None:
        self.size = index.size
        self.x = np.concatenate([_vectors(b.column("v")) for b in held])
        self.ids = np.concatenate([b.column("ids").flatten().to_numpy(zero_copy_only=False) for b in held])
        self.ends = np.cumsum(np.concatenate([b.column("ids").value_lengths().to_numpy(zero_copy_only=False) for b in held]))
        self.begins = np.r_[0, self.ends[:-1]]
        with np.errstate(over="ignore"):
            self.norms = (self.x.astype(np.float64) ** 2).sum(axis=1)
        self.longest = self.norms.max()
        self.keys, inverse = np.unique(index.keys(np.floor(index.places(self.x))).ravel(), return_inverse=True)
        self.rows = np.argsort(inverse, kind="stable") // index.tables
        self.starts = np.r_[0, np.cumsum(np.bincount(inverse, minlength=len(self.keys)))]

    def met(self, keys: np.ndarray) -> np.ndarray:
        """The rows in these buckets, each once."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = at[self.keys[at] == keys]
        n = self.starts[at + 1] - self.starts[at]
        found = np.zeros(len(self.x), dtype=bool)
        found[self.rows[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]] = True
        return np.flatnonzero(found)

    def nearest(self, asked: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        """(query_id, vec_id, score): the k nearest of the candidates that a query's buckets hold, for some queries at a time."""
        names, vectors, keys = asked.column("ids").flatten().to_pylist(), _vectors(asked.column("v")), asked.column("keys")
        flat, ends = keys.flatten().to_numpy(zero_copy_only=False), np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))
        visited = np.split(flat, ends[:-1])
        for lo in range(0, len(names), 64):
            q, rows = vectors[lo : lo + 64], [self.met(own) for own in visited[lo : lo + 64]]
            # from a quarter of the block on, products with all of it take less than picking the rows
            with np.errstate(over="ignore", invalid="ignore"):
                products = self.x @ q.T if 4 * sum(map(len, rows)) > len(self.x) * len(q) else None
            out = []
            for i, (me, own) in enumerate(zip(names[lo : lo + 64], rows, strict=True)):
                own = self._likely(own, q[i], None if products is None else products[:, i], k)
                d = np.sqrt(((self.x[own].astype(np.float64) - q[i]) ** 2).sum(axis=1))
                best = np.lexsort((self.ids[self.begins[own]], d))[: k + 1]
                found = sorted((float(d[j]), v) for j in best for v in self.ids[self.begins[own[j]] : self.ends[own[j]]].tolist() if v != me)
                out += [(me, v, s) for s, v in found[:k]]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    def _likely(self, rows: np.ndarray, q: np.ndarray, products: np.ndarray | None, k: int) -> np.ndarray:
        """rows without those that are surely not among the k + 1 nearest: squared distances by products, which are right but for rounding."""
        kind, own = np.finfo(self.x.dtype), float((q.astype(np.float64) ** 2).sum())
        if len(rows) <= k + 1 or not self.longest + own < kind.max / 8:
            return rows
        rough = self.norms[rows] - 2.0 * (self.x[rows] @ q if products is None else products[rows])
        slack = 4 * (self.size + 4) * (float(kind.eps) * (self.longest + own) + float(kind.tiny))
        return rows[rough <= np.partition(rough, k)[k] + slack]


def _units(both: DataFrame, index: Index, k: int) -> DataFrame:
    """The k nearest candidates of each query inside each unit. A unit's rows lie together, candidates first: these are held, queries go by in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held, buckets = None, [], None
        for b in batches:
            ids = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("cb", "qb", "asked")], axis=1)
            cuts = [0, *(np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1), len(ids)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if (at := tuple(ids[lo, :2])) != unit:
                    unit, held, buckets = at, [], None
                part = b.slice(lo, hi - lo)
                if not ids[lo, 2]:
                    held.append(part)
                elif held:
                    buckets = buckets or Buckets(index, held)
                    yield from buckets.nearest(part, k)

    return both.repartition("cb", "qb").sortWithinPartitions("cb", "qb", "asked").mapInArrow(run, "query_id long, vec_id long, score double")


def _scanned(reps: DataFrame, asked: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query_id, vec_id, score): the k nearest of all reps for each of a bounded block of queries; a partition gives its own k best."""
    names = np.array([i for i, _ in asked], dtype=np.int64)
    x = np.array([v for _, v in asked], dtype=np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple[float, int]]] = [[] for _ in names]
        for b in batches:
            b = b.iloc[np.argsort([ids[0] for ids in b["ids"]], kind="stable")]
            lists = b["ids"].to_numpy()
            c = np.stack(b["v"].to_numpy()).astype(np.float64) if len(b) else np.empty((0, x.shape[1]))
            for n, q in enumerate(x if len(b) else ()):
                d = np.sqrt(((c - q) ** 2).sum(axis=1))
                near = np.argsort(d, kind="stable")[: k + 1]
                best[n] = sorted(best[n] + [(float(d[j]), int(v)) for j in near for v in lists[j] if v != names[n]])[:k]
        yield pd.DataFrame([(int(names[n]), v, s) for n, own in enumerate(best) for s, v in own], columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return reps.select("ids", "v").mapInPandas(run, "query_id long, vec_id long, score double")


def searched(table: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by `every` the k nearest other rows found.

    score is the Euclidean distance in double precision; ties go to the smaller vec_id. Rows with a null vec_id, or a vector that is null,
    zero, or holds null or non-finite components, take no part. Vectors of each length are searched by themselves, with an index of their own. Equal
    vectors are indexed once with their k + 1 smallest ids, which is all that a ranking can need. Rows equal in vec_id and vector are one; a query never
    finds its own vec_id. A query whose buckets hold fewer than k candidates (it lies far from the rest, or there are no more) is held
    against all vectors, in blocks of such queries. An empty table gives no rows.
    """
    kind = "array<float>" if table.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = table.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast(kind).alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    first = rows.withColumn("n", F.dense_rank().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    reps = written(first.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")), "vectors")
    lengths = sorted(r[0] for r in reps.select(F.size("v")).distinct().collect())
    own = lambda df, n: df.where(F.size("v") == n) if len(lengths) > 1 else df
    parts = [_met(own(reps, n), own(rows, n).where(F.col("id") % every == 0).distinct(), kind, k) for n in lengths]
    found = reduce(DataFrame.unionByName, parts) if parts else rows.select(F.col("id").alias("query_id"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _met(reps: DataFrame, queries: DataFrame, kind: str, k: int) -> DataFrame:
    """(query_id, vec_id, score): the candidates among reps (v, ids) that queries (id, v) found, the k nearest at least; all vectors have one length."""
    sample = reps.orderBy(F.xxhash64("v"), "ids").limit(FIT_VECTORS).select("v").toPandas()["v"]
    rows = reps.count()
    index = fitted(np.stack(sample.to_numpy()), rows, k)
    queries = written(queries, "queries")
    asked = queries.count()

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                keys = [np.unique(x) for x in index.probed(_vectors(part.column("v")), index.probes)]
                cut = [(n, own[at : at + KEYS]) for n, own in enumerate(keys) for at in range(0, len(own), KEYS)]
                part = part.take(pa.array([n for n, _ in cut]))
                yield pa.RecordBatch.from_arrays([part.column("ids"), part.column("v"), pa.array([own for _, own in cut], pa.list_(pa.int64()))], ["ids", "v", "keys"])

    of = {"cb": -(-rows // min(BLOCK, max(1, 128 * BLOCK // index.size))), "qb": max(1, -(-asked // (8 * QUERY_BLOCK)))}
    block = lambda b: F.pmod(F.xxhash64("ids"), F.lit(of[b])).cast("int").alias(b)
    every_block = lambda b: F.explode(F.sequence(F.lit(0), F.lit(of[b] - 1))).alias(b)
    dealt = queries.repartition(max(1, -(-asked // PROBED)), "id").select(F.array("id").alias("ids"), "v")
    c = reps.select("ids", "v", F.lit(None).cast("array<long>").alias("keys"), block("cb"), every_block("qb"), F.lit(False).alias("asked"))
    q = dealt.mapInArrow(probe, f"ids array<long>, v {kind}, keys array<long>").select("ids", "v", "keys", every_block("cb"), block("qb"), F.lit(True).alias("asked"))
    met = written(_units(c.unionByName(q), index, k).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")), "met")
    full = met.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("id"))
    short = written(queries.join(full, "id", "left_anti"), "short")
    parts = [met]
    of = -(-short.count() // QUERY_BLOCK)
    for i in range(of):  # each block is a pass over all vectors, stored before the next
        block = short.where(F.pmod(F.xxhash64("id"), F.lit(of)) == i).select("id", "v").collect()
        if block:
            parts.append(written(_scanned(reps, [(r["id"], list(r["v"])) for r in block], k), "scanned"))
    found = reduce(DataFrame.unionByName, parts)
    return found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score")) if of else found
