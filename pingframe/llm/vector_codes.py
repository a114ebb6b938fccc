"""Vector code compression: Lloyd rounds over the parts of integer vectors, by trees over both the parts and the codebook entries."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.plans.tables import written

#: Fixed values of the code: equal parts, entries of a part's codebook, steps of a unit, rounds.
PARTS, ENTRIES, SCALE, ROUNDS = 4, 256, 1024, 4
#: Vectors whose parts share a tree, and most of them that a leaf has.
BLOCK_ROWS, LEAF_ROWS = 4_096, 16
#: Label sums of at most this many labels are broadcast (they are counted first); more are shuffled.
BROADCAST_LABELS = 1_000_000
#: Sums of squares stay below this in 64 bits, and doubles hold whole numbers up to the other.
WHOLE, DOUBLE = 1 << 62, 1 << 53


def edges(length: int) -> list[int]:
    """Where the parts of a vector start, and its end. If the length is no multiple of PARTS, parts differ by one component."""
    return [k * length // PARTS for k in range(PARTS + 1)]


class Tree:
    """Rows of whole numbers, ordered so that node k of level l has the rows from k * n >> l to (k + 1) * n >> l.

    Each level has the box around every node's rows and their sum. No node is empty.
    """

    def __init__(self, rows: np.ndarray, leaf: int) -> None:
        self.rows, self.n = rows, len(rows)
        self.depth = depth(self.n, leaf)
        starts = self.starts(self.depth)
        if rows.shape[1]:
            low, high, total = ([f.reduceat(rows, starts)] for f in (np.minimum, np.maximum, np.add))
        else:
            low, high, total = ([np.zeros((len(starts), 0), np.int64)] for _ in range(3))
        for _ in range(self.depth):
            low.append(np.minimum(low[-1][::2], low[-1][1::2]))
            high.append(np.maximum(high[-1][::2], high[-1][1::2]))
            total.append(total[-1][::2] + total[-1][1::2])
        self.low, self.high, self.total = low[::-1], high[::-1], total[::-1]

    def starts(self, level: int) -> np.ndarray:
        return np.arange(1 << level) * self.n >> level

    def span(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nodes * self.n >> level, (nodes + 1) * self.n >> level


def depth(n: int, leaf: int) -> int:
    """Levels below the root, so that leaves have at most about `leaf` rows and none is empty."""
    out = 0
    while n >> out > leaf and n >> out + 1:
        out += 1
    return out


def order(rows: np.ndarray, leaf: int) -> np.ndarray:
    """The order of a Tree's rows: every node is halved across the widest side of its box."""
    out, n = np.arange(len(rows)), len(rows)
    if not rows.shape[1]:
        return out
    for level in range(depth(n, leaf)):
        for k in range(1 << level):
            a, mid, b = k * n >> level, (2 * k + 1) * n >> level + 1, (k + 1) * n >> level
            own = rows[out[a:b]]
            side = own[:, np.argmax(own.max(0) - own.min(0))]
            out[a:b] = out[a:b][np.argpartition(side, mid - a)] if a < mid < b else out[a:b]
    return out


def distances(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances as whole numbers, by a product of doubles where these hold all of it exactly."""
    most = max(int(np.abs(rows).max(initial=0)), int(np.abs(entries).max(initial=0)))
    kind = np.float64 if 4 * most * most * max(1, rows.shape[1]) < DOUBLE else np.int64
    a, b = rows.astype(kind), entries.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)


class Codebook:
    """The entries of one part, with a tree over the distinct ones; of equal entries the first stands for all."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        first = np.sort(np.unique(entries, axis=0, return_index=True)[1]) if entries.shape[1] else np.zeros(1, np.int64)
        place = order(entries[first], 1)
        self.index = first[place]
        self.tree = Tree(entries[self.index], 1)

    def assigned(self, parts: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """For the tree of a block's parts: each row's entry, sums and counts by entry, and the rows that whole nodes took along.

        Pairs of a node of parts and a node of entries go down both trees. Every part of a node has an entry within the least of the largest
        distances of its pairs, so a pair whose smallest distance is larger goes. A node that is left with one entry goes to it as a whole, with its
        stored sum. Leaves with several are decided by the distances of their rows, ties to the lower index.
        """
        codes = np.zeros(parts.n, np.int64)
        sums, counts = np.zeros(self.entries.shape, np.int64), np.zeros(len(self.entries), np.int64)
        own, other, whole = np.zeros(1, np.int64), np.zeros(1, np.int64), 0
        level = below = 0
        while len(own):
            low, high = parts.low[level][own], parts.high[level][own]
            least, most = self.tree.low[below][other], self.tree.high[below][other]
            gap = np.maximum(np.maximum(least - high, low - most), 0)
            reach = np.maximum(np.abs(most - low), np.abs(high - least))
            near, far = (gap * gap).sum(1), (reach * reach).sum(1)
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            keep = near <= np.repeat(np.minimum.reduceat(far, heads), np.diff(np.append(heads, len(own))))
            own, other = own[keep], other[keep]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            number = np.diff(np.append(heads, len(own)))
            a, b = self.tree.span(below, other[heads])
            alone = (number == 1) & (b - a == 1)
            for k, e in zip(own[heads[alone]], self.index[a[alone]], strict=True):
                start, end = parts.span(level, k)
                codes[start:end] = e
                sums[e] += parts.total[level][k]
                counts[e] += end - start
                whole += end - start
            left = np.repeat(~alone, number)
            own, other = own[left], other[left]
            if level == parts.depth and below == self.tree.depth:
                break
            if level < parts.depth:
                level += 1
                own, other = np.repeat(2 * own, 2), np.repeat(other, 2)
                own[1::2] += 1
            if below < self.tree.depth:
                below += 1
                own, other = np.repeat(own, 2), np.repeat(2 * other, 2)
                other[1::2] += 1
            place = np.argsort(own, kind="stable")
            own, other = own[place], other[place]
        firsts, ends = self.tree.span(below, other)
        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))[: len(own)]
        for i, j in zip(heads, np.append(heads[1:], len(own))[: len(own)], strict=True):
            start, end = parts.span(level, own[i])
            candidates = np.sort(np.concatenate([self.index[a:b] for a, b in zip(firsts[i:j], ends[i:j], strict=True)]))
            rows = parts.rows[start:end]
            codes[start:end] = found = candidates[distances(rows, self.entries[candidates]).argmin(1)]
            np.add.at(sums, found, rows)
            np.add.at(counts, found, 1)
        return codes, sums, counts, int(whole)


def kept(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, v as whole numbers: none whose vector is null or holds null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE))).cast("long"))
    return vectors.select("vec_id", "label", whole.alias("v"), x.alias("x")).where(F.col("x").isNotNull() & ~bad).drop("x")


def _blocks(rows: DataFrame, length: int) -> DataFrame:
    """Blocks of up to BLOCK_ROWS vectors: their ids and labels, and for each part the order of its tree and the rows in that order."""
    at = edges(length)
    label = rows.schema["label"].dataType.simpleString()

    def block(batch: pa.RecordBatch) -> dict:
        v = np.asarray(batch["v"].flatten()).reshape(batch.num_rows, length)
        most = int(np.abs(v).max(initial=0))
        if 4 * most * most * max(1, at[1]) * PARTS >= WHOLE:
            raise ArithmeticError("a component is too large for squared distances in 64 bits")
        out = {"vec_id": batch["vec_id"].to_pylist(), "label": batch["label"].to_pylist(), "places": [], "parts": []}
        for a, b in zip(at[:-1], at[1:], strict=True):
            place = order(v[:, a:b], LEAF_ROWS)
            out["places"].append(place.astype("<i4").tobytes())
            out["parts"].append(v[place, a:b].astype("<i8" if most >> 31 else "<i4").tobytes())
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        kind = None

        def joined() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_pylist([block(table)], kind)

        for b in batches:
            kind = kind or pa.schema([("vec_id", pa.list_(b.schema.field("vec_id").type)), ("label", pa.list_(b.schema.field("label").type)), ("places", pa.list_(pa.binary())), ("parts", pa.list_(pa.binary()))])
            at_ = 0
            while at_ < b.num_rows:
                piece = b.slice(at_, BLOCK_ROWS - sum(x.num_rows for x in held))
                held.append(piece)
                at_ += piece.num_rows
                if sum(x.num_rows for x in held) == BLOCK_ROWS:
                    yield joined()
                    held = []
        if held:
            yield joined()

    return rows.mapInArrow(run, f"vec_id array<long>, label array<{label}>, places array<binary>, parts array<binary>")


def _trees(row: dict, length: int) -> Iterator[tuple[int, np.ndarray, Tree]]:
    """(part, order, tree) of a block."""
    at, n = edges(length), len(row["vec_id"])
    for p, (place, raw) in enumerate(zip(row["places"], row["parts"], strict=True)):
        wide = at[p + 1] - at[p]
        kind = "<i8" if len(raw) == 8 * n * wide else "<i4"
        yield p, np.frombuffer(place, "<i4"), Tree(np.frombuffer(raw, kind).astype(np.int64).reshape(n, wide), LEAF_ROWS)


def _summed(entries: list[np.ndarray], length: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        sums, counts = [np.zeros(e.shape, np.int64) for e in entries], [np.zeros(len(e), np.int64) for e in entries]
        for b in batches:
            for row in b.to_pylist():
                for p, _, tree in _trees(row, length):
                    _, s, n, _ = books[p].assigned(tree)
                    sums[p] += s
                    counts[p] += n
        for p in range(PARTS):
            used = np.flatnonzero(counts[p])
            wide = sums[p].shape[1] + 1
            value = np.concatenate([counts[p][used][:, None], sums[p][used]], axis=1)
            yield pa.RecordBatch.from_pydict({"part": np.full(len(used) * wide, p, np.int32), "entry": np.repeat(used, wide).astype(np.int32), "position": np.tile(np.arange(-1, wide - 1, dtype=np.int32), len(used)), "value": value.ravel()})

    return run


def fitted(blocks: DataFrame, entries: list[np.ndarray], length: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after the rounds. A task gives a sum for each component of an entry, Spark adds those up, and the driver gets as many numbers as
    the codebooks have."""
    for _ in range(rounds):
        parts = blocks.mapInArrow(_summed(entries, length), "part int, entry int, position int, value long")
        found = parts.groupBy("part", "entry", "position").agg(F.sum("value").alias("value")).toPandas().sort_values(["part", "entry", "position"])
        entries = [e.copy() for e in entries]
        for (p, e), own in found.groupby(["part", "entry"])["value"]:
            values = own.to_numpy()
            entries[p][e] = values[1:] // values[0]
    return entries


def digest(entries: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimals, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for e in entries for x in e.ravel().tolist()).encode()).hexdigest()


def coded(blocks: DataFrame, entries: list[np.ndarray], length: int, label: str) -> DataFrame:
    """(vec_id, label, code, error) of each vector of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        for b in batches:
            for k, row in enumerate(b.to_pylist()):
                codes, error = np.zeros((len(row["vec_id"]), PARTS), np.uint8), np.zeros(len(row["vec_id"]), np.int64)
                for p, place, tree in _trees(row, length):
                    found = books[p].assigned(tree)[0]
                    codes[place, p] = found
                    off = tree.rows - entries[p][found]
                    error[place] += (off * off).sum(1)
                text = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([b["vec_id"].slice(k, 1).flatten(), b["label"].slice(k, 1).flatten(), pa.array([text[2 * PARTS * i : 2 * PARTS * (i + 1)] for i in range(len(codes))]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return blocks.mapInArrow(run, f"vec_id long, label {label}, code string, error long")


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each row of vectors (vec_id, embedding, label) that takes part.

    Rows whose vector is null or holds null or non-finite components have no row. Each length of vectors has codebooks of its own, which start
    as the parts of the ENTRIES smallest vec_ids (null last; rows that share one in the order of their components). Repeated rows count as often
    as they come. label_error is the sum of errors over rows of equal label, nulls together, whatever their lengths. Components whose squared
    distances do not fit in 64 bits raise ArithmeticError. An empty table gives no rows; other columns are not read.
    """
    # The type of vec_id is fixed here, so that tasks agree on it; a label keeps its own.
    label = vectors.schema["label"].dataType.simpleString()
    rows = written(kept(vectors).withColumn("vec_id", F.col("vec_id").cast("long")), "whole-vectors")
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    rank = F.row_number().over(Window.partitionBy(F.size("v")).orderBy(F.col("vec_id").asc_nulls_last(), "v"))
    first = rows.select("vec_id", "v", rank.alias("k")).where(F.col("k") <= ENTRIES)
    tables = []
    for length in lengths:
        start = [r["v"] for r in first.where(F.size("v") == length).orderBy("k").collect()]
        whole, at = np.array(start, np.int64).reshape(len(start), length), edges(length)
        blocks = written(_blocks(rows.where(F.size("v") == length), length), "vector-blocks")
        entries = fitted(blocks, [whole[:, a:b] for a, b in zip(at[:-1], at[1:], strict=True)], length, rounds)
        tables.append(coded(blocks, entries, length, label).withColumn("codebooks_sha256", F.lit(digest(entries))))
    if not tables:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    every = written(reduce(DataFrame.unionByName, tables), "vector-codes")
    sums = every.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    small = every.select("label").distinct().limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    out = every.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql(rounds: int = ROUNDS) -> str:
    """DuckDB SQL: in each round every part meets every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS (SELECT n, part, any_value(v) AS v, arg_min(entry, d * {ENTRIES} + entry) AS entry, min(d) AS d FROM (SELECT n, p.part, p.v, e.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - e.v[i]) * (p.v[i] - e.v[i])))::BIGINT AS d FROM p JOIN e{r} e ON e.part = p.part) GROUP BY n, part)")
        if r < rounds:
            steps.append(f"m{r} AS (SELECT part, entry, list(c ORDER BY i) AS v FROM (SELECT part, entry, i, floor(sum(v[i]) / count(*))::BIGINT AS c FROM a{r}, unnest(range(1, len(v) + 1)) AS x(i) GROUP BY part, entry, i) GROUP BY part, entry)")
            steps.append(f"e{r + 1} AS (SELECT e.part, e.entry, coalesce(m.v, e.v) AS v FROM e{r} e LEFT JOIN m{r} m USING (part, entry))")
    return f"""
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS v, row_number() OVER (ORDER BY vec_id, embedding) AS n FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT n, part, v[part * len(v) // {PARTS} + 1:(part + 1) * len(v) // {PARTS}] AS v FROM k, unnest(range({PARTS})) AS x(part)),
e0 AS (SELECT part, n - 1 AS entry, v FROM p WHERE n <= {ENTRIES}),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds}),
c AS (SELECT n, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY n)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM k JOIN c USING (n), h
"""


#: DuckDB SQL of compressed(), for vectors of one length.
SQL = _sql()
