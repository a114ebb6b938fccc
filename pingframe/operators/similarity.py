"""Pairs of vectors that correlate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingframe.operators.raster import mean_std
from pingframe.plans.tables import written

#: Probability that a pair shares no key. A sign of a projection differs with probability arccos(least) / pi, 0.078 at 0.97.
MISSED = 2e-7
#: Vectors of a key, if they are unrelated: a key has so many signs that its lists stay as long when the table grows. More than KEYS keys are not
#: taken: then a key has fewer signs, and its lists are longer.
LIST, KEYS = 128, 512
#: Vectors of a key that meet in one task: larger lists are cut into blocks, each pair of blocks by itself.
BLOCK = 1024
#: Rows of a task that holds lists, and pairs that are multiplied out at a time.
TASK_ROWS, PAIRS = 100_000, 65_536


def key_shape(rows: int, least: float) -> tuple[int, int]:
    """(keys, signs of a key) for so many vectors."""
    same = min(1 - math.acos(max(-1.0, min(1.0, least))) / math.pi, 0.99)
    needed = lambda signs: math.ceil(math.log(MISSED) / math.log1p(-(same**signs)))
    signs = min(24, max(4, math.ceil(math.log2(max(1, rows) / LIST))))
    while signs > 1 and needed(signs) > KEYS:
        signs -= 1
    return needed(signs), signs


def correlated(vectors: DataFrame, least: float, group: str | None = None, seed: int = 3) -> DataFrame:
    """(a, b): ids of vectors (id, v) whose correlation is at least `least`, a < b; with `group` only pairs of different groups.

    Standardised vectors are stored with keys of signs of fixed projections; vectors of a key meet in blocks, and each pair is multiplied out. A pair
    is given by the first key that it shares. Vectors without deviation have no correlation. Vectors of different sizes never meet.
    """
    rows = vectors.count()
    keys, signs = key_shape(rows, least)
    mean, std = mean_std(F.col("v"))
    unit = vectors.select("id", F.size("v").alias("n"), (F.col(group) if group else F.col("id")).cast("string").alias("g"), "v", mean.alias("m"), std.alias("s")).where("id is not null and s > 0 and s < double('infinity')")
    unit = unit.select("id", "n", "g", F.transform("v", lambda x: (x - F.col("m")) / F.col("s") / F.sqrt(F.col("n"))).alias("z"))
    kind = dict(unit.dtypes)["id"]

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n, own in b.groupby("n"):
                planes = np.random.default_rng(seed + int(n)).standard_normal((int(n), keys * signs))
                z = np.stack(own["z"].to_numpy())
                step = max(1, 4_000_000 // (keys * signs))
                bits = ((z[at : at + step] @ planes > 0).reshape(-1, keys, signs) for at in range(0, len(z), step))
                names = np.concatenate([(x << np.arange(signs)).sum(axis=2) for x in bits]).astype(np.int32)
                yield own[["id", "n", "g"]].assign(z=[x.tobytes() for x in z], keys=list(names), all=[x.tobytes() for x in names])

    stored = written(unit.mapInPandas(keyed, f"id {kind}, n int, g string, z binary, keys array<int>, all binary"), "keyed")
    entry = (F.col("k").cast("long") * (1 << 24) + F.col("name")).alias("key")
    named = stored.select("n", F.posexplode("keys").alias("k", "name")).select("n", entry)
    large = written(named.groupBy("n", "key").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select("n", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("of")), "large-lists")
    lists = stored.select("id", "n", "g", "z", "all", F.posexplode("keys").alias("k", "name")).select("id", "n", "g", "z", "all", entry).join(large, ["n", "key"], "left")
    lists = lists.withColumn("of", F.coalesce("of", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("of")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    lists = lists.select("key", "n", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "g", "z", "all")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            names = b[["key", "n", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
            rest = b.iloc[starts[-1] :]
            yield from met(b, starts)
        if rest is not None:
            yield from met(rest, np.array([0, len(rest)]))

    def met(b: pd.DataFrame, bounds: np.ndarray) -> Iterator[pd.DataFrame]:
        key, i, j, own, ids, groups, zs, names = (b[c].to_numpy() for c in ("key", "i", "j", "own", "id", "g", "z", "all"))
        found = []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            z = np.frombuffer(b"".join(zs[lo:hi])).reshape(hi - lo, -1)
            if i[lo] == j[lo]:
                x, y = np.nonzero(np.triu(z @ z.T >= least - 1e-9, 1))
            else:
                left, right = np.flatnonzero(own[lo:hi] == i[lo]), np.flatnonzero(own[lo:hi] == j[lo])
                x, y = np.nonzero(z[left] @ z[right].T >= least - 1e-9)
                x, y = left[x], right[y]
            for at in range(0, len(x), PAIRS):
                p, q = x[at : at + PAIRS], y[at : at + PAIRS]
                keep = (z[p] * z[q]).sum(axis=1) >= least
                p, q = p[keep] + lo, q[keep] + lo
                keep = (ids[p] != ids[q]) & (groups[p] != groups[q])
                p, q = p[keep], q[keep]
                if not len(p):
                    continue
                name = np.frombuffer(b"".join(names[lo:hi]), np.int32).reshape(hi - lo, keys)
                first = (name[p - lo] == name[q - lo]).argmax(axis=1) == key[lo] >> 24
                a, c = ids[p[first]], ids[q[first]]
                found.append(pd.DataFrame({"a": np.where(a < c, a, c), "b": np.where(a < c, c, a)}))
                if sum(map(len, found)) >= PAIRS:
                    yield pd.concat(found)
                    found = []
        if found:
            yield pd.concat(found)

    tasks = max(vectors.sparkSession.sparkContext.defaultParallelism, -(-rows * keys // TASK_ROWS))
    return lists.repartition(tasks, "key", "n", "i", "j").sortWithinPartitions("key", "n", "i", "j").mapInPandas(run, f"a {kind}, b {kind}")
