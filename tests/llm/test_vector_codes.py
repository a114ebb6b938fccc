"""Vector codes against Lloyd rounds by all distances, over whole numbers of Python."""

import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pingframe.llm import vector_codes

KINDS = "vec_id long, embedding array<float>, label int"


def slow(rows, rounds=4):
    """(vec_id, code, error, label_error, digest) of rows of one length; rows are (vec_id, vector, label)."""
    rows = [(i, [int(np.floor(1024 * float(x))) for x in v], k) for i, v, k in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(rows[0][1])
    at = [k * d // 4 for k in range(5)]
    books = [[r[1][at[p] : at[p + 1]] for r in rows[:256]] for p in range(4)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(4):
            parts = [r[1][at[p] : at[p + 1]] for r in rows]
            own = [nearest(x, books[p])[1] for x in parts]
            new.append([[sum(c) // own.count(i) for c in zip(*(x for x, k in zip(parts, own) if k == i))] if i in own else e for i, e in enumerate(books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, by = [], {}
    for i, v, k in rows:
        found = [nearest(v[at[p] : at[p + 1]], books[p]) for p in range(4)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(x for x, _ in found), k))
        by[k] = by.get(k, 0) + out[-1][2]
    return [(i, c, e, by[k], digest) for i, c, e, k in out]


def clustered(n, d, seed=1, centres=40, spread=0.01):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(centres, d))
    return (base[rng.integers(0, centres, n)] + rng.normal(size=(n, d)) * spread).astype(np.float32)


@pytest.mark.parametrize(("n", "width", "entries", "spread"), [(700, 6, 90, 0.01), (300, 3, 256, 1.0), (40, 4, 7, 0.0), (1, 2, 1, 1.0), (500, 0, 5, 1.0)])
def test_trees_assign_as_all_distances(n, width, entries, spread):
    x = np.floor(1024 * clustered(n, width, n, spread=spread).astype(float)).astype(np.int64)
    book = x[:entries]
    place = vector_codes.order(x, 16)
    assert sorted(place) == list(range(n))
    tree = vector_codes.Tree(x[place], 16)
    codes, sums, counts, whole = vector_codes.Codebook(book).assigned(tree)
    d = ((x[place][:, None] - book[None]) ** 2).sum(2)
    want = d.argmin(1)
    assert (codes == want).all()
    assert (counts == np.bincount(want, minlength=len(book))).all()
    assert all((sums[e] == x[place][want == e].sum(0)).all() for e in range(len(book)))
    assert 0 <= whole <= n


def test_whole_nodes_are_assigned_at_once():
    """In tight groups far apart, stored sums serve more than half of all rows; halves at medians part some groups."""
    x = np.floor(1024 * clustered(8000, 8, spread=0.001).astype(float)).astype(np.int64)
    book = np.unique(np.floor(1024 * clustered(8000, 8, spread=0.0).astype(float)).astype(np.int64), axis=0)
    tree = vector_codes.Tree(x[vector_codes.order(x, 16)], 16)
    assert vector_codes.Codebook(book).assigned(tree)[3] > 4000


def test_large_numbers_stay_whole():
    x = np.array([[2**28, 0], [2**28 - 1, 1], [-(2**28), 5]], np.int64)
    want = [[sum(int(a - b) ** 2 for a, b in zip(r, e)) for e in x] for r in x]
    assert vector_codes.distances(x, x).tolist() == want


def test_odd_rows(spark):
    """Nulls, non-finite components, other lengths, ties, repeated and null ids and labels, clashing columns."""
    rng = np.random.default_rng(3)
    eight = [(i, rng.normal(size=8).tolist(), i % 3 or None) for i in range(300)]
    eight += [(5, rng.normal(size=8).tolist(), 1), eight[7], eight[7], (None, eight[9][1], 2), (900, [0.0] * 8, None)] + [(1000 + i, eight[3][1], 7) for i in range(60)]
    six = [(2000 + i, rng.normal(size=6).tolist(), 9) for i in range(20)]
    two, none = [(3000, [1.5, -2.25], 8), (3001, [0.5, 2.0], 8)], [(4000, [], 6), (4001, [], 6)]
    bad = [(1, None, 1), (2, [1.0, None, *[0.0] * 6], 1), (3, [float("nan")] * 8, 1), (4, [float("inf"), *[0.0] * 7], 1), (6, [float("-inf"), *[0.0] * 7], 1)]
    df = spark.createDataFrame([*eight, *six, *two, *none, *bad], KINDS).repartition(5)
    for c in ("v", "x", "k", "code", "error", "part", "entry"):
        df = df.withColumn(c, F.lit("x"))
    f32 = lambda rows: [(i, np.array(v, np.float32).tolist(), k) for i, v, k in rows]
    want = [r for own in (eight, six, two, none) for r in slow(f32(own))]
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in vector_codes.compressed(df).collect()), key=key) == sorted(want, key=key)
    assert vector_codes.compressed(df.where("false")).collect() == []


def test_blocks_of_any_size_agree(spark, monkeypatch):
    df = spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(clustered(600, 12, spread=0.3))], KINDS)
    want = sorted(map(tuple, vector_codes.compressed(df.repartition(3)).collect()))
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 70)
    monkeypatch.setattr(vector_codes, "BROADCAST_LABELS", 2)
    assert sorted(map(tuple, vector_codes.compressed(df.repartition(2)).collect())) == want


def test_too_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large for squared distances"):
        vector_codes.compressed(spark.createDataFrame([(1, [1e30] * 4, 1)], KINDS)).collect()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('/root/testdata/{sf}/embeddings.parquet')")
    got = vector_codes.compressed(spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet"))
    want = con.execute(vector_codes.SQL).df()
    assert got.columns == list(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))
