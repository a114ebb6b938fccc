"""Ranked search against the scores of all documents, over whole numbers of Python."""

import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pingframe.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(docs, items):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(d[2] for d in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * k + 1))) for t, k in df.items()}
    out = []
    for item, text in sorted(set(items), key=str):
        scores = []
        for i, c, size in docs:
            m = 100 - 25 + (25 * size * n) // total
            s = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:20], 1)]
    return out


def zipf(n, seed, words=(1, 80), vocabulary=400):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{min(int(x), vocabulary)}" for x in rng.zipf(1.3, rng.integers(*words))) for _ in range(n)]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_odd_rows(spark):
    """Nulls, texts without terms, capitals, other scripts, equal scores, repeated rows and ids, clashing columns."""
    docs = [(1, "Cat dog"), (2, "cat dog"), (2, "cat dog"), (None, "CAT"), (None, None), (3, ""), (4, "... !!"), (5, "naïve ÉÀ 日本語 cat"), (6, "dog " * 3000), (7, "éÀ x_y"), (9, "cat, cat-cat"), *[(20 + i, "same words here") for i in range(40)]]
    items = [(1, "cat cat DOG"), (1, "cat cat DOG"), (1, "same"), (2, None), (3, ""), (None, "ÉÀ x naïve"), (5, "absent words"), (6, "日本語")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    for c in ("score", "rank", "term", "block", "query", "tasks", "df", "terms"):
        d, i = d.withColumn(c, F.lit("x")), i.withColumn(c, F.lit("y"))
    assert rows(ranked.ranked(d, i)) == sorted(slow(docs, items), key=str)
    assert ranked.ranked(d.where("false"), i).collect() == []
    assert ranked.ranked(d, i.where("false")).collect() == []


@pytest.mark.parametrize(("terms_", "block", "item_bytes"), [(2_000_000, 128, 4 << 20), (700, 4, 4 << 20), (3000, 16, 600)])
def test_segments_and_blocks_of_any_size_agree(spark, monkeypatch, terms_, block, item_bytes):
    monkeypatch.setattr(ranked, "SEGMENT_TERMS", terms_)
    monkeypatch.setattr(ranked, "BLOCK", block)
    docs = list(enumerate(zipf(900, 1)))
    items = list(enumerate(zipf(30, 2, (1, 25))))
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(2), spark.createDataFrame(items, "item_id long, text string")
    assert rows(ranked.ranked(d, i, item_bytes)) == sorted(slow(docs, items), key=str)


def test_long_lists_and_counts(spark):
    """Gaps of two bytes and counts of four."""
    docs = [(k, f"common {'rare ' * (300 if k == 900 else 1) if k in (0, 900, 1500) else ''}{'often ' * (k % 3)}") for k in range(1600)]
    items = [(1, "rare"), (2, "common rare often")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(1), spark.createDataFrame(items, "item_id long, text string")
    assert rows(ranked.ranked(d, i)) == sorted(slow(docs, items), key=str)


def test_blocks_are_rejected_undecoded(monkeypatch):
    """With a bound at hand, most blocks of a common list stay encoded, and what is left has all that reach the bound."""
    monkeypatch.setattr(ranked, "BLOCK", 8)
    rng = np.random.default_rng(5)
    counts = [Counter({b"common": 1, **({b"rare": int(rng.integers(1, 9))} if k % 97 == 0 else {})}) for k in range(5000)]
    lengths = [int(rng.integers(5, 60)) for _ in counts]
    own = ranked.segment(list(range(5000)), counts, lengths)
    own = {k: pa.array(v) if k in ("doc_ids", "df") else v for k, v in own.items()}
    seg = ranked.Segment(own, pa.array([b"common", b"rare"], pa.binary()), 5000, sum(lengths))
    query = [(0, 40), (1, 5000)]
    doc, every = (x.copy() for x in ranked.searched(seg, query, 0))
    order = np.lexsort((doc, -every))
    least = int(every[order[19]])
    seg = ranked.Segment(own, pa.array([b"common", b"rare"], pa.binary()), 5000, sum(lengths))
    decoded = []
    whole = seg.postings
    seg.postings = lambda t, wanted=None: decoded.append((t, None if wanted is None else len(wanted))) or whole(t, wanted)
    found, score = ranked.searched(seg, query, least)
    assert set(doc[every >= least]) == set(found) and (np.sort(score) == np.sort(every[every >= least])).all()
    assert decoded[0] == (1, None) and decoded[1][0] == 0 and decoded[1][1] < 60


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_sql(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('/root/testdata/{sf}/{t}.parquet')")
    got = ranked.ranked(*(spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "benchmark")))
    want = con.execute(ranked.SQL).df()
    assert got.columns == list(want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.itertuples(index=False, name=None))
