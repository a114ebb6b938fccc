"""Ranked lexical search: Block-Max MaxScore over an inverted index in segments, whose heaps are merged."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.llm._shared import small_batches
from pingframe.llm.leaks import words
from pingframe.plans.tables import written

#: Fixed values of the score: results of an item, steps of a term's weight and of a share, slope and base of a document's length.
TOP, WEIGHT, SHARE, SLOPE, LENGTH, BASE = 20, 1_000, 1_000_000_000, 12, 25, 75
#: A segment ends at about so many terms with repeats, or so many documents; a block of a list has so many documents.
SEGMENT_TERMS, SEGMENT_DOCS, BLOCK = 2_000_000, 1 << 16, 128
#: Items are searched in blocks of about this many bytes: a block goes to every task, more items take more passes over the index.
ITEM_BYTES = 4 << 20
#: Heaps of so many tasks are merged before all of an item's.
TASKS = 64

SEGMENT = {
    "n_docs": ("long", pa.int64()), "n_terms": ("long", pa.int64()), "doc_ids": ("array<long>", pa.list_(pa.int64())), "lengths": ("binary", pa.binary()),
    "terms": ("array<binary>", pa.list_(pa.binary())), "df": ("array<int>", pa.list_(pa.int32())), "widths": ("binary", pa.binary()),
    "first": ("binary", pa.binary()), "most_tf": ("binary", pa.binary()), "least_n": ("binary", pa.binary()),
    "gaps1": ("binary", pa.binary()), "gaps2": ("binary", pa.binary()), "tf1": ("binary", pa.binary()), "tf4": ("binary", pa.binary()),
}
HIT = "query int, item_id long, doc_id long, score long"


def segment(doc_ids: list, counts: list[Counter], lengths: list[int]) -> dict:
    """The index of some documents, at most SEGMENT_DOCS: for each term a list of documents in blocks of BLOCK, each with its largest term count and least length.

    A list holds its documents as gaps from the one before in the block, of 1 or 2 bytes each, and term counts of 1 or 4 bytes, of which it has none
    where all are 1.
    """
    terms = pa.array([t for c in counts for t in c], pa.binary()).dictionary_encode()
    tf = np.fromiter((n for c in counts for n in c.values()), np.int64, len(terms))
    doc = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
    place = np.argsort(np.asarray(terms.indices), kind="stable")
    doc, tf = doc[place], tf[place]
    df = np.bincount(np.asarray(terms.indices), minlength=len(terms.dictionary)).astype(np.int64)
    length = np.array(lengths, np.int64)
    starts = np.cumsum(df) - df
    inside = np.arange(len(doc)) - np.repeat(starts, df)
    heads = np.flatnonzero(inside % BLOCK == 0)
    gaps = np.diff(doc, prepend=0)
    gaps[heads] = 0
    empty = np.zeros(0, np.int64)
    over = lambda f, x, at: f.reduceat(x, at) if len(at) else empty
    wide, many = over(np.maximum, gaps, starts) > 255, over(np.maximum, tf, starts)
    kinds = wide * 1 + (many > 1) * 2 + (many > 255) * 4
    gap2, tf1, tf4 = (np.repeat(x, df) for x in (wide, (many > 1) & (many <= 255), many > 255))
    return {
        "n_docs": int((length > 0).sum()), "n_terms": int(length.sum()), "doc_ids": doc_ids, "lengths": length.astype("<u4").tobytes(), "terms": terms.dictionary, "df": df.astype(np.int32),
        "widths": kinds.astype(np.uint8).tobytes(), "first": doc[heads].astype("<u2").tobytes(), "most_tf": over(np.maximum, tf, heads).astype("<u4").tobytes(), "least_n": over(np.minimum, length[doc], heads).astype("<u4").tobytes(),
        "gaps1": gaps[~gap2].astype(np.uint8).tobytes(), "gaps2": gaps[gap2].astype("<u2").tobytes(), "tf1": tf[tf1].astype(np.uint8).tobytes(), "tf4": tf[tf4].astype("<u4").tobytes(),
    }


def indexed(docs: DataFrame) -> DataFrame:
    """The segments of docs (doc_id, text), a row each. Every row of docs is in one, whether it has terms or not; a document may be one by itself."""
    small_batches(docs.sparkSession)
    kinds = pa.schema([(k, v[1]) for k, v in SEGMENT.items()])

    def made(ids: list, counts: list[Counter], lengths: list[int]) -> pa.RecordBatch:
        own = segment(ids, counts, lengths)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays([0, len(x)], x) if isinstance(x := own[k.name], pa.Array) else pa.array([x], k.type) for k in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, counts, lengths, size = [], [], [], 0
        for b in batches:
            for doc, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
                found = words(text.as_py())
                ids.append(doc)
                counts.append(Counter(found))
                lengths.append(len(found))
                size += len(found)
                if size >= SEGMENT_TERMS or len(ids) == SEGMENT_DOCS:
                    yield made(ids, counts, lengths)
                    ids, counts, lengths, size = [], [], [], 0
        if ids:
            yield made(ids, counts, lengths)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{k} {v[0]}" for k, v in SEGMENT.items()))


class Segment:
    """A segment as it is searched: bounds of blocks are at hand, the lists of terms are decoded block by block or whole, and whole ones are kept."""

    def __init__(self, row: dict, terms: pa.Array, docs: int, total: int) -> None:
        """row: columns of one segment; terms: all terms of the items; docs, total: N and L of the whole table."""
        self.doc_ids = row["doc_ids"]
        length = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.slope = SLOPE * (BASE + LENGTH * length * docs // max(total, 1))
        df = np.asarray(row["df"]).astype(np.int64)
        kinds = np.frombuffer(row["widths"], np.uint8)
        self._gaps = {0: np.frombuffer(row["gaps1"], np.uint8), 1: np.frombuffer(row["gaps2"], "<u2")}
        self._tf = {2: np.frombuffer(row["tf1"], np.uint8), 6: np.frombuffer(row["tf4"], "<u4")}
        self._first = np.frombuffer(row["first"], "<u2").astype(np.int64)
        before = lambda own: np.cumsum(own) - own
        blocks = -(-df // BLOCK)
        at = np.asarray(pc.fill_null(pc.index_in(terms, value_set=row["terms"]), -1)).astype(np.int64)
        self.has = at >= 0
        at = np.where(self.has, at, 0) if len(df) else at
        if len(df):
            self._df, self._wide, self._many = df[at], kinds[at] & 1, kinds[at] & 6
            self._gap_at = np.where(self._wide, before(df * (kinds & 1))[at], before(df * (1 - (kinds & 1)))[at])
            self._tf_at = np.where(self._many == 6, before(df * ((kinds & 6) == 6))[at], before(df * ((kinds & 6) == 2))[at])
            self._block_at, self._blocks = before(blocks)[at], blocks[at]
        most, least = np.frombuffer(row["most_tf"], "<u4").astype(np.int64), np.frombuffer(row["least_n"], "<u4").astype(np.int64)
        #: The largest share that a posting of a block can have.
        self._bound = SHARE * most // (1_000 * most + SLOPE * (BASE + LENGTH * least * docs // max(total, 1)))
        self._kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._tops: dict[int, int] = {}

    def blocks(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        """First document and largest share of each block of a list."""
        own = slice(self._block_at[t], self._block_at[t] + self._blocks[t])
        return self._first[own], self._bound[own]

    def top(self, t: int) -> int:
        if t not in self._tops:
            self._tops[t] = int(self.blocks(t)[1].max())
        return self._tops[t]

    def postings(self, t: int, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Documents, rising, and their shares, in all blocks of a list or in the wanted ones (rising numbers of blocks)."""
        if t in self._kept:
            return self._kept[t]
        n, first = int(self._df[t]), self.blocks(t)[0]
        every = wanted is None or len(wanted) == len(first)
        if every:
            place, head = np.arange(n), np.arange(n) // BLOCK
            starts = np.arange(len(first)) * BLOCK
            begins = first
        else:
            sizes = np.minimum(BLOCK, n - wanted * BLOCK)
            head = np.repeat(np.arange(len(wanted)), sizes)
            starts = np.cumsum(sizes) - sizes
            place = np.arange(len(head)) - starts[head] + wanted[head] * BLOCK
            begins = first[wanted]
        gaps = np.cumsum(self._gaps[int(self._wide[t])][self._gap_at[t] + place].astype(np.int64))
        doc = gaps - gaps[starts][head] + begins[head]
        tf = self._tf[int(self._many[t])][self._tf_at[t] + place].astype(np.int64) if self._many[t] else 1
        share = SHARE * tf // (1_000 * tf + self.slope[doc])
        if every:
            self._kept[t] = doc, share
        return doc, share


def searched(seg: Segment, query: list[tuple[int, int]], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a segment that may be among the best, with all that score `least` or more and over 0.

    query: (term, weight times repeats). Lists are taken by what they can give at most. Those that together stay below `least` are not essential: a document
    that is in no other cannot be among the best. Documents of essential lists are candidates; what the blocks of the other lists can add to one
    bounds its score, and only blocks that hold a candidate still in question are decoded.
    """
    lists = sorted((w * seg.top(t), t, w) for t, w in query if w and seg.has[t])
    below = np.cumsum([x for x, _, _ in lists])
    cut = int(np.searchsorted(below, least)) if least > 0 else 0
    score = np.zeros(len(seg.doc_ids), np.int64)
    met = np.zeros(len(seg.doc_ids), bool)
    for _, t, w in lists[cut:]:
        doc, share = seg.postings(t)
        score[doc] += w * share
        met[doc] = True
    doc = np.flatnonzero(met)
    value = score[doc]
    spare = []
    for _, t, w in lists[:cut][::-1]:
        first, bound = seg.blocks(t)
        spare.append((t, w, first, w * bound))
    rest = np.zeros(len(doc), np.int64)
    held = []
    for t, w, first, most in spare:
        at = np.searchsorted(first, doc, "right") - 1
        add = np.where(at >= 0, most[np.maximum(at, 0)], 0)
        rest += add
        held.append((t, w, at, add))
    alive = np.flatnonzero(value + rest >= max(least, 1))
    for t, w, at, add in held:
        rest[alive] -= add[alive]
        inside = alive[at[alive] >= 0]
        if len(inside):
            own, share = seg.postings(t, np.unique(at[inside]))
            k = np.minimum(np.searchsorted(own, doc[inside]), len(own) - 1)
            value[inside] += np.where(own[k] == doc[inside], w * share[k], 0)
        alive = alive[value[alive] + rest[alive] >= max(least, 1)]
    return doc[alive], value[alive]


def best(score: np.ndarray, doc_id: np.ndarray, missing: np.ndarray) -> np.ndarray:
    """Places of the TOP highest scores, equal ones by ascending doc_id, missing ones last."""
    return np.lexsort((doc_id, missing, -score))[:TOP]


def _search(block: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every item's best documents of all segments of a task; what earlier segments gave bounds the search of later ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, terms, queries, docs, total = block.value
        vocabulary = pa.array(terms, pa.binary())
        none = np.zeros(0, np.int64)
        heaps = [(none, none, none)] * len(queries)
        for b in batches:
            for k in range(b.num_rows):
                row = {n: b[n].slice(k, 1).flatten() if n in ("doc_ids", "terms", "df") else b[n][k].as_py() for n in SEGMENT}
                seg = Segment(row, vocabulary, docs, total)
                if not len(row["terms"]):
                    continue
                missing = np.asarray(row["doc_ids"].is_null()).astype(np.int64)
                ids = np.asarray(row["doc_ids"].fill_null(0))
                for q, query in enumerate(queries):
                    score, doc_id, null = heaps[q]
                    found, value = searched(seg, query, int(score[-1]) if len(score) == TOP else 0)
                    if len(found):
                        score, doc_id, null = np.append(score, value), np.append(doc_id, ids[found]), np.append(null, missing[found])
                        place = best(score, doc_id, null)
                        heaps[q] = score[place], doc_id[place], null[place]
        for q, (score, doc_id, null) in enumerate(heaps):
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q, np.int32)), pa.array([items[q]] * len(score), pa.int64()), pa.array(doc_id, mask=null > 0), pa.array(score)], ["query", "item_id", "doc_id", "score"])

    return run


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list[Counter]]]:
    """The distinct items, block after block, with their terms; a block is bounded by its bytes."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        own = (rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else rows).collect()
        yield [r["item_id"] for r in own], [Counter(words(r["text"])) for r in own]


def _firsts(hits: DataFrame, group: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return hits.withColumn("rank", rank).where(F.col("rank") <= TOP)


def ranked(docs: DataFrame, items: DataFrame, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score) of the TOP documents of each item that score over 0, best first, equal scores by ascending doc_id, null last.

    docs (doc_id, text) are indexed whole; the index is stored and read once for each block of items. An item is a distinct (item_id, text), so
    repeated rows of items count once, and texts that share an item_id are ranked each by itself. Null texts and texts without terms find nothing and are
    not found; rows of docs that repeat a doc_id are documents of their own. Empty tables give no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    index = written(indexed(docs), "index")
    n_docs, n_terms = index.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
    out = None
    for k, (ids, counts) in enumerate(_blocks(items, item_bytes)):
        terms = sorted({t for c in counts for t in c})
        own = spark.createDataFrame([(bytearray(t),) for t in terms], "term binary")
        every = index.select(F.explode(F.arrays_zip("terms", "df")).alias("p")).select(F.col("p.terms").alias("term"), F.col("p.df").alias("df"))
        held = {bytes(r["term"]): r["df"] for r in every.join(F.broadcast(own), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
        weight = {t: math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * df + 1))) for t, df in held.items()}
        place = {t: i for i, t in enumerate(terms)}
        queries = [[(place[t], weight[t] * n) for t, n in c.items() if weight.get(t)] for c in counts]
        found = index.mapInArrow(_search(spark.sparkContext.broadcast((ids, terms, queries, n_docs, n_terms))), HIT).withColumn("block", F.lit(k))
        if k:  # later blocks' hits are stored one after the other; the first block's are searched with the result
            found = written(found, "hits")
        out = found if out is None else out.unionByName(found)
    several = out.withColumn("tasks", F.spark_partition_id() % TASKS)
    first = _firsts(several, ["block", "query", "tasks"]).drop("rank")
    return _firsts(first, ["block", "query"]).select("item_id", "rank", "doc_id", "score")


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: DuckDB SQL of ranked(): the scores of all documents that share a term with an item.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
p AS (SELECT k, x, count(*) AS tf FROM (SELECT k, unnest(w) AS x FROM d) GROUP BY k, x),
g AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
m AS (SELECT k, doc_id, {BASE} + (({LENGTH} * len(w) * n_docs) // n_terms) AS m FROM d, g WHERE len(w) > 0),
f AS (SELECT x, floor({WEIGHT} * ln((2 * n_docs + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, g GROUP BY x, n_docs),
i AS (SELECT item_id, text, x, count(*) AS r FROM (SELECT item_id, text, unnest({_TERMS}) AS x FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY item_id, text, x),
s AS (SELECT item_id, text, k, doc_id, sum(r * w * (({SHARE} * tf) // (1000 * tf + {SLOPE} * m)))::BIGINT AS score FROM i JOIN f USING (x) JOIN p USING (x) JOIN m USING (k) GROUP BY item_id, text, k, doc_id),
o AS (SELECT item_id, (row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST))::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {TOP}
"""
