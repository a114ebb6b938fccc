"""Benchmark decontamination with suffix arrays over shards of the training text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pingframe.llm._shared import free, small_batches
from pingframe.plans.tables import written

WINDOW = 10
#: Test items are searched in blocks of about this many bytes: a block goes to every task, more items take more passes over the text.
BLOCK_BYTES = 32 << 20
#: Training text is indexed in shards of about this many words.
SHARD_WORDS = 400_000

#: A-Z to a-z, other ASCII characters that are no letters or digits to a space; bytes beyond ASCII stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """Words are runs without ASCII marks, spaces and controls, A-Z lower-cased; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Items:
    """A block of test items as numbers: every distinct word has one from 1; 0 stands for all other words."""

    def __init__(self, ids: list, texts: list[str | None], window: int = WINDOW) -> None:
        self.ids, self.window, self.vocabulary = ids, window, {}
        self.items = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(t)], dtype=">u4") for t in texts]
        self.depths = sorted({min(window, len(x)) for x in self.items if len(x)})


def suffix_array(tokens: np.ndarray, known: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the suffixes whose first `depth` words are all test words, sorted by these words, and these words as byte keys.

    known[i]: the number of test words from position i up to the next other word or the end of the document. No other suffix can hold
    a window, so none is sorted; big-endian numbers make byte order word order.
    """
    at = np.flatnonzero(known >= depth)
    keys = np.lib.stride_tricks.sliding_window_view(tokens, depth)[at] if len(at) else np.empty((0, depth), dtype=">u4")
    keys = np.ascontiguousarray(keys, dtype=">u4").view(f"S{4 * depth}").ravel()
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def numbers(text: str | None, items: Items) -> np.ndarray:
    """The words of text as numbers of items' vocabulary, 0 for those that no item has."""
    w = words(text)
    return np.fromiter(map(items.vocabulary.get, w, repeat(0)), dtype=np.int64, count=len(w))


def matches(docs: list[np.ndarray], items: Items) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, word, item, item_word, length) of the longest verbatim matches of items in docs that hold a window.

    Every suffix of every item is searched for in the shard's suffix array by bisection of its first `window` words (all words, of a
    shorter item). Matches of suffix after suffix at word after word are one longer match; they are found by sorting all matches
    by their offset against the item, so a passage that many documents share costs no step of Python for each.
    """
    if not docs or not items.depths:
        return
    tokens = np.concatenate([np.r_[x, 0] for x in docs]).astype(">u4")  # a 0 ends each document
    starts = np.cumsum([0, *(len(x) + 1 for x in docs)])
    zeros = np.flatnonzero(tokens == 0)
    known = zeros[np.searchsorted(zeros, np.arange(len(tokens)))] - np.arange(len(tokens))
    arrays = {d: suffix_array(tokens, known, d) for d in items.depths}
    for n, item in enumerate(items.items):
        if not len(item):
            continue
        depth = min(items.window, len(item))
        at, keys = arrays[depth]
        suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(item, depth)).view(f"S{4 * depth}").ravel()
        lows, highs = np.searchsorted(keys, suffixes, side="left"), np.searchsorted(keys, suffixes, side="right")
        hits = highs - lows
        if not hits.any():
            continue
        k = np.repeat(np.arange(len(suffixes)), hits)
        p = at[np.repeat(lows, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)]
        order = np.lexsort((p, p - k))
        p, k = p[order], k[order]
        first = np.flatnonzero(np.r_[True, (np.diff(p) != 1) | (np.diff(k) != 1)])
        last = np.r_[first[1:], len(p)] - 1
        row = np.searchsorted(starts, p[first], side="right") - 1
        yield from zip(row.tolist(), (p[first] - starts[row]).tolist(), [n] * len(first), k[first].tolist(), (last - first + depth).tolist(), strict=True)


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """The distinct items, block after block; a block is bounded by its bytes, so no more than that is on the driver or in a task at once."""
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).distinct()
    total = items.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) if n > 1 else items
        rows = part.collect()
        yield [r["item_id"] for r in rows], [r["text"] for r in rows]


FOUND = "array<struct<item_id:string,word:int,item_word:int,length:int>>"


def _search(block: Broadcast):
    """A column function: the number of words of each text, and its longest matches with the items of block."""

    @F.pandas_udf(f"n long, found {FOUND}")
    def search(batch: pd.Series) -> pd.DataFrame:
        items: Items = block.value
        counts: list[int] = []
        found: list[list] = []
        shard: list[np.ndarray] = []
        size = 0
        for n, t in enumerate(batch, 1):
            shard.append(numbers(t if isinstance(t, str) else None, items))
            size += len(shard[-1])
            if size >= SHARD_WORDS or n == len(batch):
                counts += map(len, shard)
                rows: list[list] = [[] for _ in shard]
                for row, word, item, k, length in matches(shard, items):
                    rows[row].append({"item_id": None if items.ids[item] is None else str(items.ids[item]), "word": word, "item_word": k, "length": length})
                found += rows
                shard, size = [], 0
        return pd.DataFrame({"n": counts, "found": found})

    return search


def searched(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs, then its number of words and what was found, named words and found after a prefix that docs has not (see free): an array of (item_id, word, item_word, length), the longest matches of each document.

    Items of one block take one pass over docs, without a shuffle. More items take a pass for each block: the matches of a block, by a
    128-bit hash of the text, are stored before the next block is read, and all are joined to docs in the end.
    """
    small_batches(docs.sparkSession)
    p = free(docs)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    text = F.col("text").cast("string")
    blocks, sc = _blocks(benchmark, block_bytes), docs.sparkSession.sparkContext
    held, stored = next(blocks), []
    for later in blocks:
        block = sc.broadcast(Items(*held, window))
        stored.append(_stored(docs, text, block))
        block.destroy()
        held = later
    last = sc.broadcast(Items(*held, window))
    if not stored:
        return docs.withColumn(f"{p}got", _search(last)(text)).select(*columns, F.col(f"{p}got.n").alias(f"{p}words"), F.col(f"{p}got.found").alias(f"{p}found"))
    every = reduce(DataFrame.unionByName, [*stored, _stored(docs, text, last)]).select(F.col("h1").alias(f"{p}h1"), F.col("h2").alias(f"{p}h2"), "found")
    gathered = every.groupBy(f"{p}h1", f"{p}h2").agg(F.flatten(F.collect_list("found")).alias(f"{p}found"))
    worded = docs.withColumn(f"{p}words", _counted(text)).withColumn(f"{p}k1", F.xxhash64(text)).withColumn(f"{p}k2", F.xxhash64(F.lit(1), text))
    both = worded.join(gathered, (F.col(f"{p}k1") == F.col(f"{p}h1")) & (F.col(f"{p}k2") == F.col(f"{p}h2")), "left")
    return both.select(*columns, f"{p}words", F.coalesce(f"{p}found", F.array().cast(FOUND)).alias(f"{p}found"))


@F.pandas_udf(LongType())
def _counted(texts: pd.Series) -> pd.Series:
    return pd.Series([len(words(t if isinstance(t, str) else None)) for t in texts], dtype="int64")


def _stored(docs: DataFrame, text: Column, block: Broadcast) -> DataFrame:
    """(h1, h2, found) of the texts of docs in which items of block occur, equal texts once."""
    got = docs.select(F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"), _search(block)(text)["found"].alias("found"))
    return written(got.where(F.size("found") > 0).groupBy("h1", "h2").agg(F.first("found").alias("found")), "found")


def decontaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs in which no window of an item occurs; columns stay as they are, whatever their names. Documents without words stay."""
    return searched(docs, benchmark, window).where(F.size(f"{free(docs)}found") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def reported(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of each row of docs.

    n_hit: words inside an occurrence of any window, each once. Items without words match nothing; items with the same id count once, a
    null id is the empty string. Null and empty texts have no words. Repeated rows stay.
    """

    @F.pandas_udf("n_hit long, n_items long, items_sha256 string")
    def digest(found: pd.Series) -> pd.DataFrame:
        rows = []
        for spans in found:
            hit, end = 0, 0
            for a, b in sorted((m["word"], m["word"] + m["length"]) for m in spans):
                hit, end = hit + max(0, b - max(a, end)), max(end, b)
            ids = sorted({m["item_id"] or "" for m in spans})
            rows.append((hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_hit", "n_items", "items_sha256"])

    slim = searched(docs.select("doc_id", "text"), benchmark, window, block_bytes).withColumn("d", digest("__found"))
    return slim.select("doc_id", F.col("__words").alias("n_words"), "d.n_hit", "d.n_items", "d.items_sha256", (F.col("d.n_hit") > 0).alias("contaminated"))


#: DuckDB SQL of reported().
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, w[i:i + least(10, len(w)) - 1] AS win FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS x(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS win FROM d, (SELECT DISTINCT n FROM bw) AS z, unnest(range(1, len(w) - n + 2)) AS x(i) WHERE len(w) >= n),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(i, i + n)) AS x(p) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM m) AS q GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""
