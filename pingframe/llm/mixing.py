"""Mixing sources to target weights: whole epochs, then a subset-sum fit of what is left over the counts of exact lengths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from pingframe.llm._shared import free, numbered, small_batches
from pingframe.plans.tables import written

#: Weights of the sources in turn, the share of all sizes to take, the most a source or document is taken.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2
#: The remaining budget that the dynamic programme fits is at most this many words (or the longest document, if that is longer). A bound of the
#: method, not of the data: what comes before it is taken evenly of all lengths, and every budget is met to the word that lengths allow.
FIT_WORDS = 1 << 15
SEED = 17
#: More sources than this are refused: their totals are handled on the driver.
MOST_SOURCES = 1_000_000


@F.pandas_udf(LongType())
def words_in(texts: pd.Series) -> pd.Series:
    """The number of runs without ASCII white space; null has none."""
    return pd.Series([len(t.encode("utf-8", "surrogatepass").split()) if isinstance(t, str) else 0 for t in texts], dtype="int64")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Each source's target: share of all sizes by weight, at most `most` times its own; what is above goes to the others by weight
    until none is above. Sources in code point order, null last, take the weights in turn."""
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    size = np.array([float(n) for _, n in order])
    weight = np.array([weights[i % len(weights)] for i in range(len(order))])
    limit, out = most * size, np.zeros(len(order))
    free, left = np.ones(len(order), dtype=bool), share * size.sum()
    while free.any() and weight[free].sum() > 0:
        out[free] = left * weight[free] / weight[free].sum()
        above = free & (out > limit)
        if not above.any():
            break
        out[above] = limit[above]
        left -= limit[above].sum()
        free &= ~above
    return {s: float(t) for (s, _), t in zip(order, out, strict=True)}


def chosen(lengths: np.ndarray, counts: np.ndarray, budget: int, fit_words: int = FIT_WORDS) -> np.ndarray:
    """How many documents of each length to take, so that their words come as near to budget as possible without passing it.

    First an even share of each length, then single ones from the longest down while more is left than the fit takes; then a bounded
    knapsack over all documents not yet taken: multiples are split in powers of two, reach[w] tells whether w words can be made, and
    by[w] which piece made them first, from which the choice is read back.
    """
    take = np.zeros(len(lengths), dtype=np.int64)
    real = lengths > 0
    if budget <= 0 or not real.any():
        return take
    total = int((lengths * counts).sum())
    if budget >= total:
        return np.where(real, counts, 0)
    span = max(fit_words, int(lengths.max()))
    if budget > span:
        take = np.where(real, np.floor(counts * ((budget - span) / total)).astype(np.int64), 0)
    left = budget - int((take * lengths).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if left <= span:
            break
        if real[i]:
            n = min(int(counts[i] - take[i]), (left - span + int(lengths[i]) - 1) // int(lengths[i]), left // int(lengths[i]))
            take[i] += n
            left -= n * int(lengths[i])
    reach, by, pieces = np.zeros(left + 1, dtype=bool), np.full(left + 1, -1, dtype=np.int64), []
    reach[0] = True
    for i in np.flatnonzero(real & (counts > take)):
        n, step = min(int(counts[i] - take[i]), left // int(lengths[i])), 1
        while n > 0 and not reach[left]:
            k = min(step, n)
            w = k * int(lengths[i])
            new = np.flatnonzero(reach[: left + 1 - w] & ~reach[w:]) + w
            reach[new], by[new] = True, len(pieces)
            pieces.append((i, k))
            n, step = n - k, step * 2
        if reach[left]:
            break
    w = int(np.flatnonzero(reach)[-1])
    while w:
        i, k = pieces[by[w]]
        take[i] += k
        w -= k * int(lengths[i])
    return take


def planned(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, size, epochs, extra, source_size, target) for each source and length: how often all, and how many once more."""
    counts = docs.groupBy("source", "size").agg(F.count("*").alias("n"))
    totals = counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("size")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources")
    sizes = {r["source"]: int(r["size"]) for r in totals}
    goal = targets(list(sizes.items()), weights, share, most)

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        source = key[0] if isinstance(key[0], str) else None
        b = b.sort_values("size")
        size = sizes[source]
        epochs = min(most, int(goal[source] // size)) if size else 0
        extra = chosen(b["size"].to_numpy(), b["n"].to_numpy(), round(goal[source] - epochs * size)) if epochs < most else 0
        return pd.DataFrame({"source": source, "size": b["size"], "epochs": epochs, "extra": extra, "source_size": size, "target": goal[source]})

    return counts.groupBy("source").applyInPandas(run, "source string, size long, epochs long, extra long, source_size long, target double")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED, keep_source: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row of docs; taken = copies * size, copies up to `most`.

    Every document of a source is taken once for each whole time that its target holds its size; for the rest, `chosen` says how many
    documents of each length, and those come first by a seeded hash of doc_id. A source or length that holds a third of all rows is
    ranked in hash bins (see numbered). Null texts and null sources are defined: no words, and a source of their own. Rows equal in
    doc_id and length are interchangeable; documents without words are taken as often as all of their source are.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), words_in(F.col("text").cast("string")).alias("size"))
    rows = written(rows.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))), "sizes")
    plan = planned(rows, weights, share, most).select(F.col("source").alias("__source"), F.col("size").alias("__size"), "epochs", "extra", "source_size", "target")
    ranked = numbered(rows, ["source", "size"], ["h", "doc_id"], "rank", F.substring("h", 1, 2))
    out = ranked.join(plan, F.col("source").eqNullSafe(F.col("__source")) & (F.col("size") == F.col("__size")))
    copies = F.col("epochs") + F.when(F.col("rank") < F.col("extra"), 1).otherwise(0)
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), *(["source"] if keep_source else []))


def drawn(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns as they were.

    Rows are matched by doc_id, source and length. Where several rows share these, the copies that the mix gives to the group are
    dealt to its rows in the order of a hash of the whole row, so the group's total is kept; a group that holds a third of all rows (one
    null doc_id, say) is numbered in hash bins.
    """
    p = free(docs)
    marked = docs.withColumn(f"{p}source", F.col("source").cast("string")).withColumn(f"{p}size", words_in(F.col("text").cast("string")))
    picked = mixed(docs, weights, share, most, seed, keep_source=True)
    plan = picked.groupBy("doc_id", "source", "size").agg(F.count("*").alias(f"{p}rows"), F.sum("copies").alias(f"{p}sum"))
    plan = plan.select(F.col("doc_id").alias(f"{p}id"), F.col("source").alias(f"{p}of"), F.col("size").alias(f"{p}long"), f"{p}rows", f"{p}sum")
    same = F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & F.col(f"{p}source").eqNullSafe(F.col(f"{p}of")) & (F.col(f"{p}size") == F.col(f"{p}long"))
    both = marked.join(plan, same)
    base = F.floor(F.col(f"{p}sum") / F.col(f"{p}rows"))
    one = both.where(f"{p}rows = 1").withColumn(f"{p}copies", F.col(f"{p}sum"))
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    alike = both.where(f"{p}rows > 1").withColumn(f"{p}hash", hashed)
    placed = numbered(alike, [f"{p}id", f"{p}of", f"{p}long"], [f"{p}hash"], f"{p}place", F.pmod(f"{p}hash", F.lit(256))).drop(f"{p}hash")
    many = placed.withColumn(f"{p}copies", base + F.when(F.col(f"{p}place") < F.col(f"{p}sum") - base * F.col(f"{p}rows"), 1).otherwise(0)).drop(f"{p}place")
    out = one.unionByName(many).where(f"{p}copies > 0")
    return out.withColumn(f"{p}copy", F.explode(F.sequence(F.lit(1), F.col(f"{p}copies").cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
