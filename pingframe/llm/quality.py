"""Quality classifier: a generalised additive model with pairwise interactions, boosted one feature at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingframe.llm._shared import crc32, small_batches

#: The model is fitted on at most this many labelled rows, those of the smallest hash of doc_id.
FIT_ROWS = 20_000

FEATURES = (
    "log_words", "log_lines", "mean_word", "sd_word", "upper", "digit", "punct", "symbol", "pipe", "bang", "space", "other",
    "distinct_words", "top_word", "repeat_next", "distinct_pairs", "distinct_lines", "words_per_line", "long_words", "short_words",
    "capital_words", "symbol_ends", "stop_share", "period", "comma",
)


def _classes() -> np.ndarray:
    """For each byte one of: 0 lower, 1 upper, 2 digit, 3 .,;:'\"-()?, 4 other ASCII marks, 5 |, 6 !, 7 white space, 8 beyond ASCII."""
    t = np.full(256, 4, dtype=np.uint8)
    t[ord("a") : ord("z") + 1], t[ord("A") : ord("Z") + 1], t[ord("0") : ord("9") + 1] = 0, 1, 2
    t[list(b".,;:'\"-()?")], t[ord("|")], t[ord("!")], t[list(b" \t\n\r\x0b\x0c")], t[128:] = 3, 5, 6, 7, 8
    return t


CLASSES = _classes()


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES for a whole text; null counts as empty. Nothing but the text is read."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), max(1, len(raw))
    kind = np.bincount(CLASSES[np.frombuffer(raw, dtype=np.uint8)], minlength=9) / size
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    lines = [x for x in raw.split(b"\n") if x]
    lowered = raw.lower().split()
    _, codes = np.unique(np.fromiter(map(hash, lowered), dtype=np.int64, count=n), return_inverse=True)
    counts = np.bincount(codes) if n else np.zeros(1, dtype=np.int64)
    pairs = codes[:-1].astype(np.int64) * (len(counts) + 1) + codes[1:]
    ends = np.fromiter((w[-1] for w in words), dtype=np.uint8, count=n)
    starts = np.fromiter((w[0] for w in words), dtype=np.uint8, count=n)
    top = np.sort(counts)[::-1]
    d = max(1, n)
    return [
        np.log1p(n), np.log1p(len(lines)), lengths.mean() if n else 0.0, lengths.std() if n else 0.0,
        kind[1], kind[2], kind[3], kind[4], kind[5], kind[6], kind[7], kind[8],
        len(counts) / d, top[0] / d, float((codes[:-1] == codes[1:]).sum()) / d, len(np.unique(pairs)) / max(1, n - 1),
        len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), (lengths > 12).sum() / d, (lengths < 3).sum() / d,
        (CLASSES[starts] == 1).sum() / d, (CLASSES[ends] >= 4).sum() / d if n else 0.0, top[:8].sum() / d,
        raw.count(b".") / d, raw.count(b",") / d,
    ]


@dataclass
class Additive:
    """base + one table a feature + one table a pair of features; a row adds the entries of its bins."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for table, b in zip(self.tables, self.bins(x), strict=True):
            out += table[b]
        for f, g, ef, eg, table in self.pairs:
            out += table[np.searchsorted(ef, x[:, f], side="right"), np.searchsorted(eg, x[:, g], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(x: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, most + 1)[1:-1])) if len(x) else np.empty(0)


def _leaves(g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float) -> np.ndarray:
    """The leaf values, a bin each, of a tree over ordered bins with gradient sums g and weights h: `depth` levels of best splits."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    out = np.full(len(g), cg[-1] / (ch[-1] + ridge))
    if depth and len(g) > 1:
        lg, lh = cg[:-1], ch[:-1]
        rg, rh = cg[-1] - lg, ch[-1] - lh
        gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + ridge) + rg**2 / (rh + ridge), -np.inf)
        k = int(gain.argmax())
        if gain[k] > cg[-1] ** 2 / (ch[-1] + ridge) + 1e-12:
            return np.r_[_leaves(g[: k + 1], h[: k + 1], depth - 1, ridge, least), _leaves(g[k + 1 :], h[k + 1 :], depth - 1, ridge, least)]
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.15, most_bins: int = 48, n_pairs: int = 8, pair_rounds: int = 60, ridge: float = 1.0, least: float = 2.0) -> Additive:
    """Cyclic boosting: in each round every feature in turn gets a two-level tree over its bins, added to its table at a small rate.

    Then pairs of features: the pairs whose 8 x 8 cells explain most of what is left get tables, boosted in turn the same way.
    With no rows, or one label only, the tables are zero and the base is the smoothed share of label 1.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    edges = [_cuts(x[:, f], most_bins) for f in range(x.shape[1])]
    model = Additive(float(np.log(share / (1 - share))), edges, [np.zeros(len(e) + 1) for e in edges], [])
    if len(y) == 0 or y.min() == y.max():
        return model
    bins, margin = model.bins(x), np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for b, table in zip(bins, model.tables, strict=True):
            if len(table) > 1:
                g, h = slopes()
                step = rate * _leaves(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)), 2, ridge, least)
                table += step
                margin += step[b]
    g, h = slopes()
    coarse = [_cuts(x[:, f], 8) for f in range(x.shape[1])]
    cells = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]
    gains = []
    for f in range(len(cells)):
        for k in range(f + 1, len(cells)):
            at, wide = cells[f] * (len(coarse[k]) + 1) + cells[k], (len(coarse[f]) + 1) * (len(coarse[k]) + 1)
            gains.append(((np.bincount(at, g, wide) ** 2 / (np.bincount(at, h, wide) + ridge)).sum(), f, k))
    chosen = sorted(gains, reverse=True)[:n_pairs]
    model.pairs = [(f, k, coarse[f], coarse[k], np.zeros((len(coarse[f]) + 1, len(coarse[k]) + 1))) for _, f, k in chosen]
    for _ in range(pair_rounds):
        for f, k, _, _, table in model.pairs:
            g, h = slopes()
            rows, cols = table.shape
            at = cells[f] * cols + cells[k]
            sg, sh = np.bincount(at, g, rows * cols).reshape(rows, cols), np.bincount(at, h, rows * cols).reshape(rows, cols)
            top = _leaves(sg.sum(1), sh.sum(1), 1, ridge, least)  # first level: a cut of the one feature; second: of the other on each side
            cut = int(np.flatnonzero(np.diff(top))[0]) + 1 if np.diff(top).any() else rows
            step = np.zeros_like(table)
            for lo, hi in ((0, cut), (cut, rows)):
                if hi > lo:
                    step[lo:hi] = rate * _leaves(sg[lo:hi].sum(0), sh[lo:hi].sum(0), 1, ridge, least)
            table += step
            margin += step.ravel()[at]
    return model


def feature_table(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """`keep` and x (array of FEATURES) of each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.drop(columns="text").assign(x=[features(t if isinstance(t, str) else None) for t in b["text"]])

    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.schema.fields if f.name != "text")
    return slim.mapInPandas(run, f"{kinds}x array<double>")


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Additive:
    """The model of labels.quality for the rows whose crc32(doc_id) mod 3 is not 1: the fit_rows of them with the smallest hash.

    Only these rows' texts are read for it. Rows with null ids or labels other than 0 and 1 are not learned from; a doc_id that
    repeats in either table counts each time.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")).where("id is not null and y in (0, 1)")
    known = known.where(crc32(F.col("id").cast("string")) % 3 != 1)
    known = known.select("id", "y", F.xxhash64(F.lit("fit"), "id").alias("h")).orderBy("h", "id", "y").limit(fit_rows)
    rows = docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(known), "id")  # of fit_rows rows of three numbers at most
    got = feature_table(rows, ("h", "id", "y")).orderBy("h", "id", "y", "x").limit(fit_rows).toPandas()
    x = np.array(got["x"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return fit(x, got["y"].to_numpy(dtype=np.float64))


def scores(texts: pd.Series, model: Additive) -> np.ndarray:
    x = np.array([features(t if isinstance(t, str) else None) for t in texts], dtype=np.float64)
    return model.score(x.reshape(len(texts), len(FEATURES)))


def scored(docs: DataFrame, model: Additive) -> DataFrame:
    """(doc_id, score) of each row; score is 0 to 1, of label 1. Null and empty texts have a score too."""
    small_batches(docs.sparkSession)
    score = F.pandas_udf(lambda texts: pd.Series(scores(texts, model)), "double")
    return docs.select("doc_id", score(F.col("text").cast("string")).alias("score"))


def classified(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs; held_out is false for a null doc_id. Repeated rows stay."""
    out = scored(docs, trained(docs, labels, fit_rows))
    held = F.coalesce(crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs that the model does not reject (score >= 0.5), with their columns as they were."""
    model = trained(docs, labels, fit_rows)
    small_batches(docs.sparkSession)
    score = F.pandas_udf(lambda texts: pd.Series(scores(texts, model)), "double")
    return docs.where(score(F.col("text").cast("string")) >= 0.5)
