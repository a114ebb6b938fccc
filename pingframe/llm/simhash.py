"""SimHash near-duplicates: a byte-position inverted index with count filtering, then exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.llm._shared import free, small_batches
from pingframe.operators.graph import connected
from pingframe.plans.tables import written

BYTES = 8
#: Shingles that are hashed and counted at once.
PIECE = 16_384
#: Lists of the index with more entries than this are compared in blocks of about this many, each pair of blocks in a task of its own.
BLOCK = 4096
#: The index is made by tasks of about this many entries each.
TASK_ENTRIES = 1_000_000

#: Sampled prints: so many lists a print, each keyed by so many positions. A pair at 0.8 shares none with probability (1 - 0.8^4)^20 = 3e-5.
LISTS, LIST_BYTES = 20, 4
POSITIONS = LISTS * LIST_BYTES
#: Of the 80 positional bytes a pair at 0.8 shares 64 on average, and fewer than 45 with a probability under 1e-6.
SHARED = 45
ODD = np.random.default_rng(5).integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Shingle sets of a candidate group meet in blocks of about so many sets and so many shingles.
SET_BLOCK, SET_SHINGLES = 512, 500_000
#: Sets of a group of several blocks that meet all others first.
LEADERS = 64
#: Id tables up to so many rows are broadcast to spare a shuffle of the texts; their rows are counted first.
BROADCAST_ROWS = 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _shingles(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles, in pieces; none of a text without words, one of a text of fewer words than a shingle."""
    parts = _words(text)
    width = min(words, len(parts))
    grams = map(b" ".join, zip(*(parts[i:] for i in range(width)), strict=False))
    while len(h := np.fromiter(map(xxhash.xxh64_intdigest, islice(grams, PIECE), repeat(42)), dtype=np.uint64)):
        yield h


def shingle_set(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit numbers, each mixed from the hashes of its words in order."""
    parts = _words(text)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts), dtype=np.uint64, count=len(parts))
    width = min(words, len(parts))
    if not width:
        return hashes
    with np.errstate(over="ignore"):
        out = np.full(len(parts) - width + 1, np.uint64(width), dtype=np.uint64)
        for i in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : len(parts) - width + 1 + i]
    return np.unique(_mixed(out))


def fingerprint(text: str | None, words: int = 3) -> bytes:
    """8 big-endian bytes; a bit is 1 if it is set in over half of the shingles' hashes. A text without words gives zeros.

    A-Z are lower-cased, words are runs without ASCII white space, a text of fewer words than a shingle is one shingle, repeated
    shingles count each time. Texts are hashed in pieces.
    """
    total, counts = 0, np.zeros(64, dtype=np.int64)
    for h in _shingles(text, words):
        total += len(h)
        bits = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        for at in range(0, len(bits), 255):  # 255 ones still fit into a byte
            counts += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(counts * 2 > total).tobytes()


def sampled_print(shingles: np.ndarray) -> bytes:
    """POSITIONS bytes: byte p is of the fingerprint of a sample of one shingle, the one that multiplier p makes smallest.

    Two sets agree in a byte with a probability of their Jaccard similarity (and 1/256 of the rest), whatever the position.
    """
    if not len(shingles):
        return bytes(POSITIONS)
    with np.errstate(over="ignore"):
        least = np.min([(shingles[at : at + 1024] * ODD[:, None]).min(axis=1) for at in range(0, len(shingles), 1024)], axis=0)
    return _mixed(least).astype(np.uint8).tobytes()


def _read(docs: DataFrame, keep: tuple[str, ...], one: Callable[[str | None], tuple], names: str) -> DataFrame:
    """The columns `keep` of each row of docs (text may be null: no words), and those that one(text) gives."""
    new = [x.split()[0] for x in names.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [one(t if isinstance(t, str) else None) for t in b["text"]]
            yield b.drop(columns="text").assign(**{n: [x[i] for x in found] for i, n in enumerate(new)})

    small_batches(docs.sparkSession)
    slim = docs.select(*keep, F.col("text").cast("string").alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields if f.name != "text")
    return slim.mapInPandas(run, f"{kinds}, {names}")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, node) of each row of docs: the fingerprint, and the same bytes as a number."""

    def one(text: str | None) -> tuple[bytes, int]:
        fp = fingerprint(text, words)
        return fp, int.from_bytes(fp, "big", signed=True)

    return _read(docs, ("doc_id",), one, "fp binary, node long")


def sketches(docs: DataFrame, words: int, keep: tuple[str, ...]) -> DataFrame:
    """The columns `keep`; k1 and k2, a 128-bit hash of the set of shingles; n, its size; fp, its sampled print."""

    def one(text: str | None) -> tuple[int, int, int, bytes]:
        s = shingle_set(text, words)
        k1, k2 = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype=np.int64)
        return int(k1), int(k2), len(s), sampled_print(s)

    return _read(docs, keep, one, "k1 long, k2 long, n long, fp binary")


def planes() -> list[tuple[int, ...]]:
    """The 14 four-sets of byte positions whose numbers cancel under exclusive or: any three positions lie in exactly one of them,
    and what such a set leaves is one of them too. So if three bytes or fewer differ, some set agrees in all four."""
    return [s for s in combinations(range(BYTES), 4) if s[0] ^ s[1] ^ s[2] ^ s[3] == 0]


def runs() -> list[tuple[int, ...]]:
    """The positions of a sampled print, dealt to its lists in order."""
    return [tuple(range(LIST_BYTES * k, LIST_BYTES * (k + 1))) for k in range(LISTS)]


def _postings(nodes: DataFrame, sets: list[tuple[int, ...]]) -> DataFrame:
    """(key, node) for each set of positions: the set's number, then the bytes there."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 2000):
                part = b.iloc[at : at + 2000]
                x = np.frombuffer(b"".join(part["fp"]), dtype=np.uint8).reshape(len(part), -1).astype(np.int64)
                keys = np.empty((len(sets), len(part)), dtype=np.int64)
                for n, s in enumerate(sets):
                    k = np.full(len(part), n, dtype=np.int64)
                    for i in s:
                        k = (k << 8) | x[:, i]
                    keys[n] = k
                yield pd.DataFrame({"key": keys.ravel(), "node": np.tile(part["node"].to_numpy(), len(sets))})

    return nodes.select("node", "fp").mapInPandas(run, "key long, node long")


Near = Callable[[np.ndarray, np.ndarray], np.ndarray]


def near_bits(min_matches: int, max_bits: int) -> Near:
    """Which rows of bytes agree with one in at least min_matches positions and then differ in at most max_bits bits."""

    def near(one: np.ndarray, rest: np.ndarray) -> np.ndarray:
        hit = (rest == one).sum(axis=1) >= min_matches
        if hit.any():
            hit[hit] = np.bitwise_count(rest[hit] ^ one).sum(axis=1) <= max_bits
        return hit

    return near


def near_bytes(min_matches: int) -> Near:
    """Which rows of bytes agree with one in at least min_matches positions."""
    return lambda one, rest: (rest == one).sum(axis=1) >= min_matches


def spanning(nodes: np.ndarray, x: np.ndarray, *levels: Near) -> list[tuple[int, int]]:
    """Links of a spanning forest of the rows of x (bytes) that are near by the last of `levels`; links by earlier levels come first.

    Each cluster is reached once on a level, so n rows give fewer than n links however many pairs are near.
    """
    out: list[tuple[int, int]] = []
    own = np.arange(len(nodes))
    for near in levels:
        left = np.ones(len(nodes), dtype=bool)
        for start in range(len(nodes)):
            if not left[start]:
                continue
            ahead = np.flatnonzero(own == own[start]).tolist()
            left[ahead] = False
            while ahead and left.any():
                f = ahead.pop()
                rest = np.flatnonzero(left)
                for g in rest[near(x[f], x[rest])]:
                    if left[g]:
                        out.append((int(nodes[f]), int(nodes[g])))
                        mine = np.flatnonzero(own == own[g])
                        left[mine] = False
                        own[mine] = own[start]
                        ahead += mine.tolist()
    return out


def _linked(lists: DataFrame, forest: Callable[[pd.DataFrame], list[tuple[int, int]]]) -> DataFrame:
    """Links (a, b), those of forest(rows), inside the runs of equal (key, i, j), leaders (if there are any) first; a run is at most
    two blocks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            ids = b[["key", "i", "j"]].to_numpy()
            starts = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]).any(axis=1)])
            rest = b.iloc[starts[-1] :]
            yield links(b.iloc[: starts[-1]], starts[:-1])
        if rest is not None:
            yield links(rest, np.zeros(1, dtype=np.int64))

    def links(b: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out: list[tuple[int, int]] = []
        for lo, hi in zip(starts, [*starts[1:], len(b)], strict=True) if len(b) else ():
            if hi - lo > 1:
                out += forest(b.iloc[lo:hi])
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    order = [F.desc("lead")] if "lead" in lists.columns else []
    return lists.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", *order).mapInPandas(run, "a long, b long")


def _blocks(lists: DataFrame, of: Column) -> DataFrame:
    """lists (key, node, ...) with blocks i <= j: each key's rows are cut into `of` blocks, of which each pair (i, j) comes together."""
    lists = lists.withColumn("of", of.cast("int"))
    lists = lists.withColumn("own", F.pmod(F.xxhash64("node"), F.col("of")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    return lists.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("of", "own", "other")


def _bytes(prints: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(prints), dtype=np.uint8).reshape(len(prints), -1)


def near_links(nodes: DataFrame, sets: list[tuple[int, ...]], *levels: Near) -> DataFrame:
    """Links (a, b) that span the same components as all pairs of nodes (node, fp; both distinct) that share a list of the index and are
    near by the last of `levels`.

    Lists of one entry go; longer ones are joined with the fingerprints. Their sizes are counted before rows meet, and a list over
    BLOCK entries is cut into blocks, of which each pair meets in one task. Within a list the shared positional bytes of a pair are
    tallied, and only pairs with enough of them go on.
    """
    tasks = max(1, nodes.count() * len(sets) // TASK_ENTRIES)
    entries = _postings(nodes.repartition(tasks), sets)
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    lists = entries.join(sizes, "key").join(nodes.select("node", "fp"), "node")
    cut = _blocks(lists.select("key", "node", "fp", "size"), F.ceil(F.col("size") / F.lit(BLOCK))).select("key", "i", "j", "node", "fp")
    return _linked(cut, lambda b: spanning(b["node"].to_numpy(), _bytes(b["fp"]), *levels))


def alike(nodes: np.ndarray, sets: list[np.ndarray], similarity: float, lead: int | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest of the sets (sorted, distinct) in which the Jaccard similarity of a pair is at least `similarity`.

    lead: only the first so many sets look for others; all do by default.
    """
    out: list[tuple[int, int]] = []
    lead = len(sets) if lead is None else lead
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    left, mark = np.ones(len(sets), dtype=bool), np.zeros(len(values), dtype=bool)
    for start in range(lead):
        if not left[start]:
            continue
        ahead, left[start] = [start], False
        while ahead:
            f = ahead.pop()
            mark[own[f]] = True
            both = np.bincount(owner[mark[flat]], minlength=len(sets))
            mark[own[f]] = False
            near = np.flatnonzero(left & (both / np.maximum(1, sizes + sizes[f] - both) >= similarity))
            if near.size:
                out.extend((int(nodes[f]), int(nodes[g])) for g in near)
                ahead.extend(near[near < lead].tolist())
                left[near] = False
                still = left[owner]
                owner, flat = owner[still], flat[still]
    return out


def across(nodes: np.ndarray, parts: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], lead: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of similar sets of different parts, one of them a leader; pairs with under SHARED equal positional bytes are not looked at,
    and parts that a link has joined are one from then on."""
    out: list[tuple[int, int]] = []
    parts = parts.copy()
    for f in np.flatnonzero(lead):
        rest = np.flatnonzero(~lead & (parts != parts[f]))
        for g in rest[(prints[rest] == prints[f]).sum(axis=1) >= SHARED]:
            if parts[g] != parts[f]:
                both = len(np.intersect1d(sets[f], sets[g], assume_unique=True))
                if both >= similarity * (len(sets[f]) + len(sets[g]) - both):
                    out.append((int(nodes[f]), int(nodes[g])))
                    parts[parts == parts[g]] = parts[f]
    return out


def _arrays(column: pd.Series) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype=np.uint64) for b in column]


def verified(wanted: DataFrame, words: int, similarity: float) -> DataFrame:
    """Links (a, b) that span the same components as all pairs inside a candidate group whose shingle sets are that similar.

    wanted: (node, root, fp, text) of groups of two or more. A group of one block is compared in one task. In a larger one, LEADERS of its
    sets, picked by hash, meet all others, a block a task; what they link is one part. Then the sets outside of the largest part
    meet all others in pairs of blocks, but only pairs of different parts count. So a hub and its thousands of copies are compared once.
    """

    def one(text: str | None) -> tuple[int, bytes]:
        s = shingle_set(text, words)
        return len(s), s.tobytes()

    sets = written(_read(wanted, ("node", "root", "fp"), one, "n long, shingles binary").withColumnRenamed("root", "key"), "sets")
    sizes = sets.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / SET_BLOCK, F.sum("n") / SET_SHINGLES)).cast("int").alias("of"))
    many = written(sizes.where("of > 1"), "many")
    zero = F.lit(0)
    whole = sets.join(sizes.where("of <= 1"), "key", "left_semi").select("key", zero.alias("i"), zero.alias("j"), "node", "shingles")
    links = _linked(whole, lambda b: alike(b["node"].to_numpy(), _arrays(b["shingles"]), similarity))
    if many.isEmpty():
        return links
    hot = written(sets.join(many, "key"), "hot")
    digest = F.xxhash64(F.lit("leader"), "node")
    leaders = hot.groupBy("key", F.pmod(digest, F.lit(LEADERS)).alias("p")).agg(F.min_by("node", digest).alias("node")).select("key", "node")
    marked = hot.join(leaders.withColumn("lead", F.lit(True)), ["key", "node"], "left").withColumn("lead", F.coalesce("lead", F.lit(False)))
    every = F.sequence(zero, F.col("of") - 1)
    own = F.pmod(F.xxhash64("node"), F.col("of")).cast("int")
    dealt = marked.withColumn("i", F.explode(F.when(F.col("lead"), every).otherwise(F.array(own)))).withColumn("j", zero)
    led = _linked(dealt.select("key", "i", "j", "lead", "node", "shingles"), lambda b: alike(b["node"].to_numpy(), _arrays(b["shingles"]), similarity, int(b["lead"].sum())))
    led = written(led, "led")
    parted = hot.join(connected(led).withColumnRenamed("root", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    counts = parted.groupBy("key", "part").agg(F.count("*").alias("n"))
    main = counts.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), (F.sum("n") - F.max("n")).alias("out")).where("out > 0")
    both = written(parted.join(main, "key"), "parted")
    cut = F.ceil(F.col("out") / SET_BLOCK).cast("int")
    kept = ("key", "i", "j", "lead", "node", "part", "fp", "shingles")
    outside = both.where("part <> main").withColumn("i", F.pmod(F.xxhash64("node"), cut).cast("int")).withColumn("j", F.explode(every)).withColumn("lead", F.lit(True))
    others = both.withColumn("i", F.explode(F.sequence(zero, cut - 1))).withColumn("j", own).withColumn("lead", F.lit(False))

    def crossed(b: pd.DataFrame) -> list[tuple[int, int]]:
        return across(b["node"].to_numpy(), b["part"].to_numpy(), _bytes(b["fp"]), _arrays(b["shingles"]), b["lead"].to_numpy(dtype=bool), similarity)

    return links.union(led).union(_linked(outside.select(*kept).union(others.select(*kept)), crossed))


def _first(columns: list[str]) -> Column:
    """The smallest of the columns, nulls last."""
    return F.min(F.struct(*[x for c in columns for x in (F.col(c).isNull().alias(f"no_{c}"), F.col(c))])).alias("first")


def firsts_of(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, first): the smallest `first` of each node's component; nodes without a component have their own."""
    rooted = nodes.select("node", "first").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    firsts = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("node", "root").join(firsts, "root").select("node", "first")


def components(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of docs: 64-bit fingerprints, linked where at most max_bits (3 or fewer) differ.

    At least 8 - max_bits positional bytes of a linked pair agree; the index finds every such pair (see planes). Equal fingerprints
    are one node, whatever their number. component_id is the smallest doc_id reachable (null ids count last; null if there is no other).
    Null and empty texts have the fingerprint zero and link like others; repeated rows stay; an empty table gives no rows.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees its matches for 0 to 3 differing bits")
    prints = written(fingerprints(docs, words), "prints")
    nodes = written(prints.groupBy("node").agg(F.first("fp").alias("fp"), _first(["doc_id"])), "nodes")
    links = near_links(nodes, planes(), near_bits(BYTES - max_bits, max_bits))
    labelled = prints.join(firsts_of(nodes, connected(links)), "node")
    return labelled.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def _sent(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if it has at most BROADCAST_ROWS rows; a larger table is joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs, of whose near-duplicate groups one document stays: the smallest doc_id (nulls last, then by a hash of the row).

    Groups are the components of pairs whose sets of distinct five-word shingles have a Jaccard similarity of at least `similarity`, each
    verified. Candidates share a list of the index over sampled prints and at least SHARED of their 80 positional bytes. Equal sets
    are one node. Rows equal in all columns are one document. Columns and types stay as they are, whatever their names; null texts are empty, and texts
    without words are one group.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    p = free(docs)
    marked = docs.withColumn(f"{p}row", F.xxhash64(*columns))
    slim = marked.select(F.col("doc_id").alias("doc_id"), F.col(f"{p}row").alias("row"), "text")
    prints = written(sketches(slim, words, ("doc_id", "row")), "prints")
    nodes = prints.groupBy("k1", "k2").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.count("*").alias("copies"), _first(["doc_id", "row"]))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    indexed = nodes.where("n > 0").select("node", "fp")
    near = written(connected(near_links(indexed, runs(), near_bytes(64), near_bytes(SHARED))), "near")
    wanted = nodes.join(near, "node").select(F.col("first.doc_id").alias(f"{p}id"), F.col("first.row").alias(f"{p}of"), "node", "root", "fp")
    mine = F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}row") == F.col(f"{p}of"))
    texts = marked.select("doc_id", f"{p}row", "text").join(_sent(written(wanted, "wanted")), mine).groupBy("node", "root", "fp").agg(F.first("text").alias("text"))
    roots = connected(verified(texts, words, similarity))
    grouped = firsts_of(nodes, roots).join(nodes.where("copies > 1").select("node", F.lit(True).alias("several")).unionByName(
        roots.select("node", F.lit(True).alias("several"))).distinct(), "node", "left_semi")
    touched = nodes.select("node", "k1", "k2").join(grouped, "node").select("k1", "k2", "first")
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))
    met = written(prints.select("doc_id", "row", "k1", "k2").join(touched, ["k1", "k2"]).select(F.col("doc_id").alias(f"{p}id"), F.col("row").alias(f"{p}of"), own.alias("stays")), "met")
    gone = written(met.where("not stays").select(f"{p}id", f"{p}of").distinct(), "gone")
    twice = written(met.where("stays").groupBy(f"{p}id", f"{p}of").agg(F.count("*").alias("n")).where("n > 1").select(f"{p}id", f"{p}of"), "twice")
    kept = marked.join(_sent(gone), mine, "left_anti")
    if twice.isEmpty():
        return kept.select(*columns)
    sent = _sent(twice)
    same = Window.partitionBy("doc_id", f"{p}row").orderBy(f"{p}row")
    again = kept.join(sent, mine, "left_semi").withColumn(f"{p}copy", F.row_number().over(same)).where(F.col(f"{p}copy") == 1).drop(f"{p}copy")
    return kept.join(sent, mine, "left_anti").unionByName(again).select(*columns)
