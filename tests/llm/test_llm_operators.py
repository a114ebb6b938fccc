"""The training-data operators against brute force on small tables that hold nulls, empties, ties, repeats and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from pingframe.llm import language, leaks, licences, lines, mixing, neighbours, quality, secret, shards, simhash

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, seed=0, words=60):
    rng = np.random.default_rng(seed)
    return [" ".join(f"w{i}" for i in rng.integers(0, 5000, words)) for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, and columns named like results."""
    t = prose(6)
    long = " ".join(prose(1, 9, 40_000))
    rows = [(1, t[0], "en", "a", 1), (1, t[0], "en", "a", 1), (2, t[0], "en", None, 1), (3, None, "en", "a", None), (4, "", None, "b", 0), (None, t[1], "de", "b", 2), (None, None, None, None, None), (5, long, "de", "a", 9), (6, "one", "de", "c", 3), (7, " \t\n", "de", "c", 3), (8, t[2] + "\nA\nB\nC\nD", "fr", "c", 5), (9, "A\nB\nC\nD\nE", "fr", "c", 5), (1, t[3], "en", "a", 7)]
    df = spark.createDataFrame(rows, KINDS)
    for c in ("size", "shard", "node", "key", "score", "rank", "fingerprint", "h", "n_lines"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, prose(1)[0]), (2, "one"), (3, None), (None, "zzz yyy"), (12, "")], "item_id long, text string")


def slow_print(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def groups(prints, most):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= most:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def expected_components(rows):
    prints = [slow_print(t) for _, t in rows]
    g = groups(prints, 3)
    least = {}
    for (i, _), k in zip(rows, g):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    return sorted(((i, f"{p:016x}", least.get(k)) for (i, _), p, k in zip(rows, prints, g)), key=str)


def test_simhash_matches_brute_force(odd):
    want = expected_components([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert sorted((tuple(r) for r in simhash.components(odd).collect()), key=str) == want


def test_simhash_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = expected_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted((tuple(r) for r in simhash.components(docs).collect()), key=str) == want


def test_every_three_damaged_bytes_leave_a_list():
    from itertools import combinations

    sets = [set(s) for s in simhash.planes()]
    assert len(sets) == 14 and all(any(not s & set(d) for s in sets) for d in combinations(range(8), 3))


def test_spanning_links_hold_a_hot_list_together():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 256, 8, dtype=np.uint8)
    x = np.tile(base, (3000, 1))
    for row in x[1:]:
        row[rng.integers(0, 8)] ^= np.uint8(1 << rng.integers(0, 8))
    links = simhash.spanning(np.arange(3000), x, simhash.near_bits(5, 3))
    assert len(links) == 2999


def test_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 4)
    prints = [(i << 2) | j for i in range(1) for j in range(4)] + [0xFF << 40 | k for k in range(8)]
    rows = [(p - (1 << 64) if p >> 63 else p, p.to_bytes(8, "big")) for p in prints]
    nodes = spark.createDataFrame(rows, "node long, fp binary")
    got = simhash.connected(simhash.near_links(nodes, simhash.planes(), simhash.near_bits(5, 3))).groupBy("root").count().collect()
    assert sorted(r["count"] for r in got) == [4, 8]


def test_near_copies_go_and_others_stay(spark):
    a, b, c = prose(3, 4, 200)
    near = " ".join(w if i not in (50, 120) else "changed" for i, w in enumerate(a.split()))
    rows = [(5, a, "en", "s", 1), (2, near, "en", "s", 1), (9, a, "en", "s", 1), (7, b, "en", "s", 1), (7, b, "en", "s", 1), (None, c, None, None, None), (8, None, "en", "s", 1), (10, "", "en", "s", 1)]
    docs = spark.createDataFrame(rows, KINDS).withColumn("node", F.lit(1)).withColumn("row", F.lit(2))
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 7, 8, None]


def shared_words(similarity, n, seed):
    """Two texts of n distinct words, the later of which differ, so that their five-word shingles have about that Jaccard similarity or more."""
    grams = n - 4
    same = int(np.ceil(2 * similarity / (1 + similarity) * grams - 1e-9))
    words = [f"{seed}x{i}" for i in range(n)]
    return " ".join(words), " ".join(w if i < same + 4 else f"{w}y" for i, w in enumerate(words))


def jaccard(a, b, words=5):
    x, y = ({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} for w in (a.split(), b.split()))
    return len(x & y) / len(x | y)


def test_pairs_at_the_limit_go_and_pairs_below_stay(spark):
    rows = []
    for seed in range(300):
        for kind, similarity in ((0, 0.8), (1, 0.74)):
            pair = shared_words(similarity, 30 + seed, f"{seed}k{kind}")
            assert (jaccard(*pair) >= 0.8) == (kind == 0)
            rows += [(4 * seed + 2 * kind + i, t, "en", "s", 1) for i, t in enumerate(pair)]
    kept = {r["doc_id"] for r in simhash.deduplicated(spark.createDataFrame(rows, KINDS)).collect()}
    assert kept == {i for i, *_ in rows if i % 4 != 1}


def chained(n, seed, words=60):
    """Texts that each differ from a base in up to three words beside one place, and their components by exact similarity."""
    rng, base = np.random.default_rng(seed), prose(1, 21, words)[0].split()
    texts = [" ".join(f"c{k}" if k and abs(i - cut) < 1 + k % 3 else w for i, w in enumerate(base)) for k, cut in enumerate(rng.integers(0, words, n))]
    root = list(range(n))
    for _ in root:
        root = [min(root[j] for j in range(n) if jaccard(texts[i], texts[j]) >= 0.8) for i in range(n)]
    return texts, root


@pytest.mark.parametrize("block", [1000, 8])
def test_alike_links_the_pairs_that_brute_force_finds(spark, monkeypatch, block):
    """A group of one block, and one of several, whose leaders meet first and whose outsiders then meet all others."""
    monkeypatch.setattr(simhash, "SET_BLOCK", block)
    monkeypatch.setattr(simhash, "LEADERS", 3)
    texts, root = chained(60, 3)
    prints = [simhash.sampled_print(simhash.shingle_set(t)) for t in texts]
    wanted = spark.createDataFrame([(n, 0, p, t) for n, (p, t) in enumerate(zip(prints, texts, strict=True))], "node long, root long, fp binary, text string")
    got = dict(simhash.connected(simhash.verified(wanted, 5, 0.8)).collect())
    assert len(set(root)) > 1 and [got.get(n, n) for n in range(60)] == root


def test_dedup_matches_brute_force_on_the_given_table(spark):
    """Every pair of distinct shingle sets at 0.8 or more, by an index of all shingles; one text of each component stays."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sets: dict = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        k = min(5, len(w))
        sets.setdefault(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if k else frozenset(), []).append(r["doc_id"])
    keys, root = list(sets), list(range(len(sets)))
    for i, x in enumerate(keys):
        for j in range(i):
            if len(x & keys[j]) >= 0.8 * len(x | keys[j]) > 0:
                root = [root[j] if k == root[i] else k for k in root]
    best: dict = {}
    for x, k in zip(keys, root, strict=True):
        best[k] = min([*sets[x], *([best[k]] if k in best else [])])
    kept = simhash.deduplicated(spark.read.parquet(f"{SF}/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == sorted(best.values())


def test_quality_holds_out_and_scores_all(spark, odd, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.classified(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 10 and (held.predicted == held.quality).mean() > 0.85
    crc = [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]
    assert (got.held_out == crc).all()
    every = quality.classified(odd, labels).toPandas()
    assert len(every) == odd.count() and every.score.between(0, 1).all()


def test_quality_without_labels(odd, labels, empty):
    got = quality.classified(odd, labels.where("false")).toPandas()
    assert (got.score == 0.5).all() and (got.predicted == 1).all()
    assert quality.classified(empty, labels).count() == 0


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (3000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9 and model.pairs[0][:2] == (0, 1)


def test_rejected_documents_go(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and 0.6 < kept.count() / docs.count() < 1


def test_secret_spans():
    key, token = "AKIA" + "ABCDEFGH12345678", "9f" * 20
    text = f'é {key} token = "{token}" secret=short password: "longenough1" AKIASHORT'
    base = sorted(secret.base_spans(text))
    assert [(k, text[a:b]) for a, b, k in base] == [("access", key), ("assign", f'token = "{token}'), ("hex", token), ("assign", 'password: "longenough1')]
    assert secret.base_spans("secret=token:abcdefgh") == []
    assert secret.base_spans("TOKEN=abcdefgh ſecret=abcdefgh")[0][:2] == (0, 14) and len(secret.base_spans("TOKEN=abcdefgh ſecret=abcdefgh")) == 1


def test_entropy_windows_match_recount():
    import math

    rng = np.random.default_rng(3)
    run = "".join(rng.choice(list("aabbccddeeff0123456789"), 120))
    hits = set()
    for i in range(len(run) - secret.WINDOW + 1):
        w = run[i : i + secret.WINDOW]
        if -sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)) >= 3.4 - 1e-9:
            hits |= set(range(i, i + secret.WINDOW))
    assert {p for a, b in secret.high_windows(run, 3.4) for p in range(a, b)} == hits
    assert secret.entropy_spans("ordinary_words_joined_by_marks_only_here 0000000000000000000000000000") == []
    assert secret.entropy_spans("x k9Jq2LmZ8vRt4WyB7nXc5PdH1sGf3Aa0 y")[0][2] == "entropy_base64"


def slow_secrets(text):
    """(base spans, all spans) by the contract's patterns and by counting every window anew."""
    import math
    from collections import Counter

    import regex

    kinds = ["assign", "access", "hex", "entropy_hex", "entropy_base64"]
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = [(m.start(), m.end(), "assign") for m in regex.finditer(rf"""({words})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), "access") for m in regex.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), "hex") for m in regex.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base, spans, hexed = list(found), list(found), []
    for kind, chars, least in (("entropy_hex", "0-9a-fA-F", 3.0), ("entropy_base64", "A-Za-z0-9+/_=-", 4.1)):
        for m in regex.finditer(f"[{chars}]+", text):
            t = m[0]
            if len(t) < 24 or any(regex.fullmatch(p, t) for p in ("[a-z]+|[A-Z]+|[A-Z][a-z]+", "[0-9+/_=-]+", "([A-Za-z]+[+/_=-]+)+[A-Za-z]*", r"(.{1,8}?)\1{2,}.{0,8}")):
                continue
            covered: list = []
            barred = [x.span() for x in regex.finditer("example|sample|placeholder|changeme|xxxx|0000|1234567|abcdefgh", t, regex.I, overlapped=True)]
            for i in range(len(t) - 23):
                w = t[i : i + 24]
                if -sum(c / 24 * math.log2(c / 24) for c in Counter(w).values()) >= least - 1e-9 and not any(a < i + 24 and b > i for a, b in barred):
                    if covered and covered[-1][1] >= i:
                        covered[-1][1] = i + 24
                    else:
                        covered.append([i, i + 24])
            own = [(m.start() + a, m.start() + b) for a, b in covered]
            spans += [(a, b, kind) for a, b in own if not any(x <= a and b <= y for x, y in hexed)]
            hexed += own if kind == "entropy_hex" else []
    text_of = lambda x: ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(x, key=lambda s: (s[0], kinds.index(s[2]), s[1])))
    return text_of(base), text_of(spans), [sum(k == kind for _, _, k in base) for kind in kinds[:3]]


def test_secrets_match_brute_force(spark):
    rng = np.random.default_rng(8)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), int(n))) for n in rng.integers(20, 90, 40)]
    keys = ["".join(rng.choice(list("ABCDEFghijklmnop0123456789+/_-"), int(n))) for n in rng.integers(20, 90, 40)]
    made = [f"x {h[:20]}0000{h[20:]} y KEY={k.upper()} id_{h.upper()} {k}EXAMPLE{k} sécret token: {k} AKIA{h.upper()}" for h, k in zip(hexes, keys, strict=True)]
    given = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate([*given, *made, None, "", "a" * 50, "0" * 60])), "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    some = 0
    for r in secret.scanned(docs).collect():
        base, spans, counts = slow_secrets(texts[r["doc_id"]] or "")
        assert r["spans"] == spans and [r["n_assign"], r["n_access"], r["n_hex"]] == counts
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["n_entropy"] == spans.count("entropy_")
        some += r["n_entropy"] > 0
    assert some >= 40


def test_a_placeholder_spares_its_windows_only():
    left, right = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "7c4a8d09ca3762af61e59520943dc26494f8941b"
    spans = secret.entropy_spans(f"{left}0000{right}")
    assert [s[:2] for s in spans] == [(0, 40), (44, 84)]
    assert [k for *_, k in secret.entropy_spans(f"KEY={left.upper()}")] == ["entropy_hex"]


def test_secret_scan_edges(odd, empty):
    got = secret.scanned(odd).toPandas()
    assert len(got) == odd.count() and set(got.base_sha256) == {hashlib.sha256(b"").hexdigest()}
    assert secret.scanned(empty).count() == 0


def test_shards(odd, empty):
    got = shards.sharded(odd).toPandas()
    assert len(got) == odd.count() and (got["law"] == "key").all()
    for _, own in got.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert got.groupby(got.doc_id.fillna(-1)).shard.nunique().max() == 1
    assert ((got.grown_shard == got.shard) | (got.grown_shard == 24)).all()
    texts = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] not in (None, 1)}
    for r in got[got.doc_id.isin(list(texts))].itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
    assert shards.sharded(empty).count() == 0


def test_weights_and_growth(spark):
    ids = spark.range(6000).select(F.col("id"), shards.shard_of(F.col("id"), [1.0, 1.0, 2.0]).alias("a"), shards.shard_of(F.col("id"), [1.0, 1.0, 2.0, 1.0]).alias("b"))
    moved = ids.where("a <> b").select("b").distinct().collect()
    assert [r["b"] for r in moved] == [3]
    share = {r["a"]: r["count"] / 6000 for r in ids.groupBy("a").count().collect()}
    assert abs(share[2] - 0.5) < 0.03 and abs(share[0] - 0.25) < 0.03
    with pytest.raises(ValueError):
        shards.shard_of(F.col("id"), [0.0])


def slow_leaks(text, items):
    def split(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]

    w, hit, ids = split(text), set(), set()
    for i, t in items:
        x = split(t)
        n = min(10, len(x))
        for k in range(len(x) - n + 1) if n else ():
            for p in range(len(w) - n + 1):
                if w[p : p + n] == x[k : k + n]:
                    hit |= set(range(p, p + n))
                    ids.add("" if i is None else str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_leaks_match_brute_force(spark, odd, benchmark, empty):
    b = benchmark.collect()
    passage = " ".join(prose(1)[0].split()[20:45])
    extra = spark.createDataFrame([(50, f"Start, {passage.upper()}! end zzz... YYY one two", "en", "q", 1), (51, passage[:-3] + " é one-two", "en", "q", 1)], KINDS)
    docs = odd.select("doc_id", "text").where("length(text) < 5000 or text is null").unionByName(extra.select("doc_id", "text"))
    items = [(r["item_id"], r["text"]) for r in b]
    want = sorted(((r["doc_id"], *slow_leaks(r["text"], items)) for r in docs.collect()), key=str)
    assert sorted((tuple(r) for r in leaks.reported(docs, benchmark).collect()), key=str) == want
    assert sorted((tuple(r) for r in leaks.reported(docs, benchmark, block_bytes=40).collect()), key=str) == want  # a pass for each block
    found = leaks.searched(docs, benchmark, block_bytes=40).where("doc_id = 50").first()["__found"]
    assert max(m["length"] for m in found) == 25
    assert leaks.reported(empty, benchmark).count() == 0 and leaks.reported(odd, benchmark.where("false")).where("n_hit > 0").count() == 0
    clean = leaks.decontaminated(odd, benchmark)
    assert clean.columns == odd.columns and clean.where("doc_id = 6").count() == 0 and clean.where("doc_id = 9").count() == 1


def test_a_hot_passage_gives_one_match_a_document():
    """300 documents hold one passage of 200 words, which the item holds twice: a match a document and place, each of full length."""
    passage = " ".join(f"p{i}" for i in range(200))
    items = leaks.Items([1], [f"{passage} between {passage}"])
    docs = [leaks.numbers(f"start{i} {passage} end", items) for i in range(300)]
    found = list(leaks.matches(docs, items))
    assert sorted((row, word, k, length) for row, word, _, k, length in found) == [(i, 1, k, 200) for i in range(300) for k in (0, 201)]


def test_targets():
    got = mixing.targets([("b", 100), (None, 10), ("a", 100)])  # weights a 3, b 1, null 2
    assert got["a"] == pytest.approx(200) and got[None] == 20 and got["b"] == pytest.approx(95)
    assert mixing.targets([]) == {}
    assert mixing.targets([("a", 0)]) == {"a": 0}


@pytest.mark.parametrize("seed", range(6))
def test_chosen_is_nearest(seed):
    rng = np.random.default_rng(seed)
    lengths = np.unique(rng.integers(0, 40, 6))
    counts = rng.integers(1, 4, len(lengths))
    reach = {0}
    for n, c in zip(lengths, counts):
        reach = {s + k * int(n) for s in reach for k in range(c + 1)}
    for budget in (0, 1, 17, 60, int((lengths * counts).sum()) - 1, 10_000):
        take = mixing.chosen(lengths, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * lengths).sum()) == max(s for s in reach if s <= budget)


def test_chosen_beyond_the_fit():
    lengths, counts = np.arange(1, 2000), np.full(1999, 3)
    for budget in (100_001, 3_000_000):
        take = mixing.chosen(lengths, counts, budget)
        assert int((take * lengths).sum()) == budget and (take <= counts).all()


def test_mix_edges(odd, empty):
    got = mixing.mixed(odd, keep_source=True).toPandas()
    assert len(got) == odd.count() and (got.taken <= 2 * got["size"]).all() and (got.taken == got.copies * got["size"]).all()
    for _, own in got.groupby(got.source.fillna("~")):
        assert own.source_size.iloc[0] == own["size"].sum()
    again = mixing.mixed(odd, keep_source=True).toPandas()
    key = ["doc_id", "size", "source"]
    assert got.sort_values([*key, "taken"]).reset_index(drop=True).equals(again.sort_values([*key, "taken"]).reset_index(drop=True))
    assert mixing.mixed(empty).count() == 0
    drawn = mixing.drawn(odd)
    assert drawn.columns == odd.columns and drawn.count() == got.copies.sum()


def test_many_rows_of_one_null_id_are_drawn_as_often_as_the_mix_takes_them(spark):
    rows = [(None, f"one two {i}", "en", "a", 1) for i in range(300)] + [(i, "w " * (1 + i % 5), "en", "b" if i % 2 else "a", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, KINDS)
    taken = mixing.mixed(docs, keep_source=True).groupBy("source").agg(F.sum("taken").alias("n")).collect()
    words = mixing.drawn(docs).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " +"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in taken} == {r["source"]: r["n"] for r in words}
    assert mixing.drawn(docs).where("doc_id is null").groupBy("text").count().agg(F.max("count")).first()[0] <= 2


def slow_mix(rows):
    """Targets, and the most words that single copies of a source's documents reach below what its whole epochs leave."""
    sizes = {}
    for _, text, _, source, _ in rows:
        sizes.setdefault(source, []).append(len((text or "").split()))
    own = mixing.targets([(s, sum(v)) for s, v in sizes.items()])
    out = {}
    for source, lengths in sizes.items():
        whole = sum(lengths)
        epochs = min(2, int(own[source] // whole)) if whole else 0
        reach = {0}
        for n in lengths:
            reach |= {r + n for r in reach}
        left = round(own[source] - epochs * whole)
        out[source] = epochs * whole + (max(r for r in reach if r <= left) if epochs < 2 else 0)
    return out


def test_the_whole_mix_is_the_nearest_fit(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(n), "en", s, 1) for i, (n, s) in enumerate(zip(rng.integers(0, 60, 120), rng.choice(["a", "b", "c", "d"], 120), strict=True))] + [(500, None, "en", "b", 1), (501, "x y", "en", None, 1)]
    got = mixing.mixed(spark.createDataFrame(rows, KINDS), keep_source=True).toPandas()
    taken = {None if k == "~" else k: int(v) for k, v in got.groupby(got.source.fillna("~")).taken.sum().items()}
    assert taken == slow_mix(rows)


def test_mix_nears_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = mixing.mixed(docs, keep_source=True).toPandas()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), size=("source_size", "first"))
    assert per.target.sum() == pytest.approx(1.5 * per["size"].sum())
    assert ((per.taken - per.target).abs() <= 0.02 * per.target).all() and (per.taken <= per.target + 1).all()


def test_language(spark, odd, empty):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.identified(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() > 0.9
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    edges = language.identified(odd).toPandas()
    assert (edges.lang_pred[edges.doc_id.isin([3, 4, 7])] == "und").all() and edges.score.between(0, 1).all() and len(edges) == odd.count()
    assert language.identified(empty).count() == 0
    assert set(r["lang_pred"] for r in language.identified(odd, {}).collect()) == {"und"}


def test_language_is_the_smallest_compression(spark):
    """Every text of the given table: the sizes under each dictionary, recomputed with one compressor a call, give the prediction."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    learned = language.dictionaries(docs)
    assert set(learned) == {"de", "en", "es", "fr"} and all(0 < len(v) <= language.DICTIONARY_BYTES for v in learned.values())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language.identified(docs, learned).collect():
        words = "".join(c if c.isalpha() or ord(c) > 127 else " " for c in texts[r["doc_id"]].lower())
        raw = " ".join(words.split(" ")).encode()
        raw = b" ".join(raw.split())
        sizes = {}
        for k, v in learned.items():
            zd = zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            zd.precompute_compress(level=language.LEVEL)
            one = zstandard.ZstdCompressor(dict_data=zd, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[k] = sum(len(one.compress(raw[i : i + language.PIECE])) for i in range(0, len(raw), language.PIECE))
        best = sorted(sizes.values())
        assert sizes[r["lang_pred"]] == best[0] and r["score"] == pytest.approx(0.5 + (1 - best[0] / best[1]) / 2)
        assert r["rejected"] == (1 - best[0] / best[1] < language.MARGIN)


def test_texts_without_letters_are_undetermined(spark):
    texts = ["²", "½ ①", "Ⅷ", "12 345", "!?", "\t", "ß", "字"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identified(docs, {"en": b"the cat", "de": b"die katze"}).collect()}
    assert [got[i] == "und" for i in range(8)] == [True] * 6 + [False] * 2


def test_sample_pieces_come_from_all_of_a_text():
    raw = b" ".join(b"w%06d" % i for i in range(20_000))
    got = [int(w[1:]) for w in language.pieces(raw, 1200, 7).split()]
    assert got == sorted(got) and all(any(2000 * k <= g < 2000 * (k + 1) for g in got) for k in range(10))
    assert language.pieces(raw, 1200, 7) == language.pieces(raw, 1200, 7) != language.pieces(raw, 1200, 8)
    assert language.pieces(b"short text", 100, 1) == b"short text" and len(language.pieces(raw, 50, 1)) <= 50


def test_licences(spark, odd, empty):
    rows = [(1, "prose here\nReleased under the MIT License.\nmore"), (2, "LICENSED under the Apache-License, version 2.0"), (3, "Released under the BSD"), (4, None), (5, "This work is licensed under the GNU General Public License, version 2.")]
    got = {r["doc_id"]: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["licences"] == "MIT" and got[1]["n_licensed"] == 1 and got[1]["n_units"] == 4
    assert got[2]["best_licence"] == "Apache-2.0" and got[2]["best_score"] == 1.0
    assert got[3]["best_licence"] is None and got[4]["n_units"] == 0
    assert got[5]["best_licence"] == "GPL-2.0" and got[5]["licences"] == "GPL-2.0"
    assert licences.scanned(odd).count() == odd.count() and licences.scanned(empty).count() == 0


def test_wrapped_notices_are_passages(spark):
    """A whole licence over many lines, and a notice in the midst of one long line, are found as windows of words; cut ones are not."""
    mit = max((t for n, t in licences.TEMPLATES if n == "MIT"), key=len).split()
    isc = max((t for n, t in licences.TEMPLATES if n == "ISC"), key=len)
    other = " ".join(prose(1, 5, 300))
    wrapped = "\n * ".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    rows = [(1, f"{other}\n{wrapped}\n{other}"), (2, f"{other} {isc} {other} {isc}"), (3, f"{other} {' '.join(mit[:20])} {other}"), (4, other), (5, f"{other} This work is licensed under\nthe GNU General Public\nLicense, version 2. {other}")]
    got = {r["doc_id"]: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["licences"] == "MIT" and got[1]["best_score"] == 1.0 and got[1]["n_passages"] == 1 and got[1]["n_licensed"] == 0
    assert got[2]["licences"] == "ISC" and got[2]["n_passages"] == 2
    assert got[3]["licences"] == "" and got[4]["n_passages"] == 0
    assert got[5]["licences"] == got[5]["best_licence"] == "GPL-2.0"


GNU = "This {} is free software; you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
RIVALS = [
    (max((t for n, t in licences.TEMPLATES if n == "BSD-3-Clause"), key=len), "BSD-3-Clause"), (max((t for n, t in licences.TEMPLATES if n == "BSD-2-Clause"), key=len), "BSD-2-Clause"),
    (GNU.format("program", "", "2"), "GPL-2.0"), (GNU.format("program", "", "3"), "GPL-3.0"), (GNU.format("program", "Affero ", "3"), "AGPL-3.0"), (GNU.format("library", "Lesser ", "2.1"), "LGPL-2.1"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0"), ("This work is licensed under a Creative Commons Attribution 3.0 Unported License.", "CC-BY-3.0"),
    ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0"), ("This work is licensed under a Creative Commons Attribution 2.5 Generic License.", ""), (GNU.format("program", "", "1"), ""),
]


def test_rival_licences_are_told_apart(spark):
    """As lines, wrapped over lines and in prose; a version that no template has is not taken for another."""
    other = " ".join(prose(1, 5, 80))
    rows = [(3 * i + k, text) for i, (t, _) in enumerate(RIVALS) for k, text in enumerate((t, f"{other} {t} {other}", "\n".join([other, *[" ".join(t.split()[j : j + 7]) for j in range(0, len(t.split()), 7)], other])))]
    got = {r["doc_id"]: (r["licences"], r["best_licence"] or "") for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(i, g) for i, g in sorted(got.items()) if g != (RIVALS[i // 3][1],) * 2] == []


def test_licences_side_by_side_are_all_named(spark):
    """Notices that follow each other without a word between them."""
    longest = {n: t for n, t in sorted(licences.TEMPLATES, key=lambda x: len(x[1]))}
    names = ["MIT", "ISC", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0"]
    rows = [(0, " ".join(longest[n] for n in names)), (1, " ".join(longest[n] for n in names[::-1])), (2, "\n".join(longest[n] for n in names))]
    for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r["licences"] == ",".join(sorted(names)) and r["n_passages"] == len(names), r


def test_licence_scan_runs_no_python(spark, odd):
    plan = licences.scanned(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def slow_lines(rows):
    """rows: distinct (doc_id, text) in the order of the first occurrences."""
    seen, out = set(), {}
    for i, t in rows:
        own = (t or "").split("\n")
        gone = set()
        for k in range(len(own) - 2):
            w = tuple(own[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        out[(i, t)] = "\n".join(x for k, x in enumerate(own) if k not in gone), len(gone)
    return out


def test_lines_match_brute_force(spark, odd, empty):
    rows = [(3, "a\nb\nc\nd\ne"), (1, "x\na\nb\nc\ny"), (2, "b\nc\nd"), (4, "a\nb\nc\na\nb\nc"), (5, "a\nb"), (6, None), (7, ""), (8, "q\nq\nq\nq\nq\n"), (None, "b\nc\nd"), (4, "a\nb\nc\na\nb\nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_lines(sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)))
    got = lines.without_repeats(docs.withColumn("orig", F.col("text"))).collect()
    assert len(got) == len(rows)
    for r in got:
        text, gone = want[(r["doc_id"], r["orig"])]
        assert (r["text"] or "") == text and r["n_removed"] == gone
    assert lines.digest(odd).count() == odd.count() and lines.digest(empty).count() == 0


def test_hot_windows_go_like_others(spark, monkeypatch):
    """One window in all of 60 documents and others in two: broadcast or shuffled, the same lines go."""
    rows = [(i, f"own {i}\nhot a\nhot b\nhot c\nx {i // 2}\ny {i // 2}\nz {i // 2}\nend {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_lines(rows)
    for hot in (1, 10, 1000):
        monkeypatch.setattr(lines, "HOT", hot)
        got = lines.without_repeats(docs).collect()
        assert {(r["doc_id"], r["text"], r["n_removed"]) for r in got} == {(i, *want[(i, t)]) for i, t in rows}


def test_dealt_rows_lie_in_their_shards(spark, odd, tmp_path):
    docs = odd.drop("shard")
    shards.dealt(docs, str(tmp_path / "out"), 5)
    back = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted((str(r["doc_id"]), r["shard"], str(r["text"])) for r in df.collect())
    assert key(back) == key(docs.withColumn("shard", shards.shard_of(F.col("doc_id"), [1.0] * 5))) and set(back.columns) == set(odd.columns)


def test_neighbours_recall_and_edges(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 16))
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(5000 + i, [float(v) for v in x[7]]) for i in range(40)]
    rows += [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0] * 3), (None, [1.0] * 16), (100, rows[100][1]), (9400, [None] * 16)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(0)).withColumn("score", F.lit(0))
    got = neighbours.searched(table).toPandas()
    good = {i: np.array(v) for i, v in rows[:3040]}
    ids = np.array(sorted(good))
    m = np.stack([good[i] for i in ids])
    hit = total = 0
    queries = [i for i in ids if i % 100 == 0]
    assert set(got.query_id) == set(queries)
    for q in queries:
        d = np.sqrt(((m - good[q]) ** 2).sum(1))
        own = got[got.query_id == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 11)) and q not in set(own.vec_id)
        assert np.allclose(own.score, [d[ids == v][0] for v in own.vec_id], rtol=0, atol=0)
        assert list(zip(own.score, own.vec_id)) == sorted(zip(own.score, own.vec_id))
        best = [ids[k] for k in np.lexsort((ids, d)) if ids[k] != q][:10]
        hit, total = hit + len(set(best) & set(own.vec_id)), total + 10
    assert hit / total >= 0.9
    assert neighbours.searched(table.where("false")).count() == 0
    assert neighbours.searched(table.where("vec_id = 100")).count() == 0


def exact_neighbours(rows, k=10):
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = []
    for q in sorted({i for i in ids.tolist() if i % 100 == 0}):
        d = np.sqrt(((m - m[ids == q][0]) ** 2).sum(axis=1))
        best = [j for j in np.lexsort((ids, d)) if ids[j] != q][:k]
        out += [(q, n + 1, int(ids[j]), float(d[j])) for n, j in enumerate(best)]
    return out


@pytest.mark.parametrize("block", [1024, 2])
def test_far_queries_find_their_neighbours(spark, monkeypatch, block):
    """Every third query lies far from all the rest and meets nothing in its buckets: all rows serve it, in blocks of queries."""
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", block)
    x = np.random.default_rng(11).standard_normal((2000, 16))
    x[::300] *= 40
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    got = sorted(tuple(r) for r in neighbours.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    want = exact_neighbours(rows)
    assert len(got) == len(want) == 200
    assert [g for g in got if g[0] % 300 == 0] == [w for w in want if w[0] % 300 == 0]


def test_fewer_candidates_than_ranks(spark):
    """Seven vectors: a query gets all six others; float components give distances in double precision."""
    x = np.random.default_rng(4).standard_normal((7, 4)).astype(np.float32)
    rows = [(i * 50, [float(v) for v in r]) for i, r in enumerate(x)]
    got = sorted(tuple(r) for r in neighbours.searched(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == exact_neighbours(rows) and len(got) == 4 * 6


def test_neighbours_cut_hot_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(rng.standard_normal((400, 8)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(tuple(r) for r in neighbours.searched(table).collect())
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "QUERY_BLOCK", 2)
    assert sorted(tuple(r) for r in neighbours.searched(table).collect()) == whole


def shuffled_rows(spark):
    """Rows that all stages so far have written for shuffles."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    stages = store.stageList(None, False, False, none, None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_queries_are_not_copied_for_each_bucket(spark):
    """3,000 queries over 3,000 vectors: what is shuffled goes by vectors, queries and their ten best, not by the buckets visited."""
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(5).standard_normal((3000, 16)))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = set(shuffled_rows(spark))
    assert neighbours.searched(table, every=1).count() == 30_000
    assert sum(n for i, n in shuffled_rows(spark).items() if i not in before) < 150_000


def test_long_keys_and_many_blocks_give_the_same(spark, monkeypatch):
    """Queries whose keys fill several rows, in several blocks, over several blocks of candidates with copies; all pairs of a bucket, picked out or not."""
    x = np.random.default_rng(8).standard_normal((900, 12))
    x[500:520] = x[0]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    whole = sorted(tuple(r) for r in neighbours.searched(table, every=10).collect())
    for name, n in (("BLOCK", 100), ("QUERY_BLOCK", 2), ("KEYS", 3), ("PROBED", 7)):
        monkeypatch.setattr(neighbours, name, n)
    monkeypatch.setattr(neighbours.Buckets, "_likely", lambda self, rows, q, products, k: rows)
    assert sorted(tuple(r) for r in neighbours.searched(table, every=10).collect()) == whole and len(whole) == 900


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e25, 1e200])
@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_likely_candidates_hold_the_nearest(kind, scale):
    """Rough distances lose none of the nearest, far from the origin, near ties and where squares over- or underflow."""
    rng = np.random.default_rng(9)
    for far in (0, 100, 1e6):
        x = rng.standard_normal((500, 8)) + far
        x[100:150] = x[1] + 1e-9 * rng.standard_normal((50, 8))
        with np.errstate(over="ignore"):
            x = (x * scale).astype(kind)
        x = x[np.isfinite(x).all(axis=1)]
        if not len(x):
            continue
        held = neighbours.pa.RecordBatch.from_pydict({"ids": [[i] for i in range(len(x))], "v": neighbours.pa.array(x.tolist(), neighbours.pa.list_(neighbours.pa.from_numpy_dtype(kind)))})
        buckets = neighbours.Buckets(neighbours.Index(8, 2, 1.0), [held])
        for q in (x[1], x[7]):
            with np.errstate(over="ignore", invalid="ignore"):
                d = np.sqrt(((x.astype(np.float64) - q) ** 2).sum(axis=1))
                kept = set(buckets._likely(np.arange(len(x)), q, None, 10).tolist())
            assert set(np.lexsort((np.arange(len(x)), d))[:11].tolist()) <= kept
            assert scale != 1.0 or far or kind == np.float32 or len(kept) < 100


def test_probes_go_by_rising_cost():
    index = neighbours.Index(4, 3, 1.0)
    place = np.array([0.1, 0.5, 0.8])
    cells = index.visited(place, 27)
    assert len({tuple(c) for c in cells}) == 27
    off = [sum((place[i] - np.floor(place[i]) if c[i] < np.floor(place[i]) else 1 - place[i] + np.floor(place[i])) ** 2 for i in range(3) if c[i] != np.floor(place[i])) for c in cells]
    assert off == sorted(off)


def test_pipeline_stages(spark, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    kept = {r["doc_id"]: r for r in docs.collect()}
    seen = docs
    for name, stage in corpus_pipeline.STAGES:
        before, seen = seen, stage(spark, seen, SF)
        if name != "sharding":
            assert seen.columns == docs.columns
            seen = spark.createDataFrame(seen.collect(), docs.schema)
        if name in ("quality", "near_dedup", "decontamination"):
            assert 0 < seen.count() < before.count()
        if name == "near_dedup":
            assert seen.groupBy("text").count().where("count > 1").count() == 0
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in bench.collect()]
            assert not any(slow_leaks(r["text"], items)[4] for r in seen.collect())
    out = seen.toPandas()
    assert set(out.doc_id) <= set(kept) and out.groupby("doc_id").size().max() == 2
    run = corpus_pipeline.run(spark, SF).toPandas()
    order = ["doc_id", "slot"]
    pd.testing.assert_frame_equal(run.sort_values(order).reset_index(drop=True), out.sort_values(order).reset_index(drop=True))


def test_columns_of_any_name_stay(spark, labels):
    """Columns named like the operators' own ones, and like those that take their place, keep their values."""
    docs = spark.createDataFrame([(i, f"line a {i % 7}\nline b\nline c\nline d {' '.join(prose(1, i % 9))}", "a") for i in range(40)], "doc_id long, text string, source string")
    names = [f"{p}{c}" for p in ("__", "___") for c in "row id of copy source size rows sum long copies hash place bin n b start g0 th gone lines got words found k1 k2 h1 h2".split()]
    wide = spark.createDataFrame([(*r, *(f"keep {c} {r[0]}" for c in names)) for r in docs.collect()], ", ".join([docs.schema.simpleString()[7:-1].replace(":", " "), *(f"{c} string" for c in names)]))
    benchmark = spark.createDataFrame([(1, prose(1, 3)[0]), (1, prose(1, 3)[0])], "item_id long, text string")
    for f in (simhash.deduplicated, mixing.drawn, lines.without_repeats, lambda d: leaks.decontaminated(d, benchmark), lambda d: quality.accepted(d, labels)):
        got, plain = f(wide).collect(), f(docs).select("doc_id", "text").collect()
        assert sorted((r["doc_id"], r["text"]) for r in got) == sorted(map(tuple, plain)) and len(got)
        assert all(r[c] == f"keep {c} {r['doc_id']}" for r in got for c in names)


def test_shards_of_one_hot_key_are_numbered_in_bins(spark):
    docs = spark.createDataFrame([(None if i % 3 else i, f"text {i % 150}") for i in range(600)], "doc_id long, text string")
    rows = shards.sharded(docs).toPandas()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in rows.groupby("shard"))
    plan = shards.sharded(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"concat_ws\(:, slot.*text_crc32.*size", plan)


def test_vectors_of_every_length_are_searched(spark):
    """Each among those of its own length, the rare ones too."""
    rng = np.random.default_rng(11)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, rng.normal(size=5).tolist()) for i in range(30)] + [(5000, [1.0, 2.0])]
    got = neighbours.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=10, k=5).toPandas()
    short = {i: np.array(v) for i, v in rows if len(v) == 5}
    for q in (1000, 1010, 1020):
        want = sorted((float(np.sqrt(((short[q] - v) ** 2).sum())), i) for i, v in short.items() if i != q)[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own.vec_id.tolist() == [i for _, i in want] and np.allclose(own.score, [d for d, _ in want])
    assert set(got[got.query_id < 1000].vec_id) <= set(range(400)) and (got.query_id == 5000).sum() == 0 and got[got.query_id < 1000].query_id.nunique() == 40


def test_the_whole_pipeline_against_brute_force(spark, labels):
    """run() over the smallest tables: all pairs of shingle sets, all windows, all sums of lengths, and every shard's hash, one after the other."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = {r["doc_id"] for r in quality.accepted(docs, labels).collect()}
    rated = {r["doc_id"]: r["predicted"] for r in quality.classified(docs, labels).collect()}
    assert good == {i for i, p in rated.items() if p == 1} and 0 < len(good) < len(rated)
    rows = sorted((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs.collect() if r["doc_id"] in good)
    root = {r[0]: r[0] for r in rows}
    for k, a in enumerate(rows):
        for b in rows[:k]:
            if root[a[0]] != root[b[0]] and (a[1] == b[1] or jaccard(a[1], b[1]) >= 0.8):
                low, high = sorted((root[a[0]], root[b[0]]))
                root = {i: low if r == high else r for i, r in root.items()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r in rows if root[r[0]] == r[0] and not slow_leaks(r[1], items)[4]]
    got = corpus_pipeline.run(spark, SF).toPandas()
    assert set(got.doc_id) <= {r[0] for r in rows} and got.groupby("doc_id").size().max() <= 2
    of = {r[0]: r for r in rows}
    words = pd.Series([len(of[i][1].split()) for i in got.doc_id]).groupby([of[i][3] for i in got.doc_id]).sum().to_dict()
    assert words == {s: n for s, n in slow_mix(rows).items() if n}

    def value(i, n):
        u = (int(hashlib.md5(f"k{i}:{n}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -1 / np.log(u)

    assert got.shard.tolist() == [max(range(24), key=lambda n: value(i, n)) for i in got.doc_id]
    assert got.grown_shard.tolist() == [max(range(25), key=lambda n: value(i, n)) for i in got.doc_id]
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got["size"].tolist() == [len(of[i][1].encode()) + 8 for i in got.doc_id] and got.text_crc32.tolist() == [zlib.crc32(of[i][1].encode()) for i in got.doc_id]
