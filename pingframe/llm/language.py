"""Language identification by compression: the language whose raw-content zstandard dictionary makes a text smallest."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pingframe.llm._shared import crc32, small_batches

#: Dictionaries are made from at most so many rows a language (smallest hashes), and hold so many bytes.
SAMPLE_ROWS, DICTIONARY_BYTES = 400, 96 << 10
#: A row gives pieces of about this many bytes, spread over its whole text; all rows of a language give the same number of bytes at most.
SAMPLE_PIECE = 120
#: More languages than this are refused: each has a dictionary and a compressor in every task, about 0.6 MB.
MOST_LANGUAGES = 500
#: Texts are compressed in pieces of this many bytes, so that a dictionary helps all of a long text, not its beginning alone.
PIECE = 4096
LEVEL = 9
#: The best language must be smaller than the next by this share, or `rejected` is true.
MARGIN = 0.005
#: ASCII characters that are no letters become spaces.
_LETTERS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))


def letters(text: str) -> bytes:
    """The lower-cased words of a text, joined by single spaces: case, marks and numbers say nothing about its language."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS).split())


def pieces(raw: bytes, most: int, seed: int) -> bytes:
    """At most `most` bytes of raw: all of it, or whole words in pieces from even shares of it, each from a seeded place in its share."""
    if len(raw) <= most:
        return raw
    n = max(1, most // SAMPLE_PIECE)
    wide, share = most // n, len(raw) / n
    out = []
    for i in range(n):
        seed = (seed * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        at = int(i * share + (seed >> 33) % max(1, int(share - wide) + 1))
        words = raw[at : at + wide].split(b" ")
        out += words[1:-1] if len(words) > 2 else words  # the words at both ends may be cut
    return b" ".join(out)[:most]


class Compressors:
    """One compressor a language; made in the task that uses them."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.languages = sorted(dictionaries)
        self.vocabularies = [frozenset(dictionaries[x].split()) for x in self.languages]
        raw = [zstandard.ZstdCompressionDict(dictionaries[x], dict_type=zstandard.DICT_TYPE_RAWCONTENT) for x in self.languages]
        for d in raw:
            d.precompute_compress(level=LEVEL)
        self.by_language = [zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for d in raw]

    def sizes(self, raw: bytes) -> list[int]:
        parts = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
        return [sum(len(c.compress(p)) for p in parts) for c in self.by_language]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the margin is narrow. Equal sizes go to the language that knows more of the words, then by name."""
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        raw = letters(text)
        sizes = self.sizes(raw)
        words = raw.split() if sizes.count(min(sizes)) > 1 else []
        order = sorted(range(len(sizes)), key=lambda i: (sizes[i], -sum(w in self.vocabularies[i] for w in words), self.languages[i]))
        best, second = sizes[order[0]], sizes[order[1]] if len(order) > 1 else 2 * sizes[order[0]]
        share = 1 - best / second
        return self.languages[order[0]], min(1.0, 0.5 + share / 2), share < MARGIN


def dictionaries(docs: DataFrame, rows: int = SAMPLE_ROWS, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """A dictionary for each lang value of the rows whose crc32(doc_id) mod 5 is not 0, cut from a bounded sample of their texts.

    A language's rows with the smallest hashes are taken; repeated rows count once. Each gives an equal share of the dictionary at
    most, in pieces from all over its text.
    """
    known = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "doc_id")
    known = known.where("lang is not null and doc_id is not null and length(text) > 0").where(crc32(F.col("doc_id").cast("string")) % 5 != 0)
    known = known.select("lang", "text", F.xxhash64(F.lit("lang"), "doc_id", "text").alias("h"))
    # hashes alone are ranked, in 64 parts of a language and then the best of these; only rows up to a language's last hash are fetched
    parts = known.select("lang", "h", F.pmod("h", F.lit(64)).alias("part")).distinct()
    for by in (["lang", "part"], ["lang"]):
        parts = parts.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("h"))).where(F.col("n") <= rows).drop("n")
    last = parts.groupBy("lang").agg(F.max("h").alias("last"), F.count("*").alias("rows")).limit(MOST_LANGUAGES + 1).collect()
    if len(last) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not last:
        return {}

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, hashes: pd.Series, shares: pd.Series) -> pd.Series:
        return pd.Series([pieces(letters(t), int(n), int(h) % (1 << 64)) for t, h, n in zip(texts, hashes, shares, strict=True)])

    limits = docs.sparkSession.createDataFrame([(r["lang"], r["last"], size // r["rows"]) for r in last], "lang string, last long, share long")
    sampled = known.join(F.broadcast(limits), "lang").where("h <= last")
    first = sampled.select("lang", "h", cut("text", "h", "share").alias("part")).groupBy("lang", "h").agg(F.first("part").alias("part"))
    own: dict[str, list[bytes]] = {}
    for r in sorted(first.collect()):
        own.setdefault(r["lang"], []).append(bytes(r["part"]))
    return {k: b" ".join(v)[:size] for k, v in own.items()}


def identified(docs: DataFrame, learned: dict[str, bytes] | None = None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) of each row of docs.

    Null texts and texts without a letter (a character that str.isalpha() takes; no digit, number sign or mark) are `und` with score 0. score is 0.5 for equal sizes and 1 if the best were nothing beside the
    next; rejected marks narrow margins, whose lang_pred is the best guess. Whole texts count. Without learned rows all are `und`.
    """
    learned = dictionaries(docs) if learned is None else learned
    small_batches(docs.sparkSession)
    ready: list[Compressors] = []

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        if not ready:
            ready.append(Compressors(learned))
        return pd.DataFrame([ready[0].predict(t if isinstance(t, str) else None) for t in texts], columns=["lang_pred", "score", "rejected"])

    held = F.coalesce(crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), predict(F.col("text").cast("string")).alias("p")).select("doc_id", "held_out", "p.*")
