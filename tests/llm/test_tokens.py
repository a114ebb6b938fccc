"""Token ids in files against the tokenizer itself, and the boundaries' codes against plain arrays."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pingframe.llm import tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.tokenizer_path())
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 0]


@given(st.lists(st.integers(0, 10**12), max_size=700), st.data())
@settings(max_examples=60, deadline=None)
def test_boundaries_come_back(numbers, data):
    x = np.sort(np.array(numbers, np.int64))
    code = tokens.EliasFano.from_bytes(tokens.EliasFano.of(x).to_bytes())
    assert (code.numbers() == x).all()
    a = data.draw(st.integers(0, len(x)))
    b = data.draw(st.integers(a, len(x)))
    assert (code.numbers(a, b) == x[a:b]).all()


def test_boundaries_are_small():
    x = np.cumsum(np.random.default_rng(1).integers(0, 2000, 20_000))
    assert len(tokens.EliasFano.of(x).to_bytes()) * 8 / len(x) < 2 + np.log2(1000) + 32 / tokens.SAMPLE + 1


def test_pieces_are_the_tokenizers(plain):
    """Cut and joined texts have the ids of the whole text, whatever white space, marks and letters meet."""
    rng = random.Random(1)
    parts = ["a", "b", "Z", " ", " ", "\n", "\n", "\t", "\r", "'", "'s", "'re", ".", "(", "1", "é", "é", " ", " ", "᠎", "​", "\x85", "\x1c", "\x00", "日", "😀", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(20_000)]
    texts += [None, "", " ", "x" * 5000, "don't we'll", "one.\nTwo (three)\n\nfour"]
    got = tokens.Encoder(tokens.tokenizer_path()).encode(pa.array(texts))
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [plain(t) for t in texts]


@given(st.lists(st.text(max_size=30), max_size=8))
@settings(max_examples=150, deadline=None)
def test_any_text_has_the_tokenizers_ids(plain, texts):
    got = tokens._encoder(tokens.tokenizer_path()).encode(pa.array(texts, pa.string()))
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [plain(t) for t in texts]


def test_kept_pieces_are_bounded(monkeypatch, plain):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    e = tokens.Encoder(tokens.tokenizer_path())
    texts = [f"w{i} v{i % 7}" for i in range(400)]
    for _ in range(2):
        for k in range(0, 400, 20):
            assert [np.frombuffer(g, "<u2").tolist() for g in e.encode(pa.array(texts[k : k + 20]))] == [plain(t) for t in texts[k : k + 20]]
    assert len(e._young) <= 110 and len(e._old) <= 110


def by_plain_encoding(rows, plain):
    out, at = [], 0
    for doc, text in rows:
        ids = plain(text)
        out.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("file_bytes", [tokens.FILE_BYTES, 50_000])
def test_whole_table(spark, plain, file_bytes):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = by_plain_encoding(sorted((r["doc_id"], r["text"]) for r in docs.collect()), plain)
    got = tokens.reported(docs, file_bytes=file_bytes, span_docs=17)
    assert sorted(tuple(r) for r in got.collect()) == want


def test_odd_rows(spark, plain):
    """Null and repeated ids, equal rows, null, empty and long texts, clashing columns; every place is taken once."""
    rows = [(3, "b c"), (3, "b c"), (3, "other"), (None, "x y"), (None, None), (-5, ""), (2**62, None), (1, "word " * 20_000), (0, "\n\n  \t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("ids", "key", "row", "start", "file", "path", "n_tokens"):
        docs = docs.withColumn(c, F.lit("x"))
    got = [tuple(r) for r in tokens.reported(docs, span_docs=2).collect()]
    assert sorted((d, n, c) for d, _, n, c in got if d is not None) == sorted((d, n, c) for d, _, n, c in by_plain_encoding(rows, plain) if d is not None)
    assert sorted((n, c) for d, _, n, c in got if d is None) == sorted((n, c) for d, _, n, c in by_plain_encoding(rows, plain) if d is None)
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == np.append(0, np.cumsum([r[2] for r in got]))[:-1].tolist()
    assert [r[0] for r in got] == sorted([r[0] for r in got if r[0] is not None]) + [None] * 2
    assert tokens.reported(docs.where("false")).collect() == []


def test_ids_are_read_back(spark, plain):
    docs = spark.createDataFrame([(i, f"text {i} of some\nwords") for i in range(50)], "doc_id long, text string")
    from pingframe.plans.tables import shared_dir

    files = tokens.written_files(docs, f"{shared_dir(spark)}/read-back", file_bytes=100)
    assert files.count() > 1
    got = {r["doc_id"]: np.frombuffer(r["ids"], "<u2").tolist() for r in tokens.read_documents(files, 7).collect()}
    assert got == {i: plain(f"text {i} of some\nwords") for i in range(50)}
    one = files.orderBy("file").first()
    with tokens.Reader(one["path"]) as r:
        a, b = r.bounds(1, 2)
        assert r.ids(int(a), int(b)).tolist() == plain(f"text {r.doc_ids(1, 2)[0]} of some\nwords")


def test_other_files_are_refused(tmp_path):
    path = tmp_path / "x.tok"
    path.write_bytes(b"no such file" * 20)
    with pytest.raises(ValueError, match="no file of token ids"):
        tokens.Reader(str(path))
