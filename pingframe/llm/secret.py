"""Secret scans: three fixed patterns, and windows of high Shannon entropy over candidate strings."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pingframe.llm._shared import small_batches

#: The base patterns, in the order of their kinds, and the least length of what has to be long.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
#: The classes of characters: a maximal stretch of one, of at least WINDOW characters, is a candidate string of that class, and its windows
#: count from so many bits of entropy a character.
WINDOW = 24
CLASSES = {"entropy_hex": (re.compile(r"[0-9a-fA-F]{%d,}" % WINDOW), 3.0), "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % WINDOW), 4.1)}
#: Candidates that are no secrets as a whole: words of one case, words joined by marks, numbers, repeated units.
ALLOWED = (
    re.compile(r"[a-z]+|[A-Z]+|[A-Z][a-z]+"),
    re.compile(r"[0-9+/_=-]+"),
    re.compile(r"(?:[A-Za-z]+[+/_=-]+)+[A-Za-z]*"),
    re.compile(r"(.{1,8}?)\1{2,}.{0,8}"),
)
#: Placeholders: windows that overlap one are no secrets, the rest of a candidate may be.
PLACEHOLDER = re.compile(r"(?=(example|sample|placeholder|changeme|xxxx|0000|1234567|abcdefgh))", re.IGNORECASE)
#: n * log2(n) for the counts that a window can have.
NLOGN = [0.0, *(n * math.log2(n) for n in range(1, WINDOW + 1))]
HINT = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)


def high_windows(run: str, least: float) -> list[tuple[int, int]]:
    """The merged [start, end) ranges of run's windows whose characters have at least `least` bits of Shannon entropy each and that
    overlap no placeholder.

    entropy = log2(W) - sum(c log2 c) / W; one count goes down and one up as the window moves, so a step costs the same at any length.
    """
    counts: dict[str, int] = {}
    total, out = 0.0, []
    barred = deque(m.span(1) for m in PLACEHOLDER.finditer(run))
    for i, c in enumerate(run):
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += NLOGN[n + 1] - NLOGN[n]
        if i >= WINDOW - 1:
            start = i - WINDOW + 1
            while barred and barred[0][1] <= start:
                barred.popleft()
            if math.log2(WINDOW) - total / WINDOW >= least - 1e-9 and not (barred and barred[0][0] <= i):
                if out and out[-1][1] >= start:
                    out[-1] = (out[-1][0], i + 1)
                else:
                    out.append((start, i + 1))
            gone = run[start]
            n = counts[gone]
            counts[gone] = n - 1
            total += NLOGN[n - 1] - NLOGN[n]
    return out


def entropy_spans(text: str) -> list[tuple[int, int, str]]:
    """The high windows of each class's candidates; a range inside one of hexadecimal digits is that range's already."""
    out: list[tuple[int, int, str]] = []
    for kind, (candidate, least) in CLASSES.items():
        starts, ends = [a for a, _, _ in out], [b for _, b, _ in out]
        for m in candidate.finditer(text):
            if not any(a.fullmatch(m[0]) for a in ALLOWED):
                for a, b in high_windows(m[0], least):
                    a, b = m.start() + a, m.start() + b
                    before = bisect_right(starts, a) - 1
                    if before < 0 or ends[before] < b:
                        out.append((a, b, kind))
    return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind; those too short are dropped after they have taken their characters."""
    out = []
    if HINT.search(text):
        out = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return out + [(*m.span(), "hex") for m in LONG_HEX.finditer(text)]


#: A maximal run of hexadecimal digits that is long enough is the same as a match of HEX that is.
LONG_HEX = re.compile(HEX.pattern[:-1] + "{%d,}" % HEX_LEAST)


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy) of each row of docs; offsets are code points, ends exclusive.

    Null texts are empty: no spans, and the digest of the empty string. Repeated rows stay. One pass over each text, no shuffle.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            t = t if isinstance(t, str) else ""
            base, more = base_spans(t), entropy_spans(t)
            n = [sum(k == kind for _, _, k in base) for kind in KINDS[:3]]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + more), len(more)))
        return pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return docs.select("doc_id", scan(F.col("text").cast("string")).alias("s")).select("doc_id", "s.*")
