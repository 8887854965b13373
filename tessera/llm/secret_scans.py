"""Secret scans: fixed patterns, and windows of high entropy in candidate strings.

Patterns find assignments, access keys and long hex strings. The method adds
candidate strings (runs of token characters of 20 and more) in which some window
of 20 characters has a Shannon entropy, for the character class of the string (hex,
alphanumeric, base64), over that class's threshold. Entropy slides along by the counts
that change: one character comes, one goes. Candidates on the allow-list (words, numbers, hyphenated
names, paths, UUIDs) and such that lie as a whole within one pattern's span are
suppressed; one that only overlaps a span is reported whole. Spans of patterns always stay.

Null and empty texts have no spans. Rows that repeat stay. Offsets are code points, the
end is exclusive. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The patterns and least lengths of the three kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+", re.ASCII)
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]{24,}", re.ASCII)  # all of a run, or the run is too short
KINDS = ("assign", "access", "hex")

WINDOW = 20
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}", re.ASCII)
#: (class, its characters, bits per character that a window must exceed)
CLASSES = (
    ("hex", re.compile(r"[0-9A-Fa-f]+", re.ASCII), 3.0),
    ("alnum", re.compile(r"[A-Za-z0-9]+", re.ASCII), 3.6),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+", re.ASCII), 3.7),
)
#: Candidates that fully match one of these are no secrets: words, numbers, hyphenated names, paths, UUIDs.
ALLOWED = (
    re.compile(r"[A-Za-z]+"),
    re.compile(r"[0-9]+"),
    re.compile(r"[A-Za-z]+([-_/=][A-Za-z]+|[-_/=][0-9]{1,4})+[-_/=]*"),
    re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),
    re.compile(r"[-_=+/]+"),
)

_XLOGX = [0.0] + [n * math.log2(n) for n in range(1, WINDOW + 1)]


def top_entropy(text: str, window: int = WINDOW) -> float:
    """The highest Shannon entropy, in bits per character, of any ``window`` consecutive characters."""
    xlogx = _XLOGX if window == WINDOW else [0.0] + [n * math.log2(n) for n in range(1, window + 1)]
    counts: dict[str, int] = {}
    total = least = 0.0  # the sum of n log n over the counts
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += xlogx[n + 1] - xlogx[n]
        counts[c] = n + 1
        if i >= window - 1:
            least = total if i == window - 1 else min(least, total)
            old = text[i - window + 1]
            n = counts[old]
            total += xlogx[n - 1] - xlogx[n]
            counts[old] = n - 1
    return math.log2(window) - least / window if len(text) >= window else 0.0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns, by start and then kind as listed."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


def entropy_spans(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates of high entropy that no span of ``taken``, which is in order, contains: one sweep over both."""
    out, at, furthest = [], 0, 0
    for m in CANDIDATE.finditer(text):
        # of the spans that begin no later, that which ends last contains the candidate, or none does
        while at < len(taken) and taken[at][0] <= m.start():
            furthest = max(furthest, taken[at][1])
            at += 1
        s = m[0]
        if m.end() <= furthest or any(p.fullmatch(s) for p in ALLOWED):
            continue
        least = next(bits for _, chars, bits in CLASSES if chars.fullmatch(s))
        if top_entropy(s) > least:
            out.append((m.start(), m.end(), "entropy"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


SPANS = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {k: i for i, k in enumerate((*KINDS, "entropy"))}
    for batch in batches:
        cols: list[list] = [[] for _ in range(6)]
        for text in batch.column("text").to_pylist():
            base = base_spans(text) if text else []
            more = entropy_spans(text, base) if text else []
            every = sorted([*base, *more], key=lambda s: (s[0], order[s[2]]))
            counts = [sum(s[2] == k for s in every) for k in order]
            for col, v in zip(cols, [*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)], strict=True):
                col.append(v)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])


def secrets(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text), with the spans of all its secrets as ``kind:start:end``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanned, SPANS)
