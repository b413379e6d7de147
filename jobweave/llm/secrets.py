"""Operator 5: secret scans.

Patterns give the base spans.  The method adds spans by sliding-window Shannon
entropy: over each candidate string a window of ``WINDOW`` characters moves by
one; the counts of its characters, and with them the entropy, change in
constant time; runs of windows above the threshold of the string's character
class become a span, unless an allow-list pattern fits the candidate.  In a URL
the host after ``://`` is no candidate, unless it is a user before ``@`` or ``:``;
what follows the host is one.

Nulls and empty texts have no span.  Repeated rows give repeated rows.  A very
long text is scanned whole.  Spans of equal start are in the order of kinds.  An
empty table gives an empty one; further columns are not carried.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column, of_rows, slices, utf8

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character for windows of 20: a random hexadecimal string has 3.4 on average, base 64 4.1.
THRESHOLDS = {"hex": 3.0, "alphanumeric": 3.75, "base64": 3.85}
CLASSES = (("hex", re.compile(r"[0-9a-fA-F]+\Z")), ("alphanumeric", re.compile(r"[A-Za-z0-9]+\Z")), ("base64", re.compile(r"[A-Za-z0-9+/_=-]+\Z")))
#: Strings that look random and are no secrets.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",  # UUID
    r"(?i).*example.*",
    r"[0-9_+/=-]*",  # numbers, rules
    r"[A-Za-z_+/=-]*",  # words and paths without digits
    r"/?([a-z0-9._-]+/)+[a-z0-9._-]*",  # paths in small letters
    r"([A-Za-z]+[-_])+[A-Za-z]*[0-9]{0,4}",  # names with a number at the end
    r"sha(1|224|256|384|512)-[A-Za-z0-9+/=]+",  # integrity values
)


def entropy_runs(text: str, threshold: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Unions of the windows whose entropy is at least ``threshold``."""
    log = [0.0, 0.0, *(n * math.log2(n) for n in range(2, window + 1))]
    counts: dict[str, int] = {}
    total, runs = 0.0, []  # total: the sum of n log n over the counts
    for i, c in enumerate(text):
        n = counts.get(c, 0)
        total += log[n + 1] - log[n]
        counts[c] = n + 1
        if i >= window:
            n = counts[gone := text[i - window]]
            total += log[n - 1] - log[n]
            counts[gone] = n - 1
        if i >= window - 1 and math.log2(window) - total / window >= threshold - 1e-9:
            start = i - window + 1
            if runs and start <= runs[-1][1]:
                runs[-1] = (runs[-1][0], i + 1)
            else:
                runs.append((start, i + 1))
    return runs


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the patterns' matches."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    return sorted(found)


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """Where candidate strings begin, and they."""
    for m in CANDIDATE.finditer(text):
        start, word = m.start(), m.group()
        if word.startswith("//") and text[start - 1 : start] == ":":
            host, slash, rest = word[2:].partition("/")
            if slash:
                start, word = start + 3 + len(host), rest
            elif text[m.end() : m.end() + 1] in ("@", ":"):
                start, word = start + 2, host
            else:
                continue
            if len(word) < WINDOW:
                continue
        yield start, word


def added_spans(text: str, base: list[tuple[int, int, int]], allowed: re.Pattern) -> list[tuple[int, int, int]]:
    found = []
    for at, word in candidates(text):
        if allowed.fullmatch(word):
            continue
        kind = next(k for k, p in CLASSES if p.match(word))
        for start, end in entropy_runs(word, THRESHOLDS[kind]):
            start, end = start + at, end + at
            if not any(s <= start and end <= e for s, _, e in base):
                found.append((start, 3, end))
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a span: all that do, and few others."""

    def runs(of: bytes, least: int) -> np.ndarray:
        allowed = np.zeros(256, bool)
        allowed[list(of)] = True
        at, n = allowed[data], 1
        while n < least:
            step = min(n, least - n)
            at = at[:-step] & at[step:]
            n += step
        return np.flatnonzero(at)

    alnum = b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    places = [runs(b"0123456789abcdef", 16), runs(alnum + b"+/_=-", 20)]
    raw = data.tobytes()
    low = raw.lower()
    for where, words in ((low, KEYWORDS), (raw, (b"AKIA",))):
        for word in words:
            at, found = where.find(word), []
            while at >= 0:
                found.append(at)
                at = where.find(word, at + 1)
            places.append(np.array(found, np.int64))
    rows = np.searchsorted(offsets, np.concatenate(places), "right") - 1
    return np.unique(rows)


def scan(docs: DataFrame, allowed: tuple[str, ...] = ALLOWED) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permit = re.compile("|".join(f"(?:{p.removeprefix('(?i)')})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in allowed) or r"(?!)")
        none = hashlib.sha256(b"").hexdigest()
        for batch in slices(batches):
            n, text = batch.num_rows, column(batch, "text")
            counts, digests, spans = np.zeros((4, n), np.int64), [none] * n, [""] * n
            for i in _suspects(*utf8(text)).tolist():
                s = text[i].as_py()
                base = base_spans(s)
                every = sorted(base + added_spans(s, base, permit))
                for _, k, _ in every:
                    counts[k, i] += 1
                digests[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *map(pa.array, counts[:3]), pa.array(digests), pa.array(spans), pa.array(counts[3])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"])

    return of_rows(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")
