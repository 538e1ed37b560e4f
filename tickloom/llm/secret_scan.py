"""Secrets by sliding-window entropy.

Patterns find the base spans, which stay. Every other long run of secret-like characters is a candidate: within each
character class a window slides over it, counts change by one character at either end, and the sum of n log2 n, in
integers, changes with them. Windows whose Shannon entropy reaches the class's threshold are joined to spans, unless
the allow-list knows what they are. A text is read once where it lies; nothing is shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

BASE = ("assign", "access", "hex")
#: Class, its characters, window and least entropy in bits; a class's span is of the kind entropy_<class>.
CLASSES = (
    ("hex", "0-9a-fA-F", 24, 3.0),
    ("upper", "A-Z0-9", 20, 3.6),
    ("base64", "A-Za-z0-9+/", 20, 3.8),
    ("url", "A-Za-z0-9_-", 20, 3.8),
)
KINDS = (*BASE, *(f"entropy_{c}" for c, *_ in CLASSES))
#: Entropies are compared as whole numbers of this fraction of a bit, so that no rounding builds up along a string.
UNIT = 1 << 20
#: Characters before a candidate in which the allow-list looks for what it is.
CONTEXT = 48
#: Characters on both sides of a dense span in which a placeholder's words count.
AROUND = 16
#: Texts of a batch that are decoded together.
SLICE = 64

# The contract's base patterns.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")

# Candidates and the allow-list.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
KNOWN_FORMS = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}|[0-9]+(?:[-/_+=][0-9]+)*")
PLACEHOLDERS = re.compile(r"example|sample|dummy|placeholder|changeme|change_me|your[_-]|redacted|x{6}|0{8}|1234567", re.IGNORECASE)
KNOWN_BEFORE = re.compile(
    r"(?:sha-?[0-9]{1,3}|md5|crc|commit|checksum|digest|hash|fingerprint|etag|revision|integrity|uuid|guid|isbn|data:[\w/+.-]{1,30};base64)[^A-Za-z0-9]{0,6}$",
    re.IGNORECASE | re.ASCII,
)
ADDRESS_BEFORE = re.compile(r"(?:://|www\.)[^\s\"'<>]*$")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

_TABLES = {w: [0, *(round(UNIT * n * math.log2(n)) for n in range(1, w + 1))] for w in {w for _, _, w, _ in CLASSES}}
_RUNS = {c: re.compile(f"[{chars}]{{{w},}}") for c, chars, w, _ in CLASSES}


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base kinds, by start, then kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], BASE.index(x[0])))


def dense_windows(run: str, window: int, bits: float) -> list[tuple[int, int]]:
    """Unions of the windows of ``run`` whose entropy is at least ``bits``.

    H = log2(w) - sum(n log2 n) / w over the counts n in a window of w characters. The sum moves by two table entries
    for each character that enters or leaves.
    """
    table = _TABLES[window]
    most = math.floor(UNIT * window * (math.log2(window) - bits)) + window // 2 + 1  # what rounding of the table adds at most
    counts: dict[str, int] = {}
    total, out = 0, []
    for i, c in enumerate(run):
        if i >= window:
            gone = run[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += table[n - 1] - table[n]
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += table[n + 1] - table[n]
        if i >= window - 1 and total <= most:
            start = i - window + 1
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((start, i + 1))
    return out


def known(value: str, before: str) -> bool:
    """Whether a whole candidate has the form of something harmless, or the text before it says that it is."""
    return bool(KNOWN_FORMS.fullmatch(value) or KNOWN_BEFORE.search(before) or ADDRESS_BEFORE.search(before))


def plain(candidate: str, start: int, end: int, cls: str) -> bool:
    """Whether the dense span candidate[start:end] is a placeholder, an alphabet, a number or made of words."""
    value = candidate[start:end]
    steps = [ord(b) - ord(a) for a, b in zip(value, value[1:], strict=False)]
    if PLACEHOLDERS.search(candidate, max(0, start - AROUND), end + AROUND) or sum(s in (-1, 0, 1) for s in steps) * 2 > len(steps):
        return True
    digits, lower, upper = (any(f(c) for c in value) for f in (str.isdigit, str.islower, str.isupper))
    if digits + lower + upper < 2 or cls == "hex" and not digits:
        return True
    words = _WORD.findall(value)  # names in camel case, snake case or paths: words of some letters, few other characters
    letters = sum(map(len, words))
    return letters >= 4 * len(words) and 10 * letters >= 8 * len(value) and sum(map(str.isdigit, value)) <= 3


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of dense windows that lie in no base span and in no other added one, by start."""
    found = []
    for m in CANDIDATE.finditer(text):
        value, at = m.group(), m.start()
        if known(value, text[max(0, at - CONTEXT) : at]):
            continue
        for i, (cls, _, window, bits) in enumerate(CLASSES):
            for run in _RUNS[cls].finditer(value):
                for s, e in dense_windows(run.group(), window, bits):
                    if not plain(value, run.start() + s, run.start() + e, cls):
                        found.append((at + run.start() + s, -(at + run.start() + e), i))
    out, i, reach = [], 0, 0  # reach: the furthest end of the base spans and kept ones that start no later
    for start, end, cls in sorted(found):
        while i < len(base) and base[i][1] <= start:
            reach = max(reach, base[i][2])
            i += 1
        if -end > reach:
            out.append((f"entropy_{CLASSES[cls][0]}", start, -end))
            reach = -end
    return out


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]))))


def find_secrets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs(text, ...).

    Spans are kind:start:end in code points, by start, then by kind in the order of KINDS. Base spans are never dropped,
    added ones lie in no base span. Null and empty texts have none and the hash of nothing; repeated rows get equal
    results; empty tables give empty results. Whole texts are read, whatever their length. A kept column with the name
    of a result is returned as <name>_in.
    """
    results = [*(f"n_{k}" for k in BASE), "base_sha256", "spans"]
    kinds = dict(docs.select(*keep).dtypes)
    kept = {c: f"{c}_in" if c in results else c for c in keep}
    names = [*kept.values(), *results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):
                batch = whole.slice(first, SLICE)
                numbers, hashes, spans = [], [], []
                for text in batch.column("text").to_pylist():
                    base = base_spans(text or "")
                    numbers.append([sum(k == b for k, _, _ in base) for b in BASE])
                    hashes.append(sha256(written(base).encode()).hexdigest())
                    spans.append(written(base + added_spans(text or "", base)))
                counts = [pa.array(list(c), pa.int64()) for c in zip(*numbers, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *counts, pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names)

    schema = [f"`{kept[c]}` {kinds[c]}" for c in keep] + [f"n_{k} long" for k in BASE] + ["base_sha256 string", "spans string"]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join(schema))
