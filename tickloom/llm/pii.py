"""Personal data and secrets by weak supervision.

Regular expressions find base spans, which stay, and looser candidates. Labelers of three sorts (form, gazetteer,
context) vote on every span. Expectation maximisation over the vote patterns of the whole corpus estimates how often
each labeler is right when it speaks: base spans are known to be personal, every kind has a prior of its own, and no
labeler is taken to be worse than chance, so that the two classes can't change places. A logistic span classifier over
hashed shapes, words before and votes is trained on the resulting probabilities and decides the candidates. Patterns
are counted in Spark: their counts, bounded by the number of patterns, and a bounded sample of spans reach the driver.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, discard, sliced

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "local_phone", "masked_email", "national_id", "person", "secret")
#: Probability from which the classifier adds a candidate.
THRESHOLD = 0.9
EM_STEPS, FIT_STEPS = 50, 300
#: Spans of each kind that the classifier is trained on at most, those with the least hash, and places of its features.
FIT_SPANS, PLACES = 2000, 4096

# The contract's base patterns, in forms that take linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Candidate patterns, gazetteers and cue words.
CANDIDATES = {
    "iban": re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", re.ASCII),
    "local_phone": re.compile(r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    "masked_email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(](?:at|AT|chez|arroba)[\])] ?[A-Za-z0-9-]++(?: ?(?:[\[(](?:dot|DOT|punkt|punto|point)[\])]|\.) ?[A-Za-z0-9-]++)+"),
    "national_id": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "person": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don|Monsieur|Madame)\.? [A-Z][a-z]{1,30}(?: [A-Z][a-z]{1,30})?\b", re.ASCII),
}
_SECRET_WORDS = "api_key api-key apikey access_key access-key secret token passwd password pwd bearer credential".split()
#: What follows such a word, and secrets that show their form.
ASSIGNED = re.compile(r"(?:api[_-]?key|access[_-]key|secret|token|passwd|password|pwd|bearer|credential)s?[\"']?(?: ?(?::=|=>|==|[:=]) ?| )[\"']?(?P<value>[A-Za-z0-9+/_.~-]{8,}+={0,2})", re.IGNORECASE | re.ASCII)
SHOWN = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+|[0-9a-f]{32,}+|[0-9A-F]{32,}+)\b|-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", re.ASCII)
#: Whatever another candidate pattern matches holds one of these.
GATE = re.compile(r"[0-9]{3}|[A-Z]{2}[0-9]{2}|[\[(](?:at|AT|chez|arroba)[\])]|\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra|Don|Monsieur|Madame)\b", re.ASCII)
#: Characters of an IBAN by country.
IBAN_LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 "
    "PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
).split()}
DOMAINS = frozenset(
    "app ar at au be biz br ca cat ch cl cloud cn co com cz de dev dk edu ee es eu fi fr gov gr hk hu id ie il in info int io ir is it jp ke kr lt lu lv mail me mil mx "
    "my name net ng nl no nz online org pe ph pl pro pt ro rs ru se sg shop si site sk th tr tv tw ua uk us vn xyz za".split()
)
GIVEN_NAMES = frozenset(
    "adam alan albert alejandro alex alice amanda amy ana andrea andreas andrew angela anna anne antonio barbara ben bernd brian carla carlos carmen caroline charles "
    "christian christine claire claudia daniel david diego dirk donald elena elizabeth emily emma eric eva felix fernando francis francisco frank frederic george gerhard "
    "hans heike helen henry ines isabel isabelle ivan jack jacques james jane javier jean jennifer jessica joachim john jorge jose joseph juan julia julie karen karl "
    "katharina kevin klaus laura laurent linda lisa louis lucia luis luc manuel marc margaret maria marie mark markus martin mary matthias michael michel miguel monika "
    "nancy nathalie nicolas olga pablo patricia patrick paul pedro peter petra philippe pierre rafael raul richard robert rosa ruth sabine samuel sandra sarah simon "
    "sofia sophie stefan stephanie steven susan sylvie thomas tim ursula victor walter werner william wolfgang".split()
)
CUES = re.compile(r"(?:phone|tel|call|mobile|fax|contact|mail|e-mail|email|write|reach|ssn|social|iban|account|konto|compte|cuenta|name|signed|dear|telefon|telefono)\W{0,3}(?:\w+\W{1,2})?$", re.IGNORECASE)
FALSE_CUES = re.compile(r"(?:order|invoice|isbn|version|page|item|total|serial|model|section|no|nr)\W{0,3}$", re.IGNORECASE)
SECRET_CUES = re.compile(r"(?:api[_-]?key|access[_-]key|secret|token|passwd|password|pwd|bearer|credential)s?\W{0,6}$", re.IGNORECASE | re.ASCII)
NO_SECRET_CUES = re.compile(r"(?:sha-?[0-9]{0,3}|md5|commit|checksum|digest|hash|uuid|etag|revision)\W{0,6}$", re.IGNORECASE | re.ASCII)
#: Characters read before a candidate for cues.
CONTEXT = 40
LABELERS = ("form", "gazetteer", "cue", "edges", "variety")


def _luhn(digits: str) -> bool:
    odd = sum(int(d) for d in digits[::-2])
    even = sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the four base kinds, in the order of BASE, then of start."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in _CHAIN.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            length = sum(map(len, parts[i : i + 4])) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts[i : i + 4]):
                out.append(("ip", start, start + length))
            start += length + 1
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "") if m.end() - m.start() < 40 else ""
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    at = text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 8 <= sum(map(str.isdigit, m.group())) <= 15:
            out.append(("phone", m.start(), m.end()))
        at = text.find("+", m.end() if m else at + 1)
    return out


def _iban_ok(value: str) -> bool:
    compact = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """Each labeler's vote on a span: 1 personal, -1 not, 0 no opinion; edges and variety only speak against."""
    value, before = text[start:end], text[max(0, start - CONTEXT) : start]
    digits = [c for c in value if c.isdigit()]
    form, gazetteer = 0, 0
    if kind == "iban":
        form = 1 if _iban_ok(value) else -1
    elif kind == "national_id":
        form = -1 if value[:3] in ("000", "666") or value[0] == "9" or value[4:6] == "00" or value[7:] == "0000" else 1
    elif kind == "local_phone":
        form = 1 if digits[0] > "1" and digits[3] > "1" else -1
    elif kind in ("email", "masked_email"):
        gazetteer = 1 if re.split(r"[^A-Za-z]+", value.lower().rstrip(")] "))[-1] in DOMAINS else -1
    elif kind == "person":
        gazetteer = 1 if any(w.lower() in GIVEN_NAMES for w in value.split()) else -1
    elif kind == "secret":
        letters = any(c.isalpha() for c in value)
        form = 1 if value.startswith("-----") or (len(value) >= 16 and letters and digits) else -1
        gazetteer = 1 if re.match(r"AKIA|gh[pousr]_|eyJ|-----BEGIN", value) else 0
        cue = 1 if SECRET_CUES.search(before) else -1 if NO_SECRET_CUES.search(before) else 0
        edges = -1 if any(c.isalnum() or c in "_/" for c in text[start - 1 : start] + text[end : end + 1]) else 0
        return form, gazetteer, cue, edges, 0 if len(set(value)) >= 8 else -1
    elif kind in BASE:
        form = 1
    cue = 1 if CUES.search(before) else -1 if FALSE_CUES.search(before) else 0
    outside = text[start - 1 : start] + text[end : end + 1]
    edges = -1 if any(c.isalnum() or c in "_/=-" for c in outside) else 0
    variety = -1 if kind != "person" and len(digits) > 3 and len(set(digits)) < 3 else 0
    return form, gazetteer, cue, edges, variety


def _ibans(text: str) -> list[tuple[int, int]]:
    """Spans like an IBAN, without words after it that look like its groups; other lengths than the country's only beside those of the right one."""
    right, wrong, at = [], [], 0
    while m := CANDIDATES["iban"].search(text, at):
        start, end = m.span()
        length, end_of_length = IBAN_LENGTHS.get(text[start : start + 2]), 0
        for i in range(start, end):
            if text[i] != " ":
                end_of_length += 1
                if end_of_length == length and (i + 1 == end or text[i + 1] == " "):
                    right.append((start, i + 1))
                    break
        else:
            wrong.append((start, end))
            at = start + 1
            continue
        at = right[-1][1]
    starts = [s for s, _ in right]

    def free(start: int, end: int) -> bool:
        i = bisect_left(starts, end)
        return not i or right[i - 1][1] <= start

    return right + [span for span in wrong if free(*span)]


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the looser patterns that touch no span in ``taken`` nor an earlier candidate, in order of start."""
    matches = [("secret", m.span()) for m in SHOWN.finditer(text)]
    low = text.lower()
    if any(word in low for word in _SECRET_WORDS):
        matches += [("secret", m.span("value")) for m in ASSIGNED.finditer(text)]
    if GATE.search(text):
        matches += [(kind, m.span()) for kind, pattern in CANDIDATES.items() if kind != "iban" for m in pattern.finditer(text)]
        matches += [("iban", x) for x in _ibans(text)]
    found = sorted((start, -end, kind) for kind, (start, end) in matches)
    busy = sorted((s, e) for _, s, e in taken)
    out, i, free = [], 0, 0
    for start, end, kind in found:
        end = -end
        while i < len(busy) and busy[i][1] <= start:
            i += 1
        if start >= free and (i == len(busy) or busy[i][0] >= end):
            out.append((kind, start, end))
            free = end
    return out


def _signature(text: str, kind: str, start: int, end: int) -> str:
    return ",".join([kind, *map(str, votes(text, kind, start, end))])


def _shape(value: str) -> str:
    """Characters by class, runs of a class cut at four."""
    classes = "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in value)
    return re.sub(r"(.)\1{3,}", r"\1\1\1\1", classes)


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Places of a span's features: kind, votes, length, three-character pieces of its shape, and the two words before."""
    shape = f"<{_shape(text[start:end])}>"
    words = re.findall(r"\w+", text[max(0, start - CONTEXT) : start].lower())[-2:]
    named = [f"k{kind}", f"n{min(8, (end - start) // 4)}"]
    named += [f"v{kind}{j}{v}" for j, v in enumerate(votes(text, kind, start, end)) if v]
    named += [f"s{kind}{x}" for x in {shape[i : i + 3] for i in range(len(shape) - 2)}]
    named += [f"w{i}{w}" for i, w in enumerate(reversed(words))]
    return sorted({zlib.crc32(x.encode("utf-8", "replace")) % PLACES for x in named})


def spans_of(docs: DataFrame) -> DataFrame:
    """kind, signature, places (of features) and hash of every base span and candidate of all whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[list] = [[], [], [], []]
            for text in batch.column("text").to_pylist():
                if text:
                    base = base_spans(text)
                    for span in base + candidates(text, base):
                        around = text[max(0, span[1] - CONTEXT) : span[2] + CONTEXT]
                        of_span = zlib.crc32(around.encode("utf-8", "replace"))
                        for column, x in zip(out, (span[0], _signature(text, *span), features(text, *span), of_span), strict=True):
                            column.append(x)
            kinds = (pa.string(), pa.string(), pa.list_(pa.int32()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["kind", "signature", "places", "hash"])

    return docs.select("text").mapInArrow(run, "kind string, signature string, places array<int>, hash long")


def estimate(kinds: list[str], patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Probability that each vote pattern is personal data, by expectation maximisation over labeler reliabilities.

    A labeler's votes count by how often they are right in either class; silence says nothing. Base kinds stay at 1.
    """
    known = np.array([k in BASE for k in kinds])
    p = np.where(known, 1.0, 1 / (1 + np.exp(-1.5 * patterns.sum(axis=1))))
    names, which = np.unique(kinds, return_inverse=True)
    for _ in range(EM_STEPS):
        prior = (np.bincount(which, counts * p, len(names)) + 2) / (np.bincount(which, counts, len(names)) + 4)
        prior = np.clip(prior, 0.1, 0.9)[which]
        log_odds = np.log(prior / (1 - prior))
        for j in range(patterns.shape[1]):
            speaks = patterns[:, j] != 0
            right = lambda weight, v: np.clip((weight[patterns[:, j] == v].sum() + 8) / (weight[speaks].sum() + 10), 0.55, 0.98)  # noqa: B023, E731
            yes, no = right(counts * p, 1), right(counts * (1 - p), -1)
            log_odds += np.where(patterns[:, j] == 1, np.log(yes / (1 - no)), np.where(speaks, np.log((1 - yes) / no), 0))
        p = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(log_odds, -30, 30))))
    return p


def fit(places: list[list[int]], target: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on spans' places, by full steps scaled to each weight."""
    row, column = np.repeat(np.arange(len(places)), [*map(len, places)]), np.concatenate([*places, []]).astype(np.int64)
    w, total = np.zeros(PLACES), np.full(PLACES, 1e-8)
    for _ in range(FIT_STEPS):
        p = 1 / (1 + np.exp(-np.bincount(row, w[column], len(places))))
        step = np.bincount(column, (p - target)[row], PLACES) / len(places) + 1e-5 * w
        total += step * step
        w -= 0.3 * step / np.sqrt(total)
    return w


def train(docs: DataFrame) -> np.ndarray:
    """The span classifier's weights; zeros where there is no span."""
    spans = cut(spans_of(docs))
    counted = sorted(map(tuple, spans.groupBy("signature").count().collect()))
    if not counted:
        discard(spans)
        return np.zeros(PLACES)
    signatures, counts = [s.split(",") for s, _ in counted], np.array([n for _, n in counted], float)
    patterns = np.array([[*map(int, s[1:])] for s in signatures], float)
    p = dict(zip((s for s, _ in counted), estimate([s[0] for s in signatures], patterns, counts), strict=True))
    rows = []
    for kind in sorted({s[0] for s in signatures}):
        of_kind = spans.filter(F.col("kind") == kind).orderBy("hash", "signature", F.col("places").cast("string")).limit(FIT_SPANS)
        rows += of_kind.select("places", "signature").collect()
    discard(spans)
    return fit([r["places"] for r in rows], np.array([p[r["signature"]] for r in rows]))


def _written(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate((*BASE, *ADDED))}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1])))


def find_pii(docs: DataFrame, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """keep, counts of base spans, base_sha256 and all spans of every row of docs(text, ...).

    Spans are kind:start:end in code points, by kind in the order of BASE and ADDED, then by start. Null and empty
    texts have none, and the hash of nothing. Repeated rows get equal results. An empty table, or one without any
    span, adds nothing. Base spans are never dropped; added spans overlap neither them nor each other.
    """
    find = finder(docs, threshold)
    kinds = dict(docs.select(*keep).dtypes)
    names = [*keep, *(f"n_{k}" for k in BASE), "base_sha256", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            numbers, hashes, spans = [], [], []
            for text in batch.column("text").to_pylist():
                base, more = find(text or "")
                numbers.append([sum(k == b for k, _, _ in base) for b in BASE])
                hashes.append(sha256(_written(base).encode()).hexdigest())
                spans.append(_written(base + more))
            counts = [pa.array(list(c), pa.int64()) for c in zip(*numbers, strict=True)] or [pa.array([], pa.int64())] * len(BASE)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *counts, pa.array(hashes, pa.string()), pa.array(spans, pa.string())], names)

    schema = [f"`{c}` {kinds[c]}" for c in keep] + [f"n_{k} long" for k in BASE] + ["base_sha256 string", "spans string"]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join(schema))


def finder(docs: DataFrame, threshold: float = THRESHOLD) -> Callable[[str], tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """A function that gives a text's base spans and those that the classifier, trained on docs, adds."""
    weights = train(docs)
    odds = np.log(threshold / (1 - threshold))

    def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        base = base_spans(text)
        return base, [c for c in candidates(text, base) if weights[features(text, *c)].sum() >= odds]

    return find


def redact_all(docs: DataFrame, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """keep of every row of docs, its text redacted; null texts stay null.

    Spans are found and redacted in the same pass, so that a task has one Python worker, not one for each.
    """
    find = finder(docs, threshold)
    kinds = dict(docs.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts = [t if t is None else redact(t, _written(sum(find(t), []))) for t in batch.column("text").to_pylist()]
            columns = {c: batch.column(c) for c in keep} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in keep], keep)

    return docs.select(*keep).mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in keep))


def redact(text: str, spans: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, last = [], 0
    for start, end, kind in sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in spans.split(",") if x)):
        if end <= last:
            continue
        if start >= last:
            out += [text[last:start], f"<{kind}>"]
        last = max(last, end)
    return "".join([*out, text[last:]])
