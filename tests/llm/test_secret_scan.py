"""Secret scans against brute force: windows recounted one by one, base spans by plain patterns."""

import math
import random
import re
from collections import Counter
from hashlib import sha256

import pytest

from tickloom.llm import catalog, secret_scan

SF = "/root/testdata/sf0.001"
KEY = "Zk8Qw3Rt9Yp2Lm6Vx1Bn4Hs7"


def brute_base(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def brute_windows(run, window, bits):
    places = set()
    for i in range(len(run) - window + 1):
        h = sum(-n / window * math.log2(n / window) for n in Counter(run[i : i + window]).values())
        if h >= bits - 1e-6:
            places |= set(range(i, i + window))
    out = []
    for p in sorted(places):
        if out and out[-1][1] == p:
            out[-1][1] = p + 1
        else:
            out.append([p, p + 1])
    return [tuple(x) for x in out]


def joined(spans):
    """Touching spans as one, as unions of places are."""
    out = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


@pytest.mark.parametrize("cls", range(len(secret_scan.CLASSES)))
def test_incremental_counts_equal_recounting(cls):
    _, chars, window, bits = secret_scan.CLASSES[cls]
    pool = [c for c in map(chr, range(33, 127)) if re.fullmatch(f"[{chars}]", c)]
    rng = random.Random(cls)
    for _ in range(150):
        run = "".join(rng.choice(pool[: rng.choice([2, 8, 99])]) for _ in range(rng.choice([window, 30, 90])))
        run += "".join(rng.choice(pool) for _ in range(rng.randrange(60)))
        assert joined(secret_scan.dense_windows(run, window, bits)) == brute_windows(run, window, bits)


def test_base_spans_equal_plain_patterns():
    rng = random.Random(5)
    parts = ["password", "PassWD", "toKen", "api_key", "apikey", "secret", "AKIA", "AKIAAKIA", "ABCDEF0123456789", "ſecret=abcdefgh", "toKen=abcdefgh", "=", ":", " ", "  ", '"', "'", "abcdef", "abcdef0123456789abcdef01", "0" * 23, "x.y-z_1", "\n", "é", "a", "AKIA" + "Q" * 15]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 14)))
        assert secret_scan.base_spans(text) == brute_base(text)


def spans(text):
    return secret_scan.added_spans(text, secret_scan.base_spans(text))


@pytest.mark.parametrize("secret", [KEY, "9f86d081884C7d659a2feaa0c55ad015a3bf4f1b", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYzT3kQ5vB8a", "Q7H2K9M4X1Z8W3V6T5R0P2N4", "gX3_kP9-zR7_mW2-qT5_vB8-"])
def test_added(secret):
    found = spans(f"note é {secret} end")
    assert found and all(7 <= s < e <= 7 + len(secret) for _, s, e in found)
    assert sum(e - s for _, s, e in found) >= 0.7 * len(secret)


@pytest.mark.parametrize(
    "text",
    [
        "id 123e4567-e89b-12d3-a456-426614174000 end",
        "commit 9F86D081884C7D659A2FEAA0C55AD015A3BF4F1B",
        f"see https://example.org/files/{KEY}/x",
        "getElementsByTagNameFromDocumentBody",
        "this_is_a_long_snake_case_identifier_name",
        "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJ",
        "Donaudampfschifffahrtsgesellschaftskapitän",
        "call 0049-30-12345678-901234567",
        f"YOUR_KEY_your-{KEY}-EXAMPLE",
        f"data:image/png;base64,{KEY * 30}",
    ],
)
def test_left_alone(text):
    assert spans(text) == []


def test_added_spans_lie_in_no_base_span():
    text = f"token={KEY} and {KEY}"
    assert [(k, text[s:e]) for k, s, e in spans(text)] == [("entropy_base64", KEY)]


def test_table(spark):
    long = f"word {KEY} " * 20000 + "password = " + "aB3" * 4000
    texts = [None, "", "token: abcdefg", f"x {KEY}", f"x {KEY}", long, "z" * 300000, "password" + " " * 100000]
    rows = [(i, t, "own") for i, t in enumerate(texts)] + [(None, "AKIA" + "Z9" * 8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r["doc_id"]: r for r in secret_scan.find_secrets(docs, ["doc_id", "spans"]).collect()}
    assert len(got) == len(rows)
    empty = sha256(b"").hexdigest()
    assert all((got[i]["n_assign"], got[i]["base_sha256"], got[i]["spans"]) == (0, empty, "") for i in (0, 1, 6, 7))
    assert got[3]["spans"] == got[4]["spans"] == f"entropy_base64:2:{2 + len(KEY)}" and got[3]["spans_in"] == "own"
    assert got[2]["spans"] == "assign:0:14" and got[2]["base_sha256"] == sha256(b"assign:0:14").hexdigest()
    assert got[None]["n_access"] == 1 and got[None]["spans_in"] is None
    assert got[5]["spans"].count("entropy_base64") == 20000 and got[5]["spans"].endswith(f"assign:{20000 * (6 + len(KEY))}:{len(long)}")
    assert secret_scan.find_secrets(docs.limit(0), ["doc_id"]).count() == 0


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = catalog.QUERIES["op13_secret_scan"](spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute_base(docs[r["doc_id"]])
        count = Counter(k for k, _, _ in base)
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (count["assign"], count["access"], count["hex"])
        assert r["base_sha256"] == sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))
