"""The trie of conversations against brute force over lists of turns."""

import random
import re
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from tickloom.llm import prefix_trie as op

SCHEMA = "conv_id long, turn long, role string, text string, depth int, digest string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            said = f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()
            own[conv].append(((turn is not None, turn or 0, sha256(said).digest()), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda y: y[0])] for c, v in own.items()}
    paths = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        paths[c] = tuple(own.get(c - c % 20, [])[:h] + mine[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, path in sorted(paths.items()):
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = defaultdict(int), defaultdict(int)
    for node in sorted(members, key=len, reverse=True):
        leaves[node] += node not in children
        saved[node] += (len(members[node]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        if node:
            leaves[node[:-1]] += leaves[node]
            saved[node[:-1]] += saved[node]
    out = []
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if paths[c] == node)
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children.get(node, ())), leaves[node], saved[node], sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in op.conversation_trie(df, **kw).select(*COLUMNS).collect()), key=str)


def test_random_conversations(spark):
    rng = random.Random(7)
    texts = [None, "", "one", "two words", "a\nb c", "é 日本"]
    rows = []
    for c in [*range(0, 70), 10**12, 10**12 + 7]:
        if c % 20 or rng.random() < 0.7:
            rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant", None]), rng.choice(texts)) for t in range(rng.choice([1, 2, 3, 6]))]
    rows += rows[:5] + [(None, 1, "user", "nobody's"), (3, 2, "user", "one"), (3, 2, "user", "two words")]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("block", [2, 3, 64])
def test_deep_conversations(spark, block):
    """Blocks change no result: chains of up to 150 turns that part at many depths."""
    rng = random.Random(block)
    rows = []
    for c in range(21, 33):
        n = rng.choice([1, 40, 90, 150])
        rows += [(c, t, "user", f"turn {t}" if t < rng.choice([5, 30, 149]) or rng.random() < 0.97 else "other") for t in range(n)]
    assert found(spark, rows, block=block) == brute(rows)


def test_copies_and_ends_over_many_runs(spark):
    rows = [(c, 0, "user", "hello there") for c in range(1, 30000, 3)] + [(40, 1, "user", "more")]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_one_turnless(spark):
    assert found(spark, []) == []
    turnless = next(c for c in range(1, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(turnless, 0, "user", "gone"), (turnless, 1, "user", "gone too")]
    assert found(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_long_texts_and_ambiguous_roles(spark):
    rows = [(1, 0, "a", "b"), (2, 0, "ab", ""), (5, 0, "", "ab"), (7, 0, "user", "word " * 300000), (8, 0, "user", "word " * 300000)]
    rows += [(c, t, "user", str(t)) for c in (1, 2, 5, 7, 8) for t in range(1, 4)]
    assert found(spark, rows) == brute(rows)
