"""The n-gram Jaccard join against brute force over all pairs."""

import random
import tracemalloc
from collections import Counter

import pyarrow as pa
import pytest

from tickloom.llm import jaccard_join

SCHEMA = "doc_id long, text string, n int, print string"


def brute(rows):
    sets = []
    for _, text, *_ in rows:
        words = [w.decode() for w in (text or "").encode().lower().split()]
        sets.append({tuple(words)} if 0 < len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, *_) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i), d)) for i, ((d, *_), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def found(spark, rows):
    out = jaccard_join.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def corpus(seed, words):
    rng = random.Random(seed)
    rows, number = [], 0
    for _ in range(25):
        base = [f"w{rng.randrange(words)}" for _ in range(rng.choice([1, 4, 5, 6, 8, 9, 11, 20, 40, 90, 200, 400]))]
        for _ in range(rng.choice([1, 1, 2, 3, 12])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.randrange(len(text) + 1)
                text[at : at + rng.choice([0, 1])] = [f"x{rng.randrange(9)}"] * rng.choice([0, 1])
            number += rng.choice([1, 1, 1, 0])  # ids come again, with other texts too
            rows.append((number, rng.choice([" ", "\n", "\t "]).join(text).upper() if rng.random() < 0.2 else " ".join(text), 1, "x"))
    return rows


@pytest.mark.parametrize(("seed", "words"), [(1, 5000), (2, 12)])
def test_equals_brute_force(spark, seed, words):
    extra = [(None, "a b c d e f g", 1, None), (900, None, None, None), (901, "", 1, ""), (902, " \t\n", 1, ""), (903, "a b c d e f g", 1, ""), (903, "a b c d e f g", 1, "")]
    rows = corpus(seed, words) + extra
    assert found(spark, rows) == brute(rows)


def test_chain_of_near_copies(spark):
    """Each text links with the next only, so that one component spans all of them."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100]), 0, "") for i in range(40)]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == []


def test_a_crowded_signature_group_loses_no_link(spark):
    """Forms share most shingles; three families differ enough not to link."""
    rng = random.Random(5)
    form = [f"f{i}" for i in range(120)]
    rows = []
    for i in range(90):
        text = form[: 120 - 40 * (i % 3 == 1)] + [f"t{i % 3}-{j}" for j in range(60)]
        text[rng.randrange(len(text))] = f"own{i}"
        rows.append((i, " ".join(text), 0, ""))
    assert found(spark, rows) == brute(rows)


def test_ids_do_not_decide_which_texts_are_the_same(spark):
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(words), " ".join(["x", "y", *words[2:]]), " ".join(["x", "y", *words[2:98], "p", "q"])]
    chain.append(" ".join(["x", "y", "z", "u", *words[4:98], "p", "q"]))
    schema = "doc_id long, text string"
    rows = [(1, chain[0]), (None, chain[1]), (3, chain[2])]
    assert brute([(i, t) for i, t in zip((1, 2, 3), chain)])[2][2] == 1
    far = " ".join(["a", "b", "c", "d", "e", "f", *words[6:94], "g", "h", "i", "j", "k", "l"])
    bridge = " ".join(["a", "b", "c", "d", "e", "f", *words[6:]])
    got = jaccard_join.jaccard_components(spark.createDataFrame([(1, " ".join(words)), (None, bridge), (3, far)], schema)).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (None, 1), (3, 1)}
    assert jaccard_join.jaccard_components(spark.createDataFrame(rows, schema)).select("component_id").distinct().count() == 1
    other = " ".join(f"v{i}" for i in range(50))
    lone = " ".join(f"u{i}" for i in range(50))
    rows = [(1, " ".join(words)), (None, bridge), (3, far), (3, other), (3, ""), (None, ""), (None, None), (None, lone), (None, lone), (4, None), (4, None)]
    kept = [tuple(r) for r in jaccard_join.one_of_each(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(kept, key=str) == sorted([(1, " ".join(words)), (3, other), (3, ""), (None, ""), (None, None), (None, lone), (4, None)], key=str)


def test_equal_texts_are_indexed_once_a_task(spark):
    one, two = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    docs = spark.createDataFrame([(i, one) for i in range(500)] + [(501, two)], "doc_id long, text string").repartition(2)
    none = (jaccard_join.np.empty(0, jaccard_join.np.uint64), jaccard_join.np.empty(0, jaccard_join.np.int64))
    counts = [r["count"] for r in jaccard_join.index_rows(docs, none).groupBy("key", "tag").count().collect()]
    assert counts and max(counts) <= 2


@pytest.mark.parametrize("one_each", [True, False])
def test_blocks_find_what_all_pairs_do(spark, monkeypatch, one_each):
    """Groups of up to 70 members in blocks of about 8, against all pairs of each group."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(7)
    sets = []
    for i in range(70):
        words = [f"w{j}" for j in range(60)]
        for _ in range(rng.choice([0, 1, 1, 2, 4])):
            words[rng.randrange(60)] = f"x{i}-{rng.randrange(99)}"
        sets.append(jaccard_join.shingle_set(" ".join(words).encode()))
    schema = "id long, n long, small binary"
    described = spark.createDataFrame([(i, len(s), bytearray(jaccard_join.sketch(s, jaccard_join.BITS).tobytes())) for i, s in enumerate(sets)], schema)
    groups = [sorted(rng.sample(range(70), k)) for k in (70, 40, 9, 3, 2, 2)]
    mixed = [(key, i, i % 20, len(g)) for key, g in enumerate(groups) for i in g]
    got = {tuple(r) for r in jaccard_join._near_in_blocks(spark.createDataFrame(mixed, "key long, id long, comp long, size long"), described, one_each).collect()}
    bits = [jaccard_join.sketch(s, jaccard_join.BITS) for s in sets]
    want = {}
    for g in groups:
        for a in g:
            for b in g:
                if a < b and a % 20 != b % 20 and 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])):
                    apart = int(jaccard_join.np.bitwise_count(bits[a] ^ bits[b]).sum())
                    if apart <= (len(sets[a]) + len(sets[b])) // 9:
                        pair = min(a % 20, b % 20), max(a % 20, b % 20)
                        want.setdefault(pair, []).append((apart, a, b))
    assert want and any(len(v) > 1 for v in want.values())
    assert got == ({min(v)[1:] for v in want.values()} if one_each else {x[1:] for v in want.values() for x in v})


class Batches:
    """Stands for a table: its batches go through what is given to mapInArrow, in this process."""

    def __init__(self, texts):
        self.batches = [pa.RecordBatch.from_pydict({"doc_id": [*range(len(texts))], "text": texts})]

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):  # noqa: N802
        return run(iter(self.batches))


def test_counting_shingles_takes_no_copies_of_all_that_a_task_met(monkeypatch):
    """300,000 shingles are 2.4 MB; besides them there is memory for those that repeat and for a slice."""
    monkeypatch.setattr(jaccard_join, "COUNTED", 310_000)
    form = " ".join(f"f{i}" for i in range(24))
    docs = Batches([f"{form} " + " ".join(f"w{i}-{j}" for j in range(80)) for i in range(3000)])
    for _ in jaccard_join.describe(Batches(["a b c d e f"])):
        pass
    tracemalloc.start()
    often = {}
    for batch in jaccard_join.describe(docs):
        often |= {r["hash"]: r["n"] for r in batch.to_pylist() if r["hash"] is not None} if batch.num_rows < 250 else {}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(often.values()) == [3000] * 20
    assert peak < 2 * 8 * 310_000


def test_counts_forget_only_shingles_met_once(monkeypatch):
    np = jaccard_join.np
    rng = np.random.default_rng(3)
    known, counts, want = np.empty(0, np.uint64), np.empty(0, np.int64), Counter()
    for least in (2, 2, 2, 3):
        new = rng.zipf(1.3, 500).astype(np.uint64) % np.uint64(200)
        met = Counter(new.tolist())
        want = Counter({x: want[x] + met[x] for x in want | met if x in want or met[x] >= least})
        known, counts = jaccard_join.summed(known, counts, new, least)
        assert dict(zip(known.tolist(), counts.tolist(), strict=True)) == want and (np.diff(known) > 0).all()
    few = np.array([5, 5], np.uint64)
    assert [x.tolist() for x in jaccard_join.summed(known[:0], counts[:0], few[:1].copy(), 3)] == [[], []]
    assert [x.tolist() for x in jaccard_join.summed(few[:1], counts[:1] * 0 + 2, few[:0], 3)] == [[5], [2]]
    monkeypatch.setattr(jaccard_join, "COUNTED", 30)
    short, long_ = "a b c d e f g h", " ".join(f"x{i}" for i in range(60))
    texts = [f"{short} {i}" for i in range(9)] + [long_, f"{long_} y"]  # sets over COUNTED, too
    often = [r for batch in jaccard_join.describe(Batches(texts)) for r in batch.to_pylist() if r["hash"] is not None]
    assert sorted(r["n"] for r in often) == [9] * 4


@pytest.mark.parametrize("one_each", [True, False])
def test_pairs_leave_a_task_in_parts(spark, monkeypatch, one_each):
    monkeypatch.setattr(jaccard_join, "PAIRS", 5)
    monkeypatch.setattr(jaccard_join, "COMPARED", 7)
    test_blocks_find_what_all_pairs_do(spark, monkeypatch, one_each)
