"""N-gram Jaccard self-join by a partitioned universe and the pigeonhole principle, with exact verification.

A document's set holds the distinct 5-word shingles of its text. Sets of one size band hash their shingles into the
same segments. A signature is a segment's subset of a set. Two sets that differ in at most D shingles differ in at
most D segments, so of the first D + 1 signatures of each, in one global order, one is shared. The order is by cost:
signatures of frequent shingles come last, whose frequency is counted over all documents. A set that fills D segments
or fewer is also indexed by single shingles: if two linked sets share no segment, all that either fills are among the
D that differ, so both are. Sets of 4 to 7 shingles, where D is 1, are one segment with its one-deletion
neighbourhood: a link joins a whole set to another's deletion.

Sets that share a signature are candidates. First each is compared with a pivot of its groups, until pivots find few
links; then the members of groups that still span several components are compared in blocks, first for one link of
any two components, then for all that are left. Parity sketches rule out
nearly all false candidates before whole sets are read: bit i of a sketch tells whether an odd number of shingles
falls on i, so that the bits in which two sketches differ are at most the shingles in which the sets do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, discard, sliced

WORDS = 5
#: Segments for each difference that a band allows.
SEGMENTS = 1.5
#: A shingle counts as frequent from so many documents of a task; the most frequent ones, so many at most, are told to
#: all tasks. A task that has met over COUNTED shingles forgets those met once. Costs decide the order of signatures only.
FREQUENT, MOST_FREQUENT, COUNTED = 3, 50_000, 4_000_000
#: Ids up to this number are broadcast; beyond it they are joined by a shuffle.
BROADCAST_IDS = 200_000
#: Pivots are tried anew as long as one comparison in so many finds a link.
WORTH = 20
#: Members of a group that are compared at once: larger groups are split into blocks of about this size.
BLOCK = 512
#: Pairs of rows that a task compares, and pairs found that it keeps, at once.
COMPARED, PAIRS = 20_000, 200_000
#: Keys told of each member of groups, by which two members know whether they also meet elsewhere.
LISTED = 8
#: Bits of the sketch that goes with every candidate; the other sketch has 2 to 4 bits a shingle.
BITS = 1024

# Odd multipliers of the polynomial and the mixing steps.
_P = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; empty without words."""
    words = (text or b"").lower().split()  # bytes lower A-Z only and split at ASCII white space
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(words) - WORDS + 1
    total = h[:n] * _P[0]
    for i in range(1, WORDS):
        total += h[i : i + n] * _P[i]
    return np.unique(_mixed(total))


def most_different(n: int, other: int) -> int:
    """Shingles by which sets of these sizes can differ at 100 * intersection >= 80 * union."""
    return (n + other) // 9


def bands(n: int) -> list[tuple[int, int]]:
    """(band, D) of the bands that a set of n shingles is indexed in: its own, and the one below if partners lie there.

    Band k has sizes from 2 ** k on. Sets below 4 shingles have no partner but their equal.
    """
    if n < 4:
        return []
    k = n.bit_length() - 1
    out = [(k, most_different(n, 5 * n // 4))]
    below = (1 << k) - 1
    if 5 * below >= 4 * n and below >= 4:
        out.append((k - 1, most_different(n, below)))
    return out


def segments(band: int) -> int:
    top = 2 << band
    return int(SEGMENTS * (most_different(top, 5 * top // 4) + 1))


def signatures(shingles: np.ndarray, band: int, d: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set's indexed signatures in a band."""
    salt = np.uint64(((band + 1) * 0x9E3779B97F4A7C15) % (1 << 64))
    mixed = _mixed(shingles)
    if band == 2:  # the whole set and the set without each shingle
        whole = mixed.sum(dtype=np.uint64)
        return _mixed(np.concatenate([[whole], whole - mixed]) + salt)
    hashes, counts = frequent
    at = np.minimum(np.searchsorted(hashes, shingles), max(0, len(hashes) - 1))
    costs = np.where(hashes[at] == shingles, counts[at], 0) if len(hashes) else np.zeros(len(shingles), np.int64)
    own = (_mixed(shingles + np.uint64(band + 1)) >> np.uint64(33)).astype(np.int64) % segments(band)
    order = np.argsort(own, kind="stable")
    filled, starts = np.unique(own[order], return_index=True)
    keys = _mixed(np.add.reduceat(mixed[order], starts) + filled.astype(np.uint64) * _P[1] + salt)
    cheapest = np.minimum.reduceat(costs[order], starts)
    first = keys[np.lexsort((keys, cheapest))[: d + 1]]
    if len(filled) > d:
        return first
    keys = _mixed(mixed + salt)
    return np.concatenate([first, keys[np.lexsort((keys, costs))[: d + 1]]])


def _print(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _tag(print_: bytes) -> int:
    return int.from_bytes(print_[:8], "little", signed=True)


def sketch(shingles: np.ndarray, bits: int) -> np.ndarray:
    """Parities of the shingles on each of ``bits`` places (a multiple of 64), as words of 64."""
    place = (_mixed(shingles) >> np.uint64(20)) % np.uint64(bits)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits) % 2 == 1).view(np.uint64)


def own_bits(n: int) -> int:
    """Bits of the larger sketch of a set of n shingles: 4 times the least size of its band."""
    return max(64, 4 << (n.bit_length() - 1))


def apart(a: bytes, b: bytes) -> int:
    """A number of shingles in which the sets of two larger sketches differ at least; the longer one is folded."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of the batches, each with its texts."""
    for part in sliced(batches):
        yield part, pc.cast(part.column("text"), pa.binary()).to_pylist()


def summed(known: np.ndarray, counts: np.ndarray, new: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted shingles and their counts: those known, and those that come ``least`` times in new, which is sorted in place.

    Besides new there is memory only for shingles that repeat, not for all of new.
    """
    new.sort()
    distinct = np.union1d(known, new[least - 1 :][new[least - 1 :] == new[: len(new) - least + 1]])
    times = np.searchsorted(new, distinct, "right") - np.searchsorted(new, distinct)
    times[np.searchsorted(distinct, known)] += counts
    return distinct, times


def describe(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, n, print, tag: the print's first 8 bytes), and rows of frequent shingles (n, hash)."""
    names = ["doc_id", "n", "print", "tag", "hash"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        known, counts, new, filled = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(COUNTED, np.uint64), 0
        for part, texts in _texts(batches):
            ns, prints = [], []
            for text in texts:
                shingles = shingle_set(text)
                ns.append(len(shingles))
                prints.append(_print(shingles))
                if prints[-1] is None or prints[-1] in seen:
                    continue
                seen.add(prints[-1])
                if filled + len(shingles) > COUNTED:
                    known, counts = summed(known, counts, new[:filled], 2)
                    filled = 0
                if len(shingles) > COUNTED:
                    known, counts = summed(known, counts, shingles, 2)
                    continue
                new[filled : filled + len(shingles)] = shingles
                filled += len(shingles)
            tags = pa.array([x and _tag(x) for x in prints], pa.int64())
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(ns, pa.int64()), pa.array(prints, pa.binary()), tags]
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(ns), pa.int64())], names)
        known, counts = summed(known, counts, new[:filled], FREQUENT)
        del new
        often = counts >= FREQUENT
        m = int(often.sum())
        columns = [pa.nulls(m, pa.int64()), pa.array(counts[often]), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(known[often].astype(np.int64))], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, print binary, tag long, hash long")


def index_rows(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key, tag and role of every indexed signature, once for each distinct set of a task.

    So the rows that leave a task are combined before the shuffle: a set that makes up a large part of the table has
    at most one row a task and key.

    Roles: 0 a deletion, 1 a whole set of a one-deletion band, 2 any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for _, texts in _texts(batches):
            keys, tags, roles = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int8)]
            for text in texts:
                shingles = shingle_set(text)
                of_set = _print(shingles)
                if of_set is None or of_set in seen:
                    continue
                seen.add(of_set)
                for band, d in bands(len(shingles)):
                    keys.append(signatures(shingles, band, d, frequent))
                    n = len(keys[-1])
                    tags.append(np.full(n, _tag(of_set), np.int64))
                    roles.append(np.full(n, 2, np.int8) if band != 2 else (np.arange(n) == 0).astype(np.int8))
            columns = [np.concatenate(keys).astype(np.int64), np.concatenate(tags), np.concatenate(roles)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["key", "tag", "role"])

    return docs.select("text").mapInArrow(run, "key long, tag long, role tinyint")


def _described_sets(docs: DataFrame, names: str) -> DataFrame:
    """``names`` of docs with, of each text: print, n, small and large (its sketches) and shingles, where there are any."""
    kept = [name.split()[0] for name in names.split(", ") if name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            sets = [shingle_set(t) for t in texts]
            full = [i for i, s in enumerate(sets) if len(s)]
            sets = [sets[i] for i in full]
            columns = [part.column(name).take(pa.array(full, pa.int64())) for name in kept]
            starts = np.concatenate([[0], np.cumsum([*map(len, sets)])]).astype(np.int32)
            values = np.concatenate([*sets, np.empty(0, np.uint64)]).astype(np.int64)
            columns += [pa.array([*map(_print, sets)], pa.binary()), pa.array([*map(len, sets)], pa.int64())]
            columns += [pa.array([sketch(s, BITS).tobytes() for s in sets], pa.binary())]
            columns += [pa.array([sketch(s, own_bits(len(s))).tobytes() for s in sets], pa.binary())]
            columns += [pa.ListArray.from_arrays(pa.array(starts), pa.array(values))]
            yield pa.RecordBatch.from_arrays(columns, [*kept, "print", "n", "small", "large", "shingles"])

    made = "print binary, n long, small binary, large binary, shingles array<long>"
    return docs.select(*kept, "text").mapInArrow(run, f"{names}, {made}" if names else made)


def _counted(df: DataFrame) -> tuple[DataFrame, int]:
    seen = Observation()
    return cut(df.observe(seen, F.count(F.lit(1)).alias("rows"))), seen.get.get("rows", 0)


def candidate_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, n, small, large and shingles of the nodes(id, print, rep), a row each.

    A doc_id may come with other texts too: the print picks the node's own. Nodes without any id are found by print.
    """
    count = nodes.count()
    ids = nodes.filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).distinct()
    found = _described_sets(docs.select("doc_id", "text").join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "doc_id"), "doc_id long")
    own = nodes.select("id", F.col("rep").alias("doc_id"), "print")
    sets = found.join(F.broadcast(own) if count <= BROADCAST_IDS else own, ["doc_id", "print"]).drop("doc_id", "print")
    without = nodes.filter("rep IS NULL").select("id", "print")
    if not without.isEmpty():
        sets = sets.union(_described_sets(docs.filter("doc_id IS NULL"), "").join(without, "print").drop("print").select(*sets.columns))
    made, rows = _counted(sets.select("id", "n", "small", "large", "shingles"))
    if rows == count:
        return made
    once = cut(made.dropDuplicates(["id"]))  # rows that repeat, id and text
    discard(made)
    return once


def _plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and larger sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            bound = (batch.column("na").to_numpy() + batch.column("nb").to_numpy()) // 9
            sketches = zip(batch.column("oa").to_pylist(), batch.column("ob").to_pylist(), strict=True)
            near = pa.array(np.fromiter((apart(*x) for x in sketches), np.int64, batch.num_rows) <= bound)
            yield batch.select(["a", "b"]).filter(near)

    ends = lambda x: sets.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("large").alias(f"o{x}"))
    near = pairs.join(ends("a"), "a").join(ends("b"), "b").filter(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
    return near.mapInArrow(run, "a long, b long")


def verified(likely: DataFrame, sets: DataFrame) -> tuple[DataFrame, int]:
    """Of the pairs (a, b) of node ids those with 100 * intersection >= 80 * union, and their number."""
    likely, count = _counted(_plausible(likely, sets))
    if not count:
        return likely, 0
    needed = likely.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = sets.join(F.broadcast(needed) if 2 * count <= BROADCAST_IDS else needed, "id", "left_semi")
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("of_b"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    joined = likely.join(left, "a").join(right, "b")
    links = _counted(joined.filter(100 * both >= 80 * (F.size("of_a") + F.size("of_b") - both)).select("a", "b"))
    discard(likely)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node it reaches) of all nodes of edges(a, b): least neighbours, then pointer jumps."""
    ways = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(ways.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("label")))
    while True:
        near = ways.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = lower.join(jump, "label").select("node", "was", F.least("label", "far").alias("label"))
        seen = Observation()
        moved = F.count_if(F.col("label") != F.col("was")).alias("moved")
        before, labels = labels, cut(new.observe(seen, moved).select("node", "label"))
        discard(before)
        if not seen.get.get("moved", 0):
            discard(ways)
            return labels


def merged(labels: DataFrame, links: DataFrame, count: int) -> DataFrame:
    """labels after count more links(a, b): components of the components that they connect. Files that are done with go."""
    if not count:
        discard(links)
        return labels
    known = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"c{x}"))
    between = links.join(known("a"), "a", "left").join(known("b"), "b", "left")
    between = between.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).filter("a <> b")
    connected = components(between)
    higher = connected.select(F.col("node").alias("label"), F.col("label").alias("top"))
    # A node that had no link before is its own component.
    nodes = labels.union(higher.join(labels.select("label").distinct(), "label", "left_anti").select("label", "label"))
    out = cut(nodes.join(higher, "label", "left").select("node", F.coalesce("top", "label").alias("label")))
    discard(labels, links, connected)
    return out


def _spanning(members: DataFrame, labels: DataFrame) -> DataFrame:
    """key, id, comp and size (of the group) of the members(key, id) whose group still spans several components."""
    own = members.join(labels.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("label", "id").alias("comp"))
    groups = own.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
    return cut(own.join(groups.filter("low <> high").select("key", "size"), "key"))


def _led(mixed: DataFrame, number: int) -> DataFrame:
    """Pairs (a, b), one for each node a at most: of its groups' pivots the one in another component that leads most.

    A group's pivot is its member with the least hash, another one for every ``number``.
    """
    pivots = mixed.groupBy("key").agg(F.min(F.struct(F.xxhash64("id", F.lit(number)).alias("h"), "id", "comp")).alias("lead"))
    other = mixed.join(pivots, "key").filter(F.col("comp") != F.col("lead.comp"))
    often = other.groupBy("id", F.col("lead.id").alias("lead")).count()
    return often.groupBy("id").agg(F.max_by("lead", F.struct("count", "lead")).alias("b")).select(F.col("id").alias("a"), "b")


def _near_in_blocks(mixed: DataFrame, sets: DataFrame, one_each: bool) -> DataFrame:
    """Pairs (a, b) of different components that share a group and whose sizes and small sketches allow a link.

    With ``one_each`` only the likeliest pair of any two components, since one link joins them. Groups over BLOCK are
    dealt into blocks by hash and a task gets two blocks, so that no task holds a whole large group, and only pairs
    that pass leave a task: each from the first of the groups that both are known to share.
    """
    keys = mixed.groupBy("id").agg(F.slice(F.sort_array(F.collect_list("key")), 1, LISTED).alias("keys"))
    deal = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = mixed.join(sets.select("id", "n", "small"), "id").join(keys, "id").withColumn("own", F.pmod(F.xxhash64("id"), deal).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), deal - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "comp", "n", "small", "keys")
    last_key = np.iinfo(np.int64).max

    def pairs_of(found: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.unique(np.concatenate(found), axis=0)
        if one_each:
            pairs = pairs[np.unique(pairs[:, :2], axis=0, return_index=True)[1]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in pairs.T], ["low", "high", "apart", "a", "b"])

    def near(rows: dict[str, np.ndarray], ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """ends: where each row's group ends. Each row is compared with the one s places on, for all s."""
        alive, found = np.arange(len(ends)), [np.empty((0, 5), np.int64)]
        s = 0
        while len(alive):
            s += 1
            alive = alive[ends[alive] > alive + s]
            for x in np.array_split(alive, len(alive) // COMPARED + 1):
                y = x + s
                n, m = rows["n"][x], rows["n"][y]
                # Two rows of one block meet in the pair of this block with itself only.
                meet = (rows["i"][x] == rows["j"][x]) | (rows["own"][x] != rows["own"][y])
                meet &= (rows["comp"][x] != rows["comp"][y]) & (5 * np.minimum(n, m) >= 4 * np.maximum(n, m))
                x, y, bound = x[meet], y[meet], ((n + m) // 9)[meet]
                apart = np.bitwise_count(rows["small"][x] ^ rows["small"][y]).sum(1, dtype=np.int64)
                x, y, apart = (v[apart <= bound] for v in (x, y, apart))
                if not len(x):
                    continue
                kx, ky = rows["keys"][x], rows["keys"][y]
                first = np.where((kx[:, :, None] == ky[:, None, :]).any(2), kx, last_key).min(1)
                x, y, apart = (v[first >= rows["key"][x]] for v in (x, y, apart))
                ids, comps = (np.sort(np.stack([rows[c][x], rows[c][y]], 1), 1) for c in ("id", "comp"))
                found.append(np.column_stack([comps, apart, ids]))
                if sum(map(len, found)) > PAIRS:
                    yield pairs_of(found)
                    found = [np.empty((0, 5), np.int64)]
        yield pairs_of(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = {c: batch.column(c).to_numpy() for c in ("key", "i", "j", "own", "id", "comp", "n")}
            words = b"".join(batch.column("small").to_pylist())
            rows["small"] = np.frombuffer(words, np.uint64).reshape(-1, BITS // 64)
            listed = batch.column("keys")
            rows["keys"] = np.full((batch.num_rows, LISTED), last_key)
            sizes = pc.list_value_length(listed).to_numpy()
            rows["keys"][np.arange(LISTED) < sizes[:, None]] = listed.flatten().to_numpy()
            if rest is not None:
                rows = {c: np.concatenate([rest[c], v]) for c, v in rows.items()}
            size = len(rows["key"])
            if not size:
                continue
            new = np.any([rows[c][1:] != rows[c][:-1] for c in ("key", "i", "j")], 0)
            starts = np.concatenate([[0], np.nonzero(new)[0] + 1])
            last = starts[-1]  # the last group may go on in the next batch
            ends = np.repeat(np.append(starts[1:], size), np.diff(np.append(starts, size)))
            yield from near({c: v[:last] for c, v in rows.items()}, ends[:last])
            rest = {c: v[last:].copy() for c, v in rows.items()}  # a view would hold the whole batch
        if rest is not None:
            yield from near(rest, np.full(len(rest["key"]), len(rest["key"])))
        pa.default_memory_pool().release_unused()

    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    pairs = dealt.mapInArrow(run, "low long, high long, apart long, a long, b long")
    if one_each:
        return pairs.groupBy("low", "high").agg(F.min(F.struct("apart", "a", "b")).alias("best")).select("best.a", "best.b")
    return pairs.select("a", "b").distinct()


def link_sets(members: DataFrame, deleted: DataFrame, sets: DataFrame) -> DataFrame:
    """node and label of all linked nodes: components of the links among deleted(a, b) and nodes that share a key of members(key, id)."""
    labels = sets.sparkSession.createDataFrame([], "node long, label long")
    labels = merged(labels, *verified(deleted, sets))
    mixed, number = _spanning(members, labels), 0
    while not mixed.isEmpty():
        pairs, tried = _counted(_led(mixed, number))
        links, found = verified(pairs, sets)
        discard(pairs)
        labels = merged(labels, links, found)
        # Groups of one component need no look again.
        before, mixed = mixed, _spanning(mixed.select("key", "id"), labels) if found else mixed
        if found:
            discard(before)
        if found * WORTH < tried:
            for one_each in (True, False):
                links, found = verified(_near_in_blocks(mixed, sets, one_each), sets)
                labels = merged(labels, links, found)
                if one_each and found:
                    before, mixed = mixed, _spanning(mixed.select("key", "id"), labels)
                    discard(before)
            break
        number += 1
    discard(mixed)
    return labels


def _labelled(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n, print) of docs, and print, rep (the least doc_id) and comp (the component) of every set."""
    described = cut(describe(docs))
    rows = described.filter("hash is null").select("doc_id", "n", "print", "tag")
    often = described.filter("hash is not null").groupBy("hash").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "hash").limit(MOST_FREQUENT).toPandas()
    hashes = often["hash"].to_numpy(np.int64).astype(np.uint64)
    order = np.argsort(hashes)
    frequent = (hashes[order], often["n"].to_numpy(np.int64)[order])

    by_key = Window.partitionBy("key")
    index = index_rows(docs, frequent).withColumns({"low": F.min("tag").over(by_key), "high": F.max("tag").over(by_key)})
    shared = cut(index.filter("low <> high").select("key", "tag", "role").distinct())
    found = rows.filter("n > 0").groupBy("print").agg(F.min("doc_id").alias("rep"), F.first("tag").alias("tag"))
    nodes = cut(found.withColumn("id", F.monotonically_increasing_id()))
    # Where two prints begin alike, both nodes take part; verification tells them apart.
    members = cut(shared.join(nodes.select("tag", "id"), "tag").select("key", "id", "role"))
    discard(shared)
    candidates = cut(nodes.join(members.select("id").distinct(), "id", "left_semi").select("id", "print", "rep"))
    sets = candidate_sets(docs, candidates)
    wholes = members.filter("role = 1").select("key", F.col("id").alias("a"))
    deleted = wholes.join(members.filter("role = 0").select("key", F.col("id").alias("b")), "key").filter("a <> b").select("a", "b").distinct()
    labels = link_sets(members.filter("role = 2").select("key", "id"), deleted, sets)
    discard(members, candidates, sets)
    labelled = nodes.select("print", "rep", "id").join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("comp", F.coalesce("label", "id"))
    return rows.select("doc_id", "n", "print"), labelled.select("print", "rep", "comp")


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs(doc_id, text).

    Two rows link when 100 * intersection >= 80 * union of their sets; component_id is the least doc_id that links
    reach. Null texts and texts without words have no shingles and are their own component; fewer than five words are
    one shingle. Equal sets are one node however many rows have them; repeated rows stay rows. A null doc_id is never
    the least. Empty tables give empty results; other columns are not read. Sets are compared as 64-bit hashes.
    """
    rows, labelled = _labelled(docs)
    least = labelled.groupBy("comp").agg(F.min("rep").alias("component_id"))
    of_print = labelled.join(least, "comp").select("print", "component_id")
    joined = rows.join(of_print, "print", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _with_print(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            prints = pa.array([_print(shingle_set(t)) for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns, prints], [*part.schema.names, "print"])

    return docs.mapInArrow(run, ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes) + ", print binary")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of docs(doc_id, text, ...): of the set with the least doc_id, or without any, the least row.

    Texts decide which rows are the same: rows of one doc_id with unlike texts are judged apart, and a null doc_id is as
    any other. Texts without words stay, one row a doc_id, and all rows without an id.
    """
    rows, labelled = _labelled(docs.select("doc_id", "text"))
    best = labelled.groupBy("comp").agg(F.min(F.when(F.col("rep").isNotNull(), F.struct("rep", "print"))).alias("best"), F.min("print").alias("least"))
    kept = cut(best.select(F.col("best.rep").alias("rep"), F.coalesce("best.print", "least").alias("print")))
    # Only where an id comes more than once, or not at all, are rows compared and their prints made again.
    again = cut(rows.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").select("doc_id"))
    ids = kept.filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id")).union(rows.filter("n = 0 AND doc_id IS NOT NULL").select("doc_id"))
    single = docs.join(ids.join(again, "doc_id", "left_anti").distinct(), "doc_id", "left_semi")
    columns, others = docs.columns, [c for c in docs.columns if c != "doc_id"]
    hard = _with_print(docs.join(again, "doc_id", "left_semi").select(*columns).union(docs.filter("doc_id IS NULL")))
    worded = hard.join(kept, "print").filter("doc_id <=> rep").groupBy("print").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    empty = hard.filter("print IS NULL")
    of_empty = empty.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")).select("doc_id", "row.*").select(*columns)
    return single.select(*columns).union(worded).union(of_empty).union(empty.filter("doc_id IS NULL").select(*columns))
