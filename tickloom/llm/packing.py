"""Best-fit packing by linear grouping.

All that decides a packing is how many pieces have each length: at most 1024 numbers, whatever the corpus. From them
the driver plans runs of equal sequences: large lengths are rounded up within groups of equal cardinality, a linear
program over few-size configurations is solved by column generation, actual lengths take the rounded ones' places and
the rest goes best-fit into what is left. Configurations that rounding leaves too empty are given up to that rest. Pieces find their places by their rank among those of their length, a
distributed prefix count.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tickloom.llm.common import cut, sliced

CAPACITY, END_ID = 1024, 2
#: Lengths above SMALL are grouped, into GROUPS groups.
SMALL, GROUPS = 256, 60
PIVOTS = 600
#: Tokens that a configuration of rounded lengths may leave free to be used: all, some or none are tried, the best plan counts.
WASTES = (1024, 16, 4, -1)
#: Hash buckets among the pieces of one length: no task sees more than its share of a frequent length.
BUCKETS = 1024
VOCABULARY = "byte_bpe_50k"
#: Texts of these characters only are split alike by both libraries; the tests go through all of them.
_PLAIN = re.compile("[\t\n\r -~¡-ſ]*")


@lru_cache(1)
def _exact(vocabulary: str) -> Tokenizer:
    """The tokenizer; loaded only where a text needs it."""
    return Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json"))


@lru_cache(1)
def _quick(vocabulary: str) -> tiktoken.Encoding:
    """A faster one of the same vocabulary and ids for plain texts."""
    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("quick", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _encoders(vocabulary: str) -> tuple[Tokenizer, tiktoken.Encoding]:
    return _exact(vocabulary), _quick(vocabulary)


def token_ids(text: str, vocabulary: str = VOCABULARY) -> list[int]:
    """Ids without special tokens, as Tokenizer.encode gives them."""
    if _PLAIN.fullmatch(text) and "<|endoftext|>" not in text:
        return _quick(vocabulary).encode_ordinary(text)
    return _exact(vocabulary).encode(text, add_special_tokens=False).ids


def cut_pieces(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of the pieces of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = []
            ids_of = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids_of, batch.column("text"), strict=True):
                ids = np.array([*token_ids(text.as_py() or "", vocabulary), END_ID], "<u4")
                first = (len(ids) - 1) % CAPACITY + 1
                bounds = [0, *range(first, len(ids) + 1, CAPACITY)]
                rows += [(doc_id, i, s, e - s, crc32(ids[s:e].tobytes())) for i, (s, e) in enumerate(zip(bounds, bounds[1:], strict=False))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [batch.column("doc_id").type, pa.int32(), *[pa.int64()] * 3], strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.select("doc_id").dtypes[0][1]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _best_configuration(sizes: np.ndarray, worth: np.ndarray) -> tuple[float, np.ndarray]:
    """The configuration of most worth that fits: a knapsack with repetition."""
    value, pick = np.zeros(CAPACITY + 1), np.full(CAPACITY + 1, -1)
    for room in range(int(sizes.min()), CAPACITY + 1):
        options = np.where(sizes <= room, worth + value[np.maximum(room - sizes, 0)], -1)
        best = int(options.argmax())
        value[room], pick[room] = (options[best], best) if options[best] > value[room - 1] else (value[room - 1], -1)
    chosen, room = np.zeros(len(sizes)), CAPACITY
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            chosen[pick[room]] += 1
            room -= int(sizes[pick[room]])
    return float(value[CAPACITY]), chosen


def few_size_configurations(sizes: np.ndarray, demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """(configuration, times): the linear program's optimum over all configurations, rounded down."""
    basis = np.diag((CAPACITY // sizes).astype(float))
    for _ in range(PIVOTS):
        duals = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, column = _best_configuration(sizes, duals)
        if value <= 1 + 1e-7:
            break
        times, direction = np.linalg.solve(basis, demand), np.linalg.solve(basis, column)
        ratios = np.where(direction > 1e-9, times / np.where(direction > 1e-9, direction, 1), np.inf)
        basis[:, int(ratios.argmin())] = column
    times = np.floor(np.linalg.solve(basis, demand) + 1e-7).astype(int)
    return [(basis[:, i].astype(int), int(t)) for i, t in enumerate(times) if t > 0]


def grouped(counts: dict[int, int]) -> list[list[list[int]]]:
    """Runs [length, count] of the large lengths, longest first, in GROUPS groups of equal cardinality."""
    large = sorted(((n, c) for n, c in counts.items() if n > SMALL and c > 0), reverse=True)
    each = -(-sum(c for _, c in large) // GROUPS) or 1
    groups: list[list[list[int]]] = []
    room = 0
    for length, count in large:
        while count:
            if not room:
                groups.append([])
                room = each
            take = min(room, count)
            groups[-1].append([length, take])
            room, count = room - take, count - take
    return groups


def substituted(ordered: np.ndarray, left: np.ndarray) -> dict[int, int]:
    """Actual lengths for a configuration's rounded ones: the longest of each size, at last the longest that fits."""
    slots: dict[int, int] = {}
    room = CAPACITY
    for i, size in enumerate(ordered):
        limit = room if i == len(ordered) - 1 else int(size)
        for n in np.flatnonzero(left[: limit + 1])[::-1]:
            if left[n] > slots.get(int(n), 0):
                slots[int(n)] = slots.get(int(n), 0) + 1
                room -= int(n)
                break
    return slots


def plan(counts: dict[int, int]) -> list[tuple[list[tuple[int, int]], int]]:
    """Runs of equal sequences, ([(length, times), ...], how many sequences): the fewest over WASTES."""
    counts = {int(n): int(c) for n, c in counts.items()}
    groups = grouped(counts)
    sizes, configurations = np.array([], int), []
    if groups:
        sizes, member = np.unique([g[0][0] for g in groups], return_inverse=True)
        configurations = few_size_configurations(sizes, np.bincount(member, [sum(c for _, c in g) for g in groups]))
    return min((filled(counts, sizes, [x for x in configurations if CAPACITY - x[0] @ sizes <= w]) for w in WASTES), key=lambda runs: sum(m for _, m in runs))


def filled(counts: dict[int, int], sizes: np.ndarray, configurations: list[tuple[np.ndarray, int]]) -> list[tuple[list[tuple[int, int]], int]]:
    """Configurations with actual lengths in them, then everything else best-fit, longest first."""
    left = np.zeros(CAPACITY + 1, int)
    for length, count in counts.items():
        left[length] = count
    rest: dict[int, int] = {}
    open_runs: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}

    def put(slots: list[tuple[int, int]], times: int) -> None:
        open_runs.setdefault(CAPACITY - sum(n * k for n, k in slots), []).append((slots, times))

    for configuration, times in configurations:
        ordered = np.repeat(sizes, configuration)[::-1]
        while times and (slots := substituted(ordered, left)):
            batch = min([times, *(int(left[n]) // k for n, k in slots.items())])
            for n, k in slots.items():
                left[n] -= k * batch
            put(list(slots.items()), batch)
            times -= batch
    for length in np.flatnonzero(left):
        rest[int(length)] = int(left[length])
    for length in sorted(rest, reverse=True):
        count = rest[length]
        while count:
            room = min((s for s in open_runs if s >= length), default=None)
            slots, times = open_runs[room].pop() if room is not None else ([], -(-count // (CAPACITY // length)))
            if room is not None and not open_runs[room]:
                del open_runs[room]
            each = (room if room is not None else CAPACITY) // length
            full = min(times, count // each)
            if full:
                put([*slots, (length, each)], full)
                count, times = count - full * each, times - full
            if times and count and full * each < each * (full + 1) and count < each:
                put([*slots, (length, count)], 1)
                count, times = 0, times - 1
            if times and slots:
                put(slots, times)
    return [run for runs in open_runs.values() for run in runs]


def places(runs: list[tuple[list[tuple[int, int]], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, times, first sequence, offset): where the pieces of a length with these ranks go."""
    out, sequence, used = [], 0, {}
    for slots, many in runs:
        offset = 0
        for length, times in slots:
            first = used.get(length, 0)
            used[length] = first + times * many
            out.append((length, first, used[length], times, sequence, offset))
            offset += length * times
        sequence += many
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """pieces with their rank from 0 among those of their length; buckets keep frequent lengths from one task."""
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(BUCKETS)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    return dealt.withColumn("own", own).join(starts, ["length", "bucket"]).withColumn("rank", F.col("first") + F.col("own")).drop("bucket", "own", "first")


def pack(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs(doc_id, text).

    Null and empty texts are the end id alone. Repeated rows are packed as often as they come; of pieces with equal
    length, doc_id, piece and ids any may take any of their places. An empty table gives an empty result; other columns
    are not read. The plan that is broadcast has at most a few rows for each of 1024 lengths.
    """
    spark = docs.sparkSession
    pieces = cut(cut_pieces(docs, vocabulary))
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = spark.createDataFrame(places(plan(counts)), "length long, first long, end long, times long, sequence long, at long")
    found = ranked(pieces).join(F.broadcast(table), "length").filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    step = F.col("rank") - F.col("first")
    sequence = (F.col("sequence") + F.floor(step / F.col("times"))).cast("long")
    offset = (F.col("at") + step % F.col("times") * F.col("length")).cast("long")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))
