"""A trie of conversations from chained prefix digests.

Each conversation's prefixes get digests that chain over its turns' digests; prefixes with equal (depth, digest) are
one node. Every node is exploded to all its ancestors, and subtree sums are sums by ancestor. So that long
conversations don't make rows for all pairs of depths, depths are cut into blocks: nodes are exploded to the ancestors
in their own block, block heads to the heads in their block of blocks, and what heads gather is handed down once. With
fewer turns than a block has depths that is a single explosion. Texts are hashed where they lie and shuffled nowhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import cut, discard
from tickloom.llm.mixing import size_of

#: Rebuilt conversations start with turns of the one whose number is rounded down to a multiple of GROUP, HEADS - 1 at most.
GROUP, HEADS = 20, 4
#: Depths of a block, and levels of blocks of blocks; a block of the last level has no end.
BLOCK, LEVELS = 64, 4
#: Members that end at a node are hashed in runs of conv_ids of this length (as a power of 2).
RUN_BITS = 12
ROOT = hashlib.sha256(b"").digest()
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 of role and text, which no other pair shares."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (place from 1 in its conversation), h, digest and words of every turn, without texts."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS
    slim = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", h.cast("int").alias("h"), turn_digest(F.col("role"), F.col("text")).alias("digest"), size_of(F.col("text")).alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return slim.select("conv_id", F.row_number().over(order).alias("at"), "h", "digest", "words")


def rebuilt(rows: DataFrame) -> DataFrame:
    """conv_id, part, at, digest and words of the rebuilt conversations: the root, borrowed turns, then own ones."""
    convs = rows.filter("at = 1").select("conv_id", "h", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("source"))
    root = convs.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    first = rows.filter((F.col("at") < HEADS) & (F.col("conv_id") % GROUP == 0)).select(F.col("conv_id").alias("source"), "at", "digest", "words")
    borrowed = convs.join(first, "source").filter("at <= h").select("conv_id", F.lit(1).alias("part"), "at", "digest", "words")
    own = rows.filter("at > h").select("conv_id", F.lit(2).alias("part"), "at", "digest", "words")
    return root.union(borrowed).union(own)


def prefixes(turn_rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, digest, parent, words, ends, up and back of every prefix.

    ``up`` has, for each level of blocks that this depth is a head of (level 0: every depth), the digests of its
    ancestors in its block and its own; ``back`` those of the block before. One pass over sorted rows keeps a digest
    and at most two blocks of digests a level, whatever the number of turns.
    """
    schema = "conv_id long, depth int, digest binary, parent binary, words long, ends boolean, up array<array<binary>>, back array<array<binary>>"
    kind = pa.list_(pa.list_(pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "digest", "parent", "words", "ends", "up", "back"]
        last, depth, digest = None, 0, ROOT
        blocks: list[list[bytes]] = []
        before: list[list[bytes]] = []

        def written(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_(), kind, kind]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(*(zip(*rows, strict=True), kinds), strict=True)], names)

        held: list[list] = []
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("conv_id", "part", "digest", "words"))
            for conv, part, turn, words in zip(*columns, strict=True):
                if part == 0:
                    if held:
                        held[-1][5] = True
                    last, depth, digest, parent = conv, 0, ROOT, None
                    blocks, before = [[] for _ in range(LEVELS)], [[] for _ in range(LEVELS)]
                else:
                    parent, depth = digest, depth + 1
                    digest = hashlib.sha256(parent + turn).digest()
                up, back, place = [], [], depth
                for level in range(LEVELS):
                    if place % block == 0 and level < LEVELS - 1 and place:
                        before[level], blocks[level] = blocks[level], []
                    blocks[level].append(digest)
                    up.append(list(blocks[level]))
                    back.append(list(before[level]) if place % block == 0 else [])
                    if place % block:
                        break
                    place //= block
                if len(held) >= 1000:
                    yield written(held[:-1])
                    held = held[-1:]
                held.append([last, depth, digest, parent, words, False, up, back])
        if held:
            held[-1][5] = True
            yield written(held)

    dealt = turn_rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    return dealt.mapInArrow(run, schema)


def nodes_of(rows: DataFrame) -> DataFrame:
    """depth, digest, conv_id, n_convs, words, parent, up and back of every node."""
    least = F.min(F.struct("conv_id", "words", "parent", "up", "back")).alias("least")
    return rows.groupBy("depth", "digest").agg(least, F.count("*").alias("n_convs")).select("depth", "digest", "n_convs", "least.*")


def hashed_ends(rows: DataFrame) -> DataFrame:
    """depth, digest and ends_sha256 of the nodes at which conversations end.

    conv_ids are written in runs of neighbouring numbers, of 2^RUN_BITS at most. A node with one run is hashed as it
    is; of the others the runs are streamed in order into one hash, which can't be computed in parts.
    """
    runs = rows.filter("ends").groupBy("depth", "digest", F.shiftright("conv_id", RUN_BITS).alias("run"))
    runs = runs.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    runs = cut(runs)
    counts = runs.groupBy("depth", "digest").agg(F.count("*").alias("n"), F.min("ids").alias("only"))
    single = counts.filter("n = 1").select("depth", "digest", F.sha2("only", 256).alias("ends_sha256"))
    several = runs.join(counts.filter("n > 1").select("depth", "digest"), ["depth", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        names = ["depth", "digest", "ends_sha256"]
        one = lambda: pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int32()), pa.array([node[1]], pa.binary()), pa.array([state.hexdigest()])], names)
        for batch in batches:
            for depth, digest, ids in zip(*(batch.column(n).to_pylist() for n in ("depth", "digest", "ids")), strict=True):
                if node != (depth, digest):
                    if node:
                        yield one()
                    node, state = (depth, digest), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if node:
            yield one()

    dealt = several.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "run").select("depth", "digest", "ids")
    return single.union(dealt.mapInArrow(run, "depth int, digest binary, ends_sha256 string"))


def subtree_sums(nodes: DataFrame, values: list[str], deepest: int, block: int = BLOCK) -> DataFrame:
    """depth, digest and the sums of ``values`` over each node's subtree.

    Level k holds the nodes whose depth is a multiple of block^k. Going up, each is exploded to its ancestors in its
    block, and heads carry the sums of their blocks to the next level. Going down, heads' sums over all that is below
    them go to the block before.
    """
    names = ["depth", "digest"]
    total = lambda df: df.groupBy(*names).agg(*(F.sum(v).alias(v) for v in values))
    levels = next((k for k in range(1, LEVELS) if deepest < block**k), LEVELS)
    shape = nodes.select(*names, "up", "back")
    inside, held = [], nodes.select(*names, "up", *values)
    for k in range(levels):
        step = block**k
        path = F.get("up", F.lit(k))
        start = F.col("depth") - (F.size(path) - 1) * step
        exploded = held.select(start.alias("start"), F.posexplode(path).alias("i", "digest"), *values)
        sums = total(exploded.select((F.col("start") + F.col("i") * step).cast("int").alias("depth"), "digest", *values))
        sums = cut(sums) if levels > 1 else sums
        inside.append(sums)
        if k + 1 < levels:
            held = sums.filter(F.col("depth") % block ** (k + 1) == 0).join(shape.select(*names, "up"), names)
    found = inside[-1]
    for k in range(levels - 2, -1, -1):
        step = block**k
        heads = found.filter("depth > 0").join(shape.select(*names, "back"), names).withColumn("path", F.get("back", F.lit(k)))
        down = heads.select((F.col("depth") - F.size("path") * step).alias("start"), F.posexplode("path").alias("i", "digest"), *values)
        down = down.select((F.col("start") + F.col("i") * step).cast("int").alias("depth"), "digest", *values)
        found = cut(total(inside[k].select(*names, *values).union(down)))
    return found


def conversation_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256 of every node.

    Turns are ordered by turn, null first, ties by the digest of role and text, so that repeated rows are turns of
    their own in a fixed order. Null roles and texts are empty ones; rows without a conv_id are left out; other columns
    are not read. conv_id % 20 takes the sign of conv_id, as in SQL. An empty table has no nodes. A conversation's
    turns are ordered by one task, as digests without texts.
    """
    rows = cut(turns(conversations))
    chain = cut(prefixes(rebuilt(rows), block))
    nodes = cut(nodes_of(chain))
    ends = hashed_ends(chain)
    names = ["depth", "digest"]
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    saved = ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    facts = nodes.join(children, names, "left").join(ends, names, "left")
    facts = facts.select(*names, "conv_id", "parent", "n_convs", "up", "back", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), saved)
    facts = cut(facts.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")))
    discard(rows, chain, nodes)
    deepest = facts.agg(F.max("depth")).first()[0] or 0
    sums = subtree_sums(facts, ["n_leaves", "saved_tokens"], deepest, block)
    # rows of one parent are many where a first turn is common: the join's large side can be split, its other side has one row
    parents = facts.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    own = facts.select(*names, "conv_id", "parent", "n_convs", "n_children", "ends_sha256").join(sums, names)
    out = own.join(parents, ["depth", "parent"], "left")
    whole = [F.col(c).cast("long").alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")]
    return out.select(*whole, "ends_sha256")


#: The same in DuckDB: nodes are written as the joined hashes of their turns, so that an ancestor is a prefix.
ORACLE = f"""
WITH t AS (
  SELECT conv_id, sha256(octet_length(encode(coalesce(role, '')))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS words, turn FROM conversations WHERE conv_id IS NOT NULL
), o AS (SELECT conv_id, digest, words, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) AS place FROM t
), c AS (
  SELECT conv_id, conv_id - conv_id % {GROUP} AS source, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
    lambda ch: [256 + ascii(ch), 0, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, x: CASE WHEN x >= 256 THEN xor(a, x - 256) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, 1 AS part, o.place, o.digest, o.words FROM c JOIN o ON o.conv_id = c.source AND o.place <= c.h
  UNION ALL SELECT c.conv_id, 2, o.place, o.digest, o.words FROM c JOIN o USING (conv_id) WHERE o.place > c.h
), p AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(digest, '') OVER w AS path, words, row_number() OVER w = count(*) OVER (PARTITION BY conv_id) AS ends FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, place ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM r) FROM c
), n AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY ALL
), k AS (
  SELECT n.*, coalesce(m.n_children, 0) AS n_children FROM n LEFT JOIN (
    SELECT substr(path, 1, 64 * (depth - 1)::INT) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL) m USING (path)
), s AS (
  SELECT a.path, sum((d.n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((d.n_convs - 1) * d.words)::BIGINT AS saved_tokens
  FROM (SELECT n_children, n_convs, words, path, unnest(range(0, depth + 1)) AS up FROM k) d JOIN k a ON a.path = substr(d.path, 1, 64 * up::INT) GROUP BY a.path
)
SELECT k.conv_id, k.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, k.ends_sha256
FROM k JOIN s USING (path) LEFT JOIN k u ON k.depth > 0 AND u.path = substr(k.path, 1, 64 * (k.depth - 1)::INT)
"""
