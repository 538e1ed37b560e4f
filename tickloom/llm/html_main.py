"""HTML main text by nearest-URL page differencing.

Pages of a host are ordered by URL path; each is paired with the nearest page, of those that are not its copies, whose
path it shares more of. The text lines
of a pair are aligned by their longest common subsequence and shared lines are deleted, inside articles too. Tags are a
further filter: lines of menus, forms and other boilerplate elements always go, and where at least half of the text that
is left lies inside article or main elements, so do the lines outside them.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import cut, discard
from tickloom.llm.url_filter import url_parts

#: A pair that shares at least this share of the characters of both is of copies, whose lines are not boilerplate.
COPIES = 0.8
#: Lines at an article's ends that two neighbours share, from which on they are a template's; licences of two lines are texts.
TEMPLATE_LINES = 3
#: Pages of a range that one task holds, as line hashes.
RANGE_PAGES = 20_000

# Elements by how they are read, and the words of class, id and role that mark boilerplate.
RAW = frozenset("script style noscript template textarea title iframe svg object canvas audio video".split())
DROPPED = frozenset("nav header footer aside form dialog menu button select head".split())
MAIN = frozenset(("article", "main"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
MARKS = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion sidebar widget cookie cookies consent gdpr notice "
    "popup modal overlay newsletter subscribe signup comment comments respond disqus related recommended share sharing social breadcrumb "
    "breadcrumbs pagination pager menu nav navbar navigation navigationbar footer masthead toolbar login search complementary contentinfo".split()
)
_TAG = re.compile(r"<(?:!--(?P<comment>.*?)(?:-->|\Z)|[!?][^>]*+>?|/(?P<end>[A-Za-z][A-Za-z0-9:-]*+)[^>]*+>?|(?P<start>[A-Za-z][A-Za-z0-9:-]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<open>[A-Za-z][A-Za-z0-9:-]*+)(?P<loose>[^>]*+)>?)", re.DOTALL)
_MARKED = re.compile(r"(?:^|[\s\"'])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_RAW_ENDS = {name: re.compile(f"</{name}", re.IGNORECASE) for name in RAW}
_H1 = re.compile(r"<h1\b[^>]*+>(.*?)</h1", re.IGNORECASE | re.DOTALL)
_MARKUP = re.compile(r"<[^>]*+>?")
#: Elements that no mark and no form may take along.
HELD = frozenset(("article", "main", "h1"))
TITLED = frozenset("h1 h2 h3 h4 h5 h6 section".split())


def _is_marked(name: str, attributes: str, in_main: bool) -> bool:
    """Whether a token of class, id or role is a mark, or only marks joined by hyphens; an article's ids name its parts."""
    for value in _MARKED.finditer(attributes):
        if in_main and name in TITLED and value.group(1).lower() == "id":
            continue
        for token in (value.group(2) or value.group(3) or value.group(4) or "").lower().split():
            words = [w for w in re.split(r"[-_]+|[0-9]+", token) if w]
            if (words and MARKS.issuperset(words)) or (not in_main and token == "header"):
                return True
    return re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attributes) is not None


def _tags(html: str) -> tuple[list[tuple[int, int, str, str, str]], dict[int, int]]:
    """All tags as (start, end, started name, ended name, attributes), raw contents passed over, and the tag that ends each element that has one."""
    tags: list[tuple[int, int, str, str, str]] = []
    ends: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    at = 0
    while m := _TAG.search(html, at):
        name, end = (m.group("start") or m.group("open") or "").lower(), (m.group("end") or "").lower()
        attributes = (m.group("rest") or m.group("loose") or "") if name else ""
        tags.append((m.start(), m.end(), name, end, attributes))
        at = m.end()
        if name in RAW:
            if not attributes.endswith("/"):
                close = _RAW_ENDS[name].search(html, at)
                tags[-1] = (m.start(), close.start() if close else len(html), name, end, attributes)
                at = tags[-1][1]
        elif name and name not in VOID:
            waiting.setdefault(name, []).append(len(tags) - 1)
        elif end and waiting.get(end):
            ends[waiting[end].pop()] = len(tags) - 1
    return tags, ends


def lines(html: str) -> list[tuple[str, str]]:
    """(zone, line) of all text blocks in page order; zones: main, free and dropped."""
    out: list[tuple[str, str]] = []
    held: list[str] = []
    tags, ends = _tags(html)
    holders = [i for i, tag in enumerate(tags) if tag[2] in HELD]
    inside, skipped, at = 0, -1, 0  # skipped: the tag up to which all is dropped

    def flush() -> None:
        text = " ".join(unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(("dropped" if skipped >= 0 else "main" if inside else "free", text))

    def holds(i: int, last: int) -> bool:
        k = bisect_right(holders, i)
        return k < len(holders) and holders[k] < last

    for i, (start, stop, name, end, attributes) in enumerate(tags):
        held.append(html[at:start])
        at = stop
        if name:
            if name in BLOCKS:
                flush()
            if name in RAW or skipped >= 0 or name in VOID:
                continue
            # Without its end it would swallow the page; only a footer may run to the end.
            last = ends.get(i, len(tags) if name == "footer" else -1)
            by_name = name in DROPPED and not (name == "header" and inside) and not (name == "form" and holds(i, last))
            marked = name not in ("html", "body", "h1") and attributes and _is_marked(name, attributes, inside > 0)
            if last >= 0 and (by_name or (marked and not holds(i, last))):
                flush()
                skipped = last
            elif name in MAIN:
                inside += 1
        elif end:
            if end in BLOCKS:
                flush()
            if i == skipped:
                flush()
                skipped = -1
            elif skipped < 0 and end in MAIN:
                inside = max(0, inside - 1)
    held.append(html[at:])
    flush()
    return out


def _lengths(a: list[int], b: list[int]) -> list[int]:
    """Length of the longest common subsequence of b and each start of a, in memory linear in a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
    lengths = [0]
    for bit in reversed(f"{row:0{len(a)}b}" if a else ""):
        lengths.append(lengths[-1] + (bit == "0"))
    return lengths


def _by_halves(a: list[int], b: list[int]) -> set[int]:
    """Positions of a in a longest common subsequence, by halving b so that no table of rows is kept."""
    found: set[int] = set()
    work = [(0, len(a), 0, len(b))]
    while work:
        a0, a1, b0, b1 = work.pop()
        if a0 == a1 or b0 == b1:
            continue
        if b1 - b0 == 1:
            at = next((i for i in range(a0, a1) if a[i] == b[b0]), None)
            if at is not None:
                found.add(at)
            continue
        half = (b0 + b1) // 2
        left, right = _lengths(a[a0:a1], b[b0:half]), _lengths(a[a0:a1][::-1], b[half:b1][::-1])
        total = [x + y for x, y in zip(left, reversed(right), strict=True)]
        split = a0 + total.index(max(total))
        work += [(a0, split, b0, half), (split, a1, half, b1)]
    return found


def shared_lines(a: list[int], b: list[int]) -> set[int]:
    """Positions of a in a longest common subsequence of both: equal starts and ends, and what halving finds between."""
    most = min(len(a), len(b))
    head = next((i for i in range(most) if a[i] != b[i]), most)
    tail = next((i for i in range(most - head) if a[-1 - i] != b[-1 - i]), most - head)
    same = {*range(head), *range(len(a) - tail, len(a))}
    common = set(a[head : len(a) - tail]) & set(b[head : len(b) - tail])
    at = [i for i in range(head, len(a) - tail) if a[i] in common]
    right = [x for x in b[head : len(b) - tail] if x in common]
    return same | {at[i] for i in _by_halves([a[i] for i in at], right)}


def _hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "replace")) - (1 << 63)


def _content(hashes: list[int], sizes: list[int]) -> dict[int, int]:
    """Length by hash of the distinct lines that no tag drops."""
    return {h: n for h, n in zip(hashes, sizes, strict=True) if n}


def _undropped(page: dict) -> list[int]:
    """Hashes of a page's lines in their order, without those that tags drop anyhow."""
    return [h for h, n in zip(page["hashes"], page["sizes"], strict=True) if n]


def are_copies(a: dict[int, int], b: dict[int, int]) -> bool:
    """Whether the shared lines hold at least COPIES of the characters of both pages' lines together."""
    same = sum(n for h, n in a.items() if h in b)
    return same >= COPIES * (sum(a.values()) + sum(b.values()) - same)


def headline(html: str, found: list[tuple[str, str]]) -> str | None:
    """The line of the first h1 that no tag drops; without one, the article's first line."""
    kept = {line for zone, line in found if zone != "dropped"}
    for m in _H1.finditer(html):
        text = " ".join(unescape(_MARKUP.sub("", m.group(1))).split())
        if text in kept:
            return text
    return next((line for zone, line in found if zone == "main"), None)


def main_lines(html: str, other: list[int] | None, third: list[int] | None = None) -> list[str]:
    """Main text of a page, given the line hashes of two neighbours that are not its copies.

    A neighbour that has the page's headline is a version of it, and is not compared. Outside articles the lines shared
    with the nearer neighbour go; where these are half of the page's text, the pair alone cannot tell a partial copy
    from boilerplate, and only lines that both neighbours share go. An article's own lines go only if both neighbours
    share them, they stand before its first or after its last line that isn't shared, as a template's lines do, and there
    are TEMPLATE_LINES of them at least; its headline never goes.
    """
    found = lines(html)
    own = [_hash(line) for _, line in found]
    title = headline(html, found)
    near = [x for x in (other, third) if x and (title is None or _hash(title) not in x)]
    shared = [shared_lines(own, x) for x in near]
    both = shared[0] & shared[1] if len(shared) == 2 else set()
    gone = shared[0] if shared else set()
    text = sum(len(line) for zone, line in found if zone != "dropped")
    same = sum(len(line) for i, (zone, line) in enumerate(found) if zone != "dropped" and i in gone)
    if len(shared) == 2 and 2 * same >= text:
        gone = both
    article = [i for i, (zone, line) in enumerate(found) if zone == "main"]
    unshared = [i for i in article if i not in both and found[i][1] != title]
    ends = {i for i in article if i in both and unshared and not unshared[0] <= i <= unshared[-1] and found[i][1] != title}
    ends = ends if len(ends) >= TEMPLATE_LINES else set()  # articles share a line or two by chance
    gone = {i for i in (gone - {*article}) | ends if found[i][1] != title}
    kept = [(zone, line) for i, (zone, line) in enumerate(found) if zone != "dropped" and i not in gone]
    inside = [line for zone, line in kept if zone == "main"]
    # What lies outside the article is not its text, unless it is more: then the article is but a card on the page.
    if 2 * sum(map(len, inside)) >= sum(len(line) for _, line in kept):
        return inside
    return [line for _, line in kept]


def _described(pages: DataFrame) -> DataFrame:
    """page_id, host, path, and hashes and sizes of all lines; the size of a dropped line is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [lines(h or "") for h in batch.column("html").to_pylist()]
            hashes = pa.array([[_hash(line) for _, line in x] for x in found], pa.list_(pa.int64()))
            sizes = pa.array([[0 if zone == "dropped" else len(line) for zone, line in x] for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), batch.column("path"), hashes, sizes], ["page_id", "host", "path", "hashes", "sizes"])

    host, path = url_parts(F.col("url"))
    kind = pages.select("page_id").dtypes[0][1]
    return pages.select("page_id", host.alias("host"), path.alias("path"), "html").mapInArrow(run, f"page_id {kind}, host string, path string, hashes array<long>, sizes array<int>")


class _Walk:
    """Pages in one direction of the order: the nearest ones so far that are not copies of the next.

    Of each run of copies of its first page the first and the last are kept, so that a group of copies is passed in two
    looks. ``ahead`` has the pages kept before the walk began, in its order.
    """

    def __init__(self, ahead: list[dict] = ()):
        self.runs: list[list[dict]] = []
        for page in ahead:
            self.add(page)

    def add(self, page: dict) -> None:
        if self.runs and self.runs[-1][0]["host"] != page["host"]:
            self.runs = []
        if self.runs and are_copies(self.runs[-1][0]["content"], page["content"]):
            self.runs[-1][1] = page
        else:
            self.runs.append([page, page])

    def nearest(self, page: dict) -> list[dict]:
        """At most two pages, the nearest first, that are no copies of the page or each other."""
        found: list[dict] = []
        if self.runs and self.runs[-1][0]["host"] == page["host"]:
            for x in (x for first, last in reversed(self.runs) for x in (last, first)):
                if not any(are_copies(x["content"], y["content"]) for y in (page, *found)):
                    found.append(x)
                    if len(found) == 2:
                        break
        return found

    def kept(self) -> list[dict]:
        """Of the last three runs the first and last pages: first ones in a row are no copies of each other."""
        return [page for run in self.runs[-3:] for page in run]


def _pages(batch: pa.Table) -> list[dict]:
    rows = sorted(batch.to_pylist(), key=lambda r: ((r["host"]).encode(), r["path"].encode("utf-8", "surrogatepass"), r["page_id"]))
    for r in rows:
        r["content"] = _content(r["hashes"], r["sizes"])
    return [r for r in rows if r["content"]]


def _alike(a: str, b: str) -> int:
    """1 more than the length of the common start of two paths."""
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n) + 1


def neighbours(pages: DataFrame) -> DataFrame:
    """page_id, other and third of pages(page_id, host, path, hashes, sizes): lines of the nearest pages of its host that are no copies of it.

    They are looked for on both sides of the order by path; other is the one that shares more of the path, and third is
    no copy of other. Pages are dealt by ranges of (host, path) of about RANGE_PAGES, so that a large host lies in many
    tasks. Six pages of each end of a range at most go on to the next ranges of their host, as rows: they are passed
    along in the order of ranges, and each range is joined with those that reach it. Pages without text neither need nor
    help others.
    """
    kinds = dict(pages.dtypes)
    columns = ["host", "path", "page_id", "hashes", "sizes"]
    wanted = pages.filter("host <> '' AND page_id IS NOT NULL AND path IS NOT NULL").select(*columns)
    ranges = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), wanted.count() // RANGE_PAGES)
    rows = cut(wanted.repartitionByRange(ranges, "host", "path", "page_id").withColumn("part", F.spark_partition_id()))
    schema = pa.schema([("part", pa.int32()), ("side", pa.int32()), ("at", pa.int32()), ("host", pa.string()), ("path", pa.string()), ("hashes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32()))])
    said = "part int, side int, at int, host string, path string, hashes array<long>, sizes array<int>"

    def ends(key: tuple, batch: pa.Table) -> pa.Table:
        found = _pages(batch)
        out = []
        for side, order in enumerate((found, found[::-1])):
            walk = _Walk()
            for page in order:
                walk.add(page)
            out += [{"part": key[0].as_py(), "side": side, "at": at} | {c: page[c] for c in ("host", "path", "hashes", "sizes")} for at, page in enumerate(walk.kept())]
        return pa.Table.from_pylist(out, schema)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, now = _Walk(), None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if now != (r["host"], r["side"]):
                    walk, now = _Walk(), (r["host"], r["side"])
                if r["hashes"] is None:  # a range that this host reaches
                    out += [{"part": r["part"], "side": r["side"], "at": at} | {c: p[c] for c in ("host", "path", "hashes", "sizes")} for at, p in enumerate(walk.kept())]
                else:
                    walk.add(r | {"content": _content(r["hashes"], r["sizes"])})
            yield pa.RecordBatch.from_pylist(out, schema)

    edge = cut(rows.groupBy("part").applyInArrow(ends, said))
    # The first host of a range is the last one of its backward side, and the other way round.
    reached = edge.filter("at = 0").select("part", (1 - F.col("side")).alias("side"), F.lit(-1).alias("at"), "host", *(F.lit(None).cast(k).alias(c) for c, k in (("path", "string"), ("hashes", "array<long>"), ("sizes", "array<int>"))))
    along = F.when(F.col("side") == 0, F.col("part")).otherwise(-F.col("part"))
    passed = edge.union(reached).repartition("host", "side").sortWithinPartitions("host", "side", along, "at").mapInArrow(carry, said)

    def run(key: tuple, batch: pa.Table, known: pa.Table) -> pa.Table:
        found = _pages(batch)
        before = [r | {"content": _content(r["hashes"], r["sizes"])} for r in sorted(known.to_pylist(), key=lambda r: r["at"])]
        sides = []
        for side, order in enumerate((found, found[::-1])):
            walk, near = _Walk([r for r in before if r["side"] == side]), []
            for page in order:
                near.append(walk.nearest(page))
                walk.add(page)
            sides.append(near)
        out: list[tuple] = []
        for page, b, a in zip(found, sides[0], sides[1][::-1], strict=True):
            if not b or (a and _alike(page["path"], a[0]["path"]) > _alike(page["path"], b[0]["path"])):
                b, a = a, b
            if b:
                third = next((x for x in a + b[1:] if not are_copies(x["content"], b[0]["content"])), None)
                out.append((page["page_id"], _undropped(b[0]), _undropped(third) if third else None))
        ids, others, thirds = zip(*out, strict=True) if out else ((), (), ())
        lists = pa.list_(pa.int64())
        return pa.Table.from_arrays([pa.array(ids, batch.schema.field("page_id").type), pa.array(others, lists), pa.array(thirds, lists)], ["page_id", "other", "third"])

    return rows.groupBy("part").cogroup(passed.groupBy("part")).applyInArrow(run, f"page_id {kinds['page_id']}, other array<long>, third array<long>")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html).

    Null and empty pages have an empty text. Pages without a host, or alone in theirs, have no neighbour and lose only
    marked boilerplate. Of rows with one page_id the least (host, path, lines) takes part in pairing, and each row is
    extracted. An empty table gives an empty result; other columns are not read.
    """
    described = cut(_described(pages))
    single = described.groupBy("page_id").agg(F.min(F.struct("host", "path", "hashes", "sizes")).alias("x")).select("page_id", "x.*")
    near = neighbours(single)
    discard(described)  # neighbours() has written what it needs of it
    kind = pages.select("page_id").dtypes[0][1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["\n".join(main_lines(h or "", o, t)) for h, o, t in zip(*(batch.column(c).to_pylist() for c in ("html", "other", "third")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([*map(len, texts)], pa.int64())], ["page_id", "url", "text", "n_chars"])

    joined = pages.select("page_id", "url", "html").join(near, "page_id", "left")
    return joined.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
