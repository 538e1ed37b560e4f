"""TIFF columns: one row per page of every image, decoded from its directories, strips or tiles.

Supported: both byte orders, several pages, 8-bit samples (one or more a pixel, chunky), strips and tiles, no
compression, PackBits, LZW and deflate, horizontal differencing. Work is done inside tasks, a file at a time.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE, LZW, DEFLATE, PACKBITS = 1, 5, 8, 32773
OLD_DEFLATE = 32946
#: Payloads are stored in lines of so many samples, and so many lines a strip or tile.
WIDTH, BAND = 64, 64

# Tag numbers, and bytes of the field types.
TAGS = {"width": 256, "height": 257, "bits": 258, "compression": 259, "photometric": 262, "offsets": 273, "samples": 277, "rows": 278, "counts": 279, "planar": 284, "predictor": 317, "tile_width": 322, "tile_height": 323, "tile_offsets": 324, "tile_counts": 325}
TYPE_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_NAMES = {v: k for k, v in TAGS.items()}
_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)

PAGE = "page int, width int, height int, samples int, compression int, predictor int, tiled boolean, pixels binary, error string"


def pack_bits(data: bytes) -> bytes:
    """Runs of three to 128 equal bytes as pairs, everything else literally."""
    out, last = bytearray(), 0
    for start, end, value in [*((m.start(), m.end(), m.group(1)) for m in _RUN.finditer(data)), (len(data), len(data), b"")]:
        for at in range(last, start, 128):
            piece = data[at : min(at + 128, start)]
            out.append(len(piece) - 1)
            out += piece
        if value:
            out.append(257 - (end - start))
            out += value
        last = end
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first, widened one code early, as TIFF has them."""
    first = {bytes([b]): b for b in range(256)}
    table, following, n, out, word = dict(first), 258, 9, bytearray(), b""
    bits, held = 0, 0

    def put(code: int) -> None:
        nonlocal bits, held
        bits = (bits << n) | code
        held += n
        while held >= 8:
            held -= 8
            out.append((bits >> held) & 255)
        bits &= (1 << held) - 1

    put(256)
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = following
        following += 1
        if following == 4095:
            put(256)
            table, following, n = dict(first), 258, 9
        elif following == 1 << n:
            n += 1
        word = data[i : i + 1]
    if word:
        put(table[word])
        following += 1
        if following == 1 << n and n < 12:
            n += 1
    put(257)
    if held:
        out.append((bits << (8 - held)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    start = [bytes([b]) for b in range(256)] + [b"", b""]
    table, out, n, bits, held, before, made = list(start), [], 9, 0, 0, b"", 0
    for byte in data:
        bits = ((bits << 8) | byte) & 0xFFFFFF
        held += 8
        if held < n:
            continue
        held -= n
        code = (bits >> held) & ((1 << n) - 1)
        if code == 257:
            break
        if code == 256:
            table, n, before = list(start), 9, b""
            continue
        if not before:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code beyond the table")
            entry = table[code] if code < len(table) else before + before[:1]
            table.append(before + entry[:1])
            if len(table) >= (1 << n) - 1 and n < 12:
                n += 1
        out.append(entry)
        made += len(entry)
        before = entry
        if made >= size:
            break
    return b"".join(out)


def _compressed(data: bytes, how: int) -> bytes:
    if how == PACKBITS:
        return pack_bits(data)
    if how == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 3) if how in (DEFLATE, OLD_DEFLATE) else data


#: Bytes that one stored byte can stand for at most, by compression.
EXPANDS = {NONE: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}
#: Samples of a page at most: what a binary value can hold.
MOST_SAMPLES = 2**31 - 1


def _expanded(data: bytes, how: int, size: int) -> bytes:
    if not size:
        return b""
    if how == PACKBITS:
        return unpack_bits(data, size)
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if how != NONE:
        raise ValueError(f"compression {how} is not supported")
    return data


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tiled: bool = False, order: str = "<", band: int = BAND) -> bytes:
    """A TIFF of 8-bit pages (height, width, samples); tiles are band x band, strips band lines high."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        height, width, samples = page.shape
        blocks = []
        if tiled:
            padded = np.pad(page, ((0, -height % band), (0, -width % band), (0, 0)))
            blocks = [padded[y : y + band, x : x + band] for y in range(0, max(height, 1), band) for x in range(0, max(width, 1), band)]
        else:
            blocks = [page[y : y + band] for y in range(0, max(height, 1), band)]
        if predictor == 2:
            blocks = [np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1) for b in blocks]
        data = [_compressed(b.tobytes(), compression) for b in blocks]
        places = []
        for d in data:
            places.append(len(out))
            out += d + b"\0" * (len(d) % 2)
        fields = {"width": width, "height": height, "bits": [8] * samples, "compression": compression, "photometric": 2 if samples == 3 else 1, "samples": samples, "planar": 1, "predictor": predictor}
        fields |= {"tile_width": band, "tile_height": band, "tile_offsets": places, "tile_counts": [*map(len, data)]} if tiled else {"offsets": places, "rows": band, "counts": [*map(len, data)]}
        entries = []
        for name, value in sorted(fields.items(), key=lambda x: TAGS[x[0]]):
            values = value if isinstance(value, list) else [value]
            short = name in ("bits", "compression", "photometric", "samples", "planar", "predictor")
            packed = struct.pack(f"{order}{len(values)}{'H' if short else 'I'}", *values)
            if len(packed) > 4:
                entries.append((TAGS[name], 3 if short else 4, len(values), struct.pack(order + "I", len(out))))
                out += packed + b"\0" * (len(packed) % 2)
            else:
                entries.append((TAGS[name], 3 if short else 4, len(values), packed.ljust(4, b"\0")))
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(struct.pack(order + "HHI", *e[:3]) + e[3] for e in entries) + b"\0" * 4
        link = len(out) - 4
    return bytes(out)


def _directory(data: bytes, order: str, at: int) -> tuple[dict[str, list[int]], int]:
    """The known fields of the directory at ``at``, and where the next one lies."""
    (n,) = struct.unpack_from(order + "H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if tag in _NAMES and kind in (1, 3, 4):
            size = TYPE_BYTES[kind] * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
            fields[_NAMES[tag]] = list(struct.unpack_from(f"{order}{count}{' BHI'[1 if kind == 1 else 2 if kind == 3 else 3]}", data, where))
    return fields, struct.unpack_from(order + "I", data, at + 2 + 12 * n)[0]


def _page(data: bytes, f: dict[str, list[int]]) -> tuple:
    width, height, samples = f["width"][0], f["height"][0], f.get("samples", [1])[0]
    how, predictor, tiled = f.get("compression", [NONE])[0], f.get("predictor", [1])[0], "tile_offsets" in f
    if any(b != 8 for b in f.get("bits", [1])) or (samples > 1 and f.get("planar", [1])[0] != 1) or predictor not in (1, 2):
        raise ValueError("only chunky 8-bit samples with predictor 1 or 2 are supported")
    high = f["tile_height"][0] if tiled else min(f.get("rows", [height])[0], max(height, 1))
    wide = f["tile_width"][0] if tiled else width
    across = -(-width // wide) if wide else 1
    stored = list(zip(f["tile_offsets" if tiled else "offsets"], f["tile_counts" if tiled else "counts"], strict=True))
    # Nothing is allocated before the stored bytes are known to be enough for what the directory claims.
    if height * width * samples:
        if not high or not wide or len(stored) < -(-height // high) * across:
            raise ValueError("strips or tiles are missing")
        last = height - (-(-height // high) - 1) * high
        claimed = [(high if tiled or i // across < -(-height // high) - 1 else last) * wide * samples for i in range(-(-height // high) * across)]
        if height * width * samples > MOST_SAMPLES or max(claimed) > MOST_SAMPLES:
            raise ValueError("the page is larger than a value can be")
        if any(size > EXPANDS.get(how, 1) * n for size, (_, n) in zip(claimed, stored, strict=False)):
            raise ValueError("the page claims more samples than its strips or tiles can hold")
    else:
        stored = []
    pixels = np.zeros((height, width, samples), np.uint8)
    for i, (at, n) in enumerate(stored[: -(-height // max(1, high)) * across]):
        y, x = i // across * high, i % across * wide
        lines = high if tiled else min(high, height - y)
        if at + n > len(data):
            raise ValueError("a strip or tile lies beyond the end of the file")
        raw = _expanded(data[at : at + n], how, lines * wide * samples)
        if len(raw) < lines * wide * samples:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(raw, np.uint8, lines * wide * samples).reshape(lines, wide, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        pixels[y : y + lines, x : x + wide] = block[: height - y, : width - x]
    return width, height, samples, how, predictor, tiled, pixels.tobytes(), None


def decode(data: bytes | None) -> list[tuple]:
    """(page, width, height, samples, compression, predictor, tiled, pixels, error) of every page; a fault ends the walk with a row that tells it."""
    rows: list[tuple] = []
    try:
        order = {b"II": "<", b"MM": ">"}[bytes((data or b"")[:2])]
        version, at = struct.unpack_from(order + "HI", data, 2)
        if version != 42:
            raise ValueError("no classic TIFF")
        seen = set()
        while at:
            if at in seen:
                raise ValueError("the directories form a circle")
            seen.add(at)
            fields, at = _directory(data, order, at)
            rows.append((len(rows), *_page(data, fields)))
    except (KeyError, ValueError, IndexError, struct.error, zlib.error) as fault:
        rows.append((len(rows), None, None, None, None, None, None, None, f"{type(fault).__name__}: {fault}"))
    return rows


def tiff_pages(files: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """keep and the columns of PAGE, one row for each page of every file in the binary column ``media``.

    Null, empty and broken files give one row whose error says why; pages before the fault are kept. Repeated rows give
    repeated pages; an empty table gives none. keep must not hold names of PAGE; other columns are not read.
    """
    kinds = dict(files.select(*keep).dtypes)
    names = [c.split()[0] for c in PAGE.split(", ")]
    types = [pa.int32()] * 6 + [pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [(i, *row) for i, data in enumerate(part.column(media).to_pylist()) for row in decode(data)]
                at, *columns = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(at)) for c in keep), *map(pa.array, columns, types)], [*keep, *names])

    return files.select(*keep, media).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), PAGE]))


def payload(text: bytes) -> bytes:
    """The text with zero bytes up to a positive multiple of WIDTH."""
    return text + b"\0" * (-len(text) % WIDTH or (0 if text else WIDTH))


def layout(data: bytes) -> tuple[int, int, bool, str]:
    """Compression, predictor, tiles and byte order by the payload's checksum, so that equal texts are stored alike."""
    n = zlib.crc32(data)
    how = LZW if n % 16 == 0 else PACKBITS if n % 16 < 4 else DEFLATE
    return how, 1 if how == PACKBITS else 1 + n // 16 % 2, bool(n // 32 % 2), "<>"[n // 64 % 2]


def store_texts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """keep, n_bytes and media: the UTF-8 bytes of text (null: none), padded, as a one-page TIFF WIDTH samples wide."""
    kinds = dict(docs.select(*keep).dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = [t or b"" for t in pc.cast(part.column("text"), pa.binary()).to_pylist()]
                media = []
                for text in texts:
                    data = payload(text)
                    how, predictor, tiled, order = layout(data)
                    media.append(encode([np.frombuffer(data, np.uint8).reshape(-1, WIDTH, 1)], how, predictor, tiled, order))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array([*map(len, texts)], pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_bytes long", "media binary"]))


def text_images(docs: DataFrame) -> DataFrame:
    """Digests of every row of docs(doc_id, text), stored as TIFF and read back from the stored bytes."""
    stored = store_texts(docs, ["doc_id"]).withColumns({"media_bytes": F.length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff_pages(stored, ["doc_id", "n_bytes", "media_bytes", "media_sha256"])
    feature = F.concat_ws(";", F.concat_ws("x", "width", "height", "samples"), F.concat(F.lit("compression="), "compression"), F.concat(F.lit("predictor="), "predictor"), F.concat(F.lit("tiled="), "tiled"))
    return pages.select(
        "doc_id",
        "n_bytes",
        F.length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.substring("pixels", -WIDTH, WIDTH)).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        feature.alias("feature"),
    )
