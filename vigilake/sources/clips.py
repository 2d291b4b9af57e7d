"""ML07, F34: a table function from a clip to its stills: the samples of an MP4's first video track, evenly spread.

``frames(content, most)`` gives a row for each of at most ``MOST`` samples: its number, how many there are, its time, the place and
size of its bytes, and whether it can be decoded by itself. A clip that can't be read gives one row with an error and never fails
the others. Only the tables of samples are read, not the samples.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MOST = 12
FRAME = StructType().add("position", "integer").add("total", "integer").add("seconds", "double").add("offset", "long").add("size", "long").add("is_key", "boolean").add("error", "string")
#: Boxes that hold boxes on the way to the tables of samples.
_HOLDERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl")


def spread(total: int, most: int) -> list[int]:
    """Numbers of at most ``most`` of ``total`` samples, both ends included."""
    if total <= most:
        return list(range(total))
    return [0] if most <= 1 else sorted({round(i * (total - 1) / (most - 1)) for i in range(most)})


def boxes(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, start, end) of the boxes in a range; a box that doesn't fit is an error."""
    while at < end:
        if at + 8 > end:
            raise ValueError("a box is cut off")
        size, kind, head = *struct.unpack_from(">I4s", raw, at), 8
        if size == 1:
            if at + 16 > end:
                raise ValueError("a box is cut off")
            size, head = struct.unpack_from(">Q", raw, at + 8)[0], 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError(f"a box {kind.decode('latin-1')} doesn't fit")
        yield kind, at + head, at + size
        at += size


def _tables(raw: bytes, at: int, end: int, out: dict[bytes, tuple[int, int]]) -> None:
    for kind, a, b in boxes(raw, at, end):
        if kind in _HOLDERS:
            _tables(raw, a, b, out)
        else:
            out[kind] = (a, b)


def video_track(raw: bytes) -> dict[bytes, tuple[int, int]]:
    """Places of the tables of the first track whose handler is video."""
    for kind, a, b in boxes(raw, 0, len(raw)):
        if kind == b"moov":
            for name, x, y in boxes(raw, a, b):
                if name == b"trak":
                    out: dict[bytes, tuple[int, int]] = {}
                    _tables(raw, x, y, out)
                    if b"hdlr" in out and raw[out[b"hdlr"][0] + 8 : out[b"hdlr"][0] + 12] == b"vide":
                        return out
    raise ValueError("no video track")


def _numbers(raw: bytes, place: tuple[int, int], kind: str, each: int = 1, skip: int = 4) -> list:
    """Entries of a table box: version and flags, ``skip`` bytes that end with the count, entries."""
    a, b = place
    count = struct.unpack_from(">I", raw, a + skip)[0]
    width = struct.calcsize(">" + kind)
    if a + skip + 4 + count * each * width > b:
        raise ValueError("a table is cut off")
    flat = struct.unpack_from(f">{count * each}{kind}", raw, a + skip + 4)
    return list(flat) if each == 1 else [flat[i : i + each] for i in range(0, len(flat), each)]


def samples(raw: bytes, most: int) -> Iterator[tuple]:
    """(number, total, seconds, offset, size, is_key) of the spread samples."""
    t = video_track(raw)
    need = {b"mdhd", b"stts", b"stsc", b"stsz"} - t.keys()
    if need or not (b"stco" in t or b"co64" in t):
        raise ValueError("a table of samples is missing")
    long = raw[t[b"mdhd"][0]] == 1
    scale = struct.unpack_from(">I", raw, t[b"mdhd"][0] + (20 if long else 12))[0]
    same, total = struct.unpack_from(">II", raw, t[b"stsz"][0] + 4)
    sizes = [] if same else _numbers(raw, t[b"stsz"], "I", skip=8)
    chunks = _numbers(raw, t[b"stco"], "I") if b"stco" in t else _numbers(raw, t[b"co64"], "Q")
    runs = _numbers(raw, t[b"stsc"], "I", 3)
    keys = set(_numbers(raw, t[b"stss"], "I")) if b"stss" in t else None
    times = _numbers(raw, t[b"stts"], "I", 2)
    wanted = set(spread(total, max(1, min(most, MOST))))
    seen, run, clock, left, step, given = 0, 0, 0, 0, 0, iter(times)
    for number, offset in enumerate(chunks, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= number:
            run += 1
        for _ in range(runs[run][1]):
            if seen >= total:
                return
            while left == 0:
                left, step = next(given, (-1, 0))
            size = same or sizes[seen]
            if seen in wanted:
                if offset + size > len(raw):
                    raise ValueError("a sample is cut off")
                yield seen, total, clock / scale if scale else 0.0, offset, size, keys is None or seen + 1 in keys
            seen, clock, left, offset = seen + 1, clock + step, left - 1, offset + size
    if seen < total:
        raise ValueError("chunks hold fewer samples than there are")


@F.udtf(returnType=FRAME)
class frames:  # noqa: N801 - called like a function
    def eval(self, content: bytes, most: int):
        try:
            rows = list(samples(bytes(content or b""), most or MOST))
            if not rows:
                raise ValueError("no samples")
        except (ValueError, struct.error, IndexError) as e:
            yield None, None, None, None, None, None, str(e)
            return
        for r in rows:
            yield *r, None


def packed(parts: list[bytes], fps: int = 25, a_chunk: int = 3, wide: bool = False) -> bytes:
    """An MP4 of one video track whose samples are ``parts``: every tenth a key, ``a_chunk`` samples in a chunk."""
    box = lambda kind, *inner: struct.pack(">I4s", 8 + sum(map(len, inner)), kind) + b"".join(inner)
    full = lambda kind, *inner: box(kind, bytes(4), *inner)
    table = lambda kind, rows, code: full(kind, struct.pack(">I", len(rows)), *[struct.pack(">" + code, *r) for r in rows])
    n = len(parts)
    head = box(b"ftyp", b"isom", bytes(4), b"isom")
    starts, at = [], 0
    for k, p in enumerate(parts):
        if k % a_chunk == 0:
            starts.append(at)
        at += len(p)
    full_chunks, rest = divmod(n, a_chunk)
    runs = ([(1, a_chunk, 1)] if full_chunks else []) + ([(full_chunks + 1, rest, 1)] if rest else [])
    places = [(len(head) + 8 + s,) for s in starts]
    stbl = box(
        b"stbl", full(b"stsd", bytes(4)), table(b"stts", [(n, 1)] if n else [], "2I"), table(b"stsc", runs, "3I"),
        full(b"stsz", struct.pack(">2I", 0, n), *[struct.pack(">I", len(p)) for p in parts]), table(b"stss", [(k + 1,) for k in range(0, n, 10)], "I"),
        table(b"co64", places, "Q") if wide else table(b"stco", places, "I"),
    )
    mdhd = full(b"mdhd", struct.pack(">4I", 0, 0, fps, n), bytes(4))
    track = box(b"trak", full(b"tkhd", bytes(80)), box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", full(b"vmhd", bytes(8)), stbl)))
    sound = box(b"trak", box(b"mdia", full(b"hdlr", bytes(4), b"soun", bytes(13))))
    return head + box(b"mdat", *parts) + box(b"moov", sound, track)
