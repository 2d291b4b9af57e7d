"""Media columns: Matroska files with one 8-bit PCM track, written and parsed element by element.

The parser reads variable-length EBML elements, clusters, lacing and cues into a packet
table: track, timestamp, key flag and byte range of every frame. It takes any bytes: an element
that can't be read ends its parent, a block that can't be read has no frames, and clusters of
unknown size (live recordings) end where the next element of the segment begins.

Nulls: a null text counts as empty (64 zero bytes of payload); a null id is carried. Equal
texts give equal files. Repeated rows are processed one by one; extra columns are ignored.
Texts of any length are stored whole. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from vigilake.llm.common import map_rows, table

#: Element ids of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, FLAG_LACING = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x9C
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DEFAULT_DURATION = 0x23E383
#: Children of a segment, which end a cluster of unknown size: besides those above, seek head, chapters, attachments and tags.
OF_SEGMENT = frozenset({INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367})
#: Elements that hold elements.
PARENTS = frozenset({SEGMENT, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS, TRACKS, TRACK_ENTRY, AUDIO, EBML, INFO})

RATE = 8000  # samples (bytes) per second
FRAME = 800  # bytes of a frame: 100 ms
FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8, 16
PAD = 64
LATEST = 1 << 61  # of timestamps in ms, whatever a damaged file says


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer; all ones is kept for 'unknown'."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def read_vint(data: bytes, at: int) -> tuple[int, int, bool]:
    """Value, offset behind it, and whether it is the unknown size."""
    width = 9 - data[at].bit_length()
    if width > 8:
        raise ValueError("EBML size of more than 8 bytes")
    value = int.from_bytes(data[at : at + width], "big") ^ (1 << 7 * width)
    return value, at + width, value == (1 << 7 * width) - 1


def element(tag: int, body: bytes | int) -> bytes:
    if isinstance(body, int):
        body = body.to_bytes(max(1, (body.bit_length() + 7) // 8), "big")
    return tag.to_bytes((tag.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def _lace(frames: list[bytes]) -> tuple[int, bytes]:
    """Flag bits and body of a block: one frame plain, equal frames fixed-size, others EBML lacing."""
    if len(frames) == 1:
        return 0x00, frames[0]
    count = bytes([len(frames) - 1])
    if len({len(f) for f in frames}) == 1:
        return 0x04, count + b"".join(frames)
    sizes = vint(len(frames[0]))
    for a, b in zip(frames, frames[1:-1], strict=False):
        d = len(b) - len(a)
        width = next(w for w in range(1, 9) if abs(d) < 1 << 7 * w - 1)
        sizes += vint(d + (1 << 7 * width - 1) - 1, width)
    return 0x06, count + sizes + b"".join(frames)


def _unlace(flags: int, data: bytes, at: int, end: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose body is data[at:end]."""
    kind = flags & 0x06
    if not kind:
        return [(at, end)]
    n, at = data[at] + 1, at + 1
    if kind == 0x04:
        size = (end - at) // n
        sizes = [size] * n
    elif kind == 0x06:
        size, at, _ = read_vint(data, at)
        sizes = [size]
        for _ in range(n - 2):
            width = 9 - data[at].bit_length()
            d, at, _ = read_vint(data, at)
            sizes.append(sizes[-1] + d - ((1 << 7 * width - 1) - 1))
        sizes = sizes[: n - 1]
    else:  # Xiph lacing: bytes of 255 and a smaller one
        sizes = []
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    if kind != 0x04:
        sizes.append(end - at - sum(sizes))
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    return out


def write_mkv(payload: bytes) -> bytes:
    """A Matroska file whose only track holds the payload as unsigned 8-bit mono samples."""
    head = element(EBML, element(DOCTYPE, b"matroska") + element(DOCTYPE_VERSION, 4) + element(DOCTYPE_READ_VERSION, 2))
    duration = np.array(len(payload) * 1000 / RATE, ">f8").tobytes()
    info = element(INFO, element(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, duration) + element(MUXING_APP, b"vigilake") + element(WRITING_APP, b"vigilake"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, np.array(RATE, ">f8").tobytes()) + element(CHANNELS, 1) + element(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, element(TRACK_NUMBER, 1) + element(TRACK_UID, 1) + element(TRACK_TYPE, 2) + element(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio))
    body, cues = [info, tracks], []
    at, step = len(info) + len(tracks), FRAME * FRAMES_PER_BLOCK
    for c in range(0, len(payload), step * BLOCKS_PER_CLUSTER):
        start = c * 1000 // RATE
        blocks = [element(TIMESTAMP, start)]
        for b in range(c, min(c + step * BLOCKS_PER_CLUSTER, len(payload)), step):
            piece = payload[b : b + step]
            flags, laced = _lace([piece[f : f + FRAME] for f in range(0, len(piece), FRAME)])
            rel = b * 1000 // RATE - start
            blocks.append(element(SIMPLE_BLOCK, vint(1) + rel.to_bytes(2, "big", signed=True) + bytes([0x80 | flags]) + laced))
        cues.append(element(CUE_POINT, element(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, element(CUE_TRACK, 1) + element(CUE_CLUSTER_POSITION, at))))
        body.append(element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


def _head(data: bytes, at: int, end: int) -> tuple[int, int, int, bool] | None:
    """Id, body start, size and whether it is unknown, of the element at ``at``; None if there is none."""
    width = 9 - data[at].bit_length()
    if width > 4 or at + width >= end or at + width + 9 - data[at + width].bit_length() > end or not data[at + width]:
        return None
    size, start, unknown = read_vint(data, at + width)
    return int.from_bytes(data[at : at + width], "big"), start, size, unknown


def walk(data: bytes):
    """(id, body start, body end, depth) of every element, parents before children."""
    open_ = [(len(data), 0, False)]  # end, id, of unknown size
    at = 0
    while at < len(data):
        while at >= open_[-1][0]:
            open_.pop()
        head = _head(data, at, open_[-1][0])
        if head is None:  # not an element: the rest of its parent is damaged
            at = open_[-1][0]
            continue
        tag, start, size, unknown = head
        if tag in OF_SEGMENT or tag in (SEGMENT, EBML):
            while open_[-1][2] and (open_[-1][1] != SEGMENT or tag in (SEGMENT, EBML)):
                open_.pop()
        stop = open_[-1][0] if unknown else min(open_[-1][0], start + size)
        yield tag, start, stop, len(open_) - 1
        at = stop
        if tag in PARENTS and start < stop:
            open_.append((stop, tag, unknown))
            at = start


def _frames(data: bytes, start: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]] | None:
    """Track, relative time, flags and frames of a block; None if it is damaged."""
    try:
        track, at, _ = read_vint(data, start)
        if at + 3 > end:
            return None
        ranges = _unlace(data[at + 2], data, at + 3, end)
    except (IndexError, ValueError):
        return None
    if any(not at <= a <= b <= end for a, b in ranges):
        return None
    return track, int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2], ranges


def _float(data: bytes) -> float:
    value = float(np.frombuffer(data, f">f{len(data)}")[0]) if len(data) in (4, 8) else 0.0
    return value if np.isfinite(value) and value > 0 else 0.0


def packets(data: bytes) -> tuple[list[tuple[int, int, bool, int, int]], list[tuple[int, int]], str]:
    """The packet table (track, timestamp in ms, key, start, end), the cues (time, cluster offset) and the codec.

    Frames of one lace follow each other by the bytes of PCM tracks, at their own frequency, depth and channels, else by the
    track's default duration.
    """
    table_, cues, codec = [], [], ""
    cluster_at, time, scale, base = 0, 0, 1_000_000, 0
    tracks: dict[int, dict] = {}
    mine: dict = {}
    number = lambda a, b: int.from_bytes(data[a : min(b, a + 8)], "big")
    for tag, start, end, _ in walk(data):
        if tag == SEGMENT:
            base = start
        elif tag == TIMESTAMP_SCALE:
            scale = number(start, end)
        elif tag == TRACK_ENTRY:
            mine = {"codec": "", "rate": 8000.0, "channels": 1, "bits": 0, "lasts": 0}
        elif tag == TRACK_NUMBER:
            tracks[number(start, end)] = mine
        elif tag == CODEC_ID:
            codec = mine["codec"] = data[start:end].decode("ascii", "replace")
        elif tag == SAMPLING_FREQUENCY:
            mine["rate"] = _float(data[start:end])
        elif tag == CHANNELS:
            mine["channels"] = number(start, end)
        elif tag == BIT_DEPTH:
            mine["bits"] = number(start, end)
        elif tag == DEFAULT_DURATION:
            mine["lasts"] = number(start, end)
        elif tag == TIMESTAMP:
            cluster_at = number(start, end)
        elif tag in (SIMPLE_BLOCK, BLOCK) and (block := _frames(data, start, end)):
            track, rel, flags, ranges = block
            t = tracks.get(track, {})
            each_second = t.get("rate", 0) * t.get("channels", 0) * t.get("bits", 0) / 8 if t.get("codec", "").startswith("A_PCM") else 0
            begin, first = ranges[0][0], max(-LATEST, min(LATEST, (cluster_at + rel) * scale // 1_000_000))
            for k, (a, b) in enumerate(ranges):
                later = (a - begin) * 1000 / each_second if each_second else k * t.get("lasts", 0) // 1_000_000
                table_.append((track, first + int(min(later, LATEST)), bool(flags & 0x80), a, b))
        elif tag == CUE_TIME:
            time = number(start, end)
        elif tag == CUE_CLUSTER_POSITION:
            cues.append((time, base + number(start, end)))
    return table_, cues, codec


def seek(data: bytes, ms: int) -> list[tuple[int, int, bool, int, int]]:
    """Packets from the cluster of the last cue at or before ``ms`` on; all of them without such a cue."""
    rows, cues, _ = packets(data)
    at = max((at for time, at in cues if time <= ms), default=0)
    return [r for r in rows if r[3] >= at]


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    n = max(PAD, -(-len(raw) // PAD) * PAD)
    return raw.ljust(n, b"\0"), len(raw)


def media_column(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): the text's bytes stored as a Matroska file."""
    def make():
        def work(batch):
            made = [payload_of(t) for t in batch["text"]]
            return {"doc_id": batch["doc_id"], "n_bytes": [n for _, n in made], "media": [write_mkv(p) for p, _ in made]}

        return work

    return map_rows(df.selectExpr(f"`{key}` AS doc_id", f"`{text}` AS text"), "doc_id long, n_bytes long, media binary", make)


def packet_table(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per frame of every file: doc_id, packet, track, ts_ms, key, byte_start, byte_end. A null file has none."""
    def make():
        def work(batch):
            out: dict[str, list] = {k: [] for k in ("doc_id", "packet", "track", "ts_ms", "key", "byte_start", "byte_end")}
            for doc, data in zip(batch["doc_id"], batch["media"], strict=True):
                for k, row in enumerate(packets(bytes(data or b""))[0]):
                    for name, v in zip(out, (doc, k, *row), strict=True):
                        out[name].append(v)
            return out

        return work

    schema = "doc_id long, packet int, track long, ts_ms long, key boolean, byte_start long, byte_end long"
    return map_rows(df.selectExpr("doc_id", f"`{media}` AS media"), schema, make)


def read_back(df: DataFrame) -> DataFrame:
    """Digests and features of (doc_id, n_bytes, media), all from the stored bytes."""
    def make():
        def work(batch):
            out: dict[str, list] = {k: [] for k in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
            for data in batch["media"]:
                data = bytes(data or b"")
                rows, cues, codec = packets(data)
                payload = b"".join([data[a:b] for _, _, _, a, b in rows])
                wave = np.frombuffer(payload or b"\0", np.uint8).astype(np.int32)
                mean, moved = float(wave.mean()), int(np.abs(np.diff(wave)).sum())
                out["payload_bytes"].append(len(payload))
                out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
                out["tail_crc32"].append(zlib.crc32(payload[-PAD:]))
                out["media_bytes"].append(len(data))
                out["media_sha256"].append(hashlib.sha256(data).hexdigest())
                out["feature"].append(
                    f"{codec};packets={len(rows)};cues={len(cues)};ms={len(payload) * 1000 // RATE};mean={mean:.4f};"
                    f"std={float(wave.std()):.4f};step={moved / max(1, len(payload) - 1):.4f}"
                )
            return {"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], **out}

        return work

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_rows(df, schema, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9 over all documents."""
    return read_back(media_column(table(spark, sf_dir, "documents", "doc_id", "text")))
