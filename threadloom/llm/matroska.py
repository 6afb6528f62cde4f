"""Media columns: Matroska files as packet tables.

``parse`` walks variable-length EBML elements and gives one packet for each laced frame, with track, timestamp, byte
range, cluster and lacing, and the cue points. ``write`` stores bytes as 8-bit PCM samples in one track, laced eight
frames to a block and with a cue for each cluster; equal bytes give equal files.

Defined results: null or empty media have no packets. Bytes that aren't Matroska, or end too soon, give the packets
before the fault and an error text, never an exception. Repeated rows give repeated packets; an empty table an empty
table. Files are parsed row by row, so memory is bounded by the longest one. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.workers import blocks
from threadloom.runtime import share_code

# Element ids of the public Matroska specification.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, SCALE, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_PARENTS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
_TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

RATE_HZ, FRAME, FRAMES, BLOCKS = 8000, 512, 8, 32


# -- reading ---------------------------------------------------------------------------------------------------------


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """A variable-length integer and where it ends; -1 for an unknown size."""
    first = data[at]
    if not first:
        raise ValueError("integer of more than 8 bytes")
    n = 9 - first.bit_length()
    if at + n > len(data):
        raise ValueError("ends within an integer")
    value = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    """Of a block: track, relative timestamp, lacing, and each frame's start and end."""
    track, at = vint(data, at)
    if at + 3 > end:
        raise ValueError("ends within a block")
    relative, flags = struct.unpack_from(">hB", data, at)
    at, lacing = at + 3, flags >> 1 & 3
    if lacing == NO_LACING:
        return track, relative, lacing, [(at, end)]
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("fixed lacing doesn't fit")
        sizes = [(end - at) // n] * n
    else:
        sizes = []
        for k in range(n - 1):
            if lacing == XIPH:
                size = 0
                while (b := data[at]) == 255:
                    size, at = size + 255, at + 1
                size, at = size + b, at + 1
            else:
                start = at
                size, at = vint(data, at)
                if k:
                    size = sizes[-1] + size - ((1 << 7 * (at - start) - 1) - 1)
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return track, relative, lacing, out


def parse(data: bytes | None) -> dict:
    """``packets`` (track, timestamp, start, end, cluster, lacing), ``cues`` (time, track, cluster position), ``tracks``, ``scale``, ``error``."""
    out: dict = {"packets": [], "cues": [], "tracks": {}, "scale": 1_000_000, "duration": 0.0, "blocks": 0, "error": None, "segment": 0}
    if not data:
        return out
    clusters, base, entry, cue = -1, 0, {}, {}
    stack: list[tuple[int, int]] = [(0, len(data))]  # element and its end; an unknown size ends with its parent or a sibling
    at = 0
    try:
        while at < len(data):
            while len(stack) > 1 and at >= stack[-1][1]:
                stack.pop()
            kind, body = vint(data, at, True)
            size, body = vint(data, body)
            while kind in _TOP and len(stack) > 2:
                stack.pop()
            end = stack[-1][1] if size < 0 else body + size
            if end > len(data):
                raise ValueError("ends within an element")
            value = data[body:end]
            if kind in _PARENTS:
                if kind == SEGMENT:
                    out["segment"] = body
                elif kind == CLUSTER:
                    clusters, base = clusters + 1, 0
                elif kind == TRACK:
                    entry = {}
                elif kind == CUE_POINT:
                    cue = {}
                stack.append((kind, end))
                at = body
                continue
            if kind == TIMESTAMP:
                base = int.from_bytes(value, "big")
            elif kind in (SIMPLE_BLOCK, BLOCK):
                track, relative, lacing, parts = frames(data, body, end)
                out["blocks"] += 1
                rate = out["tracks"].get(track, {}).get("rate")
                for a, b in parts:
                    # frames after the first of a block follow at the track's rate, where it is 8-bit sound: a byte a channel
                    sound = out["tracks"].get(track, {})
                    late = (a - parts[0][0]) * 1e9 / rate / sound.get("channels", 1) / out["scale"] if rate and sound.get("depth") == 8 else 0
                    out["packets"].append((track, base + relative + int(late), a, b, clusters, lacing))
            elif kind == SCALE:
                out["scale"] = int.from_bytes(value, "big")
            elif kind == DURATION:
                out["duration"] = struct.unpack(">d" if len(value) == 8 else ">f", value)[0]
            elif kind == NUMBER:
                out["tracks"][int.from_bytes(value, "big")] = entry
            elif kind == CODEC:
                entry["codec"] = value.decode("ascii", "replace")
            elif kind == RATE:
                entry["rate"] = struct.unpack(">d" if len(value) == 8 else ">f", value)[0]
            elif kind == CHANNELS:
                entry["channels"] = max(1, int.from_bytes(value, "big"))
            elif kind == DEPTH:
                entry["depth"] = int.from_bytes(value, "big")
            elif kind == CUE_TIME:
                cue["time"] = int.from_bytes(value, "big")
            elif kind == CUE_TRACK:
                cue["track"] = int.from_bytes(value, "big")
            elif kind == CUE_CLUSTER:
                out["cues"].append((cue.get("time", 0), cue.get("track", 0), out["segment"] + int.from_bytes(value, "big")))
            at = end
    except (ValueError, IndexError, struct.error) as e:
        out["error"] = str(e) or type(e).__name__
    return out


# -- writing ---------------------------------------------------------------------------------------------------------


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _number(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _block(parts: list[bytes], relative: int, nth: int) -> bytes:
    sizes = list(map(len, parts))
    lacing = NO_LACING if len(parts) == 1 else FIXED if len(set(sizes)) == 1 else XIPH if nth % 2 else EBML_LACING
    head = b"\x81" + struct.pack(">hB", relative, 0x80 | lacing << 1)
    if lacing:
        head += bytes([len(parts) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += _size(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(n - before) < (1 << 7 * w - 1) - 1)
            head += _size(n - before + (1 << 7 * width - 1) - 1, width)
    return _element(SIMPLE_BLOCK, head + b"".join(parts))


def write(payload: bytes) -> bytes:
    """``payload`` as 8-bit samples of one track; lossless."""
    per_block, ms = FRAME * FRAMES, 1000 / RATE_HZ
    head = _element(EBML, _element(DOC_TYPE, b"matroska"))
    info = _element(INFO, _number(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * ms)))
    sound = _element(RATE, struct.pack(">d", RATE_HZ)) + _number(CHANNELS, 1) + _number(DEPTH, 8)
    track = _number(NUMBER, 1) + _number(UID, 1 + zlib.crc32(payload)) + _number(KIND, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, sound)
    made, cues, at = [info, _element(TRACKS, _element(TRACK, track))], b"", 0
    at = sum(map(len, made))
    for c in range(0, len(payload), per_block * BLOCKS):
        base, body = int(c * ms), b""
        for k, b in enumerate(range(c, min(len(payload), c + per_block * BLOCKS), per_block)):
            parts = [payload[i : i + FRAME] for i in range(b, min(len(payload), b + per_block), FRAME)]
            body += _block(parts, int(b * ms) - base, k)
        cues += _element(CUE_POINT, _number(CUE_TIME, base) + _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at)))
        made.append(_element(CLUSTER, _number(TIMESTAMP, base) + body))
        at += len(made[-1])
    made.append(_element(CUES, cues))
    return head + _element(SEGMENT, b"".join(made))


def samples(data: bytes, track: int = 1) -> tuple[bytes, dict]:
    """A track's bytes in order of its packets, and what ``parse`` gives."""
    found = parse(data)
    return b"".join([data[a:b] for t, _, a, b, _, _ in found["packets"] if t == track]), found


def feature(sound: bytes, found: dict) -> str:
    """Counts of the packet table and simple statistics of the samples."""
    x = np.frombuffer(sound, np.uint8).astype(np.float64)
    mean, rms = (float(x.mean()), float(np.sqrt((x * x).mean()))) if len(x) else (0.0, 0.0)
    times = [p[1] for p in found["packets"]]
    return f"packets={len(times)};blocks={found['blocks']};clusters={len({p[4] for p in found['packets']})};cues={len(found['cues'])};laced={sum(p[5] > 0 for p in found['packets'])};last_ms={max(times, default=0)};duration_ms={found['duration']:.3f};mean={mean:.6f};rms={rms:.6f}"


# -- tables ----------------------------------------------------------------------------------------------------------


def packets(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row for each packet: id, track, timestamp, start, length, cluster, lacing, cue (whether a cue names its cluster), error; a file with no packet but an error has one row."""
    share_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                data = batch.column(1)[row].as_py()
                found = parse(data)
                cued = {t for t, _, _ in found["cues"]}
                starts: dict[int, int] = {}
                rows = [(t, ts, a, b - a, c, lace, starts.setdefault(c, ts) in cued, None) for t, ts, a, b, c, lace in found["packets"]]
                if found["error"]:
                    rows.append((None,) * 7 + (found["error"],))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.string()]
                    ids = batch.column(0).slice(row, 1).take(pa.array([0] * len(rows)))
                    yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["id", "track", "timestamp", "start", "length", "cluster", "lacing", "cue", "error"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media")).mapInArrow(run, f"id {kind}, track long, timestamp long, start long, length long, cluster int, lacing int, cue boolean, error string").withColumnRenamed("id", id_col)


def padded(text: str | None) -> bytes:
    """UTF-8 bytes of ``text``, with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (0 if raw else 64))


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text stored as a Matroska file and read back: the digests of both."""
    share_code(df.sparkSession)

    def one(text: str | None) -> tuple:
        n = len((text or "").encode())
        media = write(padded(text))
        sound, found = samples(media)
        return n, len(sound), hashlib.sha256(sound).hexdigest(), zlib.crc32(sound[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(sound, found)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch):
                rows = zip(*map(one, part.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], ["id", *names])

    kind = df.schema[id_col].dataType.simpleString()
    shape = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {shape}").withColumnRenamed("id", id_col)


def op6_matroska(spark, sf_dir: str) -> DataFrame:
    """``documents`` as Matroska sound and back."""
    return stored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
