"""Media columns in Matroska: a writer and a parser of EBML in plain Python.

A payload becomes one audio track of unsigned 8-bit PCM in packets of PACKET bytes, several packets laced into a
block, blocks in clusters, and a cue for each cluster. The parser reads variable-length element ids and sizes,
clusters, simple blocks and block groups, all four kinds of lacing and cues, and gives a table of packets with track,
timestamp and byte range, from which payload and features are read back.

Scale: a narrow step; one document is in memory at a time.

Defined cases: null or empty text is one packet of padding. Equal texts give equal bytes: files carry no date and no
random id. Repeated rows and rows without id give a row each. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: element ids with their marker bits.
EBML, EBML_VERSION, EBML_READ, EBML_ID_LEN, EBML_SIZE_LEN, DOC_TYPE, DOC_VERSION, DOC_READ = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, MUXER, WRITER, DURATION = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACKS, TRACK, NUMBER, UID, KIND, CODEC, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE, CUE_TIME, CUE_PLACE, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Fixed value of the contract: payloads are whole packets of this size, filled up with bytes 255.
PACKET = 576
HZ, PER_BLOCK, PER_CLUSTER = 8000, 8, 64  # samples a second; packets in a block and in a cluster
MS = PACKET * 1000 // HZ


class Packet(NamedTuple):
    track: int
    timestamp: int
    start: int
    size: int
    cluster: int


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(kind: int, n: int) -> bytes:
    return _element(kind, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def write(payload: bytes) -> bytes:
    """A Matroska file of a payload of whole packets."""
    head = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(EBML_ID_LEN, 4) + _uint(EBML_SIZE_LEN, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))
    n = len(payload) // PACKET
    info = _element(INFO, _uint(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", float(n * MS))) + _element(MUXER, b"ferrule") + _element(WRITER, b"ferrule"))
    audio = _element(AUDIO, _element(RATE, struct.pack(">d", float(HZ))) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))
    tracks = _element(TRACKS, _element(TRACK, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(KIND, 2) + _element(CODEC, b"A_PCM/INT/LIT") + _uint(DEFAULT_DURATION, MS * 1_000_000) + audio))
    body, cues = [info, tracks], []
    at = len(info) + len(tracks)
    for c in range(0, n, PER_CLUSTER):
        blocks = [_uint(TIMESTAMP, c * MS)]
        for b in range(c, min(c + PER_CLUSTER, n), PER_BLOCK):
            count = min(PER_BLOCK, c + PER_CLUSTER - b, n - b)
            frames = payload[b * PACKET : (b + count) * PACKET]
            lacing = b"\x84" + bytes([count - 1]) if count > 1 else b"\x80"  # keyframe; fixed-size lacing
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">h", (b - c) * MS) + lacing + frames))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE, _uint(CUE_TIME, c * MS) + _element(CUE_PLACE, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    return head + _element(SEGMENT, b"".join([*body, _element(CUES, b"".join(cues))]))


def vint(data: bytes, at: int, marker: bool) -> tuple[int | None, int]:
    """(value, next place) of a variable-length integer; marker: keep the length bit, as ids do. Unknown size: None."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError(f"no variable-length integer at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, start, end) of the elements of a range. A cluster or segment of unknown size ends where its parent does or
    the next cluster, cues or info begins."""
    while at < end:
        kind, body = vint(data, at, True)
        size, body = vint(data, body, False)
        stop = end if size is None else body + size
        if stop > end:
            raise ValueError(f"the element at {at} is cut off")
        if size is None and kind == CLUSTER:
            stop = body
            while stop < end:
                inner, inside = vint(data, stop, True)
                if inner in (CLUSTER, CUES, INFO, TRACKS):
                    break
                n, inside = vint(data, inside, False)
                if n is None:
                    raise ValueError(f"an element of unknown size at {stop}, inside a cluster of unknown size")
                stop = inside + n
        yield kind, body, stop
        at = stop


def _number(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def block(data: bytes, a: int, b: int) -> tuple[int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, frames as (start, size)) of a block's body."""
    track, at = vint(data, a, False)
    relative = struct.unpack_from(">h", data, at)[0]
    lacing, at = data[at + 2] >> 1 & 3, at + 3
    if not lacing:
        return track, relative, [(at, b - at)]
    count, at = data[at] + 1, at + 1
    if lacing == 2:  # all of one size
        size = (b - at) // count
        return track, relative, [(at + k * size, size) for k in range(count)]
    sizes = []
    if lacing == 1:  # sums of bytes up to one below 255
        for _ in range(count - 1):
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
    else:  # the first size, then signed differences
        for k in range(count - 1):
            before = at
            n, at = vint(data, at, False)
            sizes.append(n if k == 0 else sizes[-1] + n - ((1 << 7 * (at - before) - 1) - 1))
    sizes.append(b - at - sum(sizes))
    frames = []
    for n in sizes:
        frames.append((at, n))
        at += n
    return track, relative, frames


def read(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]]]:
    """(packets, cues as (timestamp, track, place of the cluster in the file)).

    Laced frames after a block's first follow at the track's default duration.
    """
    packets, cues, duration = [], [], {}
    for kind, a, b in elements(data, 0, len(data)):
        if kind != SEGMENT:
            continue
        scale = 1_000_000
        for kind1, a1, b1 in elements(data, a, b):
            if kind1 == INFO:
                scale = next((_number(data, x, y) for k, x, y in elements(data, a1, b1) if k == SCALE), scale)
            elif kind1 == TRACKS:
                for k, x, y in elements(data, a1, b1):
                    own = {k2: (x2, y2) for k2, x2, y2 in elements(data, x, y)} if k == TRACK else {}
                    if NUMBER in own and DEFAULT_DURATION in own:
                        duration[_number(data, *own[NUMBER])] = _number(data, *own[DEFAULT_DURATION]) // scale
            elif kind1 == CLUSTER:
                base = 0
                for k, x, y in elements(data, a1, b1):
                    if k == TIMESTAMP:
                        base = _number(data, x, y)
                    found = [(x, y)] if k == SIMPLE_BLOCK else [(x2, y2) for k2, x2, y2 in elements(data, x, y) if k2 == BLOCK] if k == BLOCK_GROUP else []
                    for x2, y2 in found:
                        track, relative, frames = block(data, x2, y2)
                        packets.extend(Packet(track, base + relative + n * duration.get(track, 0), start, size, a1) for n, (start, size) in enumerate(frames))
            elif kind1 == CUES:
                for k, x, y in elements(data, a1, b1):
                    own = {k2: (x2, y2) for k2, x2, y2 in elements(data, x, y)} if k == CUE else {}
                    if CUE_TIME in own and CUE_PLACE in own:
                        place = {k2: _number(data, x2, y2) for k2, x2, y2 in elements(data, *own[CUE_PLACE])}
                        cues.append((_number(data, *own[CUE_TIME]), place.get(CUE_TRACK, 0), a + place.get(CUE_CLUSTER, 0)))
    return packets, cues


def feature(samples: np.ndarray, packets: list[Packet], cues: list[tuple[int, int, int]]) -> str:
    """Packets, clusters and cues, end time in ms, then mean, deviation, sign changes and loudest packet's energy."""
    x = samples.astype(np.int64) - 128
    energy = (x * x).reshape(-1, PACKET).sum(axis=1)
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    mean = x.sum() / len(x)
    deviation = max(0.0, energy.sum() / len(x) - mean * mean) ** 0.5
    return f"{len(packets)}:{len({p.cluster for p in packets})}:{len(cues)}:{packets[-1].timestamp + MS}:{mean:.3f}:{deviation:.3f}:{crossings}:{int(energy.max())}"


_FIELDS = (("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()))


def digest(text: str) -> tuple[int, int, str, int, int, str, str]:
    """The values of _FIELDS for a text: written, parsed and read back."""
    own = text.encode()
    media = write(own + b"\xff" * (-len(own) % PACKET if own else PACKET))
    packets, cues = read(media)
    payload = b"".join([media[p.start : p.start + p.size] for p in packets])
    return (len(own), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(np.frombuffer(payload, np.uint8), packets, cues))


def media_digests(documents: DataFrame) -> DataFrame:
    """doc_id and the values of _FIELDS for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*(digest(t.as_py() or "") for t in batch.column(1)))) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(cols, _FIELDS))], ["doc_id", *(n for n, _ in _FIELDS)])

    schema = ", ".join(["doc_id long", *(f"{n} {'long' if k == pa.int64() else 'string'}" for n, k in _FIELDS)])
    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def media_column(documents: DataFrame) -> DataFrame:
    """doc_id, media (the file's bytes) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(0, len(batch), 64):  # so that a batch of files stays small
                part = batch.slice(n, 64)
                texts = [(t.as_py() or "").encode() for t in part.column(1)]
                files = [write(t + b"\xff" * (-len(t) % PACKET if t else PACKET)) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """(doc_id, n, track, timestamp_ms, start, size, cluster, error) of each packet of media (doc_id, media).

    null: no row. A file that can't be parsed gives one row, with the reason as error and nulls for the packet.
    """

    def packets(data: bytes) -> list[tuple]:
        try:
            return [(n, *p, None) for n, p in enumerate(read(data)[0])]
        except (ValueError, IndexError, struct.error) as e:
            return [(*[None] * 6, str(e))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(r, *p) for r, m in enumerate(batch.column(1)) if m.is_valid for p in packets(m.as_py())]
            at, *cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 6 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", "n", "track", "timestamp_ms", "start", "size", "cluster", "error"])

    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, "doc_id long, n long, track long, timestamp_ms long, start long, size long, cluster long, error string")
