"""Media columns in Matroska: EBML writer, parser and packet tables.

``encode`` stores a payload losslessly as 8-bit PCM samples of one audio track,
in clusters of laced blocks with cues. ``parse`` reads any such file: element
ids and sizes of variable length, elements of unknown size, clusters, simple
blocks and block groups, Xiph, EBML and fixed-size lacing, and cues. It gives a
table of packets with track, timestamp and byte range; ``read_back`` follows the
byte ranges to the stored bytes.

Defined results: a null or empty text is a payload of 64 zero bytes; equal
texts give equal files and features, since nothing in a file depends on time
or chance. ``parse`` of a null is an empty table; a truncated or malformed
file gives the packets before the fault and names the fault in ``error``.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch_of, doc_text, map_arrow, sha_hex

# Element ids of the public Matroska specification.
EBML, DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x1A45DFA3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, TRACKS, TRACK_ENTRY = 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER, CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES}
LACING = ("none", "xiph", "fixed", "ebml")

UNIT, FRAME, LACE, CLUSTER_BLOCKS, RATE = 64, 1024, 8, 8, 8000
#: Bytes of an element's header that stand for "unknown size", by length.
_UNKNOWN = {n: (1 << 7 * n) - 1 for n in range(1, 9)}


def vint(value: int, length: int = 0) -> bytes:
    """A size as an EBML variable-length integer, by default the shortest."""
    n = length or next(n for n in range(1, 9) if value < _UNKNOWN[n])
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes], mode: str) -> bytes:
    """The lacing header and the frames of one block."""
    if mode == "none":
        return frames[0]
    head = bytearray([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if mode == "xiph":
        for s in sizes[:-1]:
            head += b"\xff" * (s // 255) + bytes([s % 255])
    elif mode == "ebml":
        head += vint(sizes[0]) if len(sizes) > 1 else b""
        for before, s in zip(sizes[:-1], sizes[1:-1], strict=False):
            n = next(n for n in range(1, 9) if abs(s - before) < 1 << 7 * n - 1)
            head += vint(s - before + (1 << 7 * n - 1) - 1, n)
    elif len(set(sizes)) > 1:
        raise ValueError("fixed-size lacing needs frames of one size")
    return bytes(head) + b"".join(frames)


def block(ident: int, track: int, relative: int, frames: list[bytes], mode: str) -> bytes:
    flags = LACING.index(mode) << 1 | (0x80 if ident == SIMPLE_BLOCK else 0)
    return element(ident, vint(track) + struct.pack(">hB", relative, flags) + lace(frames, mode))


def encode(payload: bytes) -> bytes:
    """A Matroska file whose only track holds the payload as 8-bit samples."""
    head = element(EBML, element(DOC_TYPE, b"matroska") + unsigned(DOC_TYPE_VERSION, 4) + unsigned(DOC_TYPE_READ_VERSION, 2))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    entry = unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    body = [info, element(TRACKS, element(TRACK_ENTRY, entry))]
    place, cues, step = sum(map(len, body)), [], FRAME * LACE
    for k, at in enumerate(range(0, len(payload), step * CLUSTER_BLOCKS)):
        base, blocks = at * 1000 // RATE, []
        for b, lo in enumerate(range(at, min(len(payload), at + step * CLUSTER_BLOCKS), step)):
            frames = [payload[i : i + FRAME] for i in range(lo, min(len(payload), lo + step), FRAME)]
            same = len({len(f) for f in frames}) == 1
            mode = "none" if len(frames) == 1 else "fixed" if same and (k + b) % 3 == 0 else "xiph" if (k + b) % 3 == 1 else "ebml"
            relative = lo * 1000 // RATE - base
            if b % 4 == 3:
                blocks.append(element(BLOCK_GROUP, block(BLOCK, 1, relative, frames, mode)))
            else:
                blocks.append(block(SIMPLE_BLOCK, 1, relative, frames, mode))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, base) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, place))))
        body.append(element(CLUSTER, unsigned(CLUSTER_TIMESTAMP, base) + b"".join(blocks)))
        place += len(body[-1])
    body.append(element(CUES, b"".join(cues)))
    return head + element(SEGMENT, b"".join(body))


@dataclass
class Media:
    """What a file holds. ``packets``: (track, timestamp, cluster, lacing, start, length), the timestamp in ticks of ``scale`` nanoseconds."""

    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple[int, int, int, str, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    segment: int = 0
    error: str = ""


def read_vint(data: bytes, at: int, end: int, marker: bool = False) -> tuple[int, int, int]:
    """Value, length and place after a variable-length integer."""
    if at >= end or not data[at]:
        raise ValueError(f"no variable-length integer at {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise ValueError(f"truncated at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    return (value if marker else value ^ 1 << 7 * n), n, at + n


def frame_sizes(data: bytes, at: int, end: int, mode: str) -> tuple[list[int], int]:
    """Sizes of a block's frames and the place of the first."""
    if mode == "none":
        return [end - at], at
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if mode == "fixed":
        size, rest = divmod(end - at, count)
        if rest:
            raise ValueError(f"fixed-size lacing of unequal frames at {at}")
        return [size] * count, at
    if mode == "xiph":
        for _ in range(count - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif count > 1:
        size, _, at = read_vint(data, at, end)
        sizes.append(size)
        for _ in range(count - 2):
            delta, n, at = read_vint(data, at, end)
            size += delta - ((1 << 7 * n - 1) - 1)
            sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError(f"frames run over their block at {at}")
    return sizes, at


def parse(data: bytes | None) -> Media:
    """The packet table of a file and what stands around it."""
    media = Media()
    if data:
        try:
            _walk(data, 0, len(data), 0, media, {})
        except (ValueError, IndexError, struct.error) as fault:
            media.error = str(fault) or type(fault).__name__
    return media


def _walk(data: bytes, at: int, end: int, parent: int, media: Media, state: dict) -> int:
    while at < end:
        begin = at
        ident, _, after = read_vint(data, at, end, marker=True)
        size, n, after = read_vint(data, after, end)
        unknown = size == _UNKNOWN[n]
        if unknown and ident not in (SEGMENT, CLUSTER):
            raise ValueError(f"unknown size at {begin}")
        if state.get("open") == parent == CLUSTER and ident in TOP_LEVEL:
            return begin  # a cluster of unknown size ends where the next element of the segment begins
        stop = end if unknown else after + size
        if stop > end:
            raise ValueError(f"element at {begin} runs over its parent")
        if ident in MASTERS:
            if ident == SEGMENT:
                media.segment = after
            elif ident == CLUSTER:
                media.clusters.append(begin)
                state["time"] = 0
            elif ident == TRACK_ENTRY:
                media.tracks.append({})
            elif ident == CUE_POINT:
                state["cue"] = [0, 0, 0]
            outer = state.get("open")
            state["open"] = ident if unknown else None
            at = _walk(data, after, stop, ident, media, state)
            state["open"] = outer
            if ident == CUE_POINT:
                media.cues.append(tuple(state["cue"]))
            continue
        body = data[after:stop] if stop - after <= 64 else b""
        number = int.from_bytes(body[:8], "big")
        if ident in (SIMPLE_BLOCK, BLOCK):
            track, _, place = read_vint(data, after, stop)
            relative, flags = struct.unpack_from(">hB", data, place)
            mode = LACING[flags >> 1 & 3]
            sizes, place = frame_sizes(data, place + 3, stop, mode)
            media.blocks += 1
            for length in sizes:
                media.packets.append((track, state["time"] + relative, len(media.clusters) - 1, mode, place, length))
                place += length
        elif ident == CLUSTER_TIMESTAMP:
            state["time"] = number
        elif ident == TIMESTAMP_SCALE:
            media.scale = number
        elif parent == TRACK_ENTRY and ident in (TRACK_NUMBER, TRACK_TYPE, CODEC_ID):
            media.tracks[-1][{TRACK_NUMBER: "number", TRACK_TYPE: "type", CODEC_ID: "codec"}[ident]] = body.decode("latin-1") if ident == CODEC_ID else number
        elif parent == AUDIO and ident in (CHANNELS, BIT_DEPTH):
            media.tracks[-1]["channels" if ident == CHANNELS else "bits"] = number
        elif ident == CUE_TIME:
            state["cue"][0] = number
        elif ident == CUE_TRACK:
            state["cue"][1] = number
        elif ident == CUE_CLUSTER_POSITION:
            state["cue"][2] = media.segment + number
        at = stop
    return at


def read_back(data: bytes, media: Media, track: int = 1) -> bytes:
    """The stored bytes of a track, by the byte ranges of its packets."""
    return b"".join([data[at : at + n] for number, _, _, _, at, n in media.packets if number == track])


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, filled with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % UNIT if raw else UNIT)


def features(data: bytes, media: Media, payload: bytes) -> str:
    samples = np.frombuffer(payload, dtype=np.uint8)
    clusters = set(media.clusters)
    seek = sum(place in clusters for _, _, place in media.cues)
    kinds = "+".join(k for k in LACING if any(p[3] == k for p in media.packets))
    return (
        f"tracks={len(media.tracks)};codec={media.tracks[0].get('codec', '')};clusters={len(media.clusters)};blocks={media.blocks};"
        f"packets={len(media.packets)};lacing={kinds};cues={len(media.cues)};cues_hit={seek};"
        f"last_ms={max(p[1] for p in media.packets) * media.scale // 1_000_000};sum={int(samples.sum(dtype=np.int64))};"
        f"peak={int(samples.max())}"
    )


PACKETS = "doc_id long, track int, timestamp_ns long, cluster int, lacing string, byte_start long, byte_length long"


def media_table(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``media``: each text as a Matroska file."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(doc_id=(pa.int64(), batch.column(0)), media=(pa.binary(), [encode(payload_of(t)) for t in batch.column(1).to_pylist()]))

    return map_arrow(doc_text(docs), step, "doc_id long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each packet of the files in column ``media``."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = parse(data)
            rows += [(i, t, at * found.scale, c, k, start, n) for t, at, c, k, start, n in found.packets]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
        names = [part.split()[0] for part in PACKETS.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(names)
        return batch_of(**{n: (k, list(c)) for n, k, c in zip(names, kinds, columns, strict=True)})

    return map_arrow(media.select("doc_id", "media"), step, PACKETS)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long"


def media_digest(docs: DataFrame) -> DataFrame:
    """Write each text as a file, read the stored bytes back by its packet table and describe both."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data = encode(payload_of(text))
            found = parse(data)
            if found.error:
                raise ValueError(f"document {i}: {found.error}")
            back = read_back(data, found)
            rows.append((i, len(text.encode("utf-8", "surrogatepass")), len(back), sha_hex(back), zlib.crc32(back[-UNIT:]), len(data), sha_hex(data), features(data, found, back), len(found.packets)))
        kinds = [pa.string() if "string" in p else pa.int64() for p in DIGEST.split(", ")]
        names = [p.split()[0] for p in DIGEST.split(", ")]
        return batch_of(**{n: (k, list(c)) for n, k, c in zip(names, kinds, zip(*rows, strict=True), strict=True)})

    return map_arrow(doc_text(docs), step, DIGEST)
