"""MPEG Layer III streams: writing a payload into frames, and reading streams back.

The reader takes MPEG-1, MPEG-2 and MPEG-2.5, resynchronises on frame headers, parses ID3v2.3,
ID3v2.4 and ID3v1 tags and the Xing, Info and VBRI tables, verifies the frames' CRC-16 and gives
the exact duration and every frame's seek offset.

The writer stores a payload losslessly in the format's own unit, the main data of a frame:
`part2_3_length` of the two granules says how many bits of main data a frame has, which
the checksum covers. Null and empty payloads are stored as 64 zero bytes by the query.
Damaged streams never raise: bytes that are no frame are skipped and counted, frames whose
checksum fails are counted and their data left out.
"""

from __future__ import annotations

import binascii
import hashlib
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cipherlode.llm import flat
from cipherlode.runtime import ship

# Fixed values of the format: kbit/s by index (MPEG-1, then MPEG-2 and 2.5, Layer III), samples a second by index,
# samples in a frame and side information of one and of two channels.
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
LOW_BITRATES = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44100, 48000, 32000)
SAMPLES, LOW_SAMPLES = 1152, 576
SIDE_MONO, SIDE_STEREO = 17, 32
LOW_SIDE_MONO, LOW_SIDE_STEREO = 9, 17
GENERATOR = 0x8005
RESERVOIR = 511

FRAME_DATA = 960
"""Payload bytes in a full frame; two granules can hold 1,023."""


@lru_cache(None)
def _crc_table() -> tuple[int, ...]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1) ^ GENERATOR if value & 0x8000 else value << 1
        table.append(value & 0xFFFF)
    return tuple(table)


@lru_cache(4096)
def frame_crc(data: bytes) -> int:
    """CRC-16 over the last two header bytes and the side information."""
    table, value = _crc_table(), 0xFFFF
    for byte in data:
        value = (value << 8 & 0xFFFF) ^ table[value >> 8 ^ byte]
    return value


def frame_size(bitrate: int, rate: int, padding: int) -> int:
    return 144_000 * bitrate // rate + padding


@lru_cache(2048)
def _head(size: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a mono 44.1 kHz frame with `size` bytes of main data, and its length."""
    need = 4 + 2 + SIDE_MONO + size
    index = next(i for i in range(1, 15) if frame_size(BITRATES[i], RATES[0], 0) >= need)
    header = bytes((0xFF, 0xFA, index << 4, 0xC0))
    first = min(size * 8, 4088)
    # main_data_begin 9 bits, private 5, scfsi 4; then 59 bits a granule, led by part2_3_length
    bits = (first << 47) << 59 | (size * 8 - first) << 47
    side = bits.to_bytes(SIDE_MONO, "big")
    return header + struct.pack(">H", frame_crc(header[2:] + side)) + side, frame_size(BITRATES[index], RATES[0], 0)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def encode(payload: bytes, title: str = "") -> bytes:
    """A stream whose frames hold payload: ID3v2 tag, Xing frame, audio frames."""
    frames = []
    for at in range(0, len(payload), FRAME_DATA):
        part = payload[at : at + FRAME_DATA]
        head, size = _head(len(part))
        frames.append((head + part).ljust(size, b"\0"))
    text = b"\3" + title.encode()
    tag = b"TIT2" + _synchsafe(len(text)) + b"\0\0" + text
    tag = b"ID3\4\0\0" + _synchsafe(len(tag)) + tag
    sizes = [len(f) for f in frames]
    total, seek, passed, done = sum(sizes), bytearray(), 0, 0
    for percent in range(100):  # byte position, in 256ths, at each hundredth of the duration
        while done < len(sizes) * percent // 100:
            passed += sizes[done]
            done += 1
        seek.append(min(255, passed * 256 // max(1, total)))
    head, size = _head(200)
    head = head[:6] + bytes(SIDE_MONO)
    head = head[:4] + struct.pack(">H", frame_crc(head[2:4] + bytes(SIDE_MONO))) + bytes(SIDE_MONO)
    xing = head + b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(seek)
    return tag + xing.ljust(size, b"\0") + b"".join(frames)


@dataclass
class Stream:
    """What a stream holds. offsets: of each audio frame, from the stream's start; incomplete: frames whose data begins in ones that are missing."""

    tags: dict = field(default_factory=dict)
    vbr: dict | None = None
    offsets: list[int] = field(default_factory=list)
    data: list[bytes] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    checked: int = 0
    damaged: int = 0
    incomplete: int = 0
    skipped: int = 0
    bitrates: dict = field(default_factory=dict)

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0

    @property
    def payload(self) -> bytes:
        return b"".join(self.data)


@dataclass(frozen=True)
class Header:
    """size: of the whole frame; side: of its side information; low: MPEG-2 or 2.5."""

    size: int
    bitrate: int
    rate: int
    protected: bool
    side: int
    low: bool

    @property
    def samples(self) -> int:
        return LOW_SAMPLES if self.low else SAMPLES


@lru_cache(4096)
def _header(second: int, third: int, mono: bool) -> Header | None:
    version = second >> 3 & 3  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    if second & 0xE6 != 0xE2 or version == 1 or third >> 4 in (0, 15) or third >> 2 & 3 == 3:
        return None
    low = version != 3
    bitrate = (LOW_BITRATES if low else BITRATES)[third >> 4]
    rate = RATES[third >> 2 & 3] >> {3: 0, 2: 1, 0: 2}[version]
    side = (LOW_SIDE_MONO if mono else LOW_SIDE_STEREO) if low else (SIDE_MONO if mono else SIDE_STEREO)
    return Header((72_000 if low else 144_000) * bitrate // rate + (third >> 1 & 1), bitrate, rate, not second & 1, side, low)


def parse_header(b: bytes, at: int) -> Header | None:
    """The Layer III frame header at a place, if there is one."""
    if at + 4 > len(b) or b[at] != 0xFF:
        return None
    return _header(b[at + 1], b[at + 2], b[at + 3] >> 6 == 3)


def _granule_bits(side: bytes, h: Header) -> int:
    """Bits of main data, over all granules and channels."""
    n, width, mono = int.from_bytes(side, "big"), len(side) * 8, h.side in ((LOW_SIDE_MONO,) if h.low else (SIDE_MONO,))
    lead = (9 if mono else 10) if h.low else (18 if mono else 20)
    step, parts = (63, 1 if mono else 2) if h.low else (59, 2 if mono else 4)
    return sum(n >> width - lead - step * k - 12 & 0xFFF for k in range(parts))


def _text(body: bytes) -> str:
    """A tag's text, led by its encoding: Latin-1, UTF-16 with a mark, UTF-16 big-endian or UTF-8."""
    return body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0] if body else 0, "latin-1"), "replace").rstrip("\0")


def _safe(b: bytes) -> int:
    """A number in four bytes of seven bits."""
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3(b: bytes, tags: dict) -> int:
    """End of the ID3v2 tag at the start, 0 without one. Sizes are plain in version 3 and of seven bits a byte in version 4."""
    if b[:3] != b"ID3" or len(b) < 10 or any(x & 0x80 for x in b[6:10]):
        return 0
    end, number = min(len(b), 10 + _safe(b[6:10])), _safe if b[3] >= 4 else lambda x: int.from_bytes(x, "big")
    at = 10
    if b[5] & 0x40 and at + 4 <= end:  # an extended header; its size has its own four bytes in version 4 only
        at += number(b[at : at + 4]) + (0 if b[3] >= 4 else 4)
    while at + 10 <= end and b[at : at + 4].isalnum():
        size = number(b[at + 4 : at + 8])
        body = b[at + 10 : min(end, at + 10 + size)]
        tags[b[at : at + 4].decode("ascii", "replace")] = _text(body) if b[at : at + 1] == b"T" else body.decode("latin-1")
        at += 10 + size
    return end


def _table(b: bytes, at: int, body: int) -> dict | None:
    """A variable-bitrate table in the frame at a place: Xing or Info after the side information, or VBRI 36 bytes in."""
    if b[body : body + 4] in (b"Xing", b"Info"):
        flags, p = int.from_bytes(b[body + 4 : body + 8], "big"), body + 8
        table: dict = {"kind": b[body : body + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                table[name] = int.from_bytes(b[p : p + 4], "big")
                p += 4
        if flags & 4:
            table["seek"] = list(b[p : p + 100])
        return table
    p = at + 36
    if b[p : p + 4] == b"VBRI" and p + 26 <= len(b):
        entries, scale, width, each = struct.unpack_from(">4H", b, p + 18)
        sizes = [int.from_bytes(b[p + 26 + width * k : p + 26 + width * (k + 1)], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "bytes": int.from_bytes(b[p + 10 : p + 14], "big"), "frames": int.from_bytes(b[p + 14 : p + 18], "big"), "frames_each": each, "sizes": sizes}
    return None


def _data_begin(side: bytes, h: Header) -> int:
    """How many bytes of main data before its own a frame's data begins."""
    return side[0] if h.low else side[0] << 1 | side[1] >> 7


def decode(b: bytes) -> Stream:
    """Read a stream. A header counts if its frame's checksum holds, or if another header, the ID3v1 tag or the end follows the frame."""
    s = Stream()
    at, end = _id3(b, s.tags), len(b)
    if end - at >= 128 and b[end - 128 : end - 125] == b"TAG":
        s.tags["ID3v1"] = b[end - 125 : end - 95].rstrip(b"\0 ").decode("latin-1")
        end -= 128
    first, held = True, b""
    while at < end:
        h = parse_header(b, at)
        fits = h is not None and at + h.size <= end
        if fits:
            side_at = at + (6 if h.protected else 4)
            side, body = b[side_at : side_at + h.side], side_at + h.side
            whole = not h.protected or frame_crc(b[at + 2 : at + 4] + side) == int.from_bytes(b[at + 4 : at + 6], "big")
            fits = (h.protected and whole) or at + h.size == end or parse_header(b, at + h.size) is not None
        if not fits:
            following = b.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            s.skipped += following - at
            at, held = following, b""
            continue
        table = _table(b, at, body) if first else None
        first = False
        if table:
            s.vbr, at = table, at + h.size
            continue
        s.checked += h.protected
        area = b[body : at + h.size]
        if not whole:
            s.damaged += 1
        elif (back := _data_begin(side, h)) <= len(held):
            # main data may begin in the frames before
            s.data.append((held[len(held) - back :] + area)[: _granule_bits(side, h) // 8])
        else:
            s.incomplete += 1
        held = (held + area)[-RESERVOIR:]
        s.offsets.append(at)
        s.samples, s.rate = s.samples + h.samples, h.rate
        s.bitrates[h.bitrate] = s.bitrates.get(h.bitrate, 0) + 1
        at += h.size
    return s


def padded(raw: bytes, unit: int = 64) -> bytes:
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


def feature(s: Stream) -> str:
    seek = hashlib.sha256(struct.pack(f">{len(s.offsets)}Q", *s.offsets)).hexdigest()[:16]
    return json.dumps({"frames": len(s.offsets), "duration_us": s.duration_us, "crc_checked": s.checked, "crc_failed": s.damaged, "skipped": s.skipped, "kbps": {str(k): s.bitrates[k] for k in sorted(s.bitrates)}, "first_offset": s.offsets[0] if s.offsets else None, "last_offset": s.offsets[-1] if s.offsets else None, "seek_sha": seek, "vbr_frames": (s.vbr or {}).get("frames")})


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_us long, frame_offsets array<long>"


def store_texts(docs: DataFrame, with_media: bool = False) -> DataFrame:
    """Every row's text, stored in frames and read back. with_media adds the stream itself.

    Needs doc_id and text; other columns are left out. Null text counts as empty. Rows are
    independent: repeated rows give repeated results, an empty table an empty one.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, len(ids), 512):
                out = [[] for _ in range(11 + with_media)]
                for text in texts[lo : lo + 512]:
                    raw = (text.as_py() or "").encode()
                    media = encode(padded(raw))
                    s = decode(media)
                    payload = s.payload
                    row = [len(raw), len(payload), hashlib.sha256(payload).hexdigest(), binascii.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(s), len(s.offsets), s.duration_us, s.offsets]
                    for column, value in zip(out[1:], row + [media] * with_media):
                        column.append(value)
                kinds = [pa.int64()] * 2 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())] + [pa.binary()] * with_media
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 512], *(pa.array(c, k) for c, k in zip(out[1:], kinds))], names=[x.split()[0] for x in SCHEMA.split(", ")] + ["media"] * with_media)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(flat.lean(run), SCHEMA + ", media binary" * with_media)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in frames and read back, with the stream's facts and every frame's seek offset; see store_texts."""
    return store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
