"""Media columns: byte payloads stored in MPEG audio, and audio read back.

The container is a real MPEG-1 Layer III stream: an ID3v2.3 tag that names the
payload's length, a Xing frame with frame count, byte count and seek table, then
one CRC-protected 48 kHz mono frame for each chunk of the payload. A frame's
header, CRC and side information are followed by its data bytes; the side
information is zero (a silent frame), so the data are ancillary bytes that a
player skips. Bitrates vary with the chunk, so the stream is a variable-rate one.

``parse`` reads any MPEG-1, 2 or 2.5 stream of layers I to III: it reads ID3v2 tags
frame by frame and the ID3v1 tag at the end, resynchronises on frame headers (a
header counts only if another header or the end follows where it says), reads the
Xing or VBRI table, verifies the CRC of frames of layers I and III and returns exact
durations and the seek offset of every frame. A duration is the sum of the samples
of each rate over that rate, divided once.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from moraine.llm.common import batch_of, table, type_of

ALIGN = 64
TAIL = 64
CHUNK = 896
SAMPLES = 1152
RATE = 48_000
SIDE = 17  # bytes of side information of a mono MPEG-1 Layer III frame
HEAD = 4 + 2 + SIDE

#: Fixed values of the format: kbit/s of MPEG-1 Layer III by index, 0 and 15 unused.
BITRATES = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
#: Fixed values of the format: kbit/s of the other layers of MPEG-1, and of MPEG-2 and 2.5.
LAYER_1 = [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448]
LAYER_2 = [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384]
LOW_LAYER_1 = [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256]
LOW_OTHERS = [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]
#: Fixed values of the format: sampling rates of MPEG-1 by index; MPEG-2 halves and 2.5 quarters them.
SAMPLE_RATES = [44_100, 48_000, 32_000]
#: Fixed values of the format: what the header's version and layer bits stand for, as divisor of the rate and layer.
VERSIONS, LAYERS = {3: 1, 2: 2, 0: 4}, {3: 1, 2: 2, 1: 3}

MEDIA_SCHEMA = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    "media_sha256 string, feature string, n_frames long, n_samples long, duration_us long, "
    "bad_crc int, resync_bytes long, seek_offsets array<long>"
)


def pad(data: bytes) -> bytes:
    """Append zero bytes up to a positive multiple of ``ALIGN``."""
    return data + bytes(-len(data) % ALIGN if data else ALIGN)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The format's CRC-16, polynomial 0x8005, started at 0xFFFF."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@lru_cache(64)
def _frame_head(index: int) -> bytes:
    """Header, CRC and silent side information of a mono 48 kHz frame."""
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(SIDE)
    return head + crc16(head[2:] + side).to_bytes(2, "big") + side


@lru_cache(1024)
def _index_for(size: int) -> int:
    """The least bitrate whose frame has room for ``size`` data bytes."""
    return next(i for i, kbps in enumerate(BITRATES) if i and 3 * kbps - HEAD >= size)


def _synchsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def encode(payload: bytes) -> bytes:
    """Store ``payload`` as an MPEG stream."""
    frames = []
    for at in range(0, len(payload), CHUNK):
        chunk = payload[at : at + CHUNK]
        index = _index_for(len(chunk))
        frames.append((_frame_head(index) + chunk).ljust(3 * BITRATES[index], b"\0"))
    note = b"\0payload\0" + str(len(payload)).encode()
    body = b"TXXX" + len(note).to_bytes(4, "big") + b"\0\0" + note
    tag = b"ID3\x03\0\0" + _synchsafe(len(body)) + body
    index = 5
    xing_size = 3 * BITRATES[index]
    total = xing_size + sum(map(len, frames))
    starts, at = [], xing_size
    for frame in frames:
        starts.append(at)
        at += len(frame)
    toc = bytes(min(255, 256 * starts[k * len(frames) // 100] // total) for k in range(100))
    xing = b"Xing" + (7).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return tag + (_frame_head(index) + xing).ljust(xing_size, b"\0") + b"".join(frames)


class Header:
    """What the four header bytes at a place say; ``size`` is 0 where no frame begins.

    Frames of free bitrate have no size in their header and count as no frame.
    """

    __slots__ = ("channels", "content", "guarded", "joint", "layer", "low", "rate", "samples", "size")

    def __init__(self, media: bytes, at: int) -> None:
        self.size = 0
        if at + 4 > len(media) or media[at] != 0xFF or media[at + 1] & 0xE0 != 0xE0:
            return
        low, layer = VERSIONS.get(media[at + 1] >> 3 & 3), LAYERS.get(media[at + 1] >> 1 & 3)
        index, rate = media[at + 2] >> 4, media[at + 2] >> 2 & 3
        if low is None or layer is None or index in (0, 15) or rate == 3:
            return
        self.low, self.layer = low > 1, layer
        rates = (LOW_LAYER_1 if layer == 1 else LOW_OTHERS) if low > 1 else (LAYER_1, LAYER_2, BITRATES)[layer - 1]
        self.rate = SAMPLE_RATES[rate] // low
        self.samples = 384 if layer == 1 else 576 if layer == 3 and low > 1 else 1152
        padding, bits = media[at + 2] >> 1 & 1, rates[index] * 1000
        self.size = 4 * (12 * bits // self.rate + padding) if layer == 1 else self.samples // 8 * bits // self.rate + padding
        self.guarded = not media[at + 1] & 1
        mode = media[at + 3] >> 6
        self.channels = 1 if mode == 3 else 2
        self.joint = (media[at + 3] >> 4 & 3) if mode == 1 else None
        side = ((9, 17) if self.low else (17, 32))[self.channels - 1]
        self.content = 4 + 2 * self.guarded + (side if layer == 3 else 0)

    def protected(self) -> int:
        """Bytes behind the CRC that it covers besides the header's last two; 0 where this reader does not know."""
        if self.layer == 3:
            return self.content - 4 - 2 * self.guarded
        if self.layer == 1:  # four bits a subband and channel, shared from the bound on
            return 16 * self.channels if self.joint is None else (32 + 4 * (self.joint + 1)) // 2
        return 0


def _plain_text(raw: bytes) -> str:
    """Text of an ID3v2 frame: an encoding byte, then the text."""
    codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(raw[0] if raw else 0, "latin-1")
    return raw[1:].decode(codec, "replace").strip("\0")


def read_tags(media: bytes) -> tuple[dict[str, str], int, int]:
    """(text tags, where the audio begins, where it ends).

    ID3v2.2 to 2.4 at the front, several after each other too, and ID3v1 at the end.
    A user text goes by its description. Damaged frames end their tag.
    """
    tags: dict[str, str] = {}
    at, end = 0, len(media)
    while media[at : at + 3] == b"ID3" and len(media) >= at + 10:
        version, flags = media[at + 3], media[at + 5]
        size = _unsynchsafe(media[at + 6 : at + 10])
        body, at = media[at + 10 : at + 10 + size], at + 10 + size + (10 if flags & 0x10 else 0)
        if flags & 0x80:
            body = body.replace(b"\xff\0", b"\xff")
        k = 0
        if flags & 0x40 and version > 2:
            k = _unsynchsafe(body[:4]) if version == 4 else int.from_bytes(body[:4], "big") + 4
        name, head = (3, 6) if version == 2 else (4, 10)
        while k + head <= len(body) and body[k]:
            key, length = body[k : k + name].decode("latin-1"), body[k + name : k + name + (3 if version == 2 else 4)]
            n = _unsynchsafe(length) if version == 4 else int.from_bytes(length, "big")
            raw, k = body[k + head : k + head + n], k + head + n
            if k > len(body):
                break
            if key in ("TXXX", "TXX"):
                key, _, value = _plain_text(raw).partition("\0")
                tags.setdefault(key, value)
            elif key[0] == "T":
                tags.setdefault(key, _plain_text(raw))
    if end - 128 >= at and media[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, first, last in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := media[end + first : end + last].split(b"\0")[0].decode("latin-1").strip():
                tags.setdefault(key, value)
    return tags, min(at, end), end


def _unsynchsafe(b: bytes) -> int:
    return sum((x & 0x7F) << 7 * k for k, x in enumerate(reversed(b)))


def vbr_table(frame: bytes, head: Header) -> tuple[int, int, bytes] | None:
    """(frames, bytes, seek table) of a Xing, Info or VBRI frame; -1 where a number is not given."""
    content = frame[head.content :]
    if head.layer == 3 and content[:4] in (b"Xing", b"Info"):
        flags, at, numbers = int.from_bytes(content[4:8], "big"), 8, []
        for bit in (1, 2):
            numbers.append(int.from_bytes(content[at : at + 4], "big") if flags & bit else -1)
            at += 4 if flags & bit else 0
        return numbers[0], numbers[1], content[at : at + 100] if flags & 4 else b""
    v = frame[36:]  # 32 bytes after the header, whatever its side information
    if head.layer == 3 and v[:4] == b"VBRI":
        entries, size = int.from_bytes(v[18:20], "big"), int.from_bytes(v[22:24], "big")
        return int.from_bytes(v[14:18], "big"), int.from_bytes(v[10:14], "big"), v[26 : 26 + entries * size]
    return None


def parse(media: bytes) -> dict:
    """Frames, tags and table of a stream.

    Bytes that belong to no frame are counted in ``resync_bytes``. An empty or
    frameless stream gives no frames and duration 0; a frame cut off by the end
    of the stream counts as lost bytes. Guarded frames of Layer II count in
    ``unverified``.
    """
    tags, at, end = read_tags(media)
    stored = tags.get("payload", "")
    offsets, data, bad, unverified, lost, table_ = [], [], 0, 0, 0, None
    samples: Counter[int] = Counter()
    synced = False
    while at < end:
        head = Header(media, at)
        size = head.size
        if not size or at + size > end or not (synced or at + size == end or Header(media, at + size).size):
            nxt = media.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            lost, at, synced = lost + nxt - at, nxt, False
            continue
        synced = True
        if head.guarded:
            covered, body = head.protected(), at + 6
            unverified += not covered
            bad += bool(covered) and crc16(media[at + 2 : at + 4] + media[body : body + covered]) != int.from_bytes(media[at + 4 : at + 6], "big")
        if not offsets and table_ is None and (table_ := vbr_table(media[at : at + size], head)):
            at += size
            continue
        offsets.append(at)
        data.append(media[at + head.content : at + size])
        samples[head.rate] += head.samples
        at += size
    seconds = sum((Fraction(n, rate) for rate, n in samples.items()), Fraction(0))
    return {
        "tags": tags, "declared": int(stored) if stored.isdigit() else None, "offsets": offsets, "data": data, "bad_crc": bad,
        "unverified": unverified, "resync_bytes": lost, "samples": samples.total(), "seconds": seconds,
        "duration_us": int(seconds * 1_000_000), "table": table_,
    }


def payload_of(parsed: dict) -> bytes:
    """The stored payload: every frame's data, cut to the chunk and declared size."""
    left = parsed["declared"] if parsed["declared"] is not None else sum(map(len, parsed["data"]))
    return b"".join(d[:CHUNK] for d in parsed["data"])[:left]


def describe(data: bytes) -> tuple:
    """Store, read back and describe one text's bytes."""
    media = encode(pad(data))
    parsed = parse(media)
    payload = payload_of(parsed)
    table_ = parsed["table"]
    toc = zlib.crc32(table_[2]) if table_ else 0
    frames = len(parsed["offsets"])
    feature = (
        f"mp3;rate={RATE};frames={frames};samples={parsed['samples']};us={parsed['duration_us']};"
        f"xing={table_[0] if table_ else -1}/{table_[1] if table_ else -1};toc={toc:08x};bad_crc={parsed['bad_crc']}"
    )
    return (
        len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(media),
        hashlib.sha256(media).hexdigest(), feature, frames, parsed["samples"], parsed["duration_us"],
        parsed["bad_crc"], parsed["resync_bytes"], parsed["offsets"],
    )


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, media binary): every text of ``docs`` as an MPEG stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [encode(pad((t or "").encode())) for t in b.column("text").to_pylist()]
            yield batch_of(doc_id=b.column("doc_id"), media=pa.array(media, pa.binary()))

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, media binary")


def media_features(docs: DataFrame) -> DataFrame:
    """One row a document: its text through an MPEG stream and back.

    A null or empty text is stored as 64 zero bytes. Equal texts have equal
    values; repeated rows each give a row; null ids stay null; extra columns are
    ignored. Rows are independent and nothing is shuffled.
    """
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    kinds = [(name, arrow[kind]) for name, kind in (c.split() for c in MEDIA_SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(zip(*(describe((t or "").encode()) for t in b.column("text").to_pylist()), strict=True)) or [[]] * len(kinds)
            found = {name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns, strict=True)}
            yield batch_of(doc_id=b.column("doc_id"), **found)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {type_of(docs, 'doc_id')}, {MEDIA_SCHEMA}")


def op4_media_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as MPEG audio, read back."""
    return media_features(table(spark, sf_dir, "documents"))
