"""Media columns: Ogg containers that hold bytes as 8-bit samples, written and read back inside Spark tasks.

Container layout
    A payload is cut into packets of ``PACKET`` samples that alternate between two logical streams (serials 1 and
    2), so a reader has to demultiplex and put the packets back in order. Each logical stream starts with a
    beginning-of-stream page that holds one header packet: the codec mark, the sample rate and the stream's number.
    A data page holds as many whole or continued packets as 255 lacing values can describe. Its granule position is
    the number of samples of the stream that end on the page (-1 where no packet ends).

Reading
    ``read_container`` checks each page's checksum, reassembles packets from the lacing values (also across pages),
    sorts pages into their logical streams, and derives times from granule positions. A damaged page raises
    ``ValueError`` with the byte offset.

Defined results
    A null payload is stored as the empty one; an empty payload gives the two header pages and no data page. Equal
    payloads give equal containers. Extra input columns are not carried. Duplicate rows stay duplicate rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.llm.columns import id_and_text, slices

RATE = 8000
BLOCK = 192
PACKET = 10 * BLOCK
PAGE_SEGMENTS = 255
MARK = b"PCM8\x00\x01"

# Bytes with their bits in reverse order.
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEADER = struct.Struct("<4sBBqIIIB")


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04C11DB7, high bit first, zero start and no final inversion.

    zlib has the same polynomial with the low bit first: mirroring the bits of each byte, cancelling zlib's two
    inversions and mirroring the result gives the value at C speed.
    """
    low_first = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low_first.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(flags: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    bare = _HEADER.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing + body
    return bare[:22] + struct.pack("<I", page_checksum(bare)) + bare[26:]


def _lacing(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes((size % 255,))


def _stream_pages(serial: int, packets: list[bytes], number: int) -> Iterator[bytes]:
    """Data pages of one logical stream, filled to 255 lacing values; a packet may run on to the next page."""
    segments: list[tuple[int, int, bool]] = []  # packet, size, whether the packet ends here
    for i, packet in enumerate(packets):
        sizes = _lacing(len(packet))
        segments += [(i, s, k == len(sizes) - 1) for k, s in enumerate(sizes)]
    data = b"".join(packets)
    done = at = 0
    for first in range(0, len(segments), PAGE_SEGMENTS):
        part = segments[first : first + PAGE_SEGMENTS]
        size = sum(s for _, s, _ in part)
        ended = [i for i, _, end in part if end]
        done += sum(len(packets[i]) for i in ended)
        flags = (first > 0 and not segments[first - 1][2]) | (4 if first + PAGE_SEGMENTS >= len(segments) else 0)
        yield _page(flags, done if ended else -1, serial, number, bytes(s for _, s, _ in part), data[at : at + size])
        at += size
        number += 1


def write_container(payload: bytes, packet: int = PACKET, rate: int = RATE) -> bytes:
    """An Ogg file with the payload's packets dealt alternately to two logical streams."""
    pieces = [payload[i : i + packet] for i in range(0, len(payload), packet)]
    pages = []
    streams = []
    for serial in (1, 2):
        own = pieces[serial - 1 :: 2]
        header = MARK + struct.pack("<IB", rate, serial)
        pages.append(_page(2 if own else 6, 0, serial, 0, _lacing(len(header)), header))
        streams.append(list(_stream_pages(serial, own, 1)))
    longest = max(map(len, streams))
    pages += [s[i] for i in range(longest) for s in streams if i < len(s)]
    return b"".join(pages)


@dataclass
class LogicalStream:
    """What reading gives for one serial number."""

    packets: list[bytes] = field(default_factory=list)
    pages: int = 0
    granule: int = 0
    ended: bool = False
    rate: int = RATE
    #: Seconds at the end of each page on which a packet ends.
    times: list[float] = field(default_factory=list)


def read_container(data: bytes) -> dict[int, LogicalStream]:
    """The logical streams of an Ogg file; raises ValueError for a bad mark, checksum, page number or lacing."""
    streams: dict[int, LogicalStream] = {}
    open_packet: dict[int, list[bytes]] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27 or data[at : at + 4] != b"OggS":
            raise ValueError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, checksum, count = _HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + count]
        body = at + 27 + count
        end = body + sum(lacing)
        if version != 0 or len(lacing) < count or end > len(data):
            raise ValueError(f"cut page at byte {at}")
        page = data[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            raise ValueError(f"bad checksum at byte {at}")
        if (serial not in streams) != bool(flags & 2):
            raise ValueError(f"stream {serial} starts wrongly at byte {at}")
        stream = streams.setdefault(serial, LogicalStream())
        if number != stream.pages or bool(flags & 1) != bool(open_packet.get(serial)):
            raise ValueError(f"page out of order at byte {at}")
        stream.pages += 1
        pending = open_packet.get(serial, [])
        start = body
        for size in lacing:
            body += size
            if size < 255:
                pending.append(data[start:body])
                stream.packets.append(b"".join(pending))
                pending, start = [], body
        if body > start or (count and lacing[-1] == 255):
            pending.append(data[start:body])
        open_packet[serial] = pending
        if granule >= 0:
            stream.granule = granule
            if stream.pages > 1:
                stream.times.append(granule / stream.rate)
        if flags & 2:
            head = stream.packets.pop(0) if stream.packets else b""
            if not head.startswith(MARK):
                raise ValueError(f"unknown codec at byte {at}")
            stream.rate = struct.unpack_from("<I", head, len(MARK))[0]
        stream.ended |= bool(flags & 4)
        at = end
    if left := [s for s, p in open_packet.items() if p]:
        raise ValueError(f"stream {left[0]} ends inside a packet")
    return streams


def join_streams(streams: dict[int, LogicalStream]) -> bytes:
    """The payload: packets of the two streams in turn."""
    a, b = (streams[s].packets if s in streams else [] for s in (1, 2))
    whole: list[bytes] = [b""] * (len(a) + len(b))
    whole[0::2], whole[1::2] = a, b
    return b"".join(whole)


def _feature(payload: bytes, streams: dict[int, LogicalStream]) -> str:
    samples = np.frombuffer(payload, dtype=np.uint8)
    total = sum(s.granule for s in streams.values())
    last = max((s.times[-1] for s in streams.values() if s.times), default=0.0)
    mean = round(1000 * int(samples.sum(dtype=np.int64)) / max(1, len(samples)))
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};"
        f"packets={sum(len(s.packets) for s in streams.values())};samples={total};"
        f"last_ms={round(1000 * last)};mean_milli={mean};"
        f"peak={int(samples.max()) if len(samples) else 0}"
    )


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, filled with spaces to a positive multiple of ``block``, as Ogg."""

    def write(batches):
        for batch in slices(batches):
            ids, sizes, media = batch.column(0), [], []
            for text in batch.column(1).to_pylist():
                raw = text.encode()
                sizes.append(len(raw))
                media.append(write_container(raw.ljust(max(1, -(-len(raw) // block)) * block)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return id_and_text(docs, id_col, text_col).mapInArrow(write, "doc_id long, n_bytes long, media binary")


def load(media: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media, payload, feature``: what the stored containers hold."""

    def read(batches):
        for batch in slices(batches):
            payloads, features = [], []
            for data in batch.column("media").to_pylist():
                streams = read_container(data)
                payloads.append(join_streams(streams))
                features.append(_feature(payloads[-1], streams))
            arrays = [batch.column(n) for n in ("doc_id", "n_bytes", "media")]
            arrays += [pa.array(payloads, pa.binary()), pa.array(features, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "media", "payload", "feature"])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        read, "doc_id long, n_bytes long, media binary, payload binary, feature string"
    )


def media_digests(loaded: DataFrame) -> DataFrame:
    """Digest columns of a loaded media table."""
    return loaded.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -16, 16)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
