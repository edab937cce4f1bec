import random

import pytest
from pyspark.sql import types as T

from inkstone.llm import ogg


def slow_checksum(page: bytes) -> int:
    value = 0
    for byte in page:
        value ^= byte << 24
        for _ in range(8):
            value = ((value << 1) ^ 0x04C11DB7) & 0xFFFFFFFF if value & 0x80000000 else value << 1
    return value


def test_checksum_equals_bitwise_division():
    rng = random.Random(1)
    for size in (0, 1, 2, 27, 300):
        data = rng.randbytes(size)
        assert ogg.page_checksum(data) == slow_checksum(data)


@pytest.mark.parametrize("size", [0, 1, 192, 255, 1920, 1921, 5000, 255 * 255, 70_000, 400_000])
@pytest.mark.parametrize("packet", [1, 255, 1920, 100_000])
def test_round_trip_with_packets_over_pages(size, packet):
    if size / packet > 5000:
        return
    data = random.Random(size).randbytes(size)
    streams = ogg.read_container(ogg.write_container(data, packet=packet))
    assert ogg.join_streams(streams) == data
    assert all(s.ended for s in streams.values())
    assert sum(s.granule for s in streams.values()) == size
    for s in streams.values():
        assert s.times == sorted(s.times)


def test_every_flipped_byte_is_noticed():
    data = ogg.write_container(bytes(range(256)) * 2)
    for at in range(0, len(data), 7):
        with pytest.raises(ValueError):
            ogg.read_container(data[:at] + bytes((data[at] ^ 0x20,)) + data[at + 1 :])
    with pytest.raises(ValueError):
        ogg.read_container(data[:-1])


def test_operator_handles_nulls_repeats_and_extra_columns(spark):
    schema = T.StructType().add("doc_id", "long").add("text", "string").add("media", "integer").add("payload", "integer")
    rows = [(1, None, 0, 0), (2, "", 1, 1), (3, "é" * 50_000, 2, 2), (3, "é" * 50_000, 2, 2), (None, "x", 3, 3)]
    docs = spark.createDataFrame(rows, schema)
    got = ogg.media_digests(ogg.load(ogg.store(docs))).collect()
    assert len(got) == 5
    by = {r.doc_id: r for r in got}
    assert by[1].payload_bytes == 192 and by[1].n_bytes == 0 and by[1].payload_sha256 == by[2].payload_sha256
    assert by[3].n_bytes == 100_000 and by[3].payload_bytes % 192 == 0
    assert ogg.media_digests(ogg.load(ogg.store(docs.limit(0)))).count() == 0
