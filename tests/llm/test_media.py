import hashlib
import zlib

import pytest

from seglattice.llm.media import PACKET, PES_BYTES, UNIT, crc32_mpeg, demux, media_features, mux, pad


def slow_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def slow_payload(stream):
    """Packet by packet, without tables: the elementary bytes behind PES headers of 14 bytes."""
    out, pes = [], b""
    for i in range(2 * PACKET, len(stream), PACKET):
        p = stream[i : i + PACKET]
        body = p[5 + p[4] :] if p[3] & 0x20 else p[4:]
        if p[1] & 0x40:
            out.append(pes[14:])
            pes = b""
        pes += body
    return b"".join([*out, pes[14:]])


def test_checksum():
    for data in (b"", b"123456789", bytes(range(256))):
        assert crc32_mpeg(data) == slow_crc(data)
    assert crc32_mpeg(b"123456789") == 0x0376E6E7


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 360, 384, PES_BYTES - 1, PES_BYTES, PES_BYTES + 1, 5 * PES_BYTES + 77])
def test_round_trip(n):
    data = bytes((i * 31 + n) % 256 for i in range(n))
    payload = pad(data)
    stream = mux(payload, n)
    got = demux(stream)
    assert len(payload) % UNIT == 0 and got["payload"] == payload == slow_payload(stream)
    assert got["n_bytes"] == n and got["cc_errors"] == 0
    assert got["pts"] == got["pcr"] == [i * 90_000 // 8000 for i in range(0, len(payload), PES_BYTES)]
    assert len(got["rap"]) == got["pes"] == len(got["pts"]) and got["rap"][0] == 2


def test_every_length_of_the_last_packet():
    for n in range(1, 400):
        data = b"z" * n
        assert demux(mux(data, n))["payload"] == data


def test_lost_and_repeated_packets():
    stream = mux(pad(b"a" * 3000), 3000)
    packets = [stream[i : i + PACKET] for i in range(0, len(stream), PACKET)]
    assert demux(b"".join(packets[:5] + packets[6:]))["cc_errors"] == 1
    again = demux(b"".join(packets[:6] + packets[5:]))
    assert again["cc_errors"] == 0 and again["payload"] == pad(b"a" * 3000)
    for bad in (b"", stream[:-1], b"\x00" + stream[1:], stream[:PACKET], b"".join(packets[2:])):
        with pytest.raises(ValueError):
            demux(bad)


def test_features(spark, odd_docs, no_docs):
    rows = media_features(odd_docs).collect()
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in odd_docs.collect()}
    assert len(rows) == 14
    for r in rows:
        payload = pad(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(texts[r["doc_id"]]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r["media_sha256"] == hashlib.sha256(mux(payload, r["n_bytes"])).hexdigest()
    assert media_features(no_docs).collect() == []
