"""Media columns: MPEG transport streams, written and parsed with numpy over whole packets.

`mux` stores bytes as 8-bit samples in one program: a PAT, a PMT (whose private descriptor keeps the unpadded length)
and PES packets on one elementary PID, each opening with a random-access point that carries PCR and PTS. `demux` takes
any stream of 188-byte packets with one program: it finds the PMT through the PAT, follows the first elementary PID,
checks continuity counters (an exact repeat is dropped, a gap counted), reassembles the PES packets and returns
timestamps with their random-access points.

Defined results: a null or empty text stores one unit of 192 spaces with n_bytes 0; a stream that is no whole number
of packets, lacks sync bytes, tables or the elementary stream raises ValueError; equal texts give equal streams.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

PACKET, SYNC = 188, 0x47
PMT_PID, DATA_PID = 0x1000, 0x0101
#: Samples are bytes; units of 192 at 8000 a second last 2160 ticks of the 90 kHz clock.
UNIT, RATE, CLOCK = 192, 8000, 90_000
#: Bytes of payload in one PES packet: a multiple of UNIT.
PES_BYTES = 48 * UNIT
LENGTH_TAG = 0x80

_REV8 = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def crc32_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2, from the reflected CRC of the bit-reversed bytes."""
    return int(f"{zlib.crc32(data.translate(_REV8)) ^ 0xFFFFFFFF:032b}"[::-1], 2)


def _section(table_id: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + body
    return head + crc32_mpeg(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, b"\xff")


_PAT = _table_packet(0, _section(0x00, b"\x00\x01" + (0xE000 | PMT_PID).to_bytes(2, "big")))


def _pmt(n_bytes: int) -> bytes:
    info = bytes([LENGTH_TAG, 8]) + n_bytes.to_bytes(8, "big")
    body = (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | DATA_PID).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info
    return _table_packet(PMT_PID, _section(0x02, body))


def _pts(ticks: int) -> bytes:
    ticks &= (1 << 33) - 1
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, 0x01 | ticks >> 14 & 0xFE, ticks >> 7 & 0xFF, 0x01 | ticks << 1 & 0xFE])


def _read_pts(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def pad(data: bytes) -> bytes:
    """Spaces up to a positive multiple of UNIT."""
    return data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")


def mux(payload: bytes, n_bytes: int) -> bytes:
    """A transport stream of the payload, whose first n_bytes are not padding."""
    out, counter = [_PAT, _pmt(n_bytes)], 0
    for at in range(0, len(payload), PES_BYTES):
        piece, ticks = payload[at : at + PES_BYTES], at * CLOCK // RATE
        pes = b"\x00\x00\x01\xbd" + (len(piece) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _pts(ticks) + piece
        base = ticks & (1 << 33) - 1
        first = bytes([7, 0x50]) + (base << 15 | 0x7E00).to_bytes(6, "big")
        body = PACKET - 4
        rest = max(0, len(pes) - (body - len(first)))
        n = 1 + -(-rest // body)
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0] = SYNC
        packets[:, 1], packets[:, 2] = DATA_PID >> 8, DATA_PID & 0xFF
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        packets[0, 3] |= 0x20
        counter += n
        data = np.frombuffer(pes, np.uint8)
        if rest == 0:  # one packet: stuffing joins its adaptation field
            room = body - len(pes) - len(first)
            packets[0, 4:] = np.frombuffer(bytes([7 + room]) + first[1:] + b"\xff" * room + pes, np.uint8)
        else:
            head = body - len(first)
            packets[0, 4:] = np.frombuffer(first + pes[:head], np.uint8)
            full, tail = divmod(rest, body)
            packets[1 : 1 + full, 4:] = data[head : head + full * body].reshape(full, body)
            if tail:
                room = body - tail  # adaptation field of room bytes, its length byte included
                stuff = bytes([room - 1]) + (b"\x00" + b"\xff" * (room - 2) if room > 1 else b"")
                packets[-1, 3] |= 0x20
                packets[-1, 4:] = np.frombuffer(stuff + pes[len(pes) - tail :], np.uint8)
        out.append(packets.tobytes())
    return b"".join(out)


def _sections(packets: np.ndarray, pid: int) -> bytes:
    rows = packets[_pids(packets) == pid]
    if not len(rows):
        raise ValueError(f"no table on PID {pid}")
    row = rows[0].tobytes()
    at = 4 + (1 + row[4] if row[3] & 0x20 else 0)
    at += 1 + row[at]
    section = row[at : at + 3 + (int.from_bytes(row[at + 1 : at + 3], "big") & 0x0FFF)]
    if crc32_mpeg(section):
        raise ValueError(f"table on PID {pid} fails its checksum")
    return section


def _pids(packets: np.ndarray) -> np.ndarray:
    return (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]


def demux(stream: bytes) -> dict:
    """payload, n_bytes, packets, pes, pts, rap (packet numbers of random-access points), pcr and cc_errors of a stream."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not a whole number of transport packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("lost sync")
    pat = _sections(packets, 0)
    programs = [int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(pat) - 4, 4) if pat[i : i + 2] != b"\x00\x00"]
    pmt = _sections(packets, programs[0])
    at = 12 + (int.from_bytes(pmt[10:12], "big") & 0x0FFF)
    data_pid, info = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF, pmt[at + 5 : at + 5 + (int.from_bytes(pmt[at + 3 : at + 5], "big") & 0x0FFF)]
    n_bytes, i = None, 0
    while i < len(info):
        if info[i] == LENGTH_TAG:
            n_bytes = int.from_bytes(info[i + 2 : i + 2 + info[i + 1]], "big")
        i += 2 + info[i + 1]
    where = np.flatnonzero(_pids(packets) == data_pid)
    own = packets[where]
    control = own[:, 3] >> 4 & 3
    # continuity: each packet with payload adds one; an exact repeat is dropped
    carries = (control & 1) == 1
    where, own, control = where[carries], own[carries], control[carries]
    counter = own[:, 3].astype(np.int16) & 15
    step = (counter[1:] - counter[:-1]) % 16
    again = np.zeros(len(own), bool)
    if len(own) > 1 and (step == 0).any():
        again[1:] = (step == 0) & (own[1:] == own[:-1]).all(axis=1)
        where, own, control, counter = where[~again], own[~again], control[~again], counter[~again]
        step = (counter[1:] - counter[:-1]) % 16
    cc_errors = int((step != 1).sum())
    extra = (control & 2) > 0
    begin = 4 + np.where(extra, own[:, 4].astype(np.int32) + 1, 0)
    flags = np.where(extra & (own[:, 4] > 0), own[:, 5], 0)
    joined = own[np.arange(PACKET) >= begin[:, None]].tobytes()
    ends = np.cumsum(PACKET - begin)
    opens = np.flatnonzero(own[:, 1] & 0x40)
    if not len(opens):
        raise ValueError("no elementary stream")
    starts = [int(ends[k] - (PACKET - begin[k])) for k in opens]
    bodies, pts = [], []
    for a, b in zip(starts, [*starts[1:], len(joined)], strict=True):
        if joined[a : a + 3] != b"\x00\x00\x01":
            raise ValueError("broken PES packet")
        head = joined[a + 8]
        if joined[a + 7] & 0x80:
            pts.append(_read_pts(joined[a + 9 : a + 14]))
        size = int.from_bytes(joined[a + 4 : a + 6], "big")
        bodies.append(joined[a + 9 + head : a + 6 + size if size else b])
    pcr = [int.from_bytes(own[k, 6:11].tobytes(), "big") >> 7 for k in np.flatnonzero(flags & 0x10)]
    payload = b"".join(bodies)
    return {"payload": payload, "n_bytes": len(payload) if n_bytes is None else n_bytes, "packets": len(packets), "pes": len(bodies), "pts": pts, "rap": where[flags & 0x40 > 0].tolist(), "pcr": pcr, "cc_errors": cc_errors}


PARSED = "struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,packets:bigint,pts:array<bigint>,rap:array<bigint>,cc_errors:bigint>"
_ARROW = pa.struct([("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("packets", pa.int64()), ("pts", pa.list_(pa.int64())), ("rap", pa.list_(pa.int64())), ("cc_errors", pa.int64())])


def to_media(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        for piece in slices(batch):
            out = []
            for x in piece:
                data = (x.as_py() or "").encode()
                out.append(mux(pad(data), len(data)))
            yield pa.array(out, pa.binary())


def parse_media(streams: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in streams:
        out = []
        for x in batch:
            if (stream := x.as_py()) is None:
                out.append(None)
                continue
            got = demux(stream)
            payload = got["payload"]
            out.append({"n_bytes": got["n_bytes"], "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:]), "media_bytes": len(stream), "media_sha256": hashlib.sha256(stream).hexdigest(), "packets": got["packets"], "pts": got["pts"], "rap": got["rap"], "cc_errors": got["cc_errors"]})
        yield pa.array(out, _ARROW)


def media_column(docs: DataFrame, text: Column, name: str = "media") -> DataFrame:
    """docs with a binary transport stream of each text."""
    return docs.withColumn(name, F.arrow_udf(to_media, "binary")(text))


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a stream, parse the stream, and return its digests, timestamps and random-access points."""
    stored = media_column(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text"))
    m = F.col("m")
    feature = F.format_string("ts;packets=%d;rap=%d;pts=%d..%d;cc_errors=%d", m["packets"], F.size(m["rap"]), F.array_min(m["pts"]), F.array_max(m["pts"]), m["cc_errors"])
    return stored.select("doc_id", F.arrow_udf(parse_media, PARSED)("media").alias("m")).select("doc_id", "m.*", feature.alias("feature"))
