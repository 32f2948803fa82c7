"""MPEG audio columns: resynchronised frame headers, tags, VBR tables, checksums, durations, seek offsets.

`wrap` puts any bytes losslessly into a playable Layer III stream: every frame has an empty granule pair
(silence), so that all bytes after its side information are ancillary data, and these hold the payload.
Frames take the largest bitrate, the last the smallest that fits (variable bitrate), with CRC words, an
ID3v2 tag (payload length), a Xing table and an ID3v1 tag. `scan` reads any MPEG audio stream: it skips
tags and junk, accepts a header only if the next one (or the end) follows where it says, verifies CRCs of
Layers I and III (Layer II CRC words are counted as unchecked: what they cover depends on allocation
tables), reads Xing/Info and VBRI tables, and returns exact sample counts and every frame's byte offset, which `catalog` stores in a
column. A duration is the sum of each frame's samples over its own rate, as a fraction, without the delay (at the first rate) and padding
(at the last) that an encoder noted. Frames of free format (no bitrate in the header) are as long as it is to the next header of their kind, once the
one after that confirms it.

Null texts count as empty; an empty text is 64 zero bytes. Equal texts, also in repeated rows, give equal streams. Very long texts are one
stream each, held by the task that has the text. An empty table gives no row; null ids and other columns don't matter.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import documents, kept, text_batches

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (MPEG-1?, layer), index 1 to 14; sample rates by version bits.
KBPS = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

RATE, SAMPLES, SIDE = 32000, 1152, 17  # what wrap writes: MPEG-1 Layer III, mono
OWNER = b"folioscope.payload\0"
SIZES = [144 * kbps * 1000 // RATE for kbps in KBPS[True, 3]]
OVERHEAD = 4 + 2 + SIDE
FULL = SIZES[-1] - OVERHEAD


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The CRC of ISO/IEC 11172-3: polynomial 0x8005, starting from all ones."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@lru_cache(maxsize=None)
def _head(index: int, protected: bool) -> bytes:
    """Header, CRC word if protected, and side information of a silent frame with this bitrate index."""
    tail = bytes([index << 4 | 2 << 2, 0xC4])
    side = bytes(SIDE)
    return bytes([0xFF, 0xFA if protected else 0xFB]) + tail + (struct.pack(">H", crc16(tail + side)) if protected else b"") + side


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def wrap(data: bytes, unit: int = 64) -> bytes:
    """data, zero-padded to a positive multiple of unit, as an MPEG audio stream."""
    size = max(unit, -(-len(data) // unit) * unit)
    body = np.zeros(size, np.uint8)
    body[: len(data)] = np.frombuffer(data, np.uint8)
    n, rest = divmod(size, FULL)
    frames = np.zeros((n, SIZES[-1]), np.uint8)
    frames[:, :OVERHEAD] = np.frombuffer(_head(14, True), np.uint8)
    frames[:, OVERHEAD:] = body[: n * FULL].reshape(n, FULL)
    audio, sizes = frames.tobytes(), [SIZES[-1]] * n
    if rest:
        index = next(i for i, s in enumerate(SIZES, 1) if s - OVERHEAD >= rest)
        audio += (_head(index, True) + body[n * FULL :].tobytes()).ljust(SIZES[index - 1], b"\0")
        sizes.append(SIZES[index - 1])
    starts = SIZES[0] + np.concatenate([[0], np.cumsum(sizes)])  # after the Xing frame
    total = int(starts[-1])
    toc = starts[np.arange(100) * len(sizes) // 100] * 256 // total
    xing = _head(1, False) + b"Xing" + struct.pack(">III", 15, len(sizes), total) + toc.astype(np.uint8).tobytes() + struct.pack(">I", 0)
    private = OWNER + struct.pack(">QQ", len(data), size)
    tag = b"PRIV" + struct.pack(">IH", len(private), 0) + private
    return b"ID3\3\0\0" + _syncsafe(len(tag)) + tag + xing.ljust(SIZES[0], b"\0") + audio + b"TAG".ljust(128, b"\0")


def header(data: bytes, at: int) -> tuple | None:
    """(MPEG-1?, layer, protected, kbit/s, rate, mono, frame bytes, samples, padding bytes) at an offset, or None if no valid header. Free format: 0 kbit/s, 0 bytes."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] < 0xE0:
        return None
    version, layer, low = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3), data[at + 2]
    if version == 1 or layer == 4 or low >> 4 == 15 or low >> 2 & 3 == 3:
        return None
    one = version == 3
    kbps, rate = (0, *KBPS[one, layer])[low >> 4], RATES[version][low >> 2 & 3]
    samples = 384 if layer == 1 else 576 if layer == 3 and not one else 1152
    pad = (low >> 1 & 1) * (4 if layer == 1 else 1)
    size = 12 * kbps * 1000 // rate * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate
    return one, layer, not data[at + 1] & 1, kbps, rate, data[at + 3] >> 6 == 3, size + pad if kbps else 0, samples, pad


#: Bytes of a frame of free format, at most: twice the largest of the table.
FREE = 5760


def _alike(a: tuple, b: tuple | None) -> bool:
    """Whether headers are of one version, layer, rate and kind of bitrate."""
    return b is not None and (a[0], a[1], a[4], a[3] > 0) == (b[0], b[1], b[4], b[3] > 0)


def _free_bytes(data: bytes, at: int, end: int, h: tuple) -> int | None:
    """Bytes, without padding, of a frame of free format: to a header alike, where one more or the end follows after as many."""
    q = at + 24
    while 0 <= (q := data.find(b"\xff", q, min(end, at + FREE))):
        if _alike(h, n := header(data, q)):
            size = q - at - h[8]
            after = q + size + n[8]
            if after == end or after < end and _alike(h, header(data, after)):
                return size
        q += 1
    return None


def _tags(data: bytes) -> tuple[int, int, dict]:
    """Where audio starts and ends, and the ID3v2 frames by name (raw values, in order)."""
    start, end, found = 0, len(data), {}
    while data[start : start + 3] == b"ID3" and start + 10 <= end:
        size = sum((b & 127) << s for b, s in zip(data[start + 6 : start + 10], (21, 14, 7, 0)))
        at, stop = start + 10, min(start + 10 + size, end)
        while at + 10 <= stop and data[at : at + 4].isalnum():
            raw = data[at + 4 : at + 8]
            n = sum((b & 127) << s for b, s in zip(raw, (21, 14, 7, 0))) if data[start + 3] >= 4 else int.from_bytes(raw)
            found.setdefault(data[at : at + 4].decode("ascii"), []).append(data[at + 10 : min(at + 10 + n, stop)])
            at += 10 + n
        start = stop + (10 if data[start + 5] & 16 else 0)
    if data[max(start, end - 128) :][:3] == b"TAG":
        end -= 128
    if data[max(start, end - 32) : end][:8] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
        end = max(start, end - size - (32 if flags >> 31 else 0))
    return start, end, found


def _table(data: bytes, at: int, one: bool, mono: bool, size: int) -> tuple[str, int, int, bytes, int, int] | None:
    """(kind, frames, bytes, seek table, encoder delay, padding) if the frame at an offset is a VBR header frame; the last two in samples, if an encoder wrote them."""
    side = (17 if mono else 32) if one else (9 if mono else 17)
    frame = data[at : at + size]
    for skip in (4 + side, 6 + side):
        if frame[skip : skip + 4] in (b"Xing", b"Info"):
            flags, p, n = int.from_bytes(frame[skip + 4 : skip + 8]), skip + 8, [0, 0]
            for k in (0, 1):
                if flags >> k & 1:
                    n[k], p = int.from_bytes(frame[p : p + 4]), p + 4
            toc = frame[p : p + 100] if flags & 4 else b""
            p += 100 * (flags >> 2 & 1) + 4 * (flags >> 3 & 1)
            cut = int.from_bytes(frame[p + 21 : p + 24]) if frame[p : p + 4] in (b"LAME", b"Lavc", b"Lavf") and p + 24 <= size else 0
            return frame[skip : skip + 4].decode(), n[0], n[1], toc, cut >> 12, cut & 4095
    if frame[36:40] == b"VBRI":
        size, frames, entries, scale, width = *struct.unpack(">II", frame[46:54]), *struct.unpack(">HHH", frame[54:60])
        return "VBRI", frames, size, frame[62 : 62 + entries * width], 0, 0
    return None


def scan(data: bytes) -> dict:
    """What a stream holds. Bytes between frames that are no frame count as skipped (resynchronisation)."""
    at, end, tags = _tags(data)
    out = {"tags": tags, "vbr": None, "rate": 0, "last_rate": 0, "samples": 0, "seconds": Fraction(0), "crc_ok": 0, "crc_bad": 0, "crc_unchecked": 0, "skipped": 0}
    offsets, bodies, before, free, played = [], [], None, None, Counter()  # before: the header of the frame just before
    while at < end:
        h = header(data, at)
        if h is not None and not h[3]:
            free = free if _alike(h, before) else _free_bytes(data, at, end, h)
            h = None if free is None else (*h[:6], free + h[8], *h[7:])
        if h is not None and not _alike(h, before):  # to be confirmed by the next header, or by the end
            after = at + h[6]
            if after > end or after < end and not _alike(h, header(data, after)):
                h = None
        if h is None or at + h[6] > end:
            sync = data.find(b"\xff", at + 1, end)
            out["skipped"] += (sync if sync >= 0 else end) - at
            at, before = sync if sync >= 0 else end, None
            continue
        one, layer, protected, _, rate, mono, size, samples, _ = h
        side = 0 if layer != 3 else (17 if mono else 32) if one else (9 if mono else 17)
        if not offsets and out["vbr"] is None and layer == 3 and (table := _table(data, at, one, mono, size)):
            out["vbr"] = table
        else:
            if protected:
                covered = side if layer == 3 else (16 if mono else 32) if layer == 1 and data[at + 3] >> 6 != 1 else None
                if covered is None:
                    out["crc_unchecked"] += 1
                else:
                    good = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + covered]) == int.from_bytes(data[at + 4 : at + 6])
                    out["crc_ok" if good else "crc_bad"] += 1
            offsets.append(at)
            bodies.append((at + 4 + 2 * protected + side, at + size))
            played[rate] += samples
            out["rate"], out["last_rate"] = out["rate"] or rate, rate
        at, before = at + size, h
    out["samples"], out["seconds"] = sum(played.values()), sum((Fraction(n, r) for r, n in played.items()), Fraction(0))
    return out | {"offsets": offsets, "bodies": bodies}


def unwrap(data: bytes, found: dict | None = None) -> tuple[int, bytes]:
    """(unpadded length, padded payload) of a stream that wrap made."""
    found = found or scan(data)
    mark = next(x for x in found["tags"]["PRIV"] if x.startswith(OWNER))
    n, size = struct.unpack(">QQ", mark[len(OWNER) :])
    return n, b"".join(data[a:b] for a, b in found["bodies"])[:size]


def _wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        media = [wrap((t or "").encode()) for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])


CATALOG = (
    "doc_id long, media_bytes long, media_sha256 string, n_frames long, sample_rate int, n_samples long, encoder_delay int, encoder_padding int, duration_us long, vbr_kind string, "
    "vbr_frames long, vbr_bytes long, crc_ok long, crc_bad long, crc_unchecked long, skipped_bytes long, seek_offsets array<long>, "
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long"
)


def _catalogued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for doc_id, media in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist()):
            media = media or b""
            x = scan(media)
            n, payload = unwrap(media, x) if "PRIV" in x["tags"] and any(v.startswith(OWNER) for v in x["tags"]["PRIV"]) else (None, None)
            kind, frames, size, _, delay, padding = x["vbr"] or (None, None, None, None, 0, 0)
            played = x["seconds"] - Fraction(delay, x["rate"] or 1) - Fraction(padding, x["last_rate"] or 1)
            rows.append({
                "doc_id": doc_id, "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "n_frames": len(x["offsets"]),
                "sample_rate": x["rate"], "n_samples": x["samples"], "encoder_delay": delay, "encoder_padding": padding, "duration_us": max(0, played * 1_000_000 // 1),
                "vbr_kind": kind, "vbr_frames": frames, "vbr_bytes": size, "crc_ok": x["crc_ok"], "crc_bad": x["crc_bad"],
                "crc_unchecked": x["crc_unchecked"], "skipped_bytes": x["skipped"], "seek_offsets": x["offsets"], "n_bytes": n,
                "payload_bytes": None if payload is None else len(payload), "payload_sha256": None if payload is None else hashlib.sha256(payload).hexdigest(),
                "tail_crc32": None if payload is None else zlib.crc32(payload[-64:]),
            })
        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)


_SCHEMA = pa.schema(
    [(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[k]) for n, k in (x.split() for x in CATALOG.split(", "))]
)


def as_audio(docs: DataFrame) -> DataFrame:
    """doc_id, media: each whole text as an MPEG audio stream."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_wrapped, "doc_id long, media binary")


def catalog(media: DataFrame) -> DataFrame:
    """The columns of CATALOG for a table of doc_id, media; payload columns are null for streams that wrap didn't make."""
    return media.select("doc_id", "media").mapInArrow(_catalogued, CATALOG)


def op1_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    stored = kept(as_audio(documents(spark, sf_dir)), "media")
    x = kept(catalog(stored), "catalog")
    feature = F.concat_ws(
        ";",
        *(F.concat(F.lit(f"{n}="), F.coalesce(F.col(n).cast("string"), F.lit("-"))) for n in ("n_frames", "n_samples", "sample_rate", "vbr_kind", "vbr_frames", "crc_ok", "crc_bad", "skipped_bytes")),
        F.concat(F.lit("seek="), F.sha2(F.concat_ws(",", F.col("seek_offsets").cast("array<string>")), 256).substr(1, 16)),
    )
    return x.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"),
        "n_frames", "duration_us", "crc_bad", "seek_offsets",
    )
