"""MPEG audio columns: write payloads as frames, and read any stream's frames, tags and seek offsets.

`stored_audio` keeps bytes losslessly in the ancillary data of Layer III frames (44.1 kHz, mono, CRC on):
an ID3v2 tag, a Xing frame with the frame count, byte count and seek table, then full frames of the
highest bit rate and a last one of the lowest rate that holds the rest. `probe_audio` takes any bytes:
it skips tags, looks for the next header whose successor is a header too (so it finds its way back after
junk), checks the CRC of each frame of any layer, and reports exact sample counts and the offset of every frame.
Streams of free format take the distance between their first two headers as the frame size.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, widened

# Fixed values of the MPEG-1/2/2.5 audio formats: bit rates (kbit/s) by index, sample rates, samples a frame.
RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}

#: Bits of the allocation of each subband in Layer II, by table: two for low sampling rates and four by rate and sampling.
ALLOCATION = {"low": (4,) * 4 + (3,) * 7 + (2,) * 19, "a": (4,) * 11 + (3,) * 12 + (2,) * 4, "b": (4,) * 11 + (3,) * 12 + (2,) * 7, "c": (4,) * 2 + (3,) * 6, "d": (4,) * 2 + (3,) * 10}

HEADER, CRC, SIDE = 4, 2, 17
#: Most bytes that a frame of free format is looked through for its successor.
FREE = 8192
#: Rows an output batch holds: bounds what a task keeps of the stored bytes.
ROWS = 256


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005) & 0xFFFF if c & 0x8000 else (c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


@lru_cache(maxsize=4096)
def header(raw: bytes, free: int = 0) -> tuple[int, int, int, int, bool, float, int] | None:
    """(frame bytes, samples, hertz, side-information bytes, has CRC, version, layer) of four header bytes, or None.

    `free` is the size of an unpadded frame where the header leaves the rate open (free format); 0: such headers are none.
    """
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2.0, 3: 1.0}.get((raw[1] >> 3) & 3)
    layer = {1: 3, 2: 2, 3: 1}.get((raw[1] >> 1) & 3)
    rate, hz, pad = raw[2] >> 4, (raw[2] >> 2) & 3, (raw[2] >> 1) & 1
    if version is None or layer is None or rate == 15 or rate == 0 and not free or hz == 3:
        return None
    family = 1 if version == 1.0 else 2
    bits, hertz, samples = RATES[family, layer][rate] * 1000, HERTZ[version][hz], SAMPLES[family, layer]
    size = (12 * bits // hertz + pad) * 4 if layer == 1 else samples // 8 * bits // hertz + pad
    if rate == 0:
        size = free + pad * (4 if layer == 1 else 1)
    mono = raw[3] >> 6 == 3
    side = 0 if layer != 3 else (17 if mono else 32) if family == 1 else (9 if mono else 17)
    return size, samples, hertz, side, not raw[1] & 1, version, layer


def _frame_heads() -> list[tuple[int, bytes]]:
    """(room for payload, header + CRC + empty side information) by rising bit rate."""
    out = []
    for rate in range(1, 15):
        head = bytes([0xFF, 0xFA, rate << 4, 0xC0])
        side = bytes(SIDE)
        out.append((header(head)[0] - HEADER - CRC - SIDE, head + crc16(head[2:] + side).to_bytes(2, "big") + side))
    return out


_HEADS = _frame_heads()


def synchsafe(n: int) -> bytes:
    return bytes([(n >> 21) & 127, (n >> 14) & 127, (n >> 7) & 127, n & 127])


def tag_of(**texts: str) -> bytes:
    """An ID3v2.3 tag of user-defined text frames."""
    body = b""
    for k, v in texts.items():
        frame = b"\0" + k.encode("latin-1") + b"\0" + v.encode("latin-1")
        body += b"TXXX" + len(frame).to_bytes(4, "big") + b"\0\0" + frame
    return b"ID3\x03\x00\x00" + synchsafe(len(body)) + body


def encode(payload: bytes) -> bytes:
    room, head = _HEADS[-1]
    full = len(payload) // room
    parts = [head + payload[i * room : (i + 1) * room] for i in range(full)]
    rest = payload[full * room :]
    if rest:
        small, top = next(x for x in _HEADS if x[0] >= len(rest))
        parts.append(top + rest + bytes(small - len(rest)))
    first_room, first = _HEADS[5]
    total = len(first) + first_room + sum(map(len, parts))
    at, marks = len(first) + first_room, []
    for p in parts:
        marks.append(at)
        at += len(p)
    toc = bytes(min(255, 256 * (marks[len(marks) * i // 100] if marks else 0) // total) for i in range(100))
    info = b"Xing" + (7).to_bytes(4, "big") + len(parts).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return tag_of(payload_bytes=str(len(payload))) + first + info + bytes(first_room - len(info)) + b"".join(parts)


def skip_tags(data: bytes) -> tuple[int, int, dict[str, str], list[str]]:
    """(first, end) of what is not tags, the user-defined texts, and the kinds of tags found."""
    first, end, texts, kinds = 0, len(data), {}, []
    while data[first : first + 3] == b"ID3" and first + 10 <= len(data):
        n = 0
        for b in data[first + 6 : first + 10]:
            n = n << 7 | b & 127
        at, stop = first + 10, min(len(data), first + 10 + n)
        while at + 10 <= stop and data[at : at + 4].strip(b"\0"):
            size = int.from_bytes(data[at + 4 : at + 8], "big")
            if data[at : at + 4] == b"TXXX" and size:
                k, _, v = data[at + 11 : at + 10 + size].partition(b"\0")
                texts[k.decode("latin-1")] = v.decode("latin-1")
            at += 10 + size
        first, kinds = stop + 10 * bool(data[first + 5] & 16), [*kinds, "id3v2"]
    if end - first >= 128 and data[end - 128 : end - 125] == b"TAG":
        end, kinds = end - 128, [*kinds, "id3v1"]
    if end - first >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        n = int.from_bytes(data[end - 20 : end - 16], "little") + 32 * (data[end - 9] >> 7)
        end, kinds = max(first, end - n), [*kinds, "ape"]
    return first, end, texts, kinds


def free_size(data: bytes, at: int, end: int) -> int:
    """Size without padding of the frame of free format at `at`, by its distance to the next header like it; 0 if there is none."""
    raw = data[at : at + HEADER]
    if not header(raw, 1) or raw[2] >> 4:
        return 0
    step, limit = at + HEADER, min(end, at + FREE)
    while (step := data.find(raw[:2], step, limit)) >= 0:
        near = data[step : step + HEADER]
        if len(near) == HEADER and near[2] & 0xFC == raw[2] & 0xFC:
            return step - at - (raw[2] >> 1 & 1) * (4 if header(raw, 1)[6] == 1 else 1)
        step += 1
    return 0


def frames(data: bytes, at: int, end: int):
    """(offset, header) of each frame; a header counts when another follows it, or the end does, or it is in step."""
    in_step, free = False, 0
    while at + HEADER <= end:
        h = header(data[at : at + 4], free)
        if not h and not free and data[at] == 0xFF and (size := free_size(data, at, end)):
            h = header(data[at : at + 4], size)
            free = size if h and at + h[0] <= end else 0
        if h and at + h[0] <= end and (in_step or at + h[0] == end or header(data[at + h[0] : at + h[0] + 4], free)):
            yield at, h
            at += h[0]
            in_step = True
            continue
        in_step = False
        at = data.find(b"\xff", at + 1, end)
        if at < 0:
            return


def protected_bits(head: bytes, body: bytes) -> int:
    """How many bits after the CRC it covers, in a frame of Layer I or II: the allocation, and in Layer II the scale factor choices."""
    _, _, hertz, _, _, version, layer = header(head, 1)
    mode, bound = head[3] >> 6, ((head[3] >> 4 & 3) + 1) * 4
    channels = 1 if mode == 3 else 2
    if layer == 1:
        table_ = (4,) * 32
    else:
        kbits = RATES[1 if version == 1.0 else 2, 2][head[2] >> 4] / channels
        name = "low" if version != 1.0 else "a" if hertz == 48000 and kbits >= 56 or 56 <= kbits <= 80 else "b" if hertz != 48000 and kbits >= 96 else "c" if hertz != 32000 and kbits <= 48 else "d"
        table_ = ALLOCATION[name]
    bits, size, at, chosen = int.from_bytes(body, "big"), len(body) * 8, 0, 0
    for band, n in enumerate(table_):
        shared = mode == 1 and band >= bound  # joint stereo: one allocation for both channels above the bound
        for _ in range(1 if shared else channels):
            value = bits >> max(0, size - at - n) & ((1 << n) - 1)
            at += n
            chosen += (value > 0) * (channels if shared else 1)
    return at + (2 * chosen if layer == 2 else 0)


def crc_bits(data: bytes, n: int) -> int:
    """CRC of the first n bits."""
    c = crc16(data[: n // 8])
    for i in range(n // 8 * 8, n):
        bit = data[i // 8] >> (7 - i % 8) & 1
        c = (c << 1 & 0xFFFF) ^ (0x8005 if (c >> 15) ^ bit else 0)
    return c


def vbr_table(data: bytes, at: int, h) -> dict | None:
    """What a Xing, Info or VBRI table in the frame at `at` says: kind, frames, bytes, toc."""
    for skip in (HEADER + h[3], HEADER + CRC + h[3]):
        kind = data[at + skip : at + skip + 4]
        if kind in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(data[at + skip + 4 : at + skip + 8], "big"), at + skip + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
            out["toc"] = list(data[p : p + 100]) if flags & 4 else []
            return out
    p = at + HEADER + 32
    if data[p : p + 4] == b"VBRI":
        entries, scale, size, _ = (int.from_bytes(data[p + i : p + i + 2], "big") for i in (18, 20, 22, 24))
        lengths = [int.from_bytes(data[p + 26 + i * size : p + 26 + (i + 1) * size], "big") * scale for i in range(entries)] if 1 <= size <= 4 else []
        return {"kind": "VBRI", "bytes": int.from_bytes(data[p + 10 : p + 14], "big"), "frames": int.from_bytes(data[p + 14 : p + 18], "big"), "toc": list(accumulate(lengths))}
    return None


def parse(data: bytes) -> dict:
    """Everything probe_audio reports of one stream, and `body`: the ancillary bytes of frames without coded audio."""
    first, end, texts, kinds = skip_tags(data)
    table_, samples, hertz, ok, bad, skipped, offsets, body, expected = None, 0, 0, 0, 0, 0, [], [], first
    for at, h in frames(data, first, end):
        size, n, hz, side, has_crc, _, layer = h
        skipped, expected = skipped + at - expected, at + size
        start = at + HEADER + CRC * has_crc
        if has_crc:
            if layer == 3:
                found = crc16(data[at + 2 : at + 4] + data[start : start + side])
            else:
                body_ = data[start : min(at + size, start + 64)]
                found = crc_bits(data[at + 2 : at + 4] + body_, 16 + min(protected_bits(data[at : at + 4], body_), 8 * len(body_)))
            good = found == int.from_bytes(data[at + 4 : at + 6], "big")
            ok, bad = ok + good, bad + (not good)
        if not offsets and table_ is None and (vbr := vbr_table(data, at, h)):
            table_ = vbr  # this frame holds the table, no sound
            continue
        offsets.append(at)
        samples, hertz = samples + n, hertz or hz
        if layer == 3 and not any(data[start : start + side]):
            body.append(data[start + side : at + size])
    skipped += end - expected if offsets or table_ else end - first
    return {"tags": ",".join(kinds), "texts": texts, "vbr": table_, "frames": len(offsets), "samples": samples, "hertz": hertz, "crc_ok": ok, "crc_bad": bad, "skipped_bytes": skipped, "seek": offsets, "body": body}


PROBE = {"tags": "string", "vbr": "string", "vbr_frames": "long", "frames": "long", "samples": "long", "hertz": "int", "seconds": "double", "crc_ok": "long", "crc_bad": "long", "skipped_bytes": "long", "seek": "array<long>"}


def _mapped(df: DataFrame, column: str, added: dict[str, str], what) -> DataFrame:
    """`df` with columns made from one column, ROWS rows at a time; columns of those names are replaced."""
    df = df.drop(*[c for c in added if c != column])
    schema = widened(df, **added)
    names = list(added)

    def run(batches):
        for batch in batches:
            for at in range(0, max(1, batch.num_rows), ROWS):
                part = batch.slice(at, ROWS)
                rows = [what(x) for x in part.column(column).to_pylist()]
                for i, n in enumerate(names):
                    part = part.append_column(n, pa.array([r[i] for r in rows], ARROW[added[n]]))
                yield part

    return df.mapInArrow(run, schema)


ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}


def stored_audio(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """`df` with `media`, an audio stream that holds the bytes of `payload`; a null payload counts as empty.

    Payloads of any length are stored whole; equal ones, repeated rows too, give equal streams. An empty table stays
    empty. A caller's column of that name is replaced.
    """
    return _mapped(df, payload, {media: "binary"}, lambda x: (encode(x or b""),))


def probe_audio(df: DataFrame, media: str = "media") -> DataFrame:
    """`df` with the columns of PROBE; null, empty or foreign bytes have no frames and count as skipped.

    Streams of any length are read whole; equal ones give equal columns. An empty table stays empty. A caller's columns
    of these names are replaced.
    """

    def one(data):
        got = parse(data or b"")
        vbr = got["vbr"] or {}
        return (got["tags"], vbr.get("kind"), vbr.get("frames"), got["frames"], got["samples"], got["hertz"], got["samples"] / got["hertz"] if got["hertz"] else 0.0, got["crc_ok"], got["crc_bad"], got["skipped_bytes"], got["seek"])

    return _mapped(df, media, PROBE, one)


def read_payload(data: bytes) -> bytes:
    got = parse(data)
    return b"".join(got["body"])[: int(got["texts"].get("payload_bytes", 0))]


def op2_media(spark, sf_dir: str) -> DataFrame:
    """All `documents` stored as audio streams, read back and measured: see `stored_audio` and `probe_audio` for the awkward rows.

    `seconds` is the duration by the frames, `seek` the byte offsets of all frames, comma-joined.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    n = F.octet_length("raw")
    padding = F.greatest(F.ceil(n / 64), F.lit(1)) * 64 - n
    payload = F.concat(F.col("raw"), F.unhex(F.expr("repeat('00', cast(_pad as int))")))
    padded = docs.withColumn("_pad", padding).select("doc_id", n.cast("long").alias("n_bytes"), payload.alias("payload"))
    media = stored_audio(padded).drop("payload")

    def digest(data):
        got = parse(data)
        back = b"".join(got["body"])[: int(got["texts"]["payload_bytes"])]
        seek = hashlib.md5(b"".join(x.to_bytes(8, "big") for x in got["seek"])).hexdigest()
        feature = f"{got['vbr']['kind']}:{got['vbr']['frames']}:{got['frames']}:{got['samples']}/{got['hertz']}:{got['crc_ok']}:{got['crc_bad']}:{got['skipped_bytes']}:{seek}"
        seconds, offsets = got["samples"] / got["hertz"] if got["hertz"] else 0.0, ",".join(map(str, got["seek"]))
        return len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, seconds, offsets

    added = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "seconds": "double", "seek": "string"}
    return _mapped(media, "media", added, digest).drop("media")
