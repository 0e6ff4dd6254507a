"""Media columns: MPEG audio.

``write_stream`` stores bytes losslessly in a valid variable-bitrate Layer III stream: silent
granules (all side information zero) leave each frame's main data free for ancillary bytes, the
place where the format allows foreign data. ``parse`` reads any MPEG-1/2/2.5 stream, of free format too, whose frames' size is told by the distance of two headers: it skips and
reads tags (ID3v2.2 to 2.4, ID3v1, APE), resynchronises on frame headers, reads Xing, Info and VBRI tables and holds their counts and seek
points against the frames, verifies checksums (of all three layers' frames, and of Info tags) and gives exact durations and the offset of each frame.

Free style (Arrow maps): frame headers chain by length, which columns can't express. Both maps are
narrow, a row at a time, so neither skew nor repeated rows matter.

Defined results: a null text stores as an empty one; an empty payload still gives a stream of one
table frame; a very long one a stream as long as it needs; an empty table gives no rows; a stream without any frame has zero frames, a null rate and a null duration; null media
gives nulls. Other columns pass through ``parse_media`` untouched, but one that has the name of a column that it makes gives way.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map

# Fixed values of the format: kbit/s by (version 1 or 2, layer), samples a second by version.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {10: (44100, 48000, 32000), 20: (22050, 24000, 16000), 25: (11025, 12000, 8000)}
VERSIONS = {3: 10, 2: 20, 0: 25}
SIDE_INFO = {(10, 1): 17, (10, 2): 32, (20, 1): 9, (20, 2): 17, (25, 1): 9, (25, 2): 17}
XING_FRAMES, XING_BYTES, XING_TOC = 1, 2, 4
PAYLOAD_TAG = "payload_bytes"

_STEP = []
for _n in range(256):
    _c = _n << 8
    for _ in range(8):
        _c = (_c << 1) ^ 0x8005 if _c & 0x8000 else _c << 1
    _STEP.append(_c & 0xFFFF)


def crc16(data: bytes) -> int:
    """The format's frame checksum: polynomial 0x8005, all ones at first."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _STEP[c >> 8 ^ b]
    return c


_STEP_REFLECTED = []
for _n in range(256):
    _c = _n
    for _ in range(8):
        _c = _c >> 1 ^ (0xA001 if _c & 1 else 0)
    _STEP_REFLECTED.append(_c)


def crc16_reflected(data: bytes) -> int:
    """An Info tag's checksum: the same polynomial from the low bit, zeros at first."""
    c = 0
    for b in data:
        c = c >> 8 ^ _STEP_REFLECTED[(c ^ b) & 255]
    return c


#: Bytes of a frame of free format at most: one of the highest bitrate that decoders need take, 640 kbps, at the lowest rate, and some room.
FREE_BYTES = 8192


def free_size(data: bytes, at: int, end: int) -> int | None:
    """Bytes of the frames of a stream of free format without padding, told by the distance of a header at ``at`` from the next one like it, which must lead to a third or to the end."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 2] >> 4 != 0 or not header(data, at, 64):
        return None
    alike = lambda p: p + 4 <= end and data[p] == 0xFF and data[p + 1] == data[at + 1] and data[p + 2] & 0xFD == data[at + 2] & 0xFD
    step = 4 if 4 - (data[at + 1] >> 1 & 3) == 1 else 1
    pad = lambda p: step * (data[p + 2] >> 1 & 1)
    p = data.find(b"\xff", at + 24, min(end, at + FREE_BYTES))
    while p >= 0:
        if alike(p):
            size = p - at - pad(at)
            after = p + size + pad(p)
            if after == end or alike(after):
                return size
        p = data.find(b"\xff", p + 1, min(end, at + FREE_BYTES))
    return None


def header(data: bytes, at: int, free: int | None = None) -> dict | None:
    """The frame header at ``at``, or None where there is no valid one; one that doesn't tell its bitrate is valid if ``free``, the bytes of such frames, is known."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = VERSIONS.get(b1 >> 3 & 3), 4 - (b1 >> 1 & 3)
    index, rate = b2 >> 4, b2 >> 2 & 3
    if version is None or layer == 4 or index == 15 or index == 0 and not free or rate == 3 or b3 & 3 == 2:
        return None
    hz, pad, channels = RATES[version][rate], b2 >> 1 & 1, 1 if b3 >> 6 == 3 else 2
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 10 else 1152
    if index:
        kbps = BITRATES[1 if version == 10 else 2, layer][index]
        size = (12000 * kbps // hz + pad) * 4 if layer == 1 else samples * 125 * kbps // hz + pad
    else:
        kbps, size = round(free * hz / (samples * 125)), free + pad * (4 if layer == 1 else 1)
    return {
        "at": at, "version": version, "layer": layer, "kbps": kbps, "hz": hz, "channels": channels,
        "samples": samples, "size": size, "crc": not b1 & 1, "joint": b3 >> 6 == 1, "ext": b3 >> 4 & 3,
    }


# Fixed values of the format: Layer II bits of a subband's allocation, as (subbands, bits), by table.
ALLOCATION = {"low 32": ((2, 4), (10, 3)), "low": ((2, 4), (6, 3)), "27": ((11, 4), (12, 3), (4, 2)), "30": ((11, 4), (12, 3), (7, 2)), "half rates": ((4, 4), (7, 3), (19, 2))}


def allocation(h: dict) -> list[int]:
    """Bits of each subband's allocation in a Layer II frame."""
    each = h["kbps"] // h["channels"]
    if h["version"] != 10:
        name = "half rates"
    elif each < 56:
        name = "low 32" if h["hz"] == 32000 else "low"
    else:
        name = "30" if each >= 96 and h["hz"] != 48000 else "27"
    return [bits for n, bits in ALLOCATION[name] for _ in range(n)]


def _covered_bits(data: bytes, h: dict) -> int:
    """How many bits after the checksum of a Layer II frame it covers: allocations, and the scale factor selection of each subband that is used."""
    bits, (at, n), total, used = allocation(h), (h["at"] + 6, 64), 0, 0
    word = int.from_bytes(data[at : at + n], "big")
    bound = min(4 * (h["ext"] + 1), len(bits)) if h["joint"] else len(bits)
    for sb, b in enumerate(bits):
        for own in range(h["channels"] if sb < bound else 1):
            total += b
            if word >> (8 * n - total) & (1 << b) - 1:
                used += 1 if sb < bound else h["channels"]
    return total + 2 * used


def _checksum(data: bytes, h: dict) -> bool | None:
    """Whether the frame's checksum holds; None where there is none."""
    if not h["crc"]:
        return None
    at = h["at"]
    found = int.from_bytes(data[at + 4 : at + 6], "big")
    if h["layer"] == 2:
        n = _covered_bits(data, h)
        c = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + n // 8])
        for k in range(n % 8):  # the last byte in part
            c ^= (data[at + 6 + n // 8] >> (7 - k) & 1) << 15
            c = (c << 1 ^ (0x8005 if c & 0x8000 else 0)) & 0xFFFF
        return c == found
    if h["layer"] == 1:
        bound = 4 * (h["ext"] + 1) if h["joint"] else 32
        over = 16 if h["channels"] == 1 else (bound * 8 + (32 - bound) * 4) // 8
    else:
        over = SIDE_INFO[h["version"], h["channels"]]
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + over]) == found


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text(body: bytes) -> str:
    coding = ("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0]] if body[0] < 4 else "latin-1"
    return body[1:].decode(coding, "replace").rstrip("\0")


def id3v2(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """Where the tag at ``at`` ends (``at`` itself if there is none) and its text frames, of versions 2.2 to 2.4, unsynchronised or not."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return at, {}
    major, flags, tags = data[at + 3], data[at + 5], {}
    end = at + 10 + _syncsafe(data[at + 6 : at + 10])
    after = min(end + (10 if major == 4 and flags & 0x10 else 0), len(data))
    if major not in (2, 3, 4):
        return after, tags
    raw = data[at + 10 : end]
    if flags & 0x80 and major < 4:  # all of the tag; in 2.4 it is told frame by frame
        raw = raw.replace(b"\xff\0", b"\xff")
    pos, head = 0, 6 if major == 2 else 10
    if flags & 0x40 and major >= 3 and len(raw) >= 4:
        pos = _syncsafe(raw[:4]) if major == 4 else 4 + int.from_bytes(raw[:4], "big")
    while pos + head <= len(raw) and raw[pos]:
        size = raw[pos + 3 : pos + 6] if major == 2 else raw[pos + 4 : pos + 8]
        n = _syncsafe(size) if major == 4 else int.from_bytes(size, "big")
        name, body = raw[pos : pos + (3 if major == 2 else 4)].decode("latin-1"), raw[pos + head : pos + head + n]
        if major == 4:
            told = raw[pos + 9]
            body = body[4:] if told & 1 else body  # a length goes before
            body = body.replace(b"\xff\0", b"\xff") if told & 2 or flags & 0x80 else body
        if name[0] == "T" and body:
            text = _text(body)
            if name in ("TXXX", "TXX"):
                own, _, text = text.partition("\0")
                name = f"TXXX:{own}"
            tags[name] = text
        pos += head + n
    return after, tags


def _tail_tags(data: bytes, end: int) -> tuple[int, dict[str, str]]:
    """Where the audio ends before trailing tags, and those tags."""
    tags: dict[str, str] = {}
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + lo : end + hi].split(b"\0")[0].decode("latin-1").strip():
                tags[f"ID3v1:{name}"] = text
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, count, flags = struct.unpack("<III", data[end - 20 : end - 8])
        pos, seen = max(0, end - size), 0
        while seen < count and pos + 8 <= end - 32:  # the tag's own size bounds the items
            n, kind = struct.unpack("<II", data[pos : pos + 8])
            stop = data.find(b"\0", pos + 8, end)
            if stop < 0:
                break
            if not kind & 6:
                tags["APE:" + data[pos + 8 : stop].decode("latin-1")] = data[stop + 1 : stop + 1 + n].decode("utf-8", "replace")
            pos, seen = stop + 1 + n, seen + 1
        end = max(0, end - size - (32 if flags & 0x80000000 else 0))
    return end, tags


def _table(data: bytes, h: dict) -> dict | None:
    """The variable-bitrate table in the frame ``h``, or None: its counts, its seek points, and for an Info tag its own checksum."""
    at, end = h["at"], min(h["at"] + h["size"], len(data))
    pos = at + 4 + SIDE_INFO[h["version"], h["channels"]]
    out: dict = {"kind": "VBRI", "frames": None, "bytes": None, "toc": None, "points": None, "delay": 0, "padding": 0, "crc": None}
    for pos in (pos, pos + 2):
        kind = data[pos : pos + 4]
        if kind in (b"Xing", b"Info"):
            flags, p = int.from_bytes(data[pos + 4 : pos + 8], "big"), pos + 8
            out["kind"] = kind.decode()
            for bit, key in ((XING_FRAMES, "frames"), (XING_BYTES, "bytes")):
                if flags & bit:
                    out[key] = int.from_bytes(data[p : p + 4], "big")
                    p += 4
            if flags & XING_TOC and p + 100 <= end:
                out["toc"] = data[p : p + 100]
            if pos + 156 <= end and data[pos + 120 : pos + 124] in (b"LAME", b"Lavf", b"Lavc"):
                v = int.from_bytes(data[pos + 141 : pos + 144], "big")
                out |= {"delay": v >> 12, "padding": v & 0xFFF}
                told = int.from_bytes(data[pos + 154 : pos + 156], "big")
                out["crc"] = crc16_reflected(data[at : pos + 154]) == told if told else None
            return out
    if data[at + 36 : at + 40] == b"VBRI" and at + 62 <= end:
        size, frames, n, scale, wide, each = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
        points = [int.from_bytes(data[p : p + wide], "big") * scale for p in range(at + 62, at + 62 + n * wide, wide)] if wide and at + 62 + n * wide <= end else None
        return out | {"frames": frames, "bytes": size, "points": points, "scale": scale, "each": each}
    return None


def _seeks(table: dict, frames: list[dict], begin: int, span: int) -> bool | None:
    """Whether the table's seek points lead to the frames that they should, within a step of theirs; None where it has none. The stream begins at ``begin``."""
    if table["toc"] and frames and span:
        where = [(frames[p * len(frames) // 100]["at"] - begin) * 256 // span for p in range(100)]
        return all(abs(t - min(255, w)) <= 1 for t, w in zip(table["toc"], where, strict=True))
    if table["points"] and table["each"]:
        at, ok = frames[0]["at"] if frames else 0, bool(frames)
        for k, size in enumerate(table["points"], 1):
            at += size
            frame = k * table["each"]
            ok = ok and (frame >= len(frames) or abs(frames[frame]["at"] - at) <= table["scale"] * (k + 1))
        return ok
    return None


def parse(data: bytes) -> dict:
    """Everything that a seek index needs to know of a stream."""
    pos, tags = 0, {}
    while True:
        after, more = id3v2(data, pos)
        tags |= more
        if after == pos:
            break
        pos = after
    end, more = _tail_tags(data, len(data))
    tags |= more
    frames: list[dict] = []
    resyncs = skipped = 0
    locked, free = False, None
    while pos < end:
        free = free or free_size(data, pos, end)
        h = header(data, pos, free)
        if h and (first := frames[0] if frames else None):
            h = h if all(h[k] == first[k] for k in ("version", "layer", "hz")) else None
        if h and pos + h["size"] > end:
            h = None  # a frame cut short is no frame
        if h and not locked and pos + h["size"] < end:
            nxt = header(data, pos + h["size"], free)
            if not nxt or any(nxt[k] != h[k] for k in ("version", "layer", "hz")):
                h = None
        if h:
            frames.append(h)
            pos += h["size"]
            locked = True
            continue
        resyncs += locked or not frames and not skipped
        locked = False
        nxt = data.find(b"\xff", pos + 1, end)
        nxt = end if nxt < 0 else nxt
        skipped += nxt - pos
        pos = nxt
    table = _table(data, frames[0]) if frames and frames[0]["layer"] == 3 else None
    audio = frames[1:] if table else frames
    checks = [_checksum(data, h) for h in frames]
    samples = max(0, sum(h["samples"] for h in audio) - (table["delay"] + table["padding"] if table else 0))
    hz = frames[0]["hz"] if frames else None
    agrees = seeks = None
    if table:
        span = frames[-1]["at"] + frames[-1]["size"] - frames[0]["at"]
        agrees = table["frames"] in (None, len(audio)) and table["bytes"] in (None, span)
        seeks = _seeks(table, audio, frames[0]["at"], table["bytes"] or span)
    return {
        "version": frames[0]["version"] if frames else None, "layer": frames[0]["layer"] if frames else None,
        "sample_rate": hz, "channels": frames[0]["channels"] if frames else None, "n_frames": len(audio),
        "n_samples": samples, "duration_us": samples * 1_000_000 // hz if hz else None,
        "min_kbps": min((h["kbps"] for h in audio), default=None), "max_kbps": max((h["kbps"] for h in audio), default=None),
        "vbr_table": table["kind"] if table else None, "table_agrees": agrees, "seek_agrees": seeks, "table_crc_ok": table["crc"] if table else None,
        "crc_ok": sum(c is True for c in checks), "crc_bad": sum(c is False for c in checks),
        "resyncs": int(resyncs), "skipped_bytes": skipped, "frame_offsets": [h["at"] for h in audio],
        "tags": tags, "frames": audio,
    }


def ancillary(data: bytes, found: dict) -> bytes | None:
    """The bytes stored by ``write_stream``, or None where the stream doesn't say that it has any."""
    told = found["tags"].get(f"TXXX:{PAYLOAD_TAG}")
    if told is None or not told.isdigit():
        return None
    body = []
    for h in found["frames"]:
        skip = 4 + 2 * h["crc"] + SIDE_INFO[h["version"], h["channels"]]
        body.append(data[h["at"] + skip : h["at"] + h["size"]])
    return b"".join(body)[: int(told)]


_KBPS = BITRATES[1, 3]
_HEAD = 4 + 2 + 32
#: Ancillary bytes in a 44.1 kHz stereo Layer III frame with checksum, by bitrate index.
_ROOM = {i: 144000 * k // 44100 - _HEAD for i, k in enumerate(_KBPS) if k}
_FRONT = {}
for _i in _ROOM:
    _h = bytes((0xFF, 0xFA, _i << 4, 0x00))
    _FRONT[_i] = _h + crc16(_h[2:] + bytes(32)).to_bytes(2, "big") + bytes(32)


def write_stream(payload: bytes) -> bytes:
    """``payload`` as ancillary data of a silent variable-bitrate stream with tags and a Xing table."""
    top, out, pos = max(_ROOM), [], 0
    while pos < len(payload):
        left = len(payload) - pos
        i = top if left >= _ROOM[top] else next(i for i in _ROOM if _ROOM[i] >= left)
        out.append(_FRONT[i] + payload[pos : pos + _ROOM[i]].ljust(_ROOM[i], b"\0"))
        pos += _ROOM[i]
    index, first = 5, bytes((0xFF, 0xFB, 5 << 4, 0x00))  # 64 kbit/s, without checksum
    total = 144000 * _KBPS[index] // 44100 + sum(map(len, out))
    offsets, at = [], total - sum(map(len, out))
    for f in out:
        offsets.append(at)
        at += len(f)
    toc = bytes(min(255, offsets[p * len(out) // 100] * 256 // total) if out else 0 for p in range(100))
    table = b"Xing" + struct.pack(">III", XING_FRAMES | XING_BYTES | XING_TOC, len(out), total) + toc
    first = (first + bytes(32) + table).ljust(total - sum(map(len, out)), b"\0")
    body = b"\0" + f"{PAYLOAD_TAG}\0{len(payload)}".encode("latin-1")
    frame = b"TXXX" + struct.pack(">IH", len(body), 0) + body
    size = len(frame)
    tag = b"ID3\x03\x00\x00" + bytes((size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127)) + frame
    return b"".join((tag, first, *out, b"TAG".ljust(127, b"\0") + b"\xff"))


def padded(raw: bytes, unit: int = 64) -> bytes:
    """``raw`` with zeros up to a positive multiple of ``unit``."""
    return raw.ljust(max(unit, -(-len(raw) // unit) * unit), b"\0")


MEDIA = "version int, layer int, sample_rate int, channels int, n_frames long, n_samples long, duration_us long, min_kbps int, max_kbps int, vbr_table string, table_agrees boolean, seek_agrees boolean, table_crc_ok boolean, crc_ok long, crc_bad long, resyncs long, skipped_bytes long, frame_offsets array<long>, tags map<string,string>"


def store_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: int = 64) -> DataFrame:
    """A media column: ``key``, ``n_bytes`` (before padding) and ``media``, the stored stream of each text."""

    def rows(cols: dict[str, list]) -> dict:
        raw = [(t or "").encode() for t in cols["text"]]
        return {"key": cols["key"], "n_bytes": [len(r) for r in raw], "media": [write_stream(padded(r, unit)) for r in raw]}

    kind = docs.schema[key].dataType.simpleString()
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return arrow_map(src, rows, f"key {kind}, n_bytes long, media binary", "text").withColumnRenamed("key", key)


def parse_media(df: DataFrame, media: str = "media", payload: bool = False) -> DataFrame:
    """``df`` with the struct ``mpeg`` parsed from the binary column ``media``; with ``payload`` also the bytes stored there."""
    df = df.drop("mpeg", *["payload"] * payload)
    rest = [c for c in df.columns if c != media]
    kinds = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in df.columns]
    names = [f.split()[0] for f in MEDIA.split(", ")]

    def rows(cols: dict[str, list]) -> dict:
        out = {c: cols[c] for c in rest} | {media: cols[media], "mpeg": [], "payload": []}
        for data in cols[media]:
            found = parse(data) if data is not None else None
            out["mpeg"].append(found and {k: (list(v.items()) if k == "tags" else v) for k, v in found.items() if k in names})
            out["payload"].append(ancillary(data, found) if payload and found else None)
        return out

    schema = ", ".join([*kinds, f"mpeg struct<{MEDIA.replace(' ', ':').replace(',:', ',')}>", *["payload binary"] * payload])
    return arrow_map(df, rows, schema, media)


def stored_features(docs: DataFrame) -> DataFrame:
    """Store each text as a stream, read the stored bytes back and describe them.

    The second map sees nothing but the stream: payload, digests and the feature come from what is read.
    """

    def rows(cols: dict[str, list]) -> dict:
        names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_us")
        out: dict[str, list] = {"doc_id": cols["doc_id"], "n_bytes": cols["n_bytes"]} | {n: [] for n in names}
        for data in cols["media"]:
            found = parse(data)
            body = ancillary(data, found)
            seek = zlib.crc32(b"".join(x.to_bytes(8, "little") for x in found["frame_offsets"]))
            feature = (
                f"frames={found['n_frames']};samples={found['n_samples']};hz={found['sample_rate']};us={found['duration_us']};"
                f"kbps={found['min_kbps']}-{found['max_kbps']};table={found['vbr_table']}:{found['table_agrees']}:{found['seek_agrees']};"
                f"crc={found['crc_ok']}/{found['crc_bad']};resyncs={found['resyncs']};seek={seek:08x}"
            )
            got = (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, found["n_frames"], found["duration_us"])
            for n, v in zip(names, got, strict=True):
                out[n].append(v)
        return out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_us long"
    return arrow_map(store_texts(docs), rows, schema, "media")
