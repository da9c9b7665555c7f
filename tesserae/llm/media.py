"""Media columns: motion-JPEG in AVI, read by its RIFF index, decoded frame by frame, and cut into shots.

Storage. A JPEG frame stores bytes without loss in its own unit, the quantised DCT coefficient: all quantisers are 1
and byte b is the coefficient b (128 to 255) or b - 255 (0 to 127). These are the 256 values of size category
8, and their extra bits are b itself; with a table that codes category 8 in one bit, each byte takes nine. A minimum
coded unit of three components of 8 x 8 coefficients holds 192 bytes in 216 and ends on a byte, with
a restart marker behind it, so that prediction never reaches over. A frame holds `MCUS` of them in a row; the length
of the payload stands in the file's INFO list.

Reading. RIFF chunks are walked to the `movi` list and the `idx1` index, whose entries give each frame's place
and size; a file without an index is walked chunk by chunk. Frames are baseline JPEG: any quantisation and Huffman
tables, restart intervals, and sampling factors. Frames whose only codes are the one-bit ones above are unpacked
at once with numpy; all others are decoded bit by bit.

Shots. Each frame's luma, by inverse DCT in exact integer arithmetic, gives a histogram of `BINS` bins. The
difference of neighbouring frames starts a new shot where it exceeds the mean of the last `WINDOW` differences by
`FACTOR` standard deviations and is at least `FLOOR`. A clip is a run of frames with its times in seconds.

Defined results: a null or empty text is stored as 192 blanks; null media have no clips; media that aren't an AVI
file of baseline JPEG frames raise ValueError; equal payloads give equal files and features; an empty table gives
an empty table; only the named columns are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.session import table

UNIT = 192
MCUS, MICROSECONDS = 8, 40_000
BINS, WINDOW, FACTOR, FLOOR = 16, 8, 2.0, 0.05

# Zigzag order of the JPEG standard, as places in a row-wise 8 x 8 block.
ZIGZAG = np.array(
    [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
     35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
)
_SCALE = 1 << 13


@lru_cache(maxsize=1)
def _inverse() -> np.ndarray:
    """Zigzag coefficients to samples, as whole numbers times _SCALE: sums stay exact in doubles."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    one = np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)
    return np.rint(np.kron(one, one)[ZIGZAG] * _SCALE)


# ---- frames


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, codes: dict[int, int]) -> bytes:
    """A table by code length for each symbol, in order."""
    lengths = sorted(codes.items(), key=lambda x: x[1])
    return bytes([kind]) + bytes(sum(n == k for _, n in lengths) for k in range(1, 17)) + bytes(s for s, _ in lengths)


@lru_cache(maxsize=1)
def _frame_head() -> bytes:
    parts = [_segment(0xDB, b"\0" + bytes([1] * 64)), _segment(0xC0, struct.pack(">BHHB", 8, 8, 8 * MCUS, 3) + bytes(x for c in (1, 2, 3) for x in (c, 0x11, 0)))]
    parts += [_segment(0xC4, _huffman(0x00, {8: 1, 0: 2})), _segment(0xC4, _huffman(0x10, {8: 1, 0: 2}))]
    parts += [_segment(0xDD, struct.pack(">H", 1)), _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))]
    return b"\xff\xd8" + b"".join(parts)


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG frames that hold the payload; the last one is filled up with blanks."""
    size = MCUS * UNIT
    data = np.frombuffer(payload + b" " * (-len(payload) % size), np.uint8)
    bits = np.zeros((len(data), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(data).reshape(-1, 8)
    units = np.packbits(bits).reshape(-1, UNIT * 9 // 8)
    plain = not (units == 0xFF).any()
    head, frames = _frame_head(), []
    for k in range(0, len(units), MCUS):
        if plain:
            row = np.empty((MCUS, units.shape[1] + 2), np.uint8)
            row[:, :-2] = units[k : k + MCUS]
            row[:, -2], row[:, -1] = 0xFF, 0xD0 + np.arange(MCUS) % 8
            body = row.tobytes()[:-2]
        else:
            body = b"".join(units[k + i].tobytes().replace(b"\xff", b"\xff\0") + bytes([0xFF, 0xD0 + i % 8]) for i in range(MCUS))[:-2]
        frames.append(head + body + b"\xff\xd9")
    return frames


class Bits:
    """Bits of an entropy-coded segment without its stuffed bytes."""

    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), 8 * len(data)

    def peek(self, n: int) -> int:
        return (self.value >> (self.left - n)) & ((1 << n) - 1) if self.left >= n else (self.value << (n - self.left)) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        got = self.peek(n)
        self.left -= n
        if self.left < 0:
            raise ValueError("a JPEG scan ends early")
        if self.left % 4096 == 0:
            self.value &= (1 << self.left) - 1
        return got

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        for n in range(1, 17):
            if (s := codes.get((n, self.peek(n)))) is not None:
                self.take(n)
                return s
        raise ValueError("a JPEG scan holds an unknown code")

    def signed(self, n: int) -> int:
        x = self.take(n) if n else 0
        return x if not n or x >> (n - 1) else x - (1 << n) + 1


class Frame:
    """A baseline JPEG's tables and its entropy-coded bytes."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG frame")
        self.quant: dict[int, np.ndarray] = {}
        self.codes: dict[int, dict[tuple[int, int], int]] = {}
        self.restart, self.parts, at = 0, [], 2
        while True:
            if data[at] != 0xFF:
                raise ValueError("a JPEG marker is missing")
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    self.codes[body[0]], n = self._table(body)
                    body = body[n:]
            elif marker in (0xC0, 0xC1):
                self.height, self.width = struct.unpack(">HH", body[1:5])
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
            elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("only baseline JPEG frames are read")
            elif marker == 0xDD:
                self.restart = int.from_bytes(body[:2], "big")
            elif marker == 0xDA:
                self.tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                self.scan = data[at : data.rindex(b"\xff\xd9")]
                return

    @staticmethod
    def _table(body: bytes) -> tuple[dict[tuple[int, int], int], int]:
        codes, code, at = {}, 0, 17
        for n in range(1, 17):
            for _ in range(body[n]):
                codes[n, code] = body[at]
                code, at = code + 1, at + 1
            code <<= 1
        return codes, at

    def segments(self) -> list[bytes]:
        """The scan between restart markers, without stuffed bytes."""
        out, at, begun = [], 0, 0
        while (at := self.scan.find(b"\xff", at)) >= 0:
            if at + 1 < len(self.scan) and 0xD0 <= self.scan[at + 1] <= 0xD7:
                out.append(self.scan[begun:at])
                begun = at + 2
            at += 2
        return [x.replace(b"\xff\0", b"\xff") for x in [*out, self.scan[begun:]]]

    def uniform(self) -> bool:
        """Whether every coefficient must be a one-bit code and eight bits, a unit of three blocks to each segment."""
        sampled = len(self.parts) == 3 and self.restart == 1 and all(h == v == 1 for _, h, v, _ in self.parts)
        return sampled and all(self.codes.get(k, {}).get((1, 0)) == 8 for d, a in self.tables.values() for k in (d, 0x10 | a))

    def coefficients(self) -> np.ndarray:
        """[unit, block, coefficient in zigzag order], before multiplication by the quantisers."""
        blocks = [(c, self.codes[self.tables[c][0]], self.codes[0x10 | self.tables[c][1]]) for c, h, v, _ in self.parts for _ in range(h * v if len(self.parts) > 1 else 1)]
        hi, vi = max(h for _, h, _, _ in self.parts), max(v for _, _, v, _ in self.parts)
        hi, vi = (hi, vi) if len(self.parts) > 1 else (1, 1)
        units = -(-self.width // (8 * hi)) * -(-self.height // (8 * vi))
        out = np.zeros((units, len(blocks), 64), np.int64)
        step = self.restart or units
        for k, data in enumerate(self.segments()):
            bits, before = Bits(data), dict.fromkeys(self.tables, 0)
            for u in range(k * step, min(units, (k + 1) * step)):
                for b, (c, dc, ac) in enumerate(blocks):
                    before[c] += bits.signed(bits.symbol(dc))
                    out[u, b, 0] = before[c]
                    i = 1
                    while i < 64:
                        s = bits.symbol(ac)
                        if not s:
                            break
                        i += s >> 4
                        if s != 0xF0:
                            out[u, b, i] = bits.signed(s & 15)
                        i += 1
        return out


def uniform_bytes(frames: list[Frame]) -> np.ndarray | None:
    """The coded bytes of frames that are all uniform, [unit, byte]; None if any has another code."""
    width, rows = UNIT * 9 // 8, []
    for f in frames:
        units = -(-f.width // 8) * -(-f.height // 8)
        if len(f.scan) == units * (width + 2) - 2 and b"\xff\0" not in f.scan:
            rows.append(np.frombuffer(f.scan + b"\xff\xd0", np.uint8).reshape(units, width + 2)[:, :-2])
        else:
            parts = f.segments()
            if any(len(x) != width for x in parts):
                return None
            rows.append(np.frombuffer(b"".join(parts), np.uint8).reshape(-1, width))
    bits = np.unpackbits(np.concatenate(rows)).reshape(-1, 9)
    return None if bits[:, 0].any() else np.packbits(bits[:, 1:]).reshape(-1, UNIT)


def byte_values(coded: np.ndarray) -> np.ndarray:
    return coded.astype(np.int16) - np.where(coded < 128, 255, 0).astype(np.int16)


def decode_frames(frames: list[bytes]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Coefficients [unit, block, 64], before and luma coefficients after the quantisers, of each frame."""
    read = [Frame(x) for x in frames]
    if read and all(f.uniform() for f in read) and (coded := uniform_bytes(read)) is not None:
        ends = np.cumsum([-(-f.width // 8) * -(-f.height // 8) for f in read])
        raw = np.split(byte_values(coded).reshape(-1, 3, 64), ends[:-1])
    else:
        raw = [f.coefficients() for f in read]
    luma = []
    for f, c in zip(read, raw):
        n = f.parts[0][1] * f.parts[0][2] if len(f.parts) > 1 else 1
        q = f.quant[f.parts[0][3]]
        luma.append((c[:, :n] if (q == 1).all() else c[:, :n] * q).reshape(-1, 64))
    return raw, luma


# ---- files


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(payload: bytes) -> bytes:
    frames = encode_frames(payload)
    width, height, largest = 8 * MCUS, 8, max(map(len, frames))
    avih = struct.pack("<14I", MICROSECONDS, largest * 1_000_000 // MICROSECONDS, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, MICROSECONDS, 1_000_000, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload_bytes=%d\0" % len(payload)))
    index, movi, at = [], [b"movi"], 4
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        movi.append(_chunk(b"00dc", f))
        at += len(movi[-1])
    body = b"AVI " + head + info + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


def read_avi(media: bytes) -> tuple[list[bytes], int, int | None]:
    """Frames in the order of the index, microseconds to a frame, and the payload's length if the file says so."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    lasts, length, movi, index = MICROSECONDS, None, None, None

    def walk(at: int, end: int) -> None:
        nonlocal lasts, length, movi, index
        while at + 8 <= end:
            name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
            if name == b"LIST":
                kind = media[at + 8 : at + 12]
                if kind == b"movi":
                    movi = (at + 8, at + 8 + size)
                else:
                    walk(at + 12, at + 8 + size)
            elif name == b"avih":
                lasts = int.from_bytes(media[at + 8 : at + 12], "little")
            elif name == b"ICMT" and media[at + 8 : at + 22] == b"payload_bytes=":
                length = int(media[at + 22 : at + 8 + size].rstrip(b"\0"))
            elif name == b"idx1":
                index = list(struct.iter_unpack("<4sIII", media[at + 8 : at + 8 + size]))
            at += 8 + size + size % 2

    walk(12, min(len(media), 8 + int.from_bytes(media[4:8], "little")))
    if movi is None:
        raise ValueError("an AVI file without frames")
    if index is None:
        places, at = [], movi[0] + 4
        while at + 8 <= movi[1]:
            size = int.from_bytes(media[at + 4 : at + 8], "little")
            places.append((media[at : at + 4], at, size))
            at += 8 + size + size % 2
    else:  # offsets count from the list's name, or, in some files, from the file's start
        base = movi[0] if not index or media[movi[0] + index[0][2] : movi[0] + index[0][2] + 4] == index[0][0] else 0
        places = [(name, base + at, size) for name, _, at, size in index]
    return [media[at + 8 : at + 8 + size] for name, at, size in places if name[2:] in (b"dc", b"db")], lasts, length


def payload_of(raw: list[np.ndarray], length: int | None) -> bytes:
    values = np.concatenate(raw).ravel() if raw else np.empty(0, np.int16)
    return np.where(values < 0, values + 255, values).astype(np.uint8).tobytes()[:length]


# ---- shots


def cuts(luma: list[np.ndarray]) -> list[int]:
    """The first frame of each shot but the first."""
    if len(luma) < 2:
        return []
    sizes = np.fromiter(map(len, luma), np.int64, len(luma))
    samples = np.floor(np.concatenate(luma).astype(np.float64) @ _inverse() / _SCALE + 0.5) + 128
    bins = np.clip(samples, 0, 255).astype(np.int64) * BINS // 256
    owner = np.repeat(np.arange(len(luma)), sizes * 64)
    histograms = np.bincount(owner * BINS + bins.ravel(), minlength=len(luma) * BINS).reshape(-1, BINS)
    shares = histograms / (64 * sizes[:, None])
    change = np.abs(np.diff(shares, axis=0)).sum(axis=1) / 2
    sums, squares = np.concatenate([[0], np.cumsum(change)]), np.concatenate([[0], np.cumsum(change**2)])
    at = np.arange(len(change))
    first = np.maximum(at - WINDOW, 0)
    n = np.maximum(at - first, 1)
    mean = (sums[at] - sums[first]) / n
    spread = np.sqrt(np.maximum((squares[at] - squares[first]) / n - mean**2, 0))
    return (np.flatnonzero((at >= 2) & (change > mean + FACTOR * spread) & (change >= FLOOR)) + 1).tolist()


def clips(media: bytes) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frame after the last, start and end in seconds)."""
    frames, lasts, _ = read_avi(media)
    marks = [0, *cuts(decode_frames(frames)[1]), len(frames)]
    return [(k, a, b, a * lasts / 1e6, b * lasts / 1e6) for k, (a, b) in enumerate(zip(marks, marks[1:])) if b > a]


# ---- operators


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b" " * (UNIT if not raw else -len(raw) % UNIT)


def media_from_text(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, media) with an AVI file of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                files = [write_avi(padded(x)[1]) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], ["doc_id", "media"])

    return df.select(doc_id, text).mapInArrow(run, f"doc_id {df.schema[doc_id].dataType.simpleString()}, media binary")


def media_clips(df: DataFrame, media_id: str = "doc_id", media: str = "media") -> DataFrame:
    """One row for each clip of each file."""
    names = ["media_id", "clip", "first_frame", "end_frame", "start_s", "end_s"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *c) for i, x in enumerate(batch.column(1).to_pylist()) if x is not None for c in clips(x)]
            cols = list(zip(*rows)) or [()] * 6
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, k) for c, k in zip(cols[1:], kinds))], names)

    kind = df.schema[media_id].dataType.simpleString()
    return df.select(media_id, media).mapInArrow(run, f"media_id {kind}, clip int, first_frame int, end_frame int, start_s double, end_s double")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text is stored as a file, and all else is read back from that file."""

    def digest(text: str | None) -> tuple:
        n, payload = padded(text)
        media = write_avi(payload)
        frames, _, length = read_avi(media)
        raw, luma = decode_frames(frames)
        back = payload_of(raw, length)
        marks = cuts(luma)
        feature = f"frames={len(frames)};shots={len(marks) + 1};cuts={','.join(map(str, marks))}"
        return n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(digest, batch.column(1).to_pylist()))) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], ["doc_id", *names])

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
