"""AVI motion-JPEG columns: write payloads as video, parse the RIFF index, decode frames and detect shots.

A frame is a baseline grey-scale JPEG of SIDE x SIDE pixels. A block's 63 AC coefficients hold 63 payload bytes: a value
of size category 8 has eight extra bits, which are the byte as it is, and its Huffman code is given eight bits too. So a
payload byte is one quantised coefficient (the format's unit) and entropy-coded data stay aligned to bytes. Every quantiser
step is 1, so reading back is lossless.

Frames are read by a decoder for baseline JPEG: quantiser and Huffman tables, sampling factors, restart markers and
stuffed bytes are taken from the file, or the standard tables where a motion-JPEG frame leaves them out. Frames whose
header is that of the own profile need no bit-by-bit walk, as all their codes are whole bytes: these are decoded by array
operations, with the same result.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pixels on a frame's edge, frames a second, grey levels of the histograms.
SIDE, RATE, BINS = 32, 25, 16
#: A cut: the histogram difference is above MEAN times the mean of the shot so far, and above LEAST of the pixels.
MEAN, LEAST = 1.5, 0.15
BLOCKS = (SIDE // 8) ** 2
FRAME_BYTES = 63 * BLOCKS
PAD = 64

_DC_CODE, _AC_CODE = 0x00, 0x00
_AVI_HAS_INDEX = 0x10


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, symbols: bytes) -> bytes:
    """A table whose symbols all have codes of eight bits, in order from 0."""
    return _segment(0xC4, bytes([kind]) + bytes([0] * 7 + [len(symbols)] + [0] * 8) + symbols)


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, bytes([0]) + bytes([1] * 64))
    + _segment(0xC0, struct.pack(">BHHB3B", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _huffman(0x00, bytes([0]))
    + _huffman(0x10, bytes([0x08, 0x00]))
    + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
)
_TAIL = b"\xff\xd9"


def _zigzag() -> list[tuple[int, int]]:
    """(row, column) of the coefficients in the order of the file: diagonals, up and down in turn."""
    return sorted(((v, u) for v in range(8) for u in range(8)), key=lambda x: (sum(x), x[0] if sum(x) % 2 else x[1]))


def _basis() -> np.ndarray:
    """The 63 AC waves as pixels, times 512 and rounded: sums of products stay whole in 32-bit floats, in any order."""
    n = np.arange(8)
    wave = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) * np.where(n == 0, np.sqrt(0.125), 0.5)
    full = np.stack([np.outer(wave[:, v], wave[:, u]).ravel() for v, u in _zigzag()[1:]])
    return np.round(full * 512).astype(np.float32)


_BASIS = _basis()


def _waves() -> np.ndarray:
    """All 64 waves as pixels, in the order of the file."""
    n = np.arange(8)
    wave = np.cos((2 * n[:, None] + 1) * n[None, :] * np.pi / 16) * np.where(n == 0, np.sqrt(0.125), 0.5)
    return np.stack([np.outer(wave[:, v], wave[:, u]).ravel() for v, u in _zigzag()])


_WAVES = _waves()


def encode_frames(payload: bytes) -> list[bytes]:
    """The payload as JPEG images; the last one is filled up with zero bytes."""
    raw = np.frombuffer(payload, np.uint8)
    n = max(1, -(-len(raw) // FRAME_BYTES))
    held = np.zeros((n, BLOCKS, 63), np.uint8)
    held.reshape(-1)[: len(raw)] = raw
    coded = np.zeros((n, BLOCKS, 127), np.uint8)
    coded[:, :, 0] = _DC_CODE
    coded[:, :, 1::2] = _AC_CODE
    coded[:, :, 2::2] = held
    return [_HEAD + frame.tobytes().replace(b"\xff", b"\xff\x00") + _TAIL for frame in coded]


def decode_frame(jpeg: bytes) -> np.ndarray:
    """The payload bytes (blocks x 63) of an image of the own profile; ValueError for any other."""
    if not (jpeg.startswith(_HEAD) and jpeg.endswith(_TAIL)):
        raise ValueError("not an image of this profile")
    coded = np.frombuffer(jpeg[len(_HEAD) : -len(_TAIL)].replace(b"\xff\x00", b"\xff"), np.uint8)
    if len(coded) != BLOCKS * 127:
        raise ValueError("scan data of another length")
    coded = coded.reshape(BLOCKS, 127)
    if coded[:, 0].any() or coded[:, 1::2].any():
        raise ValueError("a code outside the tables")
    return coded[:, 2::2]


class Scan:
    """Bits of entropy-coded data without their stuffed bytes, a segment between restart markers at a time.

    Bytes go into a small buffer as they are asked for, so that a scan costs its length.
    """

    def __init__(self, data: bytes):
        self.data, self.next, self.held, self.left = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.left < n:
            if self.next == len(self.data):
                raise ValueError("scan data end early")
            self.held = self.held << 8 | self.data[self.next]
            self.next, self.left = self.next + 1, self.left + 8
        self.left -= n
        x = self.held >> self.left
        self.held &= (1 << self.left) - 1
        return x

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("a code outside the tables")

    def value(self, size: int) -> int:
        """A number of a size category: those below half of its range are negative."""
        x = self.take(size) if size else 0
        return x - (1 << size) + 1 if size and x < 1 << (size - 1) else x


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol: codes count up, and double when they grow longer."""
    out, code, k = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


# Fixed values of the JPEG standard, annex K.3: code counts by length and symbols of the usual tables, which motion-JPEG
# frames may leave out.
_STANDARD = {
    0x00: ("00010501010101010100000000000000", "000102030405060708090a0b"),
    0x01: ("00030101010101010101010000000000", "000102030405060708090a0b"),
    0x10: (
        "0002010303020403050504040000017d",
        "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a"
        "434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aa"
        "b2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
    ),
    0x11: (
        "00020102040403040705040400010277",
        "0001020311040521310612415107617113223281081442"
        "91a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a63646566676869"
        "6a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5"
        "d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    ),
}


def read_jpeg(jpeg: bytes) -> dict[int, np.ndarray]:
    """component -> quantised coefficients, block rows x block columns x 64 in the order of the file, of a baseline image,
    under the key 0 the grey image's pixels; ValueError for an image that is no whole baseline JPEG."""
    try:
        return _read_jpeg(jpeg)
    except (IndexError, struct.error, KeyError) as e:
        raise ValueError(f"not a whole baseline JPEG: {e}") from e


def _read_jpeg(jpeg: bytes) -> dict[int, np.ndarray]:
    if jpeg[:2] != b"\xff\xd8":
        raise ValueError("no start of image")
    steps: dict[int, np.ndarray] = {}
    codes = {k: _codes(bytes.fromhex(n), bytes.fromhex(s)) for k, (n, s) in _STANDARD.items()}
    parts: dict[int, tuple[int, int, int]] = {}
    high = wide = interval = 0
    at = 2
    while True:
        if jpeg[at] != 0xFF:
            raise ValueError("no marker where one is due")
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                steps[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xC0:
            bits, high, wide, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not high or not wide:
                raise ValueError("not eight bits, or no size")
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("not baseline")
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            break
    used = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
    end = jpeg.rfind(_TAIL)
    if {c for c, _, _ in used} != set(parts) or end < at:
        raise ValueError("more than one scan, or no end of image")
    held = re.split(rb"\xff[\xd0-\xd7]", jpeg[at:end])
    most_h, most_v = max(h for h, _, _ in parts.values()), max(v for _, v, _ in parts.values())
    if len(parts) == 1:  # one component is not interleaved: its units are single blocks
        parts, most_h, most_v = {c: (1, 1, q) for c, (_, _, q) in parts.items()}, 1, 1
    rows, columns = -(-high // (8 * most_v)), -(-wide // (8 * most_h))
    out = {c: np.zeros((rows * v, columns * h, 64), np.int64) for c, (h, v, _) in parts.items()}
    scan, before = None, {}
    for unit in range(rows * columns):
        if scan is None or interval and unit % interval == 0:
            k = unit // interval if interval else 0
            scan, before = Scan(held[k].replace(b"\xff\x00", b"\xff")), dict.fromkeys(parts, 0)
        for c, dc, ac in used:
            h, v, _ = parts[c]
            for y in range(v):
                for x in range(h):
                    block = out[c][unit // columns * v + y, unit % columns * h + x]
                    before[c] += scan.value(scan.symbol(codes[dc]))
                    block[0], i = before[c], 1
                    while i < 64:
                        run, n = divmod(scan.symbol(codes[0x10 | ac]), 16)
                        if n == 0 and run < 15:
                            break
                        i += run
                        if n:
                            block[i] = scan.value(n)
                        i += 1
    first = next(iter(parts))
    values = out[first] * steps[parts[first][2]]
    flat = (values.reshape(-1, 64).astype(np.float64) @ _WAVES + 128).round().clip(0, 255).astype(np.uint8)
    grey = flat.reshape(*values.shape[:2], 8, 8).swapaxes(1, 2).reshape(8 * values.shape[0], 8 * values.shape[1])
    return out | {0: grey[: -(-high * parts[first][1] // most_v), : -(-wide * parts[first][0] // most_h)]}


def pixels(held: np.ndarray) -> np.ndarray:
    """Grey levels by the inverse cosine transform of (..., 63) payload bytes; (..., 64) values from 0 to 255."""
    values = held.astype(np.int32)
    values = np.where(values < 128, values - 255, values).astype(np.float32)
    level = np.floor(values.reshape(-1, 63) @ _BASIS / 512 + 128.5)
    return np.clip(level, 0, 255).astype(np.uint8).reshape(*held.shape[:-1], 64)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def _list(name: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", name + b"".join(chunks))


def write_avi(payload: bytes) -> bytes:
    """A RIFF AVI file with one MJPG stream and an idx1 index; strd holds the payload's length."""
    frames = encode_frames(payload)
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, _AVI_HAS_INDEX, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    image = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    head = _list(b"hdrl", _chunk(b"avih", main), _list(b"strl", _chunk(b"strh", stream), _chunk(b"strf", image), _chunk(b"strd", struct.pack("<Q", len(payload)))))
    chunks, index, at = [], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        index.append(b"00dc" + struct.pack("<III", _AVI_HAS_INDEX, at, len(frame)))
        chunks.append(chunk)
        at += len(chunk)
    return _chunk(b"RIFF", b"AVI " + head + _list(b"movi", *chunks) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Video:
    rate: float
    payload_bytes: int
    frames: list[bytes]


def read_avi(data: bytes) -> Video:
    """Walks the chunks and takes the frames by the index; ValueError where the file is not whole."""

    def walk(start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while start + 8 <= end:
            name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
            if start + 8 + size > end:
                raise ValueError("a chunk ends behind its list")
            if name in (b"RIFF", b"LIST"):
                yield data[start + 8 : start + 12], start + 8, size
                if data[start + 8 : start + 12] != b"movi":
                    yield from walk(start + 12, start + 8 + size)
            else:
                yield name, start + 8, size
            start += 8 + size + size % 2

    found = {name: (at, size) for name, at, size in walk(0, len(data))}
    if not {b"AVI ", b"strh", b"movi", b"idx1"} <= found.keys():
        raise ValueError("not an AVI file with an index")
    at, _ = found[b"strh"]
    scale, rate = struct.unpack_from("<II", data, at + 20)
    movi, (index, size) = found[b"movi"][0], found[b"idx1"]
    frames = []
    for i in range(index, index + size - 15, 16):
        name, _, offset, length = struct.unpack_from("<4sIII", data, i)
        if name[2:] not in (b"dc", b"db"):
            continue  # sound
        start = movi + offset
        if i == index and data[start : start + 4] != name:  # some writers count from the file's start
            movi, start = 0, offset
        if data[start : start + 4] != name or struct.unpack_from("<I", data, start + 4)[0] != length:
            raise ValueError("the index doesn't meet its chunks")
        frames.append(data[start + 8 : start + 8 + length])
    stored = struct.unpack_from("<Q", data, found[b"strd"][0])[0] if b"strd" in found else 0
    return Video(rate / scale if scale else float(RATE), stored, frames)


def histograms(held: np.ndarray) -> np.ndarray:
    """frames x BINS counts of grey levels, from frames x blocks x 63 payload bytes."""
    level = (pixels(held).reshape(len(held), -1) // (256 // BINS)).astype(np.int64)
    return np.bincount((level + BINS * np.arange(len(held))[:, None]).ravel(), minlength=BINS * len(held)).reshape(-1, BINS)


def frame_histograms(frames: list[bytes]) -> np.ndarray:
    """frames x BINS counts of grey levels of any baseline frames."""
    if all(f.startswith(_HEAD) for f in frames):
        return histograms(np.stack([decode_frame(f) for f in frames]))
    levels = [read_jpeg(f)[0].ravel() // (256 // BINS) for f in frames]
    return np.stack([np.bincount(x, minlength=BINS) for x in levels])


def shots(counts: np.ndarray) -> list[tuple[int, int]]:
    """[first frame, end frame) of each shot: a cut where the histograms differ by more than the shot's own usual."""
    if not len(counts):
        return []
    size = max(1, int(counts[0].sum()))
    step = np.abs(np.diff(counts, axis=0)).sum(axis=1) / 2
    cuts, first, total = [0], 0, 0
    for i, d in enumerate(step.tolist(), 1):
        held = i - 1 - first  # steps inside the shot so far
        if held and d > max(LEAST * size, MEAN * total / held):
            cuts.append(i)
            first, total = i, 0
        else:
            total += d
    return list(zip(cuts, [*cuts[1:], len(counts)], strict=True))


def padded(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + b"\x00" * (-len(raw) % PAD if raw else PAD), len(raw)


def examine(media: bytes) -> tuple[bytes, np.ndarray, list[tuple[int, int]]]:
    """The payload read back, the histograms and the shots of a stored file."""
    video = read_avi(media)
    held = np.stack([decode_frame(f) for f in video.frames])
    counts = histograms(held)
    return held.tobytes()[: video.payload_bytes], counts, shots(counts)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            payload, n = padded(text.as_py())
            media = write_avi(payload)
            back, counts, found = examine(media)
            feature = f"frames={len(counts)};shots={len(found)};cuts={'.'.join(str(a) for a, _ in found[1:])};grey={'.'.join(map(str, counts.sum(axis=0)))}"
            rows.append((doc, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        cols = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))


def _stored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, text in enumerate(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([write_avi(padded(text.as_py())[0])])], names=["doc_id", "media"])


def _clips(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("doc_id", "clip", "start_s", "end_s", "frames", "grey", "error")
    kinds = (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.int64()), pa.string())
    for batch in batches:
        rows = []
        for doc, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            try:
                video = read_avi(media.as_py() or b"")
                counts = frame_histograms(video.frames) if video.frames else np.empty((0, BINS), np.int64)
            except (ValueError, struct.error) as e:
                rows.append((doc, None, None, None, None, None, str(e)))
                continue
            rows += [(doc, k, a / video.rate, b / video.rate, b - a, counts[a:b].sum(axis=0).tolist(), None) for k, (a, b) in enumerate(shots(counts))]
        cols = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=list(names))


def _own(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def store(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text as an AVI file. Null text is empty; equal texts give equal files."""
    return _own(docs).mapInArrow(_stored, "doc_id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """A row for each shot of media(doc_id, media): clip number, start and end in seconds, frames, grey histogram.

    Any AVI file with an index and baseline JPEG frames is read; sound is passed over. A file that can't be read, or
    null, gives one row with error set and the rest null; one without frames gives no row. Other columns, whatever their
    names, are ignored; repeated rows repeat, an empty table gives an empty result.
    """
    columns = "doc_id long, clip int, start_s double, end_s double, frames int, grey array<long>, error string"
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(_clips, columns)


def round_trip(docs: DataFrame) -> DataFrame:
    """Stores each text of docs(doc_id, text) as a file, reads it back and gives digests of both and its features.

    feature: frames, shots, the frames at which cuts are, and the grey histogram of all. Null and empty texts are 64 zero
    bytes. Rows are independent: repeated rows repeat, null doc_ids stay null, an empty table gives an empty result. A
    very long text is one file in memory, twice its size. Other columns, whatever their names, are ignored.
    """
    columns = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return _own(docs).mapInArrow(_digests, columns)
