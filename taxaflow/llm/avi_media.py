"""Media columns: AVI with motion-JPEG frames.

write_avi stores grey frames losslessly: each is a JPEG in lossless mode (process SOF3, 8-bit samples, predictor 1). Its
Huffman table gives difference category s a code of 9 - s bits, so every sample takes 9 bits with its extra bits; the
table is legal (its codes leave the all-ones code free) and lets whole batches be packed and unpacked in numpy.

read_avi parses the RIFF tree and the idx1 index; decode_frames decodes intra frames: batches of frames with that table
side by side, other lossless tables bit by bit. shots() compares 64-bin histograms of neighbouring frames and cuts where
the difference exceeds the mean plus three deviations of the differences around it, in integers. clips() yields timed
clip rows.

Null text is empty text (one frame of padding). Equal texts give equal values. Each row is handled alone, in one narrow
pass: no shuffle, memory bounded by a slice of rows plus the longest text.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from taxaflow.llm.common import ragged, slices, utf8_buffers

SIDE = 24
FRAME = SIDE * SIDE
FPS = 24
#: Bits of the code of difference category s: 9 - s, so that code and extra bits are always 9 together. Categories by code length 1..9.
_SYMBOLS = bytes([8, 7, 6, 5, 4, 3, 2, 1, 0])


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def jpeg_head(side: int = SIDE) -> bytes:
    """Everything before the entropy-coded data."""
    return (
        b"\xff\xd8"
        + _segment(0xC4, b"\x00" + bytes([1] * 9 + [0] * 7) + _SYMBOLS)
        + _segment(0xC3, struct.pack(">BHHB", 8, side, side, 1) + b"\x01\x11\x00")
        + _segment(0xDA, b"\x01\x01\x00\x01\x00\x00")
    )


HEAD = jpeg_head()
_EOI = b"\xff\xd9"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(9-bit word of each difference -255..255, difference of each 9-bit word)."""
    word, diff = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        bits = 9 - s  # of the code: bits - 1 ones and a zero
        code = (1 << bits) - 2
        extra = d if d >= 0 else d + (1 << s) - 1
        word[d + 255] = code << s | extra
        diff[code << s | extra] = d
    return word, diff


_WORD, _DIFF = _tables()


def _predicted(frames: np.ndarray) -> np.ndarray:
    """Differences of predictor 1: from the left; the first column from above; the first sample from 128."""
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    return d


def encode_frames(frames: np.ndarray) -> list[bytes]:
    """JPEG streams of many frames (n x SIDE x SIDE) at once."""
    n = len(frames)
    words = _WORD[_predicted(frames).reshape(n * FRAME // 8, 8) + 255].astype(np.uint16)
    # 8 words of 9 bits are 9 bytes
    out = np.empty((len(words), 9), np.uint8)
    out[:, 0] = words[:, 0] >> 1
    for i in range(1, 8):
        out[:, i] = (words[:, i - 1] << (8 - i) | words[:, i] >> (i + 1)) & 0xFF
    out[:, 8] = words[:, 7] & 0xFF
    flat = out.reshape(-1)
    size = FRAME * 9 // 8
    # a zero byte after every 0xFF
    ff = np.flatnonzero(flat == 0xFF)
    stuffed = np.insert(flat, ff + 1, 0).tobytes() if len(ff) else flat.tobytes()
    edges = np.arange(n + 1) * size
    edges = (edges + np.searchsorted(ff, edges)).tolist()
    return [HEAD + stuffed[edges[i] : edges[i + 1]] + _EOI for i in range(n)]


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(tag: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", tag + body)


def write_avi(jpegs: list[bytes], fps: int = FPS, side: int = SIDE) -> bytes:
    most = max(map(len, jpegs))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(jpegs), 0, 1, most, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, fps, 0, len(jpegs), most, -1, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body, index, at = [], [], 4
    for j in jpegs:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        piece = b"00dc" + struct.pack("<I", len(j)) + j + b"\0" * (len(j) & 1)
        body.append(piece)
        at += len(piece)
    movi = _list(b"movi", b"".join(body))
    return _chunk(b"RIFF", b"AVI " + header + movi + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> dict:
    """{"fps", "width", "height", "frames": JPEG streams in index order}. A file without idx1 is walked through its movi list."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not a RIFF AVI file")
    info: dict = {"fps": 0.0, "width": 0, "height": 0, "frames": []}
    movi, idx = None, None

    def walk(at: int, end: int) -> None:
        nonlocal movi, idx
        while at + 8 <= end:
            tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if tag == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = (body, body + size)
                else:
                    walk(body + 4, min(end, body + size))
            elif tag == b"avih":
                us, *_, w, h = struct.unpack_from("<10I", data, body)
                info.update(fps=1e6 / us if us else 0.0, width=w, height=h)
            elif tag == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<2I", data, body + 20)
                info["fps"] = rate / scale if scale else info["fps"]
            elif tag == b"idx1":
                idx = (body, size)
            at = body + size + (size & 1)

    walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))
    if movi is None:
        raise ValueError("no movi list")
    if idx is not None:
        entries = [struct.unpack_from("<4sIII", data, idx[0] + i) for i in range(0, idx[1], 16)]
        video = [(off, size) for tag, _, off, size in entries if tag[2:] in (b"dc", b"db")]
        base = movi[0]
        if video and data[base + video[0][0] : base + video[0][0] + 4] != entries[0][0]:
            base = 0  # offsets from the file's start
        info["frames"] = [data[base + off + 8 : base + off + 8 + size] for off, size in video]
    else:
        at = movi[0] + 4
        while at + 8 <= movi[1]:
            tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if tag[2:] in (b"dc", b"db"):
                info["frames"].append(data[at + 8 : at + 8 + size])
            at += 8 + size + (size & 1)
    return info


def decode_frames(jpegs: list[bytes]) -> np.ndarray:
    """n x SIDE x SIDE samples. All frames that start with HEAD decode side by side."""
    if all(j.startswith(HEAD) for j in jpegs):
        head = len(HEAD)
        raw = np.frombuffer(b"".join([j[head:-2] for j in jpegs]), np.uint8)
        stuffing = np.flatnonzero((raw[:-1] == 0xFF) & (raw[1:] == 0)) + 1
        if len(stuffing):
            raw = np.delete(raw, stuffing)
        b = raw.reshape(-1, 9).astype(np.uint16)
        words = np.empty((len(b), 8), np.uint16)
        for i in range(8):
            words[:, i] = (b[:, i] << (i + 1) | b[:, i + 1] >> (7 - i)) & 0x1FF
        d = _DIFF[words].reshape(len(jpegs), SIDE, SIDE)
        return _undo(d)
    return np.stack([decode_lossless(j) for j in jpegs])


def _undo(d: np.ndarray) -> np.ndarray:
    d = d.astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 0xFFFF).astype(np.uint8)


def decode_lossless(jpeg: bytes) -> np.ndarray:
    """One grey lossless JPEG with any Huffman table and predictor 1, bit by bit."""
    at, codes, shape, predictor = 2, {}, (0, 0), 1
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            code, k = 0, 17
            for bits in range(1, 17):
                for _ in range(body[bits]):
                    codes[bits, code] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
        elif marker == 0xC3:
            shape = struct.unpack_from(">HH", body, 1)
        elif 0xC0 <= marker <= 0xCF:
            raise ValueError("only lossless JPEG frames are decoded")
        elif marker == 0xDA:
            predictor = body[-3]
            break
    if predictor != 1:
        raise ValueError("only predictor 1 is decoded")
    data = jpeg[at : jpeg.rindex(_EOI)].replace(b"\xff\x00", b"\xff")
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    p, d = 0, []
    for _ in range(shape[0] * shape[1]):
        n = code = 0
        while (n, code) not in codes:
            code, n, p = code << 1 | bits[p], n + 1, p + 1
        s, v = codes[n, code], 0
        for _ in range(s):
            v, p = v << 1 | bits[p], p + 1
        d.append(v if not s or v >> (s - 1) else v - (1 << s) + 1)
    return _undo(np.array(d, np.int32).reshape(1, *shape))[0]


def histogram_differences(frames: np.ndarray) -> np.ndarray:
    """Sum of absolute differences of neighbouring frames' 64-bin histograms."""
    n = len(frames)
    if n < 2:
        return np.zeros(0, np.int64)
    bins = (frames.reshape(n, -1) >> 2).astype(np.int64) + (np.arange(n) * 64)[:, None]
    h = np.bincount(bins.ravel(), minlength=64 * n).reshape(n, 64)
    return np.abs(np.diff(h, axis=0)).sum(1)


def shots(differences: np.ndarray, around: int = 8) -> list[int]:
    """Frames that start a new shot: the difference before them exceeds mean + 3 deviations of the others up to `around` away, and an eighth of the largest possible."""
    n = len(differences)
    if not n:
        return []
    s, q = (np.concatenate([[0], np.cumsum(x)]) for x in (differences, differences * differences))
    i = np.arange(n)
    a, b = np.maximum(i - around, 0), np.minimum(i + around + 1, n)
    m = b - a - 1
    total, squares = s[b] - s[a] - differences, q[b] - q[a] - differences * differences
    # d > mean + 3 sd  <=>  m d - total > 0 and (m d - total)^2 > 9 (m squares - total^2)
    over = m * differences - total
    cut = (m > 0) & (over > 0) & (over * over > 9 * (m * squares - total * total)) & (differences * 8 > 2 * FRAME)
    return (np.flatnonzero(cut) + 1).tolist()


def clips(data: bytes) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frames, start s, end s) of every shot of an AVI file."""
    info = read_avi(data)
    frames = decode_frames(info["frames"])
    edges = [0, *shots(histogram_differences(frames)), len(frames)]
    return [(i, a, b - a, a / info["fps"], b / info["fps"]) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def payload(text: bytes) -> bytes:
    """text, and bytes 255 up to a positive multiple of the frame size."""
    return text + b"\xff" * ((-len(text)) % FRAME or (0 if text else FRAME))


def media_digests(docs: DataFrame) -> DataFrame:
    """Each text stored as an AVI file and read back: sizes, digests and a feature string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            raw, off = utf8_buffers(batch.column(1))
            size = np.diff(off)
            frames = np.maximum(1, -(-size // FRAME))
            first = np.cumsum(frames) - frames
            samples = np.full(int(frames.sum()) * FRAME, 255, np.uint8)
            samples[ragged(first * FRAME, size)] = raw
            jpegs = encode_frames(samples.reshape(-1, SIDE, SIDE))
            stored = [write_avi(jpegs[a : a + n]) for a, n in zip(first.tolist(), frames.tolist(), strict=True)]
            del samples, jpegs
            # from here on, only the stored bytes are used
            read = [read_avi(x)["frames"] for x in stored]
            back = decode_frames([j for js in read for j in js])
            flat = back.tobytes()
            rows, at = [], 0
            differences = histogram_differences(back)
            for i, (data, js) in enumerate(zip(stored, read, strict=True)):
                n = len(js)
                own = flat[at * FRAME : (at + n) * FRAME]
                d = differences[at : at + n - 1]
                cuts = shots(d)
                at += n
                feature = f"frames={n};clips={len(cuts) + 1};cuts={','.join(map(str, cuts))};difference={int(d.sum())};sum={sum(own)}"
                rows.append((int(size[i]), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clip_rows(docs: DataFrame, media: str = "media") -> DataFrame:
    """Timed clip rows (doc_id, clip, first_frame, frames, start_s, end_s) of a column of AVI files. A null file yields none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *c) for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if data for c in clips(data)]
            if rows:
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, [pa.int64()] * 4 + [pa.float64()] * 2, strict=True)], names=["doc_id", "clip", "first_frame", "frames", "start_s", "end_s"])

    return docs.select("doc_id", media).mapInArrow(run, "doc_id long, clip long, first_frame long, frames long, start_s double, end_s double")
