"""Media columns: AVI files of motion JPEG that hold a text's bytes without loss.

A payload is dealt to frames of 24 x 24 samples of 8 bits. Frames are lossless JPEG (predictor 1,
a restart marker after every line), each an intra frame of an AVI with an ``idx1`` index. Reading
goes the other way: RIFF chunks, the index, each frame's markers and Huffman codes. Coding works on
all lines of a block of frames at once, since every line begins at a byte and predicts from 128; a
long payload is many blocks.

Shots: the sum of absolute differences of two frames' 16-bin histograms cuts where it exceeds the
mean of the up to ``MEMORY`` differences before by two standard deviations and by ``LEAST``.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SIDE = 24
FRAME = SIDE * SIDE
MS = 40
MEMORY, LEAST = 8, FRAME // 8
#: Payload bytes whose rows are coded together, and frames that are coded at a time within them.
AT_ONCE = 1 << 21
BLOCK = AT_ONCE // FRAME

# A frame's head (start, Huffman table of nine 4-bit codes, lossless frame, restart interval, scan).
HEAD = b"".join(
    [
        b"\xff\xd8",
        b"\xff\xc4" + struct.pack(">HB16B9B", 28, 0, *[9 if k == 4 else 0 for k in range(1, 17)], *range(9)),
        b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, SIDE, SIDE, 1, 1, 0x11, 0),
        b"\xff\xdd" + struct.pack(">HH", 4, SIDE),
        b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0),
    ]
)
END = b"\xff\xd9"


@functools.cache
def codes() -> tuple[np.ndarray, np.ndarray]:
    """Code and its length of each difference from -255 to 255: 4 bits of category, then its bits."""
    d = np.arange(-255, 256)
    category = np.ceil(np.log2(np.abs(d) + 1)).astype(np.int64)
    return (category << category | np.where(d > 0, d, d + (1 << category) - 1)).astype(np.uint64), (category + 4).astype(np.uint64)


def encode_lines(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded bytes of lines of 24 samples with their restart markers; bytes of each frame."""
    before = np.concatenate([np.full((len(lines), 1), 128, np.int16), lines[:, :-1]], axis=1)
    at = lines.astype(np.int16) - before + 255
    value, size = (x[at] for x in codes())
    for _ in range(2):  # four neighbours to one of at most 48 bits
        value, size = value[:, ::2] << size[:, 1::2] | value[:, 1::2], size[:, ::2] + size[:, 1::2]
    bits = size.sum(axis=1)
    length = (bits + np.uint64(7)) // np.uint64(8)
    pad = length * np.uint64(8) - bits
    value = np.concatenate([value, ((np.uint64(1) << pad) - np.uint64(1))[:, None]], axis=1)
    size = np.concatenate([size, pad[:, None]], axis=1)
    place = np.cumsum(size, axis=1) - size
    words = np.zeros(len(lines) * 6 + 1, np.uint64)
    row = np.arange(len(lines)) * 6
    for k in range(value.shape[1]):
        word, end = row + (place[:, k] >> np.uint64(6)).astype(np.int64), (place[:, k] & np.uint64(63)) + size[:, k]
        over = np.where(end > 64, end - np.uint64(64), np.uint64(0))
        words[word] |= np.where(end > 64, value[:, k] >> over, value[:, k] << ((np.uint64(64) - np.minimum(end, 64)) & np.uint64(63)))
        spill = over > 0
        words[word[spill] + 1] |= value[spill, k] << (np.uint64(64) - over[spill])
    made = np.empty((len(lines), 50), np.uint8)
    made[:, :48] = words[:-1].astype(">u8").view(np.uint8).reshape(-1, 48)
    line = np.arange(len(lines)) % SIDE
    made[:, 48], made[:, 49] = 0xFF, 0xD0 + line % 8
    kept = np.arange(50) < length.astype(np.int64)[:, None]
    stuffed = kept & (made == 0xFF)
    kept[:, 48:] = (line < SIDE - 1)[:, None]
    flat, twice = made[kept], stuffed[kept]
    out = np.repeat(flat, 1 + twice)
    out[(np.cumsum(1 + twice) - 1)[twice]] = 0
    per_line = kept.sum(axis=1) + stuffed.sum(axis=1)
    return out, per_line.reshape(-1, SIDE).sum(axis=1)


def avi(frames: list[bytes]) -> bytes:
    """An AVI file of motion-JPEG frames, all of them key frames, with an idx1 index."""
    chunk = lambda name, data: name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    most = max(map(len, frames))
    main = struct.pack("<14I", MS * 1000, most * 1000 // MS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    head = b"vidsMJPG" + struct.pack("<I2H8I4H", 0, 0, 0, 0, MS, 1000, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    form = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    lists = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", head) + chunk(b"strf", form)))
    sizes = np.array([len(f) for f in frames], np.int64)
    stored = 8 + sizes + (sizes & 1)
    index = np.empty((len(frames), 4), "<u4")
    index[:] = int.from_bytes(b"00dc", "little"), 0x10, 0, 0
    index[:, 2], index[:, 3] = 4 + np.cumsum(stored) - stored, sizes
    movie = b"".join(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) & 1) for f in frames)
    return chunk(b"RIFF", b"AVI " + lists + chunk(b"LIST", b"movi" + movie) + chunk(b"idx1", index.tobytes()))


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI for each payload; payloads are positive multiples of 576 bytes."""
    lines = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, SIDE)
    coded, sizes = zip(*(encode_lines(lines[a : a + BLOCK * SIDE]) for a in range(0, len(lines), BLOCK * SIDE)))
    edge = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).tolist()
    data, out, at = b"".join(coded), [], 0
    for p in payloads:
        n = len(p) // FRAME
        out.append(avi([HEAD + data[a:b] + END for a, b in zip(edge[at : at + n], edge[at + 1 : at + n + 1])]))
        at += n
    return out


def chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start, end) of the RIFF chunks from ``at``; those of lists follow their list."""
    while at + 8 <= end:
        name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        yield name, at + 8, at + 8 + size
        if name == b"LIST" and data[at + 8 : at + 12] != b"movi":
            yield from chunks(data, at + 12, at + 8 + size)
        at += 8 + size + (size & 1)


def frames_of(data: bytes) -> tuple[list[bytes], int]:
    """The frames that the index of an AVI lists, and milliseconds a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    movie = index = ms = None
    for name, s, e in chunks(data, 12, len(data)):
        if name == b"avih":
            ms = int.from_bytes(data[s : s + 4], "little") // 1000
        elif name == b"LIST" and data[s : s + 4] == b"movi":
            movie = s
        elif name == b"idx1":
            index = np.frombuffer(data, "<u4", (e - s) // 4, s).reshape(-1, 4)
    return [data[movie + a + 8 : movie + a + 8 + n] for a, n in index[:, 2:].tolist()], ms


@functools.lru_cache(maxsize=8)
def head_of(head: bytes) -> tuple[int, int, int, np.ndarray, np.ndarray]:
    """Height, width, restart interval; category and length by the longest code's bits."""
    at, shape, restart, table = 2, None, 0, None
    while at < len(head):
        marker, size = head[at + 1], int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if marker == 0xC3:
            shape = struct.unpack(">HH", body[1:5])
            if body[0] != 8 or body[5] != 1:
                raise ValueError("one component of 8 bits is read")
        elif marker == 0xC4:
            table = body
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA and body[3] != 1:
            raise ValueError("predictor 1 is read")
        at += 2 + size
    counts, values = table[1:17], table[17:]
    longest = max(k for k in range(1, 17) if counts[k - 1])
    category, length = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.uint32)
    code = k = 0
    for size in range(1, longest + 1):
        for _ in range(counts[size - 1]):
            s = code << (longest - size)
            category[s : s + (1 << (longest - size))], length[s : s + (1 << (longest - size))] = values[k], size
            code, k = code + 1, k + 1
        code <<= 1
    return *shape, restart, category, length


def decode(files: list[bytes]) -> list[np.ndarray]:
    """The frames' samples of each AVI, one array (frames, 576) a file."""
    found = [frames_of(f)[0] for f in files]
    every = [f for x in found for f in x]
    heads = {f[: f.index(b"\xff\xda") + 10] for f in every}
    if len(heads) != 1:  # files of other makers: one by one
        return [decode([f])[0] for f in files] if len(files) > 1 else _mixed(found[0])
    head = heads.pop()
    samples = np.concatenate([decode_scans([f[len(head) : -2] for f in every[a : a + BLOCK]], *head_of(head)) for a in range(0, len(every), BLOCK)])
    edge = np.cumsum([len(x) for x in found])[:-1]
    return np.split(samples, edge)


def _mixed(frames: list[bytes]) -> np.ndarray:
    heads = [f[: f.index(b"\xff\xda") + 10] for f in frames]
    return np.concatenate([decode_scans([f[len(h) : -2]], *head_of(h)) for f, h in zip(frames, heads)])


def decode_scans(scans: list[bytes], height: int, width: int, restart: int, category: np.ndarray, length: np.ndarray) -> np.ndarray:
    if restart != width:
        raise ValueError("a restart after each line is read")
    data = np.frombuffer(b"".join(scans), np.uint8)
    after = np.concatenate([data[1:], np.zeros(1, np.uint8)])
    marked = (data == 0xFF) & (after >= 0xD0) & (after <= 0xD7)
    drop = marked.copy()
    drop[1:] |= marked[:-1] | (data[:-1] == 0xFF) & (data[1:] == 0)
    kept = np.concatenate([[0], np.cumsum(~drop)])
    sizes = np.array([len(s) for s in scans])
    begin = np.sort(np.concatenate([np.cumsum(sizes) - sizes, np.flatnonzero(marked) + 2]))
    if len(begin) != len(scans) * height:
        raise ValueError("lines are missing")
    bit = kept[begin] * 8
    clean = np.concatenate([data[~drop], np.zeros(8, np.uint8)]).astype(np.uint32)
    word = clean[:-3] << 24 | clean[1:-2] << 16 | clean[2:-1] << 8 | clean[3:]
    out = np.empty((len(begin), width), np.uint8)
    left = np.full(len(begin), 128, np.int64)
    shift = np.uint32(32 - int(len(category)).bit_length() + 1)
    for k in range(width):
        w = word[bit >> 3] << (bit & 7).astype(np.uint32)
        c = w >> shift
        n, took = category[c], length[c]
        extra = ((w << took).astype(np.uint64) >> (np.uint64(32) - n.astype(np.uint64))).astype(np.int64)
        full = np.int64(1) << n.astype(np.int64)
        left = left + np.where(extra * 2 < full, extra - full + 1, extra)
        left &= 0xFFFF
        out[:, k] = left
        bit = bit + took + n
    return out.reshape(len(scans), height * width)


def histograms(frames: np.ndarray) -> np.ndarray:
    """How many samples of each frame fall in each of 16 bins."""
    key = np.arange(len(frames))[:, None] * 16 + (frames >> 4)
    return np.bincount(key.ravel(), minlength=len(frames) * 16).reshape(-1, 16)


def cuts(samples: list[np.ndarray]) -> list[list[int]]:
    """First frames of each file's shots."""
    frames = np.concatenate(samples)
    n = np.array([len(s) for s in samples])
    first = np.cumsum(n) - n
    histogram = np.concatenate([histograms(frames[a : a + BLOCK]) for a in range(0, len(frames), BLOCK)])
    jump = np.concatenate([[0], np.abs(np.diff(histogram, axis=0)).sum(axis=1)])
    jump[first] = 0
    start = np.repeat(first, n)
    at = np.arange(len(frames))
    low = np.maximum(start + 1, at - MEMORY)
    count = np.maximum(at - low, 0)
    total, square = (np.concatenate([[0], np.cumsum(x)]) for x in (jump, jump * jump))
    s, q, c = total[at] - total[np.minimum(low, at)], square[at] - square[np.minimum(low, at)], np.maximum(count, 1)
    cut = (count > 0) & (jump > s / c + 2 * np.sqrt(np.maximum(c * q - s * s, 0)) / c) & (jump > LEAST)
    cut[first] = True
    where = np.flatnonzero(cut)
    which = np.searchsorted(first, where, "right") - 1
    return [x.tolist() for x in np.split(where - first[which], np.cumsum(np.bincount(which, minlength=len(n)))[:-1])]


def parts(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of about AT_ONCE bytes of a column."""
    size = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    group = np.cumsum(np.maximum(size, FRAME)) // AT_ONCE
    for at in np.split(np.arange(len(size)), np.flatnonzero(np.diff(group)) + 1):
        if len(at):
            yield batch.slice(at[0], len(at))


def with_media(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of each row with n_bytes and media, the text's AVI file.

    The payload is the text's UTF-8 and bytes 255 up to a positive multiple of 576; no text holds
    that byte, so the text can be read back. Null text is empty.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, batch.num_columns - 1):
                texts = part.column(part.num_columns - 1).to_pylist()
                made = encode([t + b"\xff" * (-len(t) % FRAME if t else FRAME) for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(map(len, texts), pa.int64()), pa.array(made, pa.binary())], names=[*keep, "n_bytes", "media"])

    rows = docs.select(*(F.col(c) for c in keep), text_of().cast("binary").alias("__bytes"))
    return rows.mapInArrow(store, rows.drop("__bytes").schema.add("n_bytes", "long").add("media", "binary"))


def clips(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a shot of ``media(key, media)``: its number, frames and time.

    A null key is kept; repeated rows give their shots each; no rows give no rows. Every file has a frame,
    as ``with_media`` writes it, so a shot at least.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 1):
                samples = decode(part.column(1).to_pylist())
                rows = [(k, c, a, b, a * MS, b * MS) for k, x, found in zip(part.column(0).to_pylist(), samples, cuts(samples)) for c, (a, b) in enumerate(zip(found, [*found[1:], len(x)]))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[key, "clip", "first_frame", "end_frame", "start_ms", "end_ms"])

    rows = media.select(F.col(key).cast("long").alias(key), "media")
    return rows.mapInArrow(split, f"{key} long, clip int, first_frame long, end_frame long, start_ms long, end_ms long")


def describe(media: DataFrame) -> DataFrame:
    """Digests of what is stored and of what is read back, with shots as frames=N shots=a-b,c-d.

    A row for each row of ``media``, repeated ones too; null doc_ids are kept; no rows give no rows.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch, 2):
                files = part.column(2).to_pylist()
                samples = decode(files)
                payloads = [s.tobytes() for s in samples]
                shots = [",".join(f"{a}-{b}" for a, b in zip(c, [*c[1:], len(s)])) for c, s in zip(cuts(samples), samples)]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column(0),
                        "n_bytes": part.column(1),
                        "payload_bytes": pa.array(map(len, payloads), pa.int64()),
                        "payload_sha256": [hashlib.sha256(p).hexdigest() for p in payloads],
                        "tail_crc32": pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()),
                        "media_bytes": pa.array(map(len, files), pa.int64()),
                        "media_sha256": [hashlib.sha256(f).hexdigest() for f in files],
                        "feature": [f"frames={len(s)} shots={x}" for s, x in zip(samples, shots)],
                    }
                )

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select(F.col("doc_id").cast("long"), "n_bytes", "media").mapInArrow(read, schema)
