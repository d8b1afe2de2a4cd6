"""Media columns: AVI with motion-JPEG video, split into timed clips.

An AVI file is read by its RIFF index (idx1), or by walking the movi list where there is none.  Intra frames are decoded
in batches; a cut stands where the histogram difference of neighbouring frames exceeds an adaptive threshold, the mean
plus ``spread`` standard deviations of the file's differences and no less than ``floor``.  Each shot is a clip row.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import mjpeg
from ._io import map_columns, slices

FPS = 25
WIDTH, HEIGHT = 64, 16  # of a stored frame: 16 blocks, 1024 bytes
BINS = 16
SPREAD, FLOOR = 2.0, 0.05
BATCH_BYTES = 1 << 20
BLOCKS_AT_ONCE = 16_384  # of 64 coefficients


@dataclass(frozen=True)
class Video:
    width: int
    height: int
    frame_us: int
    frames: list[bytes]
    info: dict[str, bytes]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, fps: int = FPS, comment: bytes = b"") -> bytes:
    """An AVI file of one motion-JPEG stream with an idx1 index."""
    avih = struct.pack("<14I", 1_000_000 // fps, 0, 0, 0x10, len(frames), 0, 1, 0, width, height, 0, 0, 0, 0)
    strh = b"vids" + b"MJPG" + struct.pack("<IHHIIIIIIIIhhhh", 0, 0, 0, 0, 1, fps, 0, len(frames), 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    chunks = [_chunk(b"00dc", f) for f in frames]
    at, index = 4, []
    for f, c in zip(frames, chunks, strict=True):
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(c)
    body = _chunk(b"LIST", header) + (_chunk(b"LIST", b"INFO" + _chunk(b"ICMT", comment)) if comment else b"")
    body += _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", b"AVI " + body)


def read_avi(data: bytes) -> Video:
    """Headers, video frames in index order, and INFO entries of an AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    size, frame_us, info, index, movi, walked = (0, 0), 0, {}, b"", 0, []
    ranges = [(12, len(data), b"")]  # what is still to be walked, innermost last: lists may nest to any depth
    while ranges:
        lo, hi, inside = ranges.pop()
        while lo + 8 <= hi:
            name, n = data[lo : lo + 4], int.from_bytes(data[lo + 4 : lo + 8], "little")
            body = lo + 8
            lo = body + n + n % 2
            if name == b"LIST":
                kind = data[body : body + 4]
                if kind == b"movi":
                    movi = body
                ranges += [(lo, hi, inside), (body + 4, min(hi, body + n), inside if kind == b"rec " else kind)]
                break
            if name == b"avih":
                frame_us, size = struct.unpack_from("<I", data, body)[0], struct.unpack_from("<II", data, body + 32)
            elif name == b"idx1":
                index = data[body : body + n]
            elif inside == b"INFO":
                info[name.decode("latin-1")] = data[body : body + n]
            elif inside == b"movi" and name[2:4] in (b"dc", b"db"):
                walked.append((body, n))
    if index:
        rows = np.frombuffer(index[: len(index) // 16 * 16], np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]))
        rows = rows[[x[2:4] in (b"dc", b"db") for x in rows["name"]]]
        # offsets count from the movi list's name, or in some files from the start
        base = movi if not len(rows) or data[movi + int(rows["at"][0]) : movi + int(rows["at"][0]) + 4] == rows["name"][0] else 0
        walked = [(base + int(a) + 8, int(n)) for a, n in zip(rows["at"], rows["n"], strict=True)]
    return Video(*size, frame_us, [data[a : a + n] for a, n in walked if n], info)


# bytes as video


def pad(data: bytes) -> bytes:
    """``data`` and zeros up to a positive multiple of 64."""
    return data + b"\x00" * (64 if not data else -len(data) % 64)


def store(payload: bytes) -> bytes:
    """AVI file that holds ``payload`` (a multiple of 64 bytes) losslessly as coefficients, 64 a block; its length is in the comment."""
    return write_avi(mjpeg.encode_frames(payload, WIDTH, HEIGHT), WIDTH, HEIGHT, comment=b"payload %d" % len(payload))


@dataclass(frozen=True)
class Decoded:
    histograms: np.ndarray  # frames x BINS, counts of luma samples
    stored: bytes  # the coefficients as bytes, where the file holds a payload


_BROKEN = (ValueError, KeyError, IndexError, ZeroDivisionError, struct.error)


def _payload_bytes(video: Video) -> int | None:
    """Length of the stored payload that the comment names, if it is one of ours."""
    found = re.fullmatch(rb"payload (\d{1,18})\x00*", video.info.get("ICMT", b""))
    return int(found[1]) if found else None


def _layouts(video: Video) -> list[tuple[mjpeg.Layout, int]]:
    """Layout of each frame and where its data starts; a frame of more blocks than its bits can hold is refused."""
    out = [mjpeg.frame_layout(frame) for frame in video.frames]
    for frame, (layout, start) in zip(video.frames, out, strict=True):
        if not 0 < mjpeg.blocks_of(layout) <= 4 * (len(frame) - start):  # a block takes two bits at least
            raise ValueError("a frame is cut")
    return out


def decode(videos: list[Video]) -> tuple[list[Decoded], list[bool]]:
    """Luma histograms and stored payloads, and whether each file is whole.

    Frames of equal layout are decoded together, whatever file they are of.  A file with a broken frame has neither frames
    nor a payload; the others are not touched by it.
    """
    placed, whole = [], []
    for video in videos:
        try:
            placed.append(_layouts(video))
            whole.append(True)
        except _BROKEN:
            placed.append([])
            whole.append(False)
    groups: dict[mjpeg.Layout, list[tuple[int, int, bytes, int]]] = {}
    for v, video in enumerate(videos):
        for i, (layout, start) in enumerate(placed[v]):
            groups.setdefault(layout, []).append((v, i, video.frames[i], start))
    hist = [np.zeros((len(p), BINS), np.int64) for p in placed]
    wanted = [_payload_bytes(v) if ok else None for v, ok in zip(videos, whole, strict=True)]
    bytes_of: list[list[bytes]] = [[b""] * len(p) for p in placed]

    def run(layout: mjpeg.Layout, some: list[tuple[int, int, bytes, int]]) -> None:
        try:
            values = mjpeg.coefficients([f for _, _, f, _ in some], [s for _, _, _, s in some], layout)[0]
            luma = mjpeg.samples(values, layout.parts[0].quant, layout.width, layout.height)
        except _BROKEN:
            files = sorted({v for v, _, _, _ in some})
            if len(files) == 1:
                whole[files[0]] = False
            else:  # find the file by halves
                for part in (files[: len(files) // 2], files[len(files) // 2 :]):
                    run(layout, [r for r in some if r[0] in part])
            return
        counts = np.bincount((np.arange(len(some))[:, None] * BINS + (luma.reshape(len(some), -1) >> 4)).reshape(-1), minlength=len(some) * BINS).reshape(-1, BINS)
        raw = np.where(values < 0, values + 255, values).astype(np.uint8).reshape(len(some), -1)
        for k, (v, i, _, _) in enumerate(some):
            hist[v][i] = counts[k]
            if wanted[v] is not None:
                bytes_of[v][i] = raw[k].tobytes()

    for layout, rows in groups.items():
        step = max(1, BLOCKS_AT_ONCE // mjpeg.blocks_of(layout))
        for lo in range(0, len(rows), step):
            run(layout, rows[lo : lo + step])
    out = []
    for v in range(len(videos)):
        stored = b"".join(bytes_of[v])[: wanted[v]] if wanted[v] is not None and whole[v] else b""
        out.append(Decoded(hist[v] if whole[v] else hist[v][:0], stored))
    return out, whole


def shots(histograms: np.ndarray, spread: float = SPREAD, floor: float = FLOOR) -> list[tuple[int, int]]:
    """First and end frame of each shot."""
    n = len(histograms)
    if not n:
        return []
    share = histograms / np.maximum(histograms.sum(axis=1, keepdims=True), 1)
    change = np.round(np.abs(np.diff(share, axis=0)).sum(axis=1) / 2, 9)
    cuts = (np.flatnonzero(change > max(floor, float(change.mean() + spread * change.std()))) + 1).tolist() if n > 1 else []
    return list(zip([0, *cuts], [*cuts, n], strict=True))


def _read(data: bytes | None) -> Video:
    """A null, empty or broken file is a video without frames."""
    try:
        return read_avi(data or b"")
    except _BROKEN:
        return Video(0, 0, 0, [], {})


def _batched(rows: list[tuple[object, bytes | None]]) -> Iterator[list[tuple[object, bytes | None]]]:
    """Rows in lists of bounded bytes; a larger file stands alone."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[1] or b"") > BATCH_BYTES:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[1] or b"")
    if held:
        yield held


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, media): each whole text (null: empty), however long, stored as an AVI file of its own.

    Repeated rows give equal rows, an empty table none; other columns are not read.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([store(pad(r)) for r in raw], pa.binary())], ["id", "n_bytes", "media"]
                )

    return map_columns(docs, [id_col, text_col], kernel, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """(id_col, clip, start_frame, end_frame, start_s, end_s, width, height) of each shot of each file.

    Null, empty and broken files, and files with a broken frame, have no clips.  A comment of another writer is no payload.
    Very long files are read whole, their frames some at a time.  Repeated rows give equal rows; an empty table gives none.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _batched(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))):
                videos = [_read(m) for _, m in rows]
                decoded, _ = decode(videos)
                out = [
                    (name, k, a, b, a * v.frame_us / 1e6, b * v.frame_us / 1e6, v.width, v.height)
                    for (name, _), v, d in zip(rows, videos, decoded, strict=True)
                    for k, (a, b) in enumerate(shots(d.histograms))
                ]
                kinds = [batch.column(0).type, *[pa.int64()] * 3, pa.float64(), pa.float64(), pa.int64(), pa.int64()]
                names = ["id", "clip", "start_frame", "end_frame", "start_s", "end_s", "width", "height"]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    schema = f"id {media.schema[id_col].dataType.simpleString()}, clip long, start_frame long, end_frame long, start_s double, end_s double, width long, height long"
    return map_columns(media, [id_col, media_col], kernel, schema).withColumnRenamed("id", id_col)


def read_back(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, *keep, payload, media_bytes, media_sha256, feature) of each stored file.

    payload: the stored bytes, empty where the file holds none; feature: frames, size, ends of the clips and a hash of the
    histograms.  Null, empty and broken files, and files with a broken frame: no frames and an empty payload.  Repeated rows
    give equal rows; an empty table gives none.
    """
    kept = [media.schema[c] for c in keep]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, lo = batch.column(1).to_pylist(), 0
            for rows in _batched([(None, m) for m in files]):
                videos = [_read(m) for _, m in rows]
                decoded, _ = decode(videos)
                feature = [
                    f"{len(d.histograms)}x{v.width}x{v.height};clips={','.join(f'{a}-{b}' for a, b in shots(d.histograms))};hist={zlib.crc32(d.histograms.astype('<i8').tobytes()):08x}"
                    for v, d in zip(videos, decoded, strict=True)
                ]
                part = batch.slice(lo, len(rows))
                lo += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        *part.columns[2:],
                        pa.array([d.stored for d in decoded], pa.binary()),
                        pa.array([len(m or b"") for _, m in rows], pa.int64()),
                        pa.array([hashlib.sha256(m or b"").hexdigest() for _, m in rows], pa.string()),
                        pa.array(feature, pa.string()),
                    ],
                    ["id", *keep, "payload", "media_bytes", "media_sha256", "feature"],
                )

    schema = ", ".join(
        [f"id {media.schema[id_col].dataType.simpleString()}", *[f"{f.name} {f.dataType.simpleString()}" for f in kept], "payload binary, media_bytes long, media_sha256 string, feature string"]
    )
    return map_columns(media, [id_col, media_col, *keep], kernel, schema).withColumnRenamed("id", id_col)
