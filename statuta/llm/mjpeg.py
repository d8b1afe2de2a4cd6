"""Baseline motion-JPEG frames in numpy: a lossless writer of bytes as coefficients, and a batch decoder.

The writer stores 64 bytes as the 64 quantised coefficients of an 8x8 block, in scan order.  A byte b becomes b or
b - 255, whichever has size category 8, so each coefficient is one code bit and the byte itself; every block is a restart
interval, so blocks decode independently.  The frames follow the baseline format; tests read them with this decoder alone,
as no other one is at hand.

The decoder takes frames of one component or of several interleaved ones, with any Huffman tables, and steps through all
restart intervals of a batch of frames at once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# The scan order of an 8x8 block.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
_SCALE = 1 << 16


@lru_cache(1)
def _inverse_dct() -> np.ndarray:
    """Row k: the 64 samples of the k-th coefficient in scan order, as whole numbers, so sums are exact in any order."""
    u = np.arange(8)
    c = np.where(u == 0, np.sqrt(0.5), 1.0)[:, None] * np.cos((2 * np.arange(8)[None] + 1) * u[:, None] * np.pi / 16) / 2
    full = np.einsum("vy,ux->vuyx", c, c).reshape(64, 64)
    return np.round(full[ZIGZAG] * _SCALE)


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


@lru_cache(64)
def frame_header(width: int, height: int) -> bytes:
    table = lambda kind: bytes([kind, 1, *[0] * 15, 8])  # noqa: E731  one code of one bit, for size 8 (run 0)
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0, *[1] * 64]))
        + _segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0]))
        + _segment(0xC4, table(0x00) + table(0x10))
        + _segment(0xDD, (1).to_bytes(2, "big"))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def encode_frames(payload: bytes, width: int, height: int) -> list[bytes]:
    """Frames of width x height (multiples of 8) that hold ``payload``, whose length is a multiple of 64; the last is filled with 0."""
    per = width * height // 64
    data = np.frombuffer(payload, np.uint8).reshape(-1, 64)
    data = np.concatenate((data, np.zeros((-len(data) % per, 64), np.uint8)))
    eights = data.reshape(-1, 8).astype(np.uint16)
    packed = np.empty((len(eights), 9), np.uint16)
    packed[:, 0] = eights[:, 0] >> 1
    for k in range(1, 8):
        packed[:, k] = ((eights[:, k - 1] & ((1 << k) - 1)) << (8 - k)) | (eights[:, k] >> (k + 1))
    packed[:, 8] = eights[:, 7]
    flat = packed.astype(np.uint8).reshape(-1)
    blocks = len(data)
    # a 0 after each FF; two bytes for the restart marker after each block but a frame's last
    full = flat == 255
    block = np.arange(len(flat)) // 72
    marks = block - block // per
    at = np.arange(len(flat)) + np.cumsum(full) - full + 2 * marks
    out = np.zeros(int(at[-1]) + 1 + int(full[-1]), np.uint8)
    out[at] = flat
    last = at[71::72] + full[71::72]
    inner = np.arange(blocks) % per != per - 1
    out[last[inner] + 1] = 0xFF
    out[last[inner] + 2] = 0xD0 + (np.arange(blocks) % per)[inner] % 8
    head, ends = frame_header(width, height), last[per - 1 :: per] + 1
    starts = np.concatenate(([0], ends[:-1]))
    whole = out.tobytes()
    return [head + whole[a:b] + b"\xff\xd9" for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


@dataclass(frozen=True)
class Component:
    h: int
    v: int
    quant: bytes
    dc: bytes
    ac: bytes


@dataclass(frozen=True)
class Layout:
    """What frames must share to be decoded together."""

    width: int
    height: int
    restart: int
    parts: tuple[Component, ...]


def blocks_of(layout: Layout) -> int:
    """Blocks of a frame, padding among them."""
    hmax, vmax = max(p.h for p in layout.parts), max(p.v for p in layout.parts)
    return -(-layout.width // (8 * hmax)) * -(-layout.height // (8 * vmax)) * sum(p.h * p.v for p in layout.parts)


@lru_cache(256)
def _lookup(table: bytes) -> np.ndarray:
    """For each 16 bits: length of the code << 8 | symbol (length 0: no code), from the counts and symbols of a DHT table."""
    out = np.zeros(1 << 16, np.int16)
    code, at = 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            lo = code << (16 - length)
            out[lo : lo + (1 << (16 - length))] = length << 8 | table[at]
            code += 1
            at += 1
        code <<= 1
    return out


def parse_frame(frame: bytes) -> tuple[Layout, int]:
    """Layout of a baseline frame and where its entropy-coded data starts."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    at, quant, tables, restart, size, parts = 2, {}, {}, 0, None, {}
    while True:
        while frame[at] == 0xFF and frame[at + 1] == 0xFF:
            at += 1
        marker, length = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = body[1 : 65 + 64 * wide] if wide else b"".join(bytes([0, x]) for x in body[1:65])
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            size = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big")
            parts = {body[6 + 3 * i]: (body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                tables[body[0]] = body[1:n]
                body = body[n:]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            chosen = []
            for i in range(body[0]):
                name, t = body[1 + 2 * i], body[2 + 2 * i]
                h, v, q = parts[name]
                chosen.append(Component(h, v, quant[q], tables[t >> 4], tables[0x10 | t & 15]))
            if len(chosen) != len(parts):
                raise ValueError("only frames of one interleaved scan are read")
            if len(chosen) == 1:  # a scan of one component has one block in each unit
                chosen = [Component(1, 1, chosen[0].quant, chosen[0].dc, chosen[0].ac)]
            return Layout(*size, restart, tuple(chosen)), at
        elif marker in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("only baseline frames are read")


_known_headers: dict[bytes, tuple[Layout, int]] = {}


def frame_layout(frame: bytes) -> tuple[Layout, int]:
    """:func:`parse_frame`, parsing equal headers once; a header ends with its scan's segment."""
    end = frame.find(b"\xff\xda")
    head = frame[: end + 2 + int.from_bytes(frame[end + 2 : end + 4], "big")] if end >= 0 else b""
    found = _known_headers.get(head)
    if found is None:
        found = parse_frame(frame)
        if len(_known_headers) >= 256:
            _known_headers.clear()
        if found[1] == len(head):
            _known_headers[head] = found
    return found


def coefficients(frames: list[bytes], starts: list[int], layout: Layout) -> list[np.ndarray]:
    """For each component: quantised coefficients (frames, rows of blocks, columns of blocks, 64) in scan order."""
    hmax, vmax = max(p.h for p in layout.parts), max(p.v for p in layout.parts)
    across, down = -(-layout.width // (8 * hmax)), -(-layout.height // (8 * vmax))
    units = across * down
    step = layout.restart or units
    per_frame = -(-units // step)
    raw = np.frombuffer(b"".join(f[s:] + b"\xff\xd9" for f, s in zip(frames, starts, strict=True)), np.uint8)
    ends = np.cumsum([len(f) - s + 2 for f, s in zip(frames, starts, strict=True)])
    after = np.append(raw[1:], 0)
    marker = (raw == 0xFF) & (after != 0) & (after != 0xFF)
    restart = marker & (after >= 0xD0) & (after <= 0xD7)
    # of a frame only what stands before its first marker that is no restart counts
    begin = np.concatenate(([0], ends[:-1]))
    stops = np.flatnonzero(marker & ~restart)
    stop = stops[np.searchsorted(stops, begin)]
    live = np.zeros(len(raw) + 1, np.int64)
    np.add.at(live, begin, 1)
    np.add.at(live, stop, -1)
    live = np.cumsum(live[:-1]) > 0
    drop = ~live | np.concatenate(([False], (raw[:-1] == 0xFF) & (raw[1:] == 0))) | restart | np.concatenate(([False], restart[:-1]))
    keep = np.flatnonzero(~drop)
    data = raw[keep]
    cuts = np.sort(np.concatenate((begin, np.flatnonzero(restart & live) + 2)))
    if len(cuts) != per_frame * len(frames):
        raise ValueError("a frame has more or fewer restart intervals than units ask for")
    pos = np.searchsorted(keep, cuts).astype(np.int64) * 8
    d = np.concatenate((data, np.full(8, 0xFF, np.uint8))).astype(np.int64)
    window = (d[:-5] << 32) | (d[1:-4] << 24) | (d[2:-3] << 16) | (d[3:-2] << 8) | d[4:-1]
    n = len(cuts)
    todo = np.full(n, step)
    todo[per_frame - 1 :: per_frame] = units - step * (per_frame - 1)
    # laid out by coefficient, then restart interval: one step writes one row
    out = [np.zeros((step, p.v * p.h, 64, n), np.int16) for p in layout.parts]
    last = [np.zeros(n, np.int64) for _ in layout.parts]
    top = len(window) - 1

    def take(at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray | int, np.ndarray, np.ndarray]:
        """Symbol at each position (one for all where they agree), its extra bits as a value, and the next positions."""
        bits = window[np.minimum(at >> 3, top)] >> (8 - (at & 7))
        hit = table[(bits >> 16) & 0xFFFF]
        if len(hit) and (hit == hit[0]).all():
            hit = int(hit[0])
            size = hit & 15
            extra = (bits >> (32 - (hit >> 8) - size)) & ((1 << size) - 1)
            return hit & 255, extra - ((1 << size) - 1) * (extra < (1 << size >> 1)), at + ((hit >> 8) + size)
        length, size = (hit >> 8).astype(np.int64), (hit & 15).astype(np.int64)
        extra = (bits >> (32 - length - size)) & ((1 << size) - 1)
        return hit & 255, extra - ((1 << size) - 1) * (extra < (1 << size >> 1)), at + length + size

    for unit in range(step):
        all_on = bool((todo > unit).all())
        rows = np.arange(n) if all_on else np.flatnonzero(todo > unit)
        for c, p in enumerate(layout.parts):
            dc, ac = _lookup(p.dc), _lookup(p.ac)
            for b in range(p.v * p.h):
                target = out[c][unit, b]
                at = pos[rows]
                _, diff, at = take(at, dc)
                last[c][rows] += diff
                target[0, rows] = last[c][rows]
                where, k, together = rows, 1, all_on  # together: all intervals stand at the one coefficient k
                while len(where):
                    symbol, value, at = take(at, ac)
                    if isinstance(symbol, int) and symbol & 15 and isinstance(k, int):
                        k += symbol >> 4
                        if k > 63:
                            raise ValueError("a block of more than 64 coefficients")
                        if together:
                            target[k] = value
                        else:
                            target[k, where] = value
                        k += 1
                        if k > 63:
                            pos[where] = at
                            break
                        continue
                    symbol = np.broadcast_to(symbol, len(where))
                    k = k + (symbol >> 4).astype(np.int64)
                    held = (symbol & 15) > 0
                    if (k[held] > 63).any():
                        raise ValueError("a block of more than 64 coefficients")
                    target[k[held], where[held]] = value[held]
                    k = k + 1
                    on = (held | (symbol == 0xF0)) & (k < 64)
                    pos[where] = at
                    where, k, at, together = where[on], k[on], at[on], False
    # every interval must end in its own last byte
    ends_at = np.append(np.searchsorted(keep, cuts[1:]), len(data)).astype(np.int64)
    if ((pos + 7) >> 3 != ends_at).any():
        raise ValueError("an interval holds a code that no table has, or more than its units")
    result = []
    for p, values in zip(layout.parts, out, strict=True):
        flat = values.transpose(3, 0, 1, 2).reshape(len(frames), per_frame * step, p.v, p.h, 64)[:, :units]
        grid = flat.reshape(len(frames), down, across, p.v, p.h, 64).transpose(0, 1, 3, 2, 4, 5)
        result.append(grid.reshape(len(frames), down * p.v, across * p.h, 64))
    return result


def samples(values: np.ndarray, quant: bytes, width: int, height: int) -> np.ndarray:
    """8-bit samples (frames, height, width) of one component's coefficients."""
    q = np.frombuffer(quant, ">u2").astype(np.float64)
    f, rows, cols, _ = values.shape
    flat = (values.reshape(-1, 64) * q) @ _inverse_dct()
    pixels = np.clip(np.floor(flat / _SCALE + 128.5), 0, 255).astype(np.uint8)
    return pixels.reshape(f, rows, cols, 8, 8).transpose(0, 1, 3, 2, 4).reshape(f, rows * 8, cols * 8)[:, :height, :width]
