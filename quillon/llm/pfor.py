"""Patched frame-of-reference blocks: a binary format for token ids, in numpy alone.

Segment layout, all little-endian:
  magic "QPF1", u32 ids, u32 blocks, then u32 block starts (blocks + 1 of them, from the first block), then the blocks.
Block of BLOCK ids: u32 minimum, u8 width, u8 spare, u16 exceptions, BLOCK * width / 8 bytes of packed differences (low width bits of each,
lane-wise in 64-bit words), then per exception u16 position and, after all positions, u32 high part (difference >> width).
The last block is padded with its minimum. The width is the bit length of the PERCENTILE-th difference, so a few large ids go to the
exception list instead of widening the block.
"""

from __future__ import annotations

import numpy as np

BLOCK, PERCENTILE = 256, 0.9
MAGIC = b"QPF1"
_LANES = BLOCK // 64


def _pack(d: np.ndarray, w: int) -> np.ndarray:
    """(n, BLOCK) values under 2^w as (n, BLOCK * w / 8) bytes."""
    lanes = d.reshape(len(d), _LANES, 64)
    words = np.zeros((len(d), _LANES, w), np.uint64)
    for i in range(64):
        word, shift = divmod(i * w, 64)
        words[:, :, word] |= lanes[:, :, i] << np.uint64(shift)
        if shift + w > 64:
            words[:, :, word + 1] |= lanes[:, :, i] >> np.uint64(64 - shift)
    return words.astype("<u8", copy=False).reshape(len(d), -1).view(np.uint8)


def _unpack(raw: np.ndarray, w: int) -> np.ndarray:
    words = np.ascontiguousarray(raw).view("<u8").astype(np.uint64, copy=False).reshape(len(raw), _LANES, w)
    out = np.empty((len(raw), _LANES, 64), np.uint64)
    mask = np.uint64((1 << w) - 1)
    for i in range(64):
        word, shift = divmod(i * w, 64)
        v = words[:, :, word] >> np.uint64(shift)
        if shift + w > 64:
            v = v | (words[:, :, word + 1] << np.uint64(64 - shift))
        out[:, :, i] = v & mask
    return out.reshape(len(raw), BLOCK)


def encode(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return MAGIC + np.array([0, 0, 0], "<u4").tobytes()
    full = np.full(blocks * BLOCK, ids[-1], np.uint64)
    full[:n] = ids
    full = full.reshape(blocks, BLOCK)
    if n < blocks * BLOCK:
        full[-1, n - blocks * BLOCK :] = full[-1, : n - (blocks - 1) * BLOCK].min()
    low = full.min(1)
    d = full - low[:, None]
    pivot = np.partition(d, int(PERCENTILE * (BLOCK - 1)), 1)[:, int(PERCENTILE * (BLOCK - 1))]
    width = np.ceil(np.log2(pivot.astype(np.float64) + 1)).astype(np.int64)
    high = d >> width.astype(np.uint64)[:, None]
    over = high > 0
    counts = over.sum(1)
    sizes = 8 + BLOCK * width // 8 + 6 * counts
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    if starts[-1] >= 1 << 32:
        raise ValueError("a segment holds less than 4 GiB")
    body = np.zeros(starts[-1], np.uint8)
    head = np.zeros(blocks, np.dtype([("low", "<u4"), ("width", "u1"), ("spare", "u1"), ("over", "<u2")]))
    head["low"], head["width"], head["over"] = low, width, counts
    body[starts[:-1, None] + np.arange(8)] = head.view(np.uint8).reshape(blocks, 8)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            body[(starts[at] + 8)[:, None] + np.arange(BLOCK * w // 8)] = _pack(d[at] & np.uint64((1 << int(w)) - 1), int(w))
    row, position = np.nonzero(over)
    if len(row):
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        base = starts[row] + 8 + BLOCK * width[row] // 8
        body[(base + 2 * nth)[:, None] + np.arange(2)] = position.astype("<u2").view(np.uint8).reshape(-1, 2)
        body[(base + 2 * counts[row] + 4 * nth)[:, None] + np.arange(4)] = high[row, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    return MAGIC + np.array([n, blocks], "<u4").tobytes() + starts.astype("<u4").tobytes() + body.tobytes()


def decode(segment: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids first to last (exclusive; all by default) of a segment; only the blocks that hold them are unpacked."""
    if segment[:4] != MAGIC:
        raise ValueError("not a segment")
    n, blocks = (int(x) for x in np.frombuffer(segment, "<u4", 2, 4))
    last = n if last is None else min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    starts = np.frombuffer(segment, "<u4", blocks + 1, 12).astype(np.int64)
    body = np.frombuffer(segment, np.uint8, offset=12 + 4 * (blocks + 1))
    b0, b1 = first // BLOCK, -(-last // BLOCK)
    starts = starts[b0:b1]
    head = np.ascontiguousarray(body[starts[:, None] + np.arange(8)]).view(np.dtype([("low", "<u4"), ("width", "u1"), ("spare", "u1"), ("over", "<u2")])).reshape(-1)
    width, counts = head["width"].astype(np.int64), head["over"].astype(np.int64)
    d = np.zeros((b1 - b0, BLOCK), np.uint64)
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        if w:
            d[at] = _unpack(body[(starts[at] + 8)[:, None] + np.arange(BLOCK * w // 8)], int(w))
    if counts.sum():
        row = np.repeat(np.arange(b1 - b0), counts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        base = starts[row] + 8 + BLOCK * width[row] // 8
        position = np.ascontiguousarray(body[(base + 2 * nth)[:, None] + np.arange(2)]).view("<u2").reshape(-1)
        high = np.ascontiguousarray(body[(base + 2 * counts[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        d[row, position] |= high.astype(np.uint64) << width[row].astype(np.uint64)
    return (d + head["low"].astype(np.uint64)[:, None]).reshape(-1)[first - b0 * BLOCK : last - b0 * BLOCK].astype(np.uint32)
