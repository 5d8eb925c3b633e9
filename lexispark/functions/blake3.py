"""BLAKE3 digests of 32 bytes, after the published specification; for columns, in Arrow batches."""

from __future__ import annotations

import struct

# fixed values of the specification: the initial state, the order of message words from round to round, flags, sizes in bytes
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
BLOCK, CHUNK = 64, 1024
ROUNDS = 7

_MASK = 0xFFFFFFFF
#: Columns, then diagonals, of the state seen as four rows of four.
_QUARTERS = [(k, k + 4, k + 8, k + 12) for k in range(4)] + [(k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4) for k in range(4)]


def _schedule() -> list[list[int]]:
    rows = [list(range(16))]
    for _ in range(ROUNDS - 1):
        rows.append([rows[-1][k] for k in ORDER])
    return rows


_SCHEDULE = _schedule()


def _compressed(chain: tuple[int, ...], block: bytes, counter: int, flags: int) -> tuple[int, ...]:
    """The next chaining value of eight words."""
    m = struct.unpack("<16I", block.ljust(BLOCK, b"\0"))
    v = [*chain, *IV[:4], counter & _MASK, counter >> 32, len(block), flags]
    for words in _SCHEDULE:
        for k, (a, b, c, d) in enumerate(_QUARTERS):
            for half, (one, two) in enumerate(((16, 12), (8, 7))):
                v[a] = (v[a] + v[b] + m[words[2 * k + half]]) & _MASK
                x = v[d] ^ v[a]
                v[d] = (x >> one | x << (32 - one)) & _MASK
                v[c] = (v[c] + v[d]) & _MASK
                x = v[b] ^ v[c]
                v[b] = (x >> two | x << (32 - two)) & _MASK
    return tuple(v[k] ^ v[k + 8] for k in range(8))


def _chunk(data: bytes, counter: int, root: int) -> tuple[int, ...]:
    chain = IV
    blocks = [data[at : at + BLOCK] for at in range(0, len(data), BLOCK)] or [b""]
    for k, block in enumerate(blocks):
        last = k == len(blocks) - 1
        chain = _compressed(chain, block, counter, CHUNK_START * (k == 0) | CHUNK_END * last | root * last)
    return chain


def digest(data: bytes) -> bytes:
    """The digest of 32 bytes."""
    if len(data) <= CHUNK:
        return struct.pack("<8I", *_chunk(data, 0, ROOT))
    # trees of 2**k chunks that are complete, largest first; what is left when chunks end is joined from the right
    heights: list[tuple[int, tuple[int, ...]]] = []
    n = -(-len(data) // CHUNK)
    for k in range(n):
        size, node = 0, _chunk(data[k * CHUNK : (k + 1) * CHUNK], k, 0)
        while heights and heights[-1][0] == size and k + 1 < n:
            node = _joined(heights.pop()[1], node, 0)
            size += 1
        heights.append((size, node))
    node = heights.pop()[1]
    while heights:
        node = _joined(heights.pop()[1], node, 0 if heights else ROOT)
    return struct.pack("<8I", *node)


def _joined(left: tuple[int, ...], right: tuple[int, ...], root: int) -> tuple[int, ...]:
    return _compressed(IV, struct.pack("<16I", *left, *right), 0, PARENT | root)
