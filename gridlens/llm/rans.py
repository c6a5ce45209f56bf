"""Static range asymmetric numeral system over token ids: segments with one frequency table and independent blocks.

A segment is bytes: MAGIC, a header, the table, the index of blocks, the blocks.
* The table has each id's share of 2 ** SCALE, counted over the whole segment; every id that occurs has one at least.
* A block codes up to BLOCK ids with LANES states in turn: id i belongs to lane i mod LANES. All lanes move in step, a
  vector at a time, and the words they give off follow in the order in which the decoder takes them.
* The index is a row of checkpoints: place and length of the block's words, number of ids, and CRC-32 of the decoded
  ids. With the states that stand before its words a block is decoded alone, in any order or task.

States are 64 bits wide and stay in [2 ** 31, 2 ** 63); they give off 32 bits at a time, at most once for an id.
"""

import struct
import zlib

import numpy as np

MAGIC = b"RANS1\0"
HEADER = struct.Struct("<6sIIQ")  # magic, bytes of the packed table, blocks, ids
CHECKPOINT = np.dtype([("at", "<u8"), ("words", "<u4"), ("ids", "<u4"), ("crc", "<u4")])
SCALE = 20
LANES = 1024
BLOCK = 1 << 18
LOW = np.uint64(1 << 31)
WORD = np.uint64(32)
BITS = np.uint64(SCALE)
MASK = np.uint64((1 << SCALE) - 1)


def shares(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and their shares, which add up to 2 ** SCALE."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    if len(symbols) > 1 << (SCALE - 1):
        raise ValueError(f"a segment has {len(symbols)} different ids; its table holds {1 << (SCALE - 1)}")
    counts = counts[symbols]
    own = np.maximum(1, counts * (1 << SCALE) // counts.sum())
    rest = int((1 << SCALE) - own.sum())
    order = np.argsort(-counts, kind="stable")
    if rest > 0:
        own[order[0]] += rest
    for i in order:
        if rest >= 0:
            break
        less = min(-rest, int(own[i]) // 2)
        own[i] -= less
        rest += less
    return symbols.astype(np.uint32), own.astype(np.uint32)


def _coded(numbers: np.ndarray, own: np.ndarray, firsts: np.ndarray) -> bytes:
    """States and words of one block; numbers index the table."""
    n = len(numbers)
    states = np.full(min(LANES, n), LOW)
    words = []
    for at in range((n - 1) // LANES * LANES, -1, -LANES):
        part = numbers[at : at + LANES]
        x, f = states[: len(part)], own[part]
        full = x >= (f << np.uint64(63 - SCALE))
        words.append(x[full].astype("<u4"))
        x = np.where(full, x >> WORD, x)
        whole = x // f
        states[: len(part)] = (whole << BITS) + (x - whole * f) + firsts[part]
    return b"".join([states.astype("<u8").tobytes(), *(w.tobytes() for w in reversed(words))])


def _decoded(data: memoryview, n: int, n_words: int, own: np.ndarray, firsts: np.ndarray, slots: np.ndarray) -> np.ndarray:
    states = np.frombuffer(data, "<u8", min(LANES, n)).astype(np.uint64)
    words = np.frombuffer(data, "<u4", n_words, 8 * len(states)).astype(np.uint64)
    numbers = np.empty(n, slots.dtype)
    taken = 0
    for at in range(0, n, LANES):
        x = states[: min(LANES, n - at)]
        slot = x & MASK
        part = slots[slot]
        numbers[at : at + LANES] = part
        x = own[part] * (x >> BITS) + slot - firsts[part]
        low = np.flatnonzero(x < LOW)
        if taken + len(low) > n_words:
            raise ValueError("damaged block: its words end too early")
        x[low] = (x[low] << WORD) | words[taken : taken + len(low)]
        taken += len(low)
        states[: len(x)] = x
    return numbers


def _packed(symbols: np.ndarray, own: np.ndarray) -> bytes:
    return zlib.compress(np.diff(symbols, prepend=np.uint32(0)).astype("<u4").tobytes() + own.astype("<u4").tobytes(), 1)


def _unpacked(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, own = np.frombuffer(zlib.decompress(table), "<u4").reshape(2, -1)
    return np.cumsum(steps, dtype=np.uint32), own


def encode_segment(ids: np.ndarray) -> bytes:
    """One segment for ids (unsigned, below 2 ** 32; any number of them)."""
    if not len(ids):
        return HEADER.pack(MAGIC, 0, 0, 0)
    symbols, own = shares(ids)
    number_of = np.zeros(int(symbols[-1]) + 1, np.uint32)
    number_of[symbols] = np.arange(len(symbols), dtype=np.uint32)
    firsts = (np.cumsum(own) - own).astype(np.uint64)
    own = own.astype(np.uint64)
    blocks, index, at = [], [], 0
    for start in range(0, len(ids), BLOCK):
        part = ids[start : start + BLOCK]
        coded = _coded(number_of[part], own, firsts)
        n_words = (len(coded) - 8 * min(LANES, len(part))) // 4
        index.append((at, n_words, len(part), zlib.crc32(part.astype("<u4").tobytes())))
        blocks.append(coded)
        at += len(coded)
    table = _packed(symbols, own)
    return b"".join([HEADER.pack(MAGIC, len(table), len(blocks), len(ids)), table, np.array(index, CHECKPOINT).tobytes(), *blocks])


def decode_segment(data: bytes, wanted: range | None = None) -> np.ndarray:
    """The ids of the segment, or of some of its blocks; ValueError where bytes were damaged."""
    magic, table_bytes, n_blocks, n = HEADER.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a segment")
    if not n:
        return np.zeros(0, np.uint32)
    view = memoryview(data)
    table_end = HEADER.size + table_bytes
    symbols, own = _unpacked(view[HEADER.size : table_end])
    firsts = (np.cumsum(own) - own).astype(np.uint64)
    slots = np.repeat(np.arange(len(symbols), dtype=np.uint32), own)
    own = own.astype(np.uint64)
    index = np.frombuffer(data, CHECKPOINT, n_blocks, table_end)
    first_block = table_end + index.nbytes
    parts = []
    for block in wanted if wanted is not None else range(n_blocks):
        point = index[block]
        at = first_block + int(point["at"])
        part = symbols[_decoded(view[at:], int(point["ids"]), int(point["words"]), own, firsts, slots)]
        if zlib.crc32(part.astype("<u4").tobytes()) != point["crc"]:
            raise ValueError(f"block {block} does not match its checksum")
        parts.append(part)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)
