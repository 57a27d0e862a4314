"""CRC-32 as linear algebra over GF(2): running values of a buffer, shifts, CRCs of its parts."""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0xEDB88320
ONES = np.uint32(0xFFFFFFFF)
# Bytes that the running scan takes in one lane; lanes are scanned side by side.
LANE = 128


def _byte_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(POLYNOMIAL), table >> 1)
    return table


TABLE = _byte_table()


def _apply(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (tables[0][x & 0xFF] ^ tables[1][(x >> 8) & 0xFF]
            ^ tables[2][(x >> 16) & 0xFF] ^ tables[3][x >> 24])


def _spread(basis: np.ndarray) -> np.ndarray:
    """Look-up tables (4 bytes by 256 values) of the linear map given on the 32 unit vectors."""
    tables = np.zeros((4, 256), np.uint32)
    values = np.arange(256)
    for bit in range(32):
        tables[bit // 8] ^= np.where((values >> (bit % 8)) & 1, basis[bit], np.uint32(0)).astype(np.uint32)
    return tables


def _powers(count: int) -> list[np.ndarray]:
    units = np.uint32(1) << np.arange(32, dtype=np.uint32)
    step = _spread(TABLE[units & 0xFF] ^ (units >> 8))
    powers = [step]
    while len(powers) < count:
        powers.append(_spread(_apply(powers[-1], _apply(powers[-1], units))))
    return powers


# SHIFTS[k] moves a register over 2**k zero bytes.
SHIFTS = _powers(40)


def shifted(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each register after ``lengths`` more zero bytes."""
    out = np.array(values, dtype=np.uint32)
    for k in range(int(lengths.max(initial=0)).bit_length()):
        at = np.flatnonzero((lengths >> k) & 1)
        out[at] = _apply(SHIFTS[k], out[at])
    return out


class RunningCrc:
    """The registers after every prefix of ``data``, from one scan."""

    def __init__(self, data: np.ndarray) -> None:
        lanes = max(1, -(-len(data) // LANE))
        padded = np.zeros(lanes * LANE, np.uint8)
        padded[:len(data)] = data
        columns = np.ascontiguousarray(padded.reshape(lanes, LANE).T)
        self.inner = np.zeros((LANE + 1, lanes), np.uint32)
        state = np.zeros(lanes, np.uint32)
        for i in range(LANE):
            state = TABLE[(state ^ columns[i]) & 0xFF] ^ (state >> 8)
            self.inner[i + 1] = state
        # The register at a lane's end, carried over the lanes by doubling distances.
        total, step, k = state.copy(), 1, LANE.bit_length() - 1
        while step < lanes:
            total[step:] ^= _apply(SHIFTS[k], total[:-step])
            step, k = 2 * step, k + 1
        self.begin = np.concatenate([np.zeros(1, np.uint32), total[:-1]])

    def at(self, positions: np.ndarray) -> np.ndarray:
        """The register after the first ``positions`` bytes."""
        lane = np.minimum(positions // LANE, len(self.begin) - 1)
        within = positions - lane * LANE
        return self.inner[within, lane] ^ shifted(self.begin[lane], within)


def part_crc(begin: np.ndarray, end: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of parts of ``lengths`` bytes from the registers before and after them.

    Shifting the register before a part over its length gives what the prefix adds to the register
    after it; both cancel, and with them the usual start and end of all ones.
    """
    return end ^ shifted(begin ^ ONES, lengths) ^ ONES


def joined_crc(first: np.ndarray, second: np.ndarray, second_lengths: np.ndarray) -> np.ndarray:
    """The CRC-32 of two strings in a row from those of both."""
    return shifted(first, second_lengths) ^ second
