"""CRC-32 of a whole from the CRC-32 of its parts."""

from __future__ import annotations

import functools
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, functions as F

# Fixed value: the reversed polynomial of CRC-32.
POLYNOMIAL = 0xEDB88320
# Files of up to 2**48 bytes.
LENGTH_BITS = 48


def _times(matrix: list[int], vector: int) -> int:
    product = 0
    for bit, column in enumerate(matrix):
        if vector >> bit & 1:
            product ^= column
    return product


@lru_cache(maxsize=1)
def zero_byte_matrices() -> list[list[int]]:
    """For each k, what becomes of the 32 bits of a CRC behind 2**k zero bytes."""
    one_bit = [POLYNOMIAL] + [1 << n for n in range(31)]
    matrix = one_bit
    for _ in range(3):
        matrix = [_times(matrix, column) for column in matrix]
    matrices = [matrix]
    for _ in range(LENGTH_BITS - 1):
        matrices.append([_times(matrices[-1], column) for column in matrices[-1]])
    return matrices


@lru_cache(maxsize=1)
def zero_byte_tables() -> np.ndarray:
    """The same matrices by four bits at a time: for each k, place of the four bits and value of them, what these become."""
    digits = [
        [[_times(matrix, value << 4 * place) for value in range(16)] for place in range(8)] for matrix in zero_byte_matrices()
    ]
    return np.array(digits, np.int64)


def crc_before(crc: Column, n_bytes: Column) -> Column:
    """What a part with this CRC-32 adds (by exclusive or) to that of a whole in which ``n_bytes`` follow it.

    So the CRC-32 of a whole is ``bit_xor`` over its parts, in any order. The matrices of the bits that are set in
    ``n_bytes`` are applied one after the other, by tables of what each four bits become.
    """
    tables = F.lit(zero_byte_tables().reshape(-1))

    def moved(value: Column, power: Column) -> Column:
        digits = (F.shiftright(value, 4 * place).bitwiseAND(15) for place in range(8))
        found = (F.get(tables, (power * 128 + 16 * place + d).cast("int")) for place, d in enumerate(digits))
        return functools.reduce(Column.bitwiseXOR, found)

    def behind(value: Column, n: Column) -> Column:
        last = F.least(F.length(F.bin(n)) - 1, F.lit(LENGTH_BITS - 1))
        return F.aggregate(F.filter(F.sequence(F.lit(0), last), lambda k: F.getbit(n, k) == 1), value, moved)

    # In an array of one, so that the number is worked out once and not for each of its bits.
    return F.aggregate(F.array(F.coalesce(n_bytes.cast("bigint"), F.lit(0))), crc.cast("bigint"), behind)
