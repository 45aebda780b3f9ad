"""Split-block bloom filters as Parquet stores them: insertion, membership and the value hash."""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import xxhash

from parqlane.sources.thrift import Reader

#: Fixed by the format: the eight odd factors of a block's words.
SALT = (0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31)


class SplitBlockBloom:
    def __init__(self, bits: bytes | int):
        """From a filter's bytes, or empty with so many bytes."""
        data = bytearray(bits)
        if not data or len(data) % 32:
            raise ValueError("a filter is a positive multiple of 32 bytes")
        self.words = np.frombuffer(data, "<u4").copy().reshape(-1, 8)

    def _place(self, hashed: int) -> tuple[int, np.ndarray]:
        low = np.uint32(hashed & 0xFFFFFFFF)
        with np.errstate(over="ignore"):
            shifts = (np.array(SALT, np.uint32) * low) >> np.uint32(27)
        return (hashed >> 32) * len(self.words) >> 32, np.uint32(1) << shifts

    def insert(self, hashed: int) -> None:
        block, mask = self._place(hashed)
        self.words[block] |= mask

    def might_contain(self, hashed: int) -> bool:
        block, mask = self._place(hashed)
        return bool((self.words[block] & mask == mask).all())

    def to_bytes(self) -> bytes:
        return self.words.tobytes()


def plain_bytes(value, physical: str) -> bytes:
    """A value as the PLAIN encoding has it, without a length."""
    if physical in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"):
        return value.encode() if isinstance(value, str) else bytes(value)
    return struct.pack({"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}[physical], value)


def xxhash64(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data, 0)


#: By the number of the union member in a filter's header. Open to further ones.
ALGORITHMS: dict[int, Callable[[bytes], SplitBlockBloom]] = {1: SplitBlockBloom}
HASHES: dict[int, Callable[[bytes], int]] = {1: xxhash64}


def read_filter(data: bytes) -> tuple[SplitBlockBloom, Callable[[bytes], int]] | None:
    """The filter that starts data and its hash; None if its kind isn't known."""
    reader = Reader(data)
    header = reader.fields()
    size = header[1]
    algorithm, hashed, compression = (next(iter(header[k]), None) for k in (2, 3, 4))
    if algorithm not in ALGORITHMS or hashed not in HASHES or compression != 1:
        return None
    return ALGORITHMS[algorithm](data[reader.at : reader.at + size]), HASHES[hashed]
