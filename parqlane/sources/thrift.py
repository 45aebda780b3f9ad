"""Reading of Thrift's compact encoding into plain values: structs as {field id: value}."""

from __future__ import annotations

import struct

#: Fixed by the encoding: type numbers.
TRUE, FALSE, BYTE, I16, I32, I64, DOUBLE, BINARY, LIST, SET, MAP, STRUCT = range(1, 13)


class Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    def signed(self) -> int:
        n = self.varint()
        return n >> 1 ^ -(n & 1)

    def binary(self) -> bytes:
        n = self.varint()
        self.at += n
        return self.data[self.at - n : self.at]

    def value(self, kind: int):
        if kind in (TRUE, FALSE):  # in a list a boolean is a byte
            self.at += 1
            return self.data[self.at - 1] == TRUE
        if kind == BYTE:
            self.at += 1
            return struct.unpack_from("<b", self.data, self.at - 1)[0]
        if kind in (I16, I32, I64):
            return self.signed()
        if kind == DOUBLE:
            self.at += 8
            return struct.unpack_from("<d", self.data, self.at - 8)[0]
        if kind == BINARY:
            return self.binary()
        if kind in (LIST, SET):
            head = self.data[self.at]
            self.at += 1
            n = head >> 4
            n = self.varint() if n == 15 else n
            return [self.value(head & 15) for _ in range(n)]
        if kind == MAP:
            n = self.varint()
            kinds = self.data[self.at] if n else 0
            self.at += bool(n)
            return {self.value(kinds >> 4): self.value(kinds & 15) for _ in range(n)}
        if kind == STRUCT:
            return self.fields()
        raise ValueError(f"unknown Thrift type {kind}")

    def fields(self) -> dict[int, object]:
        out, last = {}, 0
        while True:
            head = self.data[self.at]
            self.at += 1
            if not head:
                return out
            last = last + (head >> 4) if head >> 4 else self.signed()
            kind = head & 15
            out[last] = kind == TRUE if kind in (TRUE, FALSE) else self.value(kind)
