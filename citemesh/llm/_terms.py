"""Terms of texts: runs of kept ASCII characters and of all others beyond ASCII, with only A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: Bytes of a text that are split at once.
PIECE = 1 << 20


def byte_map(kept: str) -> bytes:
    """Of each byte: itself, its lower case, or a space where no term holds it. UTF-8 bytes from 0x80 are kept."""
    return bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or chr(b) in kept else 32 for b in range(256))


LETTERS = byte_map("abcdefghijklmnopqrstuvwxyz")
LETTERS_DIGITS = byte_map("abcdefghijklmnopqrstuvwxyz0123456789")


def pieces(data: bytes, known: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded piece of it at a time; a term is never split."""
    if len(data) <= PIECE:
        yield data.translate(known).split()
        return
    at = 0
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and known[data[end]] != 32:
            end += 1
        yield data[at:end].translate(known).split()
        at = end


def texts_of(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a column's texts."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()
