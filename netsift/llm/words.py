"""Words of letters, digits and non-ASCII characters, A-Z lower-cased, cut from the bytes of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

_PLAIN = re.compile(rb"[^0-9A-Za-z\x80-\xff]")
_TABLE = bytes(c | 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(body: bytes) -> list[bytes]:
    """The words of UTF-8 bytes in order, repeats included."""
    return body.translate(_TABLE).split()


def word_blocks(body: bytes | None, block: int = 1 << 20) -> Iterator[list[bytes]]:
    """The same about ``block`` bytes at a time, so that a very long text is never laid out as words as a whole.

    Blocks end between words. A null text has none.
    """
    at, end = 0, len(body or b"")
    while at < end:
        stop = _PLAIN.search(body, at + block) if at + block < end else None
        to = stop.start() if stop else end
        yield words_of(body[at:to])
        at = to
