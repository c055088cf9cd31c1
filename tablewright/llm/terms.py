"""Terms of UTF-8 texts at the speed of byte tables.

Where a pattern's excluded characters are all ASCII, its maximal matches in a
text are those in the text's bytes: a table turns excluded bytes into blanks
and A-Z into a-z, the rest is a split at blanks."""

from __future__ import annotations

from collections.abc import Callable


def term_splitter(apart: str) -> Callable[[bytes | None], list[bytes]]:
    """``fn(utf8) -> terms`` for terms that are runs of anything but the ASCII
    characters in ``apart`` (which holds the blank), A-Z lower-cased; None has
    no terms."""
    table = bytearray(range(256))
    for c in range(65, 91):
        table[c] = c + 32
    for c in apart.encode("ascii"):
        table[c] = 32
    # what bytes.split() takes for a blank has to be a separator
    if any(table[c] != 32 for c in b" \t\n\r\x0b\x0c"):
        raise ValueError("white space must separate terms")
    table = bytes(table)
    return lambda raw: raw.translate(table).split() if raw else []


def ascii_but(keep: str) -> str:
    """All ASCII characters but those in ``keep``."""
    return "".join(chr(c) for c in range(128) if chr(c) not in keep)
