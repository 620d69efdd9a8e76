"""Terms: maximal runs of ASCII letters and digits and of everything beyond ASCII, A-Z in lower case; as UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

#: Byte by byte: A-Z in lower case, other ASCII but letters and digits a space. Bytes from 0x80 on belong to characters beyond ASCII.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Texts of one portion have so many characters together, unless one alone has more.
PORTION_CHARS = 1_500_000


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split()


def portions(texts: Sequence[str], most_chars: int = PORTION_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of texts, so that long texts come few at a time."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > most_chars:
            yield start, i
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield start, len(texts)
