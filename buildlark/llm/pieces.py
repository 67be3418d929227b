"""Cutting texts where every byte-level BPE split pattern cuts, so that encodings can be reused.

A space or line feed between two characters that are no white space always starts a new piece of
the split pattern: no piece holds white space after another character, and the pattern never looks
behind. A text may therefore be encoded part by part, cut before them, with the same ids as in one go.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

BETWEEN = re.compile(r"(?<=\S) (?=\S)")

#: Parts a Python worker remembers; beyond that it starts anew. Bounds memory, not results.
REMEMBERED = 1_200_000

#: Characters of text that are cut and encoded together.
AT_ONCE = 1_000_000


def cut(text: str) -> list[str]:
    """Parts of ``text``. After the first, one that begins with a line feed stands for itself and
    any other for a space and itself. A line feed between other characters is cut off like a space.
    Parts with white space elsewhere (``uneven``) mean that ``cut_evenly`` must be used instead."""
    return text.replace("\n", " \n").split(" ")


def uneven(part: str) -> bool:
    return not part or part[-1].isspace() or (part[0].isspace() and (part[0] != "\n" or part[1].isspace()))


def cut_evenly(text: str) -> list[str]:
    return BETWEEN.split(text)


class PartEncoder:
    """Encode texts part by part, each different part once as long as it is remembered.

    ``encode_parts(inner, heads)`` gets parts with what stands before them and first parts; it
    returns the little-endian 32-bit ids of each. ``remembered`` parts are kept at most between calls.
    """

    def __init__(self, encode_parts: Callable[[list[str], list[str]], list[bytes]], remembered: int = REMEMBERED):
        self.encode_parts, self.remembered = encode_parts, remembered
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > self.remembered:
            self.known.clear()
        known = self.known
        look, new, held = known.get, set(), []
        for text in texts:
            parts = cut(text)
            found = list(map(look, parts))
            gaps = [i for i, f in enumerate(found) if f is None]
            missing = {parts[i] for i in gaps if i}
            if uneven(parts[0]) or any(map(uneven, missing)):
                parts = cut_evenly(text)
                found = list(map(look, parts))
                gaps = [i for i, f in enumerate(found) if f is None]
                missing = {parts[i] for i in gaps if i}
            new |= missing
            held.append((parts, found, gaps))
        missing, heads = list(new), list({parts[0] for parts, _, _ in held})
        out = self.encode_parts([p if p[0] == "\n" else " " + p for p in missing], heads)
        known.update(zip(missing, out))
        head = dict(zip(heads, out[len(missing):]))
        for parts, found, gaps in held:
            for i in gaps:
                if i:
                    found[i] = known[parts[i]]
            found[0] = head[parts[0]]
        return [b"".join(found) for _, found, _ in held]


def text_groups(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[str]]]:
    """First row and texts (NULL: empty) of runs of rows with about ``AT_ONCE`` characters."""
    texts = batch.column(column)
    start, held, size = 0, [], 0
    for i in range(batch.num_rows):
        t = texts[i].as_py() or ""
        held.append(t)
        size += len(t)
        if size >= AT_ONCE:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held
