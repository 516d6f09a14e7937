"""64-bit hashes of word k-grams of many texts at once, by prefix sums of a polynomial over their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .anchors import polynomial_hashes

BATCH = 1 << 18  # bytes of text that are taken at a time
_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


def portions(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Place of the first text, and the texts, of portions of about ``BATCH`` bytes; null counts as empty."""
    first, size, some = 0, 0, []
    for i, t in enumerate(texts):
        some.append(t.as_py() or b"")
        size += len(some[-1])
        if size >= BATCH:
            yield first, some
            first, size, some = i + 1, 0, []
    if some:
        yield first, some


def word_grams(texts: list[bytes], width: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, of its word, and hash of each ``width``-gram of words, in order.

    Words stand between ASCII white space, whatever and however much of it; with ``lower``, A-Z count as a-z. A text of
    fewer words has one gram, the whole sequence.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    after = np.append(True, space[:-1])  # what stands after white space
    begins = np.flatnonzero(after & ~space)
    if not len(begins):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    kept = ~(space & after)  # words, each with one space behind it
    doc = np.searchsorted(starts, begins, "right") - 1
    first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    of_doc = np.diff(np.append(first, len(doc)))
    word = np.arange(len(doc)) - np.repeat(first, of_doc)
    words = np.repeat(of_doc, of_doc)
    gram = np.flatnonzero((word + width <= words) | ((word == 0) & (words < width)))
    last = gram + np.minimum(width, words[gram]) - 1
    at = (np.cumsum(kept) - 1)[begins]
    ends = np.append(at[1:], kept.sum()) - 1
    return doc[gram], word[gram], polynomial_hashes(np.where(space, np.uint8(32), data)[kept], at[gram], ends[last])
