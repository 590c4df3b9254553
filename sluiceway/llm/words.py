"""Words and word shingles of whole texts as 64-bit hashes, computed over bytes in numpy.

A word is a longest run of bytes other than space and ``\\x09``-``\\x0d``, with A-Z in
lower case; both are ASCII, so this is exact on UTF-8. A shingle is five words in a row;
a text of one to four words has one, its whole sequence; a text without words has none.
Hashes stand for words: among a billion distinct ones, a clash has odds of about 1 to 40.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

SHINGLE = 5
_CHUNK = 1 << 18  # bytes; arrays of 8 for each stay in a cache, and workers small
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_PUNCTUATED = np.ones(256, bool)
_PUNCTUATED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACES = b" \t\n\v\f\r"
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits of its argument."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base & (2**64 - 1)))
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))[_LOWER]
_UP = _powers(_BASE, _CHUNK + 1)
_DOWN = _powers(_INVERSE, _CHUNK + 1)


def _hashes(data: bytes, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of some bytes: hash, first byte, and byte after the last."""
    raw = np.frombuffer(data, np.uint8)
    word = np.zeros(len(raw) + 2, bool)
    np.take(~between, raw, out=word[1:-1], mode="clip")
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start, end
    up, down = (_UP, _DOWN) if len(raw) < len(_UP) else (_powers(_BASE, len(raw)), _powers(_INVERSE, len(raw)))
    total = np.take(_BYTE, raw)
    total *= up[: len(raw)]
    np.cumsum(total, out=total)
    upto = total[end - 1]
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    return mix((upto - before) * down[start] + (end - start).astype(np.uint64)), start, end


def _parts(data: bytes) -> Iterator[bytes]:
    """A text in parts of about ``_CHUNK``, cut at white space."""
    at = 0
    while len(data) - at > _CHUNK:
        cuts = [p for s in _SPACES if (p := data.rfind(bytes([s]), at, at + _CHUNK)) > at]
        if not cuts:  # a word longer than that: up to its end
            cuts = [min((p for s in _SPACES if (p := data.find(bytes([s]), at + 1)) > 0), default=len(data))]
        yield data[at : max(cuts)]
        at = max(cuts)
    yield data[at:]


def word_hashes(texts: Iterable[str | None], *, punctuated: bool = False) -> Iterator[np.ndarray]:
    """Each text's words in order, as uint64; a null text has none.

    ``punctuated`` ends words at any ASCII character that is not a letter or digit, too.
    """
    between = _PUNCTUATED if punctuated else _SPACE
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        found, start, _ = _hashes(b" ".join(held), between)
        ends = np.cumsum([len(x) + 1 for x in held])
        yield from np.split(found, np.searchsorted(start, ends[:-1]))

    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass")
        if size and size + len(data) + 1 > _CHUNK:
            yield from flush()
            held, size = [], 0
        if len(data) >= _CHUNK:
            yield np.concatenate([_hashes(x, between)[0] for x in _parts(data)])
            continue
        held.append(data)
        size += len(data) + 1
    if held:
        yield from flush()


def word_spans(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A text's words: hash, and first and end byte in its UTF-8 form."""
    data = (text or "").encode("utf-8", "surrogatepass")
    found, at = [], 0
    for part in _parts(data):
        h, start, end = _hashes(part)
        found.append((h, start + at, end + at))
        at += len(part)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The hash of every run of n words, in order; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + words[k : len(words) - n + 1 + k]
    return mix(out)


def shingle_set(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """The distinct shingles, sorted."""
    return np.unique(shingles(words, n))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
