"""Words of many texts as 64-bit numbers, found with array operations."""

from __future__ import annotations

import functools
import re
import string

import numpy as np

#: Bytes that are hashed at once.
CHUNK = 2 << 20
_BASE = 0x9E3779B97F4A7C15
_SPACES = (string.whitespace + string.punctuation).encode()
#: Letters of scripts written without spaces (Thai, Lao, Myanmar, Khmer, Tai, kana, bopomofo, Han) with their
#: marks; each is a word. Also the punctuation of such texts and full-width forms, which end words, and
#: full-width letters and digits, which count as their ASCII forms.
_UNSPACED = (
    "\u0e01-\u0e3a\u0e40-\u0e4e\u0e81-\u0ece\u0edc-\u0edf\u1000-\u103f\u1050-\u108f\u109a-\u109f\u1780-\u17d3\u1950-\u19df"
    "\u1a20-\u1aad\uaa60-\uaadf\u2e80-\u2fdf\u3005-\u3007\u3021-\u302f\u3031-\u303c\u3041-\u30fa\u30fc-\u312f\u31a0-\u31bf"
    "\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00016fe0-\U00018cff\U0001aff0-\U0001b16f"
    "\U00020000-\U0003ffff"
)
_STOPS = "\u0e2f\u0e46\u0e4f\u0e5a\u0e5b\u104a-\u104f\u17d4-\u17da\u3000-\u3004\u3008-\u3020\u3030\u303d-\u303f\u30a0\u30fb"
_STOPS += "\ufe10-\ufe1f\ufe30-\ufe6f\uff00-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65\uffe0-\uffee"
_STOP = re.compile(f"[{_STOPS}]")
_LETTER = re.compile(f"[{_UNSPACED}]")
_WIDE = {c: c - 0xFEE0 for c in (*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B))}
_ANY = re.compile(f"[{_UNSPACED}{_STOPS}\uff10-\uff5a]")
_PLAIN = bytes(0x20 if b in _SPACES else b | 0x20 if 0x41 <= b <= 0x5A else b for b in range(256))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    forth, back = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    forth[0] = back[0] = 1
    return np.cumprod(forth), np.cumprod(back)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def plain(text: str | None) -> bytes:
    """The text's bytes with A-Z in lower case and a space for ASCII white space and punctuation.

    Letters of scripts without spaces stand alone, so that each is a word, and their
    punctuation is a space.
    """
    text = text or ""
    if not text.isascii() and _ANY.search(text):
        text = _LETTER.sub(r" \g<0> ", _STOP.sub(" ", text)).translate(_WIDE)
    return text.encode().translate(_PLAIN)


def spaced(text: str) -> str:
    """The text, where it holds letters of scripts without spaces with a space around each of them."""
    return _LETTER.sub(r" \g<0> ", text) if not text.isascii() and _LETTER.search(text) else text


def _chunks(data: bytes):
    start = 0
    while start < len(data):
        end = min(len(data), start + CHUNK)
        if end < len(data):
            space = data.rfind(b" ", start, end)
            end = space + 1 if space >= 0 else end
            if space < 0:  # one word longer than a chunk
                after = data.find(b" ", end)
                end = len(data) if after < 0 else after + 1
        yield data[start:end]
        start = end


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of plain texts, and where each text's words start (with the end)."""
    joined = b" ".join(texts) + b" "
    bounds = np.cumsum([0] + [len(t) + 1 for t in texts])
    hashes, places, at = [], [], 0
    for chunk in _chunks(joined):
        data = np.frombuffer(chunk, np.uint8)
        n = len(data)
        word = np.concatenate([[False], data != 0x20, [False]])
        edges = np.flatnonzero(word[1:] != word[:-1])
        starts, ends = edges[::2], edges[1::2]
        forth, back = _powers(max(CHUNK, 1 << (n - 1).bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forth[:n], out=sums[1:])
        hashes.append(mixed((sums[ends] - sums[starts]) * back[starts]))
        places.append(starts + at)
        at += n
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), bounds)
