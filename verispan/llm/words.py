"""Words, word hashes, shingles and window fingerprints in numpy."""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np

from verispan.llm.lookalike import canonical

#: A run of letters and digits; a mark belongs to the letter it stands on.
WORD = re.compile(r"[^\W_](?:[^\W_]|[\u0300-\u036f\u0483-\u0487\u0591-\u05bd\u064b-\u065f\u093a-\u094d])*")
_PLAIN = re.compile("[a-z0-9]+")
#: The file of a public tokenizer: byte pairs by rank.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of that tokenizer.
_SPLITS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KEPT = 1 << 18  # words whose hash a worker keeps; it starts anew beyond


def words_of(text: str | None, fold_looks: bool = True) -> list[str]:
    """Words of a text without case; with fold_looks, characters that look the same count as the same."""
    if not text:
        return []
    if text.isascii():
        return _PLAIN.findall(text.lower())
    t = canonical(text) if fold_looks else text
    return WORD.findall(t.casefold())


@lru_cache(maxsize=4)
def tokenizer(ranks_file: str = RANKS):
    """The tokenizer of a file of ranks; the strings of special tokens are ordinary text to it."""
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=_SPLITS, mergeable_ranks=ranks, special_tokens={})


class WordHash:
    """64-bit hashes of words, the same on every machine."""

    class _Known(dict):
        def __missing__(self, w: str) -> int:
            h = self[w] = int.from_bytes(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
            return h

    def __init__(self) -> None:
        self.known = self._Known()

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > _KEPT:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, in order; of all words where there are fewer."""
    if len(h) == 0:
        return h
    n = min(n, len(h))
    x = np.zeros(len(h) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            x = (x ^ (x >> np.uint64(29))) * _MIX + h[k : len(h) - n + 1 + k]
        x ^= x >> np.uint64(32)
        return x * _MIX


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two numbers per bit position, each given by its binary digits, lowest first."""
    out, carry = [], None
    for k in range(max(len(a), len(b))):
        some = [x[k] for x in (a, b) if k < len(x)] + ([] if carry is None else [carry])
        if len(some) == 1:
            out.append(some[0])
            carry = None
        elif len(some) == 2:
            out.append(some[0] ^ some[1])
            carry = some[0] & some[1]
        else:
            half = some[0] ^ some[1]
            out.append(half ^ some[2])
            carry = (some[0] & some[1]) | (half & some[2])
    return out if carry is None else [*out, carry]


def simhash_windows(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash (64 bits) of every window of size words; a bit is set where more than half of the words have it.

    The 64 counts are kept as binary digits across words of 64 bits, and those of
    2, 4, 8 ... words are sums of two halves, so a window takes a few dozen
    operations whatever its size.
    """
    n = len(h) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, width, total, done = [h], 1, None, 0
    while width <= size:
        if size & width:
            part = [x[done : done + n] for x in power]
            total = part if total is None else _add(total, part)
            done += width
        if 2 * width <= size:
            m = len(h) - 2 * width + 1
            power = _add([x[:m] for x in power], [x[width : width + m] for x in power])
        width *= 2
    need = size // 2 + 1
    more, equal = np.zeros(n, np.uint64), np.full(n, ~np.uint64(0))
    for k in range(max(len(total), need.bit_length()) - 1, -1, -1):
        x = total[k] if k < len(total) else np.zeros(n, np.uint64)
        if need >> k & 1:
            equal &= x
        else:
            more |= equal & x
            equal &= ~x
    return more | equal
