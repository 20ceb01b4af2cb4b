"""Words and five-word shingles of many texts at once, as 64-bit hashes.

A-Z is lower-cased and words are runs without ASCII white space. Texts are taken as
UTF-8 bytes, end to end, so that all steps are array operations. The texts of one
call should hold a few megabytes; a longer text is a call of its own.
"""

from __future__ import annotations

import numpy as np

#: Words per shingle.
SHINGLE = 5

#: Texts whose numbers fit beside 44 bits of a hash.
_NUMBERED = 1 << 20

_PRIME = 0x100000001B3
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xC2B2AE3D27D4EB4F)


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes whose every bit depends on all bits of ``x``."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACES = b" \t\n\x0b\x0c\r"
#: Per byte: whether it divides words, whether it doesn't, and its code, one more than the byte with A-Z lowered.
#: Code 256 doesn't fit, so byte 255 (which no UTF-8 text has) takes the code that A-Z leave free.
SPACE = np.array([b in _SPACES for b in range(256)])
_SOLID = bytes(b not in _SPACES for b in range(256))
_CODES = bytes(66 if b == 255 else b + 33 if 65 <= b <= 90 else b + 1 for b in range(256))


_KEPT: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def hash_powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base and of its inverse; kept for texts of ordinary length."""
    kept = _KEPT.get("powers")
    if kept is None or len(kept[0]) <= size:
        wide = max(size, 1 << 20) + 1
        kept = tuple(
            np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(wide, base, np.uint64))), dtype=np.uint64)
            for base in (_PRIME, pow(_PRIME, -1, 1 << 64))
        )
        if wide <= 1 << 22:
            _KEPT["powers"] = kept
    return kept


#: Bytes that are looked at together: their arrays stay in a core's cache.
_BLOCK = 1 << 16


def words(data: np.ndarray, starts: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, begin) of each word of texts that lie end to end; no word crosses a start.

    ``extra`` marks bytes that divide words beside white space. The texts are taken in
    blocks that end at white space, or go on until there is some.
    """
    cuts = [0]
    for at in range(_BLOCK, len(data), _BLOCK):
        if at > cuts[-1]:
            # White space is near as a rule.
            for wide in (_BLOCK >> 8, _BLOCK):
                found = np.flatnonzero(SPACE[data[at : at + wide]])
                if len(found):
                    cuts.append(at + int(found[0]))
                    break
    inner = np.searchsorted(starts, [*cuts, len(data)])
    out = [
        _words(data[a:b], starts[low:high] - a, None if extra is None else extra[a:b])
        for a, b, low, high in zip(cuts, [*cuts[1:], len(data)], inner[:-1], inner[1:])
    ]
    return np.concatenate([v for v, _ in out]), np.concatenate([begin + a for a, (_, begin) in zip(cuts, out)])


def _words(data: np.ndarray, starts: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    size = len(data)
    if not size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    raw = data.tobytes()
    solid = np.frombuffer(raw.translate(_SOLID), bool)
    if extra is not None:
        solid = solid & ~extra
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    edges = np.concatenate((np.zeros(int(solid[0]), np.int64), edges, np.full(int(solid[-1]), size)))
    begin, end = edges[::2], edges[1::2]
    inner = starts[(starts > 0) & (starts < size)]
    split = np.unique(inner[solid[inner] & solid[inner - 1]])
    if len(split):
        begin, end = np.sort(np.concatenate((begin, split))), np.sort(np.concatenate((end, split)))
    powers, inverse = hash_powers(size)
    total = np.zeros(size + 1, np.uint64)
    np.multiply(np.frombuffer(raw.translate(_CODES), np.uint8), powers[:size], out=total[1:])
    np.cumsum(total, out=total)
    value = (total[end] - total[begin]) * inverse[begin]
    return mixed(value ^ ((end - begin).astype(np.uint64) * _MIX)), begin


def word_counts(at: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Words per text, by the places where words and texts begin; of texts that begin at one place the last has them."""
    return np.diff(np.searchsorted(at, begin), append=len(at))


def _chained(value: np.ndarray, word: np.ndarray) -> np.ndarray:
    value = value * _MIX + word
    value ^= value >> np.uint64(29)
    return value


def shingles(word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of all shingles in order of their texts; ``counts`` holds the words per text."""
    texts = len(counts)
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    first, placed = np.cumsum(counts) - counts, np.cumsum(made) - made
    owner = np.repeat(np.arange(texts), made)
    begin = np.arange(len(owner)) + np.repeat(first - placed, made)
    # Five words in a row, wherever they begin; those that cross texts aren't taken.
    whole = max(0, len(word) - SHINGLE + 1)
    run = np.full(whole, SHINGLE * int(_MIX2) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(SHINGLE):
        run = _chained(run, word[i : i + whole])
    value = run[np.minimum(begin, whole - 1)] if whole else np.zeros(len(owner), np.uint64)
    few = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    size = counts[few]
    short = size.astype(np.uint64) * _MIX2
    for i in range(SHINGLE - 1):
        more = size > i
        short[more] = _chained(short[more], word[first[few[more]] + i])
    value[placed[few]] = short
    return mixed(value), owner


def shingle_sets(word: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, end to end, and their number per text.

    ``counts`` holds the words per text. A text with fewer words than a shingle
    has one shingle, the whole sequence; a text without words has none.
    """
    value, owner, texts = *shingles(word, counts), len(counts)
    if texts <= _NUMBERED:
        # One key of the text and the hash's leading 44 bits sorts much faster than two keys.
        order = np.argsort((owner.astype(np.uint64) << np.uint64(44)) | (value >> np.uint64(20)))
    else:
        order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[new], np.bincount(owner[new], minlength=texts)


def text_shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``shingle_sets`` of whole texts."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
    word, begin = words(data, starts)
    return shingle_sets(word, word_counts(begin, starts[:-1]))


def batches(texts: list[bytes], limit: int = 1 << 20):
    """Runs of texts of about ``limit`` bytes, in order."""
    at = 0
    while at < len(texts):
        until, held = at, 0
        while until < len(texts) and (until == at or held + len(texts[until]) <= limit):
            held += len(texts[until])
            until += 1
        yield texts[at:until]
        at = until
