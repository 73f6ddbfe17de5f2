"""Hashes of words and word shingles of whole texts, in numpy."""

import numpy as np
import xxhash

# Words that a worker remembers.
_SEEN = 250_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash of each word (bytes)."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > _SEEN:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit depends on every other."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def join(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of the concatenation of two sequences with hashes a and b."""
    return mix(a * _ODD + mix(b + np.uint64(seed + 1)))


def windows(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of `size` consecutive words, from those of runs of powers of two."""
    count = len(hashes) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out, at, power, width = None, 0, hashes, 1
    while True:
        if size & width:
            part = power[at:at + count]
            out = part if out is None else join(out, part, seed)
            at += width
        width *= 2
        if width > size:
            return out if size > 1 else mix(out)
        power = join(power[: len(power) - width // 2], power[width // 2:], seed)


def shingle_sets(texts: list[str | None], size: int, seen: WordHashes) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles; a shorter text is one shingle."""
    words: list[bytes] = []
    ends = []
    for text in texts:
        words += (text or "").encode("utf-8", "replace").translate(LOWER).split()
        ends.append(len(words))
    hashes = seen.of(words)
    grams = windows(hashes, size)
    out, begin = [], 0
    for end in ends:
        count = end - begin - size + 1
        if count > 0:
            found = np.sort(grams[begin:begin + count])
            fresh = np.empty(count, bool)
            fresh[0] = True
            np.not_equal(found[1:], found[:-1], out=fresh[1:])
            out.append(found[fresh])
        elif end > begin:
            out.append(windows(hashes[begin:end], end - begin) ^ np.uint64(end - begin))
        else:
            out.append(hashes[:0])
        begin = end
    return out


def slices(texts, most: int = 1_500_000):
    """Lists of texts of an Arrow column, of about `most` characters each."""
    out, chars = [], 0
    for text in texts:
        out.append(text.as_py())
        chars += len(out[-1] or "")
        if chars >= most:
            yield out
            out, chars = [], 0
    if out:
        yield out
