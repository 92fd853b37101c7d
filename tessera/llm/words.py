"""Words of Arrow text columns and their hashes, computed on the UTF-8 bytes of many documents at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

#: The bytes that part words: space and 9 to 13. UTF-8 has them nowhere else, so bytes part as code points do.
_GAP = np.zeros(256, bool)
_GAP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_U = np.uint64

#: Bytes of a word that are mixed at once, and the masks that leave the first 0 to 8 of them.
CHUNK = 8
_FIRST_BYTES = np.array([(1 << (8 * n)) - 1 for n in range(CHUNK + 1)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (a published 64-bit finalizer)."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


class Family:
    """A family of hashes of words and of sequences of words.

    A word is cut into chunks of 8 bytes. Each chunk is combined with a random key of its place and mixed, which no sum of
    other chunks undoes; the sum of the chunks and the length are mixed again. A polynomial in the bytes modulo 2^64 would
    not do: it takes some pairs of words of 1,024 bytes for equal whatever its base. Sequences are sums of word hashes by
    random odd factors of their places, not by powers of one.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.length_key, self.whole_key, self.place_key, self.step_key = (int(x) | 1 for x in rng.integers(1 << 40, 1 << 63, 4))

    def _keys(self, places: np.ndarray) -> np.ndarray:
        return mixed((places.astype(np.uint64) + _U(1)) * _U(self.place_key))

    def _factors(self, length: int) -> np.ndarray:
        return mixed(np.arange(1, length + 1, dtype=np.uint64) * _U(self.step_key)) | _U(1)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of each of the words data[start:end], none of which is empty."""
        if not len(starts):
            return np.empty(0, np.uint64)
        padded = np.concatenate([data, np.zeros(CHUNK, np.uint8)])
        at_byte = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each byte on
        lengths = ends - starts
        total = mixed((at_byte[starts] & _FIRST_BYTES[np.minimum(lengths, CHUNK)]) ^ self._keys(np.zeros(1, np.int64)))
        long = np.flatnonzero(lengths > CHUNK)
        if len(long):
            chunks = (lengths[long] - 1) // CHUNK
            first = np.cumsum(chunks) - chunks
            place = np.arange(int(chunks.sum()), dtype=np.int64) - np.repeat(first, chunks) + 1
            at = np.repeat(starts[long], chunks) + CHUNK * place
            rest = np.minimum(np.repeat(ends[long], chunks) - at, CHUNK)
            total[long] += np.add.reduceat(mixed((at_byte[at] & _FIRST_BYTES[rest]) ^ self._keys(place)), first)
        return mixed(total ^ lengths.astype(np.uint64) * _U(self.length_key))

    def runs(self, words: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all runs of ``length`` consecutive word hashes, by their first word."""
        count = max(0, len(words) - length + 1)
        total = np.zeros(count, np.uint64)
        for i, factor in enumerate(self._factors(length)):
            total += words[i : i + count] * factor
        return mixed(total)

    def whole(self, words: np.ndarray) -> int:
        """Hash of a whole sequence, different from that of a run."""
        total = (words * self._factors(len(words))).sum(dtype=np.uint64) if len(words) else _U(0)
        return int(mixed(np.array([total ^ _U(len(words) * self.whole_key & (1 << 64) - 1)]))[0])


FIRST, SECOND = Family(11), Family(23)


@dataclass
class Block:
    """Words of consecutive documents. Document i (of all rows: first + i) has words bounds[i] to bounds[i + 1] - 1; word
    j is data[starts[j]:ends[j]]."""

    first: int
    data: np.ndarray
    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def hashes(self, family: Family, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word; ``lower`` takes A-Z as a-z."""
        return family.words(_LOWER[self.data] if lower else self.data, self.starts, self.ends)


def blocks(texts: pa.Array) -> Iterator[Block]:
    """The words of a column of texts (null: none), block by block, in the order of rows."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK_BYTES, "right")) - 1)
        edges = offsets[row : last + 1] - offsets[row]
        piece = data[offsets[row] : offsets[last]]
        solid = ~_GAP[piece]
        opens = solid.copy()
        opens[1:] &= ~solid[:-1]
        inner = edges[:-1][edges[:-1] < len(piece)]
        opens[inner] = solid[inner]  # a document's first byte opens a word even after another's last word
        closes = solid.copy()
        closes[:-1] &= ~solid[1:] | opens[1:]
        starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        yield Block(row, piece, np.searchsorted(starts, edges), starts, ends)
        row = last
