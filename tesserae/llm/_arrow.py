"""Arrow and numpy helpers that the free-style operators share: cutting texts, memoised encoding, ragged gathers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

try:
    _TRIM = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _TRIM = None

#: Bytes of text handled at a time within a batch; one longer text is a slice of its own.
SLICE_BYTES = 4_000_000
#: Strings kept in a task's memo before it starts afresh.
MEMO_ITEMS = 300_000
#: Most bytes of a memo's strings, unless those of one slice alone are more.
MEMO_BYTES = 64_000_000
#: Strings whose lists are made at a time, as objects of a tokenizer take far more than its ids.
MAKE_ITEMS = 4096


def slices(batch: pa.RecordBatch, column: int, size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `size` (SLICE_BYTES) bytes of the given string column; freed memory goes back at its end."""
    n = batch.num_rows
    if not n:
        return
    offsets = text_offsets(batch.column(column))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (size or SLICE_BYTES), side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Give freed memory back to the system: workers live on, and what one operator held would add to the next one's."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_offsets(texts: pa.Array) -> np.ndarray:
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    return np.frombuffer(texts.buffers()[1], kind, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts end to end, and each text's bounds within them; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    offsets = text_offsets(texts)
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return flat, offsets - offsets[0]


def cut(flat: np.ndarray, offsets: np.ndarray, marks: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Chunks that begin at each mark and at each text's start, and each text's bounds in the list of chunks."""
    marks = marks.copy()
    inner = offsets[offsets < len(flat)]
    marks[inner] = True
    bounds = np.append(np.flatnonzero(marks), len(flat))
    chunks = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])
    return chunks, np.searchsorted(bounds, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the runs [start, start + length), one run after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Memo:
    """Integer lists of strings, each made once while it stays in a bounded memo; strings are one array, not objects."""

    def __init__(self, make, items: int = MEMO_ITEMS, size: int = MEMO_BYTES):
        self.make, self.items, self.size = make, items, size
        self.clear()

    def clear(self) -> None:
        self.place: pa.Array | None = None  # the strings, in the order of their lists
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def get(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The lists of all chunks end to end, and the bounds of each chunk's list."""
        coded = chunks.dictionary_encode()
        words = coded.dictionary
        at = self._find(words)
        new = words.filter(pa.array(at < 0))
        if self.place is not None and (len(self.place) + len(new) > self.items or self.place.nbytes + new.nbytes > self.size):
            self.clear()
            at, new = self._find(words), words
        if len(new):
            at[at < 0] = len(self.ends) - 1 + np.arange(len(new))
            flat, lengths = [self.flat], []
            for k in range(0, len(new), MAKE_ITEMS):
                lists = self.make(new.slice(k, MAKE_ITEMS).to_pylist())
                lengths.append(np.fromiter(map(len, lists), np.int64, len(lists)))
                flat.append(np.fromiter((x for y in lists for x in y), np.int32, int(lengths[-1].sum())))
            self.flat = np.concatenate(flat)
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.concatenate(lengths))])
            self.place = new if self.place is None else pa.concat_arrays([self.place, new])
        at = at[coded.indices.to_numpy()] if len(words) else at
        starts, lengths = self.ends[at], self.ends[at + 1] - self.ends[at]
        return self.flat[ragged(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])

    def _find(self, words: pa.Array) -> np.ndarray:
        """Places of the words in the memo, -1 for the others."""
        if self.place is None:
            return np.full(len(words), -1, np.int64)
        return pc.index_in(words, value_set=self.place).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


_BYTE = np.arange(256)
_ASCII_BLANK = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_ASCII_SOLID = (_BYTE > 32) & (_BYTE < 127)
_LETTER_OR_DIGIT = np.isin(_BYTE, np.frombuffer(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
_PUNCTUATION = _ASCII_SOLID & ~_LETTER_OR_DIGIT
_TWO_BYTE_LEAD = (_BYTE >= 0xC3) & (_BYTE <= 0xDF)


def before_punctuation(flat: np.ndarray) -> np.ndarray:
    """Places of ASCII punctuation right after an ASCII letter or digit, or a Latin letter of two bytes (U+00C0 to U+017F)."""
    marks = np.zeros(len(flat), bool)
    if len(flat) > 2:
        prev, lead = flat[:-1], np.concatenate([[0], flat[:-2]])
        latin = (lead == 0xC3) & (prev >= 0x80) & (prev != 0x97) & (prev != 0xB7) | ((lead == 0xC4) | (lead == 0xC5)) & (prev >= 0x80)
        marks[1:] = _PUNCTUATION[flat[1:]] & (_LETTER_OR_DIGIT[prev] | latin)
    return marks


def single_spaces(flat: np.ndarray) -> np.ndarray:
    """Places of a space between two characters that surely are no white space of any kind."""
    marks = np.zeros(len(flat), bool)
    if len(flat) > 3:
        prev, after, lead = flat[:-2], flat[2:], np.concatenate([[0], flat[:-3]])
        solid_before = _ASCII_SOLID[prev] | (_TWO_BYTE_LEAD[lead] & (prev >= 0x80))
        marks[1:-1] = (flat[1:-1] == 32) & solid_before & (_ASCII_SOLID[after] | _TWO_BYTE_LEAD[after])
    return marks


def blanks(flat: np.ndarray) -> np.ndarray:
    return _ASCII_BLANK[flat]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All runs of bytes other than ASCII blanks, and each text's bounds among them."""
    flat, offsets = text_bytes(texts)
    solid = ~blanks(flat)
    first = np.zeros(len(flat), bool)
    first[offsets[offsets < len(flat)]] = True
    starts = np.flatnonzero(solid & (first | ~np.concatenate([[False], solid[:-1]]))) if len(flat) else np.empty(0, np.int64)
    ends = np.flatnonzero(solid & np.concatenate([first[1:] | ~solid[1:], [True]])) + 1 if len(flat) else starts
    bounds = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    found = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(flat[solid]))])
    return found, np.searchsorted(starts, offsets)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words with A-Z in lower case, and each text's bounds among them."""
    found, at = words(texts)
    coded = pc.ascii_lower(found.view(pa.string())).view(pa.binary()).dictionary_encode()
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return (hashed[coded.indices.to_numpy()] if len(hashed) else hashed), at
