"""Arrow batches of texts as numpy arrays of words."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are handled together; one longer text is handled alone.
BYTES = 2_000_000
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class Words(NamedTuple):
    """Words of consecutive documents: distinct words, the index of each word among them, and where each document starts and the last ends."""

    distinct: list[str]
    ids: np.ndarray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def docs(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)


class Keyed(NamedTuple):
    """Words of consecutive documents: the hashes of the distinct words, the index of each word among them, and where each document starts and the last ends."""

    keys: np.ndarray
    ids: np.ndarray
    starts: np.ndarray


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about BYTES of text each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
    at = 0
    for end in [*(np.flatnonzero(np.diff(np.cumsum(sizes) // BYTES)) + 1), batch.num_rows]:
        if end > at:
            yield batch.slice(at, end - at)
            at = end
    release()


def texts(batch: pa.RecordBatch, text: str) -> pa.Array:
    """The text column with null as empty."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(text)), "")


def split(column: pa.Array) -> Words:
    """Maximal runs without white space, as they stand."""
    lists = pc.utf8_split_whitespace(column)
    coded = lists.flatten().dictionary_encode()
    ids, distinct = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return only(Words(distinct, ids, starts), np.fromiter(map(bool, distinct), bool, len(distinct)))


def only(words: Words, keep: np.ndarray) -> Words:
    """The words whose distinct index is marked."""
    if keep.all():
        return words
    stays = keep[words.ids] if len(words.ids) else np.zeros(0, bool)
    starts = np.concatenate([[0], np.cumsum(stays)])[words.starts]
    renumbered = np.cumsum(keep) - 1
    return Words([w for w, k in zip(words.distinct, keep, strict=True) if k], renumbered[words.ids[stays]], starts.astype(np.int64))


def bare(word: str) -> str:
    """Lower case without what isn't a letter or digit at both ends."""
    plain = word.lower().strip(MARKS)
    return plain if not plain or plain[0].isalnum() and plain[-1].isalnum() else EDGE.sub("", plain)


def lines(held: pa.Array) -> pa.Scalar:
    """All strings of an array as one, with a line break between them: cheaper to take apart in Python than the array."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held), pa.scalar("\n", held.type))[0]


def bared(held: pa.Array) -> pa.Array:
    """``bare`` of each word; those of printable ASCII, which are most, are handled together."""
    plain = pc.ascii_is_printable(held)
    rest = held.filter(pc.invert(plain))
    low = lines(rest).as_py().lower().split("\n")  # a line break ends a word for lower() as the string's end does
    if len(low) == len(rest):
        other = [w if not w or w[0].isalnum() and w[-1].isalnum() else EDGE.sub("", w) for w in (w.strip(MARKS) for w in low)]
    else:  # none, or some hold line breaks
        other = [bare(w) for w in rest.to_pylist()]
    return pc.replace_with_mask(pc.ascii_trim(pc.ascii_lower(held), characters=MARKS), pc.invert(plain), pa.array(other, pa.string()))


def normal(words: Words) -> Words:
    """Words in lower case and without surrounding punctuation; what is punctuation only goes."""
    return _merged(pa.array(words.distinct, pa.string()), words.ids, words.starts)


def normalised(column: pa.Array) -> Words:
    """``normal`` of ``split``, without a list of the words as they stand."""
    lists = pc.utf8_split_whitespace(column)
    coded = lists.flatten().dictionary_encode()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    return _merged(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), starts)


def keyed(column: pa.Array) -> Keyed:
    """The words of ``normalised`` by their ``hashes``, without a list of them."""
    lists = pc.utf8_split_whitespace(column)
    coded = lists.flatten().dictionary_encode()
    bare = bared(coded.dictionary).dictionary_encode()
    found = lines(bare.dictionary).as_buffer().to_pybytes().split(b"\n") if len(bare.dictionary) else []
    keys = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    ids = bare.indices.to_numpy(zero_copy_only=False)[coded.indices.to_numpy(zero_copy_only=False)]
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    empty = pc.index(bare.dictionary, pa.scalar("", bare.dictionary.type)).as_py()
    if empty >= 0:
        stays = ids != empty
        starts = np.concatenate([[0], np.cumsum(stays)])[starts]
        ids = ids[stays]
        ids -= ids > empty
        keys = np.delete(keys, empty)
    return Keyed(keys, ids, starts)


def _merged(distinct: pa.Array, ids: np.ndarray, starts: np.ndarray) -> Words:
    """Words whose bare forms are equal as one; empty ones go."""
    coded = bared(distinct).dictionary_encode()
    found, to = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    merged = Words(found, to[ids] if len(ids) else ids.astype(np.int64), starts)
    return only(merged, np.fromiter(map(bool, found), bool, len(found))) if "" in found else merged


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashes(distinct: list[str]) -> np.ndarray:
    """64-bit hashes of strings, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))


def release() -> None:
    """Give freed memory back to the system: Python workers wait between tasks, and others need it meanwhile."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def per_document(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of values (along the first axis) over each document."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[starts[1:]] - total[starts[:-1]]
