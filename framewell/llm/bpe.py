"""Byte-pair encoding and decoding by depth-first traversal of a prefix trie.

Distinct words are sorted as bytes, which is their trie in preorder. For every
trie node (a prefix of some word) one state is kept: the last token of the
prefix's encoding. A prefix is encoded by the one vocabulary token that ends it
and is *stable* after the last token of what stands before, so a state follows
from states above it, and what words share is encoded once. Which tokens end at
a prefix is told by an automaton over the tokens' bytes, whose state is kept
beside it. A word's tokens are read back from its node to the root.

Two neighbouring tokens are stable if encoding their joined bytes gives just
these two tokens. That is decided by undoing merges at their boundary, latest
first, and asking at each step if the pair then adjacent would have merged.

Cases: null text counts as empty; empty text has no tokens; repeated rows are
encoded each by itself; an empty table gives an empty result; a column whose
name an output takes is replaced, other columns pass unchanged. Texts of any
length are encoded whole; memory is bounded by the text of ``ROWS`` rows or
one row and by ``CACHE`` words, whose encodings a Python worker keeps.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from framewell.llm.words import release

#: Rows and characters encoded together, and words whose encodings a Python worker keeps.
ROWS, CHARS, CACHE = 512, 1_000_000, 300_000
#: Fixed value: the pre-tokenizer of byte-level BPE.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A token that no merge consumes or makes.
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A vocabulary with its merges, and encodings of words by trie traversal."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, pre = spec["model"], spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or model.get("ignore_merges"):
            raise ValueError("only plain byte-level BPE vocabularies are understood")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("only literal added tokens are understood")
        of = byte_alphabet()
        self.bytes = {i: bytes(of[c] for c in s) for s, i in model["vocab"].items()}
        self.id = {b: i for i, b in self.bytes.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        vocab = model["vocab"]
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.rank[vocab[a], vocab[b]] = r
            self.parts.setdefault(vocab[a + b], (r, vocab[a], vocab[b]))
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pattern = regex.compile(WORD)
        text = self.bytes | {i: s.encode() for s, i in self.added.items()}
        self.text = [text.get(i, b"") for i in range(max(text) + 1)]
        self.pairs: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        #: Tokens that their own bytes encode to; no other token is ever made.
        self.made = {b: i for b, i in self.id.items() if self.reachable(i)}
        self.automaton()
        self.forget()

    def automaton(self) -> None:
        """States that know, after any bytes, which tokens end there: prefixes of tokens, linked to their longest proper suffix that is one."""
        self.edges: dict[int, int] = {}  # state << 8 | byte: state
        self.found: dict[int, int] = {}  # as edges, for bytes that lead back to a shorter prefix
        own, self.fail, queue = {}, [0], []
        for word, t in self.made.items():
            at = 0
            for b in word:
                key = at << 8 | b
                to = self.edges.get(key)
                if to is None:
                    to = self.edges[key] = len(self.fail)
                    self.fail.append(0)
                at = to
            own[at] = t
        below: list[list[tuple[int, int]]] = [[] for _ in self.fail]
        for key, to in self.edges.items():
            below[key >> 8].append((key & 255, to))
        self.suffixes: list[tuple[int, ...]] = [()] * len(self.fail)  # tokens that end at a state, longest first
        queue.append(0)
        for at in queue:
            for b, to in below[at]:
                self.fail[to] = self.back(self.fail[at], b) if at else 0
                shorter = self.suffixes[self.fail[to]]
                self.suffixes[to] = (own[to], *shorter) if to in own else shorter
                queue.append(to)
        self.size = {t: len(word) for word, t in self.made.items()}

    def back(self, at: int, b: int) -> int:
        """The state after one more byte."""
        while True:
            to = self.edges.get(at << 8 | b)
            if to is not None or not at:
                return to or 0
            at = self.fail[at]

    def forget(self) -> None:
        """Empty the cache of words: the row of each word, and the rows' tokens one after the other."""
        self.rows: dict[str, int] = {}
        self.tokens, self.ends = array("i"), array("q", [0])
        if self.added:
            for s, i in self.added.items():
                self.keep(s, [i])

    def keep(self, word: str, ids: list[int]) -> None:
        self.rows[word] = len(self.rows)
        self.tokens.extend(ids)
        self.ends.append(len(self.tokens))

    def apart(self, a: int, b: int, inner: int = NEVER) -> bool:
        """Whether no merge ever spans the boundary of a and b before the one of rank ``inner``."""
        left = right = inner  # rank at which the token beside the boundary is consumed
        first = inner != NEVER
        rank, parts = self.rank, self.parts
        while True:
            r = rank.get((a, b))
            if r is not None and not first and r < left and r <= right:
                return False
            first = False
            made_a, made_b = parts.get(a), parts.get(b)
            if made_a and (not made_b or made_a[0] > made_b[0]):
                left, a = made_a[0], made_a[2]
            elif made_b:
                right, b = made_b[0], made_b[1]
            else:
                return True

    def reachable(self, t: int) -> bool:
        """Whether a token's own bytes encode to it."""
        known = self.whole.get(t)
        if known is None:
            made = self.parts.get(t)
            known = self.whole[t] = not made or self.reachable(made[1]) and self.reachable(made[2]) and self.apart(made[1], made[2], made[0])
        return known

    def traverse(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Encodings of sorted words, each prefix shared with the word before being kept."""
        edges, found, suffixes, size, pairs = self.edges, self.found, self.suffixes, self.size, self.pairs
        for held in (pairs, found):
            if len(held) > 300_000:
                held.clear()
        last: list[int] = [-1]  # last[i]: last token of the first i bytes
        states = [0]  # states[i]: state after the first i bytes
        before = b""
        for word in words:
            n, keep = len(word), 0
            for x, y in zip(before, word):  # noqa: B905
                if x != y:
                    break
                keep += 1
            del last[keep + 1 :], states[keep + 1 :]
            at = states[keep]
            for i in range(keep + 1, n + 1):
                key = at << 8 | word[i - 1]
                to = edges.get(key)
                if to is None:
                    to = found.get(key)
                    if to is None:
                        to = found[key] = self.back(at, word[i - 1])
                at = to
                states.append(at)
                for t in suffixes[at]:
                    j = i - size[t]
                    if not j:
                        break
                    pair = (last[j], t)
                    fits = pairs.get(pair)
                    if fits is None:
                        fits = pairs[pair] = self.apart(*pair)
                    if fits:
                        break
                last.append(t)
            before, out, i = word, [], n
            while i:
                t = last[i]
                out.append(t)
                i -= size[t]
            out.reverse()
            yield out

    def learn(self, words: set[str]) -> None:
        """Add the encodings of words to the cache. Code point order is the order of UTF-8 bytes."""
        if len(self.rows) + len(words) > CACHE:
            self.forget()
        new = sorted(w for w in words if w not in self.rows)
        for w, ids in zip(new, self.traverse(w.encode() for w in new), strict=True):
            self.keep(w, ids)

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after the other, and where each text's start and the last end; distinct words go through one traversal."""
        split, find, added = self.specials, self.pattern.findall, self.added
        pieces = []
        for x in texts:
            x = x or ""
            if split and any(s in x for s in added):
                pieces.append([w for p in split.split(x) for w in ([p] if p in added else find(p))])
            else:
                pieces.append(find(x))
        self.learn(set(chain.from_iterable(pieces)))
        n_words = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rows = np.fromiter(map(self.rows.__getitem__, chain.from_iterable(pieces)), np.int64, n_words.sum())
        ends = np.array(self.ends)
        sizes = (ends[1:] - ends[:-1])[rows]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        ids = np.array(self.tokens, np.int32)[np.repeat(ends[rows] - starts[:-1], sizes) + np.arange(starts[-1])]
        return ids, starts[np.concatenate([[0], np.cumsum(n_words)])]

    def decode_batch(self, ids: np.ndarray, starts: np.ndarray) -> list[str]:
        """Texts of token ids; bytes that are no UTF-8 become U+FFFD, ids that are no tokens vanish."""
        text = self.text
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(text):
            text = dict(enumerate(text)) | {int(i): b"" for i in ids if not 0 <= i < len(text)}
        flat = list(map(text.__getitem__, ids.tolist()))
        return [b"".join(flat[a:b]).decode("utf-8", errors="replace") for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Bpe:
    """The vocabulary at ``path``, read once in each Python process."""
    return Bpe(path)


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Start and texts of consecutive rows, at most ROWS and about CHARS characters together."""
    start, held, size = 0, [], 0
    for k in range(len(column)):
        x = column[k].as_py()
        held.append(x)
        size += len(x or "")
        if len(held) >= ROWS or size >= CHARS:
            yield start, held
            start, held, size = k + 1, [], 0
    if held:
        yield start, held


def _with(schema: T.StructType, **new: T.DataType) -> T.StructType:
    return T.StructType([f for f in schema.fields if f.name not in new] + [T.StructField(k, v) for k, v in new.items()])


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens", decoded: str | None = None) -> DataFrame:
    """Add the token ids of ``text``, their count and, if a name is given, their decoding.

    ``path`` is a tokenizer file that executors can read, too.
    """
    new: dict[str, T.DataType] = {ids: T.ArrayType(T.IntegerType(), False), count: T.LongType()} | ({decoded: T.StringType()} if decoded else {})
    rest = [f.name for f in df.schema.fields if f.name not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            for start, texts in chunks(batch.column(batch.schema.get_field_index(text))):
                found, starts = bpe.encode_batch(texts)
                columns = [batch.column(batch.schema.get_field_index(c)).slice(start, len(texts)) for c in rest]
                columns += [pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(found, pa.int32())), pa.array(np.diff(starts), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(bpe.decode_batch(found, starts), pa.string())] if decoded else []), names=rest + list(new))
        release()

    return df.mapInArrow(run, _with(df.schema, **new))


def decode(df: DataFrame, path: str, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of token ids (null ids: empty text)."""
    rest = [f.name for f in df.schema.fields if f.name != decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary(path)
        for batch in batches:
            columns = {c: batch.column(k) for k, c in enumerate(batch.schema.names)}
            given = pc.fill_null(columns[ids], [])
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(given).to_numpy(zero_copy_only=False))])
            texts = bpe.decode_batch(given.flatten().to_numpy(zero_copy_only=False), starts)
            yield pa.RecordBatch.from_arrays([columns[c] for c in rest] + [pa.array(texts, pa.string())], names=[*rest, decoded])

    return df.mapInArrow(run, _with(df.schema, **{decoded: T.StringType()}))
