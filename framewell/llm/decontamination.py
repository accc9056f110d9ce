"""Benchmark passages in documents, by CGK embedding, bit-sampling hashing and exact edit distance.

Items and texts are sequences of words (lower case, without surrounding
punctuation). For each item a document is looked at in windows of as many
words, and in shorter ones at its end that lack no more words than may be edited. A CGK embedding walks along a window with random steps of 0 or 1 that
depend on the word under it; it maps a small edit distance to a small Hamming
distance. ``WALKS`` walks are drawn; in each, ``PICKS`` random places of the
embedding name a bucket, and a window that shares a bucket with an item of its
size is a candidate. The Hamming distance grows faster than the edits, so items of more than
``SECTION`` words are embedded in sections of at most so many: of edits within
the limit for the whole, one section at least has no more than within its own
limit, so recall doesn't fall with an item's size. Sections are looked for where
windows of the item's size pass. Candidates are verified: the item's edit distance to a
stretch of text there, in words, must be at most ``EDITS`` of its
length.

Before it is embedded, a window must hold enough words, and enough different
words, that items of its size have: within that edit distance, all but so many
of its words are the item's, so nothing is lost, and few windows remain.

Cases: null and empty texts hold nothing; items without words are held
nowhere; items that are too short for an edit must occur as they are; copies of
an item are found each; repeated rows get the same result; an empty table, of
documents or items, gives no findings; other columns pass unchanged, of any
name but the one added. Items are broadcast in blocks of ``BLOCK`` bytes at
most, each block with a pass of its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.llm import words

#: Allowed edits as a share of an item's words. With 24 walks of 3 picks a window whose embedding differs in 0.3 of its places is missed with a probability of 0.00005.
EDITS, WALKS, PICKS, SEED = 0.2, 24, 3, 7
#: Words of an item that are embedded together at most.
SECTION = 20
#: Bytes of item text that are broadcast together.
BLOCK = 16_000_000
FOUND = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("distance", T.IntegerType())])


def embed(tokens: np.ndarray, starts: np.ndarray, held: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Bucket names (walks x windows) of the windows of ``held`` tokens each at ``starts``: hashes of each CGK walk's words at its row of ``places``."""
    walks = np.arange(1, len(places) + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    at = np.zeros((len(places), len(starts)), np.int64)
    names = np.broadcast_to(walks, at.shape).copy()
    for step in range(int(places.max()) + 1):
        under = np.where(at < held, tokens[starts + np.minimum(at, held - 1)], np.uint64(0))
        here = (places == step).any(axis=1)
        if here.any():
            names[here] = words.mix(names[here] ^ under[here]) + np.uint64(step)
        at += ((words.mix(under ^ (walks + np.uint64((step + 1) * 0xD6E8FEB86659FD93 & (2**64 - 1)))) >> np.uint64(33)) & np.uint64(1)).astype(np.int64)
    return names


def sections(size: int) -> list[tuple[int, int]]:
    """First word and number of words of each section of an item of so many words."""
    cuts = np.linspace(0, size, -(-size // SECTION) + 1).astype(int).tolist()
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def varied(tokens: np.ndarray, known: np.ndarray, starts: np.ndarray, stops: np.ndarray, size: int, least: int) -> np.ndarray:
    """The windows of ``size`` words, or up to their stop, with at least so many different known words."""
    at = starts[:, None] + np.arange(size)
    inside, at = at < stops[:, None], np.minimum(at, len(tokens) - 1)
    held = np.where(inside & (known[at] > 0), tokens[at], np.uint64(0))
    held.sort(axis=1)
    return starts[(held[:, 1:] != held[:, :-1]).sum(axis=1) + (held[:, 0] != 0) >= least]


def distance(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance of item to a stretch of text."""
    place = np.arange(len(text) + 1)
    cost = np.zeros(len(text) + 1, np.int64)
    for k, word in enumerate(item, 1):
        row = np.minimum(cost + 1, np.concatenate([[k], cost[:-1] + (text != word)]))
        cost = np.minimum.accumulate(row - place) + place
    return int(cost.min())


def nearest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of item to a stretch of text, and that stretch: the first to end."""
    cost, origin = [0] * (len(text) + 1), list(range(len(text) + 1))
    for k, word in enumerate(item.tolist(), 1):
        row, source = [k], [origin[0]]
        for j, other in enumerate(text.tolist()):
            change, drop, more = cost[j] + (other != word), cost[j + 1] + 1, row[j] + 1
            least = min(change, drop, more)
            row.append(least)
            source.append(origin[j] if change == least else origin[j + 1] if drop == least else source[j])
        cost, origin = row, source
    end = min(range(len(cost)), key=cost.__getitem__)
    return cost[end], origin[end], end


@dataclass
class Index:
    """Items by their size: ids, words, the words that any of them has, and buckets of each walk in each section."""

    ids: list[int]
    items: list[np.ndarray]
    sizes: dict[int, list[int]] = field(default_factory=lambda: defaultdict(list))
    vocabulary: dict[str, int] = field(default_factory=dict)
    places: dict[int, np.ndarray] = field(default_factory=dict)
    held: dict[tuple[int, int, int], dict[int, list[int]]] = field(default_factory=dict)

    def find(self, found: words.Words) -> list[list[tuple[int, int, int, int]]]:
        """For each document (item, first word, word after the last, distance), by place."""
        tokens = words.hashes(found.distinct)[found.ids] if len(found.ids) else np.zeros(0, np.uint64)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in range(len(found.starts) - 1)]
        sizes = sorted(self.sizes)
        get = self.vocabulary.get
        masks = [get(w, 0) for w in found.distinct]
        cuts = [0]  # documents that are looked at together, so that their marks stay in the processor's cache
        for k, end in enumerate(found.starts[1:], 1):
            if end - found.starts[cuts[-1]] > 100_000:
                cuts.append(k)
        cuts.append(len(found.starts) - 1)
        for low in range(0, len(sizes), 63):
            mask = np.fromiter(((m >> low) & (2**63 - 1) for m in masks), np.int64, len(masks))
            starts: dict[int, list[np.ndarray]] = defaultdict(list)
            for first, last in zip(cuts[:-1], cuts[1:], strict=True):
                self.gate(found.starts[first : last + 1], tokens, mask[found.ids[found.starts[first] : found.starts[last]]] if len(masks) else mask, sizes[low : low + 63], starts)
            for size, own in starts.items():
                self.windows(found, tokens, size, np.concatenate(own), out)
        for rows in out:
            rows.sort(key=lambda r: (r[1], r[0]))
        return out

    def gate(self, ends: np.ndarray, tokens: np.ndarray, mask: np.ndarray, sizes: list[int], starts: dict[int, list[np.ndarray]]) -> None:
        """Add the windows of some documents that hold enough words of each size's items."""
        tokens = tokens[ends[0] : ends[-1]]
        last = np.repeat(ends[1:] - ends[0], np.diff(ends))
        sums = np.zeros(len(mask) + 1, np.int32)
        for bit, size in enumerate(sizes):
            if len(tokens) < size - int(EDITS * size):
                continue
            known = ((mask >> bit) & 1).astype(np.int8)
            np.cumsum(known, out=sums[1:])
            stop = np.minimum(np.arange(len(tokens)) + size, last)
            some = np.flatnonzero(sums[stop] - sums[:-1] >= size - int(EDITS * size))
            least = min(len(np.unique(self.items[k])) for k in self.sizes[size]) - int(EDITS * size)
            for k in range(0, len(some), 20_000):
                kept = varied(tokens, known, some[k : k + 20_000], stop[some[k : k + 20_000]], size, least)
                if len(kept):
                    starts[size].append(kept + ends[0])

    def windows(self, found: words.Words, tokens: np.ndarray, size: int, starts: np.ndarray, out: list) -> None:
        """Add the occurrences of the items of one size at the windows given."""
        met: dict[tuple[int, int], list[int]] = defaultdict(list)
        for first, some in sections(size):
            own = starts if some == size else self.around(found, starts, size, first, some)
            docs = np.searchsorted(found.starts, own, side="right") - 1
            lengths = np.minimum(some, found.starts[docs + 1] - own)
            for at in range(0, len(own), 10_000):
                for walk, names in enumerate(embed(tokens, own[at : at + 10_000], lengths[at : at + 10_000], self.places[some])):
                    held = self.held[size, first, walk]
                    for k in np.flatnonzero(np.isin(names, np.fromiter(held, np.uint64, len(held)))):
                        for item in held[int(names[k])]:
                            met[int(docs[at + k]), item].append(int(own[at + k]) - first)
        for (doc, item), places in met.items():
            self.verify(tokens, found.starts[doc], found.starts[doc + 1], item, sorted(set(places)), out[doc])

    def around(self, found: words.Words, starts: np.ndarray, size: int, first: int, some: int) -> np.ndarray:
        """Where a section may start, in texts whose windows of the item's size do at ``starts``."""
        most, docs = int(EDITS * size), np.searchsorted(found.starts, starts, side="right") - 1
        low = np.maximum(starts + first - most, found.starts[docs])
        high = np.minimum(starts + first + most, found.starts[docs + 1] - max(1, some - int(EDITS * some)))
        marks = np.zeros(int(found.starts[-1]) + 2, np.int32)
        np.add.at(marks, low[high >= low], 1)
        np.add.at(marks, high[high >= low] + 1, -1)
        return np.flatnonzero(np.cumsum(marks))

    def verify(self, tokens: np.ndarray, first: int, last: int, item: int, places: list[int], out: list) -> None:
        """Append the item's occurrences at the candidate places, which do not overlap; in each run of places the exact or else the nearest first, then those before and after it."""
        own = self.items[item]
        most, size, done = int(EDITS * len(own)), len(own), first
        runs: list[list[int]] = []
        for p in places:
            if runs and p - runs[-1][-1] <= max(1, most) and p - runs[-1][0] <= size // 2:
                runs[-1].append(p)
            else:
                runs.append([p])
        for run, later in zip(runs, [*(r[0] for r in runs[1:]), last + size], strict=True):
            parts = [(max(first, run[0] - most, done), min(last, run[-1] + size + most))]
            while parts:
                low, high = parts.pop()
                if high - low < max(1, size - most):
                    continue
                exact = next((p for p in run if low <= p <= high - size and (tokens[p : p + size] == own).all()), None)
                if exact is not None:
                    a, b, edits = exact, exact + size, 0
                elif distance(own, tokens[low:high]) <= most:
                    edits, a, b = nearest(own, tokens[low:high])
                    a, b = low + a, low + b
                else:
                    continue
                if a > run[-1] + most and a >= later - most:  # the next run's
                    parts.append((low, a))
                    continue
                out.append((item, int(a - first), int(b - first), edits))
                done = max(done, b)
                parts += [(low, a), (b, high)]


def index(items: list[tuple[int, str]]) -> Index:
    """Prepare (item_id, text) pairs."""
    column = pa.array([t or "" for _, t in items], pa.string())
    found = words.normalised(column)
    own = words.hashes(found.distinct)[found.ids] if len(found.ids) else np.zeros(0, np.uint64)
    made = Index([i for i, _ in items], [own[a:b] for a, b in zip(found.starts[:-1], found.starts[1:], strict=True)])
    for k, item in enumerate(made.items):
        if len(item):
            made.sizes[len(item)].append(k)
    bits = {size: 1 << k for k, size in enumerate(sorted(made.sizes))}
    for k, item in enumerate(made.items):
        for i in set(found.ids[found.starts[k] : found.starts[k + 1]].tolist()):
            made.vocabulary[found.distinct[i]] = made.vocabulary.get(found.distinct[i], 0) | bits[len(item)]
    for size, members in made.sizes.items():
        flat = np.concatenate([made.items[k] for k in members])
        for first, some in sections(size):
            if some not in made.places:
                random, reach = np.random.default_rng([SEED, some]), some + (some + 1) // 2  # where few walks are over: the places after hold nothing that tells items apart
                made.places[some] = np.array([np.sort(random.choice(reach, min(PICKS, reach), replace=False)) for _ in range(WALKS)])
            starts = np.arange(len(members)) * size + first
            for walk, names in enumerate(embed(flat, starts, np.full(len(starts), some), made.places[some])):
                held: dict[int, list[int]] = defaultdict(list)
                for k, name in zip(members, names.tolist(), strict=True):
                    held[name].append(k)
                made.held[size, first, walk] = dict(held)
    return made


def offsets(text: str, raw: list[str]) -> list[tuple[int, int]]:
    """Code point offsets of the words that have a normal form."""
    out, at = [], 0
    for w in raw:
        at = text.index(w, at)
        if words.bare(w):
            out.append((at, at + len(w)))
        at += len(w)
    return out


def _found(docs: DataFrame, made: Index, text: str, out: str) -> DataFrame:
    rest = [f for f in docs.schema.fields if f.name != out]
    names = [f.name for f in rest]
    shared = docs.sparkSession.sparkContext.broadcast(made)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("distance", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shared.value
        for batch in batches:
            for some in words.slices(batch, text):
                column = words.texts(some, text)
                raw = words.split(column)
                rows: list[list[dict]] = []
                for k, found in enumerate(made.find(words.normal(raw))):
                    where = offsets(column[k].as_py(), [raw.distinct[i] for i in raw.ids[raw.starts[k] : raw.starts[k + 1]]]) if found else []
                    rows.append([{"item_id": made.ids[i], "start": where[a][0], "end": where[b - 1][1], "distance": d} for i, a, b, d in found])
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in names), pa.array(rows, kind)], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(out, T.ArrayType(FOUND))]))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", out: str = "leaks", item_id: str = "item_id", item: str = "text") -> DataFrame:
    """Documents with an array of the items that their text holds: item_id, start and end in code points, distance in words."""
    given = items.select(F.col(item_id).cast("long").alias("i"), F.col(item).alias("t")).where("t is not null")
    blocks = int((given.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // BLOCK) + 1
    found = docs
    for k in range(blocks):
        block = given.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k) if blocks > 1 else given
        made = index([(r["i"], r["t"]) for r in block.orderBy("i", "t").collect()])
        if k == 0:
            found = _found(found, made, text, out)
        else:
            found = _found(found, made, text, "_more").withColumn(out, F.concat(out, "_more")).drop("_more")
    return found


def clean(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no item."""
    columns = [c for c in docs.columns if c != "leaks"]
    marked = leaks(docs.select(F.struct(*docs.columns).alias("_row"), F.col(text).alias("_text")), items, text="_text")
    kept = marked.where(F.size("leaks") == 0)
    return kept.select(*(F.col("_row").getField(c).alias(c) for c in [*columns, *(["leaks"] if "leaks" in docs.columns else [])]))
