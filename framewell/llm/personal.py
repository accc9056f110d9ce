"""Personal data: rules for four kinds, and a character tagger that adds what rules miss.

The rules find e-mail addresses, IP addresses, card and phone numbers. The
tagger is a bidirectional LSTM over characters with transition scores between
tags (a conditional random field on top), all in numpy. It learns from labelled
spans: what the rules find in a sample of the corpus, the same spans written in
other ways (``name at host dot com``, grouped or bare phone numbers and cards), and
look-alikes that are no personal data. Any span has a digit, an ``@`` or a
spelled-out ``at``, so only windows around these are decoded. Windows overlap;
of each, the best path is decoded, and spans are reconciled over the text:
those that touch a window's inner edge are left to the next window, overlapping ones go
to the more certain, and rule spans stay as they are.

Cases: null and empty texts have no spans; repeated rows get the same result;
an empty table gives an empty result; other columns pass unchanged, of any name
but those added. Texts are read whole. Without any rule span in the sample the
tagger learns from made-up ones.
"""

from __future__ import annotations

import re
from bisect import bisect, bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framewell.llm import words

KINDS = ("email", "ip", "card", "phone")
#: Documents whose rule spans the tagger learns from, at most about.
MOST = 4_000
#: Characters in a window, how many of them its neighbour has too (two more than the longest span that is sought), hidden units a direction, epochs, windows that are trained on at once.
WINDOW, SHARED, HIDDEN, EPOCHS, BATCH, SEED = 96, 66, 24, 6, 64, 3
#: Least confidence of an added span.
SURE = 0.5
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

#: Possessive and anchored forms of the rules, which no text makes slow: a run of digits that fails from its start fails from within.
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]+|(?<=[A-Za-z0-9])[ \[(]+[aA][tT][ \])]+(?=[A-Za-z0-9])", re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (2 if k % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost spans of a local part, @ and a host with a dot; the local part is the whole run before its @."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = HOST.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def rules(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what the rules find, by start and then kind."""
    found = []
    if "@" in text:
        found += [(*span, "email") for span in emails(text)]
    if "." in text:
        found += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        own = digits(m[0]) if m.end() - m.start() >= 14 else ""
        if 14 <= len(own) <= 19 and luhn(own):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def codes(text: str) -> np.ndarray:
    """Class of each character: ASCII as it stands, other letters, other."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    kinds = np.minimum(points, 129).astype(np.int64)
    for k in np.flatnonzero(kinds >= 128):
        kinds[k] = 128 if text[k].isalpha() else 129
    return kinds


SYMBOLS = 131  # and padding


@dataclass
class Tagger:
    """Weights: for each direction input and recurrent gates, the output layer, transitions."""

    p: dict[str, np.ndarray]

    @staticmethod
    def new() -> Tagger:
        r = np.random.default_rng(SEED)
        p = {}
        for d in "fb":
            p[f"in_{d}"] = r.normal(0, 0.1, (SYMBOLS, 4 * HIDDEN))
            p[f"in_{d}"][:, HIDDEN : 2 * HIDDEN] += 1  # forget little at first
            p[f"re_{d}"] = r.normal(0, 0.5 / np.sqrt(HIDDEN), (HIDDEN, 4 * HIDDEN))
            p[f"out_{d}"] = r.normal(0, 0.3 / np.sqrt(HIDDEN), (HIDDEN, len(TAGS)))
        p["bias"], p["moves"] = np.zeros(len(TAGS)), np.zeros((len(TAGS), len(TAGS)))
        return Tagger({k: v.astype(np.float32) for k, v in p.items()})

    def run(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """Tag scores (batch x length x tags) of a batch of symbols, and what training needs; both directions take their steps together."""
        n, size = x.shape
        both = np.stack([x.T, x.T[::-1]], axis=1)
        gates = np.stack([self.p["in_f"][both[:, 0]], self.p["in_b"][both[:, 1]]], axis=1)
        back = np.stack([self.p["re_f"], self.p["re_b"]])
        all_h, cells = (np.zeros((size + 1, 2, n, HIDDEN), np.float32) for _ in range(2))
        for t in range(size):
            g = gates[t]
            g += all_h[t] @ back
            own = g[..., : 3 * HIDDEN]
            np.exp(-np.clip(own, -30, 30), out=own)
            own += 1
            np.reciprocal(own, out=own)
            np.tanh(g[..., 3 * HIDDEN :], out=g[..., 3 * HIDDEN :])
            cells[t + 1] = g[..., HIDDEN : 2 * HIDDEN] * cells[t] + g[..., :HIDDEN] * g[..., 3 * HIDDEN :]
            all_h[t + 1] = g[..., 2 * HIDDEN : 3 * HIDDEN] * np.tanh(cells[t + 1])
        scores = all_h[1:, 0] @ self.p["out_f"] + all_h[:0:-1, 1] @ self.p["out_b"] + self.p["bias"]
        return np.ascontiguousarray(scores.transpose(1, 0, 2)), (both, gates, all_h, cells) if keep else ()

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-forward, log-backward values and log partition functions of batches of tag scores."""
        n, size, tags = scores.shape
        a, b = np.zeros_like(scores), np.zeros_like(scores)
        m = np.exp(self.p["moves"])
        a[:, 0] = scores[:, 0]
        for t in range(1, size):
            top = a[:, t - 1].max(axis=1, keepdims=True)
            a[:, t] = scores[:, t] + top + np.log(np.exp(a[:, t - 1] - top) @ m + 1e-30)
        for t in range(size - 2, -1, -1):
            x = b[:, t + 1] + scores[:, t + 1]
            top = x.max(axis=1, keepdims=True)
            b[:, t] = top + np.log(np.exp(x - top) @ m.T + 1e-30)
        top = a[:, -1].max(axis=1)
        return a, b, top + np.log(np.exp(a[:, -1] - top[:, None]).sum(axis=1))

    def best(self, scores: np.ndarray) -> np.ndarray:
        """The best path of tags."""
        n, size, _ = scores.shape
        v, back = scores[:, 0], np.zeros((size, n, len(TAGS)), np.int64)
        for t in range(1, size):
            x = v[:, :, None] + self.p["moves"]
            back[t] = x.argmax(axis=1)
            v = x.max(axis=1) + scores[:, t]
        path = np.zeros((n, size), np.int64)
        path[:, -1] = v.argmax(axis=1)
        for t in range(size - 1, 0, -1):
            path[:, t - 1] = back[t][np.arange(n), path[:, t]]
        return path

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of tags y, and its gradient."""
        n, size = x.shape
        scores, held = self.run(x, keep=True)
        a, b, z = self.marginals(scores)
        rows = np.arange(n)[:, None]
        gold = scores[rows, np.arange(size), y].sum() + self.p["moves"][y[:, :-1], y[:, 1:]].sum()
        ds = np.exp(a + b - z[:, None, None])
        ds[rows, np.arange(size), y] -= 1
        ds /= n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["bias"] = ds.sum(axis=(0, 1))
        left = np.exp(a[:, :-1] - a[:, :-1].max(axis=2, keepdims=True))
        right = b[:, 1:] + scores[:, 1:]
        shift = a[:, :-1].max(axis=2) - z[:, None]
        pair = np.einsum("nti,ntj->ij", left, np.exp(np.minimum(right + shift[:, :, None], 60)), optimize=True) * np.exp(self.p["moves"])
        np.subtract.at(pair, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        g["moves"] = (pair / n).astype(np.float32)
        both, gates, all_h, cells = held
        flat = np.ascontiguousarray(ds.transpose(1, 0, 2), np.float32)
        each = flat.reshape(-1, len(TAGS))
        g["out_f"], g["out_b"] = all_h[1:, 0].reshape(-1, HIDDEN).T @ each, all_h[:0:-1, 1].reshape(-1, HIDDEN).T @ each
        told = np.stack([flat @ self.p["out_f"].T, (flat @ self.p["out_b"].T)[::-1]], axis=1)
        back = np.stack([self.p["re_f"].T, self.p["re_b"].T])
        dg = np.empty_like(gates)
        dh, dc = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        for t in range(size - 1, -1, -1):
            i, f, o, z_in = np.split(gates[t], 4, axis=2)
            tc = np.tanh(cells[t + 1])
            dh = dh + told[t]
            dc = dc + dh * o * (1 - tc * tc)
            dg[t] = np.concatenate([dc * z_in * i * (1 - i), dc * cells[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - z_in * z_in)], axis=2)
            dh, dc = dg[t] @ back, dc * f
        for k, d in enumerate("fb"):
            own, symbols = dg[:, k].reshape(-1, 4 * HIDDEN), both[:, k].ravel().astype(np.uint8)
            g[f"re_{d}"] = all_h[:-1, k].reshape(-1, HIDDEN).T @ own
            order = np.argsort(symbols, kind="stable")
            first = np.flatnonzero(np.diff(symbols[order], prepend=255 if symbols[order[0]] != 255 else 0))
            g[f"in_{d}"][symbols[order[first]]] = np.add.reduceat(own[order], first, axis=0)
        return float(z.sum() - gold) / n, g

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        r = np.random.default_rng(SEED)
        first, second, step = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(x))
            for k in range(0, len(x), BATCH):
                _, g = self.gradient(x[order[k : k + BATCH]], y[order[k : k + BATCH]])
                norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
                step += 1
                rate = 0.01 * (0.5 ** max(0, epoch - EPOCHS // 2))
                for name, v in g.items():
                    v = v * min(1.0, 5 / (norm + 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * v
                    second[name] = 0.999 * second[name] + 0.001 * v * v
                    self.p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)


def windows(text: str) -> list[int]:
    """Starts of the windows of which one holds, within its edges, any span of SHARED - 2 characters at most with a trigger in it."""
    step, starts = WINDOW - SHARED, set()
    for m in TRIGGER.finditer(text):
        for k in range(max(0, (m.start() - WINDOW) // step), m.end() // step + 1):
            starts.add(k * step)
    return sorted(s for s in starts if s < len(text))


def batch_of(pieces: list[str]) -> np.ndarray:
    x = np.full((len(pieces), WINDOW), SYMBOLS - 1, np.int64)
    for k, piece in enumerate(pieces):
        x[k, : len(piece)] = codes(piece)
    return x


def read(path: np.ndarray, sure: np.ndarray, size: int) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, least confidence) of the spans that a path of tags marks."""
    out: list[tuple[int, int, str, float]] = []
    t = 0
    while t < size:
        if path[t] and path[t] % 2:  # a begin tag
            kind, end = (path[t] - 1) // 2, t + 1
            while end < size and path[end] == path[t] + 1:
                end += 1
            out.append((t, end, KINDS[kind], float(sure[t:end].min())))
            t = end
        else:
            t += 1
    return out


def tagged(tagger: Tagger, texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    """Spans that the tagger finds in each text, reconciled between windows; they never overlap."""
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in texts]
    where = [(k, s) for k, t in enumerate(texts) for s in windows(t)]
    for at in range(0, len(where), 512):
        some = where[at : at + 512]
        scores, _ = tagger.run(batch_of([texts[k][s : s + WINDOW] for k, s in some]))
        path = tagger.best(scores)
        a, b, z = tagger.marginals(scores)
        sure = np.take_along_axis(np.exp(a + b - z[:, None, None]), path[:, :, None], axis=2)[:, :, 0]
        for row, (k, s) in enumerate(some):
            size = min(WINDOW, len(texts[k]) - s)
            for start, end, kind, p in read(path[row], sure[row], size):
                cut = (start == 0 and s > 0) or (end == size and s + size < len(texts[k]))
                if not cut:
                    out[k].append((s + start, s + end, kind, p))
    return [settle(spans) for spans in out]


def settle(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of overlapping spans the more certain, then the longer, then the earlier one; equal ones once."""
    kept: list[tuple[int, int, str, float]] = []
    for s in sorted(set(spans), key=lambda s: (-s[3], s[0] - s[1], s[0], KINDS.index(s[2]))):
        k = bisect(kept, s)
        if (not k or kept[k - 1][1] <= s[0]) and (k == len(kept) or s[1] <= kept[k][0]):
            kept.insert(k, s)
    return kept


def plausible(text: str, kind: str) -> bool:
    """Whether an added span can be what it is tagged as."""
    own = digits(text)
    if kind == "email":
        return bool(re.search(r"[A-Za-z0-9]\s*[\[(]?\s*(@|at)\s*[\])]?\s*[A-Za-z0-9]", text, re.IGNORECASE)) and bool(re.search(r"\.|dot", text, re.IGNORECASE))
    if kind == "ip":
        parts = [p for p in re.split(r"[^0-9]+", text) if p]
        return len(parts) == 4 and all(int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(own) <= 19 and luhn(own)
    return 9 <= len(own) <= 15


#: How often an address is spelled out in each of these ways; words without brackets, which look like any others, are the hardest.
SPELLED = (0.3, 0.08, 0.08, 0.08, 0.08, 0.08, 0.3)


def variants(r: np.random.Generator, text: str, kind: str) -> tuple[str, str | None]:
    """A span written in another way, or a look-alike with None as kind."""
    way = r.random()
    if kind == "email":
        user, host = text.split("@", 1)
        if way < 0.35:
            return text, kind
        if way < 0.8:
            at, dot = [(" at ", " dot "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" @ ", "."), (" (at) ", "."), ("[at]", "[dot]"), (" AT ", " DOT ")][r.choice(7, p=SPELLED)]
            return (user.replace(".", dot) if dot != "." and r.random() < 0.5 else user) + at + host.replace(".", dot), kind
        return [f"@{user}", f"{user} at {host.split('.')[0]}", f"{user}#{host}"][r.integers(3)], None
    if kind == "ip":
        if way < 0.6:
            return text, kind
        if way < 0.75:
            return text.replace(".", "[.]"), kind
        return [".".join(text.split(".")[:3]), text.rsplit(".", 1)[0] + "." + str(r.integers(256, 999)), "v" + ".".join(text.split(".")[:2])][r.integers(3)], None
    own = digits(text)
    if kind == "card":
        if way < 0.4:
            return text, kind
        if way < 0.75:
            gap = [".", "/", "  ", " - ", "_"][r.integers(5)]
            return gap.join(own[k : k + 4] for k in range(0, len(own), 4)), kind
        wrong = own[:-1] + str((int(own[-1]) + r.integers(1, 10)) % 10)
        return [own[: r.integers(4, 9)], wrong[:12], own + "".join(map(str, r.integers(0, 10, 8)))][r.integers(3)], None
    tail = own[-10:]
    if way < 0.35:
        return text, kind
    if way < 0.8:
        area, mid, end = tail[:3], tail[3:6], tail[6:]
        forms = (f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"{area} {mid} {end}", f"00{own[:-10] or '1'} {area} {mid} {end}", f"tel: {area}-{mid}-{end}", f"+{own[:-10] or '1'}-{area}-{mid}-{end}")
        form = forms[r.integers(len(forms))]
        return form, kind
    return [f"{tail[:4]}-{tail[4:6]}-{tail[6:8]}", tail[: r.integers(2, 8)], f"{tail[:2]}:{tail[2:4]}", f"{tail[:4]}"][r.integers(4)], None


def made_up(r: np.random.Generator, kind: str) -> str:
    """A span as the rules know it, of random parts."""
    letters = "abcdefghijklmnopqrstuvwxyz"

    def name(low: int, high: int) -> str:
        return "".join(letters[i] for i in r.integers(0, 26, r.integers(low, high)))

    if kind == "email":
        part = [".", "_", "", "-"][r.integers(4)] + [name(1, 9), str(r.integers(0, 99))][r.integers(2)]
        return name(1, 9) + [part, ""][r.integers(2)] + "@" + name(3, 9) + [".example", "", f".{name(2, 6)}"][r.integers(3)] + [".com", ".org", ".net", ".de", ".fr", ".es"][r.integers(6)]
    if kind == "ip":
        return ".".join(map(str, r.integers(0, 256, 4)))
    if kind == "card":
        own = str(r.integers(3, 7)) + "".join(map(str, r.integers(0, 10, [13, 14, 14, 14][r.integers(4)])))
        own += next(str(d) for d in range(10) if luhn(own + str(d)))
        return [own, " ".join(own[k : k + 4] for k in range(0, len(own), 4)), "-".join(own[k : k + 4] for k in range(0, len(own), 4))][r.integers(3)]
    a, b, c = ("".join(map(str, r.integers(0, 10, n))) for n in (3, 3, 4))
    code = str(r.integers(1, 99))
    return [f"+{code} ({a}) {b}-{c}", f"+{code} {a} {b} {c}", f"+{code}-{a}-{b}-{c}", f"+{code}{a}{b}{c}"][r.integers(4)]


def noise(r: np.random.Generator) -> str:
    """Text with digits that is no personal data."""
    hexes = "0123456789abcdef"
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    kind = r.integers(8)
    if kind == 0:
        return "".join(hexes[i] for i in r.integers(0, 16, r.integers(12, 41)))
    if kind == 1:
        return "AKIA" + "".join(upper[i] for i in r.integers(0, 32, 16))
    if kind == 2:
        return str(r.integers(0, 10 ** int(r.integers(1, 9))))
    if kind == 3:
        return f"{r.integers(1900, 2100)}-{r.integers(1, 13):02d}-{r.integers(1, 29):02d}"
    if kind == 4:
        return f"{r.integers(0, 999)}.{r.integers(0, 99):02d}"
    if kind == 5:
        return f"{r.integers(0, 24)}:{r.integers(0, 60):02d}"
    if kind == 6:
        return ["token", "password", "key", "id"][r.integers(4)] + ["=", " = ", ": "][r.integers(3)] + "".join(hexes[i] for i in r.integers(0, 16, r.integers(8, 41)))
    return ["at", "dot", "we met at noon", "look at it"][r.integers(4)]


def examples(found: list[tuple[str, str, str, str]], n: int = 12_000) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols and their tags, from (text before, span, kind, text after)."""
    r = np.random.default_rng(SEED)
    around = [(a, b) for a, _, _, b in found] or [("", "")]
    x, y = np.full((n, WINDOW), SYMBOLS - 1, np.int64), np.zeros((n, WINDOW), np.int64)
    by = {k: [s for _, s, kind, _ in found if kind == k] for k in KINDS}
    for row in range(n):
        before, after = around[r.integers(len(around))]
        kind: str | None = KINDS[r.integers(4)]
        if r.random() < 0.2:
            span, kind = noise(r), None
        else:
            own = by[kind]
            span, kind = variants(r, own[r.integers(len(own))] if own and r.random() < 0.4 else made_up(r, kind), kind)
        room = WINDOW - min(len(span), WINDOW)
        head = before[len(before) - min(len(before), int(r.integers(0, room + 1))) :]
        tail = after[: room - len(head)]
        if r.random() < 0.25:  # a text's end
            tail = tail[: r.integers(0, len(tail) + 1)]
        if r.random() < 0.15 and tail:
            tail = [".", ",", ";", ")", "!"][r.integers(5)] + tail[1:]
        piece = (head + span + tail)[:WINDOW]
        x[row, : len(piece)] = codes(piece)
        end = min(WINDOW, len(head) + len(span))
        if kind:
            tag = 1 + 2 * KINDS.index(kind)
            start = len(head) + (len(span) - len(span.removeprefix("tel: ")))
            y[row, start], y[row, start + 1 : end] = tag, tag + 1
    return x, y


def fit(docs: DataFrame, most: int = MOST) -> Tagger:
    """Train on all rule spans of about ``most`` documents that have a digit or an @, and on variants of them.

    A hash of the text picks these, and each text counts once however many copies it has. The
    driver gets the sample's spans with some text around, which ``most`` bounds.
    """
    likely = docs.where(F.col("text").rlike("[0-9@]")).select("text")
    n = likely.count()
    if n > most:
        likely = likely.where(F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    likely = likely.dropDuplicates(["text"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(t[max(0, a - WINDOW) : a], t[a:b], kind, t[b : b + WINDOW]) for t in batch.column(0).to_pylist() for a, b, kind in rules(t)]
            yield pa.RecordBatch.from_pydict({k: pa.array([r[i] for r in rows], pa.string()) for i, k in enumerate(("before", "span", "kind", "after"))})

    found = [tuple(r) for r in likely.mapInArrow(collect, "before string, span string, kind string, after string").collect()]
    tagger = Tagger.new()
    tagger.train(*examples(sorted(set(found))))
    return tagger


def spans(tagger: Tagger, texts: list[str]) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """For each text the rule spans, and these with the tagger's, which never overlap them."""
    base = [rules(t) if TRIGGER.search(t) else [] for t in texts]
    out = []
    for text, own, more in zip(texts, base, tagged(tagger, texts), strict=True):
        starts, ends = [s[0] for s in own], [0, *accumulate((s[1] for s in own), max)]
        added = [(a, b, k) for a, b, k, p in more if p >= SURE and plausible(text[a:b], k) and ends[bisect_left(starts, b)] <= a]
        out.append((own, sorted(own + added, key=lambda s: (s[0], KINDS.index(s[2])))))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def find(docs: DataFrame, tagger: Tagger, text: str = "text", base: str = "base_spans", every: str = "spans") -> DataFrame:
    """Documents with the rule spans and all spans added, as arrays of (start, end, kind) in code points."""
    new = (base, every)
    rest = [f for f in docs.schema.fields if f.name not in new]
    names = [f.name for f in rest]
    shared = docs.sparkSession.sparkContext.broadcast(tagger)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def column(rows: list[list[tuple[int, int, str]]]) -> pa.Array:
        return pa.array([[{"start": a, "end": b, "kind": k} for a, b, k in r] for r in rows], kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = shared.value
        for batch in batches:
            for some in words.slices(batch, text):
                found = spans(tagger, words.texts(some, text).to_pylist())
                yield pa.RecordBatch.from_arrays([*(some.column(some.schema.get_field_index(c)) for c in names), column([f[0] for f in found]), column([f[1] for f in found])], names=[*names, *new])

    return docs.mapInArrow(run, T.StructType([*rest, T.StructField(base, SPANS), T.StructField(every, SPANS)]))
