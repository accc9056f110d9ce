import hashlib
import random
import re

import numpy as np
import pytest

from framewell.llm import personal, queries

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            own = re.sub("[^0-9]", "", m[0])
            if kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 14 <= len(own) <= 19 and luhn(own) or kind == "phone" and 10 <= len(own) <= 15:
                found.append((m.start(), order, m.end(), kind))
    return [(s, e, k) for s, _, e, k in sorted(found)]


def test_rules_equal_plain_patterns():
    r = random.Random(1)
    parts = ["a", "@", ".", "-", "+", "1", "45", "255", "300", "(", ")", " ", "x.y", "4111111111111111", "é", "٣"]
    for _ in range(20000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 30)))
        assert personal.rules(text) == brute(text)


@pytest.mark.parametrize("text", ["1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "@" * 200_000, "+1" + " " * 200_000])
def test_no_text_is_slow(text):
    assert isinstance(personal.rules(text), list)


def test_gradients():
    tagger = personal.Tagger.new()
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    x, y = personal.examples([("ab c ", "j.x@m.com", "email", " de")], 6)
    _, g = tagger.gradient(x, y)
    for name, at in (("out_f", (3, 1)), ("out_b", (5, 2)), ("bias", (1,)), ("moves", (0, 1))):
        e = 1e-5
        tagger.p[name][at] += e
        up, _ = tagger.gradient(x, y)
        tagger.p[name][at] -= 2 * e
        down, _ = tagger.gradient(x, y)
        tagger.p[name][at] += e
        assert abs((up - down) / 2 / e - g[name][at]) < 1e-3 + 0.02 * abs(g[name][at])


@pytest.fixture(scope="module")
def tagger():
    own = personal.Tagger.new()
    context = [("Some words stand before the ", "jo.x@mail.org", "email", " and others after it. "), ("und davor steht ", "+1 (555) 123-4567", "phone", " noch etwas Text danach, ")]
    own.train(*personal.examples(context))
    return own


def test_tagger_finds_other_forms(tagger):
    r = np.random.default_rng(9)
    hits: dict[str, list[bool]] = {}
    for _ in range(240):
        kind = personal.KINDS[r.integers(4)]
        span, real = personal.variants(r, personal.made_up(r, kind), kind)
        text = f"Some words stand before the {span} and others after it."
        got = personal.spans(tagger, [text])[0][1]
        hits.setdefault("real" if real else "not", []).append(any(s < 28 + len(span) and e > 28 for s, e, _ in got))
    assert np.mean(hits["real"]) > 0.8 and np.mean(hits["not"]) < 0.15


def test_windows_agree_with_each_other(tagger):
    text = "word " * 37 + "jane.doe@mail.org" + " word" * 40
    (own, every), (_, none) = personal.spans(tagger, [text, "plain text at noon"])
    assert own == every == [(185, 202, "email")] and none == []
    assert personal.settle([(0, 5, "ip", 0.9), (3, 9, "card", 0.95), (0, 5, "ip", 0.9), (9, 12, "ip", 0.5)]) == [(3, 9, "card", 0.95), (9, 12, "ip", 0.5)]


def test_query(spark, tmp_path):
    docs = [(1, "mail a.b@c.de or 10.0.0.1, +49 170 1234567 and 4111 1111 1111 1111"), (2, None), (3, ""), (4, "é x@y.z"), (4, "é x@y.z"), (5, "plain " * 20000 + "q@r.st")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op6_pii(spark, str(tmp_path)).collect()
    assert len(rows) == 6
    for r in rows:
        base = brute(dict(docs)[r["doc_id"]] or "")
        joined = [f"{k}:{s}:{e}" for s, e, k in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(joined).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(x[2] == k for x in base) for k in PLAIN] and set(joined) <= set(filter(None, r["spans"].split(",")))


def test_upper_case_forms_are_looked_at():
    text = "name AT host DOT com"
    assert personal.windows(text) == [0] and personal.plausible(text, "email") and personal.plausible("name At host Dot com", "email")


def test_a_window_holds_every_span_at_every_place():
    span = "some_one.with.long.name at a-rather-long-host dot example dot"
    assert 60 <= len(span) <= personal.SHARED - 2
    for own in (span, span[:46], f"({span[:40]}) 1", f"1 {span[:40]}"):
        for before in range(200):
            text = "x" * before + " " + own + " " + "y" * 150
            start, end = before + 1, before + 1 + len(own)
            assert any((s < start or s == 0) and end < s + personal.WINDOW for s in personal.windows(text)), (own, before)


def test_forms_are_found_wherever_windows_end(tagger):
    form = "jane.roe AT mail DOT org"
    texts = [("Some words stand before the " * 12)[-28 - 4 * k :] + form + " and others after it. " * 6 for k in range(70)]
    found = [personal.spans(tagger, [t])[0][1] for t in texts]
    right = [any(kind == "email" and t[a:b] == form for a, b, kind in own) for t, own in zip(texts, found, strict=True)]
    assert sum(right) / len(right) > 0.9
    for own in found:
        assert all(a[1] <= b[0] for a, b in zip(own, own[1:], strict=False))


def test_empty_table_and_clashing_columns(spark, tagger):
    docs = spark.createDataFrame([(1, "a@b.org", "own", "x"), (2, None, None, "y")], "doc_id long, text string, spans string, kind string")
    rows = {r["doc_id"]: r for r in personal.find(docs, tagger).collect()}
    assert [(s["start"], s["end"], s["kind"]) for s in rows[1]["base_spans"]] == [(0, 7, "email")] and rows[2]["spans"] == []
    assert rows[1]["kind"] == "x" and set(rows[1].asDict()) == {"doc_id", "text", "kind", "base_spans", "spans"}
    assert personal.find(docs.where("false"), tagger).count() == 0


def test_all_spans_of_a_text_and_one_of_its_copies_are_learned(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(personal, "examples", lambda found: seen.append(found) or (np.zeros((0, 1), int), np.zeros((0, 1), int)))
    many = " ".join(f"u{k}@host{k}.org" for k in range(9))
    personal.fit(spark.createDataFrame([(k, many) for k in range(500)] + [(500, None)], "doc_id long, text string"))
    assert sorted(s[1] for s in seen[0]) == sorted(many.split())
