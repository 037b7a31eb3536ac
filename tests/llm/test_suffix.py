"""Repeats against a set of all 100-byte strings."""

import hashlib
import random

import pytest

from cutline.llm import suffix as S
from cutline.llm.rows import numbered


def brute(rows):
    seen, out = set(), []
    for i, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - 99):
            string = data[k : k + 100]
            if string in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(string)
        kept = bytes(x for x, y in zip(data, gone) if not y)
        spans = sum(1 for k in range(len(data)) if gone[k] and (not k or not gone[k - 1]))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows():
    draw = random.Random(5)
    words = ["".join(draw.choices("abcdefgh", k=draw.randint(1, 6))) for _ in range(30)]
    passages = [" ".join(draw.choices(words, k=60)) for _ in range(8)]
    out = []
    for i in range(120):
        parts = []
        for _ in range(draw.randint(0, 6)):
            if draw.random() < 0.5:
                parts.append(draw.choice(passages)[draw.randint(0, 100) :][: draw.randint(0, 300)])
            else:
                parts.append(" ".join(draw.choices(words, k=draw.randint(0, 30))))
        out.append((i, " ".join(parts)))
    return out + [(150, "a" * 700), (151, None), (152, ""), (153, "é" * 300), (154, "xy" * 300), (155, passages[0] * 40)]


def digest(docs):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in S.digest(docs).collect()), key=str)


@pytest.mark.parametrize("hot", [5_000, 3])
def test_digest(spark, monkeypatch, hot):
    plain = S.repeats
    monkeypatch.setattr(S, "repeats", lambda docs, **options: plain(docs, hot_rows=hot, **options))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows()], "doc_id long, text string, start string").repartition(5)
    assert digest(docs) == brute(rows())


def test_long_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(S, "SEGMENT", 1_000)
    docs = [(1, rows()[-1][1]), (2, rows()[-1][1][500:])]
    parts = list(S._segments(S.np.frombuffer(docs[0][1].encode(), S.np.uint8), S.np.array([0, len(docs[0][1])])))
    assert len(parts) > 3
    texts = spark.createDataFrame(docs, "doc_id long, text string")
    assert digest(texts) == brute(docs)


def test_repeated_and_missing_ids(spark):
    text = " ".join(f"word{i}" for i in range(60))
    given = [(7, text), (7, text), (3, text + " more"), (None, text), (7, None)]
    found = digest(spark.createDataFrame(given, "doc_id long, text string"))
    in_order = [(3, text + " more"), (7, None), (7, text), (7, text), (None, text)]
    assert found == brute(in_order)


def test_maximal_repeats_hold_all_occurrences(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, f"aa {passage} zz"), (2, f"bb {passage} yy"), (3, f"aa {passage} xx"), (4, "none")], "doc_id long, text string")
    found = S.repeats(numbered(docs)).collect()
    by_repeat = {}
    for r in found:
        by_repeat.setdefault(r.repeat, []).append(r)
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    whole = 0
    for members in by_repeat.values():
        assert len({texts[r.doc][r.start : r.start + r.size] for r in members}) == 1
        assert sum(r.leads for r in members) == 1 and min((r.doc, r.start) for r in members) == next((r.doc, r.start) for r in members if r.leads)
        whole += len({r.doc for r in members}) == 3
    assert whole


def test_interval_tree():
    texts = sorted([b"banana", b"anana", b"nana", b"ana", b"na", b"a"])
    found = {(texts[a][:d], b - a) for a, b, d in S.intervals(texts) if d}
    assert found == {(b"a", 3), (b"ana", 2), (b"na", 2)}


def test_cut_keeps_whole_characters_and_columns(spark):
    passage = "é" * 120
    docs = spark.createDataFrame([(1, passage + "a", "k"), (2, "b" + passage, "l"), (3, None, None)], "doc_id long, text string, lang string")
    found = {r.doc_id: (r.text, r.lang) for r in S.cut_rows(docs).collect()}
    assert found[1][0][0] == "é" and found[3] == (None, None) and found[2] == ("b", "l")
    assert S.cut_rows(docs.limit(0)).count() == 0 and S.digest(docs.limit(0)).count() == 0


def test_a_crowd_of_near_copies_is_linear():
    """5,000 near copies through one anchor: one span a member, nodes as ranges, and both say what brute force says."""
    draw = random.Random(3)
    base = bytes(draw.choices(range(97, 123), k=240))
    around = []
    for i in range(5_000):
        text = bytearray(base)
        for _ in range(draw.randint(1, 2)):
            text[draw.choice([k for k in range(240) if not 110 <= k < 134])] = 65
        around.append((i, 110, bytes(text[:110]), bytes(text[110:])))
    rows = S._tree_of(1, around)
    nodes, members = [r for r in rows if r[-1] == S.NODE], [r for r in rows if r[-1] == S.MEMBER]
    assert len(members) == 5_000 and len(S._cuts_of(1, around)) <= 5_000
    assert len({r[1] for r in nodes}) == len(nodes)
    few = around[:60]
    rows = S._tree_of(1, few)
    members = [r for r in rows if r[-1] == S.MEMBER]
    for r in (r for r in rows if r[-1] == S.NODE):
        inside = {m[2] for m in members if r[7] <= m[7] < r[8] and r[9] <= m[9] < r[10]}
        left, size = r[6] - r[3], r[4]
        text = few[r[2]][2][110 - left :] + few[r[2]][3][: size - left]
        assert inside == {d for d, _, a, b in few if (a[110 - left :] + b[: size - left]) == text} and len(inside) > 1 and min(inside) == r[2]
    cut = {d: set(range(s, s + n)) for d, s, n in S._cuts_of(1, few)}
    for d, _, a, b in few:
        text, want = a + b, set()
        for k in range(11, 111):  # the strings that hold the anchor
            if k + 100 >= 134 and any((x + y)[k : k + 100] == text[k : k + 100] for e, _, x, y in few if e < d):
                want |= set(range(k, k + 100))
        assert cut.get(d, set()) >= want
