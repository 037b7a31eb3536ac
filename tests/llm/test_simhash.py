"""Fingerprints and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from cutline.llm import simhash as S
from cutline.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def fingerprint(text):
    words = WORD.findall(re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    return sorted(((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, group)), key=str)


def rows():
    draw = random.Random(4)
    words = ["w%d" % i for i in range(400)]
    out = []
    for k in range(25):
        text = draw.choices(words, k=draw.choice([0, 1, 3, 40, 120, 300]))
        for _ in range(draw.randint(1, 5)):
            copy = list(text)
            for _ in range(draw.randint(0, 2)):
                if copy:
                    copy[draw.randrange(len(copy))] = draw.choice(words)
            out.append((len(out), " ".join(copy)))
    return out + [(500, None), (501, ""), (501, ""), (None, "W1 w2\tw3  w4 w5"), (502, "w1 w2 w3 w4 w5"), (503, "x" * 100_000)]


@pytest.mark.parametrize("hot", [20_000, 5])
def test_components(spark, monkeypatch, hot):
    plain = S.links
    monkeypatch.setattr(S, "links", lambda distinct, radius: plain(distinct, radius, hot_rows=hot))
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows()], "doc_id long, text string, fp int")
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in S.near_copies(docs).collect()), key=str)
    assert found == brute(rows())


def test_every_distance(spark):
    """Fingerprints at each distance up to six from a few centres: linked up to four, never beyond."""
    draw = random.Random(6)
    for distance in range(1, 7):
        prints = []
        for _ in range(6):
            a = draw.getrandbits(64)
            prints.append((a, a ^ sum(1 << b for b in draw.sample(range(64), distance))))
        signed = np.array([x for p in prints for x in p], np.uint64).view(np.int64).tolist()
        found = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"), 4).count()
        assert found == (len(prints) if distance <= 4 else 0)


def test_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (100, 101)], "a long, b long")
    found = {r.node: r.root for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_nothing(spark):
    assert S.near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0
