"""Base counts and distances against plain Python."""

import math
import re
from collections import Counter

import pytest

from cutline.llm import divergence as D

WORD = re.compile("[^\x20\x09-\x0d]+")
SF = "/root/testdata/sf0.001"


def base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    covered = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    seen, duplicate = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicate += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), duplicate, len(covered)


def js(p, q):
    a, b = sum(p), sum(q)
    if not a or not b:
        return 0.0
    out = 0.0
    for x, y in zip(p, q):
        x, y = x / a, y / b
        m = (x + y) / 2
        out += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(0.0, min(1.0, out / 2)))


ODD = [(10_000, None, "en", 1), (10_001, "", "en", 1), (10_002, "a b c d e f g h " * 3, None, 1), (10_003, "x\n\nx\nx \n y", "en", 1), (10_004, "é ß " * 30, "zz", 1), (10_005, "lone " * 9000, "en", 1), (10_005, "lone " * 9000, "en", 1)]


def test_base_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "n_chars")
    docs = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string, lang string, n_chars long")).withColumn("kept", docs.n_chars)
    found = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in D.quality(docs).collect())
    want = []
    for r in docs.collect():
        n = base(r.text)
        want.append((r.doc_id, *n, n[0] < 20 or 100 * n[4] > 30 * n[0]))
    assert found == sorted(want)


def test_distances(spark):
    rules = D.Rules(min_reference=100)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.collect()
    counts, classes, words = {}, {}, {}
    for r in rows:
        c = [0] * len(D.CLASSES)
        for x in r.text:
            c[D._CLASS[x.encode()[0]]] += 1
        classes[r.doc_id], words[r.doc_id] = c, Counter(WORD.findall(r.text))
        whole, common = counts.setdefault(r.lang, ([0] * len(D.CLASSES), Counter()))
        counts[r.lang] = ([a + b for a, b in zip(whole, c)], common + words[r.doc_id])
    for r in D.measured(docs, D.references(docs, rules), rules).collect():
        lang = next(x.lang for x in rows if x.doc_id == r.doc_id)
        whole, common = counts[lang]
        top = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0].encode()))[: rules.common]]
        bins = [*(common[w] for w in top), sum(common.values()) - sum(common[w] for w in top)]
        own = [*(words[r.doc_id][w] for w in top), sum(words[r.doc_id].values()) - sum(words[r.doc_id][w] for w in top)]
        if sum(classes[r.doc_id]) < rules.min_chars:
            assert r.class_distance is None
        else:
            assert r.class_distance == pytest.approx(js(classes[r.doc_id], whole), abs=1e-9)
        if r.n_words < rules.min_words:
            assert r.word_distance is None
        else:
            assert r.word_distance == pytest.approx(js(own, bins), abs=1e-9)
        apart = (r.class_distance or 0) > rules.max_class_distance or (r.word_distance or 0) > rules.max_word_distance
        assert r.kept == (not r.base_failed and not apart)


def test_nothing(spark):
    assert D.quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
