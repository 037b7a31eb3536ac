"""Languages too small for a reference of their own."""

import random
from collections import Counter

import pytest

from cutline.llm import divergence as D
from tests.llm.test_divergence import WORD, js


def test_small_languages_share_a_reference(spark):
    draw = random.Random(3)
    prose = lambda n: " ".join(draw.choice("the of and river stone walks under morning a light they carry".split()) for _ in range(n))
    junk = " ".join(draw.choice("#### $$%% 99871 ||<> 44-55 ***7".split()) for _ in range(200))
    rows = [(i, prose(400), "en") for i in range(20)] + [(100 + i, prose(150), f"l{i}") for i in range(9)]
    rows += [(200, junk, "l1"), (201, junk, None), (202, prose(150), None), (203, "few words", "l2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r.doc_id: r for r in D.quality(docs).collect()}
    pool = [t for _, t, lang in rows if lang != "en"]
    classes = lambda texts: [sum(D._CLASS[x.encode()[0]] == k for t in texts for x in t) for k in range(len(D.CLASSES))]
    common = Counter(w for t in pool for w in WORD.findall(t))
    top = [w for w, _ in sorted(common.items(), key=lambda x: (-x[1], x[0]))[: D.Rules().common]]
    bins = lambda n: [*(n[w] for w in top), sum(n.values()) - sum(n[w] for w in top)]
    for i, text, lang in rows:
        if lang == "en" or i == 203:
            continue
        assert found[i].class_distance == pytest.approx(js(classes([text]), classes(pool)), abs=1e-9)
        assert found[i].word_distance == pytest.approx(js(bins(Counter(WORD.findall(text))), bins(common)), abs=1e-9)
        apart = found[i].class_distance > D.Rules().max_class_distance or found[i].word_distance > D.Rules().max_word_distance
        assert found[i].kept == (not found[i].base_failed and not apart)
    assert not found[200].kept and not found[201].kept and not found[200].base_failed
    assert found[202].kept and found[203].class_distance is None
