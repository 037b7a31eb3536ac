"""Preference pairs against plain Python, and the registered query against its SQL."""

from cutline.llm import chat
from cutline.llm.queries import CHECKS, QUERIES
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"


def brute(rows):
    pairs = {}
    for pair, side, turn, role, text in rows:
        if pair is not None:
            pairs.setdefault(pair, {"chosen": [], "rejected": []})
            if side in pairs[pair]:
                pairs[pair][side].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for pair, sides in pairs.items():
        turns = {s: [x[2:] for x in sorted(v)] for s, v in sides.items()}
        n = 0
        while n < min(map(len, turns.values())) and turns["chosen"][n] == turns["rejected"][n]:
            n += 1
        show = lambda ts: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in ts)
        made = [len(turns["chosen"]), len(turns["rejected"]), n, show(turns["chosen"][:n])]
        for side in ("chosen", "rejected"):
            at, spans = 0, []
            for r, t in turns[side][n:]:
                begin = at + len(f"<|{r}|>\n")
                at = begin + len(t) + len("<|end|>\n")
                if r == "assistant":
                    spans.append(f"{begin}:{at - 1}")
            made += [show(turns[side][n:]), ",".join(spans)]
        out[pair] = tuple(made)
    return out


def test_pairs(spark):
    rows = [
        (1, "chosen", 0, "user", "hi 🙂"), (1, "chosen", 1, "assistant", "good"), (1, "rejected", 0, "user", "hi 🙂"), (1, "rejected", 1, "assistant", "bad"), (1, "rejected", 2, "user", "why"),
        (2, "chosen", 0, "user", "a"), (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "user", "a"),
        (3, "chosen", 1, None, None), (3, "rejected", 1, None, None),
        (4, "chosen", 0, "assistant", "x" * 100_000), (5, "rejected", None, "assistant", ""), (None, "chosen", 0, "user", "lost"), (6, "other", 0, "user", "no side"),
        (7, "chosen", 0, "system", "s"), (7, "rejected", 0, "user", "s"),
    ]
    found = chat.preference(spark.createDataFrame([(*r, 1) for r in rows], "pair_id long, side string, turn int, role string, text string, prompt int"))
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == brute(rows)
    assert chat.preference(spark.createDataFrame([], "pair_id long, side string, turn int, role string, text string")).count() == 0


def test_query_equals_its_sql(spark):
    _, problems = compare(spark, connect(SF), QUERIES["op1_preference_pairs"], CHECKS["op1_preference_pairs"], SF)
    assert not problems, problems
