"""Secret scans in SQL functions only: fixed shapes, and windows of high entropy.

Spans come from marking: a pattern's matches are wrapped in control characters,
the text is split at them and the lengths of the parts add up to positions (in code
points). Text that holds these control characters itself gets another one in
their place first, which changes no position.

Fixed shapes are assignments of secrets, access keys and long hex strings. Beside
them, runs of key-like characters with a digit are candidates of the class hex or
base64, and with ``letters`` those without a digit but with letters of both cases. A window of ``WINDOW`` characters slides over each candidate; the sum of
c * log2(c) over its character counts changes only by the counts of the character that
comes and the one that goes, so each step costs the same. Windows whose Shannon entropy
reaches the class's limit are joined to spans. Windows that overlap a match of the
allow list are left out, the others of that candidate are not; it never touches the
fixed shapes. Its patterns are met one after the other, each in what is left.

Edge cases: a null text is empty and has no spans; repeated rows give repeated
results; an empty table gives no rows; other columns are not read unless kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, VALUE, CLOSE, OTHER = "\u0001", "\u0002", "\u0003", "\u001a"

#: Kind, pattern (head and value), least length of the value.
SHAPES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"()(AKIA[A-Z0-9]+)", 20),
    ("hex", r"()([0-9a-f]{24,}+)", 24),
)
WINDOW = 20
#: Class of candidates, pattern of the whole candidate, least entropy of a window in bits.
CLASSES = (("entropy_hex", r"^[0-9a-fA-F]+$", 2.9), ("entropy_base64", None, 3.8))
_DIGIT = r"(?=[A-Za-z+/_-]*[0-9])"
_BOTH_CASES = r"(?=[a-z+/_-]*[A-Z])(?=[A-Z+/_-]*[a-z])"
CANDIDATE, LETTERS = (rf"()((?<![A-Za-z0-9+/_-])(?:{x})[A-Za-z0-9+/_-]{{20,}}+={{0,2}})" for x in (_DIGIT, f"{_DIGIT}|{_BOTH_CASES}"))
#: What is no secret: UUIDs, examples, alphabets, one character over and over.
ALLOW = (r"(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$", r"(?i)example|sample|dummy|placeholder|changeme", r"(?i)abcdefghij|0123456789", r"([^\x02])\1{7,}")
SCALE = 1_000_000_000
KINDS = [kind for kind, _, _ in SHAPES] + [kind for kind, _, _ in CLASSES]


def _size(count: int) -> int:
    return round(count * math.log2(count) * SCALE) if count > 1 else 0


def _matches(text: Column, pattern: str, least: int) -> Column:
    """Array of (a, b, value) of the matches with a value of at least ``least`` characters."""
    marked = F.regexp_replace(text, pattern, f"{OPEN}$1{VALUE}$2{CLOSE}")
    parts = F.split(marked, OPEN)
    none = F.array().cast("array<struct<a:int,b:int,value:string>>")

    def step(state, part):
        head = F.length(F.substring_index(part, VALUE, 1))
        value = F.substring_index(F.substring_index(part, CLOSE, 1), VALUE, -1)
        found = F.struct(state["at"].alias("a"), (state["at"] + head + F.length(value)).alias("b"), value.alias("value"))
        return F.struct(
            (state["at"] + F.length(part) - 2).alias("at"),
            F.when(F.length(value) >= least, F.array_append(state["found"], found)).otherwise(state["found"]).alias("found"),
        )

    start = F.struct(F.length(F.get(parts, F.lit(0))).alias("at"), none.alias("found"))
    walked = F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), start, step, lambda s: s["found"])
    return F.when(F.contains(marked, F.lit(OPEN)), walked).otherwise(none)


def _spans(kind: str, found: Column) -> Column:
    order = KINDS.index(kind)
    return F.transform(found, lambda x: F.struct(x["a"].alias("a"), F.lit(order).alias("kind"), x["b"].alias("b")))


def _once(value: Column, use) -> Column:
    """``use(value)``, with the value worked out once: a lambda's variable is bound, an expression is repeated."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shown(value: Column) -> Column:
    """A candidate with ``VALUE`` in the place of each character that the allow list matches."""

    def hidden(pattern):
        def use(x):
            parts = F.split(F.regexp_replace(x, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]")
            return F.array_join(F.transform(parts, lambda part, i: F.when(i % 2 == 1, F.repeat(F.lit(VALUE), F.length(part))).otherwise(part)), "")

        return use

    out = value
    for pattern in ALLOW:
        out = _once(out, hidden(pattern))
    named = F.lit(False)
    for pattern in ALLOW:
        named = named | F.rlike(value, F.lit(pattern))
    return F.when(named, out).otherwise(value)


def _high(shown: Column, limit: float) -> Column:
    """Array of (a, b), within the candidate, of joined windows whose entropy is at least ``limit`` and that hold no ``VALUE``."""
    table = F.array(*[F.lit(_size(c)).cast("long") for c in range(WINDOW + 2)])
    most = math.floor((math.log2(WINDOW) - limit) * WINDOW * SCALE)
    pair = "array<struct<a:int,b:int>>"
    grown = lambda n: F.get(table, n + 1) - F.get(table, n)
    count = lambda among, x: F.size(F.filter(among, lambda y: y == x))

    def slide(chars):
        def step(state, i):
            """The window ends before place ``i`` (from 1) becomes part of it."""
            inside = F.slice(chars, F.greatest(i - WINDOW + 1, F.lit(1)), F.least(i - 1, F.lit(WINDOW - 1)))

            def moved(kept):
                came, went = F.get(chars, i - 1), F.get(chars, i - WINDOW - 1)
                lost = F.when(i > WINDOW, grown(count(kept, went))).otherwise(F.lit(0).cast("long"))
                return state["sum"] - lost + grown(count(kept, came))

            def told(sum_):
                hides = F.when(F.get(chars, i - 1) == VALUE, i).otherwise(state["hides"])
                high = (i - hides >= WINDOW) & (sum_ <= most)
                joins = high & (state["b"] >= i - WINDOW)
                ended = F.array_append(state["done"], F.struct(state["a"].alias("a"), state["b"].alias("b")))
                return F.struct(
                    sum_.alias("sum"),
                    F.when(high & ~joins, i - WINDOW).otherwise(state["a"]).cast("int").alias("a"),
                    F.when(high, i).otherwise(state["b"]).cast("int").alias("b"),
                    F.when(high & ~joins & (state["b"] > 0), ended).otherwise(state["done"]).alias("done"),
                    hides.alias("hides"),
                )

            return _once(_once(inside, moved), told)

        return step

    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(0).alias("a"), F.lit(-1).alias("b"), F.array().cast(pair).alias("done"), F.lit(0).alias("hides"))
    last = lambda s: F.when(s["b"] > 0, F.array_append(s["done"], F.struct(s["a"].alias("a"), s["b"].alias("b")))).otherwise(s["done"])
    places = F.sequence(F.lit(1), F.length(shown))
    return _once(F.split(shown, ""), lambda chars: F.aggregate(places, start, slide(chars), last))


def _class_spans(candidates: Column, kind: str, of_class: bool, limit: float) -> Column:
    """Spans of high entropy in the candidates that are (or are not) all hex digits."""
    order = KINDS.index(kind)
    mine = F.filter(candidates, lambda x: F.rlike(x["value"], F.lit(CLASSES[0][1])) == F.lit(of_class))
    place = lambda x: lambda y: F.struct((x["a"] + y["a"]).alias("a"), F.lit(order).alias("kind"), (x["a"] + y["b"]).alias("b"))
    window = F.lit(f"[^{VALUE}]{{{WINDOW}}}")
    none = F.array().cast("array<struct<a:int,b:int>>")
    high = lambda x: _once(_shown(x["value"]), lambda s: F.when(F.rlike(s, window), _high(s, limit)).otherwise(none))
    return F.flatten(F.transform(mine, lambda x: F.transform(high(x), place(x))))


def _entropy(candidates: Column) -> list[Column]:
    """Spans of each class over the candidates, without what the allow list names."""
    return [_class_spans(candidates, kind, own is not None, limit) for kind, own, limit in CLASSES]


def scanned(docs: DataFrame, text_col: str = "text", letters: bool = False) -> DataFrame:
    """``docs`` with ``base_spans_`` and ``all_spans_``: sorted arrays of (a, kind, b)."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), OPEN + VALUE + CLOSE, OTHER * 3)
    marked = docs.withColumn("scan_", text)
    shapes = [_matches(F.col("scan_"), pattern, least) for _, pattern, least in SHAPES]
    found = marked.select("*", *[x.alias(f"found_{kind}_") for x, (kind, _, _) in zip(shapes, SHAPES)], _matches(F.col("scan_"), LETTERS if letters else CANDIDATE, WINDOW).alias("candidates_"))
    base = F.array_sort(F.concat(*[_spans(kind, F.col(f"found_{kind}_")) for kind, _, _ in SHAPES]))
    more = F.when(F.size("candidates_") > 0, F.concat(*_entropy(F.col("candidates_")))).otherwise(F.array().cast("array<struct<a:int,kind:int,b:int>>"))
    found = found.withColumn("base_spans_", base).withColumn("all_spans_", F.array_sort(F.concat("base_spans_", more)))
    return found.drop("scan_", "candidates_", *[f"found_{kind}_" for kind, _, _ in SHAPES])


def _joined(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["a"], x["b"])), ",")


def report(docs: DataFrame, letters: bool = False) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document."""
    found = scanned(docs.select("doc_id", "text"), letters=letters)
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("base_spans_", of(k))).cast("long").alias(f"n_{kind}") for k, (kind, _, _) in enumerate(SHAPES)]
    return found.select("doc_id", *counts, F.sha2(_joined("base_spans_").cast("binary"), 256).alias("base_sha256"), _joined("all_spans_").alias("spans"))


def redacted(docs: DataFrame, mask: str = "[SECRET]", letters: bool = False) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mask``; overlapping spans by one."""
    found = scanned(docs, letters=letters)

    def merge(state, x):
        last = F.element_at(state, -1)
        joins = (F.size(state) > 0) & (x["a"] <= F.try_element_at(state, F.lit(-1))["b"])
        return F.when(joins, F.array_append(F.slice(state, F.lit(1), F.size(state) - 1), F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b")))).otherwise(
            F.array_append(state, F.struct(x["a"].alias("a"), x["b"].alias("b")))
        )

    spans = F.aggregate("all_spans_", F.array().cast("array<struct<a:int,b:int>>"), merge)
    found = found.withColumn("merged_", F.when(F.size("all_spans_") > 0, spans))
    begins = F.concat(F.array(F.lit(0)), F.transform("merged_", lambda x: x["b"]))
    ends = F.concat(F.transform("merged_", lambda x: x["a"]), F.array(F.length("text")))
    gaps = F.transform(F.arrays_zip(begins.alias("x"), ends.alias("y")), lambda g: F.substring(F.col("text"), g["x"] + 1, g["y"] - g["x"]))
    text = F.when(F.col("merged_").isNotNull(), F.array_join(gaps, mask)).otherwise(F.col("text"))
    return found.withColumn("text", text).drop("base_spans_", "all_spans_", "merged_")
