"""Name normalisers and text extraction."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cutline import constants as K

_SUFFIX_PATTERN = "|".join(K.NAME_SUFFIXES)

def _decomposed_letters() -> tuple[str, str]:
    """Every precomposed lower-case letter whose canonical decomposition is one letter and marks, and that letter."""
    pairs = []
    for code in range(0x80, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and chr(code).islower() and all(unicodedata.combining(x) for x in parts[1:]):
            pairs.append((chr(code), parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _decomposed_letters()


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often ``body`` names it."""
    return F.transform(F.array(value), body)[0]


def strip_accents(text: Column) -> Column:
    """Drop combining marks and map precomposed letters to their base."""
    lowered = F.lower(text)
    bare = F.regexp_replace(lowered, r"[̀-ͯ]", "")
    return F.translate(bare, _ACCENTED, _PLAIN)


def ingest_name_tokens(name: Column) -> Column:
    """Apostrophes vanish, ``.,-/`` separate, one trailing suffix drops."""
    folded = F.regexp_replace(F.lower(name), "['’]", "")
    spaced = F.regexp_replace(folded, r"[.,\-/]", " ")
    tokens = F.filter(F.split(spaced, r"\s+"), lambda t: t != "")
    last = F.try_element_at(tokens, F.lit(-1))
    drop = (F.size(tokens) > 1) & last.isin(*K.NAME_SUFFIXES)
    return F.when(drop, F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)


def market_name(name: Column) -> Column:
    """Accents stripped, ``.'’-`` separate, suffix words drop anywhere."""
    spaced = F.regexp_replace(strip_accents(name), r"[.'’\-]", " ")
    cut = F.regexp_replace(spaced, rf"\b({_SUFFIX_PATTERN})\b", "")
    return F.trim(F.regexp_replace(cut, r"\s+", " "))


def _looks_like_a_person(raw: Column) -> Column:
    person = lambda name: (name != "") & ~name.rlike(r"\d") & (F.size(F.split(name, r"\s+")) >= 2)
    return _let(F.trim(raw), lambda name: F.when(person(name), name))


def _first_group(text: Column, pattern: str) -> Column:
    return _let(F.regexp_extract(text, pattern, 1), lambda found: F.when(found != "", found))


def market_player_name(sub_title: Column, title: Column) -> Column:
    """Text before a colon, else before a number; the sub-title is tried first."""
    tries = []
    for source in (sub_title, title):
        tries.append(_looks_like_a_person(_first_group(source, r"^([^:]+):\s+")))
        tries.append(_looks_like_a_person(_first_group(source, r"^(.+?)\s+\d")))
    return F.coalesce(*tries)


def market_threshold(strike: Column, sub_title: Column, title: Column) -> Column:
    """A finite numeric strike wins; otherwise ``N+`` read from the text."""
    number = strike.cast("double")
    finite = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    pattern = r"(\d+(?:\.\d+)?)\s*\+"
    texts = [_first_group(t, pattern).cast("double") for t in (sub_title, title)]
    return F.coalesce(finite, *texts)


def event_ticker_parts(ticker: Column, codes: tuple[str, ...] | None = None) -> Column:
    """Struct of date, away and home code from the tail of an event ticker.

    The two team codes are concatenated, so both split points are tried and the
    answer stands only if exactly one leaves two known codes.
    """
    known = list(codes) if codes is not None else [*K.TEAM_CODES, *K.TEAM_ALIASES]
    shape = r"^(\d{2})([A-Z]{3})(\d{2})([A-Z]+)$"
    months = F.array(*[F.lit(m) for m in K.MONTH_CODES])

    def groups(tail: Column) -> Column:
        year, month, day, teams = (F.regexp_extract(tail, shape, i) for i in (1, 2, 3, 4))
        return F.struct(year.alias("year"), F.array_position(months, month).cast("int").alias("month_no"), day.alias("day"), teams.alias("teams"))

    def only_cut(teams: Column) -> Column:
        two, three = (
            (F.length(teams) >= cut + 2) & F.substring(teams, 1, cut).isin(*known) & F.substring(teams, cut + 1, 64).isin(*known) for cut in (2, 3)
        )
        return F.when(two & ~three, 2).when(three & ~two, 3)

    def parts(g: Column) -> Column:
        stamp = F.concat_ws("-", F.concat(F.lit("20"), g["year"]), F.lpad(g["month_no"].cast("string"), 2, "0"), g["day"])
        game_date = F.when(g["month_no"] > 0, F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd")).cast("date"))
        teams = g["teams"]
        return _let(only_cut(teams), lambda cut: F.struct(
            game_date.alias("game_date"),
            F.when(cut.isNotNull(), F.substr(teams, F.lit(1), cut)).alias("away_code"),
            F.when(cut.isNotNull(), F.substr(teams, cut + 1)).alias("home_code"),
        ))

    # A tail of another shape has empty groups: no month and no cut.
    tail = F.coalesce(F.try_element_at(F.split(ticker, "-"), F.lit(2)), F.lit(""))
    return _let(tail, lambda t: _let(groups(t), parts))


def canonical_team(code: Column) -> Column:
    mapped = F.create_map(*[F.lit(x) for kv in K.TEAM_ALIASES.items() for x in kv])
    return F.coalesce(F.element_at(mapped, code), code)


def series_stat_type(series: Column) -> Column:
    mapped = F.create_map(*[F.lit(x) for kv in K.SERIES_STAT_TYPES.items() for x in kv])
    return F.element_at(mapped, series)


def redact_error(text: Column, secrets: tuple[str, ...] = (), limit: int | None = None) -> Column:
    """Credential spans first, then known secret values longest first."""
    out = F.regexp_replace(text, r"(?i)(postgres(?:ql)?(?:\+\w+)?://)[^\s/@]+@", "$1<redacted>@")
    for secret in sorted((s for s in secrets if s), key=len, reverse=True):
        out = F.replace(out, F.lit(secret), F.lit("<redacted>"))
    return F.left(out, F.lit(limit)) if limit else out


def redact_urls(text: Column, limit: int | None = None) -> Column:
    out = F.regexp_replace(text, r"https?://\S+", "[url]")
    return F.left(out, F.lit(limit)) if limit else out
