"""Name and contract resolution as equi-joins. Nothing fuzzy, nothing scored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutline.functions import text as TX
from cutline.operators.merges import Merge, upsert_if_distinct
from cutline.operators import timeline as TL


def name_index(players: DataFrame) -> DataFrame:
    """(form, name_key, entity_id): full names and initial-plus-surname forms."""
    tokens = players.select("entity_id", TX.ingest_name_tokens(F.col("full_name")).alias("t")).where(F.size("t") > 0)
    full = F.struct(F.lit("full").alias("form"), F.concat_ws(" ", "t").alias("name_key"))
    short = F.struct(
        F.lit("initial").alias("form"),
        F.concat_ws(" ", F.substring(F.col("t")[0], 1, 1), F.try_element_at("t", F.lit(-1))).alias("name_key"),
    )
    return tokens.select("entity_id", F.explode(F.array(full, short)).alias("k")).select("k.*", "entity_id").distinct()


def _key(tokens: Column) -> Column:
    short = (F.size(tokens) >= 2) & (F.length(tokens[0]) == 1)
    return F.when(
        short, F.struct(F.lit("initial").alias("form"), F.concat_ws(" ", tokens[0], F.try_element_at(tokens, F.lit(-1))).alias("name_key"))
    ).otherwise(F.struct(F.lit("full").alias("form"), F.concat_ws(" ", tokens).alias("name_key")))


def _counted(index: DataFrame, keys: list[str]) -> DataFrame:
    """Matches per key as partial aggregates: how many, one of them, and an
    order-free hash of them all. Namesakes are never gathered into a list."""
    distinct = index.select(*keys, "entity_id").distinct()
    return distinct.groupBy(*keys).agg(
        F.count("*").alias("__n"), F.min("entity_id").alias("__one"),
        F.sum(F.xxhash64("entity_id").cast("decimal(20,0)")).alias("__hash"),
    )


def _status(df: DataFrame) -> DataFrame:
    n = F.coalesce("__n", F.lit(0))
    return df.withColumns({
        "status": F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unresolved"),
        "entity_id": F.when(n == 1, F.col("__one")),
        "candidate_count": n,
        "candidate_hash": F.when(n > 1, F.col("__hash").cast("string")),
    }).drop("__n", "__one", "__hash")


def _keyed(names: DataFrame, name: str) -> DataFrame:
    keyed = names.withColumn("__t", TX.ingest_name_tokens(F.col(name))).withColumn("__k", _key(F.col("__t")))
    return keyed.withColumns({"form": F.col("__k")["form"], "name_key": F.col("__k")["name_key"]}).drop("__k", "__t")


def resolve_names(names: DataFrame, players: DataFrame, name: str = "name") -> DataFrame:
    """Names with status, entity if single, and how many candidates there were."""
    matches = _counted(name_index(players), ["form", "name_key"])
    return _status(_keyed(names, name).join(matches, ["form", "name_key"], "left")).drop("form", "name_key")


def ambiguous_candidates(names: DataFrame, players: DataFrame, name: str = "name") -> DataFrame:
    """One row per candidate of each ambiguous name, for whoever decides."""
    index = name_index(players)
    several = _counted(index, ["form", "name_key"]).where(F.col("__n") > 1).select("form", "name_key")
    return _keyed(names, name).join(several, ["form", "name_key"], "left_semi").join(index, ["form", "name_key"]).drop("form", "name_key")


def crosswalk_identities(players: DataFrame, sources: dict[str, str]) -> DataFrame:
    """One resolved identity row per source id present on each player."""
    pairs = ", ".join(f"'{source}', cast(`{column}` as string)" for source, column in sources.items())
    tall = players.select("entity_id", F.col("full_name").alias("external_name"), F.expr(f"stack({len(sources)}, {pairs}) as (source, external_id)"))
    return tall.where(F.col("external_id").isNotNull() & (F.col("external_id") != "")).withColumn("status", F.lit("resolved"))


IDENTITY_KEY = ["source", "external_id", "external_name"]


def identity_upsert(current: DataFrame, incoming: DataFrame) -> Merge:
    """Never overwrites a manual override."""
    return upsert_if_distinct(
        current, incoming, IDENTITY_KEY, ["entity_id", "status", "candidate_count", "candidate_hash"],
        protect=F.col("__cur")["status"] == "manual_override",
    )


def parse_markets(markets: DataFrame) -> DataFrame:
    """Every market parsed; what cannot be parsed is NULL, never dropped."""
    parts = TX.event_ticker_parts(F.col("event_ticker"))
    parsed = markets.withColumn("__e", parts)
    return parsed.select(
        *markets.columns,
        TX.market_player_name(F.col("yes_sub_title"), F.col("title")).alias("player_name"),
        TX.series_stat_type(F.col("series")).alias("stat_type"),
        TX.market_threshold(F.col("floor_strike"), F.col("yes_sub_title"), F.col("title")).alias("threshold"),
        F.col("__e")["game_date"].alias("game_date"),
        F.col("__e")["away_code"].alias("away_code"),
        F.col("__e")["home_code"].alias("home_code"),
    )


def match_events(parsed: DataFrame, events: DataFrame) -> DataFrame:
    """Parsed rows with the event of both teams kicking off within two days.

    The date window spans at most three calendar days, so each event offers
    itself under each day that could name it and the match is an equi-join.
    ``events``: event_id, kickoff_at, home_team, away_team.
    """
    day = F.to_date("kickoff_at")
    offered = events.select(
        F.col("event_id"), F.col("kickoff_at"), F.col("home_team").alias("__home"), F.col("away_team").alias("__away"),
        F.explode(F.array(day, F.date_sub(day, 1))).alias("__date"),
    )
    asked = parsed.select("ticker", "game_date", TX.canonical_team(F.col("away_code")).alias("__away"), TX.canonical_team(F.col("home_code")).alias("__home"))
    found = asked.join(offered, [asked.game_date == offered["__date"], asked["__away"] == offered["__away"], asked["__home"] == offered["__home"]])
    first = found.groupBy("ticker").agg(F.min_by("event_id", F.struct("kickoff_at", "event_id")).alias("event_id"))
    return parsed.join(first, "ticker", "left")


def player_index(players: DataFrame) -> DataFrame:
    """Each name form that markets use, with how many players bear it: what :func:`resolve_contracts` and :func:`new_mappings` look names up in."""
    return _counted(players.select("entity_id", TX.market_name(F.col("full_name")).alias("wanted")).where("wanted <> ''"), ["wanted"])


def resolve_contracts(parsed: DataFrame, events: DataFrame, players: DataFrame, mappings: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Contracts with entity, event, status and the note saying what failed.

    ``mappings``: external_name, entity_id, status, updated_at; an existing
    mapping wins outright, manual overrides first. Otherwise only exact equality
    of normalised full names matches. ``index``: the players' :func:`player_index`, if it is at hand.
    """
    usable = mappings.where(F.col("status").isin("resolved", "manual_override") & F.col("entity_id").isNotNull())
    settled = usable.groupBy(F.col("external_name").alias("player_name")).agg(
        F.max_by(
            F.struct(F.col("entity_id").alias("mapped_id"), F.col("status").alias("mapped_status")),
            F.struct((F.col("status") == "manual_override").alias("m"), "updated_at", "entity_id"),
        ).alias("m")
    ).select(F.col("player_name").alias("__mapped_name"), "m.*")
    index = player_index(players) if index is None else index
    dated = match_events(parsed, events)
    # A listing without a name asks under one of its own, so that these don't meet in one task.
    alone = F.concat(F.lit("\x00"), "ticker")
    staged = dated.withColumns({"__asked": F.coalesce("player_name", alone), "wanted": F.coalesce(TX.market_name(F.col("player_name")), alone)})
    staged = staged.join(settled, F.col("__asked") == F.col("__mapped_name"), "left").drop("__asked", "__mapped_name").join(index, "wanted", "left")
    n = F.coalesce("__n", F.lit(0))
    mapped, named = F.col("mapped_id").isNotNull(), F.col("player_name").isNotNull()
    entity = F.when(mapped, F.col("mapped_id")).when(named & (n == 1), F.col("__one"))
    person = F.when(mapped, F.col("mapped_status")).when(named & (n == 1), "resolved").when(named & (n > 1), "ambiguous").otherwise("unresolved")
    staged = staged.withColumns({"entity_id": entity, "__person": person})
    full = F.col("entity_id").isNotNull() & F.col("event_id").isNotNull() & F.col("stat_type").isNotNull() & F.col("threshold").isNotNull()
    status = (
        F.when(full & (F.col("__person") == "manual_override"), "manual_override").when(full, "resolved")
        .when(F.col("__person") == "ambiguous", "ambiguous").otherwise("unresolved")
    )
    dateless = F.col("game_date").isNull() | F.col("away_code").isNull() | F.col("home_code").isNull()
    note = F.concat_ws(
        "; ",
        F.when(F.col("stat_type").isNull(), F.format_string("stat: series %s has none", F.col("series"))),
        F.when(F.col("threshold").isNull(), F.lit("threshold: none given")),
        F.when(dateless, F.format_string("event: no date and teams in %s", F.col("event_ticker"))).when(
            F.col("event_id").isNull(),
            F.format_string("event: none of %s at %s near %s", TX.canonical_team(F.col("away_code")),
                            TX.canonical_team(F.col("home_code")), F.col("game_date").cast("string")),
        ),
        F.when(~named, F.lit("player: none named")).when(
            ~mapped & (n != 1), F.format_string("player: %d are called %s", n, F.col("player_name"))
        ),
    )
    return staged.withColumns({"resolution_status": status, "resolution_note": F.nullif(note, F.lit(""))}).drop(
        "__person", "wanted", "__n", "__one", "__hash", "mapped_id", "mapped_status"
    )


def new_mappings(resolved: DataFrame, players: DataFrame, source: str = "market", index: DataFrame | None = None) -> DataFrame:
    """Identity rows to record for the names a resolution pass looked up."""
    names = resolved.where(F.col("player_name").isNotNull()).select("player_name").distinct()
    index = player_index(players) if index is None else index
    out = names.withColumn("wanted", TX.market_name(F.col("player_name"))).join(index, "wanted", "left")
    return _status(out.drop("wanted")).select(
        F.lit(source).alias("source"), F.col("player_name").alias("external_id"), F.col("player_name").alias("external_name"),
        "entity_id", "status", "candidate_count", "candidate_hash",
    )


def apply_overrides(mappings: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual corrections for future reads: latest override per name on top."""
    chosen = TL.latest_per_key(overrides, ["external_name"], ["updated_at", "entity_id"]).withColumn("status", F.lit("manual_override"))
    rest = mappings.join(chosen.select("external_name"), "external_name", "left_anti")
    return rest.unionByName(chosen, allowMissingColumns=True)


def overridden_contracts(contracts: DataFrame, overrides: DataFrame) -> DataFrame:
    """The contracts an admin corrected: the entity changes, nothing else does."""
    latest = TL.latest_per_key(overrides, ["ticker"], ["updated_at", "entity_id"]).select("ticker", F.col("entity_id").alias("__e"))
    joined = contracts.join(latest, "ticker", "left")
    touched = F.col("__e").isNotNull()
    ready = F.col("event_id").isNotNull() & F.col("stat_type").isNotNull() & F.col("threshold").isNotNull()
    return joined.withColumns({
        "entity_id": F.coalesce("__e", "entity_id"),
        "resolution_status": F.when(touched & ready, "manual_override").when(touched, "unresolved").otherwise(F.col("resolution_status")),
        "resolution_note": F.when(touched & ready, F.lit(None)).when(
            touched, "player: set by hand; event, stat or threshold: still missing"
        ).otherwise(F.col("resolution_note")),
    }).drop("__e")
