"""Streams into tables whose content does not depend on the order of arrival.

No watermark stands in front of a sink, so a row is never too late. Two sinks:
``append_batch`` appends rows whose key is new; ``rederive_batch`` stores every row
and works out the touched keys anew by a batch rule, so that a late row changes
the answer the way it would have, had it come in time.

Their tables are dealt by a hash of the key into parts, and each part into batches.
A micro-batch reads the parts of its own keys and lists no others; a part that has
gathered ``COMPACT_AFTER`` batches is rewritten as one. So what a micro-batch reads
depends on its keys and not on the length of the stream.

A replayed micro-batch rewrites its own partitions and nothing else. Folders of batches
that a rewrite has replaced are read by nothing and may be removed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cutline.operators import merges as MG
from cutline.operators import timeline as TL

OBSERVATION_KEY = ["entity_id", "event_id", "context_type", "known_at", "source"]
INVOCATION_KEY = ["category", "invocation_id"]
#: For a table on a cluster choose some hundreds; a table keeps the number it was made with.
PARTS = 16
COMPACT_AFTER = 16


def path_missing(error: AnalysisException) -> bool:
    """Whether a read failed because nothing was written there; any other failure is one."""
    return error.getCondition() == "PATH_NOT_FOUND"


@dataclass(frozen=True)
class KeyedTable:
    """Rows under ``root``, dealt to ``part`` by a hash of ``keys``, then to ``batch``.

    ``<root>/rows`` holds what each batch wrote, ``<root>/base`` a part's rows up to a batch as one.
    """

    root: str
    schema: str
    keys: tuple[str, ...]
    parts: int = PARTS
    upto: dict[int, int] = field(default_factory=dict, compare=False)

    def dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("part", F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int"))

    def parts_of(self, rows: DataFrame) -> list[int]:
        """The parts that hold the keys of ``rows``: ``parts`` numbers at most."""
        return sorted(r.part for r in self.dealt(rows.select(*self.keys)).select("part").distinct().collect())

    def write(self, rows: DataFrame, batch: int, where: str = "rows") -> None:
        placed = self.dealt(rows).withColumn("batch", F.lit(batch).cast("long")).hint("rebalance", "part")
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{self.root}/{where}")

    def _scan(self, spark: SparkSession, where: str, parts: list[int] | None) -> DataFrame | None:
        base = f"{self.root}/{where}"
        paths = [base] if parts is None else [f"{base}/part={p}" for p in parts]
        try:
            return spark.read.schema(f"{self.schema}, part int, batch long").option("basePath", base).parquet(*paths) if paths else None
        except AnalysisException as error:
            if not path_missing(error):
                raise
        if parts is None:
            return None
        # Some of the parts are new: list all that there are, once.
        every = self._scan(spark, where, None)
        return None if every is None else every.where(F.col("part").isin(parts))

    def compacted(self, spark: SparkSession, parts: list[int] | None) -> dict[int, int]:
        """Up to which batch each part is held in ``base``; looked up once for each part."""
        unknown = None if parts is None else [p for p in parts if p not in self.upto]
        if unknown is None or unknown:
            base = self._scan(spark, "base", unknown)
            held = {} if base is None else {r.part: r.upto for r in base.groupBy("part").agg(F.max("batch").alias("upto")).collect()}
            self.upto.update(held if parts is None else {p: held.get(p, -1) for p in unknown})
        return {p: u for p, u in self.upto.items() if u >= 0 and (parts is None or p in parts)}

    def read(self, spark: SparkSession, parts: list[int] | None = None, before: int | None = None) -> DataFrame:
        """Rows of ``parts`` (all, if none are named) that batches under ``before`` wrote, with ``part`` and ``batch``."""
        upto = self.compacted(spark, parts)
        fresh = self._scan(spark, "rows", parts)
        if fresh is None:
            fresh = spark.createDataFrame([], f"{self.schema}, part int, batch long")
        if before is not None:
            fresh = fresh.where(F.col("batch") < before)
        if not upto:
            return fresh
        base = self._scan(spark, "base", sorted(upto))
        newest, replaced = F.lit(False), F.lit(False)
        for p, u in upto.items():
            newest = newest | ((F.col("part") == p) & (F.col("batch") == u))
            replaced = replaced | ((F.col("part") == p) & (F.col("batch") <= u))
        return base.where(newest).unionByName(fresh.where(~replaced))

    def compact(self, spark: SparkSession, parts: list[int], batch: int, after: int, current: Callable[[list[int]], DataFrame] | None = None) -> None:
        """Rewrite those of ``parts`` as one that hold ``after`` batches before ``batch``; the rows of ``batch`` itself are not in it."""
        upto = self.compacted(spark, parts)
        old = [p for p in parts if batch - 1 - upto.get(p, -1) >= after]
        if not old:
            return
        rows = current(old) if current else self.read(spark, old, before=batch).drop("part", "batch")
        self.write(rows, batch - 1, "base")
        self.upto.update({p: batch - 1 for p in old})


def append_batch(root: str, schema: str, keys: list[str], order: list[str] | None = None, parts: int = PARTS, compact_after: int = COMPACT_AFTER):
    """foreachBatch sink appending only rows whose key is new, however late. Read it with ``appended``.

    Of the rows of one batch with one key the first by ``order`` stays (by default
    the order of all other columns).
    """
    table = KeyedTable(root, schema, tuple(keys), parts)

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        touched = table.parts_of(batch)
        table.compact(spark, touched, batch_id, compact_after)
        stored = table.read(spark, touched, before=batch_id).drop("part", "batch")
        by = order or [c for c in batch.columns if c not in keys] or keys
        table.write(MG.append_if_new(stored, batch, keys, by).log, batch_id)

    sink.table = table
    return sink


def appended(spark: SparkSession, root: str, schema: str, keys: list[str], parts: int = PARTS) -> DataFrame:
    """All rows of an ``append_batch`` table."""
    return KeyedTable(root, schema, tuple(keys), parts).read(spark).drop("part", "batch")


def _columns(schema: str) -> list[str]:
    return [c.strip().split()[0] for c in schema.split(", ")]


@dataclass(frozen=True)
class Derived:
    """What a ``rederive_batch`` sink keeps: all rows, results, and what each batch replaced.

    A batch's ``touched`` row says that its results replace those of the key from ``since`` on
    (NULL: all of them). It is written last: until then the results of a batch count for nothing,
    and the earlier ones stand.
    """

    root: str
    schema: str
    keys: tuple[str, ...]
    key_schema: str
    clock_schema: str = ""
    parts: int = PARTS

    @property
    def clock(self) -> list[str]:
        return _columns(self.clock_schema) if self.clock_schema else []

    @cached_property
    def results(self) -> KeyedTable:
        return KeyedTable(f"{self.root}/derived", self.schema, self.keys, self.parts)

    @cached_property
    def touched(self) -> KeyedTable:
        fields = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in self.clock_schema.split(", ")) if self.clock_schema else "none: boolean"
        return KeyedTable(f"{self.root}/touched", f"{self.key_schema}, since struct<{fields}>", self.keys, self.parts)

    def current(self, spark: SparkSession, parts: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The results that stand. A key has at most one replacement for each batch since its part was last rewritten."""
        results = self.results.read(spark, parts, before)
        from_base = F.lit(False)
        for p, u in self.results.compacted(spark, parts).items():
            from_base = from_base | ((F.col("part") == p) & (F.col("batch") <= u))
        touches = self.touched.read(spark, parts, before).where(~from_base)
        touches = touches.groupBy(*self.keys).agg(F.collect_list(F.struct("batch", "since")).alias("touches"))
        at = F.struct(*self.clock) if self.clock else None

        def replaces(t):
            later = t["batch"] > F.col("batch")
            return later if at is None else later & (t["since"].isNull() | (t["since"] <= at))

        own = lambda t: t["batch"] == F.col("batch")
        joined = results.withColumn("based", from_base).join(touches, list(self.keys), "left")
        complete = F.col("based") | F.coalesce(F.exists("touches", own), F.lit(False))
        return joined.where(complete & ~F.coalesce(F.exists("touches", replaces), F.lit(False))).select(*_columns(self.schema))


def rederive_batch(
    root: str, schema: str, keys: list[str], derive: Callable[[DataFrame], DataFrame], out_schema: str | None = None,
    clock: list[str] | None = None, parts: int = PARTS, compact_after: int = COMPACT_AFTER,
):
    """foreachBatch sink that stores all rows and derives the touched keys from theirs. Read it with ``derived``.

    With ``clock`` (columns of rows and results alike, which order a key's rows) a key is derived from
    its last result before the earliest row that came, which ``derive`` must keep as
    the first of its rows and need nothing before; the results before it stand.
    """
    types = {c.strip().split()[0]: c.strip() for c in schema.split(", ")}
    clock_schema = ", ".join(types[c] for c in clock) if clock else ""
    rows_table = KeyedTable(f"{root}/rows", schema, tuple(keys), parts)
    state = Derived(root, out_schema or schema, tuple(keys), ", ".join(types[k] for k in keys), clock_schema, parts)
    results, touched_table = state.results, state.touched

    def since(spark: SparkSession, batch: DataFrame, found: list[int], batch_id: int) -> DataFrame:
        at = F.struct(*clock)
        first = batch.groupBy(*keys).agg(F.min(at).alias("first"))
        kept = state.current(spark, found, before=batch_id).join(first, keys).where(at < F.col("first"))
        return first.join(kept.groupBy(*keys).agg(F.max(at).alias("last")), keys, "left").select(*keys, F.coalesce("last", "first").alias("since"))

    def sink(batch: DataFrame, batch_id: int) -> None:
        from cutline.session import materialize

        spark = batch.sparkSession
        found = rows_table.parts_of(batch)
        if not found:
            return
        rows_table.compact(spark, found, batch_id, compact_after)
        results.compact(spark, found, batch_id, compact_after, lambda p: state.current(spark, p, before=batch_id))
        rows_table.write(batch, batch_id)
        rows = rows_table.read(spark, found, before=batch_id + 1).drop("part", "batch")
        if clock:
            touched = materialize(since(spark, batch, found, batch_id), "since")
            lowest = touched.agg(F.min(F.col("since")[clock[0]])).first()[0]
            # A literal, so that files and row groups of earlier times are skipped.
            rows = rows.where(F.col(clock[0]) >= F.lit(lowest)).join(touched, keys).where(F.struct(*clock) >= F.col("since")).drop("since")
        else:
            touched = batch.select(*keys).distinct()
            rows = rows.join(touched, keys, "left_semi")
            touched = touched.withColumn("since", F.lit(None).cast("struct<none: boolean>"))
        results.write(derive(rows).select(*_columns(state.schema)), batch_id)
        touched_table.write(touched, batch_id)

    sink.rows, sink.state = rows_table, state
    return sink


def derived(spark: SparkSession, root: str, schema: str, keys: list[str], key_schema: str, clock_schema: str = "", parts: int = PARTS) -> DataFrame:
    """The current results of a ``rederive_batch`` sink."""
    return Derived(root, schema, tuple(keys), key_schema, clock_schema, parts).current(spark)


def arrival_versions(arrivals: DataFrame, measures: list[str], arrived_at: str = "arrived_at", keys: tuple[str, str] = ("entity_id", "event_id")) -> DataFrame:
    """Every version of each line: its first arrival, then each arrival that differs from the one before it.

    The first is known from its publication, a correction from its own arrival, so
    no as-of read at an earlier cutoff can change. Keeps both snapshots of a correction.
    A window spans one line.
    """
    from cutline.functions import times

    line = Window.partitionBy(*keys).orderBy(arrived_at, *measures)
    rows = arrivals.withColumn("__nth", F.row_number().over(line)).withColumn("__prev", F.lag(F.struct(*measures)).over(line))
    differs = F.lit(False)
    for m in measures:
        differs = differs | ~F.col(m).eqNullSafe(F.col("__prev")[m])
    first = F.col("__nth") == 1
    kept = rows.where(first | differs)
    snapshot = lambda side: F.create_map(*[x for m in measures for x in (F.lit(m), side(m).cast("double"))])
    return kept.select(
        *keys, "team", *measures, F.row_number().over(line).alias("version"), "valid_at",
        F.when(first, times.published_at(F.col("valid_at"))).otherwise(F.col(arrived_at)).alias("known_at"),
        F.when(~first, snapshot(lambda m: F.col("__prev")[m])).alias("prior_values"),
        F.when(~first, snapshot(F.col)).alias("corrected_values"),
    )


def correction_batch(root: str, schema: str, measures: list[str], arrived_at: str = "arrived_at"):
    """foreachBatch sink for late facts: every arrival of a touched line, in the order of arrival, whatever the micro-batches."""
    kinds = {c.strip().split()[0]: c.strip() for c in schema.split(", ")}
    versions = ", ".join(["entity_id long", "event_id long", kinds["team"], *[kinds[m] for m in measures], "version int", "valid_at timestamp", "known_at timestamp",
                          "prior_values map<string,double>", "corrected_values map<string,double>"])
    return rederive_batch(root, schema, ["entity_id", "event_id"], lambda rows: arrival_versions(rows, measures, arrived_at), versions)


def current_lines(versions: DataFrame) -> DataFrame:
    return TL.latest_per_key(versions, ["entity_id", "event_id"], ["version"]).drop("prior_values", "corrected_values")


def correction_log(versions: DataFrame) -> DataFrame:
    return versions.where("prior_values is not null").select("entity_id", "event_id", "version", "prior_values", "corrected_values", "known_at")


def run_available(stream: DataFrame, sink, checkpoint: str) -> None:
    """Drive a foreachBatch stream over what is there now, then stop."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
