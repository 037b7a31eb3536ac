import datetime as dt

import pytest

from pyspark.sql import functions as F

from cutline.operators import bitemporal as B
from cutline.streaming import ingest as SI
from cutline.streaming import prices as SP
from tests.test_market import BOOK, NOW, books, keep

FACTS = "entity_id long, event_id long, team string, yards double, valid_at timestamp, arrived_at timestamp"
VERSIONS = "entity_id long, event_id long, team string, yards double, version int, valid_at timestamp, known_at timestamp, prior_values map<string,double>, corrected_values map<string,double>"


def feed(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}")


def stream(spark, schema, path):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))


def run(spark, schema, src, sink, checkpoint):
    SI.run_available(stream(spark, schema, src), sink, str(checkpoint))


def test_compaction_over_micro_batches_in_any_order(spark, tmp_path):
    rows = sorted(books(8, 160), key=lambda r: (r[2], r[1]))
    src, root = tmp_path / "in", str(tmp_path / "out")
    sink = SP.compaction_batch(root, 60)
    feed(spark, rows[1::2], BOOK, src, "a")
    run(spark, BOOK, src, sink, tmp_path / "cp")
    feed(spark, rows[::2], BOOK, src, "b")  # every row of it is late
    run(spark, BOOK, src, sink, tmp_path / "cp")
    sink(spark.read.schema(BOOK).parquet(f"{src}/b"), 1)  # replayed
    kept = SI.derived(spark, root, SP.BOOK_SCHEMA, ["contract_id"], "contract_id long", SP.BOOK_CLOCK)
    assert sorted(r.observation_id for r in kept.collect()) == keep(rows, 60)


def test_a_late_transition_is_written(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "out")
    sink = SP.transition_batch(root)
    day = lambda d: NOW + dt.timedelta(days=d)
    feed(spark, [(1, day(0), 1, True, "yes"), (1, day(9), 3, True, "yes"), (2, day(1), 7, False, None)], SP.STATE_SCHEMA, src, "a")
    run(spark, SP.STATE_SCHEMA, src, sink, tmp_path / "cp")
    feed(spark, [(1, day(3), 2, False, None)], SP.STATE_SCHEMA, src, "b")
    run(spark, SP.STATE_SCHEMA, src, sink, tmp_path / "cp")
    found = SI.derived(spark, root, SP.TRANSITION_SCHEMA, ["contract_id"], "contract_id long").orderBy("seq").collect()
    assert [(r.seq, r.trigger) for r in found] == [(1, "appeared"), (2, "state_changed"), (3, "state_changed")]


def test_late_facts_become_corrections_and_leave_earlier_answers(spark, tmp_path):
    at = dt.datetime(2023, 9, 10, 17)
    src, root = tmp_path / "in", str(tmp_path / "table")
    sink = SI.correction_batch(root, FACTS, ["yards"])
    fixed_at, later = at + dt.timedelta(days=30), at + dt.timedelta(days=40)
    feed(spark, [(1, 1, "KC", 50.0, at, at + dt.timedelta(days=1)), (2, 1, "DET", 9.0, at, at + dt.timedelta(days=1)), (1, 1, "KC", 60.0, at, later)], FACTS, src, "a")
    run(spark, FACTS, src, sink, tmp_path / "cp")
    feed(spark, [(1, 1, "KC", 55.0, at, fixed_at), (2, 1, "DET", 9.0, at, fixed_at)], FACTS, src, "b")
    run(spark, FACTS, src, sink, tmp_path / "cp")

    def versions():
        return SI.derived(spark, root, VERSIONS, ["entity_id", "event_id"], "entity_id long, event_id long")

    log = sorted((r.entity_id, r.version, r.prior_values["yards"], r.known_at) for r in SI.correction_log(versions()).collect())
    assert log == [(1, 2, 50.0, fixed_at), (1, 3, 55.0, later)]
    assert {r.entity_id: (r.yards, r.version) for r in SI.current_lines(versions()).collect()} == {1: (60.0, 3), 2: (9.0, 1)}
    sink(spark.read.schema(FACTS).parquet(f"{src}/b"), 1)  # a replay changes nothing
    assert SI.correction_log(versions()).count() == 2
    line = spark.createDataFrame([(1, 1, "m", 2023, "KC", "WR", at, at + dt.timedelta(hours=20), 55.0)],
                                 "entity_id long, event_id long, measure string, season int, team string, position string, valid_at timestamp, published_at timestamp, value double")
    corr = spark.createDataFrame([(1, 1, "m", 2, fixed_at, True, 50.0)], "entity_id long, event_id long, measure string, version int, known_at timestamp, has_prior boolean, prior_value double")
    v = B.value_versions(line, corr)
    read = lambda d: [r.value for r in B.visible(v, F.lit(at + dt.timedelta(days=d))).collect()]
    assert read(0) == [] and read(5) == [50.0] and read(31) == [55.0]


def test_an_observation_is_never_too_late(spark, tmp_path):
    schema = "entity_id long, event_id long, context_type string, known_at timestamp, source string"
    src, root = tmp_path / "in", str(tmp_path / "t")
    sink = SI.append_batch(root, schema, SI.OBSERVATION_KEY)
    for k, days in enumerate((0, 1, -40)):
        feed(spark, [(1, 1, "injury", NOW + dt.timedelta(days=days), "s"), (1, 1, "injury", NOW, "s")], schema, src, f"f{k}")
        run(spark, schema, src, sink, tmp_path / "cp")
    assert SI.appended(spark, root, schema, SI.OBSERVATION_KEY).count() == 3


def test_the_first_state_in_the_window_is_captured_whole(spark, tmp_path):
    schema = "contract_id long, at timestamp, kickoff_at timestamp, seq long"
    src, root, minute = tmp_path / "in", str(tmp_path / "t"), dt.timedelta(minutes=1)
    sink = SP.final_capture_batch(root, schema, order=("seq",))
    feed(spark, [(1, NOW - 20 * minute, NOW, 2), (1, NOW - 300 * minute, NOW, 1), (2, NOW + minute, NOW, 9)], schema, src, "a")
    run(spark, schema, src, sink, tmp_path / "cp")
    feed(spark, [(1, NOW - 30 * minute, NOW, 3)], schema, src, "b")
    run(spark, schema, src, sink, tmp_path / "cp")
    assert [(r.contract_id, r.seq) for r in SI.derived(spark, root, schema, ["contract_id"], "contract_id long").collect()] == [(1, 3)]


def test_append_batch_only_adds_new_keys(spark, tmp_path):
    schema = "entity_id long, known_at timestamp"
    sink = SI.append_batch(str(tmp_path / "t"), schema, ["entity_id", "known_at"])
    one = spark.createDataFrame([(1, NOW), (1, NOW)], schema)
    two = spark.createDataFrame([(1, NOW), (1, NOW + dt.timedelta(days=1))], schema)
    sink(one, 0)
    sink(two, 1)
    sink(two, 1)
    assert SI.appended(spark, str(tmp_path / "t"), schema, ["entity_id", "known_at"]).count() == 2


def test_a_micro_batch_reads_the_parts_it_touches(spark, tmp_path):
    """Twenty micro-batches: the last lists its own part only, as one base and the batches since."""
    schema = "entity_id long, known_at timestamp"
    sink = SI.append_batch(str(tmp_path / "t"), schema, ["entity_id", "known_at"], parts=16, compact_after=4)
    batches = [[(b % 3, NOW), (b % 3, NOW + dt.timedelta(days=b))] for b in range(20)]
    for b, rows in enumerate(batches):
        sink(spark.createDataFrame(rows, schema), b)
    parts = sink.table.parts_of(spark.createDataFrame(batches[-1], schema))
    found = sink.table.read(spark, parts, before=19)
    assert {f.split("/part=")[1].split("/")[0] for f in found.inputFiles()} <= {str(p) for p in parts} and len(parts) <= 2
    upto = sink.table.compacted(spark, parts)
    assert any(u >= 12 for u in upto.values())
    assert {(r.part, r.batch) for r in found.select("part", "batch").distinct().collect()} <= {(p, b) for p in parts for b in range(upto.get(p, 0), 20)}
    assert sorted(map(tuple, SI.appended(spark, str(tmp_path / "t"), schema, ["entity_id", "known_at"], parts=16).collect())) == sorted({r for rows in batches for r in rows})


def test_compaction_goes_on_from_the_last_kept_book(spark, tmp_path):
    root, minute = str(tmp_path / "t"), dt.timedelta(minutes=1)
    sink = SP.compaction_batch(root, 60, parts=4, compact_after=2)
    rows = []
    for b in range(6):
        own = [(c, 100 * b + c, NOW + 40 * b * minute, 40 + (b // 3) % 2, 42, 50, 52) for c in ((1, 2, 3) if b % 2 else (1, 4))]
        if b == 4:
            own.append((1, 9_999, NOW + 100 * minute, 77, 78, 50, 52))  # long after its time
        rows += own
        sink(spark.createDataFrame(own, BOOK), b)
    kept = SI.derived(spark, root, SP.BOOK_SCHEMA, ["contract_id"], "contract_id long", SP.BOOK_CLOCK, parts=4)
    assert sorted(r.observation_id for r in kept.collect()) == keep(rows, 60)
    assert sink.state.results.upto and max(sink.state.results.upto.values()) >= 1


def test_results_count_once_they_are_complete(spark, tmp_path):
    """A batch that stops before its last write changes nothing; its replay does."""
    schema = "contract_id long, at timestamp, kickoff_at timestamp, seq long"
    root, minute = str(tmp_path / "t"), dt.timedelta(minutes=1)
    sink = SP.final_capture_batch(root, schema, order=("seq",))
    sink(spark.createDataFrame([(1, NOW - 20 * minute, NOW, 2)], schema), 0)
    late = spark.createDataFrame([(1, NOW - 30 * minute, NOW, 1)], schema)
    sink.state.results.write(late, 1)  # as if the job had ended here
    read = lambda: [r.seq for r in SI.derived(spark, root, schema, ["contract_id"], "contract_id long").collect()]
    assert read() == [2]
    sink(late, 1)
    assert read() == [1]


def test_a_broken_table_is_an_error(spark, tmp_path):
    table = SI.KeyedTable(str(tmp_path / "t"), "k long", ("k",))
    assert table.read(spark).count() == 0
    (tmp_path / "t" / "rows" / "part=0" / "batch=0").mkdir(parents=True)
    (tmp_path / "t" / "rows" / "part=0" / "batch=0" / "x.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        table.read(spark).collect()


def test_final_capture_query_keeps_both_edges_of_its_window(spark, tmp_path):
    """Waits of under a second have started, waits of over 45 minutes are to come, though by less than a microsecond."""
    from cutline.workload import stream_queries as SQ

    at = dt.datetime(2024, 1, 1)
    waits = {1: 0.01, 2: 1 / 60, 3: 45.0, 4: 45.01, 5: 45.000000001, 6: 0.0}
    rows = [(c, at, c, "view", v, None) for c, v in waits.items()] + [(10 + c, at + dt.timedelta(hours=1), c, "view", 20.0, None) for c in waits]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r.contract_id: r.seq for r in SQ.stream_final_capture(spark, str(tmp_path)).collect()}
    assert got == {1: 11, 2: 2, 3: 3, 4: 14, 5: 15, 6: 16}
