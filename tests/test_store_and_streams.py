import random
import time
from datetime import datetime

from pyspark.sql import functions as F

from claimweave.operators import aggregates, fingerprints, ranking, windows
from claimweave.session import scratch_path
from claimweave.sources import sinks
from claimweave.streaming import admission, logs, tables as stream_tables
from tests.conftest import rows


def tables(spark, bump=0):
    a = spark.range(500).select(F.col("id"), F.concat(F.lit("é"), F.col("id") + bump).alias("name"), F.current_timestamp().alias("searched_at"))
    b = spark.range(40).select(F.col("id"), (F.col("id") % 3).alias("k"))
    return {"a": a, "b": b}


LEAVE = {"a": ("searched_at",)}


def test_snapshot_id_ignores_order_partitioning_and_times(spark):
    ids = {sinks.package({k: v.repartition(n).orderBy(F.rand(n)) for k, v in tables(spark).items()}, LEAVE)[0] for n in (1, 7, 64)}
    assert len(ids) == 1 and ids != {sinks.package(tables(spark, 1), LEAVE)[0]}
    doubled = {**tables(spark), "b": tables(spark)["b"].union(tables(spark)["b"].limit(1))}
    assert sinks.package(doubled, LEAVE)[0] not in ids


def test_publish_is_idempotent_and_notices_corruption(spark):
    store = sinks.Store(spark, scratch_path(spark, "store"))
    first, outcome = store.publish(tables(spark), LEAVE)
    assert outcome == "published" and store.publish(tables(spark), LEAVE) == (first, "unchanged")
    second, outcome = store.publish(tables(spark, 5), LEAVE)
    assert outcome == "published" and second != first and store.commits().select("snapshot").distinct().count() == 2
    assert sinks.load_problems(spark, store.base, first, {"a": "id", "b": "id"}, LEAVE).count() == 0
    spark.range(1).select(F.lit(9999).cast("bigint").alias("id"), F.lit(1).cast("bigint").alias("k")).write.mode("append").parquet(f"{store.base}/b/snapshot_id={first}")
    assert store.publish(tables(spark), LEAVE) == (first, "corrupt")
    assert sinks.load_problems(spark, store.base, first, {"a": "id", "b": "id"}, LEAVE).count() == 1


def test_jsonl_is_sorted_and_complete(spark):
    path = scratch_path(spark, "jsonl")
    df = spark.createDataFrame([("b", None), ("a", "é")], "id string, v string")
    sinks.write_jsonl(df, path, "id")
    assert rows(spark.read.text(path)) == [('{"id":"a","v":"é"}',), ('{"id":"b","v":null}',)]


def test_merkle_null_when_child_dangles(spark):
    child = spark.createDataFrame([(1, "x")], "k int, hash string")
    parent = spark.createDataFrame([(10, 1), (11, 2), (12, None)], "id int, ref int")
    got = dict(rows(fingerprints.with_dependencies(parent, "id", fingerprints.row_hash(parent), {"ref": (child, "k")})))
    assert got[10] and got[11] is None and got[12]


def test_running_total_in_blocks(spark):
    rng = random.Random(1)
    data = [(k, i, rng.randrange(10)) for k in "ab" for i in rng.sample(range(100), 60)]
    df = spark.createDataFrame(data, "k string, i int, v int")
    got = {(r.k, r.i): r.t for r in windows.running_total(df, ["k"], "i", F.col("v"), "t", block=7).collect()}
    assert all(got[(k, i)] == sum(v for kk, j, v in data if kk == k and j < i) for k, i, _ in data)


def test_families_sharing_cohorts_count_once(spark):
    data = [("c", "f1", "x"), ("c", "f2", "x"), ("c", "f2", "y"), ("c", "f3", "y"), ("c", "f4", None), ("c", "f5", "z"), ("d", "f1", "q")]
    df = spark.createDataFrame(data, "ctx string, family string, cohort string")
    assert rows(aggregates.independent_publications(df, ["ctx"])) == [("c", 5, 3), ("d", 1, 1)]


def test_order_statistics(spark):
    rng = random.Random(4)
    for values in ([rng.random() for _ in range(3000)], [1.0] * 2000 + [rng.random() for _ in range(1000)], [5.0] * 50):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = aggregates.order_statistics(df, "v", {"p95": F.floor(F.lit(0.95) * F.col("n")) - 1, "lo": F.lit(0)}, enough=100)
        assert got == {"p95": sorted(values)[int(0.95 * len(values)) - 1], "lo": min(values)}


def test_retrieval_matches_brute_force(spark):
    names = [("e1", "red bolt"), ("e2", "red bolt"), ("e3", "red nut big"), ("e4", "blue"), ("e5", "Red"), ("e6", "bolt red"), ("e1", "crimson bolt"), ("e7", "red red")]
    got = rows(ranking.retrieve(spark.createDataFrame([("Red bolt",), ("zzz",)], "mention string"), spark.createDataFrame(names, "entity string, alias string"), 3), "rank", "entity")
    want, q = {}, {"red", "bolt"}
    for e, a in names:
        t = set(a.lower().split())
        want[e] = max(want.get(e, 0), len(q & t) / len(q | t))
    order = [e for e, s in sorted(want.items(), key=lambda kv: (-kv[1], kv[0])) if s > 0][:3]
    assert [e for _, e in got] == order


def replay(hits, window, limit):
    kept, out = {}, []
    for at, hit, client in sorted((a, h, c) for c, h, a in hits):
        kept[client], ok, wait = admission.decide(kept.get(client, []), at, window, limit)
        out.append((client, hit, ok, wait))
    return sorted(out)


def test_admission_batch_and_stream_match_replay(spark, folder):
    rng = random.Random(2)
    hits = [(rng.randrange(4), i, round(rng.uniform(0, 3000), 2)) for i in range(400)] + [(9, 1000 + i, i * 0.5) for i in range(300)]
    df = spark.createDataFrame(hits, "client bigint, hit bigint, at double")
    want = replay(hits, 60.0, 3)
    assert rows(admission.admission_batch(df, 60.0, 3), "client", "hit", "admitted", "wait") == want
    ordered = sorted(hits, key=lambda h: h[2])
    for i, part in enumerate((ordered[:350], ordered[350:])):  # two micro-batches in time order
        spark.createDataFrame(part, df.schema).coalesce(1).write.parquet(str(folder / f"in/day={i}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in/day=*"))
    got = logs.drain(admission.admission_stream(stream, 60.0, 3), "admission")
    assert rows(got, "client", "hit", "admitted", "wait") == want


def source(spark, folder, schema, batches):
    """A stream of one micro-batch per list of rows."""
    for i, part in enumerate(batches):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(folder / f"in/part={i}"))
        time.sleep(0.05)  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in/part=*"))


def test_bulk_decisions_equal_single_ones():
    rng = random.Random(8)
    for limit in (0, 1, 3):
        at = sorted(round(rng.uniform(0, 300), 2) for _ in range(200))
        recent, want = [], []
        for t in at:
            recent, ok, wait = admission.decide(recent, t, 60.0, limit) if limit else ([], False, 1)
            want.append((ok, wait))
        _, ok, waits = admission.decide_all([], at, 60.0, limit)
        assert list(zip(ok, waits, strict=True)) == want


def test_idle_clients_leave_no_state(spark, folder):
    early = [(c, c * 10 + i, float(i)) for c in range(20) for i in range(3)]
    late = [(99, 1000, 5000.0)]
    stream = source(spark, folder, "client bigint, hit bigint, at double", [early, late, [(99, 1001, 9000.0)]])
    seen = []

    def write(batch, batch_id):
        seen.append(batch.count())

    query = logs.run_batches(admission.admission_stream(stream, 60.0, 2), "append", write, str(folder / "checkpoint"))
    assert seen[:3] == [60, 1, 1]
    state = spark.read.format("statestore").option("stateVarName", "hits").load(str(folder / "checkpoint"))
    assert {r[0] for r in state.select("key.client").distinct().collect()} <= {99}
    assert query.lastProgress is not None


def test_latest_decisions_write_changed_keys_only(spark, folder):
    schema = "target_type string, target_id bigint, id bigint, reviewed_at string, decision string"
    first = [("a", k, k, f"2024-01-0{1 + k % 3}", "accepted") for k in range(50)]
    second = [("a", 1, 100, "2024-02-01", "rejected"), ("a", 2, 101, "2023-01-01", "rejected"), ("a", 3, 3, "2024-01-01", "accepted"), ("b", 1, 102, "2024-01-01", "accepted")]
    third = [("a", 1, 99, "2024-02-01", "accepted"), ("a", 4, 103, "2024-03-01", "rejected"), ("a", 4, 104, "2024-03-01", "accepted")]
    stream = source(spark, folder, schema, [first, second, third])
    table = stream_tables.UpsertTable(spark, str(folder / "table"), ["target_type", "target_id"])
    kept = {}

    def write(batch, batch_id):
        kept[batch_id] = batch.collect()
        table.write(batch, batch_id)

    logs.run_batches(logs.latest_changes(stream), "update", write, str(folder / "checkpoint"))
    changed = {b: sorted((r["target_type"], r["target_id"], r["id"]) for r in v) for b, v in kept.items() if v}
    assert [changed[b] for b in sorted(changed)][1:] == [[("a", 1, 100), ("b", 1, 102)], [("a", 4, 104)]]
    want = {}
    for row in sorted(first + second + third, key=lambda r: (r[3], r[2])):
        want[row[:2]] = row
    assert rows(table.current().drop("version"), "target_type", "target_id", "id", "reviewed_at", "decision") == sorted(want.values())
    before = rows(table.current())
    for batch_id in sorted(kept):  # a batch that is run again changes nothing
        table.write(spark.createDataFrame(kept[batch_id], schema_of(table)), batch_id)
        assert rows(table.current()) == before
    table.compact()
    assert rows(table.current()) == before
    table.write(spark.createDataFrame([("b", 1, "rejected")], "target_type string, target_id bigint, decision string").selectExpr("target_type", "target_id", "200L AS id", "'2025-01-01' AS reviewed_at", "decision"), max(kept) + 1)
    assert len(rows(table.current())) == len(before) and ("b", 1, 200) in rows(table.current(), "target_type", "target_id", "id")


def schema_of(table):
    return "target_type string, target_id bigint, id bigint, reviewed_at string, decision string"


def test_days_close_and_late_rows_are_kept(spark, folder):
    def charge(day, hour, amount):
        return (datetime(2024, 3, day, hour), float(amount))

    batches = [[charge(1, 3, 5), charge(1, 23, 7), charge(2, 1, 1)], [charge(4, 2, 2), charge(2, 5, 3)], [charge(1, 4, 100), charge(4, 3, 4)], [charge(9, 0, 8)]]
    ledger = stream_tables.DayLedger(spark, str(folder / "ledger"), "1 day")
    open_after, kept = [], {}

    def write(batch, batch_id):
        kept[batch_id] = batch.collect()
        ledger.write(batch, batch_id)
        open_after.append(sorted(r["day"].day for r in ledger.open_days().collect()))

    logs.run_batches(source(spark, folder, "at timestamp, amount double", batches), "append", write, str(folder / "checkpoint"))
    assert open_after == [[1, 2], [4], [4], [9]]  # state holds open days only
    closed = sorted((r["day"].day, r["spent"], r["charges"]) for r in ledger.closed_days().collect())
    assert closed == [(1, 12.0, 2), (2, 4.0, 2), (4, 6.0, 2)]
    assert [(r["at"].day, r["amount"]) for r in ledger.late_rows().collect()] == [(1, 100.0)]
    for batch_id in sorted(kept)[-2:]:  # replaying the last batches changes nothing
        ledger.write(spark.createDataFrame(kept[batch_id], "at timestamp, amount double"), batch_id)
    assert closed == sorted((r["day"].day, r["spent"], r["charges"]) for r in ledger.closed_days().collect())


def test_empty_batches_of_the_ledger(spark, folder):
    ledger = stream_tables.DayLedger(spark, str(folder / "ledger"), "1 day")
    none = spark.createDataFrame([], "at timestamp, amount double")
    ledger.write(none, 0)
    ledger.write(none, 1)
    assert ledger.closed_days().count() == ledger.open_days().count() == ledger.late_rows().count() == 0
