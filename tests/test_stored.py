"""Merges, sync runs, time slices and streams on literal rows."""

import hashlib
import os
import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shelfmark.functions import hashing as fh
from shelfmark.operators import events as E
from shelfmark.operators import media as M
from shelfmark.operators import remote as R
from shelfmark.operators import sync
from shelfmark.operators import audit
from shelfmark.plans import catalog, streams
from shelfmark.sources import fixtures, listing, store
from shelfmark.sources.fixtures import tables
from shelfmark.streaming import streams as S

ROWS = "account_id long, key string, value string"


def files_of(folder):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{folder}/data") for f in names if f.endswith(".parquet")}


def stored(spark, folder):
    return sorted((tuple(r) for r in store.read(spark, store.open_table(spark, folder)).collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    rows = [(a, f"k{k}", None if k % 7 == 0 else "v") for a in range(40) for k in range(5)] + [(99, f"k{k}", "hot") for k in range(300)] + [(None, "k", "v")]
    folder = str(tmp_path / "t")
    made = store.create(spark.createDataFrame(rows, ROWS), folder, ("account_id", "key"), buckets=16, giant=200)
    return folder, rows, made


def test_a_merge_rewrites_what_it_touches(spark, table):
    folder, rows, made = table
    assert stored(spark, folder) == sorted(rows, key=str) and made.giants == (99,)
    assert len({b for b in made.places}) == 16  # the giant account is in all buckets
    before = files_of(folder)
    change = spark.createDataFrame([(3, "k1", "new"), (3, "k2", "v"), (777, "k1", None), (None, "k", "w")], ROWS)
    after = store.merge(spark, folder, change)
    want = {(a, k): v for a, k, v in rows} | {(3, "k1"): "new", (777, "k1"): None, (None, "k"): "w"}
    assert stored(spark, folder) == sorted(((a, k, v) for (a, k), v in want.items()), key=str)
    moved = {b for b, v in after.places.items() if v == 1}
    assert 1 <= len(moved) <= 3 and before.items() <= files_of(folder).items()  # old files stay for readers


def test_a_second_merge_changes_no_file(spark, table):
    folder, _, _ = table
    change = spark.createDataFrame([(3, "k1", "new"), (5, "k9", None)], ROWS)
    store.merge(spark, folder, change)
    before, version = files_of(folder), store.open_table(spark, folder).version
    store.merge(spark, folder, change)
    store.merge(spark, folder, store.read(spark, store.open_table(spark, folder)))
    assert files_of(folder) == before and store.open_table(spark, folder).version == version


def test_keys_that_are_gone(spark, table):
    folder, rows, _ = table
    gone = spark.createDataFrame([(4, f"k{k}", None) for k in range(5)] + [(8, "none", None)], ROWS)
    store.merge(spark, folder, gone.limit(0), gone=gone)
    assert stored(spark, folder) == sorted((r for r in rows if r[0] != 4), key=str)


def test_accounts_that_are_gone_go_with_all_their_rows(spark, table):
    folder, rows, made = table
    names = "account_id long"
    before = files_of(folder)
    after = store.merge(spark, folder, spark.createDataFrame([(4, "k1", "new"), (5, "k1", "new")], ROWS), gone=spark.createDataFrame([(4,), (4,), (12345,)], names))
    want = [(*r[:2], "new" if r[:2] == (5, "k1") else r[2]) for r in rows if r[0] != 4]
    assert stored(spark, folder) == sorted(want, key=str)
    assert 1 <= len({b for b, v in after.places.items() if v == 1}) <= 2 and before.items() <= files_of(folder).items()
    store.merge(spark, folder, spark.createDataFrame([], ROWS), gone=spark.createDataFrame([(99,), (None,)], names))  # a giant, and rows of no account
    assert stored(spark, folder) == sorted((r for r in want if r[0] not in (99, None)), key=str)
    version = store.open_table(spark, folder).version
    store.merge(spark, folder, spark.createDataFrame([], ROWS), gone=spark.createDataFrame([(99,), (None,)], names))
    assert store.open_table(spark, folder).version == version


def test_of_two_merges_one_fails_and_readers_see_all_or_nothing(spark, table):
    folder, rows, made = table
    with pytest.raises(RuntimeError):
        store._switch(spark, made)  # version 0 is there
    assert stored(spark, folder) == sorted(rows, key=str)
    broken = spark.createDataFrame([(3, "k1", "x")], ROWS).withColumn("value", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        store.merge(spark, folder, broken)
    assert stored(spark, folder) == sorted(rows, key=str)


def test_vacuum_keeps_what_is_named(spark, table):
    folder, _, _ = table
    store.merge(spark, folder, spark.createDataFrame([(a, "k1", "new") for a in range(40)], ROWS))
    want, before = stored(spark, folder), files_of(folder)
    store.vacuum(spark, folder)
    assert stored(spark, folder) == want and len(files_of(folder)) < len(before) and len(os.listdir(f"{folder}/manifest")) in (1, 2)


@pytest.fixture(scope="module")
def run_tables(spark, tmp_path_factory):
    """The stand-in tables of a run, written, so that plans show their scans."""
    out, folder = [], tmp_path_factory.mktemp("run")
    for name, rows in zip(("listing", "remote_index", "held", "accounts"), tables(spark, "/root/testdata/sf0.001", "listing", "remote_index", "held", "accounts")):
        rows.write.parquet(f"{folder}/{name}")
        out.append(spark.read.schema(rows.schema).parquet(f"{folder}/{name}"))
    return out


def test_giant_accounts_plan_alike(spark, run_tables):
    plain, split = (catalog.run_of(*run_tables, limit) for limit in (10**9, 400))
    giants = sync.giant_accounts(run_tables[1].filter("remote_bytes > 25000"), run_tables[2], 400)
    assert 0 < giants.count() < run_tables[1].select("account_id").distinct().count()
    for name in ("index", "plan", "work"):
        a, b = getattr(plain, name), getattr(split, name)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.select(*a.columns).collect())), name


def test_a_run_deals_the_index_once(spark, run_tables):
    """Listing, cut-off, upsert, backlog and slice: the index is read once and moves once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        run = catalog.run_of(*run_tables)
        for frame in (run.work, run.index):
            plan = frame._jdf.queryExecution().executedPlan().toString()
            moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
            assert len(moved) == 1 and plan.count("remote_hash") > 0 and plan.count("/remote_index]") == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_limits_go_before_the_exchange(spark, run_tables):
    plan = catalog.R.pending_backlog(run_tables[1], run_tables[2], most=7)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_slices_of_any_length_agree(spark):
    rng = random.Random(5)
    start = 1_700_000_000
    rows, at = [], start
    for k in range(600):
        at += rng.choice((0, 1, 60, 1799, 1800, 1801, 4000, 90_000))
        rows.append((k, at if k % 97 else None, "error", 1 if rng.random() < 0.9 else 2, f"m {k}", None if k % 3 else f"d{k}", None if k % 4 else k))
    log = spark.createDataFrame(rows, "id long, at long, level string, account_id long, message string, detail string, job_id long")
    log = log.withColumns({"ts": F.timestamp_seconds("at").cast("timestamp_ntz"), "event": F.lit("e"), "error_type": F.lit("X"), "source": F.concat(F.lit("s"), "id"), "traceback": F.concat(F.lit("t"), "id"), "retryable": F.col("id") % 2 == 0, "resolved_at": F.lit(None).cast("timestamp_ntz")})
    runs = [sorted(map(str, E.coalesce_events(log, slice_seconds=n).collect())) for n in (60, 3600, 10**9)]
    assert runs[0] == runs[1] == runs[2] and 10 < len(runs[0]) < 600
    marks = log.filter("id % 29 = 0")
    found = [sorted(map(str, E.resolve_errors(log, marks, slice_seconds=n).collect())) for n in (60, 3600, 10**9)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 600
    times = {i: (t, a) for i, t, _, a, *_ in rows}
    for r in E.resolve_errors(log, marks).collect():
        t, a = times[r["id"]]
        later = [u for i, (u, b) in times.items() if i % 29 == 0 and b == a and u is not None and (t is None or u >= t)]
        assert (None if r["resolved_at"] is None else int(pd.Timestamp(r["resolved_at"], tz="UTC").timestamp())) == min(later, default=None)


def test_errors_of_named_accounts(spark):
    log = spark.createDataFrame([(1, 1, "error", "a", None), (2, 2, "error", "a", None), (3, 1, "info", "a", None), (4, 1, "critical", "b", None)], "id long, account_id long, level string, event string, resolved_at string")
    some = lambda **k: {r["id"] for r in E.resolve_account(log, spark.createDataFrame([(1,), (1,), (9,)], "id long"), F.lit("now"), **k).filter("resolved_at IS NOT NULL").collect()}
    assert some() == {1, 4} and some(event="a") == {1}


def test_digest_streams_in_path_order(spark):
    rows = [(a, f"photos/{k * 37 % 101:03d}-é", None if k % 9 == 0 else k, None if k % 11 == 0 else k, None, False) for a in (3, 1, None) for k in range(101)] + [(7, "videos/x", 5, 1, None, False), (8, "gone", 5, 1, None, True)]
    files = spark.createDataFrame(rows, "account_id long, rel_path string, bytes long, mtime_ns long, deleted_at string, is_missing boolean").repartition(7)
    got = {r["account_id"]: tuple(r)[1:] for r in M.inventory_digest(files).collect()}
    assert set(got) == {3, 1, None, 7}
    for a in got:
        mine = sorted(r for r in rows if r[0] == a and not r[5])
        text = "".join(f"{p}:{b}:{m}" for _, p, b, m, *_ in sorted(mine, key=lambda r: r[1]))
        assert got[a] == (hashlib.sha256(text.encode()).hexdigest()[:16], sum(r[2] or 0 for r in mine), len(mine), False)


def test_hashing_is_dealt_by_bytes(spark):
    rng = random.Random(2)
    paths = spark.createDataFrame([(f"p{k}", int(rng.paretovariate(1.2) * 1000) % 400_000) for k in range(3000)], "path string, bytes long")
    parts = fh.dealt_by_bytes(paths, 8).withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.sum("bytes").alias("n"), F.count("*").alias("files")).collect()
    total, most = sum(r["n"] for r in parts), paths.agg(F.max("bytes")).first()[0]
    assert len(parts) == 8 and sum(r["files"] for r in parts) == 3000
    assert max(r["n"] for r in parts) <= total / 8 + most


def plain_runs(rows, gap):
    out = []
    for r in sorted(rows, key=lambda r: (r["us"], r["id"])):
        if out and r["us"] - out[-1][-1]["us"] < gap:
            out[-1].append(r)
        else:
            out.append([r])
    return out


class Row(dict):
    __getattr__ = dict.__getitem__


def test_runs_fold_in_any_order_and_chunk(monkeypatch):
    rng = random.Random(8)
    rows = [Row(id=k, us=rng.randrange(10**12) if k % 3 else 7 * 10**11 + k, message=f"m{k}", detail=None if k % 2 else f"d{k}", job_id=None if k % 5 else k, source=f"s{k}", error_type=None, traceback=f"t{k}", retryable=k % 2 == 0) for k in range(4000)]
    work = S.Coalescer(30)
    want = plain_runs(rows, work.gap)
    for size in (1, 64, 4000):
        runs = []
        for k in range(0, len(rows) if size > 1 else 300, size):
            runs = work.fold(runs + [work.one(r) for r in rows[k : k + size]])
        mine = want if size > 1 else plain_runs(rows[:300], work.gap)
        assert [(r["id"], r["occurrences"], r["first_us"], r["last_us"], r["message"], r["traceback"]) for r in runs] == [(g[0]["id"], len(g), g[0]["us"], g[-1]["us"], g[-1]["message"], g[0]["traceback"]) for g in mine]
        for r, g in zip(runs, mine):
            assert r["detail"] == next((x["detail"] for x in reversed(g) if x["detail"] is not None), None)
            assert r["job_id"] == next((x["job_id"] for x in reversed(g) if x["job_id"] is not None), None)


def land(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).withColumn("ts", F.timestamp_seconds(F.col("at") + 1_000_000).cast("timestamp_ntz")).drop("at").coalesce(1).write.mode("append").parquet(folder)


EVENTS = "id long, at long, level string, account_id long, event string, error_type string, message string, detail string, job_id long, source string, traceback string, retryable boolean, resolved_at timestamp_ntz"


def test_a_timer_closes_a_run_once(spark, tmp_path):
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    event = lambda k, at, account: (k, at, "error", account, "e", "X", f"m {k}", None, None, "s", f"line {k}", k % 2 == 0, None)
    land(spark, folder, [event(1, 1000, 1), event(2, 1000 + 1799, 1), event(3, 1200, 2)], EVENTS)
    for k in range(5):
        land(spark, folder, [event(10 + k, 20_000 + 10_000 * k, 3)], EVENTS)
    schema = spark.read.parquet(folder).schema
    found = S.run_to_table(S.stream_coalesce(S.event_stream(spark, folder, schema, 1)), out)
    rows = found.collect()
    assert max(r["batch"] for r in rows) >= 4
    closed = [(r["id"], r["occurrences"], r["traceback"], r["retryable"]) for r in rows if r["closed"]]
    assert sorted(closed)[:2] == [(1, 2, "line 1", False), (3, 1, "line 3", False)] and len(set(closed)) == len(closed)
    assert sorted((r["id"], r["occurrences"]) for r in S.standing(found).collect()) == [(1, 2), (3, 1), *((10 + k, 1) for k in range(5))]


KEYS = "account_id long, provider string, remote_id string, at long"


def test_a_key_is_admitted_once(spark, tmp_path):
    """Over batches, long after the watermark, after a restart, and when a batch is run again."""
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    known = spark.createDataFrame([(1, "p", "known")], "account_id long, provider string, remote_id string")
    for k in range(5):
        land(spark, folder, [(1, "p", "often", k * 100_000), (1, "p", f"r{k}", k * 100_000), (1, "p", "known", k * 100_000 + 1), (1, "p", "often", k * 100_000 + 2)], KEYS)
    schema = spark.read.parquet(folder).schema
    names = lambda rows: sorted(r["remote_id"] for r in rows.collect())
    assert names(S.stream_first_seen(S.event_stream(spark, folder, schema, 1), known, out)) == ["often", "r0", "r1", "r2", "r3", "r4"]
    land(spark, folder, [(1, "p", "often", 900_000), (1, "p", "r2", 900_001), (1, "p", "new", 900_002)], KEYS)
    again = S.stream_first_seen(S.event_stream(spark, folder, schema, 1), known, out)
    assert names(again) == ["new", "often", "r0", "r1", "r2", "r3", "r4"] and again.filter("remote_id = 'often'").first()["ts"].timestamp() == 1_000_000
    batch = spark.createDataFrame([(1, "p", "late", 5), (1, "p", "r1", 5)], KEYS).withColumn("ts", F.timestamp_seconds("at")).drop("at")
    for _ in range(2):
        S.first_seen(f"{out}/admitted", known)(batch, 50)
    assert names(S.admitted(spark, f"{out}/admitted")) == ["late", "new", "often", "r0", "r1", "r2", "r3", "r4"]


def test_outcomes_keep_a_bounded_state(spark, tmp_path):
    """An account that never succeeds: the state has no more times than the watermark's delay has."""
    folder, out = f"{tmp_path}/in", f"{tmp_path}/out"
    jobs = "account_id long, status string, at long"
    every = []
    for k in range(6):
        rows = [(1, "failed", k * 10_000 + j * 10) for j in range(1000)] + [(2, "failed" if j % 7 else "succeeded", k * 10_000 + (j * 7919 % 1000) * 10) for j in range(1000)]
        land(spark, folder, rows, jobs)
        every += rows
    schema = spark.read.parquet(folder).schema
    found = S.run_to_table(S.stream_job_outcomes(S.event_stream(spark, folder, schema, 1)), out)
    last = {r["account_id"]: r for r in found.groupBy("account_id").agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*").collect()}
    won = max(t for a, status, t in every if a == 2 and status == "succeeded")
    assert last[1]["consecutive_failures"] == 6000 and last[1]["last_success_us"] is None
    assert last[2]["consecutive_failures"] == sum(a == 2 and status == "failed" and t > won for a, status, t in every) > 0
    state = spark.read.format("statestore").load(f"{out}/checkpoint")
    sizes = [len(r["v"]["groupState"]["recent"]) for r in state.select(F.col("value").alias("v")).collect()]
    assert sizes and max(sizes) <= 1100


def test_buckets_share_the_coalescing_state(spark, tmp_path):
    """Two buckets for 60 keys: as many states, and the runs of the batch operator."""
    folder, out, rng = f"{tmp_path}/in", f"{tmp_path}/out", random.Random(3)
    for k in range(3):
        land(spark, folder, [(100 * k + j, 10_000 * k + rng.randrange(9_000), "error", j % 60, "e", "X", f"m {j}", None if j % 3 else f"d{j}", j if j % 4 else None, "s", None, None, None) for j in range(100)], EVENTS)
    log = spark.read.parquet(folder)
    found = S.standing(S.run_to_table(S.stream_coalesce(S.event_stream(spark, folder, log.schema, 1, "1 hour"), buckets=2), out))
    show = lambda rows: sorted(map(str, rows.select("fingerprint", "id", "occurrences", "message", "detail", "job_id").collect()))
    assert show(found) == show(E.coalesce_events(log)) and len(show(found)) > 60
    state = spark.read.format("statestore").option("stateVarName", "runs").load(f"{out}/checkpoint")
    assert 0 < state.select("key").distinct().count() <= 2


def test_buckets_share_the_outcomes(spark, tmp_path):
    """Three buckets for 200 accounts, later and earlier successes: as the jobs in a row tell."""
    folder, out, rng = f"{tmp_path}/in", f"{tmp_path}/out", random.Random(4)
    every = []
    for k in range(3):
        rows = [(a, rng.choice(("failed", "failed", "succeeded")) if a % 3 else "failed", 50_000 * k + rng.randrange(49_000)) for a in range(200) for _ in range(4)]
        land(spark, folder, rows, "account_id long, status string, at long")
        every += rows
    schema = spark.read.parquet(folder).schema
    found = S.run_to_table(S.stream_job_outcomes(S.event_stream(spark, folder, schema, 1, "1 day"), buckets=3), out)
    last = {r["account_id"]: r for r in found.groupBy("account_id").agg(F.max_by(F.struct("*"), "batch").alias("r")).select("r.*").collect()}
    assert len(last) == 200
    for a, r in last.items():
        won, lost = (max((t for b, s, t in every if b == a and s == kind), default=None) for kind in ("succeeded", "failed"))
        us = lambda t: None if t is None else (t + 1_000_000) * 1_000_000
        assert (r["last_success_us"], r["last_error_us"]) == (us(won), us(lost))
        assert r["consecutive_failures"] == sum(b == a and s == "failed" and (won is None or t > won) for b, s, t in every)
    assert spark.read.format("statestore").load(f"{out}/checkpoint").count() <= 3


def test_slices_land_in_files_by_their_rows(spark, monkeypatch):
    """Large slices are many tasks' work, and each lands in as many files, as a batch is so many."""
    from shelfmark.plans import streams

    monkeypatch.setattr(streams, "FILE_ROWS", 300)
    rows = spark.range(6000).select("id", (F.timestamp_seconds(F.col("id") * 60)).cast("timestamp_ntz").alias("ts"))
    seen = {}
    monkeypatch.setattr(S, "event_stream", lambda spark, folder, schema, files, watermark: seen.update(folder=folder, files=files))
    streams._landed(spark, rows, "sliced")
    assert seen["files"] == 4
    assert len([f for f in os.listdir(seen["folder"].removeprefix("file:")) if f.endswith(".parquet")]) == 4 * streams.BATCHES
    assert spark.read.parquet(seen["folder"]).count() == 6000


@pytest.mark.parametrize("name", ["A10_sync_run_summary", "G2_index_media", "J2_dedup_guards", "WL2_sync_index"])
def test_the_index_is_made_once(spark, name):
    """What is returned reads the stored index; the raw rows are aggregated only to make it."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "max(l_shipdate" not in plan


def test_larger_tables_take_more_buckets(spark, tmp_path):
    rows = spark.createDataFrame([(a % 50, f"k{a}", "x") for a in range(1000)], ROWS)
    made = [store.create(rows, f"{tmp_path}/{n}", ("account_id", "key"), buckets=4, bucket_rows=n) for n in (1000, 50)]
    assert [m.buckets for m in made] == [4, 20]
    assert stored(spark, f"{tmp_path}/50") == stored(spark, f"{tmp_path}/1000")


def test_the_index_is_grouped_in_more_tasks_the_larger_it_is(spark, monkeypatch):
    monkeypatch.setattr(fixtures, "DEALT_ROWS", 300)
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    (index,) = tables(spark, "/root/testdata/sf0.001", "remote_index")
    assert index.groupBy("account_id", "provider", "remote_id").count().rdd.getNumPartitions() == -(-rows // 300)


def test_keys_are_counted_in_the_partitions_asked_for(spark):
    rows = [("a", "active"), ("A", "active"), ("b", "odd"), (None, "flagged"), (None, "legacy"), (None, None)]
    accounts = {"accounts": spark.createDataFrame(rows, "name string, status string")}
    count = lambda parts: audit.integrity_audit(accounts, parts)
    assert sorted(map(tuple, count({"accounts": 37}).collect())) == sorted(map(tuple, count(None).collect())) == [("accounts.name_unique", 2), ("accounts.status", 1)]
    assert ", 37), REPARTITION_BY_NUM" in count({"accounts": 37})._jdf.queryExecution().executedPlan().toString()


def test_the_index_is_stored_in_ranges_without_a_second_deal(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fixtures, "DEALT_ROWS", 600)
    (index,) = tables(spark, "/root/testdata/sf0.001", "remote_index", ranges=streams.RANGES)
    assert index._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    listing.save_table(index, "remote_index", str(tmp_path), ranged=True)
    files = listing.load_table(spark, "remote_index", str(tmp_path)).withColumn("file", F.input_file_name())
    ends = files.groupBy("file").agg(F.min(F.struct("account_id", "remote_id")), F.max(F.struct("account_id", "remote_id"))).collect()
    ends = sorted((tuple(low), tuple(high)) for _, low, high in ends)
    assert len(ends) > 4 and all(a[1] < b[0] for a, b in zip(ends, ends[1:]))
    assert sorted(map(str, files.drop("file").collect())) == sorted(map(str, tables(spark, "/root/testdata/sf0.001", "remote_index")[0].collect()))


def test_all_tables_are_stored_with_the_index_in_ranges(spark, monkeypatch):
    dealt = {}
    monkeypatch.setattr(streams, "save_table", lambda rows, name, folder, ranged=False: (dealt.update({name: ranged}), listing.save_table(rows, name, folder, ranged))[1])
    assert streams.all_tables_io(spark, "/root/testdata/sf0.001").count() == len(dealt) == 7
    assert [n for n in dealt if dealt[n]] == ["remote_index"]


def test_a_listing_is_dealt_before_its_texts_are_made(spark):
    of = lambda **how: tables(spark, "/root/testdata/sf0.001", "listing", **how)[0]._jdf.queryExecution().executedPlan().toString()
    above, below = of().split("Exchange")
    assert "https://" in above and "https://" not in below
    (rows,) = tables(spark, "/root/testdata/sf0.001", "listing", plain=("listing",))
    assert "Exchange" not in rows.select("account_id", "remote_id")._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, rows.collect())) == sorted(map(str, tables(spark, "/root/testdata/sf0.001", "listing")[0].collect()))


def test_an_upsert_is_one_deal(spark):
    """Listing and stored index move once each, by account; what is stored lands in a file a bucket and isn't counted before."""
    parts = fixtures.account_parts(spark, "/root/testdata/sf0.001")
    index, rows = tables(spark, "/root/testdata/sf0.001", "remote_index", "listing", parts=parts)
    folder = listing.shared_folder(spark, "dealt")
    table = store.create(index, folder, tuple(catalog.R.KEY), dealt=parts)
    assert table.buckets == parts and len(files_of(folder.removeprefix("file:"))) == len(table.places) > 1
    plan = store._remade(spark, table, catalog.R.listed(rows), catalog.R.upserted(F.current_timestamp()), parts)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2


@pytest.mark.parametrize(("giant", "dealt"), [(200, None), (10**9, None), (10**9, 16)])
def test_an_upsert_remakes_rows(spark, tmp_path, giant, dealt):
    """As a full join would, however rows are dealt; only buckets with a difference are new, a second time adds nothing."""
    old = [(a, f"k{k}", None if k % 7 == 0 else "v") for a in range(40) for k in range(5)] + [(99, f"k{k}", "hot") for k in range(300)] + [(None, "k", "v")]
    new = [(3, "k1", "w"), (3, "k2", None), (5, "k1", "v"), (777, "k1", None), (99, "k7", "w"), (None, "k", "w")]
    deal = lambda rows: rows.repartition(dealt, "account_id") if dealt else rows
    folder = str(tmp_path / "t")
    made = store.create(deal(spark.createDataFrame(old, ROWS)), folder, ("account_id", "key"), buckets=16, giant=giant, dealt=dealt)
    assert made.giants == ((99,) if giant == 200 else ())
    before = files_of(folder)
    given = deal(spark.createDataFrame(new, "account_id long, key string, said string"))
    after = store.upsert(spark, folder, given, {"value": F.coalesce("said", "value")}, dealt)
    want = {(a, k): v for a, k, v in old} | {(3, "k1"): "w", (777, "k1"): None, (99, "k7"): "w", (None, "k"): "w"}
    assert stored(spark, folder) == sorted(((a, k, v) for (a, k), v in want.items()), key=str)
    assert 1 <= len({b for b, v in after.places.items() if v == 1}) <= 4 and before.items() <= files_of(folder).items()
    files = files_of(folder)
    assert store.upsert(spark, folder, given, {"value": F.coalesce("said", "value")}, dealt).version == 1
    assert files_of(folder) == files and not os.listdir(f"{folder}/changes")
    store.merge(spark, folder, spark.createDataFrame([(3, "k1", "x")], ROWS))  # what was moved in is merged into as any
    assert ((3, "k1", "x") in stored(spark, folder)) and len(stored(spark, folder)) == len(want)


def test_an_upsert_that_fails_leaves_the_table(spark, table):
    folder, rows, _ = table
    given = spark.createDataFrame([(3, "k1", "x")], "account_id long, key string, said string")
    with pytest.raises(Exception, match="stop"):
        store.upsert(spark, folder, given, {"value": F.when(F.col("said") == "x", F.raise_error(F.lit("stop")).cast("string"))})
    assert stored(spark, folder) == sorted(rows, key=str) and not os.listdir(f"{folder}/changes")


def test_giant_accounts_are_not_dealt_as_a_whole(spark, monkeypatch):
    from shelfmark.plans import stored as stored_plans

    show = lambda: sorted(map(str, stored_plans.upsert(spark, "/root/testdata/sf0.001").collect()))
    want = show()
    monkeypatch.setattr(fixtures, "GIANT_ROWS", 100)
    assert fixtures.account_parts(spark, "/root/testdata/sf0.001") is None
    assert show() == want


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    """lineitem with repeated rows and nulls in each column that isn't made into text, which the dialects do differently with nulls."""
    folder, rows = tmp_path_factory.mktemp("odd"), spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    names = ("l_suppkey", "l_quantity", "l_returnflag", "l_linestatus", "l_shipdate")
    turn = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(17))
    rows = rows.select(*(F.when(turn != k, F.col(c)).alias(c) if c in names else c for k, c in ((names.index(c) if c in names else None, c) for c in rows.columns)))
    rows.unionAll(rows.filter("l_partkey % 7 = 0")).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def agrees(spark, name, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/lineitem.parquet/*.parquet'")
    want, got = con.execute(catalog.ORACLES[name]).fetchall(), catalog.QUERIES[name](spark, folder)
    columns = [d[0] for d in con.description]
    assert len(want) > 5 and sorted(columns) == sorted(got.columns)
    return sorted(map(str, (tuple(r) for r in want))) == sorted(map(str, (tuple(r) for r in got.select(*columns).collect())))


GUARDED = ["A10_sync_run_summary", "G2_index_media", "J2_dedup_guards"]


@pytest.mark.parametrize("name", GUARDED)
def test_odd_rows_agree_with_sql(spark, odd_tables, name):
    assert agrees(spark, name, odd_tables)


@pytest.mark.parametrize("name", GUARDED)
def test_guards_move_index_and_held_rows_once(spark, monkeypatch, name):
    """One table is stored; in its plan the index and the held rows are dealt by account and nothing else moves."""
    plans = []
    monkeypatch.setattr(catalog, "landed", lambda rows, label: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or rows)
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert [p.count("Exchange ") for p in plans] == [2] and plans[0].count("hashpartitioning(l_suppkey") == 2


@pytest.mark.parametrize("name", GUARDED)
def test_guards_of_giant_accounts(spark, monkeypatch, odd_tables, name):
    """Accounts that aren't dealt as a whole are parted by each key, with the same rows."""
    monkeypatch.setattr(fixtures, "GIANT_ROWS", 50)
    assert fixtures.account_parts(spark, odd_tables) is None
    assert agrees(spark, name, odd_tables)


@pytest.mark.parametrize("own", [False, True])
def test_weighed_items_by_brute_force(spark, own):
    rng = random.Random(12)
    some = lambda *v: rng.choice((None, *v))
    items = list({(a, p, r): (a, p, r, some("h1", "h2", "h3"), some("f1", "f2", "f3"), rng.choice((None, 0, 5)), some("h1", "h4")) for a, p, r in ((some(1, 2), some("p", "q"), some("r1", "r2", "r3", "r4")) for _ in range(300))}.values())
    held = [(some(1, 2), some("p", "q"), some("r1", "r2", "r9"), some("h1", "h2"), some(True, False), some(3, 4, 5)) for _ in range(12)]
    files = [(a, f, n, h) for a, _, _, _, f, n, h in items if n is not None] if own else [(some(1, 2), some("f1", "f2"), rng.choice((0, 5)), some("h1", "h4")) for _ in range(8)]
    frame = spark.createDataFrame(items, "account_id long, provider string, remote_id string, remote_hash string, path string, n int, h string")
    frame = frame.withColumn("file", F.when(F.col("n").isNotNull(), F.struct(F.col("n").alias("bytes"), F.col("h").alias("content_hash")))) if own else frame
    known = spark.createDataFrame(held, "account_id long, source_provider string, remote_id string, content_hash string, is_tombstone boolean, id long")
    on_disk = None if own else spark.createDataFrame(files, "account_id long, path string, bytes int, content_hash string")
    same = lambda *pairs: all(x is not None and x == y for x, y in pairs)
    want = set()
    for a, p, r, h, f, _, _ in items:
        live = [k for k in held if k[4] is False]
        owns = lambda h: any(same((a, k[0]), (h, k[3])) for k in live)
        there = [d for d in files if d[2] > 0 and same((a, d[0]), (f, d[1]))]
        ids = [k[5] for k in live if same((a, k[0]), (r, k[2])) and k[5] is not None]
        want.add((a, p, r, any(same((a, k[0]), (p, k[1]), (r, k[2])) for k in live), any(k[4] and same((a, k[0]), (r, k[2])) for k in held), owns(h), bool(there), any(owns(d[3]) for d in there), min(ids, default=None)))
    got = [tuple(r) for r in R.weighed(frame, known, on_disk).select("account_id", "provider", "remote_id", "live", "dead", "same", "placed", "there", "media_id").collect()]
    assert len(got) == len(items) and set(got) == want
