"""Pinned behaviours on literal rows."""

import os

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import events as fe
from shelfmark.functions import hashing as fh
from shelfmark.functions import names as fn
from shelfmark.functions import pacing as fp
from shelfmark.operators import accounts as A
from shelfmark.operators import audit
from shelfmark.operators import events as E
from shelfmark.operators import links
from shelfmark.operators import media as M
from shelfmark.operators import remote as R
from shelfmark.sources.listing import TABLES, list_files, load_table, save_table


def one(spark, expression, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())) if values else spark.range(1)
    return row.select(expression.alias("x")).first()["x"]


@pytest.mark.parametrize(("path", "kind"), [("photos/a.JPG", "image"), ("v/b.mkv", "video"), ("c.bin", "other"), ("x/.DS_Store", None), ("half.jpg.part", None), (".hidden", None), ("meta.json", None), ("_x.jpg", "image")])
def test_classify(spark, path, kind):
    assert one(spark, fn.classify_media(F.col("p")), p=path) == kind


def plan(spark, backlog, new=False, favorite=False, failures=0):
    found = fp.plan_run(F.lit(backlog), F.lit(new), F.lit(favorite), F.lit(failures))
    return spark.range(1).select(*(v.alias(k) for k, v in found.items())).first()


def test_pacing(spark):
    assert (plan(spark, 0)["budget"], plan(spark, 0)["requeue_delay_seconds"]) == (0, 0.0)
    small = plan(spark, 3)
    assert (small["budget"], small["paced"], small["spread_over_runs"]) == (3, False, 1)
    large = plan(spark, 40)
    assert large["budget"] == 25 and large["paced"] and large["requeue_delay_seconds"] > 0
    assert 15000 >= plan(spark, 400)["base_delay_ms"] > plan(spark, 10)["base_delay_ms"]
    first = plan(spark, 900, new=True)
    assert first["budget"] <= 25 and first["spread_over_runs"] > 1
    assert plan(spark, 12, new=True)["budget"] == 2 and plan(spark, 30, new=True)["budget"] == 5
    assert 4000 <= plan(spark, 50, favorite=True)["base_delay_ms"] < plan(spark, 50)["base_delay_ms"]
    assert plan(spark, 20, failures=3)["base_delay_ms"] > plan(spark, 20)["base_delay_ms"]


def test_percent_rounds_both_ways(spark):
    assert one(spark, fp.percent_complete(F.lit(1), F.lit(0), F.lit(8))) == 13
    assert one(spark, fp.percent_complete(F.lit(1), F.lit(0), F.lit(8), half_even=True)) == 12
    assert one(spark, fp.percent_complete(F.lit(1), F.lit(0), F.lit(0))) is None


def test_eta_ignores_one_slow_item(spark):
    rows = spark.createDataFrame([(1, k, k, 600.0 if k == 5 else 2.0) for k in range(10)], "account_id long, ts long, id long, seconds double")
    last = R.rolling_eta(rows, F.lit(10)).orderBy("id").collect()
    assert last[0]["eta_seconds"] is None and last[-1]["eta_seconds"] == 20


def test_discovery_stops_after_known_streak(spark):
    known = spark.createDataFrame([(1, "p", f"r{k}") for k in range(40)], "account_id long, provider string, remote_id string")
    listing = known.withColumn("position", F.substring("remote_id", 2, 9).cast("long") + 1)
    assert R.discovery_cutoff(listing, known).count() == 12
    fresh = listing.withColumn("remote_id", F.when(F.col("position") == 1, "new").otherwise(F.col("remote_id")))
    assert R.discovery_cutoff(fresh, known).count() == 13


def test_guards_in_order(spark):
    held = spark.createDataFrame([(1, "p", "a", "h1", False), (1, "p", "t", "h9", True)], "account_id long, source_provider string, remote_id string, content_hash string, is_tombstone boolean")
    items = spark.createDataFrame([(1, "p", "a", "x", "f1"), (1, "p", "b", "h1", "f2"), (1, "p", "c", "x", "f3"), (1, "p", "d", None, "f4"), (1, "p", "e", "h9", "f5")], "account_id long, provider string, remote_id string, remote_hash string, path string")
    items = items.unionByName(items.limit(1).selectExpr("account_id", "provider", "'f' AS remote_id", "'y' AS remote_hash", "'f6' AS path"))
    disk = spark.createDataFrame([(1, "f3", 5, "new"), (1, "f4", 0, "h1"), (1, "f6", 5, "h1")], "account_id long, path string, bytes long, content_hash string")
    found = R.dedup_guards(items, held, disk).collect()
    assert {r["remote_id"]: r["outcome"] for r in found} == {"a": "duplicate", "b": "duplicate", "c": "adopted", "d": "fetch", "e": "fetch", "f": "adopted"}
    assert {r["remote_id"]: r["note"] for r in found if r["outcome"] == "adopted"} == {"c": "adopted existing file", "f": "present on disk"}


def log(spark, *rows):
    text = "id long, ts timestamp_ntz, level string, source string, account_id long, event string, message string, detail string, error_type string, resolved_at timestamp_ntz"
    return spark.createDataFrame(rows, text.replace("timestamp_ntz", "string")).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "resolved_at")} | {"job_id": F.col("id") * 10, "traceback": F.concat(F.lit("line "), "id"), "retryable": F.col("id") % 2 == 0})


def test_a_resolution_starts_a_new_row(spark):
    at = ["2024-01-01 00:00:00", "2024-01-01 00:05:00", "2024-01-01 00:10:00"]
    done = ["2024-01-01 00:07:00", "2024-01-01 00:07:00", None]
    rows = [(k, t, "error", "s", 1, "e", "429", None, "X", r) for k, (t, r) in enumerate(zip(at, done))]
    found = E.coalesce_events(log(spark, *rows)).orderBy("id").collect()
    assert [(r["id"], r["occurrences"], r["job_id"], r["traceback"], r["retryable"]) for r in found] == [(0, 2, 10, "line 0", True), (2, 1, 20, "line 2", True)]


def test_coalescing_is_strict_at_thirty_minutes(spark):
    at = ["2024-01-01 00:00:00", "2024-01-01 00:29:59", "2024-01-01 00:59:59", "2024-01-01 01:00:00", "2024-01-01 01:10:00"]
    rows = [(k, t, "error", "s", 1, "e", f"429 retry after {k}0s", None if k else "d", None, None) for k, t in enumerate(at)]
    found = E.coalesce_events(log(spark, *rows)).orderBy("id").collect()
    assert [(r["id"], r["occurrences"], r["detail"]) for r in found] == [(0, 2, "d"), (2, 3, None)]


def test_fingerprint_masks_numbers_and_quotes(spark):
    make = lambda m: fe.fingerprint(F.lit(1), F.lit("e"), F.lit(None).cast("string"), F.lit(m))
    assert one(spark, make("Wait 10s for 'a'")) == one(spark, make("wait 95s for 'bcd'")) != one(spark, make("wait for it"))


def test_errors_resolve_forward_only(spark):
    rows = log(spark, (1, "2024-01-01 00:00:00", "error", "s", 1, "e", "m", None, None, None), (2, "2024-01-03 00:00:00", "error", "s", 1, "e", "m", None, None, None), (3, "2024-01-01 00:00:00", "error", "s", None, "e", "m", None, None, None))
    ok = rows.limit(1).select(F.lit(1).cast("long").alias("account_id"), F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00")).alias("ts"))
    found = {r["id"]: r["resolved_at"] for r in E.resolve_errors(rows, ok).collect()}
    assert set(found) == {1, 2} and found[1] is not None and found[2] is None


def test_indexing_inserts_and_fills(spark):
    """A new file is a row; known content isn't; a known path only learns where it came from."""
    media = spark.createDataFrame([(1, 1, "a.jpg", "h1", None, None), (2, 1, "b.jpg", "h2", "p", "x")], "id long, account_id long, rel_path string, content_hash string, source_provider string, remote_id string")
    media = media.withColumns({"media_type": F.lit("image"), "bytes": F.lit(5).cast("long"), "remote_url": F.lit(None).cast("string")} | {c: F.lit(None).cast("timestamp_ntz") for c in ("captured_at", "downloaded_at", "imported_at", "last_verified_at", "deleted_at")})
    files = [(1, "a.jpg", "h1", "p", "r1", True), (1, "c.jpg", "h2", "p", "r2", True), (1, "d.jpg", "h3", "p", "r3", True), (1, "e.jpg", "h3", "p", "r4", True), (1, "f.jpg", "h4", "p", "r5", False)]
    files = spark.createDataFrame(files, "account_id long, rel_path string, content_hash string, provider string, remote_id string, downloaded boolean")
    files = files.withColumns({"media_type": F.lit("image"), "bytes": F.lit(7).cast("long"), "url": F.lit("u"), "posted_at": F.lit("2024-01-01").cast("timestamp_ntz")})
    got = {r["rel_path"]: r for r in R.index_media(media, files, F.lit("2024-02-01").cast("timestamp_ntz")).collect()}
    assert set(got) == {"a.jpg", "b.jpg", "d.jpg", "f.jpg"}
    assert [(got[k]["remote_id"], got[k]["id"], got[k]["last_verified_at"] is not None) for k in sorted(got)] == [("r1", 1, True), ("x", 2, False), ("r3", None, True), ("r5", None, True)]
    assert got["d.jpg"]["downloaded_at"] is not None and got["f.jpg"]["downloaded_at"] is None and got["f.jpg"]["imported_at"] is not None


def test_unfinished_items_keep_their_state(spark):
    index = spark.createDataFrame([(1, "p", k, "pending", 1, "old", None) for k in "abcd"], "account_id long, provider string, remote_id string, state string, attempts int, last_error string, media_file_id long").withColumn("last_attempt_at", F.lit(None).cast("timestamp_ntz"))
    done = spark.createDataFrame([(1, "p", "a", "downloaded", None), (1, "p", "b", "duplicate", "known"), (1, "p", "c", "fetch", None)], "account_id long, provider string, remote_id string, outcome string, note string")
    media = spark.createDataFrame([(9, 1, "a", None)], "id long, account_id long, remote_id string, deleted_at string")
    got = {r["remote_id"]: tuple(r)[3:7] for r in R.mark_outcomes(index, done, media, F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))).collect()}
    assert got == {"a": ("downloaded", 2, None, 9), "b": ("duplicate", 2, "known", None), "c": ("pending", 1, "old", None), "d": ("pending", 1, "old", None)}


def test_a_holder_keeps_its_hash(spark):
    rows = spark.createDataFrame([(1, 1, "z.jpg", "h", None), (2, 1, "a.jpg", "h", None)], "id long, account_id long, rel_path string, content_hash string, deleted_at string")
    assert {r["id"]: r["duplicate_of"] for r in M.dedup_keeper(rows, F.col("id") == 1).collect()} == {1: None, 2: 1}


def test_keeper_goes_by_path_parts(spark):
    rows = spark.createDataFrame([(1, 1, "a-b/x.jpg", "h", None), (2, 1, "a/b.jpg", "h", None), (3, 1, "c.jpg", None, None)], "id long, account_id long, rel_path string, content_hash string, deleted_at string")
    assert {r["id"]: r["duplicate_of"] for r in M.dedup_keeper(rows).collect()} == {1: 2, 2: None}


def test_scan_twice_changes_nothing(spark):
    index = spark.createDataFrame([(1, 1, "a.jpg", 5, 9, "h", False, None)], "id long, account_id long, rel_path string, bytes long, mtime_ns long, content_hash string, is_missing boolean, deleted_at string")
    assert [r["action"] for r in M.scan_reconcile(index, index).collect()] == ["unchanged"]


@pytest.mark.parametrize(("path", "out"), [("a/b.jpg", False), ("../b", True), ("a/../b", False), ("a/../../b", True), ("/etc/passwd", True), ("a/./b", False)])
def test_path_escapes(spark, path, out):
    assert one(spark, fn.path_escapes(F.col("p")), p=path) is out


@pytest.mark.parametrize(("url", "provider"), [("https://www.Instagram.com/x", "instagram"), ("https://m.x.com/y", "twitter"), ("https://notx.com", "custom"), ("x.com/y", "custom"), (None, "custom")])
def test_infer_provider(spark, url, provider):
    assert one(spark, fn.infer_provider(F.lit(url).cast("string"))) == provider


def test_names(spark):
    name, valid = fn.account_name(F.lit(" @@a.b "))
    assert (one(spark, name), one(spark, valid)) == ("a.b", True)
    assert one(spark, fn.sanitize_filename(F.lit("..//"))) == "file"
    assert one(spark, fn.target_path(F.lit("a b"), F.lit("https://h/p.JPEG?x"), F.lit("image"), F.lit(None).cast("timestamp"))) == "photos/00000000_a_b.jpeg"
    assert one(spark, fn.parse_iso(F.lit("never"))) is None


def test_decode_detail(spark):
    got = spark.createDataFrame([('{"a":1}',), ("oops",), ("",), (None,)], "d string").select(fe.decode_detail(F.col("d")).alias("x")).collect()
    assert [r["x"] for r in got] == ['{"a":1}', '{"raw":"oops"}', "", None]


def test_quick_signature_reads_both_ends(spark):
    make = lambda text: one(spark, fh.quick_signature(F.lit(text), 4))
    assert make("abcdXXefgh") == make("abcdYYefgh") != make("abcdXXefgi")


def test_patch_enables(spark):
    accounts = spark.createDataFrame([(1, 3, False, "x", 4), (2, 3, True, "x", 4)], "id long, priority int, scrape_enabled boolean, next_eligible_at string, consecutive_failures int")
    patch = spark.createDataFrame([(1, None, True)], "id long, priority int, scrape_enabled boolean")
    assert {tuple(r) for r in A.apply_patch(accounts, patch).collect()} == {(1, 3, True, None, 0), (2, 3, True, "x", 4)}


def test_list_files(spark, tmp_path):
    for name in ("a/p/one.jpg", "a/_x.jpg", "a/.hid/no.jpg", "b/two.mp4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"12345")
    got = list_files(spark.createDataFrame([("a",), ("b",), ("gone",)], "account string"), str(tmp_path)).collect()
    assert {(r["account"], r["rel_path"], r["bytes"]) for r in got if r["error"] is None} == {("a", "p/one.jpg", 5), ("a", "_x.jpg", 5), ("b", "two.mp4", 5)}
    assert [r["account"] for r in got if r["error"]] == ["gone"]
    digests = fh.hash_files(spark.createDataFrame([(os.path.join(tmp_path, "b/two.mp4"),), ("/no/file",)], "path string")).collect()
    assert [r["content_hash"] is None for r in digests] == [False, True]


def test_audit_counts_rows_behind_each_lost_reference(spark):
    accounts = spark.createDataFrame([(1, "A", "active"), (2, "a", "odd"), (3, None, None)], "id long, name string, status string")
    files = spark.createDataFrame([(1, 9, "x", None), (2, 9, "x", 7), (3, 1, "y", 1), (4, None, "z", None)], "id long, account_id long, rel_path string, duplicate_of long")
    files = files.withColumns({"media_type": F.lit("image"), "bytes": F.lit(-1), "content_hash": F.lit(None).cast("string"), "deleted_at": F.lit(None).cast("timestamp")})
    found = {r["rule"]: r["violations"] for r in audit.integrity_audit({"accounts": accounts, "media": files}).collect()}
    assert found == {
        "accounts.status": 1, "accounts.name_unique": 1, "media.media_type": 0, "media.bytes": 4, "media.path_unique": 1, "media.live_hash_unique": 0,
        "media.account_id_orphan": 2, "media.duplicate_of_orphan": 1,
    }


def test_seeded_eta_answers_after_one_sample(spark):
    rows = spark.createDataFrame([(1, 1, 1, 3.5), (2, 2, 2, 4.0)], "account_id long, ts long, id long, seconds double")
    seeds = spark.createDataFrame([(1, 6.5)], "account_id long, seconds double")
    found = {r["id"]: r["eta_seconds"] for r in R.rolling_eta(rows, F.lit(2), seeds=seeds).collect()}
    assert found == {1: 10, 2: None}


def test_expected_items_prefer_the_backlog(spark):
    assert [one(spark, fp.expected_items(F.lit(p), F.lit(m).cast("long"))) for p, m in ((3, 9), (0, 9), (0, None))] == [3, 9, 0]


def test_digest_by_type_keeps_the_whole_accounts_digest(spark):
    rows = [(1, "photos/a.jpg", 5, 1), (1, "videos/b.mp4", 7, 2), (1, "videos/c.mp4", None, 3)]
    files = spark.createDataFrame(rows, "account_id long, rel_path string, bytes long, mtime_ns long").withColumns({"deleted_at": F.lit(None).cast("timestamp"), "is_missing": F.lit(False)})
    every, video, image = (M.inventory_digest(files, most=6, media_type=t).first() for t in (None, "video", "image"))
    assert video["digest"] == every["digest"] + "-video" and image["digest"] == every["digest"] + "-image"
    assert [(r["total_bytes"], r["file_count"], r["oversize"]) for r in (every, video, image)] == [(12, 3, True), (7, 2, True), (5, 1, False)]


def test_data_tables_part_a_large_account_and_keep_their_layout(spark, tmp_path):
    rows = spark.range(4000).select("id", F.lit(1).cast("int").alias("account_id"), F.concat(F.lit("u"), "id").alias("url"), *(F.lit(None).cast(t).alias(c) for c, t in (("provider", "string"), ("label", "string"), ("is_enabled", "boolean"), ("sort_order", "long"), ("extra", "int"))))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so little would be one file
    save_table(rows, "links", str(tmp_path))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = load_table(spark, "links", str(tmp_path))
    assert found.columns == [c.split()[0] for c in TABLES["links"][0].split(", ")] and dict(found.dtypes)["account_id"] == "bigint"
    assert found.count() == 4000 and len(list((tmp_path / "links").glob("*.parquet"))) > 1
    save_table(rows.filter("false"), "links", str(tmp_path))
    assert load_table(spark, "links", str(tmp_path)).count() == 0


def test_the_first_of_a_repeated_link_stays(spark):
    rows = [(9, 1, " https://a.example/x", "b", None), (4, 1, "https://a.example/x", "z", "mine"), (5, 1, "https://a.example/x", "a", "theirs"), (2, 2, "https://a.example/x", None, None), (3, 1, "https://a.example/y", "c", "old")]
    given = spark.createDataFrame(rows, "id long, account_id long, url string, provider string, label string")
    found = links.add_manual_links(given, given.filter("id = 3"), order=("id",)).select("account_id", "url", "provider", "label")
    assert sorted(map(tuple, found.collect())) == [(1, "https://a.example/x", "z", "mine"), (2, "https://a.example/x", "custom", "Custom")]
