"""Incremental sync: discovery, upsert, backlog, guards and outcomes over all accounts at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["account_id", "provider", "remote_id"]
STREAK, MOST, TRIES = 12, 5000, 4
# Notes of what was found before fetching.
NOTES = {"id": "already indexed by remote id", "hash": "remote hash already held", "held": "present on disk", "new": "adopted existing file"}


def newest() -> list[Column]:
    """Order of a work list; rows that have no id yet are the newest of their time."""
    return [F.coalesce("posted_at", "discovered_at").desc_nulls_last(), F.col("id").desc_nulls_first(), F.col("provider"), F.col("remote_id")]


def number_listing(listing: DataFrame, *ties: str) -> DataFrame:
    """``position`` of each item in its account's listing, newest first."""
    order = Window.partitionBy("account_id").orderBy(F.col("posted_at").desc_nulls_last(), *ties)
    return listing.withColumn("position", F.row_number().over(order).cast("long"))


def discovery_cutoff(listing: DataFrame, known: DataFrame, streak: int = STREAK, most: int = MOST) -> DataFrame:
    """The items that a discovery pass reads: up to the streak-th known item in a row, or ``most``.

    The cap comes before the windows, so an account holds at most ``most`` rows. An item that a
    listing repeats counts as known the second time.
    """
    rows = listing.filter(F.col("position") <= most)
    rows = rows.join(known.select(*KEY).distinct().withColumn("known", F.lit(True)), KEY, "left")
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("position")) == 1
    rows = rows.withColumn("is_new", F.col("known").isNull() & first)
    by = Window.partitionBy("account_id").orderBy("position")
    since = F.col("position") - F.coalesce(F.max(F.when(F.col("is_new"), F.col("position"))).over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    rows = rows.withColumn("since", since)
    full = F.coalesce(F.max((F.col("since") >= streak).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("full", full).filter("full = 0").drop("known", "since", "full")


def listed(listing: DataFrame) -> DataFrame:
    """What a listing says of each key: the last non-null url, hash, size and date, and the first media type."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("position")))
    return listing.groupBy(*KEY).agg(last("url").alias("n_url"), last("content_hash").alias("n_hash"), last("size_bytes").alias("n_bytes"), last("posted_at").alias("n_posted"), F.min_by("media_type", "position").alias("n_type"))


def upserted(now: Column) -> dict[str, Column]:
    """Columns of an index row (nulls for a new key) after what ``listed`` says of it."""
    return {
        "remote_url": F.coalesce("n_url", "remote_url"), "media_type": F.coalesce("media_type", "n_type"), "remote_hash": F.coalesce("n_hash", "remote_hash"), "remote_bytes": F.coalesce("n_bytes", "remote_bytes"),
        "posted_at": F.coalesce("n_posted", "posted_at"), "discovered_at": F.coalesce("discovered_at", now), "id": F.col("id"), "state": F.coalesce("state", F.lit("pending")), "attempts": F.coalesce("attempts", F.lit(0)),
    }


def upsert_remote(index: DataFrame, listing: DataFrame, now: Column) -> DataFrame:
    """Insert new keys, discovered now; on known ones newer non-null url, hash, size and date win; state stays."""
    both = index.join(listed(listing), KEY, "full_outer")
    return both.select(*KEY, *(c.alias(name) for name, c in upserted(now).items()))


def open_items(index: DataFrame, held: DataFrame) -> DataFrame:
    """Items still to be fetched: neither held nor tombstoned, not settled, under four attempts.

    Held rows without a remote id go before the shuffle: they match nothing and would pile up.
    """
    with_id = held.filter("remote_id IS NOT NULL")
    live = with_id.filter("NOT is_tombstone").select("account_id", F.col("source_provider").alias("provider"), "remote_id").distinct()
    dead = with_id.filter("is_tombstone").select("account_id", "remote_id").distinct()
    open_ = index.filter(F.col("state").isin("pending", "failed") & (F.col("attempts") < TRIES))
    return open_.join(live, KEY, "left_anti").join(dead, ["account_id", "remote_id"], "left_anti")


def still_open() -> Column:
    """Whether a weighed item is one of ``open_items``."""
    return F.col("state").isin("pending", "failed") & (F.col("attempts") < TRIES) & ~F.col("live") & ~F.col("dead")


def pending_backlog(index: DataFrame, held: DataFrame, most: int | None = None) -> DataFrame:
    """Open items, numbered newest first within the account: by when they were posted, or else discovered, then by id.

    With ``most``, only the first so many of an account. Up to about a thousand, that limit goes down
    before the exchange by account, so each task sends that many rows of an account at most.
    """
    order = Window.partitionBy("account_id").orderBy(*newest())
    rows = open_items(index, held).withColumn("place", F.row_number().over(order))
    return (rows if most is None else rows.filter(F.col("place") <= most)).withColumn("place", F.col("place").cast("long"))


def budget_slice(backlog: DataFrame, budgets: DataFrame) -> DataFrame:
    """The first ``budget`` items of each account."""
    return backlog.join(budgets.select("account_id", "budget"), "account_id").filter("place <= budget")


def weighed(items: DataFrame, held: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """``items`` with what their account has of each: ``live`` and ``dead`` (its id is held, or tombstoned), ``same`` (its
    hash is held), ``placed`` and ``there`` (a file is in its place, one whose content is held); where ``held`` has
    ids also ``media_id``, the least one of live rows with its remote id.

    Files come as ``on_disk(account_id, path, bytes, content_hash)`` or as the items' own column ``file(bytes,
    content_hash)``, null where there is none. All rows are one table and all keys begin with the account: rows that
    come dealt by account stay where they are, others are dealt by one whole key after the other.
    """
    none = F.lit(None).cast("string")
    kind = F.when(F.col("is_tombstone"), "dead").otherwise("live").alias("__kind")
    ids = [F.col("id").alias("__media")] if "id" in held.columns else []
    known = held.filter("is_tombstone IS NOT NULL").select("account_id", F.col("source_provider").alias("provider"), "remote_id", F.col("content_hash").alias("__hash"), kind, *ids)
    if on_disk is None:
        each = F.when(F.col("file.bytes") > 0, F.array(F.lit("item"), F.lit("file"))).otherwise(F.array(F.lit("item")))
        rows = items.withColumn("__kind", F.explode(each)).withColumn("__hash", F.when(F.col("__kind") == "item", F.col("remote_hash")).otherwise(F.col("file.content_hash"))).drop("file")
    else:
        # a file's path stands for its remote id, so that the files of an account are parted as its items are
        files = on_disk.filter("bytes > 0").select("account_id", "path", none.alias("provider"), F.col("path").alias("remote_id"), F.col("content_hash").alias("__hash"), F.lit("file").alias("__kind"))
        rows = items.withColumn("__kind", F.lit("item")).withColumn("__hash", F.col("remote_hash")).unionByName(files, allowMissingColumns=True)
    rows = rows.unionByName(known, allowMissingColumns=True)

    def met(what: Column, *keys: str | Column) -> Column:
        """Whether a row of equal keys, none of them null, is ``what``."""
        full = F.col("account_id").isNotNull()
        for k in keys:
            full = full & (F.col(k).isNotNull() if isinstance(k, str) else F.lit(True))
        return full & F.max(what).over(Window.partitionBy("account_id", *keys))

    is_ = lambda k: F.col("__kind") == k
    # rows without a hash match none; they are parted by their remote ids
    rows = rows.withColumn("same", met(is_("live"), "__hash", F.when(F.col("__hash").isNull(), F.col("remote_id"))))
    rows = rows.filter(F.col("__kind").isin("item", "file") | F.col("remote_id").isNotNull())
    rows = rows.withColumn("live", met(is_("live"), "remote_id", "provider")).withColumn("dead", met(is_("dead"), "remote_id"))
    if ids:
        least = F.min(F.when(is_("live"), F.col("__media"))).over(Window.partitionBy("account_id", "remote_id"))
        rows = rows.withColumn("media_id", F.when(F.col("account_id").isNotNull() & F.col("remote_id").isNotNull(), least)).drop("__media")
    rows = rows.filter(F.col("__kind").isin("item", "file")).withColumn("placed", met(is_("file"), "path")).withColumn("there", met(is_("file") & F.col("same"), "path"))
    return rows.filter(is_("item")).drop("__kind", "__hash")


def guarded(rows: DataFrame) -> DataFrame:
    """Weighed items with their outcome before fetching: known id, known hash, file in place, or fetch; in that order.

    A file whose content the account holds already is adopted too, but as a duplicate (its note tells).
    """
    outcome = F.when(F.col("live") | F.col("same"), "duplicate").when(F.col("placed"), "adopted").otherwise("fetch")
    note = F.when(F.col("live"), NOTES["id"]).when(F.col("same"), NOTES["hash"]).when(F.col("there"), NOTES["held"]).when(F.col("placed"), NOTES["new"])
    return rows.withColumn("outcome", outcome).withColumn("note", note)


def dedup_guards(items: DataFrame, held: DataFrame, on_disk: DataFrame | None = None) -> DataFrame:
    """``items`` with outcome and note before fetching (see ``weighed`` for what is given)."""
    return guarded(weighed(items, held, on_disk)).drop("live", "dead", "same", "placed", "there", "media_id")


def post_fetch_dedup(fetched: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Outcome after hashing ``fetched(account_id, seq, content_hash, size, ...)``: failed when empty,
    duplicate when the account holds the content or got it earlier in the run, else downloaded.

    Rows that bring an outcome other than fetch keep it. ``held`` isn't needed where the guards took it for the same hashes.
    """
    fetch = F.col("outcome").eqNullSafe("fetch") if "outcome" in fetched.columns else F.lit(True)
    got, rows, again = F.lit(False), fetched, F.col("account_id").isNotNull() & F.col("content_hash").isNotNull()
    if held is not None:
        known = held.filter("NOT is_tombstone AND content_hash IS NOT NULL").select("account_id", "content_hash").distinct().withColumn("held", F.lit(True))
        got, rows = F.coalesce("held", F.lit(False)), fetched.join(known, ["account_id", "content_hash"], "left")
    first = F.min(F.when(fetch & (F.col("size") > 0), F.col("seq"))).over(Window.partitionBy("account_id", "content_hash"))
    rows = rows.withColumn("first", first)
    outcome = F.when(F.col("size") <= 0, "failed").when(got | (again & (F.col("seq") > F.col("first"))), "duplicate").otherwise("downloaded")
    if "outcome" in fetched.columns:
        outcome = F.when(fetch, outcome).otherwise(F.col("outcome"))
    return rows.withColumn("outcome", outcome).drop("held", "first")


def item_failures(index: DataFrame, failures: DataFrame) -> DataFrame:
    """One more attempt for failed items: gone at the fourth; the error is cut to 500 characters."""
    text = F.substring(F.concat_ws(": ", "error_type", "message"), 1, 500)
    # cut before the exchange, so that no task sorts or holds whole messages
    rows = index.join(failures.select(*KEY, text.alias("last_error")), KEY)
    return rows.select(*KEY, F.when(F.col("attempts") + 1 >= TRIES, "gone").otherwise("failed").alias("state"), (F.col("attempts") + 1).alias("attempts"), "last_error")


def index_media(media: DataFrame, files: DataFrame, now: Column) -> DataFrame:
    """The media rows after ``files`` were fetched or adopted.

    A file whose path has no row and whose content no live row of the account holds is inserted (the
    first of its content and path by remote id); any other only fills what its path's row doesn't know
    of where it came from. New rows have no id yet.
    """
    hash_ = media.filter("deleted_at IS NULL AND content_hash IS NOT NULL").select("account_id", "content_hash").distinct().withColumn("held", F.lit(True))
    turn = F.struct("provider", "remote_id")
    first = lambda *keys: files.groupBy("account_id", *keys).agg(F.min(turn).alias(f"first_{keys[0]}"))
    rows = files.join(hash_, ["account_id", "content_hash"], "left").join(first("content_hash"), ["account_id", "content_hash"]).join(first("rel_path"), ["account_id", "rel_path"])
    fresh = rows.filter(F.col("held").isNull() & (turn == F.col("first_content_hash")) & (turn == F.col("first_rel_path")))
    at = ["account_id", "rel_path"]
    known = files.groupBy(*at).agg(*(F.min_by(c, turn).alias(f"n_{c}") for c in ("provider", "remote_id", "url")))
    kept = media.join(known, at, "left")
    met = F.col("n_remote_id").isNotNull()
    kept = kept.select(
        "id", *at, "media_type", "bytes", "content_hash",
        F.coalesce("source_provider", "n_provider").alias("source_provider"), F.coalesce("remote_id", "n_remote_id").alias("remote_id"), F.coalesce("remote_url", "n_url").alias("remote_url"),
        "captured_at", "downloaded_at", "imported_at", F.when(met, now).otherwise(F.col("last_verified_at")).alias("last_verified_at"), "deleted_at",
    )
    added = fresh.join(media.select(*at), at, "left_anti").select(
        F.lit(None).cast("long").alias("id"), *at, "media_type", "bytes", "content_hash", F.col("provider").alias("source_provider"), "remote_id", F.col("url").alias("remote_url"),
        F.col("posted_at").alias("captured_at"), F.when(F.col("downloaded"), now).alias("downloaded_at"), F.when(~F.col("downloaded"), now).alias("imported_at"), now.alias("last_verified_at"), F.lit(None).cast("timestamp_ntz").alias("deleted_at"),
    )
    return kept.unionByName(added)


def mark_outcomes(index: DataFrame, outcomes: DataFrame, media: DataFrame, now: Column) -> DataFrame:
    """The remote rows after a run: state, note, one more attempt, its time, and the media row of finished items.

    Items that were only chosen to be fetched, or not reached, stay as they are.
    """
    done = outcomes.filter(F.col("outcome").isin("duplicate", "adopted", "downloaded")).select(*KEY, "outcome", "note")
    live = media.filter("deleted_at IS NULL AND remote_id IS NOT NULL").groupBy("account_id", "remote_id").agg(F.min("id").alias("media_id"))
    return marked(index.join(done, KEY, "left").join(live, ["account_id", "remote_id"], "left"), now)


def marked(rows: DataFrame, now: Column) -> DataFrame:
    """The same for rows of the index that have their ``outcome``, ``note`` and ``media_id``."""
    met = F.coalesce(F.col("outcome").isin("duplicate", "adopted", "downloaded"), F.lit(False))
    state = F.when((F.col("outcome") == "duplicate") | (F.col("note") == NOTES["held"]), "duplicate").when(met, "downloaded").otherwise(F.col("state"))
    return rows.select(
        *KEY, state.alias("state"), (F.col("attempts") + met.cast("int")).alias("attempts"), F.when(met, F.col("note")).otherwise(F.col("last_error")).alias("last_error"),
        F.when(met, F.coalesce("media_id", "media_file_id")).otherwise(F.col("media_file_id")).alias("media_file_id"), F.when(met, now).otherwise(F.col("last_attempt_at")).alias("last_attempt_at"),
    )


def run_summary(outcomes: DataFrame, discovered: DataFrame, backlog: DataFrame, by: str = "account_id") -> DataFrame:
    """Counts of final outcomes of each run, with what was discovered and what stays of the backlog.

    ``discovered(by)`` has a row an item, ``backlog(by)`` one an item that was open before the run.
    """
    count = lambda o: F.count_if(F.col("outcome") == o)
    done = outcomes.groupBy(by).agg(
        count("downloaded").alias("downloaded"), count("duplicate").alias("skipped_duplicate"), count("adopted").alias("skipped_existing"), count("failed").alias("failed"),
        F.coalesce(F.sum(F.when(F.col("outcome") == "downloaded", F.col("remote_bytes"))), F.lit(0)).alias("bytes_downloaded"), F.count("*").alias("processed"),
    )
    out = done.join(discovered.groupBy(by).agg(F.count("*").alias("discovered")), by, "left").join(backlog.groupBy(by).agg(F.count("*").alias("open")), by, "left")
    return out.fillna(0, ["discovered", "open"]).withColumn("remaining", F.greatest(F.col("open") - F.col("processed"), F.lit(0))).drop("open")


def path_collisions(items: DataFrame) -> DataFrame:
    """Paths of an account that several remote ids map to."""
    return items.groupBy("account_id", "path").agg(F.count_distinct("remote_id").alias("remote_ids")).filter("remote_ids > 1")


def seed_seconds(base_delay_ms: Column, transfer_seconds: float = 2.5) -> Column:
    """A guess of an item's seconds before anything was measured: the planned delay and a transfer."""
    return base_delay_ms / 1000.0 + transfer_seconds


def rolling_eta(samples: DataFrame, remaining: Column, window: int = 20, by: str = "account_id", order: tuple[str, ...] = ("ts", "id"), seeds: DataFrame | None = None) -> DataFrame:
    """Median of the last samples times what remains; null under two samples, 0 when nothing remains.

    ``seeds(by, seconds)``, one row a value of ``by``, count as the sample before all others.
    """
    rows = samples.filter("seconds > 0").withColumn("__seed", F.lit(False))
    if seeds is not None:
        rows = rows.unionByName(seeds.select(by, "seconds").withColumn("__seed", F.lit(True)), allowMissingColumns=True)
    last = Window.partitionBy(by).orderBy(F.desc("__seed"), *order).rowsBetween(1 - max(3, window), 0)
    rows = rows.withColumn("n", F.count("*").over(last)).withColumn("per_item", F.percentile("seconds", F.lit(0.5)).over(last))
    eta = F.when(remaining <= 0, F.lit(0).cast("long")).when(F.col("n") >= 2, F.bround(F.col("per_item") * remaining).cast("long"))
    return rows.withColumn("eta_seconds", eta).filter("NOT __seed").drop("__seed")
