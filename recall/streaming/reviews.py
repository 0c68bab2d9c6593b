"""Answers as a stream: keep history, schedules and due cards current, exactly, with late answers.

One streaming query reads the answer files; each micro-batch does, in order:

* **history**: the batch's rows of known cards, one per (card, time), none that the history already
  has, are appended; rows of unknown cards go to the rejected log;
* **state**: a card's state is what the closed form needs and no more: its last failure, last
  review, number of reviews and current run. Answers newer than the card's last review
  are folded into it; a card that got a late answer is replayed from its history;
* **due**: the cards that came due, each due time once. Cards whose state changed are
  looked at whatever their due time, all other cards (also those without any answer) in the
  window since the previous batch.

What a batch reads does not grow with the number of batches:

* **History** is a run of batches per folder (batch 0 to 63, 64 to 71, 72, ...; ``every`` runs of one length become
  one run), each partitioned by a hash bucket of the card. Its folders follow from the batch id alone, the
  digits of the id in base ``every``. Only late answers make a batch read history, and then
  only the buckets of their cards.
* **State** is a snapshot every ``every`` batches and the log folders after it. The snapshot is partitioned by
  the day a card is due: the window of a batch reads the days that it covers. Cards already due when
  the snapshot was written, which no window can reach, are one partition; those due after more than ``HORIZON`` days another.
* **Due times already reported** need no look at the due log. A state that was due before the last batch's time
  has been reported; a card whose state changes keeps such times, as far as the new state can still be due
  at them (not before its last review). So the due log is only written.

All folders are named by batch id and overwritten on replay, so a repeated batch changes nothing; what a later folder replaces is
deleted once the batch that wrote it is over. No watermark is used, so nothing is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.functions.text import due_at, interval_after, interval_overflows
from recall.operators.cards import accepted, quarantined
from recall.operators.schedule import dedupe_reviews, replay
from recall.schema import REVIEW
from recall.session import shared_dir

# Every COMPACT_EVERY batches the state log is folded into a snapshot, and as many history runs into one.
COMPACT_EVERY = 8
BUCKETS = 64      # of a history run, by card
HORIZON = 400     # days of a snapshot that are partitions of their own
ALREADY_DUE, LATER = -(2**31), 2**31 - 1  # the partitions around them

STATE = ("card_id long, base_secs long, last_fail timestamp_ntz, last_reviewed timestamp_ntz, review_after_secs long, "
         "n_reviews long, streak long, overflow boolean, due_at timestamp_ntz, reported array<timestamp_ntz>")
SNAPSHOT = STATE + ", due_day int"
HISTORY = "card_id long, review_date timestamp_ntz, remembered boolean, bucket int"
DUE = "card_id long, due_at timestamp_ntz, as_of timestamp_ntz"
STATE_COLS = ["card_id", "last_reviewed", "review_after_secs", "streak", "overflow"]


@dataclass
class ReviewStreamPaths:
    root: str

    def __post_init__(self):
        self.history, self.rejected, self.state, self.snapshot, self.due, self.checkpoint = (
            f"{self.root}/{name}" for name in ("history", "rejected", "state", "snapshot", "due", "_checkpoint"))

    @classmethod
    def under(cls, spark: SparkSession) -> "ReviewStreamPaths":
        return cls(shared_dir(spark, "review_stream"))


def _folder(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _batches(spark: SparkSession, path: str) -> list[int]:
    """Ids of the batch folders below ``path``."""
    fs, p = _folder(spark, path)
    if not fs.exists(p):
        return []
    return sorted(int(f.getPath().getName().split("=")[1]) for f in fs.listStatus(p) if "batch_id=" in f.getPath().getName())


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        fs, p = _folder(spark, path)
        fs.delete(p, True)


def _read_folders(spark: SparkSession, root: str, schema: str, names: list[str]) -> DataFrame:
    """The named folders below ``root`` and no others."""
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", root).parquet(*[f"{root}/{name}" for name in names])


def _read(spark: SparkSession, path: str, schema: str, ids) -> DataFrame:
    """The named batch folders, with ``batch_id``."""
    return _read_folders(spark, path, schema + ", batch_id int", [f"batch_id={i}" for i in ids])


def _write(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def _runs(upto: int, every: int) -> list[tuple[int, int]]:
    """(first, length) of the history runs that hold the batches before ``upto``: its digits in base ``every``."""
    runs, first, length = [], 0, 1
    while length * every <= upto:
        length *= every
    while length:
        while first + length <= upto:
            runs.append((first, length))
            first += length
        length //= every
    return runs


def _run_name(run: tuple[int, int]) -> str:
    return f"run={run[0]}-{run[1]}"


def _bucket(card: str = "card_id") -> Column:
    return F.pmod(F.xxhash64(card), F.lit(BUCKETS)).cast("int")


def _history(spark: SparkSession, paths: ReviewStreamPaths, runs: list[tuple[int, int]], buckets: list[int] | None = None) -> DataFrame:
    """The rows of some runs, of the named buckets alone: the others' folders are pruned."""
    rows = _read_folders(spark, paths.history, HISTORY + ", run string", [_run_name(r) for r in runs])
    return rows if buckets is None else rows.where(F.col("bucket").isin(buckets))


def _write_run(rows: DataFrame, paths: ReviewStreamPaths, run: tuple[int, int]) -> None:
    """A run's rows by bucket: few files each, more for a bucket with a hot card."""
    rows = rows.select("card_id", "review_date", "remembered", _bucket().alias("bucket")).hint("rebalance", "bucket")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{paths.history}/{_run_name(run)}")


def _merge_runs(spark: SparkSession, paths: ReviewStreamPaths, done: int, every: int) -> None:
    """After ``done`` batches: the runs that the last batch completed become one, and so on up."""
    length = every
    while done % length == 0:
        parts = [(done - length + i * (length // every), length // every) for i in range(every)]
        _write_run(_history(spark, paths, parts), paths, (done - length, length))
        length *= every


def _delete_merged(spark: SparkSession, paths: ReviewStreamPaths, done: int, every: int) -> None:
    """Delete the runs that ``_merge_runs`` replaced at the end of the batch before."""
    length = every
    while done and done % length == 0:
        _delete(spark, [f"{paths.history}/{_run_name((done - length + i * (length // every), length // every))}" for i in range(every)])
        length *= every


def _snapshot_before(batch_id: int, every: int) -> int:
    """Id of the newest snapshot written before ``batch_id``: -1 (the stored cards), every-1, 2*every-1, ..."""
    return (batch_id // every) * every - 1


def _view(spark: SparkSession, paths: ReviewStreamPaths, upto: int, snapshot: int) -> tuple[DataFrame, DataFrame]:
    """(snapshot, newest log row per card for the batches after it up to ``upto``)."""
    old = _read(spark, paths.snapshot, SNAPSHOT, [snapshot]).drop("batch_id")
    log = _read(spark, paths.state, STATE, range(snapshot + 1, upto + 1))
    values = [c for c in old.columns if c not in ("card_id", "due_day")]
    newest = log.groupBy("card_id").agg(F.max_by(F.struct(*values), "batch_id").alias("_s"))
    return old, newest.select("card_id", "_s.*")


def _with_schedule(state: DataFrame) -> DataFrame:
    failed = F.col("last_fail").isNotNull()
    secs = interval_after(F.col("base_secs"), failed, F.col("streak"))
    return state.select(
        "card_id", "base_secs", "last_fail", "last_reviewed", secs.alias("review_after_secs"), "n_reviews", "streak",
        interval_overflows(F.col("base_secs"), failed, F.col("streak")).alias("overflow"),
        due_at("last_reviewed", secs).alias("due_at"), "reported")


def _stored(cards: DataFrame) -> DataFrame:
    """The stored schedule of every card, as the state before any answer."""
    none = F.lit(None).cast("timestamp_ntz")
    return cards.select(
        F.col("id").alias("card_id"), F.col("review_after_secs").alias("base_secs"), none.alias("last_fail"), "last_reviewed",
        "review_after_secs", F.lit(0).cast("long").alias("n_reviews"), F.lit(0).cast("long").alias("streak"),
        F.lit(False).alias("overflow"), due_at("last_reviewed", "review_after_secs").alias("due_at"),
        F.array().cast("array<timestamp_ntz>").alias("reported"))


def _day(at: Column) -> Column:
    return F.datediff(at.cast("date"), F.lit("1970-01-01").cast("date"))


def _write_snapshot(state: DataFrame, paths: ReviewStreamPaths, batch_id: int, as_of=None) -> None:
    """By due day, each day's rows in order of ``due_at``; ``as_of`` is the time up to which due cards have been reported."""
    if as_of is None:
        start = state.agg(F.min("due_at")).first()[0]
    else:
        start = as_of
    day = _day(F.col("due_at"))
    if start is not None:
        begin = F.lit(start).cast("timestamp_ntz")
        day = F.when(day >= _day(begin) + HORIZON, LATER).otherwise(day)
        if as_of is not None:
            day = F.when(F.col("due_at") < begin, ALREADY_DUE).otherwise(day)
    dated = state.withColumn("due_day", F.coalesce(day, F.lit(LATER)).cast("int")).hint("rebalance", "due_day")
    dated.sortWithinPartitions("due_day", "due_at").write.mode("overwrite").partitionBy("due_day").parquet(
        f"{paths.snapshot}/batch_id={batch_id}")


def _due_between(snapshot: DataFrame, since, end) -> DataFrame:
    """The snapshot's cards due in [since, end): reads the days between, and the partition beyond the horizon."""
    until = F.lit(end).cast("timestamp_ntz")
    rows = snapshot.where((F.col("due_at") < until) & ((F.col("due_day") <= _day(until)) | (F.col("due_day") == LATER)))
    if since is None:
        return rows
    begin = F.lit(since).cast("timestamp_ntz")
    return rows.where((F.col("due_at") >= begin) & (F.col("due_day") >= _day(begin)))


def _reported_by(spark: SparkSession, paths: ReviewStreamPaths, batch_id: int):
    """The time up to which due cards have been reported after ``batch_id``."""
    marker = _read(spark, paths.due, DUE, [batch_id] if batch_id >= 0 else []).where(F.col("card_id").isNull())
    return marker.agg(F.max("as_of")).first()[0]


def _apply(spark: SparkSession, paths: ReviewStreamPaths, every: int, batch: DataFrame, batch_id: int, months=None) -> None:
    _delete_merged(spark, paths, batch_id, every)
    snapshot, since = _snapshot_before(batch_id, every), _reported_by(spark, paths, batch_id - 1)
    old, newest = _view(spark, paths, batch_id - 1, snapshot)
    cards = _read(spark, paths.snapshot, SNAPSHOT, [-1]).select("card_id")
    incoming = batch.select("card_id", "review_date", "remembered")
    _write(quarantined(incoming, cards, "card_id"), paths.rejected, batch_id)
    rows = dedupe_reviews(accepted(incoming, cards, "card_id"))
    touched = rows.select("card_id").distinct()
    before = old.drop("due_day").join(touched, "card_id", "left_semi").join(newest.select("card_id"), "card_id", "left_anti").unionByName(
        newest.join(touched, "card_id", "left_semi"))

    # Only rows not newer than the card's last review can repeat a stored one.
    seen = before.select("card_id", F.when(F.col("n_reviews") > 0, F.col("last_reviewed")).alias("_seen"))
    rows = rows.join(seen, "card_id")
    is_late = F.coalesce(F.col("review_date") <= F.col("_seen"), F.lit(False))
    late = rows.where(is_late).drop("_seen")
    buckets = sorted(r[0] for r in late.select(_bucket().alias("bucket")).distinct().collect())  # BUCKETS at most
    past = _history(spark, paths, _runs(batch_id, every), buckets).select("card_id", "review_date", "remembered")
    if buckets:
        known = past.join(late.select("card_id").distinct(), "card_id", "left_semi")
        late = late.join(known.select("card_id", "review_date"), ["card_id", "review_date"], "left_anti")
    _write_run(rows.where(~is_late).drop("_seen").unionByName(late), paths, (batch_id, 1))

    added = _history(spark, paths, [(batch_id, 1)]).select("card_id", "review_date", "remembered")
    change = replay(added).select("card_id", F.col("last_fail").alias("_fail"), F.col("last_review").alias("_last"),
                                  F.col("n_reviews").alias("_n"), F.col("streak").alias("_run"))
    folded = before.join(change, "card_id").select(
        "card_id", "base_secs", F.coalesce("_fail", "last_fail").alias("last_fail"), F.col("_last").alias("last_reviewed"),
        (F.col("n_reviews") + F.col("_n")).alias("n_reviews"),
        F.when(F.col("_fail").isNull(), F.col("streak") + F.col("_run")).otherwise(F.col("_run")).alias("streak"),
        F.col("due_at").alias("_due"), "reported")
    if buckets:
        behind = added.join(before.where("n_reviews > 0").select("card_id", F.col("last_reviewed").alias("_seen")), "card_id").where(
            F.col("review_date") <= F.col("_seen")).select("card_id").distinct()
        whole = past.unionByName(added).join(behind, "card_id", "left_semi")
        again = before.select("card_id", "base_secs", F.col("due_at").alias("_due"), "reported").join(replay(whole), "card_id").select(
            "card_id", "base_secs", "last_fail", F.col("last_review").alias("last_reviewed"), "n_reviews", "streak", "_due", "reported")
        folded = folded.join(behind, "card_id", "left_anti").unionByName(again)
    # Due times before the last batch's time have been reported; those before the last review cannot come again.
    was_due = F.coalesce(F.col("_due") < F.lit(since).cast("timestamp_ntz"), F.lit(False))
    reported = F.when(was_due, F.array_union("reported", F.array("_due"))).otherwise(F.col("reported"))
    again_possible = F.filter(reported, lambda t: (t >= F.col("last_reviewed")) | (F.col("base_secs") < 0))
    _write(_with_schedule(folded.withColumn("reported", again_possible)), paths.state, batch_id)
    as_of = _log_due(spark, paths, batch_id, added, snapshot, since)
    if months is not None:
        months.add(batch_id, added)
    _merge_runs(spark, paths, batch_id + 1, every)
    if (batch_id + 1) % every == 0:
        old, newest = _view(spark, paths, batch_id, snapshot)
        _write_snapshot(old.drop("due_day").join(newest.select("card_id"), "card_id", "left_anti").unionByName(newest), paths, batch_id, as_of)
        # No later batch or replay reads these.
        _delete(spark, [f"{paths.state}/batch_id={i}" for i in _batches(spark, paths.state) if i <= snapshot])
        _delete(spark, [f"{paths.snapshot}/batch_id={i}" for i in _batches(spark, paths.snapshot) if -1 < i < snapshot])


def _log_due(spark: SparkSession, paths: ReviewStreamPaths, batch_id: int, added: DataFrame, snapshot: int, since):
    """Append the cards that came due by this batch's ``as_of``, the newest review applied so far, which is returned.

    A null card marks the batch's ``as_of``.
    """
    newest_review = added.agg(F.max("review_date")).first()[0]
    as_of = max((t for t in (since, newest_review) if t is not None), default=None)
    end, begin = F.lit(as_of).cast("timestamp_ntz"), F.lit(since).cast("timestamp_ntz")
    old, newest = _view(spark, paths, batch_id, snapshot)
    changed = _read(spark, paths.state, STATE, [batch_id])
    columns = ["card_id", "due_at"]
    in_window = (F.col("due_at") < end) & ((F.col("due_at") >= begin) if since is not None else F.lit(True))
    same = _due_between(old, since, as_of).select(*columns).join(newest.select("card_id"), "card_id", "left_anti").unionByName(
        newest.where(in_window).select(*columns).join(changed.select("card_id"), "card_id", "left_anti"))
    moved = changed.where((F.col("due_at") < end) & ~F.array_contains("reported", F.col("due_at"))).select(*columns)
    marker = spark.range(1).select(F.lit(None).cast("long").alias("card_id"), F.lit(None).cast("timestamp_ntz").alias("due_at"))
    _write(same.unionByName(moved).unionByName(marker).withColumn("as_of", end), paths.due, batch_id)
    return as_of


def stream_reviews(spark: SparkSession, source_dir: str, cards: DataFrame, paths: ReviewStreamPaths,
                   files_per_batch: int | None = 1, available_now: bool = True, compact_every: int = COMPACT_EVERY,
                   months=None):
    """Start the query; returns its handle. A new stream begins from the cards' stored schedules.

    ``months`` (``months.MonthCounts``) is told of each batch's new rows; it must be given from the first batch on.
    """
    if not _batches(spark, paths.snapshot):
        _write_snapshot(_stored(cards), paths, -1)
    reader = spark.readStream.schema(REVIEW)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    trigger = {"availableNow": True} if available_now else {"processingTime": "10 seconds"}
    return (reader.parquet(source_dir).writeStream.trigger(**trigger)
            .foreachBatch(lambda batch, i: _apply(batch.sparkSession, paths, compact_every, batch, i, months))
            .option("checkpointLocation", paths.checkpoint).start())


def current_state(spark: SparkSession, paths: ReviewStreamPaths) -> DataFrame:
    """Current schedule of every card that the stream has seen an answer of; empty before the first batch."""
    batches = _batches(spark, paths.state)
    if not batches:
        return spark.createDataFrame([], STATE).select(*STATE_COLS)
    last = batches[-1]
    snapshot = max(i for i in _batches(spark, paths.snapshot) if i <= last)
    old, newest = _view(spark, paths, last, snapshot)
    merged = old.drop("due_day").join(newest.select("card_id"), "card_id", "left_anti").unionByName(newest)
    return merged.where("n_reviews > 0").select(*STATE_COLS)


def history(spark: SparkSession, paths: ReviewStreamPaths, every: int = COMPACT_EVERY) -> DataFrame:
    """The review history that the stream has appended; ``every`` as the stream was started with."""
    done = max(_batches(spark, paths.state), default=-1) + 1
    return _history(spark, paths, _runs(done, every)).select(*REVIEW.fieldNames())


def stream_due(spark: SparkSession, paths: ReviewStreamPaths) -> DataFrame:
    """(batch_id, card_id, due_at, as_of): each due time of a card once, in the first batch that has passed it."""
    rows = _read(spark, paths.due, DUE, _batches(spark, paths.due))
    return rows.where(F.col("card_id").isNotNull()).select(F.col("batch_id").cast("long").alias("batch_id"), "card_id", "due_at", "as_of")
