import collections
import datetime as dt
import math
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from recall.operators import schedule as sc
from recall.schema import CARD, REVIEW
from recall.sources import card_files as cf
from recall.streaming import reviews as rs

CARD_TOML = """id = {id}
question = "q{id}"
answer = "line1\\nline2"
last_reviewed = "2024-01-0{id}T10:00:00Z"
review_after_secs = 43200
tags = ["ignored"]
"""


def test_load_card_files_tags_from_folders(spark):
    root = tempfile.mkdtemp(prefix="cards-")
    for tag, ids in [("spanish", [1, 2]), ("math", [3])]:
        os.makedirs(os.path.join(root, tag))
        for i in ids:
            with open(os.path.join(root, tag, f"{i}.toml"), "w") as f:
                f.write(CARD_TOML.format(id=i))
    os.makedirs(os.path.join(root, "math", "deep"))
    with open(os.path.join(root, "math", "deep", "4.toml"), "w") as f:
        f.write(CARD_TOML.format(id=4))
    with open(os.path.join(root, "math", "bad.toml"), "w") as f:
        f.write("id = = 3\n")
    with open(os.path.join(root, "math", "notes.txt"), "w") as f:
        f.write("not a card")
    rows = cf.load_card_files(spark, root).collect()
    good = {r.id: (r.tag, r.answer, r.last_reviewed) for r in rows if r.error is None}
    assert good == {1: ("spanish", "line1\nline2", dt.datetime(2024, 1, 1, 10)),
                    2: ("spanish", "line1\nline2", dt.datetime(2024, 1, 2, 10)),
                    3: ("math", "line1\nline2", dt.datetime(2024, 1, 3, 10)),
                    4: ("deep", "line1\nline2", dt.datetime(2024, 1, 4, 10))}
    bad = [r for r in rows if r.error is not None]
    assert len(bad) == 1 and bad[0].path.endswith("bad.toml") and bad[0].tag == "math"


@pytest.mark.parametrize("tag", ["", "a b", "x,y", "k=v", "tag=z", "50%", "%41", "c++", "é ü"])
def test_tags_survive_folder_names(spark, tag):
    t = dt.datetime(2024, 2, 3, 4, 5, 6, 123456)
    cards = spark.createDataFrame([(1, "q", "a", None, "src", None, t, 86400, None)], CARD)
    root = tempfile.mkdtemp(prefix="cards-")
    cf.write_card_toml(cards.withColumn("tag", F.lit(tag)), root + "/toml")
    cf.write_card_files(cards, spark.createDataFrame([(1, tag)], "card_id long, tag string"), root + "/json")
    for got in (cf.load_card_files(spark, root + "/toml", glob="*.txt").collect(), cf.read_card_files(spark, root + "/json").collect()):
        assert [(r.id, r.tag, r.last_reviewed) for r in got] == [(1, tag, t)]
    if tag and not tag.startswith("tag="):  # a hand-made folder is the tag as it stands
        os.makedirs(f"{root}/own/{tag}")
        with open(f"{root}/own/{tag}/1.toml", "w") as f:
            f.write(CARD_TOML.format(id=1))
        assert [r.tag for r in cf.load_card_files(spark, root + "/own").collect()] == [tag]


@pytest.mark.parametrize("missing", ["id", "question", "answer", "last_reviewed", "review_after_secs", "tags"])
def test_a_card_file_without_a_required_field_is_quarantined(spark, missing):
    root = tempfile.mkdtemp(prefix="cards-")
    os.makedirs(root + "/t")
    with open(root + "/t/1.toml", "w") as f:
        f.write("\n".join(x for x in CARD_TOML.format(id=1).split("\n") if not x.startswith(missing + " ")))
    row = cf.load_card_files(spark, root).collect()[0]
    assert missing in row.error and row.id is None and row.question is None


def test_a_tag_gets_few_files(spark):
    t = dt.datetime(2024, 2, 3)
    cards = spark.createDataFrame([(i, "q", "a", None, "s", None, t, 86400, None) for i in range(200)], CARD).repartition(8)
    root = tempfile.mkdtemp(prefix="cards-") + "/out"
    cf.write_card_toml(cards.withColumn("tag", (F.col("id") % 3).cast("string")), root)
    assert all(len([f for f in files if f.endswith(".txt")]) <= 1 for _, _, files in os.walk(root))


def test_toml_round_trip(spark):
    t = dt.datetime(2024, 2, 3, 4, 5, 6, 123456)
    cards = spark.createDataFrame([(1, 'say "hi"\n\ttab\\', "a\u007f", None, "src", None, t, 86400, "qi.png")], CARD)
    root = tempfile.mkdtemp(prefix="cards-") + "/out"
    cf.write_card_toml(cards.withColumn("tag", F.lit("x,y")), root)
    got = cf.load_card_files(spark, root, glob="*.txt").collect()
    assert len(got) == 1 and got[0].error is None
    r = got[0]
    assert (r.question, r.answer, r.examples, r.last_reviewed, r.question_img, r.tag) == (
        'say "hi"\n\ttab\\', "a\u007f", None, t, "qi.png", "x,y")


T0 = dt.datetime(2024, 1, 1)


def hours(h):
    return T0 + dt.timedelta(hours=h)


def cards_of(spark, ids, secs=43200):
    return spark.createDataFrame([(c, "q", "a", None, None, None, T0, secs, None) for c in ids], CARD)


def run_batches(spark, batches, cards, compact_every=8, months=None):
    """One micro-batch for each list of rows."""
    paths, src = rs.ReviewStreamPaths.under(spark), tempfile.mkdtemp(prefix="src-") + "/reviews"
    for rows in batches:
        spark.createDataFrame(rows, REVIEW).coalesce(1).write.mode("append").parquet(src)
        rs.stream_reviews(spark, src, cards, paths, files_per_batch=None, compact_every=compact_every, months=months).awaitTermination()
    return paths


def test_stream_equals_batch_in_any_split(spark):
    rows = [(c, hours(h), (c * h) % 3 != 0) for c in range(5) for h in range(0, 60, 3)]
    src = tempfile.mkdtemp(prefix="src-") + "/reviews"
    # Files in shuffled time order: later answers may arrive before earlier ones.
    spark.createDataFrame(rows, REVIEW).repartition(4).write.parquet(src)
    cards = cards_of(spark, range(6))
    batch = sorted(sc.schedule_state(spark.createDataFrame(rows, REVIEW), cards.where("id < 5")).select(*rs.STATE_COLS).collect())
    due = []
    for every, files in ((2, 1), (1000, 1), (8, 3)):
        paths = rs.ReviewStreamPaths.under(spark)
        rs.stream_reviews(spark, src, cards, paths, files_per_batch=files, compact_every=every).awaitTermination()
        assert sorted(rs.current_state(spark, paths).collect()) == batch
        assert sorted(r[:3] for r in rs.history(spark, paths, every).select(*REVIEW.fieldNames()).collect()) == sorted(rows)
        due.append(sorted(rs.stream_due(spark, paths).collect()))
        assert all(r.due_at < r.as_of for r in due[-1])
    assert due[0] == due[1]  # compaction changes where state is read from, never the answer


def test_every_due_time_is_reported_once(spark):
    """A late failure, a late success and a card without any answer."""
    first = [(1, hours(1), True), (1, hours(30), True), (2, hours(2), False), (9, hours(200), True)]
    late = [(1, hours(20), False), (2, hours(3), True)]
    paths = run_batches(spark, [first, late, [(3, hours(300), True)]], cards_of(spark, (1, 2, 3, 9)), compact_every=2)
    got = sorted((r.batch_id, r.card_id, r.due_at) for r in rs.stream_due(spark, paths).collect())
    assert got == sorted([
        (0, 1, hours(30 + 48)), (0, 2, hours(2 + 6)), (0, 3, hours(12)),  # batch 0 sees all cards up to hour 200
        (1, 1, hours(30 + 12)), (1, 2, hours(3 + 12)),                    # new due times after the late answers
        (2, 9, hours(200 + 24))])


def test_late_answers_are_placed_in_time(spark):
    early = [(1, hours(h), True) for h in (1, 2, 4, 5)]
    late = [(1, hours(3), False), (1, hours(2), True)]
    paths = run_batches(spark, [early, late], cards_of(spark, [1]))
    got = rs.current_state(spark, paths).collect()[0]
    # Run after the late failure at 03:00: successes at 04:00 and 05:00.
    assert (got.streak, got.review_after_secs, got.last_reviewed) == (2, 21600 * 4, hours(5))
    assert rs.history(spark, paths).count() == 5


def test_history_obeys_its_keys(spark):
    rows = [(1, hours(1), True), (1, hours(1), False), (7, hours(1), True)]
    paths = run_batches(spark, [rows, [(1, hours(1), True), (1, hours(2), True)]], cards_of(spark, [1]))
    assert sorted((r.card_id, r.review_date, r.remembered) for r in rs.history(spark, paths).collect()) == [
        (1, hours(1), False), (1, hours(2), True)]
    assert [r.card_id for r in spark.read.parquet(paths.rejected).collect()] == [7]


def test_state_does_not_grow_with_a_run(spark):
    rows = [(1, hours(h), True) for h in range(40)]
    paths = run_batches(spark, [rows[:20], rows[20:]], cards_of(spark, [1]))
    state = spark.read.parquet(paths.state)
    assert state.count() == 2 and all(len(r.reported) <= 1 for r in state.collect())
    assert rs.current_state(spark, paths).first().streak == 40


def test_a_repeated_batch_changes_nothing(spark):
    rows = [(1, hours(1), True), (2, hours(2), False)]
    paths = run_batches(spark, [rows, [(1, hours(0), False)]], cards_of(spark, [1, 2]))
    before = [sorted(x.collect(), key=str) for x in (rs.current_state(spark, paths), rs.history(spark, paths), rs.stream_due(spark, paths))]
    rs._apply(spark, paths, 8, spark.createDataFrame([(1, hours(0), False)], REVIEW), 1)
    assert before == [sorted(x.collect(), key=str) for x in (rs.current_state(spark, paths), rs.history(spark, paths), rs.stream_due(spark, paths))]


def test_runs_are_the_digits_of_the_batch_id():
    for every in (2, 3, 8):
        for upto in range(200):
            runs = rs._runs(upto, every)
            assert [f for f, _ in runs] + [upto] == [0] * bool(runs) + [f + n for f, n in runs] + [upto] * (not runs)
            assert len(runs) <= (every - 1) * max(1, math.ceil(math.log(upto + 1, every)))


def test_forty_batches_read_no_more_than_ten(spark, monkeypatch):
    """Folders read in a batch, with a late answer in each; the result is that of a batch job."""
    every, read = 3, []
    real = rs._read_folders

    def counted(session, root, schema, names):
        read.extend((root.rsplit("/", 1)[1], n) for n in names)
        return real(session, root, schema, names)

    monkeypatch.setattr(rs, "_read_folders", counted)
    monkeypatch.setattr(rs, "BUCKETS", 4)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    paths, per_batch, rows = rs.ReviewStreamPaths.under(spark), [], []
    cards = cards_of(spark, range(4))
    rs._write_snapshot(rs._stored(cards), paths, -1)
    for k in range(40):
        new = [(k % 3, hours(5 * k), k % 4 != 0)] + ([(k % 3, hours(5 * (k - 3) + 1), k % 5 != 0)] if k >= 3 else [])
        rows += new
        del read[:]
        rs._apply(spark, paths, every, spark.createDataFrame(new, REVIEW), k)
        per_batch.append(collections.Counter(root for root, _ in read))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    peak = lambda root, batches: max(per_batch[k][root] for k in batches)
    for root in ("state", "snapshot", "due"):
        assert peak(root, range(24, 40)) <= peak(root, range(3, 10))
    assert peak("history", range(40)) <= 1 + 6 * 3 and max(p["due"] for p in per_batch) == 1
    assert len(rs._batches(spark, paths.state)) <= 2 * every and len(rs._batches(spark, paths.snapshot)) <= 3
    want = sc.schedule_state(spark.createDataFrame(rows, REVIEW), cards.where("id < 3")).select(*rs.STATE_COLS)
    assert sorted(rs.current_state(spark, paths).collect()) == sorted(want.collect())
    assert rs.history(spark, paths, every).count() == len(set(r[:2] for r in rows))
    assert len(os.listdir(paths.history.replace("file:", ""))) <= len(rs._runs(40, every)) + 2 * every


def _partition_filters(df):
    plan = df._jdf.queryExecution().toString()
    return [line for line in plan.splitlines() if "FileScan" in line]


def test_late_answers_read_only_their_buckets(spark):
    paths = run_batches(spark, [[(c, hours(c), True) for c in range(50)]], cards_of(spark, range(50)))
    rows = rs._history(spark, paths, [(0, 1)], [3, 5])
    scan = _partition_filters(rows)
    assert scan and all("PartitionFilters: [bucket" in line and "IN (3,5)" in line for line in scan)
    assert {r[0] for r in rows.select(rs._bucket().alias("b")).collect()} <= {3, 5}


def test_the_due_window_reads_only_its_days(spark):
    state = rs._stored(cards_of(spark, range(40))).withColumn(
        "due_at", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(card_id * 20 AS int))"))
    paths = rs.ReviewStreamPaths.under(spark)
    rs._write_snapshot(state, paths, 7, as_of=T0 + dt.timedelta(days=50))
    snapshot = rs._read(spark, paths.snapshot, rs.SNAPSHOT, [7])
    for since, end in ((50, 51), (60, 101), (100, 700), (450, 470)):
        window = rs._due_between(snapshot, T0 + dt.timedelta(days=since), T0 + dt.timedelta(days=end))
        assert sorted(r.card_id for r in window.collect()) == [c for c in range(40) if since <= 20 * c < end]
        assert all("PartitionFilters: [" in line and "due_day" in line.split("PartitionFilters")[1] for line in _partition_filters(window))
    days = {r[0] for r in snapshot.select("due_day").distinct().collect()}
    assert rs.ALREADY_DUE in days and rs.LATER in days and len(days) < 25


def test_a_due_time_that_comes_back_is_not_reported_again(spark):
    """Two late answers move the due time away and back to one that was reported before."""
    first = [(1, hours(h), True) for h in (10, 20, 30)] + [(9, hours(2000), True)]     # 43200 * 8
    away = [(1, hours(15), True)]                                                      # 43200 * 16
    back = [(1, hours(5), False), (1, hours(1), True)]                                 # 21600 * 16 = 43200 * 8
    paths = run_batches(spark, [first, away, back], cards_of(spark, (1, 9)), compact_every=2)
    got = [(r.batch_id, r.due_at) for r in rs.stream_due(spark, paths).collect() if r.card_id == 1]
    assert sorted(got) == [(0, hours(30 + 96)), (1, hours(30 + 192))]


def test_a_stream_without_batches_has_no_state(spark):
    paths = rs.ReviewStreamPaths.under(spark)
    assert rs.current_state(spark, paths).collect() == [] and rs.history(spark, paths).collect() == []
