"""Average reviews per month, kept current by a stream of answers.

The average over (card, month) of the number of reviews needs two sums: the reviews and the pairs. The reviews of a batch
add up; a pair counts once, however many batches hold reviews of it. So the pairs are kept as a mergeable table of partial
counts, (card, month, reviews), written by batch in runs that grow like the digits of the batch id (see ``reviews``), and
a batch asks the earlier runs only which of its own pairs they hold.

* **Reading**: runs are partitioned by month. A batch reads the months that it has rows of, in at most
  ``every`` - 1 runs of each length; answers of today do not read the months before, a late answer reads its own month.
* **Totals**: one row per batch, the sums after it. The average after a batch is read off this row.
* **Repeats**: every folder is named by batch id and overwritten, so a batch that runs again changes nothing.

``rows`` of a batch must be new in the history (the stream's ``added``): late answers are, repeated ones are not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recall.streaming import reviews as rs

NO_MONTH = -1  # the month of a review without a date
COUNTS = "card_id long, reviews long, month int"
TOTALS = "n_pairs long, n_reviews long"


def month_number(at: str) -> Column:
    """Months since year 0, an integer: a folder name that filters prune by."""
    return F.coalesce(F.year(at) * 12 + F.month(at) - 1, F.lit(NO_MONTH)).cast("int")


def month_counts(reviews: DataFrame) -> DataFrame:
    """(card_id, month, reviews): partial counts, which ``merged_counts`` adds up."""
    return reviews.groupBy("card_id", month_number("review_date").alias("month")).agg(F.count(F.lit(1)).alias("reviews"))


def merged_counts(counts: DataFrame) -> DataFrame:
    return counts.groupBy("card_id", "month").agg(F.sum("reviews").alias("reviews"))


@dataclass(frozen=True)
class MonthCounts:
    """The partial counts under ``root``; ``every`` runs of a length are merged into one."""

    root: str
    every: int = rs.COMPACT_EVERY

    @property
    def runs(self) -> str:
        return f"{self.root}/month_runs"

    @property
    def totals(self) -> str:
        return f"{self.root}/month_totals"

    def _write(self, counts: DataFrame, run: tuple[int, int]) -> None:
        rows = counts.select("card_id", "reviews", "month").hint("rebalance", "month")
        rows.write.mode("overwrite").partitionBy("month").parquet(f"{self.runs}/{rs._run_name(run)}")

    def counts(self, spark: SparkSession, runs: list[tuple[int, int]], months: list[int] | None = None) -> DataFrame:
        """Partial counts of some runs, of the named months alone: the others' folders are pruned."""
        rows = rs._read_folders(spark, self.runs, COUNTS + ", run string", [rs._run_name(r) for r in runs])
        rows = rows if months is None else rows.where(F.col("month").isin(months))
        return rows.select("card_id", "month", "reviews")

    def _steps(self, done: int) -> list[tuple[tuple[int, int], list[tuple[int, int]]]]:
        """(merged run, its parts) that ``done`` batches complete, shortest first."""
        steps, length = [], self.every
        while done and done % length == 0:
            part = length // self.every
            steps.append(((done - length, length), [(done - length + i * part, part) for i in range(self.every)]))
            length *= self.every
        return steps

    def add(self, batch_id: int, rows: DataFrame) -> None:
        """Take the rows that a batch added to the history."""
        spark = rows.sparkSession
        for _run, parts in self._steps(batch_id):  # replaced at the end of the batch before
            rs._delete(spark, [f"{self.runs}/{rs._run_name(p)}" for p in parts])
        self._write(month_counts(rows), (batch_id, 1))
        new = self.counts(spark, [(batch_id, 1)])
        months = [r[0] for r in new.select("month").distinct().collect()]  # of the calendar: few
        earlier = self.counts(spark, rs._runs(batch_id, self.every), months).select("card_id", "month", F.lit(True).alias("_held"))
        held = new.join(earlier.distinct(), ["card_id", "month"], "left")
        added = held.agg(F.count(F.when(F.col("_held").isNull(), F.lit(1))).alias("n_pairs"), F.coalesce(F.sum("reviews"), F.lit(0)).alias("n_reviews"))
        before = rs._read(spark, self.totals, TOTALS, [batch_id - 1] if batch_id else []).select("n_pairs", "n_reviews")
        sums = added.unionByName(before).agg(F.sum("n_pairs").alias("n_pairs"), F.sum("n_reviews").alias("n_reviews"))
        rs._write(sums, self.totals, batch_id)
        for run, parts in self._steps(batch_id + 1):
            self._write(merged_counts(self.counts(spark, parts)), run)

    def averages(self, spark: SparkSession) -> DataFrame:
        """(batch_id, n_pairs, n_reviews, avg_reviews_per_month) after every batch; the average is null while there is no review."""
        rows = rs._read(spark, self.totals, TOTALS, rs._batches(spark, self.totals))
        return rows.select(F.col("batch_id").cast("long").alias("batch_id"), "n_pairs", "n_reviews",
                           (F.col("n_reviews") / F.nullif("n_pairs", F.lit(0))).alias("avg_reviews_per_month"))

    def current(self, spark: SparkSession) -> DataFrame:
        """(card_id, month, reviews) of the whole history."""
        done = max(rs._batches(spark, self.totals), default=-1) + 1
        return merged_counts(self.counts(spark, rs._runs(done, self.every)))
