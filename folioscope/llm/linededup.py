"""Line de-duplication with levelled sorted runs of line hashes. Native: DataFrame functions only."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import new_path, remove, written

#: Stripped at both ends of a line.
BLANKS = " \t\n\x0b\x0c\r"
#: So many runs of a level are merged into one of the next.
FAN_OUT = 2
#: Batches of ids. With FAN_OUT the first level fills twice, is compacted twice into a second that fills as well, and the last batch meets runs of two levels.
BATCHES = FAN_OUT * FAN_OUT + 1


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case (only these: lower() is right for ASCII alone)."""
    bare = F.btrim(line, F.lit(BLANKS))
    slow = F.translate(bare, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(slow)


class LineRuns:
    """An index of line hashes that grows batch by batch: levels of sorted runs, compacted when a level is full.

    A run is a table bucketed and sorted by hash, with rows (h1, h2, n_docs, keep_doc). Each batch is merge-joined
    with the runs, bucket by bucket, and only the batch is shuffled. A key that no run has (anti-join) enters with its
    keep_doc; a key that some run has enters with its count alone. Compaction adds counts and keeps the one keep_doc.
    Runs are tables below the shared folder, so lost executors lose nothing. As a context manager it drops them at the end, also
    after a failure; only a driver that dies leaves tables named line_run_* behind.
    """

    def __init__(self, spark: SparkSession, n_buckets: int | None = None, fan_out: int = FAN_OUT) -> None:
        self.spark, self.fan_out = spark, fan_out
        self.n_buckets = n_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.paths: dict[str, str] = {}

    def __enter__(self) -> LineRuns:
        return self

    def __exit__(self, *failure: object) -> None:
        self.drop()

    def _write(self, df: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        dealt = df.repartition(self.n_buckets, "h1", "h2")
        self.paths[name] = new_path(self.spark, "line_run")
        dealt.write.bucketBy(self.n_buckets, "h1", "h2").sortBy("h1", "h2").format("parquet").option("path", self.paths[name]).saveAsTable(name)
        return name

    def _drop(self, run: str) -> None:
        """The table and, as its files lie at a path of their own, these too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        remove(self.spark, self.paths.pop(run))

    def runs(self) -> list[str]:
        return [r for level in self.levels for r in level]

    def fresh(self, batch: DataFrame) -> DataFrame:
        """The rows of batch (h1, h2, ...) whose key no run has."""
        for run in self.runs():
            batch = batch.join(self.spark.table(run).select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")
        return batch

    def add(self, batch: DataFrame) -> None:
        """Take in a batch with one row for each key: (h1, h2, n_docs, keep_doc)."""
        if self.runs():
            marked = self.fresh(batch).select("h1", "h2", F.lit(True).alias("new"))
            batch = batch.join(marked.hint("merge"), ["h1", "h2"], "left").select(
                "h1", "h2", "n_docs", F.when(F.col("new"), F.col("keep_doc")).alias("keep_doc")
            )
        self.levels[0].append(self._write(batch))
        for i, level in enumerate(self.levels):
            if len(level) < self.fan_out:
                break
            merged = self._write(self._merged(level))
            for run in level:
                self._drop(run)
            level.clear()
            if i + 1 == len(self.levels):
                self.levels.append([])
            self.levels[i + 1].append(merged)

    def _merged(self, runs: list[str]) -> DataFrame:
        """Bucketed runs merged by full outer merge joins, which need no shuffle."""
        rows = self.spark.table(runs[0])
        for run in runs[1:]:
            other = self.spark.table(run).select("h1", "h2", F.col("n_docs").alias("n"), F.col("keep_doc").alias("k"))
            rows = rows.join(other.hint("merge"), ["h1", "h2"], "full").select(
                "h1",
                "h2",
                (F.coalesce("n_docs", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n_docs"),
                F.coalesce("keep_doc", "k").alias("keep_doc"),
            )
        return rows

    def keys(self) -> DataFrame:
        """All keys, one row each."""
        return self._merged(self.runs())

    def drop(self) -> None:
        for run in self.runs():
            self._drop(run)
        self.levels = [[]]


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    batches: int = BATCHES,
) -> DataFrame:
    """Drop lines whose key, of at least min_chars code points, is in at least min_docs documents, but for the
    largest id that holds it.

    Lines are what stands between \\n; an empty or null text is one empty line. Batches are ranges of ids from the
    largest down, so the batch in which a key is first seen holds the document that keeps it. Rows with equal ids are
    one document: they count once and keep or lose a line together. A row with a null id counts for nothing and stays as
    it is. A text of any length is one row and is split once. Returns the columns of df with the text replaced (null stays null if no line went) and n_lines long, n_dropped long,
    replacing columns of these names; an empty table stays empty. Keys are 128-bit hashes.

    The text is read twice and moved once, beside the numbers of the lines to drop, and only these are gathered for each document.
    Counts are summed before the shuffle; a line that a third of all documents hold meets its key in a join whose side AQE
    can split or broadcast by measured size.
    """
    spark = df.sparkSession
    base = df.select(*[df[f"`{c}`"] for c in df.columns if c not in ("n_lines", "n_dropped")])
    doc, text = base[f"`{id_col}`"], F.coalesce(base[f"`{text_col}`"], F.lit(""))
    lines = F.split(text, "\n", -1)
    long = base.where(F.length(text) >= min_chars).where(doc.isNotNull())
    exploded = long.select(doc.alias("doc"), F.xxhash64(text).alias("mark"), F.posexplode(lines).alias("pos", "line"))
    exploded = exploded.where(F.length(F.btrim("line", F.lit(BLANKS))) >= min_chars).withColumn("key", line_key(F.col("line")))
    cuts = base.where(doc.isNotNull()).agg(F.percentile_approx(doc, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    edges = sorted(set(cuts), reverse=True)
    # numbered from the largest ids down; a folder for each batch, so that each is read once
    batch = sum((F.when(F.col("doc") <= e, 1).otherwise(0) for e in edges), F.lit(0))
    path = new_path(spark, "lines")
    rows = exploded.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), "key").alias("h2"), "doc", "mark", "pos", batch.alias("batch"))
    rows.write.partitionBy("batch").parquet(path)
    places = spark.read.schema(rows.schema).parquet(path)
    with LineRuns(spark) as index:
        for number in range(len(edges) + 1):
            found = places.where(F.col("batch") == number).select("h1", "h2", "doc").distinct()
            index.add(found.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc").alias("keep_doc")))
        common = written(index.keys().where(F.col("n_docs") >= min_docs), "common_lines")
    doomed = places.join(common, ["h1", "h2"]).where("doc <> keep_doc").groupBy("doc", "mark").agg(
        F.collect_set("pos").alias("drop")
    )
    left = base.withColumn("__mark", F.xxhash64(text))
    met = left.join(doomed.hint("shuffle_hash"), (doc == doomed["doc"]) & (left["__mark"] == doomed["mark"]), "left")
    kept_at = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("drop"))
    kept = F.array_join(F.transform(kept_at, lambda i: F.get(lines, i)), "\n")
    changed = F.when(F.col("drop").isNull(), base[f"`{text_col}`"]).otherwise(kept)
    return met.select(
        *[(changed if c == text_col else base[f"`{c}`"]).alias(c) for c in base.columns],
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
