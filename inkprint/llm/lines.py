"""Line dedup: levelled sorted runs of line hashes that each new batch merge-anti-joins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.functions.text import let
from inkprint.llm.tables import ascii_lower
from inkprint.storage import drop_at_end, new_path, stored

MIN_DOCS = 10
MIN_CHARS = 1
# Runs of one level that are merged into one of the next.
FANOUT = 2
_SPACE = " \t\n\x0b\x0c\r"
_KEY = ["h1", "h2"]


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(_SPACE)))


def _marked_lines(text: Column, min_chars: int) -> Column:
    """(h1, h2, place, first) of every line whose key has ``min_chars``, in order of the hashes.

    The hashes are 128 bits of the key, by two seeds; ``place`` counts from 0; ``first`` marks one line of each key.
    """

    def hashed(line: Column, i: Column) -> Column:
        parts = lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit("line"), k).alias("h2"), i.alias("place"))
        return let(line_key(line), lambda k: F.when(F.char_length(k) >= min_chars, parts(k)))

    def marked(found: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            before = F.get(found, i - 1)
            return x.withField("first", (i == 0) | (before["h1"] != x["h1"]) | (before["h2"] != x["h2"]))

        return F.transform(found, one)

    return let(F.sort_array(F.filter(F.transform(lines_of(text), hashed), lambda x: x.isNotNull())), marked)


def hash_lines(docs: DataFrame, batches: int = 1, min_chars: int = MIN_CHARS) -> DataFrame:
    """A written table (_row, _batch, _all, _lines): the only pass that hashes lines.

    ``_all`` holds all columns but n_lines and n_dropped, ``_batch`` is a hash of the id.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    hashed = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("_batch"),
        F.struct(*columns).alias("_all"),
        _marked_lines(F.col("text"), min_chars).alias("_lines"),
    )
    return stored(hashed, "hashed-lines")


class LineRuns:
    """Document counts of line keys in sorted runs, levelled as batches come.

    A run is a table (h1, h2, n_docs) in the shared folder, dealt by hash to ``buckets`` files and sorted in each. All runs have the same buckets:
    a batch meets them, and two of them are merged, bucket by bucket, and no run is ever shuffled. ``fanout`` runs of a level are compacted
    into one run of the next, two at a time, which sums their counts; so a key's count is spread over a logarithmic number of runs. The
    runs are external tables of the session's catalog until ``drop``.
    """

    def __init__(
        self, spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, fanout: int = FANOUT, buckets: int | None = None
    ) -> None:
        self.spark, self.min_docs, self.min_chars, self.fanout = spark, min_docs, min_chars, fanout
        # as many as a batch's own shuffle has, so that counting deals it as the runs are dealt
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self._names: list[str] = []

    def _write(self, counts: DataFrame) -> DataFrame:
        path, name = new_path(self.spark, "line-run"), f"line_run_{uuid.uuid4().hex}"
        counts.write.format("parquet").bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("path", path).saveAsTable(name)
        drop_at_end(self.spark, path)
        self._names.append(name)
        return self.spark.table(name)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        """The counts of all runs, each key once; two runs meet in a merge join, and what is merged further is a run itself."""
        while len(runs) > 1:
            a, b = (run.alias(name) for run, name in zip(runs, "ab"))
            both = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in _KEY], "full")
            n_docs = F.coalesce("a.n_docs", F.lit(0)) + F.coalesce("b.n_docs", F.lit(0))
            joined = both.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in _KEY], n_docs.alias("n_docs"))
            runs = [joined if len(runs) == 2 else self._write(joined), *runs[2:]]
        return runs[0]

    def frequent(self) -> DataFrame:
        """(h1, h2) of keys found in at least ``min_docs`` documents of all batches so far."""
        # the smallest first
        runs = [run for level in self.levels for run in level]
        if not runs:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        return self._merged(runs).where(F.col("n_docs") >= self.min_docs).select(*_KEY)

    def add(self, batch: DataFrame) -> None:
        """Count the keys of these documents as the next batch."""
        self.add_hashed(hash_lines(batch, min_chars=self.min_chars))

    def add_hashed(self, hashed: DataFrame) -> None:
        """Count the batch's keys, each once a document, merge-anti-join the runs, and add what is left as a run."""
        self.levels[0].append(self._write(self._unseen(hashed)))
        self._compact()

    def _unseen(self, hashed: DataFrame) -> DataFrame:
        """(h1, h2, n_docs) of the batch's keys but those that the runs together already count as frequent."""
        keys = hashed.select(F.inline("_lines")).where("first").select(*_KEY)
        counts = keys.groupBy(*_KEY).agg(F.count("*").alias("n_docs"))
        runs = [run for level in self.levels for run in level]
        seen = F.lit(0)
        for i, run in enumerate(runs):
            # either side has one row a key: no hot key is left to join
            counts = counts.join(run.withColumnRenamed("n_docs", f"_n{i}"), _KEY, "left")
            seen = seen + F.coalesce(f"_n{i}", F.lit(0))
        return counts.where(seen < self.min_docs).select(*_KEY, "n_docs")

    def _compact(self) -> None:
        for level, runs in enumerate(self.levels):
            if len(runs) >= self.fanout:
                if level + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[level + 1].append(self._write(self._merged(runs)))
                runs.clear()

    def drop(self) -> None:
        """Take the runs' names out of the catalog; their files go when the session ends."""
        for name in self._names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self._names, self.levels = [], [[]]

    def without_frequent(self, hashed: DataFrame) -> DataFrame:
        """The columns of a ``hash_lines`` table with kept lines only in ``text``, plus n_lines and n_dropped.

        Places of dropped lines come from a merge join of narrow hash rows; texts move once, to meet their places.
        """
        places = hashed.select("_row", F.inline("_lines"))
        # written first: a join of plain exchanges lets Spark split the rows of a hot line
        frequent = stored(self.frequent(), "frequent-lines")
        hits = places.select("_row", "place", *_KEY).join(frequent, _KEY, "left_semi")
        drops = hits.groupBy("_row").agg(F.collect_list("place").alias("_drop"))
        met = hashed.select("_row", "_all").join(drops, "_row", "left")
        lines = lines_of(F.col("_all.text"))
        none = F.col("_drop").isNull()

        def kept(own: Column) -> Column:
            left = F.array_except(F.sequence(F.lit(0), F.size(own) - 1), F.col("_drop"))
            return F.array_join(F.transform(left, lambda i: F.get(own, i)), "\n")

        # split once, not once a line
        text = F.when(none, F.col("_all.text")).otherwise(let(lines, kept))
        return met.select(
            *[(text if c == "text" else F.col(f"_all.`{c}`")).alias(c) for c in hashed.schema["_all"].dataType.names],
            F.size(lines).cast("long").alias("n_lines"),
            F.when(none, F.lit(0)).otherwise(F.size("_drop")).cast("long").alias("n_dropped"),
        )


def dedup_lines(docs: DataFrame, batches: int = 3, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines whose key is in at least ``min_docs`` documents, plus n_lines and n_dropped.

    A key is a line stripped of ASCII white space with A-Z lower-cased; keys under ``min_chars`` code points stay. Lines are hashed once, in a
    written table. Documents come in ``batches`` by hash of their id, each merge-anti-joining the runs before it adds its own; then all
    documents meet the finished runs, so the result does not depend on the batches. A null or empty text is one empty line; a null
    text stays null. A row is a document, also where ids repeat; other columns pass through,
    but for columns that are already named n_lines or n_dropped. An empty table gives no rows.
    """
    hashed = hash_lines(docs, batches, min_chars)
    runs = LineRuns(docs.sparkSession, min_docs, min_chars)
    for b in range(batches):
        runs.add_hashed(hashed.where(F.col("_batch") == b))
    kept = runs.without_frequent(hashed)
    runs.drop()
    return kept
