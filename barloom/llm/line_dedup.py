"""Lines that many documents share, by levelled sorted runs of line hashes (DataFrame functions only).

A run is a table of (hash, number of documents), sorted by hash. Each batch of documents is merge-anti-joined with the runs so far: hashes that no run
holds become a run at level 0, so every hash stands in one run; what known hashes gain is a run of increments beside them. ``fanout`` runs
of a level are merged into one of the next, so a line is rewritten once per level and not once per batch. ``unseen`` gives the lines
of a batch that no earlier one holds, ``drop_frequent`` removes lines that enough documents hold.

Defined results: null or empty text is one empty line; empty keys (only white space) are never counted nor dropped; repeated
rows count as documents of their own; rows with null ids are kept as they are; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import SPACE_CHARS, ascii_lower, row_key, stage, text_of
from barloom.session import fresh_path

HASH = ["_b_h1", "_b_h2"]


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(SPACE_CHARS))


def lines(text: Column) -> Column:
    return F.split(text_of(text), "\n", -1)


def _hashed(df: DataFrame, key: str) -> DataFrame:
    """128-bit hash of the key column, so that different lines do not meet even among 1e12 of them."""
    return df.withColumns({HASH[0]: F.xxhash64(key), HASH[1]: F.xxhash64(F.lit(1), key)}).drop(key)


class LineRuns:
    """The runs of all batches so far. The driver holds only their folder names."""

    def __init__(self, spark: SparkSession, fanout: int = 4, min_chars: int = 1):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.levels: list[list[str]] = [[]]
        self.more: list[list[str]] = [[]]

    def _keys(self, docs: DataFrame, text: str) -> DataFrame:
        """A row for each document and different key in it."""
        keys = F.array_distinct(F.transform(lines(F.col(text)), line_key))
        return _hashed(docs.select(F.explode(keys).alias("_b_key")).filter(F.length("_b_key") >= self.min_chars), "_b_key")

    def _write(self, run: DataFrame, levels: list[list[str]], level: int) -> None:
        path = fresh_path(self.spark, f"line-run-{level}")
        run.repartitionByRange(*HASH).sortWithinPartitions(*HASH).write.parquet(path)
        if level == len(levels):
            levels.append([])
        levels[level].append(path)

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("_b_h1 long, _b_h2 long, _b_docs long").parquet(*paths)

    def _known(self) -> DataFrame | None:
        """The hashes of all runs, each once."""
        paths = [p for level in self.levels for p in level]
        return self._read(paths).select(*HASH) if paths else None

    def add(self, docs: DataFrame, text: str = "text") -> None:
        """Add the run of one batch: its new hashes, and what known ones gain. Levels that are full are merged."""
        batch = self._keys(docs, text).groupBy(*HASH).agg(F.count("*").alias("_b_docs"))
        known = self._known()
        if known is None:
            self._write(stage(batch, "batch"), self.levels, 0)
        else:
            met = stage(batch.join(known.withColumn("_b_old", F.lit(True)), HASH, "left"), "batch")
            self._write(met.filter("_b_old is null").drop("_b_old"), self.levels, 0)
            self._write(met.filter("_b_old").drop("_b_old"), self.more, 0)
        for levels in (self.levels, self.more):
            level = 0
            while level < len(levels) and len(levels[level]) >= self.fanout:
                full, levels[level] = levels[level], []
                # hashes of runs differ, so they are merged as they are; increments of one hash become one
                merged = self._read(full)
                self._write(merged if levels is self.levels else merged.groupBy(*HASH).agg(F.sum("_b_docs").alias("_b_docs")), levels, level + 1)
                level += 1

    def counts(self) -> DataFrame:
        """(hash, documents) over all runs."""
        paths = [p for levels in (self.levels, self.more) for level in levels for p in level]
        if not paths:
            return self.spark.createDataFrame([], "_b_h1 long, _b_h2 long, _b_docs long")
        return self._read(paths).groupBy(*HASH).agg(F.sum("_b_docs").alias("_b_docs"))

    def frequent(self, min_docs: int) -> DataFrame:
        """Hashes of keys in at least ``min_docs`` documents, as a table whose size is known when joins are planned."""
        return stage(self.counts().filter(F.col("_b_docs") >= min_docs).select(*HASH), "frequent")

    def unseen(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(document columns, line number, line) of the batch's lines that no earlier batch holds: the merge anti join."""
        rows = docs.select(*docs.columns, F.posexplode(lines(F.col(text))).alias("line_no", "line")).withColumn("_b_key", line_key(F.col("line")))
        known, rows = self._known(), _hashed(rows, "_b_key")
        return (rows if known is None else rows.join(known, HASH, "left_anti")).drop(*HASH)

    def drop_frequent(self, docs: DataFrame, min_docs: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept) for each row of ``docs``."""
        base = docs.select(F.col(doc_id).alias("_b_id"), text_of(F.col(text)).alias("_b_text"))
        base = base.select("*", *row_key(F.col("_b_id"), F.col("_b_text")))
        rows = base.select("_b_k1", "_b_k2", F.posexplode(lines(F.col("_b_text"))).alias("_b_pos", "_b_line"))
        rows = rows.select("_b_k1", "_b_k2", "_b_pos", line_key(F.col("_b_line")).alias("_b_key")).filter(F.length("_b_key") >= self.min_chars)
        gone = _hashed(rows, "_b_key").join(self.frequent(min_docs), HASH, "left_semi")
        gone = gone.groupBy("_b_k1", "_b_k2").agg(F.collect_set("_b_pos").alias("_b_gone"))
        out = base.join(gone, ["_b_k1", "_b_k2"], "left").withColumn("_b_lines", lines(F.col("_b_text")))
        left = F.array_except(F.sequence(F.lit(0), F.size("_b_lines") - 1), "_b_gone")
        kept = F.array_join(F.transform(left, lambda p: F.get("_b_lines", p)), "\n")
        return out.select(
            F.col("_b_id").alias(doc_id), F.size("_b_lines").cast("long").alias("n_lines"),
            F.when(F.col("_b_gone").isNull(), 0).otherwise(F.size("_b_gone")).cast("long").alias("n_dropped"),
            F.when(F.col("_b_gone").isNull(), F.col("_b_text")).otherwise(kept).alias("kept"),
        )


def batches(df: DataFrame, parts: int) -> list[DataFrame]:
    """A table as at most ``parts`` batches of whole files of like size, as they would arrive one after the other.

    Whatever was done to ``df`` stays: a batch is ``df`` itself with a range of file names, which Spark prunes when it lists files. A frame that does not come
    from files is one batch. The runs are read once per batch, so batches should be few and large.
    """
    try:
        found = df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
    except AnalysisException:
        return [df]
    files = sorted((r["path"], r["bytes"]) for r in found.distinct().collect())
    total, cuts, size = sum(b for _, b in files), [], 0
    for i, (_, b) in enumerate(files):
        if not cuts or size * parts >= total * len(cuts):
            cuts.append(i)
        size += b
    spans = [(files[a][0], files[b - 1][0]) for a, b in zip(cuts, [*cuts[1:], len(files)])]
    return [df.filter(F.col("_metadata.file_path").between(lo, hi)) for lo, hi in spans] or [df]
