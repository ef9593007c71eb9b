"""Removal of repeated passages by overlapping windows of three lines, in DataFrame functions only.

Every run of three consecutive lines is hashed (96 bits). Of each window that occurs more than once, anywhere,
the occurrence in the smallest doc_id at the smallest position stays; every later one marks its three lines.
Marks of overlapping windows are merged as a set of covered positions, and the lines they cover are removed.

The windows travel as a few numbers. Minimum and count of each window are pre-aggregated before the shuffle,
so a window with a third of all rows costs a row for each task. The repeated windows are written to the shared
folder; joining windows to them is a plain sort-merge join, whose hot partitions Spark splits. Texts are
shuffled once, to meet their covered positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

WINDOW = 3


def _lines() -> Column:
    return F.split(F.col("text"), "\n", -1)


def _windows(docs: DataFrame) -> DataFrame:
    """``(id, h, pos, w1, w2)`` of every window; id and h (hash of the text) name a document."""
    lines = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), _lines().alias("ls")).where(F.size("ls") >= WINDOW)

    def window(i: Column) -> Column:
        three = [F.get("ls", i + k) for k in range(WINDOW)]
        return F.struct(i.alias("pos"), F.xxhash64(*three).alias("w1"), F.hash(*three).alias("w2"))

    return lines.select("id", "h", F.inline(F.transform(F.sequence(F.lit(0), F.size("ls") - WINDOW), window)))


def covered_positions(docs: DataFrame) -> DataFrame:
    """``(id, h, starts)``: where later occurrences of repeated windows begin, for documents that have any."""
    windows = _windows(docs)
    firsts = windows.groupBy("w1", "w2").agg(F.min(F.struct("id", "h", "pos")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated, _ = materialize(firsts.select("w1", "w2", F.col("first.id").alias("id_1"), F.col("first.h").alias("h_1"), F.col("first.pos").alias("pos_1")), "windows")
    same = F.col("id").eqNullSafe(F.col("id_1")) & (F.col("h") == F.col("h_1")) & (F.col("pos") == F.col("pos_1"))
    later = windows.join(repeated, ["w1", "w2"]).where(~same)
    return later.groupBy("id", "h").agg(F.collect_set("pos").alias("starts"))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with all its columns: text without the lines of later occurrences, and new columns n_lines and n_removed.

    Lines are what newline characters separate; an empty line counts. Documents of fewer than three lines have
    no window and stay as they are, null texts stay null with n_lines 0. Rows that repeat a doc_id and a text
    count as one document. Null ids come before all others. A document may end up empty. Columns named
    n_lines or n_removed are replaced.
    """
    covered = covered_positions(docs)
    covered = covered.select(F.col("id").alias("_ld_id"), F.col("h").alias("_ld_h"), F.col("starts").alias("_ld_starts"))
    joined = docs.join(covered, docs["doc_id"].cast("long").eqNullSafe(F.col("_ld_id")) & (F.xxhash64(docs["text"]) == F.col("_ld_h")), "left")
    lines = _lines()
    count = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))
    gone = F.flatten(F.transform("_ld_starts", lambda p: F.array(*(p + k for k in range(WINDOW)))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_ld_lines") - 1), gone)
    out = joined.select(*(docs[c] for c in docs.columns if c not in ("n_lines", "n_removed")), "_ld_starts", F.when(F.col("_ld_starts").isNotNull(), lines).alias("_ld_lines"), count.cast("long").alias("n_lines"))
    out = out.withColumn("_ld_kept", F.when(F.col("_ld_starts").isNotNull(), kept))
    text = F.when(F.col("_ld_kept").isNull(), F.col("text")).otherwise(F.array_join(F.transform("_ld_kept", lambda i: F.get("_ld_lines", i)), "\n"))
    out = out.withColumn("n_removed", F.coalesce(F.col("n_lines") - F.size("_ld_kept"), F.lit(0)).cast("long")).withColumn("text", text)
    out = out.withColumn("n_removed", F.when(F.col("_ld_kept").isNull(), F.lit(0).cast("long")).otherwise(F.col("n_removed")))
    return out.drop("_ld_starts", "_ld_lines", "_ld_kept")


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole table ``documents``: doc_id, text after removal, n_lines (before), n_removed."""
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_removed")


def dedup_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document, without passages that came earlier; n_chars follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


ORACLE_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i AS pos, ls[i + 1] || chr(10) || ls[i + 2] || chr(10) || ls[i + 3] AS win
      FROM l, unnest(range(0, len(ls) - 2)) AS t(i)),
later AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + d AS i FROM later, (VALUES (0), (1), (2)) AS v(d)),
kept AS (SELECT l.doc_id, string_agg(ls[t.i + 1], chr(10) ORDER BY t.i) AS text, count(*) AS n
         FROM l, unnest(range(0, len(ls))) AS t(i) WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = l.doc_id AND g.i = t.i) GROUP BY l.doc_id)
SELECT l.doc_id, CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       coalesce(len(ls), 0)::BIGINT AS n_lines, (coalesce(len(ls), 0) - coalesce(kept.n, 0))::BIGINT AS n_removed
FROM l LEFT JOIN kept ON l.doc_id = kept.doc_id
"""
