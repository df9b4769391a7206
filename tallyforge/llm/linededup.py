"""Line dedup: a suffix array over line ids by distributed prefix doubling.

Every line is an id, every document a sequence of ids that ends with the document. Ranks of
single lines double to ranks of 2, 4, 8... lines: the pair (rank of the first half, rank of
the second half) is sorted over all documents, and its place in that order is the new rank.
Suffixes whose rank nobody shares leave at once, so only repeated lines are ever sorted. A
suffix needs depth only up to its shortest run of ``min_words`` words. The suffixes that
need it are sorted to that depth, ties by document and line: that part of the suffix array is
walked in order, and each suffix is held against the one before. Where their longest common
prefix reaches the depth they are in one interval. The first suffix of an interval is the
original; the runs of the others are later copies. Overlapping runs merge into maximal
repeated runs, which are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, saved, skew_join, slices, table, trim

MIN_WORDS = 50
CHUNK_BYTES = 4_000_000  # text that is cut into lines at once; one text is never cut


def needed_lines(words: np.ndarray, min_words: int) -> np.ndarray:
    """By line: lines of the shortest run from there with ``min_words`` words; 0 where the text ends before."""
    upto = np.concatenate([[0], np.cumsum(words)])
    end = np.searchsorted(upto, upto[:-1] + min_words, side="left")
    return np.where(end < len(upto), end - np.arange(len(words)), 0)


def line_table(df: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """(doc, digest, line, c, need): one row for each line; c is the line's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, CHUNK_BYTES):
                docs, ids, needs = [], [], []
                for t in part.column(2).to_pylist():
                    lines = t.encode("utf-8", "surrogatepass").split(b"\n")
                    docs.append(len(lines))
                    ids.append(np.fromiter((xxhash.xxh64_intdigest(x) for x in lines), np.uint64, len(lines)).view(np.int64))
                    needs.append(needed_lines(np.fromiter((len(x.split()) for x in lines), np.int64, len(lines)), min_words))
                at = np.repeat(np.arange(len(docs)), docs)
                line = np.arange(len(at)) - np.repeat(np.cumsum(docs) - docs, docs)
                take = pa.array(at)
                columns = [part.column(0).take(take), part.column(1).take(take), pa.array(line, pa.int32()), pa.array(np.concatenate(ids)), pa.array(np.concatenate(needs), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc", "digest", "line", "c", "need"])
        trim()

    rows = df.where(F.col(text).isNotNull()).select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1 << 63)).alias("doc"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc long, digest long, line int, c long, need int")


def dense_ranks(pairs: DataFrame) -> DataFrame:
    """Of (c, c2, n): (c, c2, n, rank), rank counting the suffixes that sort before the pair.

    One range partitioning sorts the pairs; each task sums its own, and the task totals (one
    number for each partition) become offsets.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, before = TaskContext.get().partitionId(), 0
        for pdf in batches:
            upto = pdf["n"].cumsum() + before
            yield pd.DataFrame({"c": pdf["c"], "c2": pdf["c2"], "n": pdf["n"], "own": upto - pdf["n"], "task": task})
            before = int(upto.iloc[-1]) if len(upto) else before

    placed = saved(pairs.select("c", "c2", "n").repartitionByRange("c", "c2").sortWithinPartitions("c", "c2").mapInPandas(run, "c long, c2 long, n long, own long, task int"))
    totals = {r["task"]: r["n"] for r in placed.groupBy("task").agg(F.sum("n").alias("n")).collect()}
    offsets, before = [], 0
    for t in range(max(totals, default=-1) + 1):
        offsets.append(F.lit(before).cast("long"))
        before += totals.get(t, 0)
    rank = F.col("own") + F.element_at(F.array(*offsets), F.col("task") + 1) if offsets else F.col("own")
    return placed.select("c", "c2", "n", rank.alias("rank"))


def later_copies(here: DataFrame) -> DataFrame:
    """Of (doc, digest, line, need, c, c2): doc, digest, line and need of all but the first suffix of each interval.

    c ranks the first lines of a run, c2 its last lines; together they cover ``need`` lines. So
    in the order of (c, need, c2), the suffix array, neighbours that agree in the three have a
    common prefix of ``need`` lines at least. Equal suffixes may lie in several tasks: whether
    a task's first suffix goes on with an interval is told by the last of the task before.
    """
    keys, place = ["c", "need", "c2"], ["doc", "digest", "line"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        task, last = TaskContext.get().partitionId(), None
        for pdf in batches:
            if not len(pdf):
                continue
            now = pdf[keys].to_numpy(np.int64)
            reaches = np.concatenate([[last is None or (now[0] == last[keys].to_numpy(np.int64)[0]).all()], (now[1:] == now[:-1]).all(axis=1)])
            yield pdf[reaches].assign(task=task, kind=np.where((np.arange(len(pdf)) == 0) & (last is None), 1, 0)[reaches])
            last = pdf.iloc[-1:]
        if last is not None:
            yield last.assign(task=task, kind=2)

    array = here.select(*place, *keys).repartitionByRange(*keys, *place).sortWithinPartitions(*keys, *place)
    found = saved(array.mapInPandas(run, "doc long, digest long, line int, c long, need int, c2 long, task int, kind int"))
    goes_on, before = [], None
    for r in sorted(found.where("kind > 0").select("task", "kind", *keys).collect()):  # two of each task
        if r["kind"] == 1 and r[2:] == before:
            goes_on.append(r["task"])
        before = r[2:]
    return found.where((F.col("kind") == 0) | ((F.col("kind") == 1) & F.col("task").isin(goes_on))).select(*place, "need")


def repeated_runs(lines: DataFrame) -> DataFrame:
    """(doc, digest, first, last): maximal runs of lines that are later copies; ``last`` is exclusive."""
    place = ["doc", "digest", "line"]
    counted = saved(lines.groupBy("c").agg(F.count("*").alias("n")).where("n > 1"))
    cur = saved(skew_join(lines, counted, ["c"], place).drop("n").dropDuplicates(place))
    found, depth = [], 1
    while True:
        here = cur.where((F.col("need") >= depth) & (F.col("need") < 2 * depth))
        other = cur.select("doc", "digest", F.col("line").alias("line2"), F.col("c").alias("c2"))
        if depth == 1:
            here = here.withColumn("c2", F.lit(0).cast("long"))
        else:
            here = here.withColumn("line2", F.col("line") + F.col("need") - depth).join(other, ["doc", "digest", "line2"])
        here = saved(here.select(*place, "need", "c", "c2"))
        found.append(saved(later_copies(here).select("doc", "digest", F.col("line").alias("first"), (F.col("line") + F.col("need")).alias("last"))))
        most = cur.agg(F.max("need")).first()[0]
        if most is None or most < 2 * depth:
            break
        pairs = cur.withColumn("line2", F.col("line") + depth).join(other, ["doc", "digest", "line2"]).drop("line2")
        pairs = saved(pairs)
        ranks = dense_ranks(pairs.groupBy("c", "c2").agg(F.count("*").alias("n")).where("n > 1"))
        cur = saved(skew_join(pairs, ranks, ["c", "c2"], place).select(*place, F.col("rank").alias("c"), "need"))
        depth *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("doc", "digest").orderBy("first", "last")
    out = out.withColumn("reach", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    out = out.withColumn("run", F.sum(F.when(F.col("first") <= F.col("reach"), 0).otherwise(1)).over(order))
    return out.groupBy("doc", "digest", "run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("run")


NAMES = ("n_lines", "n_removed", "runs")


def dedup_lines(df: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text", names: tuple[str, str, str] = NAMES) -> DataFrame:
    """``df`` without later copies of line runs of at least ``min_words`` words; adds n_lines, n_removed, runs.

    ``runs`` lists the deleted runs as array<struct<first, last>> of line numbers. The original
    is the smallest (id, hash of the text, line), a null id first; that also decides ties. Rows
    that agree in id and text are one document. A null text stays null with 0 lines; an empty
    one has one empty line; a very long one is judged whole; an empty table gives no rows.
    ``names`` are those of the three new columns: columns of ``df`` with these names are
    replaced, all others, whatever their names, stay as they are.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in names])
    runs = repeated_runs(saved(line_table(df, min_words, doc_id, text)))
    doc, digest, cut = fresh(df, "_doc", "_digest", "_runs")
    runs = saved(runs.groupBy(F.col("doc").alias(doc), F.col("digest").alias(digest)).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias(cut)))
    keyed = (F.coalesce(F.col(doc_id).cast("long"), F.lit(-1 << 63)) == F.col(doc)) & (F.xxhash64(text) == F.col(digest))
    out = df.join(runs, keyed, "left")
    lines = F.split(F.col(text), "\n", -1)

    def between(k: Column) -> Column:
        """The lines between run k - 1 and run k; runs are sorted and apart."""
        last = F.coalesce(F.get(cut, k - 1)["last"], F.lit(0))
        return F.slice(lines, last + 1, F.coalesce(F.get(cut, k)["first"], F.size(lines)) - last)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size(cut)), between))
    removed = F.aggregate(cut, F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    n_lines, n_removed, all_runs = names
    return out.select(
        *[F.when(F.col(cut).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text) if c == text else F.col(c) for c in df.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_lines),
        F.coalesce(removed, F.lit(0)).cast("long").alias(n_removed),
        F.coalesce(cut, F.array().cast("array<struct<first:int,last:int>>")).alias(all_runs),
    )


def op9_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    runs = F.array_join(F.transform("runs", lambda r: F.concat_ws(":", r["first"].cast("string"), r["last"].cast("string"))), ",")
    return out.select("doc_id", "n_lines", "n_removed", runs.alias("runs"), "text")


OP9_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
w AS (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l),
c AS (SELECT *, CAST(sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS upto FROM w),
s AS (SELECT a.doc_id, a.i, min(b.i) + 1 AS stop FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.n >= {MIN_WORDS} GROUP BY ALL),
d AS (SELECT doc_id, list(line ORDER BY i) AS ls FROM l GROUP BY doc_id),
r AS (SELECT s.doc_id, s.i, s.stop, array_to_string(d.ls[s.i + 1:s.stop], chr(10)) AS run FROM s JOIN d USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS copy FROM r),
x AS (SELECT DISTINCT l.doc_id, l.i FROM l JOIN o ON o.doc_id = l.doc_id AND o.copy > 1 AND l.i >= o.i AND l.i < o.stop),
e AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM x),
-- runs that touch are one run
m AS (SELECT doc_id, string_agg(f || ':' || t, ',' ORDER BY f) AS runs, CAST(sum(t - f) AS BIGINT) AS n_removed FROM (SELECT doc_id, g, min(i) AS f, max(i) + 1 AS t FROM e GROUP BY ALL) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM l WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = l.doc_id AND x.i = l.i) GROUP BY doc_id)
SELECT documents.doc_id, CAST(CASE WHEN documents.text IS NULL THEN 0 ELSE len(string_split(documents.text, chr(10))) END AS BIGINT) AS n_lines,
       coalesce(m.n_removed, 0) AS n_removed, coalesce(m.runs, '') AS runs, CASE WHEN documents.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text
FROM documents LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id)
"""
