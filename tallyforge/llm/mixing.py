"""Mixing sources to target weights by capped water-filling.

Each source has a size (words) and a weight. All weights together share a budget of words;
a source never gives more than ``max_epochs`` times its size, and what it cannot give goes
to the others by weight until nobody is above its cap. That level has a closed form: sorted
by cap/weight the capped sources are a prefix, so one pass of running sums over the table of
sources (one row each) finds it. Documents are then repeated a whole number of times, and the
fractional rest of a source is drawn in the seeded order of a hash of ``doc_id``: buckets of
that hash are summed first, only the one bucket in which the draw ends is ordered row by row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, hinted, n_words, saved, table

BUCKET_HEX = 4  # 65,536 buckets of the draw order for each source


def draw_key(doc_id: Column, seed: int) -> Column:
    """32 hex digits that order the documents of a source; a null id counts as ''."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def water_level(sources: DataFrame, weights: Sequence[int], max_epochs: int) -> DataFrame:
    """(source, source_size) -> plus weight, target. Works on one row per source, all in one task.

    Sources are a closed list of a corpus (at most some ten thousands); a column with a value
    for each host or document is no source.
    Sources in code point order, null last, take ``weights`` in turn, again and again.
    """
    unit = 1
    for w in weights:
        unit *= w
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cap = F.col("source_size") * max_epochs
    every = Window.partitionBy(F.lit(0))
    order = Window.partitionBy(F.lit(0)).orderBy(F.expr(f"source_size * {max_epochs * unit} div weight"), "rank")
    df = sources.withColumn("rank", rank)
    df = df.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    df = df.withColumn("total", F.sum("source_size").over(every))
    df = df.withColumn("_left", F.col("total") - F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    df = df.withColumn("_weights", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    # decimals: a product of a size and a sum of weights may pass 2^63
    df = df.withColumn("_capped", cap.cast("decimal(38,0)") * F.col("_weights") <= F.col("_left").cast("decimal(38,0)") * F.col("weight"))
    rest = F.col("total") - F.sum(F.when(F.col("_capped"), cap).otherwise(0)).over(every)
    shared = F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("weight"))).over(every)
    df = df.withColumn("_rest", rest).withColumn("_shared", shared)
    target = F.when(F.col("_capped"), cap.cast("double")).otherwise((F.col("_rest") * F.col("weight")).cast("double") / F.col("_shared").cast("double"))
    return df.select("source", "source_size", "weight", target.alias("target"))


def mixing_plan(slim: DataFrame, weights: Sequence[int], max_epochs: int) -> tuple[DataFrame, DataFrame]:
    """Of (doc_id, source, size, key): a row per source, and the drawn documents of the buckets in which draws end."""
    sums = saved(slim.groupBy("source", F.substring("key", 1, BUCKET_HEX).alias("bucket")).agg(F.sum("size").alias("bucket_size")))
    levels = water_level(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, max_epochs)
    whole = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size"))).cast("long")
    levels = levels.withColumn("whole", whole).withColumn("needed", F.col("target") - F.col("whole") * F.col("source_size"))
    run = Window.partitionBy("source").orderBy("bucket")
    named = levels.select(F.col("source").alias("s"), "needed")
    cum = sums.join(named, F.col("source").eqNullSafe(F.col("s"))).select("source", "bucket", "bucket_size", "needed", F.sum("bucket_size").over(run).alias("upto"))
    ends = cum.where(F.col("upto") > F.col("needed")).groupBy(F.col("source").alias("s")).agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("bucket_size")).alias("before")), "bucket").alias("end"))
    levels = saved(levels.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "whole", "needed", F.col("end.bucket").alias("end_bucket"), F.col("end.before").alias("before")))
    named = hinted(levels.select(F.col("source").alias("s"), "needed", "end_bucket", "before"))
    edge = slim.join(named, F.col("source").eqNullSafe(F.col("s")) & (F.substring("key", 1, BUCKET_HEX) == F.col("end_bucket")))
    edge = edge.groupBy("source", "doc_id", "key").agg(F.sum("size").alias("size"), F.first("before").alias("before"), F.first("needed").alias("needed"))
    run = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("upto", F.col("before") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    return levels, saved(edge.where(2 * F.col("upto") + F.col("size") <= 2 * F.col("needed")).select("source", "doc_id"))


NAMES = ("size", "source_size", "target", "repeats", "taken")


def mix_sources(df: DataFrame, weights: Sequence[int] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source", names: Sequence[str] = NAMES) -> DataFrame:
    """``df`` with columns size, source_size, target, repeats and taken = size * repeats.

    Rows that share id and source are drawn together, so repeated rows agree; equal keys of the
    draw are ordered by id. A null or empty text has size 0, a very long one counts with all its
    words, a null source is a source of its own, an empty table gives no rows. ``names`` are
    those of the five new columns: columns of ``df`` with these names are replaced, all others,
    whatever their names, stay as they are.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in names])
    sized = df.withColumn(names[0], n_words(F.col(text)))
    slim = saved(sized.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(names[0]).alias("size"), draw_key(F.col(doc_id), seed).alias("key")))
    levels, drawn = mixing_plan(slim, weights, max_epochs)
    return apply_plan(sized, levels, drawn, max_epochs, seed, doc_id, source, names)


def apply_plan(sized: DataFrame, levels: DataFrame, drawn: DataFrame, max_epochs: int, seed: int, doc_id: str, source: str, names: Sequence[str] = NAMES) -> DataFrame:
    own = dict(zip(levels.columns, fresh(sized, *[f"_{c}" for c in levels.columns]), strict=True))
    d_source, d_id, d = fresh(sized, "_d_source", "_d_id", "_d")
    levels = levels.select(*[F.col(c).alias(n) for c, n in own.items()])
    drawn = drawn.select(F.col("source").alias(d_source), F.col("doc_id").alias(d_id), F.lit(1).alias(d))
    out = sized.join(hinted(levels), F.col(source).eqNullSafe(F.col(own["source"])))
    out = out.join(hinted(drawn), F.col(source).eqNullSafe(F.col(d_source)) & F.col(doc_id).eqNullSafe(F.col(d_id)), "left")
    bucket = F.substring(draw_key(F.col(doc_id), seed), 1, BUCKET_HEX)
    extra = (F.col(own["needed"]) > 0) & (F.col(own["end_bucket"]).isNull() | (bucket < F.col(own["end_bucket"])) | F.col(d).isNotNull())
    repeats = F.least(F.col(own["whole"]) + F.when(extra, 1).otherwise(0), F.lit(max_epochs)).cast("int")
    size, source_size, target, times, taken = names
    return out.select(
        *sized.columns, F.col(own["source_size"]).alias(source_size), F.col(own["target"]).alias(target),
        repeats.alias(times), (F.col(size) * repeats).cast("long").alias(taken),
    )


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), draw_key(F.col("doc_id"), 17).alias("key")))
    levels, drawn = mixing_plan(slim, (5, 2, 1), 3)
    return apply_plan(slim, levels, drawn, 3, 17, "doc_id", "source").select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(r - 1) % 3 + 1] AS BIGINT) AS weight FROM s),
c AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total,
        CAST(coalesce(sum(3 * source_size) OVER (ORDER BY source_size * 30 // weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gone,
        CAST(sum(weight) OVER (ORDER BY source_size * 30 // weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS left_weight FROM w),
p AS (SELECT *, CAST(3 * source_size AS HUGEINT) * left_weight <= CAST(total - gone AS HUGEINT) * weight AS capped FROM c),
q AS (SELECT *, CAST(total - sum(CASE WHEN capped THEN 3 * source_size ELSE 0 END) OVER () AS BIGINT) AS rest,
        CAST(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () AS BIGINT) AS shared FROM p),
t AS (SELECT source, source_size, CASE WHEN capped THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(rest * weight AS DOUBLE) / CAST(shared AS DOUBLE) END AS target FROM q),
n AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t),
g AS (SELECT source, doc_id, k, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY ALL),
u AS (SELECT g.source, doc_id, g.size, n.target - n.whole * n.source_size AS needed,
        CAST(coalesce(sum(g.size) OVER (PARTITION BY g.source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS upto
      FROM g JOIN n ON g.source IS NOT DISTINCT FROM n.source),
x AS (SELECT source, doc_id FROM u WHERE needed > 0 AND 2 * upto + size <= 2 * needed)
SELECT d.doc_id, d.size, n.source_size, n.target,
       CAST(d.size * least(n.whole + CASE WHEN EXISTS (SELECT 1 FROM x WHERE x.source IS NOT DISTINCT FROM d.source AND x.doc_id IS NOT DISTINCT FROM d.doc_id) THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source
"""
