"""Discovery of physical folders for manifest folders, from sampled anchor files.

Works on an inventory of candidates (folder, norm_name, norm_below, size_bytes, readable)
instead of probing directories one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import below_top
from ..lineage import saved


def frequencies(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(norm_filename, path_count) and (norm_below, top_count)."""
    names = manifest.groupBy("norm_filename").agg(F.countDistinct("norm_path").alias("path_count"))
    below = manifest.withColumn("norm_below", below_top(F.col("norm_path"))).where("norm_below is not null").groupBy("norm_below").agg(F.countDistinct("norm_top_folder").alias("top_count"))
    return names, below


def anchors(manifest: DataFrame, most: int = 5) -> DataFrame:
    """At most ``most`` anchors of each top folder: known sizes first, one of each parent folder, then the rest, then unknown sizes."""
    known = F.col("size_known") == 1
    rep = F.min_by(F.struct("relative_path", "norm_filename"), F.struct("relative_path", "tape", "source_pdf", "source_page"))
    paths = manifest.groupBy("norm_top_folder", "norm_path").agg(
        rep.alias("rep"), F.countDistinct(F.when(known, F.struct("size_min_bytes", "size_max_bytes"))).alias("ranges"), F.count_if(~known).alias("unknown"), F.min("size_min_bytes").alias("lo"), F.max("size_max_bytes").alias("hi"),
    )
    names, tops = frequencies(manifest)
    paths = paths.withColumns({"norm_below": below_top(F.col("norm_path")), "norm_filename": F.col("rep.norm_filename")}).where("norm_below is not null")
    sized = (F.col("ranges") == 1) & (F.col("unknown") == 0)
    paths = paths.join(names, "norm_filename").join(tops, "norm_below", "left")
    parent = F.when(F.instr("norm_below", "/") > 0, F.regexp_extract("norm_below", "^(.*)/[^/]*$", 1)).otherwise("")
    paths = paths.withColumns({"sized": sized, "parent": parent, "distinctive": F.coalesce(F.col("top_count") == 1, F.lit(False))})
    order = ["path_count", "parent", "norm_path"]
    first = F.row_number().over(Window.partitionBy("norm_top_folder", "sized", "parent").orderBy(*order)) == 1
    tier = F.when(F.col("sized"), F.when(first, 0).otherwise(1)).otherwise(2)
    place = F.row_number().over(Window.partitionBy("norm_top_folder").orderBy("tier", *order))
    chosen = paths.withColumn("tier", tier).withColumn("place", place).where(F.col("place") <= most)
    return chosen.select("norm_top_folder", "norm_path", "norm_below", "sized", F.when(F.col("sized"), F.col("lo")).alias("lo"), F.when(F.col("sized"), F.col("hi")).alias("hi"), "distinctive", "place")


def scores(manifest: DataFrame, inventory: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates of each top folder with their anchor counts and rank: folders of the same name, or any folder that has a distinctive anchor.

    ``chosen``: the anchors. A path that several files of a folder share after normalisation
    counts as absent. Rank 1 has most matched sizes, then most matched paths, then fewest wrong
    sizes, then the lowest folder.
    """
    tops = manifest.select("norm_top_folder").distinct()
    folders = inventory.select("folder", "norm_name", "readable").distinct()
    named = tops.join(folders, tops["norm_top_folder"] == folders["norm_name"]).select("norm_top_folder", "folder", "readable", F.lit(False).alias("fallback"))
    unnamed = tops.join(named.select("norm_top_folder").distinct(), "norm_top_folder", "left_anti")
    files = inventory.where("norm_below is not null").groupBy("folder", "readable", "norm_below").agg(F.count("*").alias("n"), F.min("size_bytes").alias("size_bytes")).where("n = 1")
    far = chosen.where("distinctive").join(unnamed, "norm_top_folder", "left_semi")
    hits_near = named.join(chosen, "norm_top_folder").join(files.drop("readable", "n"), ["folder", "norm_below"], "left")
    hits_far = far.join(files.drop("n"), "norm_below").withColumn("fallback", F.lit(True))
    cols = ["norm_top_folder", "folder", "readable", "fallback", "sized", "lo", "hi", "size_bytes"]
    hits = hits_near.select(*cols).unionByName(hits_far.select(*cols))
    hit, sized, inside = F.col("size_bytes").isNotNull(), F.col("sized"), F.col("size_bytes").between(F.col("lo"), F.col("hi"))
    found = hits.groupBy("norm_top_folder", "folder", "readable", "fallback").agg(
        F.count_if(hit).alias("path_matched"), F.count_if(hit & sized & inside).alias("size_matched"), F.count_if(hit & sized & ~inside).alias("size_mismatched"), F.count_if(hit & ~sized).alias("unknown_matched"),
    )
    best = Window.partitionBy("norm_top_folder").orderBy(F.desc("size_matched"), F.desc("path_matched"), "size_mismatched", "folder")
    return found.withColumn("rank", F.row_number().over(best))


METRICS = ("path_matched", "size_matched", "size_mismatched", "unknown_matched")
#: Column names of a mapping, which ``roots.matched_roots`` reads back.
METRIC_NAMES = ("anchors_path_matched", "anchors_size_matched", "anchors_size_mismatched", "unknown_size_paths_matched")


def mapping(manifest: DataFrame, inventory: DataFrame, most: int = 5, least: int = 2) -> DataFrame:
    """Status, reason, chosen folder and its counts for each top folder, which shows its lowest display name.

    The chosen folder is the one with strong evidence, or the only candidate; without a choice
    the counts are those of the best candidate.
    """
    chosen = saved(anchors(manifest, most))
    s = scores(manifest, inventory, chosen)
    strong = (F.col("size_matched") >= least) & (F.col("size_mismatched") == 0) & F.col("readable")
    plausible = (F.col("path_matched") > 0) & (F.col("size_mismatched") == 0)
    row = F.struct("folder", *METRICS)
    per = s.groupBy("norm_top_folder").agg(
        F.count("*").alias("candidates"), F.count_if(strong).alias("strong"), F.count_if(plausible).alias("plausible"), F.max("fallback").alias("fallback"),
        F.min_by(F.when(strong, row), F.when(strong, F.col("rank"))).alias("s"), F.max(F.when(plausible, F.col("size_matched"))).alias("p"), F.min_by(row, "rank").alias("best"),
        F.array_sort(F.collect_list(F.when(strong, F.col("folder")))).alias("strong_folders"), F.array_sort(F.collect_list(F.when(plausible, F.col("folder")))).alias("plausible_folders"),
    )
    tested = chosen.groupBy("norm_top_folder").agg(F.count("*").alias("all_anchors"), F.count_if("distinctive").alias("far_anchors"))
    tops = manifest.groupBy("norm_top_folder").agg(F.min("top_folder").alias("lto_top_folder"))
    df = tops.join(per, "norm_top_folder", "left").join(tested, "norm_top_folder", "left")
    c = F.col
    none = c("candidates").isNull()
    status = F.when(none, "NOT_FOUND").when(c("strong") == 1, "MATCHED").when((c("strong") > 1) | (c("plausible") > 1), "AMBIGUOUS").otherwise("NAME_MATCH_UNVERIFIED")
    listed = F.array_join(F.when(c("strong") > 0, c("strong_folders")).otherwise(c("plausible_folders")), "|")
    #: The texts of reasons.
    reason = (
        F.when(none, "NO_NAME_OR_PATH_ANCHOR_CANDIDATE")
        .when(c("strong") == 1, F.concat(F.lit("UNIQUE_STRONG_PATH_AND_SIZE_ANCHORS;matched="), c("s.size_matched"), F.lit(";fallback="), F.when(c("fallback"), "yes").otherwise("no")))
        .when((c("strong") > 1) | (c("plausible") > 1), F.concat(F.lit("MULTIPLE_PLAUSIBLE_CANDIDATES;strong="), c("strong"), F.lit(";plausible="), c("plausible"), F.lit(";candidates="), listed))
        .when(c("plausible") == 1, F.concat(F.lit(f"INSUFFICIENT_KNOWN_SIZE_ANCHORS;required={least};matched="), c("p")))
        .when(~c("fallback"), "NAME_MATCH_WITHOUT_USABLE_ANCHOR_EVIDENCE").otherwise("FALLBACK_PATH_HIT_WITHOUT_USABLE_SIZE_EVIDENCE")
    )
    picked = F.when(c("strong") == 1, c("s")).when(c("candidates") == 1, c("best"))
    counted = F.coalesce(picked, c("best"))
    anchors_tested = F.coalesce(F.when(F.coalesce("fallback", F.lit(True)), c("far_anchors")).otherwise(c("all_anchors")), F.lit(0))
    return df.select(
        "lto_top_folder", c("norm_top_folder").alias("normalized_lto_top_folder"), status.alias("status"), F.coalesce(picked["folder"], F.lit("")).alias("physical_folder"),
        F.coalesce("candidates", F.lit(0)).alias("candidate_count"), anchors_tested.alias("anchors_tested"), *[counted[m].alias(n) for m, n in zip(METRICS, METRIC_NAMES, strict=True)], reason.alias("confidence_reason"),
    )
