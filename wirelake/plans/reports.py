"""Report queries over the scene tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scenes import CLUSTER_FEATURES


def overview(scenes: DataFrame, default_label: str = "idle") -> DataFrame:
    labelled = F.when(F.col("primary_action_label") != default_label, 1).otherwise(0)
    return scenes.agg(
        F.count(F.lit(1)).alias("n_scenes"),
        F.countDistinct("_source_file").alias("n_files"),
        F.countDistinct("cluster_id").alias("n_clusters"),
        F.round(F.avg("duration_s"), 2).alias("mean_duration_s"),
        F.round(100.0 * F.avg(labelled), 1).alias("labeled_pct"),
        F.round(F.avg("anomaly_score"), 1).alias("mean_anomaly"),
        F.round(F.percentile_approx("anomaly_score", 0.95), 1).alias("p95_anomaly"),
        F.round(F.max("anomaly_score"), 1).alias("max_anomaly"),
        F.round(F.avg("n_features_present"), 1).alias("mean_features_present"),
    )


def segmentation_by_file(boundaries: DataFrame) -> DataFrame:
    return boundaries.groupBy("_source_file").agg(
        F.count(F.lit(1)).alias("n_scenes"),
        F.round(F.min("duration_s"), 3).alias("min_duration_s"),
        F.round(F.avg("duration_s"), 2).alias("mean_duration_s"),
        F.round(F.max("duration_s"), 2).alias("max_duration_s"),
        F.round(F.min("seg_start_s"), 2).alias("t_start_s"),
        F.round(F.max("seg_end_s"), 2).alias("t_end_s"),
        F.round(100.0 * F.avg(F.col("from_changepoint").cast("int")), 1).alias("changepoint_pct"),
    ).orderBy("_source_file")


def tiling(boundaries: DataFrame) -> DataFrame:
    """Gaps and overlaps between neighbouring scenes; both 0 for a tiling."""
    following = F.lead("seg_start_s").over(Window.partitionBy("_source_file").orderBy("seg_start_s"))
    pairs = boundaries.withColumn("next_s", following).where("next_s is not null")
    return pairs.agg(F.sum((F.col("next_s") > F.col("seg_end_s") + 1e-9).cast("int")).alias("gaps"), F.sum((F.col("next_s") < F.col("seg_end_s") - 1e-9).cast("int")).alias("overlaps"))


def label_counts(scenes: DataFrame) -> DataFrame:
    return scenes.select(F.explode("action_labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n_scenes")).orderBy(F.col("n_scenes").desc(), "label")


def primary_label_counts(scenes: DataFrame) -> DataFrame:
    return scenes.groupBy("primary_action_label").agg(F.count(F.lit(1)).alias("n_scenes"), F.round(F.avg("anomaly_score"), 1).alias("mean_anomaly"), F.round(F.avg("duration_s"), 2).alias("mean_duration_s")).orderBy(F.col("n_scenes").desc(), "primary_action_label")


def top_scenes(scenes: DataFrame, n: int = 20) -> DataFrame:
    shown = F.transform("top_features", lambda f: F.concat(f["feature"], F.lit("="), F.round(f["z"], 1).cast("string"), F.lit("z")))
    columns = ["_source_file", "scene_id", "segment_index", *(F.round(c, 2).alias(c) for c in ("seg_start_s", "seg_end_s", "duration_s")), "primary_action_label", "cluster_id"]
    top = scenes.orderBy(F.col("anomaly_score").desc(), "scene_id").limit(n)
    return top.select(*columns, F.round("anomaly_score", 1).alias("anomaly_score"), "n_features_present", F.round("z_max", 2).alias("z_max"), shown.alias("top_features"), "scene_summary")


def recurring_features(scenes: DataFrame, n: int = 20) -> DataFrame:
    """The features that drive the n most anomalous scenes."""
    top = scenes.orderBy(F.col("anomaly_score").desc(), "scene_id").limit(n).select(F.explode("top_features").alias("f"))
    counted = top.groupBy(F.col("f.feature").alias("feature")).agg(F.count(F.lit(1)).alias("n_scenes"), F.round(F.avg(F.abs("f.z")), 2).alias("mean_abs_z"))
    return counted.orderBy(F.col("n_scenes").desc(), F.col("mean_abs_z").desc(), "feature")


def timeline(scenes: DataFrame) -> DataFrame:
    file = F.regexp_extract("_source_file", r"([^/]*)$", 1).alias("file")
    return scenes.select("_source_file", file, "scene_id", "seg_start_s", "duration_s", "anomaly_score", "primary_action_label", "cluster_id").orderBy("_source_file", "seg_start_s")


def scored_vectors(vectors: DataFrame, scenes: DataFrame) -> DataFrame:
    """Vectors with what a scatter plot shows of their scenes."""
    return vectors.select("scene_id", "feature_vector").join(scenes.select("scene_id", "anomaly_score", "cluster_id", "primary_action_label"), "scene_id")


def drill_down(z: DataFrame, scene: str, n: int = 15) -> DataFrame:
    rows = z.where(F.col("scene_id") == scene).orderBy(F.col("abs_z").desc(), "feature_key").limit(n)
    return rows.select("feature_key", F.round("feature_value", 4).alias("feature_value"), F.round("median_value", 4).alias("corpus_median"), F.round("z", 2).alias("z"))


def driving_signals(z: DataFrame, scene: str, n: int = 4) -> DataFrame:
    """The signals behind a scene's largest z-scores. Names may hold dots; only
    the feature's suffix is cut off."""
    parts = F.split("feature_key", r"[|]")
    name = F.regexp_replace(parts[2], rf"\.({'|'.join(CLUSTER_FEATURES)})$", "")
    rows = z.where(F.col("scene_id") == scene).groupBy(parts[0].alias("signal_source"), name.alias("signal_name")).agg(F.max("abs_z").alias("rank_z"))
    return rows.orderBy(F.col("rank_z").desc(), "signal_source", "signal_name").limit(n)


def scene_samples(gold: DataFrame, scene: dict, signals: list[tuple[str, str]], pad_s: float = 5.0) -> DataFrame:
    """Raw samples of signals around a scene."""
    wanted = F.lit(False)
    for source, name in signals:
        wanted = wanted | ((F.col("signal_source") == source) & (F.col("signal_name") == name))
    near = (F.col("_source_file") == scene["_source_file"]) & F.col("timestamp_s").between(scene["seg_start_s"] - pad_s, scene["seg_end_s"] + pad_s)
    return gold.where(near & wanted).select("signal_source", "signal_name", "timestamp_s", "signal_value").orderBy("signal_source", "signal_name", "timestamp_s")


def scene_signals(features: DataFrame, scene: str) -> DataFrame:
    rounded = [F.round(c, 3).alias(c) for c in ("mean_v", "min_v", "max_v", "first_v", "last_v", "delta_v", "range_v")]
    rows = features.where(F.col("scene_id") == scene)
    return rows.select("signal_source", "channel", "signal_name", "n_samples", *rounded, F.round("slope_per_s", 4).alias("slope_per_s"), "n_transitions", F.round("duty_cycle", 3).alias("duty_cycle")).orderBy("signal_source", "signal_name", "channel")
