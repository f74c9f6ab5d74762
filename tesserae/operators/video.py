"""Decisions over tracks of a video: early removal, occlusion, suppression of whole tracks, clean-up where labels are open."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.functions import boxes as B
from tesserae.operators.assignment import matched


def early_removals(matches: DataFrame, unmatched: DataFrame, delay: int, misses: int, doubles: int) -> DataFrame:
    """Tracks that go within ``delay`` frames of their first: (video, track, first, removed_at, cause).

    matches (video, frame, det, track), unmatched (video, frame, track). A track goes at its ``misses``-th frame without a match, or at the ``doubles``-th
    detection that it shares with one same track, the one of that detection which began first (ties: the smaller id). The earlier event counts; a miss
    before a double in the same frame. What a removed track does later is the input's: a tracker that dropped it logs nothing of it.
    """
    seen = matches.select("video", "track", "frame").unionByName(unmatched.select("video", "track", "frame"))
    first = seen.groupBy("video", "track").agg(F.min("frame").alias("first"))
    nth = lambda by, order: F.row_number().over(Window.partitionBy("video", *by).orderBy(*order))
    lone = unmatched.withColumn("k", nth(["track"], ["frame"])).where(F.col("k") == misses).select("video", "track", "frame", F.lit("unmatched").alias("cause"))
    dated = matches.join(first, ["video", "track"])
    lead = F.min(F.struct("first", "track")).over(Window.partitionBy("video", "frame", "det"))["track"]
    shared = dated.withColumn("lead", lead).where("lead <> track").withColumn("k", nth(["lead", "track"], ["frame", "det"]))
    double = shared.where(F.col("k") == doubles).select("video", "track", "frame", F.lit("duplicate").alias("cause"))
    events = lone.unionByName(double).join(first, ["video", "track"]).where(F.col("frame") < F.col("first") + delay)
    order = F.struct("frame", F.col("cause") == "duplicate")
    return events.groupBy("video", "track", "first").agg(F.min("frame").alias("removed_at"), F.min_by("cause", order).alias("cause"))


def occluded(pairs: DataFrame, threshold: float, reverse: bool = False) -> DataFrame:
    """Of overlapping pairs (image, i, j, iou, oi, oj; i < j) the objects to hide: the one occluded later, if the other was ever occluded (-1: never).

    ``reverse`` is for frames that run backwards: the one occluded earlier.
    """
    later = (lambda a, b: a < b) if reverse else (lambda a, b: a > b)
    oi, oj = F.col("oi"), F.col("oj")
    near = pairs.where(F.col("iou") >= threshold)
    hidden = F.array(F.when(later(oi, oj) & (oj > -1), F.col("i")), F.when(later(oj, oi) & (oi > -1), F.col("j")))
    return near.select("image", F.explode(hidden).alias("n")).where("n IS NOT NULL").distinct()


def suppressed_tracks(frames: DataFrame, scores: DataFrame, threshold: float) -> DataFrame:
    """Greedy suppression of whole tracks: (video, track) that stay.

    frames (video, track, frame, x, y, w, h) without rows where a track is absent, scores (video, track, score). The overlap of two tracks is the sum of shared area
    over the sum of joint area, in frames that both have; one that equals the threshold suppresses. A video's tracks, not its frames, are gathered for the fold.
    """
    side = lambda p: frames.select("video", "frame", *(F.col(c).alias(f"{p}{c}") for c in ("track", "x", "y", "w", "h")))
    p = side("a").join(side("b"), ["video", "frame"]).where("atrack <> btrack")
    joint = p.groupBy("video", "atrack", "btrack").agg(F.sum(B.overlap("a", "b")).alias("i"), F.sum(B.union("a", "b")).alias("u"))
    near = joint.where(B.ratio(F.col("i"), F.col("u")) >= threshold).groupBy("video", F.col("atrack").alias("track")).agg(F.collect_list("btrack").alias("near"))
    present = scores.join(frames.select("video", "track").distinct(), ["video", "track"], "left_semi")
    item = F.struct((-F.col("score")).alias("s"), "track", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))
    tracks = present.join(near, ["video", "track"], "left").groupBy("video").agg(F.sort_array(F.collect_list(item)).alias("t"))
    kept = F.aggregate("t", F.array().cast("array<bigint>"), lambda k, e: F.when(F.arrays_overlap(k, e["near"]), k).otherwise(F.concat(k, F.array(e["track"]))))
    return tracks.select("video", F.explode(kept).alias("track"))


def without_unlabelled(dets: DataFrame, truth: DataFrame, pairs: DataFrame, negative: DataFrame, partial: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Detections that may be judged: an unmatched one goes where its class has no ground truth in the image and is not declared absent, or is not labelled throughout.

    dets and truth (image, category, n), pairs (image, category, g, d, iou), negative and partial (image, category). Matches are optimal above the threshold.
    """
    near = pairs.where(F.col("iou") >= threshold).withColumn("group", F.to_json(F.struct("image", "category")))
    hits = matched(near.select("group", "g", "d", "iou"), "group", "g", "d", "iou").join(near.drop("iou"), ["group", "g", "d"]).select("image", "category", F.col("d").alias("n"))
    key = ["image", "category"]
    lone = dets.join(hits, [*key, "n"], "left_anti")
    unknown = lone.join(truth, key, "left_anti").join(negative, key, "left_anti")
    open_ = lone.join(partial, key, "left_semi")
    return dets.join(unknown.unionByName(open_).distinct(), [*key, "n"], "left_anti")
