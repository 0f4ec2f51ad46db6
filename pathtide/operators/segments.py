"""Segments of runs on nodes, small holes between them, and the best path through each region.

Runs lie on the flat axis; a segment is a run's part on one node. Its class tells which borders of
the node it touches: ``full``, ``start``, ``end`` or ``internal``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathtide.operators.graph import components
from pathtide.operators.joins import overlap_join
from pathtide.operators.scan import scan, sharded
from pathtide.operators.tracks import coalesce_runs
from pathtide.session import cut, free

def segments(runs: DataFrame, nodes: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """chrom, node_id, size, node_index, a, b (flat), kind and the ``carried`` columns of the run, for every run and node that overlap."""
    own = nodes.select("chrom", "node_id", "size", "node_index", (F.col("node_index") + F.col("size")).alias("node_end"))
    got = overlap_join(runs.select("chrom", "start_pos", "end_pos", *carried), own, ["chrom"], ("start_pos", "end_pos"), ("node_index", "node_end"))
    got = got.withColumn("a", F.greatest("start_pos", "node_index")).withColumn("b", F.least("end_pos", "node_end"))
    at_start, at_end = F.col("a") == F.col("node_index"), F.col("b") == F.col("node_end")
    kind = F.when(at_start & at_end, "full").when(at_start, "start").when(at_end, "end").otherwise("internal")
    return got.select("chrom", "node_id", "size", "node_index", "a", "b", kind.alias("kind"), *carried)


def segment_scores(segs: DataFrame, track: DataFrame) -> DataFrame:
    """``segs`` with score, the integral of the track over each segment."""
    keys = ["chrom", "node_id", "a", "b"]
    over = overlap_join(segs.select(*keys), track.select("chrom", "start_pos", "end_pos", "value"), ["chrom"], ("a", "b"), ("start_pos", "end_pos"))
    part = F.col("value") * (F.least("b", "end_pos") - F.greatest("a", "start_pos"))
    sums = over.groupBy(*keys).agg(F.sum(part).alias("score"))
    return segs.join(sums, keys, "left").withColumn("score", F.coalesce("score", F.lit(0)))


def holes_between(runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The runs between neighbouring runs of a chromosome, up to the last run, and before the first one: chrom, start_pos, end_pos."""
    own = sharded(runs.select("chrom", "start_pos", "end_pos"), ["chrom"], "start_pos")
    own = scan(own, ["chrom"], "start_pos", before={"before": "end_pos"})
    return own.select("chrom", F.coalesce("before", F.lit(0)).alias("a"), F.col("start_pos").alias("b")).filter("a < b").select("chrom", F.col("a").alias("start_pos"), F.col("b").alias("end_pos"))


def internal_fill(runs: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """``runs`` with every hole inside one node filled that is no longer than ``longest``."""
    small = segments(holes_between(runs, nodes), nodes).filter((F.col("kind") == "internal") & (F.col("b") - F.col("a") <= longest))
    both = runs.select("chrom", "start_pos", "end_pos").unionByName(small.select("chrom", F.col("a").alias("start_pos"), F.col("b").alias("end_pos")))
    return coalesce_runs(both.withColumn("value", F.lit(True)), ["chrom"]).drop("value")


def _links(segs: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between segments (ids u, v) along graph edges: from one that touches its node's end to one that touches its node's start."""
    out = segs.filter(F.col("kind").isin("full", "end")).select(F.col("id").alias("u"), F.col("node_id").alias("src"))
    into = segs.filter(F.col("kind").isin("full", "start")).select(F.col("id").alias("v"), F.col("node_id").alias("dst"))
    return edges.select("src", "dst").join(out, "src").join(into, "dst").select("u", "v")


def _hole_needs(longest: int):
    """A function that tells for each hole of a component whether the shortest way through it, from an entry to an exit, is too long to fill."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for members in pdf["members"]:
                if not any(m["entry"] for m in members):
                    continue
                by = {m["id"]: m for m in members}
                ids = sorted(by)  # ids rise along the graph
                to = {i: 0 if by[i]["entry"] else math.inf for i in ids}
                for i in ids:
                    for j in by[i]["succ"]:
                        if j in to:
                            to[j] = min(to[j], to[i] + by[i]["len"])
                rest: dict[int, float] = {}
                for i in reversed(ids):
                    rest[i] = by[i]["len"] + min([0 if by[i]["exit"] else math.inf, *(rest[j] for j in by[i]["succ"] if j in rest)])
                out += [i for i in ids if to[i] + rest[i] <= longest]
            yield pd.DataFrame({"id": pd.Series(out, dtype="int64")})

    return run


def fill_holes(runs: DataFrame, nodes: DataFrame, edges: DataFrame, touched: DataFrame, longest: int, most: int | None = None) -> DataFrame:
    """``runs`` with small holes filled, also those that go over node borders.

    A hole inside a node is filled if it is no longer than ``longest``. A hole at a border is filled
    if some way through it, from the end of a run to the start of one, is that short. Not filled are
    holes at the graph's own ends, whole nodes that are not in ``touched`` (chrom, node_id), what
    follows the last run, and components without an entry - or, with ``most``, of more segments.
    """
    # Runs and what is between them meet the nodes in one join.
    both = runs.select("chrom", "start_pos", "end_pos", F.lit(False).alias("hole")).unionByName(holes_between(runs, nodes).withColumn("hole", F.lit(True)))
    parts_of = cut(segments(both, nodes, ("hole",)).select("chrom", "node_id", "a", "b", "kind", "hole"))
    holes, active = parts_of.filter("hole").drop("hole"), parts_of.filter("not hole").drop("hole")
    inner = holes.filter((F.col("kind") == "internal") & (F.col("b") - F.col("a") <= longest))
    seen = touched.select("node_id").distinct()
    # A node has at most one segment at its start and one at its end: ids that rise along the graph.
    border = holes.filter("kind <> 'internal'").withColumn("id", F.col("node_id") * 2 + (F.col("kind") == "end").cast("int"))
    border = border.join(seen.withColumn("seen", F.lit(True)), "node_id", "left")
    has_out, has_in = edges.select(F.col("src").alias("node_id")).distinct().withColumn("out", F.lit(True)), edges.select(F.col("dst").alias("node_id")).distinct().withColumn("into", F.lit(True))
    border = border.join(has_out, "node_id", "left").join(has_in, "node_id", "left")
    stuck = (F.col("kind").isin("end", "full") & F.col("out").isNull()) | (F.col("kind").isin("start", "full") & F.col("into").isNull()) | ((F.col("kind") == "full") & F.col("seen").isNull())
    border = border.filter(~F.coalesce(stuck, F.lit(False))).select("chrom", "id", "node_id", "a", "b", "kind", (F.col("b") - F.col("a")).alias("len"))
    # No short way goes through a long segment: without these the components are small.
    border = cut(border if most is not None else border.filter(F.col("len") <= longest))
    links = cut(_links(border, edges))
    # A way may begin at a run that touches its node's end, and stop at one that touches its node's start.
    ends_active = active.filter(F.col("kind").isin("full", "end")).select(F.col("node_id").alias("src")).join(seen.withColumnRenamed("node_id", "src"), "src").distinct()
    starts_active = active.filter(F.col("kind").isin("full", "start")).select(F.col("node_id").alias("dst")).join(seen.withColumnRenamed("node_id", "dst"), "dst").distinct()
    can_enter = edges.join(ends_active, "src", "left_semi").select(F.col("dst").alias("node_id")).distinct().withColumn("enters", F.lit(True))
    can_leave = edges.join(starts_active, "dst", "left_semi").select(F.col("src").alias("node_id")).distinct().withColumn("leaves", F.lit(True))
    entry = (F.col("kind") == "end") | F.coalesce("enters", F.lit(False))
    leave = (F.col("kind") == "start") | F.coalesce("leaves", F.lit(False))
    ready = border.join(can_enter, "node_id", "left").join(can_leave, "node_id", "left").withColumn("entry", entry).withColumn("exit", leave)
    parts = components(border.select("id"), links.select(F.col("u").alias("a"), F.col("v").alias("b")))
    succ = links.groupBy(F.col("u").alias("id")).agg(F.collect_set("v").alias("succ"))
    ready = ready.join(parts, "id").join(succ, "id", "left").withColumn("succ", F.coalesce("succ", F.array().cast("array<bigint>")))
    if most is not None:
        sizes = ready.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        ready = ready.join(sizes.filter(F.col("n") <= most), "component", "left_semi")
    grouped = ready.groupBy("component").agg(F.collect_list(F.struct("id", "len", "entry", "exit", "succ")).alias("members"))
    grouped = cut(grouped)
    filled = border.join(grouped.mapInPandas(_hole_needs(longest), "id long"), "id", "left_semi")
    add = inner.select("chrom", "a", "b").unionByName(filled.select("chrom", "a", "b"))
    both = runs.select("chrom", "start_pos", "end_pos").unionByName(add.select("chrom", F.col("a").alias("start_pos"), F.col("b").alias("end_pos")))
    out = coalesce_runs(both.withColumn("value", F.lit(True)), ["chrom"]).drop("value")
    free(parts_of, border, links, parts, grouped)
    return out


def _best_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The path of highest score from a source to a sink of each region; ties go to the smaller node."""
    names = [c.split()[0] for c in PEAK.split(", ")]
    for pdf in batches:
        out = []
        for members in pdf["members"]:
            by = {m["id"]: m for m in members}
            ids = sorted(by)
            succ = {i: [j for j in by[i]["succ"] if j in by] for i in ids}
            pred: dict[int, list[int]] = {i: [] for i in ids}
            for i in ids:
                for j in succ[i]:
                    pred[j].append(i)
            best: dict[int, float] = {}
            back: dict[int, int | None] = {}
            ways: dict[int, int] = {}
            for i in ids:
                top = max((best[p] for p in pred[i]), default=None)
                tied = [p for p in sorted(pred[i]) if best[p] == top]
                best[i] = by[i]["score"] + (top or 0)
                back[i] = tied[0] if tied else None
                ways[i] = sum(ways[p] for p in tied) if tied else 1
            sinks = [i for i in ids if not succ[i]]
            top = max(best[i] for i in sinks)
            ends = [i for i in sinks if best[i] == top]
            path, at = [], ends[0]
            while at is not None:
                path.append(at)
                at = back[at]
            path.reverse()
            first, last = by[path[0]], by[path[-1]]
            total = float(sum(m["score"] for m in members))
            out.append((first["chrom"], first["a"] - first["node_index"], last["b"] - last["node_index"], [by[i]["node_id"] for i in path], float(top), total, total != top, sum(ways[i] for i in ends) > 1))
        yield pd.DataFrame(out, columns=names)


PEAK = "chrom string, start_off int, end_off int, region_paths array<long>, path_score double, total_score double, is_diff boolean, is_ambiguous boolean"


def max_paths(runs: DataFrame, nodes: DataFrame, edges: DataFrame, track: DataFrame) -> DataFrame:
    """One peak per connected region: the path on which the track has the highest integral.

    A region is a run inside one node, or segments joined along edges. Result: chrom, start_off,
    end_off, region_paths, path_score, total_score, is_diff (the region holds more than the path),
    is_ambiguous (another path is as good).
    """
    scored = cut(segment_scores(segments(runs, nodes), track).withColumn("id", F.col("node_id") * 2 + (F.col("kind") == "end").cast("int")))
    alone = scored.filter("kind = 'internal'")
    single = alone.select(
        "chrom", (F.col("a") - F.col("node_index")).cast("int").alias("start_off"), (F.col("b") - F.col("node_index")).cast("int").alias("end_off"), F.array("node_id").alias("region_paths"),
        F.col("score").cast("double").alias("path_score"), F.col("score").cast("double").alias("total_score"), F.lit(False).alias("is_diff"), F.lit(False).alias("is_ambiguous"),
    )
    joined = cut(scored.filter("kind <> 'internal'"))
    links = cut(_links(joined, edges))
    parts = components(joined.select("id"), links.select(F.col("u").alias("a"), F.col("v").alias("b")))
    succ = links.groupBy(F.col("u").alias("id")).agg(F.collect_set("v").alias("succ"))
    ready = joined.join(parts, "id").join(succ, "id", "left").withColumn("succ", F.coalesce("succ", F.array().cast("array<bigint>")))
    member = F.struct("chrom", "id", "node_id", "node_index", "a", "b", F.col("score").cast("double").alias("score"), "succ")
    out = cut(single.unionByName(ready.groupBy("component").agg(F.collect_list(member).alias("members")).mapInPandas(_best_paths, PEAK)))
    free(scored, joined, links, parts)
    return out


def peak_scores(peaks: DataFrame, nodes: DataFrame, track: DataFrame) -> DataFrame:
    """``peaks`` (id, chrom, start_off, end_off, region_paths signed) with score, the highest track value on the path, and bp, its length."""
    n = F.size("region_paths")
    each = peaks.select("id", "start_off", "end_off", n.alias("n"), F.posexplode("region_paths").alias("i", "node")).withColumn("node_id", F.abs("node")).join(nodes.select("node_id", "chrom", "size", "node_index"), "node_id")
    start = F.when(F.col("i") == 0, F.col("start_off")).otherwise(0)
    end = F.when(F.col("i") == F.col("n") - 1, F.col("end_off")).otherwise(F.col("size"))
    # A reverse step counts from the node's far end.
    a = F.col("node_index") + F.when(F.col("node") > 0, start).otherwise(F.col("size") - end)
    b = F.col("node_index") + F.when(F.col("node") > 0, end).otherwise(F.col("size") - start)
    each = cut(each.select("id", "chrom", a.alias("a"), b.alias("b")))
    size = each.groupBy("id").agg(F.sum(F.col("b") - F.col("a")).alias("bp"))
    over = overlap_join(each, track.select("chrom", "start_pos", "end_pos", "value"), ["chrom"], ("a", "b"), ("start_pos", "end_pos"))
    top = over.groupBy("id").agg(F.max("value").alias("score"))
    return peaks.join(size, "id").join(top, "id", "left").withColumn("score", F.coalesce("score", F.lit(0)))
