"""Operators on directed acyclic graphs whose node ids rise along every edge."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathtide.operators.scan import scan, sharded
from pathtide.session import cut, free


def blocks(nodes: DataFrame, edges: DataFrame, width: int = 4096) -> DataFrame:
    """``nodes`` (chrom, node_id, size) with the number of their block: chrom, node_id, size, block.

    A node that no edge passes over is a cut: every path through its chromosome's part goes through
    it. A block is a cut and all nodes up to the next one, so longest paths, and whatever else adds
    up along paths, can be worked out block by block.
    """
    over = F.array(F.struct((F.col("src") + 1).alias("at"), F.lit(1).alias("d")), F.struct(F.col("dst").alias("at"), F.lit(-1).alias("d")))
    events = edges.filter(F.col("dst") > F.col("src") + 1).select("chrom", F.inline(over)).groupBy("chrom", "at").agg(F.sum("d").alias("d"))
    # Nodes and events share the axis; an edge from src to dst passes over the ids between them.
    own = nodes.select("chrom", F.col("node_id").alias("at"), F.lit(0).alias("d"), F.col("size")).unionByName(events.withColumn("size", F.lit(None).cast("int")))
    own = own.groupBy("chrom", "at").agg(F.sum("d").alias("d"), F.max("size").alias("size"))
    passed = cut(scan(sharded(own, ["chrom"], "at", width), ["chrom"], "at", sums={"over": "d"}).filter("size is not null").select("chrom", "at", "size", (F.col("over") == 0).cast("int").alias("is_cut")))
    numbered = scan(sharded(passed, ["chrom"], "at", width), ["chrom"], "at", sums={"block": "is_cut"})
    return numbered.select("chrom", F.col("at").alias("node_id"), "size", "block")


def _block_paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Longest distances within each block: ``pre`` from its first node's start to each node's start, ``post`` from there to the next cut."""
    for pdf in batches:
        out = []
        for chrom, block, members in zip(pdf["chrom"], pdf["block"], pdf["members"], strict=True):
            size = {m["node_id"]: m["size"] for m in members}
            succ = {m["node_id"]: [x for x in m["succ"] if x in size] for m in members}
            order = sorted(size)
            pre, post = dict.fromkeys(order, 0), {}
            for n in order:
                for m in succ[n]:
                    pre[m] = max(pre[m], pre[n] + size[n])
            for n in reversed(order):
                post[n] = size[n] + max((post[m] for m in succ[n]), default=0)
            span = max(pre[n] + post[n] for n in order)
            out += [(chrom, n, size[n], block, pre[n], post[n], span) for n in order]
        yield pd.DataFrame(out, columns=["chrom", "node_id", "size", "block", "pre", "post", "span"])


def linear_map(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node's stretch of the longest path's axis: chrom, node_id, size, lin_start, lin_end.

    lin_start is the longest way to the node from its chromosome's start, lin_end what is left of the
    whole length after the shortest rest, that is the length minus the longest way from the node's
    end to the chromosome's end. Worked out block by block and added up along the blocks.
    """
    own = blocks(nodes, edges)
    succ = edges.groupBy(F.col("src").alias("node_id")).agg(F.collect_set("dst").alias("succ"))
    own = own.join(succ, "node_id", "left").withColumn("succ", F.coalesce("succ", F.array().cast("array<bigint>")))
    # A block is as long as a bubble, the longest edge-covered stretch, however long the chromosome.
    whole = cut(own.groupBy("chrom", "block").agg(F.collect_list(F.struct("node_id", "size", "succ")).alias("members")))
    one = F.get("members", F.lit(0))
    size = one.getField("size").cast("long")
    single = whole.filter(F.size("members") == 1).select("chrom", one.getField("node_id").alias("node_id"), one.getField("size").alias("size"), "block", F.lit(0).cast("long").alias("pre"), size.alias("post"), size.alias("span"))
    more = whole.filter(F.size("members") > 1).mapInPandas(_block_paths, "chrom string, node_id long, size int, block long, pre long, post long, span long")
    local = cut(single.unionByName(more))
    spans = local.groupBy("chrom", "block").agg(F.max("span").alias("span"))
    spans = scan(sharded(spans, ["chrom"], "block", 4096), ["chrom"], "block", sums={"upto": "span"}).select("chrom", "block", (F.col("upto") - F.col("span")).alias("base"), "upto")
    got = local.join(spans, ["chrom", "block"])
    end = F.col("upto") - F.col("post") + F.col("size")
    return got.select("chrom", "node_id", "size", (F.col("base") + F.col("pre")).alias("lin_start"), end.alias("lin_end"))


def extend_reads(ends: DataFrame, nodes: DataFrame, edges: DataFrame, extension: int) -> DataFrame:
    """Where an extension by ``extension`` base pairs flows: read_id, node_id, reach.

    ends: read_id, node_id, offset - the read's end within a forward node. The extension goes on to
    every successor; a read that reaches a node on several ways keeps the longest reach and covers
    the node once; dead ends drop. reach is how far into the node the cover goes, from its start (on
    the first node, from the offset).
    """
    got = extend_both_ways(ends.withColumn("way", F.lit(1)), nodes, edges, extension)
    return got.select("read_id", "node_id", "reach")


def extend_both_ways(ends: DataFrame, nodes: DataFrame, edges: DataFrame, extension: int) -> DataFrame:
    """The same for reads of both strands in one walk: read_id, way, node_id, size, reach. ends also have way, 1 along the edges, -1 against them."""
    size = nodes.select("node_id", "size")
    keys = ["read_id", "way", "node_id", "size"]
    start = ends.join(size, "node_id").select("read_id", "way", "node_id", "size", (F.col("offset") + extension).alias("rem"))
    front = cut(start.groupBy(*keys).agg(F.max("rem").alias("rem")))
    far = edges.select(F.col("src").alias("node_id"), F.col("dst").alias("next"), F.lit(1).alias("way")).unionByName(edges.select(F.col("dst").alias("node_id"), F.col("src").alias("next"), F.lit(-1).alias("way")))
    ways = cut(far.join(size.select(F.col("node_id").alias("next"), F.col("size").alias("next_size")), "next"))
    levels = [front]
    while True:
        flow = front.filter(F.col("rem") > F.col("size")).join(ways, ["node_id", "way"])
        front = cut(flow.groupBy("read_id", "way", F.col("next").alias("node_id"), F.col("next_size").alias("size")).agg(F.max(F.col("rem") - F.col("size")).alias("rem")))
        if front.isEmpty():
            break
        levels.append(front)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    out = out.groupBy(*keys).agg(F.max("rem").alias("rem"))
    out = cut(out.select("read_id", "way", "node_id", "size", F.least("rem", "size").cast("int").alias("reach")))
    free(ways, *levels)
    return out


def components(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Weakly connected components: id, component (the least id in it).

    vertices: id; links: a, b. Labels are passed on and shortcut in rounds until nothing changes, so
    the number of rounds grows with the logarithm of a component's length, not with the length.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    both = cut(both)
    # Vertices without a link are components of their own from the start.
    labels = cut(both.select(F.col("a").alias("id"), F.col("a").alias("label")).distinct())
    while True:
        near = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("label", F.coalesce("near", "label")).alias("new"), F.col("label").alias("old"))
        # A label is itself a vertex: hook the old label's vertex too, then jump to the label's label.
        pull = hooked.groupBy(F.col("old").alias("p")).agg(F.min("new").alias("pulled"))
        hooked = cut(hooked.join(pull, F.col("id") == F.col("p"), "left").select("id", "old", F.least("new", F.coalesce("pulled", "new")).alias("new")))
        jump = hooked.select(F.col("id").alias("j"), F.col("new").alias("jumped"))
        after = cut(hooked.join(jump, F.col("new") == F.col("j"), "left").select("id", F.least("new", F.coalesce("jumped", "new")).alias("label"), "old"))
        changed = not after.filter("label <> old").isEmpty()
        free(hooked, labels)
        labels = after
        if not changed:
            break
    found = labels.select("id", F.col("label").alias("component"))
    out = cut(vertices.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component")))
    free(both, labels)
    return out


def path_positions(nodes: DataFrame) -> DataFrame:
    """The linear path in order: chrom, node_id, path_offset, place (from 0), next_node."""
    path = nodes.filter("path_offset is not null").select("chrom", "node_id", "path_offset", F.lit(1).alias("one"))
    got = scan(sharded(path, ["chrom"], "path_offset"), ["chrom"], "path_offset", sums={"place": "one"}, after={"next_node": "node_id"})
    return got.select("chrom", "node_id", "path_offset", (F.col("place") - 1).cast("long").alias("place"), "next_node")


