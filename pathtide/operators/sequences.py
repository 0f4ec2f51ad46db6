"""Letters along paths: sequences of intervals, and hits of a weight matrix in them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathtide.operators.joins import overlap_join

LETTERS = "ACGT"


def interval_sequences(steps: DataFrame, sequences: DataFrame) -> DataFrame:
    """The letters along each path: read_id, sequence.

    steps: read_id, i, node (signed), node_id and the forward range lo, hi within the node;
    sequences: node_id, sequence. Reverse steps are complemented backwards. A path with a node
    that has no sequence gets none.
    """
    own = steps.join(sequences.select("node_id", "sequence"), "node_id", "left")
    part = F.substr("sequence", (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    turned = F.when(F.col("node") < 0, F.reverse(F.translate(part, "ACGTacgt", "TGCAtgca"))).otherwise(part)
    got = own.groupBy("read_id").agg(F.array_sort(F.collect_list(F.struct("i", turned.alias("t")))).alias("p"), F.bool_or(F.col("sequence").isNull()).alias("gap"))
    return got.filter(~F.col("gap")).select("read_id", F.array_join(F.transform("p", lambda x: x.t), "").alias("sequence"))


def linear_sequences(intervals: DataFrame, path: DataFrame, item: str) -> DataFrame:
    """The letters of linear intervals (``item``, chrom, a, b) along the linear path (chrom, path_offset, sequence): ``item``, sequence.

    What lies beyond the path has no letters.
    """
    own = path.select("chrom", "path_offset", (F.col("path_offset") + F.length("sequence")).alias("path_end"), "sequence")
    both = overlap_join(intervals.select(item, "chrom", "a", "b"), own, ["chrom"], ("a", "b"), ("path_offset", "path_end"))
    lo, hi = F.greatest("a", "path_offset"), F.least("b", "path_end")
    part = F.substr("sequence", (lo - F.col("path_offset") + 1).cast("int"), (hi - lo).cast("int"))
    got = both.groupBy(item).agg(F.array_sort(F.collect_list(F.struct(lo.alias("at"), part.alias("t")))).alias("p"))
    return got.select(item, F.array_join(F.transform("p", lambda x: x.t), "").alias("sequence"))


def _scanner(weights: np.ndarray, least: float):
    """A pandas function: (id, sequence) to every hit of the matrix on either strand."""
    width = weights.shape[0]
    codes = np.full(256, 4, dtype=np.int64)
    for k, c in enumerate(LETTERS):
        codes[ord(c)] = codes[ord(c.lower())] = k
    # Another letter than these four never is a hit.
    forward = np.hstack([weights, np.full((width, 1), -np.inf)])
    backward = np.hstack([weights[::-1, ::-1], np.full((width, 1), -np.inf)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for key, text in zip(pdf["id"], pdf["sequence"], strict=True):
                own = codes[np.frombuffer(text.encode("latin-1", "replace"), dtype=np.uint8)] if text else np.zeros(0, np.int64)
                n = len(own) - width + 1
                if n <= 0:
                    continue
                for strand, matrix in (("+", forward), ("-", backward)):
                    score = np.zeros(n)
                    for j in range(width):
                        score += matrix[j][own[j:j + n]]
                    rows += [(key, int(i) + 1, int(i) + width, strand, float(score[i])) for i in np.nonzero(score >= least)[0]]
            yield pd.DataFrame(rows, columns=["id", "start", "stop", "strand", "score"])

    return run


def matrix_hits(sequences: DataFrame, item: str, weights: list[list[float]], least: float) -> DataFrame:
    """Every place where the matrix's weights add up to ``least``: ``item``, start and stop (from 1, both within), strand, score.

    weights: a row a position, the weights of A, C, G and T. On strand - the reverse complement is
    met; places are counted forward all the same. Null sequences have no hits.
    """
    kind = sequences.schema[item].dataType.simpleString()
    own = sequences.filter(F.col("sequence").isNotNull()).select(F.col(item).alias("id"), "sequence")
    got = own.mapInPandas(_scanner(np.array(weights, dtype=float), least), f"id {kind}, start int, stop int, strand string, score double")
    return got.withColumnRenamed("id", item)


def best_hits(hits: DataFrame, item: str) -> DataFrame:
    """Each item's hit of the highest score; on ties the first one, strand + before -."""
    best = hits.groupBy(item).agg(F.max_by(F.struct("start", "stop", "strand", "score"), F.struct("score", (-F.col("start")).alias("a"), (F.col("strand") == "+").alias("f"))).alias("h"))
    return best.select(item, "h.*")
