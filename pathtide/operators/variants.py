"""Variants on intervals: pruned alleles, the haplotypes that occur, and their sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathtide.operators.joins import overlap_join


def common_prefix(ref: Column, alts: Column) -> Column:
    """Length of the prefix that ``ref`` and all of ``alts`` (an array) share."""
    most = F.array_min(F.transform(F.array_insert(alts, 1, ref), lambda a: F.length(a)))
    same = F.filter(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), lambda n: F.exists(alts, lambda a: F.substr(a, F.lit(1), n) != F.substr(ref, F.lit(1), n)))
    return F.coalesce(F.array_min(same) - 1, most)


def prune_alleles(variants: DataFrame) -> DataFrame:
    """``variants`` (pos, ref, alt array) without the letters that all alleles begin with; pos moves on by as many."""
    own = variants.withColumn("_shared", common_prefix(F.col("ref"), F.col("alt")))
    cut_off = lambda a: F.substr(a, F.col("_shared") + 1)
    return own.withColumns({"pos": F.col("pos") + F.col("_shared"), "ref": cut_off(F.col("ref")), "alt": F.transform("alt", cut_off)}).drop("_shared")


def observed_haplotypes(intervals: DataFrame, variants: DataFrame, genotypes: DataFrame) -> DataFrame:
    """The combinations of alleles that occur on each interval: id, alleles (by position, 0 the reference), n_haplotypes, n_samples.

    intervals: id, chromosome, a, b; variants: chromosome, pos, ref, alt; genotypes: chromosome, pos,
    sample_no, alleles (one number a phase, -1 unknown). Combinations are not enumerated but read
    from the genotypes, a sample's phase at a time; a phase with an unknown allele is left out, as
    are variants that aren't wholly within the interval.
    """
    own = variants.select("chromosome", "pos", (F.col("pos") + F.greatest(F.length("ref"), F.lit(1))).alias("pos_end"))
    on = overlap_join(intervals.select("id", "chromosome", "a", "b"), own, ["chromosome"], ("a", "b"), ("pos", "pos_end")).filter("pos >= a and pos_end <= b")
    each = on.join(genotypes.select("chromosome", "pos", "sample_no", F.posexplode("alleles").alias("phase", "allele")), ["chromosome", "pos"])
    phased = each.groupBy("id", "sample_no", "phase").agg(F.array_sort(F.collect_list(F.struct("pos", "allele"))).alias("p"), F.min("allele").alias("least"))
    phased = phased.filter("least >= 0").withColumn("alleles", F.transform("p", lambda x: x.allele))
    return phased.groupBy("id", "alleles").agg(F.count(F.lit(1)).alias("n_haplotypes"), F.countDistinct("sample_no").alias("n_samples"))


def haplotype_sequences(intervals: DataFrame, variants: DataFrame, haplotypes: DataFrame) -> DataFrame:
    """``haplotypes`` of :func:`observed_haplotypes` with their sequence: the interval's letters with the alleles put in.

    intervals also have sequence, the reference from a to b. Alleles are put in from left to right;
    one that begins within the one before is left out.
    """
    own = variants.select("chromosome", "pos", (F.col("pos") + F.greatest(F.length("ref"), F.lit(1))).alias("pos_end"), "ref", "alt")
    on = overlap_join(intervals.select("id", "chromosome", "a", "b"), own, ["chromosome"], ("a", "b"), ("pos", "pos_end")).filter("pos >= a and pos_end <= b")
    listed = on.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "ref", "alt"))).alias("v"))
    got = haplotypes.join(listed, "id").join(intervals.select("id", "a", "sequence"), "id")
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("upto"))
    picked = F.transform(F.arrays_zip("v", "alleles"), lambda z: F.struct((z.v.pos - F.col("a")).alias("at"), z.v.ref.alias("ref"), F.when(z.alleles == 0, z.v.ref).otherwise(F.get(z.v.alt, z.alleles - 1)).alias("put")))

    def step(acc: Column, x: Column) -> Column:
        before = F.substr("sequence", (acc.upto + 1).cast("int"), (x.at - acc.upto).cast("int"))
        put = F.struct(F.concat(acc.done, before, F.coalesce(x.put, x.ref)).alias("done"), (x.at + F.length(x.ref)).cast("bigint").alias("upto"))
        return F.when(x.at >= acc.upto, put).otherwise(acc)

    applied = got.withColumn("s", F.aggregate(picked, start, step))
    rest = F.substr("sequence", (F.col("s.upto") + 1).cast("int"))
    return applied.select("id", "alleles", "n_haplotypes", "n_samples", F.concat("s.done", rest).alias("sequence"))
