import itertools
import random

from pyspark.sql import functions as F

from pathtide.operators.sequences import best_hits, interval_sequences, linear_sequences, matrix_hits
from pathtide.operators.variants import haplotype_sequences, observed_haplotypes, prune_alleles


def test_interval_and_linear_sequences(spark):
    seqs = spark.createDataFrame([(1, "ACGTA", 0), (2, "GG", None), (3, "TTC", 5)], "node_id long, sequence string, path_offset long")
    steps = spark.createDataFrame(
        [(1, 0, 1, 1, 2, 5), (1, 1, 2, 2, 0, 2), (2, 0, -3, 3, 0, 2), (2, 1, -1, 1, 1, 5), (3, 0, 9, 9, 0, 1)],
        "read_id long, i int, node long, node_id long, lo int, hi int",
    )
    assert {r.read_id: r.sequence for r in interval_sequences(steps, seqs).collect()} == {1: "GTAGG", 2: "AATACG"}
    peaks = spark.createDataFrame([(1, "c", 3, 7), (2, "c", 0, 99), (3, "d", 0, 5), (4, "c", 4, 4)], "lp long, chrom string, a long, b long")
    path = seqs.filter("path_offset is not null").withColumn("chrom", F.lit("c"))
    assert {r.lp: r.sequence for r in linear_sequences(peaks, path, "lp").collect()} == {1: "TATT", 2: "ACGTATTC"}


def test_matrix_hits_against_every_window(spark):
    r = random.Random(4)
    weights = [[r.uniform(-2, 2) for _ in range(4)] for _ in range(5)]
    rows = [(i, "".join(r.choice("ACGTacgtN") for _ in range(r.randrange(0, 60)))) for i in range(40)] + [(100, None), (101, "")]
    turn = str.maketrans("ACGT", "TGCA")
    want = set()
    for i, s in rows:
        for k in range(len(s or "") - 4):
            for strand, w in (("+", s[k:k + 5].upper()), ("-", s[k:k + 5].upper().translate(turn)[::-1])):
                if "N" not in w and sum(x["ACGT".index(c)] for x, c in zip(weights, w)) >= 2:
                    want.add((i, k + 1, k + 5, strand))
    hits = matrix_hits(spark.createDataFrame(rows, "p long, sequence string"), "p", weights, 2.0).cache()
    assert {(h.p, h.start, h.stop, h.strand) for h in hits.collect()} == want and want
    best = {b.p: b.score for b in best_hits(hits, "p").collect()}
    assert best == {i: max(h.score for h in g) for i, g in itertools.groupby(sorted(hits.collect(), key=lambda h: h.p), key=lambda h: h.p)}


def test_pruned_alleles(spark):
    rows = [(5, "ACG", ["ACT", "A"]), (5, "ACG", ["ACT", "ACGG"]), (7, "A", ["T"]), (9, "AT", ["AT"]), (3, "G", [])]
    got = prune_alleles(spark.createDataFrame(rows, "pos long, ref string, alt array<string>")).collect()
    assert [tuple(r) for r in got] == [(6, "CG", ["CT", ""]), (7, "G", ["T", "GG"]), (7, "A", ["T"]), (11, "", [""]), (4, "", [])]


def test_haplotypes_that_occur(spark):
    variants = spark.createDataFrame([("c", 2, "A", ["T"]), ("c", 4, "CG", ["C", "CGG"]), ("c", 9, "A", ["C"])], "chromosome string, pos long, ref string, alt array<string>")
    genotypes = spark.createDataFrame(
        [("c", 2, 0, [0, 1]), ("c", 4, 0, [2, 1]), ("c", 9, 0, [1, 1]), ("c", 2, 1, [1, 0]), ("c", 4, 1, [1, -1]), ("c", 9, 1, [0, 0])],
        "chromosome string, pos long, sample_no int, alleles array<int>",
    )
    intervals = spark.createDataFrame([(1, "c", 1, 8, "GATCGTT"), (2, "c", 20, 30, "A" * 10)], "id long, chromosome string, a long, b long, sequence string")
    found = observed_haplotypes(intervals, variants, genotypes)
    got = {(r.id, tuple(r.alleles), r.n_haplotypes, r.n_samples, r.sequence) for r in haplotype_sequences(intervals, variants, found).collect()}
    # sample 1's second phase has an unknown allele
    assert got == {(1, (0, 2), 1, 1, "GATCGGTT"), (1, (1, 1), 2, 2, "GTTCTT")}
