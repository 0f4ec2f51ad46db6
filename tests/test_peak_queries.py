import random

from pathtide.operators.matching import similar_intervals
from pathtide.plans.peak_queries import MISMATCH, MOTIF, alignment_compare, motif_hits, motif_locations, peak_compare_report, peak_set_matching, similar_peaks
from pathtide.plans.signal_queries import peak_maxima

PEAKS = "peak_id long, sample_id long, start_off int, end_off int, region_paths array<long>, average_q_value double, unique_id string"


NODES = "chrom string, node_id long, node_size int, node_index long, path_offset long"
LINEAR = "lp_id long, run_id long, chromosome string, start_pos long, end_pos long, score double"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def tables(spark, folder, **named):
    """Writes tables (rows, schema) as a data folder."""
    for name, (data, schema) in named.items():
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def peaks(own):
    """graph_peaks of (id, sample, start, end, nodes, q)."""
    return [(*x, f"u{x[0]}") for x in own], PEAKS


def test_similar_peaks_are_all_pairs(spark, tmp_path):
    # 2 and 3 resemble each other, not the path's first interval 1; 4 lies on the same nodes backwards
    own = [(1, 1, 0, 30, [5, 6], 1.0), (2, 1, 40, 80, [5, 6], 1.0), (3, 2, 40 + MISMATCH, 80 - MISMATCH, [5, 6], 1.0), (4, 1, 40, 80, [-6, -5], 1.0), (5, 1, 40, 81 + MISMATCH, [5, 6], 1.0)]
    d = tables(spark, tmp_path, graph_peaks=peaks(own))
    assert rows(similar_peaks(spark, d)) == [(3, 2)]


def test_similar_intervals_in_blocks(spark):
    r = random.Random(7)
    own = [(i, r.randrange(0, 60), r.randrange(60, 120), [r.choice([3, 4]), 9]) for i in range(150)]
    got = rows(similar_intervals(spark.createDataFrame(own, "read_id long, s int, e int, rp array<long>"), 7, block=2))
    key = lambda x: (x[1], x[2], x[0])
    assert got == sorted((y[0], x[0]) for x in own for y in own if x[3] == y[3] and key(x) < key(y) and abs(x[1] - y[1]) <= 7 and abs(x[2] - y[2]) <= 7)


def test_alignment_compare_counts_every_start(spark, tmp_path):
    # one node of the path, so a start's offset is its position: 198 and 201 are near across a border of hundreds,
    # 510 and 512 are not the least of their hundred, 340 has a start within a hundred only, 700 and 950 have none
    g = [(k, 1, a, a + 20, [1], 1.0) for k, a in enumerate([198, 500, 510, 510, 340, 700])]
    li = [(k, 1, "chr1", a, a + 20, 1.0) for k, a in enumerate([201, 480, 512, 420, 950])]
    d = tables(spark, tmp_path, graph_peaks=peaks(g), nodes=([("chr1", 1, 2000, 0, 0)], NODES), linear_peaks=(li, LINEAR))
    got = rows(alignment_compare(spark, d).select("kind", "n", "graph_calls", "linear_calls"))
    assert got == [("apart", 2, 2, 2), ("graph_only", 1, 1, 0), ("linear_only", 1, 0, 1), ("same", 2, 3, 2)]


def test_reverse_peaks_have_a_highest_coverage(spark, tmp_path):
    # 2 is 1 walked backwards; 3 covers the first node's last ten again
    own = [(1, 1, 20, 15, [1, 2], 1.0), (2, 1, 25, 40, [-2, -1], 1.0), (3, 2, 0, 10, [-1], 1.0)]
    d = tables(spark, tmp_path, graph_peaks=peaks(own), nodes=([("chr1", 1, 60, 0, 0), ("chr1", 2, 40, 60, 60)], NODES))
    assert rows(peak_maxima(spark, d)) == [(1, 55, 3), (2, 55, 3), (3, 10, 3)]


def test_reverse_peaks_have_motif_locations(spark, tmp_path):
    r = random.Random(3)
    size = {k: 2 * r.randrange(15, 30) for k in range(1, 9)}
    own = []
    for i in range(60):
        path = sorted(r.sample(range(1, 9), 3))
        s, e = r.randrange(0, 15), r.randrange(16, 30)
        own.append((i, 1, s, e, path if i % 2 else [-x for x in reversed(path)], 1.0))
    d = tables(spark, tmp_path, graph_peaks=peaks(own), nodes=([("chr1", k, n, k * 100, None) for k, n in size.items()], NODES))

    def letters(node):
        text = "".join("ACGT"[(abs(node) * 7 + x * x) % 4] for x in range(size[abs(node)]))
        return text if node > 0 else text[::-1].translate(str.maketrans("ACGT", "TGCA"))

    want = []
    for i, _, s, e, path, _ in own:
        places = [(node, x) for k, node in enumerate(path) for x in range(s if k == 0 else 0, e if k == 2 else size[abs(node)])]
        at = "".join(letters(node)[x] for node, x in places).find(MOTIF)
        if at >= 0:
            node, x = places[at]
            want.append((i, abs(node), x, "+" if node > 0 else "-"))
    assert {x[3] for x in want} == {"+", "-"}
    assert rows(motif_locations(spark, d)) == sorted(want)
    assert motif_hits(spark, d).count() == len(want)


def test_peak_sets_are_whole(spark, tmp_path):
    # run 2 swaps letters of FGI5; AB1 and BA1 have the same letters, so that only exact labels name them;
    # graph peak 3 has no q, 4 is off the path; linear peaks 12 and 13 have no score
    own = [(1, 1, 0, 50, [1], 2.0), (2, 1, 100, 150, [1], 3.0), (3, 1, 200, 250, [1], None), (4, 1, 0, 10, [2], 1.0), (5, 2, 300, 350, [1], float("nan")), (6, 3, 300, 350, [1], 1.0)]
    li = [(10, 1, "chr1", 10, 60, 1.0), (11, 2, "1", 110, 160, 1.0), (12, 2, "1", 210, 260, None), (13, 2, "1", 120, 170, -1.0), (14, 3, "chr1", 310, 360, 1.0)]
    d = tables(
        spark, tmp_path, graph_peaks=peaks(own), nodes=([("chr1", 1, 2000, 0, 0), ("chr1", 2, 50, 2000, None)], NODES), linear_peaks=(li, LINEAR),
        samples=([(1, "FGI5"), (2, "AB1"), (3, "BA1")], "sample_id long, factor string"), linear_runs=([(1, "leaf FGI-5"), (2, "GFI5 rep1"), (3, "ba1 #1")], "run_id long, run_label string"),
    )
    assert rows(peak_set_matching(spark, d)) == [(1, 10), (2, 11), (3, 12), (6, 14)]
    assert rows(peak_compare_report(spark, d)) == [("AB1", 1, 0, 0, 1, 0), ("BA1", 1, 1, 1, 0, 0), ("FGI5", 4, 4, 3, 1, 1)]
