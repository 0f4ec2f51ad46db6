from pathtide.operators import walks
from pathtide.plans import base
from pathtide.plans.track_queries import event_sort, scaled_tracks
from pathtide.plans.walk_queries import ref_max_path
from pathtide.session import cut, no_broadcast
from tests.test_peak_queries import NODES, peaks, rows, tables


def small(spark, folder):
    """Two nodes of a path; 2 is 1 walked backwards, 3 covers the first node's last ten again."""
    own = [(1, 1, 20, 15, [1, 2], 1.0), (2, 1, 25, 40, [-2, -1], 1.0), (3, 2, 0, 10, [-1], 1.0)]
    return tables(spark, folder, graph_peaks=peaks(own), nodes=([("chr1", 1, 60, 0, 0), ("chr1", 2, 40, 60, 60)], NODES))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_nodes_are_not_broadcast(spark, tmp_path):
    # the files are far below Spark's own limit in both cases
    d = small(spark, tmp_path)
    few, many = (base.steps(spark, d, no_broadcast(base.nodes(spark, d), n)) for n in (2, 100_001))
    assert "BroadcastHashJoin" in plan(few) and "BroadcastHashJoin" not in plan(many)
    assert rows(few.select("read_id", "a", "b")) == rows(many.select("read_id", "a", "b"))


def test_event_sort_works_out_reads_once(spark, tmp_path):
    got = event_sort(spark, small(spark, tmp_path))
    assert "graph_peaks" not in plan(got)
    assert rows(got) == [("chr1", 0, 2, 1), ("chr1", 20, 1, 2), ("chr1", 50, 1, 3), ("chr1", 60, 0, 4), ("chr1", 60, 1, 5), ("chr1", 60, 2, 6), ("chr1", 100, 0, 7)]


def test_scaled_tracks_work_out_reads_once(spark, tmp_path):
    # one forward and two reverse reads: the reverse track is halved
    got = scaled_tracks(spark, small(spark, tmp_path))
    assert "graph_peaks" not in plan(got)
    assert rows(got) == [("forward", "chr1", 20, 75, 1.0), ("reverse", "chr1", 20, 50, 0.5), ("reverse", "chr1", 50, 60, 1.0), ("reverse", "chr1", 60, 75, 0.5)]


def test_max_path(spark, tmp_path, monkeypatch):
    # 3 is a SNP beside 2 with half of its reads, which an insertion would need and a SNP must exceed; six of nine reads jump from 11 to 13
    walked = [[1, 2, 4]] * 6 + [[1, 3, 4]] * 3 + [[11, 13]] * 6 + [[11, 12, 13]] * 3
    own = [(k, 1, 0, 10, nodes, 1.0) for k, nodes in enumerate(walked)]
    n = [("chr1", 1, 10, 0, 0), ("chr1", 2, 10, 10, 10), ("chr1", 3, 10, 20, None), ("chr1", 4, 10, 30, 20), ("chr2", 11, 10, 0, 0), ("chr2", 12, 10, 10, 10), ("chr2", 13, 10, 20, 20)]
    e = [("chr1", 1, 2), ("chr1", 1, 3), ("chr1", 2, 4), ("chr1", 3, 4), ("chr2", 11, 12), ("chr2", 12, 13), ("chr2", 11, 13)]
    d = tables(spark, tmp_path, graph_peaks=peaks(own), nodes=(n, NODES), edges=(e, "chrom string, src long, dst long"))
    written = []
    monkeypatch.setattr(walks, "cut", lambda df: (written.append(plan(df)), cut(df))[1])
    assert rows(ref_max_path(spark, d)) == [(1, [1, 2, 4]), (11, [11, 13])]
    assert written and not any("graph_peaks" in p for p in written)
