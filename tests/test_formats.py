import json

import pytest
from pyspark.sql import functions as F

from pathtide.sources import formats as S


def put(tmp_path, name, text):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


def test_peaks_round_trip(spark, tmp_path):
    line = {"start": 6, "end": 2, "region_paths": [31, -34], "direction": -1, "average_q_value": 0.25, "unique_id": "odd", "is_ambigous": 0, "is_diff": 1, "chromosome": "chr1"}
    got = S.read_peaks(spark, put(tmp_path, "p.json", json.dumps(line) + "\nbroken\n" + '{"start": 1, "end": 2, "region_paths": [3]}\n'))
    assert sorted((r.start, r.region_paths, r.direction) for r in got.collect()) == [(1, [3], 1), (6, [31, -34], -1)]
    S.write_peaks(got, str(tmp_path / "out"))
    assert sorted(map(str, S.read_peaks(spark, str(tmp_path / "out")).collect())) == sorted(map(str, got.collect()))


def test_alignments_and_graph(spark, tmp_path):
    row = {"name": "r", "sequence": "ACG", "path": {"mapping": [{"position": {"node_id": "7", "offset": 2}, "edit": [{"from_length": 4}]}, {"position": {"node_id": 8, "is_reverse": True}, "edit": [{"from_length": 2}, {"from_length": 1}]}]}}
    got = S.read_alignments(spark, put(tmp_path, "a.json", json.dumps(row) + '\n{"name": "none"}\n')).collect()
    assert [(r.name, r.start, r.end, r.region_paths) for r in got] == [("r", 2, 3, [7, -8])]
    graph = {"node": [{"id": 1, "sequence": "GATTA"}, {"id": 2, "sequence": "CCA"}], "edge": [{"from": 1, "to": 2}], "path": [{"name": "ref", "mapping": [{"position": {"node_id": "1"}}, {"position": {"node_id": "2"}}]}]}
    nodes, edges, paths = S.read_graph(spark, put(tmp_path, "g.json", json.dumps(graph)))
    assert {r.node_id: r["size"] for r in nodes.collect()} == {1: 5, 2: 3}
    assert [tuple(r) for r in edges.collect()] == [(1, 2)] and sorted((r["rank"], r.node_id) for r in paths.collect()) == [(0, 1), (1, 2)]


def test_bed(spark, tmp_path):
    text = "#c\ntrack x\nchr1\t1\t5\t.\t0\t+\t.\t.\t4.5\nchr1\t10\t300\t.\t0\t-\t.\t.\t5.5\t100\nchr2\t1\t2\n"
    path = put(tmp_path, "x.bed", text)
    assert sorted((r.start_pos, r.end_pos, r.score) for r in S.read_bed(spark, path).collect()) == [(1, 2, -1.0), (1, 5, 4.5), (10, 300, 5.5)]
    assert [(r.start_pos, r.end_pos, r.summit) for r in S.read_bed(spark, path, 20).collect() if r.summit is not None] == [(90, 130, 20)]
    S.write_bed(S.read_bed(spark, path), str(tmp_path / "bed"))
    back = S.read_bed(spark, str(tmp_path / "bed"))
    cols = ["chromosome", "start_pos", "end_pos", "score"]
    assert sorted(map(tuple, back.select(*cols).collect())) == sorted(map(tuple, S.read_bed(spark, path).select(*cols).collect()))
    named = spark.createDataFrame([("c", 1, 2, "n", 3.0), ("c", 2, 3, None, None)], "chromosome string, start_pos long, end_pos long, name string, score double")
    S.write_bed(named, str(tmp_path / "named"))
    assert sorted((r.name, r.score) for r in S.read_bed(spark, str(tmp_path / "named")).collect()) == [(".", -1.0), ("n", 3.0)]
    S.cut_bed_around_summit(spark, path, str(tmp_path / "cut"), 20)
    assert [(r.chromosome, r.start_pos, r.end_pos, r.summit) for r in S.read_bed(spark, str(tmp_path / "cut")).collect()] == [("1", 90, 130, 20)]


def test_fasta(spark, tmp_path):
    peak = json.dumps({"start": 0, "end": 2, "region_paths": [1, 2], "average_q_value": 3.0})
    got = S.read_peak_fasta(spark, put(tmp_path, "x.fa", f">peak0 {peak}\nACG\nTT\n>peak1\nGG\n"))
    assert sorted((r.name, r.sequence, r.region_paths) for r in got.collect()) == [("peak0", "ACGTT", [1, 2]), ("peak1", "GG", None)]
    S.write_fasta(got, str(tmp_path / "fa"), F.col("name"), F.col("sequence"))
    assert sorted((r.name, r.sequence) for r in S.read_fasta(spark, str(tmp_path / "fa")).collect()) == [("peak0", "ACGTT"), ("peak1", "GG")]


def test_other_tables(spark, tmp_path):
    hits = S.read_motif_hits(spark, put(tmp_path, "m.tsv", "#h\nmotif\tname\tid\tstart\tstop\tstrand\tscore\nM\t.\tpeak3\t4\t9\t+\t12.5\n")).collect()
    assert [tuple(r) for r in hits] == [("peak3", 4, 9, "+", 12.5)]
    variants, genotypes = S.read_vcf(spark, put(tmp_path, "v.vcf", "##x\nchr1\t5\t.\tA\tC,G\t.\t.\t.\tGT\t0|1:3\t./2\n"))
    assert [(r.pos, r.ref, r.alt) for r in variants.collect()] == [(5, "A", ["C", "G"])]
    assert sorted((r.sample_no, r.alleles) for r in genotypes.collect()) == [(0, [0, 1]), (1, [-1, 2])]
    assert [(r.name, r.pos) for r in S.read_sam(spark, put(tmp_path, "s.sam", "@HD\nr1\t0\tchr1\t7\t60\t*\t*\t0\t0\tACG\n")).collect()] == [("r1", 7)]
    assert [(r.lo, r.hi) for r in S.read_node_ranges(spark, put(tmp_path, "n.txt", "1:90\n")).collect()] == [(1, 90)]


def test_interval_dict(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 2, [3], 1), ("a", 0, 2, [4, 5], -1), ("b", 1, 1, [6], 1)], "name string, start int, end int, region_paths array<bigint>, direction int")
    S.write_interval_dict(rows, str(tmp_path / "d"))
    got = S.read_interval_dict(spark, str(tmp_path / "d")).select(*rows.columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, rows.collect()))


def test_readers_by_ending(spark, tmp_path):
    line = '{"start": 1, "end": 2, "region_paths": [3]}'
    for name in ("a.intervalcollection", "b.jsonl"):
        assert [tuple(r) for r in S.read_reads(spark, put(tmp_path, name, line)).collect()] == [(1, 2, [3])]
    row = {"name": "r", "path": {"mapping": [{"position": {"node_id": 7}, "edit": [{"from_length": 4}]}]}}
    assert [tuple(r) for r in S.read_reads(spark, put(tmp_path, "c.json", json.dumps(row))).collect()] == [(0, 4, [7])]
    with pytest.raises(ValueError):
        S.read_reads(spark, "x.bin")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        S.read_reads(spark, str(tmp_path / "none.jsonl"))


def test_more_tables(spark, tmp_path):
    assert [tuple(r) for r in S.read_bedgraph(spark, put(tmp_path, "t.bedgraph", "track x\nc\t1\t4\t2.5\nc\t4\t4\t1\n")).collect()] == [("c", 1, 4, 2.5)]
    assert [tuple(r) for r in S.read_set_summary(spark, put(tmp_path, "s.txt", "p1, (1, 2.5, x)\n\n")).collect()] == [("p1", [1.0, 2.5])]
    assert [tuple(r) for r in S.read_diplotypes(spark, put(tmp_path, "d.tsv", "p1\t[1, 2]\t[1,3]\t5\t4\n")).collect()] == [("p1", [1, 2], [1, 3], 5, 4)]
    sam = S.read_sam(spark, put(tmp_path, "x.sam", "r1\t0\tc\t7\t60\t*\t*\t0\t0\tACG\tIII\tX0:i:1\tXA:Z:c,1:2\n")).collect()
    assert sam[0].tags == {"X0": "1", "XA": "c,1:2"}
    fasta = S.read_linear_peak_fasta(spark, put(tmp_path, "l.fa", '>p {"chromosome": "c", "start": 1, "end": 4, "score": 2.0}\nACG\n')).collect()
    assert [tuple(r) for r in fasta] == [("p", "ACG", "c", 1, 4, 2.0)]


def test_ranked_fasta(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", 2.0), (2, "C", 5.0), (3, "G", None), (4, "T", 5.0)], "id long, sequence string, score double")
    S.write_ranked_fasta(rows, str(tmp_path / "r"), "score", "id", ["id"])
    got = S.read_fasta(spark, str(tmp_path / "r")).collect()
    assert [(r.name, r.sequence) for r in sorted(got, key=lambda r: r.name)] == [("peak0", "C"), ("peak1", "T"), ("peak2", "A"), ("peak3", "G")]


def test_comparisons_and_unique_peaks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5, 6, 2, 3, 4), ("b", 1, 1, 1, 0, 0)], "name string, total_graph long, total_linear long, shared long, unique_graph long, unique_linear long")
    S.write_comparison(rows, str(tmp_path / "c"))
    assert tuple(S.venn_totals(S.read_comparisons(spark, str(tmp_path / "c"))).first()) == (6, 7, 3, 3, 4)
    peaks = spark.createDataFrame([("p", 1, 2, [1]), ("q", 1, 2, [2])], "unique_id string, start int, end int, region_paths array<bigint>")
    S.write_unique_peaks(peaks, peaks.filter("unique_id = 'p'"), str(tmp_path / "u"), "unique_id")
    assert [r.unique_id for r in S.read_peaks(spark, str(tmp_path / "u")).collect()] == ["q"]
    S.write_projected(spark.createDataFrame([("c", 1, 5, "-")], "chrom string, a long, b long, strand string"), str(tmp_path / "p"))
    assert spark.read.text(str(tmp_path / "p")).first().value == "c\t1\t5\t.\t0\t-"


def test_subgraphs_and_maps(spark, tmp_path):
    links = spark.createDataFrame([(1, 1, 2, 3.0), (1, 2, 3, 1.0), (9, 9, 10, 1.0)], "component long, src long, dst long, score double")
    S.write_subgraphs(links, str(tmp_path / "g"))
    assert sorted(tuple(r) for r in S.read_subgraph_sizes(spark, str(tmp_path / "g")).collect()) == [(1, 3, 2), (9, 2, 1)]
    lmap = spark.createDataFrame([("c", 1, 5, 0, 5), ("d", 2, 5, 0, 6)], "chrom string, node_id long, size int, lin_start long, lin_end long")
    S.write_linear_map(lmap, str(tmp_path / "m"))
    assert [(r.node_id, r.lin_end) for r in S.read_linear_map(spark, str(tmp_path / "m"), ["d"]).collect()] == [(2, 6)]


def test_partitioned_writes(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 1), ("chr2", 2)], "chromosome string, x int")
    S.write_by_chromosome(df, str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).filter("chromosome = 'chr2'").first().x == 2
    track = spark.createDataFrame([("c", 5, 6, 1), ("c", 1, 2, 1)], "chrom string, start_pos long, end_pos long, value long")
    S.write_track(track, str(tmp_path / "t"))
    assert sorted(tuple(r) for r in S.read_tracks(spark, str(tmp_path / "t")).collect()) == [("c", 1, 2, 1), ("c", 5, 6, 1)]
