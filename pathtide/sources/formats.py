"""Readers and writers of the field's text formats, as Spark scans and writes.

Every reader takes a path (or paths) Spark can list and gives plain columns; every writer takes a
DataFrame and a folder. Nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathtide.operators.scan import ranked

#: The fields of a peak's JSON line.
PEAK_JSON = "start int, end int, region_paths array<bigint>, direction int, average_q_value double, unique_id string, is_ambigous int, is_diff int, chromosome string"
LINEAR_JSON = "chromosome string, start bigint, end bigint, score double"
ALIGNMENT_JSON = (
    "name string, sequence string, mapping_quality int, identity double, path struct<mapping: array<struct<"
    "position: struct<node_id: string, offset: int, is_reverse: boolean>, rank: int, edit: array<struct<from_length: int, to_length: int, sequence: string>>>>>"
)
GRAPH_JSON = "node array<struct<id: bigint, sequence: string>>, edge array<struct<from: bigint, to: bigint>>, path array<struct<name: string, mapping: array<struct<position: struct<node_id: string>, rank: int>>>>"


def read_peaks(spark: SparkSession, path: str) -> DataFrame:
    """Peaks or intervals, one JSON object a line; a missing direction is 1. Lines that are no JSON give no row."""
    got = spark.read.text(path).select(F.from_json("value", PEAK_JSON).alias("p")).filter("p.region_paths is not null").select("p.*")
    return got.withColumn("direction", F.coalesce("direction", F.lit(1)))


def write_peaks(peaks: DataFrame, path: str) -> None:
    """JSON lines with the fields of ``PEAK_JSON`` that ``peaks`` has."""
    names = [f.split()[0] for f in PEAK_JSON.split(", ")]
    peaks.select(F.to_json(F.struct(*[n for n in names if n in peaks.columns])).alias("value")).write.text(path)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """Aligned reads: name, start, end, region_paths (negative on the reverse strand), mapping_quality, sequence.

    Node ids may be quoted; a missing offset is 0. The end counts the last mapping's edits. Lines
    without a mapping give no row.
    """
    got = spark.read.text(path).select(F.from_json("value", ALIGNMENT_JSON).alias("r")).select("r.*").filter(F.size("path.mapping") > 0)
    m = F.col("path.mapping")
    offset = lambda x: F.coalesce(x.position.offset, F.lit(0))
    node = F.transform(m, lambda x: F.when(F.coalesce(x.position.is_reverse, F.lit(False)), -x.position.node_id.cast("bigint")).otherwise(x.position.node_id.cast("bigint")))
    last = F.element_at(m, -1)
    used = F.aggregate(F.coalesce(last.edit, F.array()), F.lit(0), lambda a, e: a + F.coalesce(e.from_length, F.lit(0)))
    return got.select("name", offset(F.element_at(m, 1)).alias("start"), (offset(last) + used).alias("end"), node.alias("region_paths"), "mapping_quality", "sequence")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes: node_id, sequence, size; edges: src, dst; paths: name, rank, node_id) of graphs in JSON lines."""
    doc = spark.read.text(path).select(F.from_json("value", GRAPH_JSON).alias("g")).select("g.*")
    nodes = doc.select(F.explode("node").alias("n")).select(F.col("n.id").alias("node_id"), "n.sequence", F.length("n.sequence").alias("size"))
    edges = doc.select(F.explode("edge").alias("e")).select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"))
    paths = doc.select(F.explode("path").alias("p")).select("p.name", F.posexplode("p.mapping").alias("rank", "m"))
    return nodes, edges, paths.select("name", "rank", F.col("m.position.node_id").cast("bigint").alias("node_id"))


def _fields(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated fields of the lines that hold data."""
    text = spark.read.text(path).filter(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != ""))
    return text.select(F.split("value", "\t").alias("f"))


def read_bed(spark: SparkSession, path: str, cut_around_summit: int | None = None) -> DataFrame:
    """BED or narrowPeak: chromosome, start_pos, end_pos, name, strand, score, summit.

    score is the ninth field where there is one, else -1; summit the tenth, else null. With
    ``cut_around_summit`` an interval is cut to so many positions on either side of its summit.
    """
    f = lambda k: F.get("f", F.lit(k))
    got = _fields(spark, path).select(f(0).alias("chromosome"), f(1).try_cast("bigint").alias("start_pos"), f(2).try_cast("bigint").alias("end_pos"), f(3).alias("name"), f(5).alias("strand"), F.coalesce(f(8).try_cast("double"), F.lit(-1.0)).alias("score"), f(9).try_cast("bigint").alias("summit"))
    if cut_around_summit is None:
        return got
    at = F.col("start_pos") + F.col("summit")
    a, b = F.greatest(at - cut_around_summit, F.col("start_pos")), F.least(at + cut_around_summit, F.col("end_pos"))
    return got.withColumns({"start_pos": F.coalesce(a, "start_pos"), "end_pos": F.coalesce(b, "end_pos"), "summit": at - a})


def write_bed(peaks: DataFrame, path: str) -> None:
    """chromosome, start, end, name, four dots, score with two places; a missing name is a dot, a missing score -1."""
    name = F.coalesce("name", F.lit(".")) if "name" in peaks.columns else F.lit(".")
    line = F.concat_ws("\t", "chromosome", F.col("start_pos").cast("string"), F.col("end_pos").cast("string"), name, *[F.lit(".")] * 4, F.format_string("%.2f", F.coalesce("score", F.lit(-1.0))))
    peaks.select(line.alias("value")).write.text(path)


def cut_bed_around_summit(spark: SparkSession, path: str, out: str, half: int) -> None:
    """Rewrites narrowPeak lines cut to ``half`` positions on either side of the summit, with bare chromosome names and the summit counted anew."""
    f = _fields(spark, path).select("f")
    get = lambda k: F.get("f", F.lit(k))
    start, end, at = get(1).try_cast("bigint"), get(2).try_cast("bigint"), get(1).try_cast("bigint") + get(9).try_cast("bigint")
    a, b = F.greatest(at - half, start), F.least(at + half, end)
    line = F.concat_ws("\t", F.regexp_replace(get(0), "^chr", ""), a.cast("string"), b.cast("string"), F.array_join(F.slice("f", 4, 6), "\t"), (at - a).cast("string"))
    f.filter(at.isNotNull() & end.isNotNull()).select(line.alias("value")).write.text(out)


def write_projected(alignments: DataFrame, path: str) -> None:
    """Stranded linear intervals (chrom, a, b, strand) as lines: chromosome, start, end, dot, 0, strand."""
    line = F.concat_ws("\t", "chrom", F.col("a").cast("string"), F.col("b").cast("string"), F.lit("."), F.lit("0"), "strand")
    alignments.select(line.alias("value")).write.text(path)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Records ``>id {json}`` with their sequence: name, info (the JSON text, if any), sequence.

    Records are split at the header mark, so a sequence may have any number of lines.
    """
    got = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    head, body = F.split_part("value", F.lit("\n"), F.lit(1)), F.regexp_replace(F.regexp_replace("value", "^[^\n]*\n?", ""), "\\s", "")
    return got.select(F.split_part(head, F.lit(" "), F.lit(1)).alias("name"), F.nullif(F.trim(F.regexp_replace(head, "^[^ ]*", "")), F.lit("")).alias("info"), body.alias("sequence"))


def read_peak_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence and the peak's fields of a peak FASTA."""
    return read_fasta(spark, path).select("name", "sequence", F.from_json("info", PEAK_JSON).alias("p")).select("name", "sequence", "p.*")


def write_fasta(records: DataFrame, path: str, name: Column, sequence: Column, info: Column | None = None) -> None:
    """One record a row; ``info`` follows the name."""
    head = F.concat(F.lit(">"), name) if info is None else F.concat(F.lit(">"), name, F.lit(" "), info)
    records.select(F.concat(head, F.lit("\n"), sequence).alias("value")).write.text(path)


def read_motif_hits(spark: SparkSession, path: str) -> DataFrame:
    """Motif scanner output: peak_id, start, stop, strand, score; headers and other comment lines are skipped."""
    f = lambda k: F.get("f", F.lit(k))
    got = _fields(spark, path).select(f(2).alias("peak_id"), f(3).try_cast("int").alias("start"), f(4).try_cast("int").alias("stop"), f(5).alias("strand"), f(6).try_cast("double").alias("score"))
    return got.filter(F.col("start").isNotNull())


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(variants: chromosome, pos, ref, alt; genotypes: chromosome, pos, sample_no, alleles).

    Unphased genotypes are read like phased ones; an unknown allele is -1.
    """
    f = lambda k: F.get("f", F.lit(k))
    got = _fields(spark, path).select("f", f(0).alias("chromosome"), f(1).try_cast("bigint").alias("pos"), f(3).alias("ref"), F.split(f(4), ",").alias("alt"))
    each = got.select("chromosome", "pos", F.posexplode(F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0)))).alias("sample_no", "g"))
    alleles = F.transform(F.split(F.split_part("g", F.lit(":"), F.lit(1)), "[|/]"), lambda a: F.when(a == ".", -1).otherwise(a.try_cast("int")))
    return got.drop("f"), each.select("chromosome", "pos", "sample_no", alleles.alias("alleles"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments of a SAM: name, flag, chromosome, pos, mapq, sequence, and the tags as a map of text."""
    got = spark.read.text(path).filter(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f"))
    f = lambda k: F.get("f", F.lit(k))
    return got.select(f(0).alias("name"), f(1).try_cast("int").alias("flag"), f(2).alias("chromosome"), f(3).try_cast("bigint").alias("pos"), f(4).try_cast("int").alias("mapq"), f(9).alias("sequence"), _tags().alias("tags"))


def _tags() -> Column:
    """The fields after the eleventh, NAME:TYPE:VALUE, as NAME to VALUE."""
    rest = F.filter(F.slice("f", 12, 2**30), lambda x: F.size(F.split(x, ":", 3)) == 3)
    return F.map_from_entries(F.array_distinct(F.transform(rest, lambda x: F.struct(F.split(x, ":", 3)[0].alias("k"), F.split(x, ":", 3)[2].alias("v")))))


def read_node_ranges(spark: SparkSession, path: str) -> DataFrame:
    """File name, lo and hi of range files that hold ``lo:hi``."""
    got = spark.read.text(path).select(F.input_file_name().alias("file"), F.split("value", ":").alias("f"))
    return got.select("file", F.get("f", F.lit(0)).try_cast("bigint").alias("lo"), F.get("f", F.lit(1)).try_cast("bigint").alias("hi")).dropna()


def read_interval_dict(spark: SparkSession, path: str) -> DataFrame:
    """Sections ``#name`` with JSON intervals: name and the intervals' fields. A section lies in one file, read in order."""
    got = spark.read.option("lineSep", "#").text(path).filter(F.trim("value") != "")
    lines = got.select(F.trim(F.split_part("value", F.lit("\n"), F.lit(1))).alias("name"), F.explode(F.slice(F.split("value", "\n"), 2, 2**31 - 1)).alias("line"))
    return lines.filter(F.trim("line") != "").select("name", F.from_json("line", PEAK_JSON).alias("p")).select("name", "p.*")


def write_interval_dict(intervals: DataFrame, path: str) -> None:
    """One section per ``name``, a line an interval, in the order of start and end."""
    w = Window.partitionBy("name").orderBy("start", "end", "line")
    each = intervals.withColumn("line", F.to_json(F.struct("start", "end", "region_paths", "direction"))).withColumn("k", F.row_number().over(w))
    text = F.when(F.col("k") == 1, F.concat(F.lit("#"), F.col("name"), F.lit("\n"), F.col("line"))).otherwise(F.col("line"))
    each.select("name", "k", text.alias("value")).repartition("name").sortWithinPartitions("name", "k").select("value").write.text(path)


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """Reads by the path's ending: start, end, region_paths.

    ``.json`` and ``.gam.json`` hold alignments, ``.intervalcollection`` and ``.jsonl`` intervals,
    ``.parquet`` a table of these columns. Anything else is an error; so is a path that isn't there.
    """
    cols = ["start", "end", "region_paths"]
    if path.endswith((".intervalcollection", ".jsonl")):
        return read_peaks(spark, path).select(*cols)
    if path.endswith(".json"):
        return read_alignments(spark, path).select(*cols)
    if path.endswith(".parquet"):
        return spark.read.parquet(path).select(*cols)
    raise ValueError(f"no reader for {path}")


def read_linear_peak_fasta(spark: SparkSession, path: str) -> DataFrame:
    """name, sequence and the linear peak's fields (chromosome, start, end, score) of a FASTA."""
    return read_fasta(spark, path).select("name", "sequence", F.from_json("info", LINEAR_JSON).alias("p")).select("name", "sequence", "p.*")


def write_ranked_fasta(records: DataFrame, path: str, score: str, tie: str, fields: list[str], sequence: str = "sequence") -> None:
    """Records ``>peak<i> {json}`` numbered by falling score (then ``tie``), in that order over the files; null scores come last."""
    best = F.coalesce(F.when(~F.isnan(score), F.col(score)), F.lit(float("-inf")))
    placed = ranked(records.withColumn("_best", F.greatest(best, F.lit(-1e300))).withColumn("_all", F.lit(0)), ["_all"], "_best", tie, 1.0)
    text = F.concat(F.lit(">peak"), (F.col("place") - 1).cast("string"), F.lit(" "), F.to_json(F.struct(*fields)), F.lit("\n"), F.col(sequence))
    placed.select("place", text.alias("value")).repartitionByRange("place").sortWithinPartitions("place").select("value").write.text(path)


def read_bedgraph(spark: SparkSession, path: str) -> DataFrame:
    """A track: chrom, start_pos, end_pos, value."""
    f = lambda k: F.get("f", F.lit(k))
    got = _fields(spark, path).select(f(0).alias("chrom"), f(1).try_cast("bigint").alias("start_pos"), f(2).try_cast("bigint").alias("end_pos"), f(3).try_cast("double").alias("value"))
    return got.filter("start_pos < end_pos and value is not null")


def read_set_summary(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``id, (a, b, ...)``: id, numbers."""
    text = spark.read.text(path)
    got = text.select(F.trim(F.regexp_extract("value", "^([^,]*),", 1)).alias("id"), F.transform(F.split(F.regexp_extract("value", "\\(([^)]*)\\)", 1), ","), lambda x: F.trim(x).try_cast("double")).alias("numbers"))
    return got.filter("id <> ''").withColumn("numbers", F.array_compact("numbers"))


def read_diplotypes(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated peak_id, best and second haplotype as lists of numbers in brackets, and their read counts."""
    f = lambda k: F.get("f", F.lit(k))
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit("-?[0-9]+"), 0), lambda x: x.cast("bigint"))
    return _fields(spark, path).select(f(0).alias("peak_id"), numbers(f(1)).alias("first_path"), numbers(f(2)).alias("second_path"), f(3).try_cast("int").alias("n_first"), f(4).try_cast("int").alias("n_second"))


def write_by_chromosome(df: DataFrame, path: str, column: str = "chromosome") -> None:
    """Parquet, one folder a chromosome, so that later scans prune."""
    df.write.partitionBy(column).parquet(path)


def write_track(track: DataFrame, path: str) -> None:
    """Runs of a track as parquet, one folder a chromosome, sorted for tight row group statistics."""
    track.repartition("chrom").sortWithinPartitions("chrom", "start_pos").write.partitionBy("chrom").parquet(path)


def read_tracks(spark: SparkSession, path: str, chromosomes: list[str] | None = None) -> DataFrame:
    """What :func:`write_track` wrote, of all chromosomes or some: whole folders are skipped. The start of a later stage."""
    got = spark.read.option("basePath", path).parquet(path)
    got = got.select(F.col("chrom").cast("string").alias("chrom"), *[c for c in got.columns if c != "chrom"])
    return got if chromosomes is None else got.filter(F.col("chrom").isin(chromosomes))


def write_linear_map(lmap: DataFrame, path: str) -> None:
    """chrom, node_id, size, lin_start, lin_end, one folder a chromosome."""
    lmap.select("chrom", "node_id", "size", "lin_start", "lin_end").repartition("chrom").sortWithinPartitions("node_id").write.partitionBy("chrom").parquet(path)


read_linear_map = read_tracks


def write_subgraphs(links: DataFrame, path: str) -> None:
    """Edges of the peaks' sub-graphs: component, src, dst, score; one table, sorted by component so that a reader of some skips the rest."""
    links.select("component", "src", "dst", "score").repartitionByRange("component").sortWithinPartitions("component", "src").write.parquet(path)


def read_subgraph_sizes(spark: SparkSession, path: str) -> DataFrame:
    """component, n_nodes, n_edges of :func:`write_subgraphs`."""
    own = spark.read.parquet(path)
    ends = own.select("component", F.explode(F.array("src", "dst")).alias("node")).groupBy("component").agg(F.countDistinct("node").alias("n_nodes"))
    return own.groupBy("component").agg(F.count(F.lit(1)).alias("n_edges")).join(ends, "component").select("component", "n_nodes", "n_edges")


#: The columns of a comparison file.
COMPARISON = "total_graph,total_linear,shared,unique_graph,unique_linear"


def write_comparison(report: DataFrame, path: str) -> None:
    """One line a row of a comparison of two peak sets: name and the counts of ``COMPARISON``."""
    report.select("name", *COMPARISON.split(",")).write.option("header", True).csv(path)


def read_comparisons(spark: SparkSession, path: str) -> DataFrame:
    """The comparisons of one or more folders."""
    return spark.read.option("header", True).schema("name string, " + ", ".join(f"{c} bigint" for c in COMPARISON.split(","))).csv(path)


def venn_totals(comparisons: DataFrame) -> DataFrame:
    """One row: the counts of all comparisons added up."""
    return comparisons.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COMPARISON.split(",")])


def write_unique_peaks(peaks: DataFrame, matched: DataFrame, path: str, item: str) -> None:
    """The peaks that have no row in ``matched``, as JSON lines."""
    write_peaks(peaks.join(matched.select(item).distinct(), item, "left_anti"), path)
