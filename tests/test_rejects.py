from pathtide.sources.rejects import assemble_records, parse_line, parse_lines, split_rejects


def reason(line, n=10, place=8):
    got = parse_line(line, n, place)
    return "none" if got is None else got[0]


GOOD = "chr1\t5\t9\tpk\t7\t+\t1.0\t2.0\t3.5\t2"


def test_reasons():
    assert reason(GOOD) is None and reason(GOOD + "\r") is None and reason(GOOD + "\r\n") is None
    assert reason(GOOD + "\t\r") == "columns"
    assert reason(GOOD.replace("pk", '"p\tk"')) is None
    assert reason(GOOD.replace("pk", '"p""k"')) is None
    assert reason(GOOD.replace("pk", 'p "k" q')) is None
    assert reason(GOOD.replace("pk", '"pk')) == "quoting"
    assert reason(GOOD.replace("pk", '"p"k')) == "quoting"
    assert reason(GOOD.replace("pk", "p\rk")) is None
    assert reason(GOOD.replace("pk", '"p\rk')) == "quoting"
    for bad in ("", "-5", "5.0", "1e0", "5 ", "٥", "9", "99999999999999999999"):
        assert reason(GOOD.replace("\t5\t", f"\t{bad}\t")) == "start", bad
    assert reason(GOOD.replace("\t5\t", '\t"5"\t')) is None
    for bad in ("", "inf", "nan", "-1", "1e", "1,5", "1e999", "٣", " 1", "+1", "1.2.3"):
        assert reason(GOOD.replace("3.5", bad)) == "score", bad
    for ok in (".", "0", "5.", ".5", "1e3", "1.5E-3", '"3.5"'):
        assert reason(GOOD.replace("3.5", ok)) is None, ok
    for blank in ("", "   ", "\r", "#x", "track a", "browser b", None):
        assert reason(blank) == "none"
    assert reason(GOOD, None, 8) == "columns" and reason("a\tb", 2, 8) == "columns"
    assert reason("chr1\t5\t9\tpk\tx\t+", 6, 4) == "score"
    assert reason("x" * 1_000_000) == "columns"


def test_tables(spark):
    lines = spark.createDataFrame(
        [(1, 1, 1, GOOD, "a"), (1, 1, 1, GOOD, "b"), (2, 1, 2, "#", None), (3, 9, 1, GOOD, None), (4, None, 1, GOOD, None), (5, 1, None, GOOD.replace("3.5", "."), None), (6, 1, 3, None, None), (7, 1, 4, GOOD + "\r", None), (8, 1, 5, GOOD + "\r\r", None)],
        "line_id long, run_id long, line_no int, raw_line string, score_field string",
    )
    runs = spark.createDataFrame([(1, "narrowPeak", 10, 3), (1, "narrowPeak", 10, 4), (2, None, None, 1)], "run_id long, file_format string, n_columns int, line_no int")
    ok, bad = split_rejects(parse_lines(lines, runs))
    assert [(r.line_id, r.score) for r in ok.orderBy("line_id").collect()] == [(1, 3.5), (1, 3.5), (5, None), (7, 3.5), (8, 3.5)]
    assert sorted((r.line_id, r.reason) for r in bad.collect()) == [(3, "columns"), (4, "columns")]
    assert parse_lines(lines.limit(0), runs).count() == 0
    assert parse_lines(lines, runs.limit(0)).filter("reason = 'columns'").count() == 7


def test_assembled_records(spark):
    text = ['a\t"x', "y", 'z"\tb', "plain", 'q ""', '"open', "rest"]
    rows = [("f", i, t, 0) for i, t in enumerate(text)] + [("g", 0, "one", 0), ("g", 1, None, 0), (None, 0, "x", 0)]
    df = spark.createDataFrame(rows, "file string, line int, text string, record int")
    for width in (1, 3, 1000):
        got = sorted(tuple(r) for r in assemble_records(df, "file", "line", "text", width).collect())
        assert got == [("f", 0, 'a\t"x\ny\nz"\tb'), ("f", 3, "plain"), ("f", 4, 'q ""'), ("f", 5, '"open\nrest'), ("g", 0, "one")]
    assert assemble_records(df.limit(0), "file", "line", "text").count() == 0
