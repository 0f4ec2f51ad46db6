"""Typed loading of delimited interval lines, with the unreadable ones set apart.

The lines are read quote-aware by Python's strict csv reader inside Spark tasks; nothing but
the table of file layouts (one row per file) is joined to them.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathtide.operators.scan import scan, sharded

#: The place of the score in a line, by layout.
SCORE_FIELD = {"narrowpeak": 8, "bed6": 4}
#: Lines that begin so hold no data.
NO_DATA = ("#", "track", "browser")

_DIGITS = re.compile(r"[0-9]+\Z")
_DECIMAL = re.compile(r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
_LONG_MAX = 2**63 - 1
# A field is as long as its line.
csv.field_size_limit(2**31 - 1)
_FIELDS = "line_id long, run_id long, line_no int, reason string, chromosome string, start_pos long, end_pos long, name string, strand string, score double"


class BadStart(ValueError):
    """The start is no plain number below the end."""


class BadScore(ValueError):
    """The score is neither a lone dot nor a finite, non-negative decimal."""


def _split(line: str) -> list[str]:
    """The fields of one record. Raises csv.Error on broken quoting.

    The csv module takes a bare carriage return or line feed for the end of a row; inside a
    record they are content here, so they are carried through as characters the line lacks.
    """
    swap = {}
    if "\r" in line or "\n" in line:
        free = (c for c in map(chr, range(0xE000, 0xF8FF)) if c not in line)
        swap = {"\r": next(free), "\n": next(free)}
        for a, b in swap.items():
            line = line.replace(a, b)
    fields = next(csv.reader([line], delimiter="\t", strict=True))
    for a, b in swap.items():
        fields = [f.replace(b, a) for f in fields]
    return fields


def _start_end(start: str, end: str) -> tuple[int, int]:
    if not (_DIGITS.match(start) and _DIGITS.match(end)):
        raise BadStart
    a, b = int(start), int(end)
    if a >= b or b > _LONG_MAX:
        raise BadStart
    return a, b


def _score(text: str) -> float | None:
    if text == ".":
        return None
    if not _DECIMAL.match(text):
        raise BadScore
    value = float(text)
    if value == float("inf"):
        raise BadScore
    return value


def _data(line: str | None) -> str | None:
    """The line without its end, None if it holds no data."""
    if line is None or not line.strip() or line.startswith(NO_DATA):
        return None
    return line.removesuffix("\n").removesuffix("\r")


def parse_line(line: str | None, n_columns: int | None, score_field: int | None, fields: list[str] | None = None) -> tuple | None:
    """(reason, chromosome, start, end, name, strand, score) of one line; None if it holds no data. ``fields`` may be given if they are known."""
    line = _data(line)
    if line is None:
        return None
    try:
        fields = _split(line) if fields is None else fields
        if n_columns is None or len(fields) != n_columns or score_field is None or len(fields) <= max(score_field, 5):
            return ("columns", *[None] * 6)
        start, end = _start_end(fields[1], fields[2])
        score = _score(fields[score_field])
    except csv.Error:
        return ("quoting", *[None] * 6)
    except BadStart:
        return ("start", *[None] * 6)
    except BadScore:
        return ("score", *[None] * 6)
    return (None, fields[0], start, end, fields[3], fields[5], score)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["reason", "chromosome", "start_pos", "end_pos", "name", "strand", "score"]
    for pdf in batches:
        data = [_data(x) for x in pdf["raw_line"]]
        # Without quotes or line breaks within them, lines are records whatever comes next: one reader takes them all.
        plain = [i for i, x in enumerate(data) if x is not None and not ('"' in x or "\r" in x or "\n" in x)]
        known = dict(zip(plain, csv.reader((data[i] for i in plain), delimiter="\t", strict=True), strict=True))
        keep, out = [], []
        for i, (line, n, place) in enumerate(zip(pdf["raw_line"], pdf["n_columns"], pdf["score_field"], strict=True)):
            got = parse_line(line, None if pd.isna(n) else int(n), None if pd.isna(place) else int(place), known.get(i))
            if got is not None:
                keep.append(i)
                out.append(got)
        done = pd.DataFrame(out, columns=names)
        head = pdf.iloc[keep][["line_id", "run_id", "line_no"]].reset_index(drop=True)
        done = done.astype({"start_pos": "Int64", "end_pos": "Int64", "score": "float64"})
        yield pd.concat([head, done], axis=1)


def assemble_records(lines: DataFrame, file: str, order: str, text: str, width: int = 1 << 14) -> DataFrame:
    """Records of files in which a quoted field may go on in the next line: ``file``, ``order`` (of the first line), ``text``.

    A line begins a record if the file's lines before it hold an even number of double quotes. They
    are counted along each file in stretches of ``width`` line numbers, which must be unique in a
    file, so that no file is one task's work. A quote that is never closed takes in the rest of its
    file. Rows with a null file, order or text are left out.
    """
    own = lines.select(F.col(file).alias("f"), F.col(order).alias("o"), F.col(text).alias("t")).dropna()
    own = own.withColumn("quotes", F.length("t") - F.length(F.replace("t", F.lit('"'))))
    own = scan(sharded(own, ["f"], "o", width), ["f"], "o", sums={"upto": "quotes"})
    begins = own.withColumn("head", ((F.col("upto") - F.col("quotes")) % 2 == 0).cast("int")).drop("shard")
    numbered = scan(sharded(begins, ["f"], "o", width), ["f"], "o", sums={"record": "head"})
    got = numbered.groupBy("f", "record").agg(F.min("o").alias(order), F.array_sort(F.collect_list(F.struct("o", "t"))).alias("p"))
    return got.select(F.col("f").alias(file), order, F.array_join(F.transform("p", lambda x: x.t), "\n").alias(text))


def parse_lines(lines: DataFrame, layouts: DataFrame) -> DataFrame:
    """Every data line of ``lines``, typed, or with the reason why it can't be.

    lines: line_id, run_id, line_no, raw_line. layouts: one row per run_id with file_format and
    n_columns. Other columns are ignored, whatever their names. Result: line_id, run_id, line_no,
    reason (null for a valid line), chromosome, start_pos, end_pos, name, strand, score (null: none).

    Each line is one record; files whose records may span lines go through
    :func:`assemble_records` first. Reasons, the first that applies: ``quoting``, ``columns``, ``start``, ``score``. A null, blank
    or comment line gives no row. A line whose run has no layout can't have the run's number of
    fields: ``columns``. Bounds beyond BIGINT can't be typed: ``start``. Repeated lines each give
    a row; an empty table gives an empty result.
    """
    places = F.create_map(*[F.lit(x) for kv in SCORE_FIELD.items() for x in kv])
    known = layouts.groupBy("run_id").agg(
        F.min(F.struct("n_columns", F.lower("file_format").alias("file_format"))).alias("l")
    ).select("run_id", F.col("l.n_columns").alias("n_columns"), places[F.col("l.file_format")].alias("score_field"))
    got = lines.select("line_id", "run_id", "line_no", "raw_line").join(known, "run_id", "left")
    return got.mapInPandas(_parse, _FIELDS)


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid typed rows, rejected lines with their reason) of :func:`parse_lines`' result."""
    bad: Column = F.col("reason").isNotNull()
    return parsed.filter(~bad).drop("reason"), parsed.filter(bad).select("line_id", "run_id", "line_no", "reason")
