"""CSV inputs: every column as text, missing-value words as null, row positions, bad records."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from opsmeter.functions.text import quote
from opsmeter.operators.ranges import running_total
from opsmeter.operators.staging import stage

# Texts that stand for a missing value in a CSV cell.
MISSING_WORDS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# What a scan says of each record besides its cells: the whole text of one whose cells do not
# fit the header, and the file and split it came from.
RECORD = "_malformed_record"
SPLIT_FILE, SPLIT_START = "_split_file", "_split_start"

# a quoted cell with quotes inside doubled, one without a quote at its start, or nothing
_QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
_CELL = f'(?:{_QUOTED}|[^",][^,]*+|)'
_WHOLE_LINE = f"^{_CELL}(?:,{_CELL})*+$"


@dataclass(frozen=True)
class Quarantine:
    """Where bad records go instead of ending the job, and which share of all may be bad."""

    folder: str
    allowed: float = 0.0


def missing_to_null(df: DataFrame) -> DataFrame:
    """Null for every missing-value word in the text columns."""
    words = ", ".join(quote(word) for word in MISSING_WORDS)
    texts = {name for name, kind in df.dtypes if kind == "string"}
    return df.selectExpr(
        *[f"IF(`{c}` IN ({words}), NULL, `{c}`) AS `{c}`" if c in texts else f"`{c}`" for c in df.columns]
    )


def _is_cut(columns: int) -> str:
    """A malformed record that has too many cells, or a quote that is still open at its end.

    One with too few cells is complete: the missing ones are null.
    """
    outside_quotes = f"regexp_replace({RECORD}, '{_QUOTED}', '')"
    cells = f"length({outside_quotes}) - length(replace({outside_quotes}, ',', '')) + 1"
    return f"({cells} > {columns} OR contains({outside_quotes}, '\"'))"


def broken_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, broken``: whether a record of the file may reach beyond its line.

    One scan of the lines, which are split wherever Spark likes. A line is whole if its cells are:
    quotes open and close within it, so their number is even. As long as all lines of
    a file are whole, each starts outside quotes, so no cell holds a line break.
    """
    broken = f"""CASE WHEN NOT contains(value, '"') THEN false
        WHEN (length(value) - length(replace(value, '"', ''))) % 2 = 1 THEN true
        ELSE NOT value RLIKE {quote(_WHOLE_LINE)} END"""
    lines = spark.read.text(path).selectExpr("_metadata.file_path AS file", f"{broken} AS broken")
    return lines.groupBy("file").agg(F.max("broken").alias("broken"))


def _path_of(spark: SparkSession, file: str) -> str:
    """A path to read from a file's name as Spark reports it: decoded, pattern letters escaped."""
    jvm = spark._jvm
    plain = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file)).toString()
    return "".join(f"\\{c}" if c in "\\*?[]{}" else c for c in plain)


def _layout(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """The paths to read record by record over lines (``True``) and line by line (``False``)."""
    found = broken_files(spark, path).collect()  # file names, which the scan's driver holds anyway
    by_kind = {kind: [r.file for r in found if r.broken == kind] for kind in (True, False)}
    if not by_kind[True]:
        return {False: [path]}
    if not by_kind[False]:
        return {True: [path]}
    return {kind: [_path_of(spark, file) for file in files] for kind, files in by_kind.items()}


def scan_csv(
    spark: SparkSession,
    path: str,
    multi_line: bool | None = None,
    quarantine: Quarantine | None = None,
) -> DataFrame:
    """``read_csv`` with ``RECORD`` and the record's split left in."""

    def reader(lines: bool):
        return spark.read.options(header=True, escape='"', multiLine=lines)

    layout = _layout(spark, path) if multi_line is None else {multi_line: [path]}
    # the first header gives the names; every other file's header must be the same
    header = reader(True in layout).csv(path).schema
    schema = StructType([*header.fields, StructField(RECORD, StringType())])
    options = {"enforceSchema": False, "columnPruning": False, "columnNameOfCorruptRecord": RECORD}
    if len(layout) > 1 and spark.read.text(path).columns != ["value"]:
        options["basePath"] = path  # names of folders are columns: keep them for single files
    scans = [
        reader(lines)
        .schema(schema)
        .options(**options)
        .csv(files)
        .selectExpr("*", f"_metadata.file_path AS {SPLIT_FILE}", f"_metadata.file_block_start AS {SPLIT_START}")
        for lines, files in layout.items()
    ]
    rows = reduce(DataFrame.unionAll, scans)
    is_cut = f"({RECORD} IS NOT NULL AND {_is_cut(len(header.fields))})"
    if quarantine is not None:
        return _set_aside(rows, is_cut, quarantine)
    # naming a real column too: Spark refuses scans that read nothing but the record
    shown = f"left(coalesce({RECORD}, `{header.names[0]}`), 200)"
    fails = f"raise_error(concat('CSV record with a wrong number of cells or an open quote: ', {shown}))"
    return rows.where(f"CASE WHEN {is_cut} THEN {fails} ELSE true END")


def _set_aside(rows: DataFrame, is_cut: str, quarantine: Quarantine) -> DataFrame:
    """The rows without the bad ones, which are written to the quarantine.

    The input is parsed once, into a stored table, from which counts, bad and good records follow.
    """
    parsed = stage(rows.selectExpr("*", f"{is_cut} AS _is_bad"))
    counts = parsed.selectExpr("count(1) AS records", "count_if(_is_bad) AS bad").first()
    bad = parsed.where("_is_bad").selectExpr(
        f"{SPLIT_FILE} AS file", f"{SPLIT_START} AS split_start", f"{RECORD} AS text"
    )
    bad.write.mode("overwrite").parquet(quarantine.folder)
    if counts["bad"] > quarantine.allowed * counts["records"]:
        raise ValueError(
            f"{counts['bad']} of {counts['records']} CSV records are bad, more than the share of "
            f"{quarantine.allowed} that is allowed; they are in {quarantine.folder}"
        )
    return parsed.where("NOT _is_bad").drop("_is_bad")


def read_csv(
    spark: SparkSession,
    path: str,
    multi_line: bool | None = None,
    quarantine: Quarantine | None = None,
) -> DataFrame:
    """All columns of a CSV with header as text; quotes inside quotes are doubled.

    Quoted cells may hold line breaks. A first scan of the lines (``broken_files``) tells
    which files have such cells: these are read in one task each, all others are
    split like any text. ``multi_line`` spares that scan: ``True`` reads every file in one
    task, ``False`` says that no cell holds a line break; a record that one cuts then fails.

    A record with more cells than the header, or cut by the end of its line, fails the job; a
    quote that is still open at the end of a file read whole ends there. With a ``quarantine`` such records go to its folder (``file, split_start, text``; replaced by
    every read), and the job fails only if more than the allowed share of all records
    is bad. A file of a folder with another header than the first fails. Records
    with fewer cells end in nulls.
    """
    return scan_csv(spark, path, multi_line, quarantine).drop(RECORD, SPLIT_FILE, SPLIT_START)


def split_shifts(splits: DataFrame) -> DataFrame:
    """``of_split, shift`` from one row per split: what turns running numbers into positions.

    ``splits`` has ``split_id, split_file, split_start, size, first_place``. The rows before a
    split, in order of file name and place in the file, are a sum in ranges, so
    files without number are no task's burden.
    """
    before = running_total(splits, ["split_file", "split_start"], "size", "before")
    return before.selectExpr("split_id AS of_split", "before - first_place AS shift")


def with_row_positions(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Number the rows of a file scan from 0, in order of file name and place in the file.

    The scan runs once: its rows are stored with the split they came from and their
    running number in it, so what follows cannot see other splits than the rows did. The
    rows before a split are summed from that copy (``split_shifts``) and come back to the
    rows by a number for the split. A row without it would fail. Records in quarantine
    have no position.
    """
    known = SPLIT_FILE in df.columns
    file, start = (SPLIT_FILE, SPLIT_START) if known else ("_metadata.file_path", "_metadata.file_block_start")
    columns = [c for c in df.columns if c not in (RECORD, SPLIT_FILE, SPLIT_START)]
    rows = stage(
        df.selectExpr(
            *[f"`{c}`" for c in columns],
            f"{file} AS split_file",
            f"{start} AS split_start",
            f"xxhash64({file}, {start}) AS split_id",
            "monotonically_increasing_id() AS place",
        )
    )
    # places rise with the tasks' numbers; a split is within one task, so its rows differ by less
    splits = stage(
        rows.groupBy("split_id", "split_file", "split_start").agg(
            F.expr("count(1) AS size"), F.expr("min(place) AS first_place")
        )
    )
    if not splits.groupBy("split_id").count().where("count > 1").isEmpty():
        raise ValueError("two splits share a number")
    shifts = stage(split_shifts(splits))
    return rows.join(shifts, F.expr("split_id = of_split"), "left").selectExpr(
        f"IF(shift IS NULL, raise_error('a split without position'), place + shift) AS {name}",
        *[f"`{c}`" for c in columns],
    )


def read_records(
    spark: SparkSession,
    path: str,
    multi_line: bool | None = None,
    quarantine: Quarantine | None = None,
) -> DataFrame:
    """A raw table for the quality checks: text columns and ``row_id``, the row's position."""
    return missing_to_null(with_row_positions(scan_csv(spark, path, multi_line, quarantine)))


def read_tickets(
    spark: SparkSession,
    path: str,
    multi_line: bool | None = None,
    quarantine: Quarantine | None = None,
) -> DataFrame:
    """Raw tickets; a target that is not a number is null."""
    tickets = missing_to_null(read_csv(spark, path, multi_line, quarantine))
    return tickets.withColumn("sla_target_hours", F.expr("try_cast(sla_target_hours AS DOUBLE)"))
