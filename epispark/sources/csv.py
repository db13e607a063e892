"""Delimited case files.

The header decides the delimiter and the projected columns; this is the
only driver-side read (one record).  Rows are read in parallel as lines.
A quoted field may hold line breaks and separators: where a file has such
breaks, its lines are first joined to records (``records``).  A record with
*more* fields than the header is dropped by counting its separators outside
quotes, before and independently of any projection, and the rest is parsed
as strings (short rows are padded with NULLs).

A quote opens a field only at its start, elsewhere it is text, in the header
as in the rows; a field that goes on after its closing quote is text as it
stands.
"""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import params as P
from ..session import scratch_path

MOST_PLACES = 1_000_000  # lines of broken records that are broadcast, some 60 MB


def delimiter_frame(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """S1 as a 1-row frame: ';' iff the first line has more ';' than ','."""
    first = spark.read.option("encoding", encoding).text(path).limit(1)
    semi, comma = F.regexp_count("value", F.lit(";")), F.regexp_count("value", F.lit(","))
    return first.select(F.when(semi > comma, F.lit(";")).otherwise(F.lit(",")).alias("delimiter"),
                        semi.alias("semicolons"), comma.alias("commas"))


def detect_delimiter(spark: SparkSession, path: str, default: str = ";", encoding: str = "UTF-8") -> str:
    """The separator of a file; ``default`` when it cannot be read."""
    try:
        rows = delimiter_frame(spark, path, encoding).take(1)
    except Exception:  # noqa: BLE001 - unreadable or missing file
        return default
    return rows[0]["delimiter"] if rows else default


def _decoded(lines: DataFrame, encoding: str) -> DataFrame:
    return lines if encoding.upper() in ("UTF-8", "UTF8") else lines.withColumn("value", F.decode(F.col("value").cast("binary"), encoding))


def _literal(sep: str) -> str:
    """``sep`` inside a regular expression."""
    return "".join("\\" + c if not c.isalnum() else c for c in sep)


def _closed(sep: str) -> str:
    """A whole quoted field at its start; possessive, so that a long field
    needs no stack."""
    return f'(^|{_literal(sep)})"[^"]*+(?:""[^"]*+)*+"'


def separators(line: Column, sep: str) -> Column:
    """Number of separators outside quoted fields."""
    bare = F.when(F.contains(line, F.lit('"')), F.regexp_replace(line, _closed(sep), "$1")).otherwise(line)
    return F.floor((F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit("")))) / len(sep)).cast("int")


def _opens(text: Column, sep: str) -> Column:
    """Whether a text that starts outside quotes ends inside a quoted field."""
    bare = F.regexp_replace(text, _closed(sep), "$1")
    return F.contains(text, F.lit('"')) & F.regexp_like(bare, F.lit(f'(^|{_literal(sep)})"'))


def _still_open(text: Column, sep: str) -> Column:
    """Whether a text that starts inside a quoted field ends inside one: the
    field goes on, or it is closed and another one opens."""
    rest = F.regexp_replace(text, r'^[^"]*+(?:""[^"]*+)*+"', "x")  # what follows a closing quote is in mid-field
    closes = F.regexp_like(text, F.lit(r'^[^"]*+(?:""[^"]*+)*+"'))
    return ~closes | _opens(rest, sep)


def _after(order: Window, start: Column) -> Column:
    """State (1 in quotes, 0 not) after each row of ``order``: a row that ends
    in one state whatever its start settles it (``_settled``), the others turn
    it over or not (``_turn``)."""
    turns = F.sum("_turn").over(order)
    base = F.last(F.when(F.col("_settled").isNotNull(), F.col("_settled").bitwiseXOR((turns % 2).cast("int"))), ignorenulls=True).over(order)
    return F.coalesce(base, start).bitwiseXOR((turns % 2).cast("int"))


def _few(spark: SparkSession, places: DataFrame) -> DataFrame:
    """``places`` written and read back, so that their number is known before
    the lines meet them; marked for broadcast if there are few."""
    path = scratch_path(spark, "record_places")
    places.write.parquet(path)
    written = spark.read.schema(places.schema).parquet(path)
    return F.broadcast(written) if written.count() <= MOST_PLACES else written


def records(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> DataFrame:
    """The records of delimited files, one row each (``value``): lines, or
    lines joined by ``\\n`` where a break lies inside a quoted field.

    One pass over the lines tells whether any line leaves a quoted field open;
    if none does, the lines are the records.  Otherwise every line with a
    quote is a map from the quote state before it to the state after it.  The
    maps compose within each split of a file, then over its splits (one row a
    split), which gives every split its start state and every line its own.
    Opening and closing lines then bound the records of several lines; only
    their lines are gathered, all others pass as they are, without a shuffle
    of text: the places of those lines are written, and with at most
    ``MOST_PLACES`` of them every task gets them all (beyond that the joins
    are the planner's).  A line is known by file, split and place in the scan.

    A quote that is still open at the end of a file opens nothing: the lines
    from there on are records of their own.  Blank lines inside quotes belong
    to the record; a ``\\r\\n`` inside them comes out as ``\\n``.
    """
    place = ["_file", "_block", "_at"]
    lines = _decoded(spark.read.text(path).select(
        "value", F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at")), encoding)
    quoted = lines.where(F.contains("value", F.lit('"')))
    if quoted.where(_opens(F.col("value"), sep)).isEmpty():
        return lines.select("value")
    out, inside = F.col("_out"), F.col("_in")
    events = quoted.select(*place, _opens(F.col("value"), sep).cast("int").alias("_out"), _still_open(F.col("value"), sep).cast("int").alias("_in")).select(
        *place, F.when(out == inside, out).alias("_settled"), (out > inside).cast("int").alias("_turn")).where("_settled is not null or _turn = 1")
    in_file, in_block = Window.partitionBy("_file").orderBy("_block"), Window.partitionBy("_file", "_block").orderBy("_at")
    whole = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)

    # Every split's own map is the state its last line leads to from either
    # start; over the splits of a file the maps give the start states.
    ends = events.select("*", _after(in_block, F.lit(0)).alias("_e0"), _after(in_block, F.lit(1)).alias("_e1"))
    maps = ends.groupBy("_file", "_block").agg(F.max_by(F.struct("_e0", "_e1"), "_at").alias("e")).select(
        "_file", "_block", F.when(F.col("e._e0") == F.col("e._e1"), F.col("e._e0")).alias("_settled"), (F.col("e._e0") > F.col("e._e1")).cast("int").alias("_turn"))
    splits = lines.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.max("_at").alias("_last")).join(maps, ["_file", "_block"], "left")
    splits = splits.withColumn("_turn", F.coalesce("_turn", F.lit(0))).withColumn("_end", _after(in_file, F.lit(0)))
    splits = splits.withColumn("_start", F.coalesce(F.lag("_end").over(in_file), F.lit(0)))

    # Lines that open a record of several lines, and those that close one.
    state = ends.join(splits.select("_file", "_block", "_start"), ["_file", "_block"]).withColumn(
        "_after", F.when(F.col("_start") == 0, F.col("_e0")).otherwise(F.col("_e1")))
    state = state.withColumn("_before", F.coalesce(F.lag("_after").over(in_block), F.col("_start"))).where("_before <> _after")
    bounds = state.withColumn("_close", F.lead("_at").over(in_block))
    opened = bounds.where("_after = 1")
    within = opened.where("_close is not null").select(*place[:2], F.struct("_block", "_at").alias("_record"), F.explode(F.sequence("_at", "_close")).alias("_at"))
    # Records that go on over splits: the open end of one, whole splits, the first close.
    tails = opened.where("_close is null").select("_file", "_block", F.col("_at").alias("_tail"))
    heads = state.groupBy("_file", "_block").agg(F.min(F.when(F.col("_start") == 1, F.col("_at"))).alias("_head"))
    across = splits.join(tails, ["_file", "_block"], "left").join(heads, ["_file", "_block"], "left").select(
        "*", F.last(F.when(F.col("_tail").isNotNull(), F.struct("_block", F.col("_tail").alias("_at"))), ignorenulls=True).over(earlier).alias("_owner"),
        F.last(F.when(F.col("_tail").isNotNull(), F.struct("_block", F.col("_tail").alias("_at"))), ignorenulls=True).over(whole).alias("_latest"),
        F.last("_end").over(whole).alias("_left_open"))
    parts = F.array(F.when(F.col("_start") == 1, F.struct(F.col("_owner").alias("r"), F.col("_first").alias("a"), F.coalesce("_head", "_last").alias("b"))),
                    F.when(F.col("_tail").isNotNull(), F.struct(F.struct("_block", F.col("_tail").alias("_at")).alias("r"), F.col("_tail").alias("a"), F.col("_last").alias("b"))))
    over = across.select("_file", "_block", "_latest", "_left_open", F.explode(parts).alias("p")).where(
        "p is not null and not (_left_open = 1 and p.r = _latest)").select("_file", "_block", F.col("p.r").alias("_record"), F.explode(F.sequence("p.a", "p.b")).alias("_at"))
    members = _few(spark, within.unionByName(over))
    single = lines.join(members.select(*place), place, "left_anti").select("value")
    joined = lines.join(members, place).groupBy("_file", "_record").agg(F.array_sort(F.collect_list(F.struct("_block", "_at", "value"))).alias("l"))
    return single.unionByName(joined.select(F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("value")))


def _first_record(spark: SparkSession, path: str, sep: str, encoding: str) -> tuple[str, list[str]] | None:
    """Text and fields of the first record that is not blank: of the first
    lines, as many as it holds."""
    lines, n = _decoded(spark.read.text(path), encoding), 16
    while True:
        top = [r[0] for r in lines.take(n)]
        start = next((i for i, line in enumerate(top) if line), None)
        if start is not None:
            reader = csv.reader((line + "\n" for line in top[start:]), delimiter=sep)
            fields = next(reader)
            if start + reader.line_num < n or len(top) < n:
                text = "\n".join(top[start:start + reader.line_num])
                if len(top) < n and start + reader.line_num == len(top) and reader.line_num > 1 and fields[-1].endswith("\n"):
                    text, fields = top[start], next(csv.reader([top[start]], delimiter=sep))  # never closed: one line
                return text.rstrip("\n"), [f.rstrip("\n") for f in fields]
        elif len(top) < n:
            return None
        n *= 8


def _split(record: str, names: Sequence[str], sep: str) -> Column:
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in names)
    return F.from_csv(record, F.lit(schema), {"sep": sep, "mode": "PERMISSIVE", "quote": '"', "escape": '"', "maxCharsPerColumn": "-1"})


def _names(fields: Sequence[str]) -> list[str]:
    """Column names: an unnamed field is ``_c`` and its place, a repeated name
    gets its place after it."""
    names: list[str] = []
    for i, name in enumerate(f.lstrip("\ufeff").strip() for f in fields):
        names.append(f"_c{i}" if not name else f"{name}{i}" if name in names else name)
    return names


def header_columns(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> list[str]:
    """The fields of the first record, as column names."""
    first = _first_record(spark, path, sep, encoding)
    return _names(first[1]) if first else []


def project_header(columns: Sequence[str], wanted: Sequence[str] = P.ESSENTIAL_COLUMNS) -> list[str]:
    """Wanted columns that exist (in wanted order); none found -> all."""
    keep = [c for c in wanted if c in set(columns)]
    return keep or list(columns)


def scan_csv(spark: SparkSession, path: str, sep: str | None = None, columns: Sequence[str] | None = None,
             encoding: str = "UTF-8", project: Sequence[str] | None = None) -> DataFrame:
    """S3: all-string scan; drops records with more fields than the header,
    also where the surplus field is empty.  Which rows stay does not depend on
    the columns that are read afterwards.

    A record equal to the header is a header (of any file of the folder);
    empty lines are skipped; a doubled quote inside quotes is a quote; quoted
    fields may hold separators and line breaks, in the header too.
    ``project`` (e.g. the essential list) keeps only those columns that exist.
    """
    sep = sep or detect_delimiter(spark, path, encoding=encoding)
    first = _first_record(spark, path, sep, encoding)
    header = list(columns or (_names(first[1]) if first else []))
    if not header:
        return spark.createDataFrame([], "value string").select()
    found = records(spark, path, sep, encoding)
    kept = found.where((F.col("value") != "") & (separators(F.col("value"), sep) < len(header)))
    if first and _names(first[1]) == _names(header):
        kept = kept.where(F.col("value") != first[0])
    keep = project_header(header, project) if project is not None else header
    return kept.select(_split("value", header, sep).alias("r")).select(*[F.col("r").getField(c).alias(c) for c in keep])
