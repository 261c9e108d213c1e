"""Delimited-text series source: many files under a folder, matched by the names in their headers, with types
that hold for every value, and the file stem as an optional column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laglake.functions.timecols import strftime_to_spark
from laglake.operators.common import qc
from laglake.spec import DatasetSpec

CORRUPT = "__unreadable_line"
_DATE_LIKE = r"^\s*\d{4}-\d{1,2}-\d{1,2}"
#: Numbers as they are written: no leading zeros (those are codes), no type suffix.
_NUMBER = r"^\s*([+-]?(0|[1-9][0-9]*)?(\.[0-9]*)?([eE][+-]?[0-9]+)?|[+-]?(?i:nan|inf|infinity))\s*$"
#: Dates without a stated format: ISO (None), then the usual forms, day before month. A column takes the first that all its values have.
DATE_FORMS = (None, *[f"{d}[ HH:mm[:ss]]" for d in ("yyyy/M/d", "d/M/yyyy", "d.M.yyyy", "d-M-yyyy", "M/d/yyyy")])


def file_stem(col: str = "_metadata.file_name") -> F.Column:
    """Name before the last dot; all-digit stems are normalised as integers (``012`` -> ``12``),
    anything else (``12.5``, ``abc``) is kept as written."""
    stem = F.regexp_extract(F.col(col), r"^(.*)\.[^.]+$", 1)
    stem = F.when(stem == "", F.col(col)).otherwise(stem)
    return F.when(stem.rlike("^[0-9]+$"), stem.try_cast("bigint").cast("string")).otherwise(stem)


def _files(spark: SparkSession, spec: DatasetSpec):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{spec.extension}")


def _parsed_time(c: Column, spec: DatasetSpec, form: str | None = None) -> Column:
    if form:
        return F.try_to_timestamp(c, F.lit(form)).cast("timestamp_ntz")
    if spec.time_format:
        fmt = strftime_to_spark(spec.time_format) if "%" in spec.time_format else spec.time_format
        return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")
    return F.when(c.rlike(_DATE_LIKE), c.try_cast("timestamp_ntz"))


def header_groups(spark: SparkSession, spec: DatasetSpec) -> dict[tuple[str, bool], list[str]]:
    """(header line, whether a quoted field holds a line break) -> files. The first line of a file is the first row of the split at byte 0, a
    line break within quotes leaves a line with an odd number of quotes; both come from one aggregate. One row per file
    reaches the driver, as many as it lists anyway."""
    lines = _files(spark, spec).text(spec.path).select(
        F.col("_metadata.file_path").alias("file"), "value", F.col("_metadata.file_block_start").alias("at"))
    odd = F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1
    first = F.when(F.col("at") == 0, F.monotonically_increasing_id())
    found = (lines.withColumn("first", first).withColumn("odd", odd)
             .groupBy("file").agg(F.min_by("value", "first").alias("header"), F.max("odd").alias("broken")).collect())
    groups: dict[tuple[str, bool], list[str]] = {}
    for r in sorted(found, key=lambda r: r["file"]):
        groups.setdefault((r["header"] if spec.has_header else "", bool(r["broken"])), []).append(r["file"])
    return groups


def read_text_columns(spark: SparkSession, spec: DatasetSpec) -> DataFrame:
    """All files as string columns matched by header name, with ``CORRUPT`` holding lines whose number of fields differs
    from their header's. Files whose headers differ only in column order are one table; files with other columns raise. Files with
    line breaks inside of quotes are read whole, each by one task; all others are split."""
    groups = header_groups(spark, spec)
    if not groups:
        raise FileNotFoundError(f"no {spec.extension} file under {spec.path}")
    parts = []
    for (_, broken), files in groups.items():
        r = spark.read.option("header", spec.has_header).option("sep", spec.delimiter).option("multiLine", broken).option("escape", '"')
        names = r.csv(files).columns
        if not names:
            raise FileNotFoundError(f"no {spec.extension} file under {spec.path}")
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
        df = r.option("enforceSchema", "false" if spec.has_header else "true").option("columnNameOfCorruptRecord", CORRUPT).schema(schema).csv(files)
        if spec.file_name_as_feature:
            df = df.withColumn(spec.file_name_as_feature, file_stem())
        parts.append(df)
    out = parts[0]
    for p in parts[1:]:
        if set(p.columns) != set(out.columns):
            raise ValueError(f"files under {spec.path} have different columns: {sorted(set(p.columns) ^ set(out.columns))}")
        out = out.unionByName(p)
    return out


def _candidates(spec: DatasetSpec):
    """(type name, date form, conversion) from the narrowest on; text fits everything. A number counts only if it is written as one and
    the type keeps all its digits, so codes such as 007, words such as 1d, and large integers among decimals stay text."""
    plain = lambda c: F.trim(c).rlike(_NUMBER) & ~F.trim(c).isin("", "+", "-", ".")
    whole = lambda c: F.when(plain(c), c.try_cast("bigint"))
    kept = lambda c: whole(c).isNull() | (c.try_cast("double").cast("decimal(38,0)") == whole(c).cast("decimal(38,0)"))
    digits = lambda c: F.length(F.regexp_replace(F.regexp_extract(c, r"^[^eE]*", 0), r"[^0-9]", "")) <= 17
    times = [None] if spec.time_format else DATE_FORMS
    return [("bigint", None, lambda c: F.when(F.trim(c).rlike(r"^-?(0|[1-9][0-9]*)$"), c.try_cast("bigint"))),
            ("double", None, lambda c: F.when(plain(c) & F.coalesce(kept(c), F.lit(True)) & (whole(c).isNotNull() | digits(c)), c.try_cast("double"))),
            *[("timestamp_ntz", f, lambda c, f=f: _parsed_time(c, spec, f)) for f in times],
            ("boolean", None, lambda c: F.when(F.lower(c).isin("true", "false"), F.lower(c).try_cast("boolean")))]


def infer_types(df: DataFrame, spec: DatasetSpec, columns) -> dict[str, tuple[str, str | None]]:
    """The narrowest type that every value of a column has, and its date form, from one aggregate over all rows. Raises if a line
    doesn't have its header's number of fields."""
    kinds = _candidates(spec)
    aggs = [F.count(CORRUPT).alias("bad")]
    for i, c in enumerate(columns):
        aggs += [F.count(qc(c)).alias(f"n{i}"), *[F.count(f(qc(c))).alias(f"k{i}_{k}") for k, (_, _, f) in enumerate(kinds)]]
    r = df.agg(*aggs).first()
    if r["bad"]:
        raise ValueError(f"{r['bad']} lines under {spec.path} don't have their header's number of fields")
    out = {}
    for i, c in enumerate(columns):
        out[c] = next(((name, form) for k, (name, form, _) in enumerate(kinds) if r[f"n{i}"] and r[f"k{i}_{k}"] == r[f"n{i}"]), ("string", None))
    return out


def _converted(c: Column, kind: T.DataType, spec: DatasetSpec) -> Column:
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) and spec.time_format:
        return _parsed_time(c, spec).cast(kind)
    return c.try_cast(kind)


def read_series(spark: SparkSession, spec: DatasetSpec, schema=None, on_bad: str = "raise") -> DataFrame:
    """Read every ``*<extension>`` file below ``spec.path`` (recursively) into one DataFrame.

    Columns are matched by header name, whatever their order in a file. Without ``schema``, a column gets the
    narrowest of bigint, double, timestamp_ntz, boolean and string that all its values have, so no value is lost (see ``_candidates``);
    dates without a stated format are tried in the usual forms, day before month.
    With ``schema``, values that don't have the stated type, and lines of another number of fields, raise (counted in
    one pass) or, with ``on_bad='null'``, become NULL. Raises when no file matches."""
    text = read_text_columns(spark, spec)
    stem = spec.file_name_as_feature
    columns = [c for c in text.columns if c not in (CORRUPT, stem)]
    if schema is None:
        types = infer_types(text, spec, columns)
        kinds = {c: T._parse_datatype_string(t) if t != "timestamp_ntz" else T.TimestampNTZType() for c, (t, _) in types.items()}
        out = text.select(*[_parsed_time(qc(c), spec, types[c][1]).alias(c) if isinstance(kinds[c], T.TimestampNTZType) else _converted(qc(c), kinds[c], spec).alias(c)
                            for c in columns], *([qc(stem)] if stem else []))
        return out
    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    if not spec.has_header:
        text = text.toDF(*[schema.names[columns.index(c)] if c in columns else c for c in text.columns])
        columns = schema.names
    missing = [f.name for f in schema if f.name not in columns and f.name != stem]
    if missing:
        raise ValueError(f"no column {missing} in the files under {spec.path}")
    fields = [f for f in schema if f.name != stem]
    if on_bad == "raise":
        bad = text.agg(F.count(CORRUPT), *[F.count_if(qc(f.name).isNotNull() & _converted(qc(f.name), f.dataType, spec).isNull()) for f in fields]).first()
        if any(bad):
            raise ValueError(f"unreadable under {spec.path}: {bad[0]} lines, values by column "
                             f"{ {f.name: n for f, n in zip(fields, bad[1:], strict=True) if n} }")
    return text.select(*[_converted(qc(f.name), f.dataType, spec).alias(f.name) for f in fields], *([qc(stem)] if stem else []))


def write_series_csv(df: DataFrame, path: str, partition_cols=None, mode: str = "overwrite") -> str:
    """Write a series table as headed CSV (timestamps as ``yyyy-MM-dd HH:mm:ss``)."""
    w = (df.write.mode(mode).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
         .option("timestampFormat", "yyyy-MM-dd HH:mm:ss"))
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.csv(path)
    return path
