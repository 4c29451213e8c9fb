"""Table and file readers; filters and column choices stay in the plan so that they reach the scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dayspan.operators.select import subset_ids
from dayspan.sources.headers import clean_names, drop_columns

FORMATS = ("csv", "parquet", "json")


def format_of(path: str) -> str:
    """File format from the text after the last dot."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending not in FORMATS:
        raise ValueError(f"file must be one of the following: {', '.join(FORMATS)}")
    return ending


def read_file(spark: SparkSession, path: str | Sequence[str], fmt: str | None = None,
              schema: StructType | str | None = None, multi_line: bool = False, infer: bool = False) -> DataFrame:
    """Read files of one format. In CSV files "NA" and empty cells are null; without a schema all is text.

    ``infer`` types the text columns by their values (see ``typed_columns``). ``multi_line`` allows line breaks inside quoted CSV cells, at the price that a
    file can no longer be split between tasks.
    """
    paths = [path] if isinstance(path, str) else list(path)
    fmt = fmt or format_of(paths[0])
    if fmt not in FORMATS:
        raise ValueError(f"file must be one of the following: {', '.join(FORMATS)}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(header=True, nullValue="NA", multiLine=multi_line, escape='"')
    df = reader.load(paths)
    return typed_columns(df) if infer and schema is None else df


# Types that a text column may take, the narrowest first, and what a value must look like beyond being castable.
_TYPES = (("bigint", r"^[+-]?\d+$"), ("double", r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), ("date", r"^\d{4}-\d{1,2}-\d{1,2}$"),
          ("timestamp_ntz", r"^\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{2}"), ("boolean", r"(?i)^(true|false|t|f)$"))


def typed_columns(df: DataFrame) -> DataFrame:
    """Text columns cast to the first type that every value of theirs has; a column without values stays text.

    One aggregate over all rows decides, with a flag per column and type, so no value is judged by a sample. Numbers with
    leading zeros stay text, as they are codes.
    """
    places = [i for i, (_, kind) in enumerate(df.dtypes) if kind == "string"]
    if not places:
        return df
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    checks = []
    for i in places:
        value = F.trim(f"c{i}")
        given = value.isNotNull() & (value != "")
        for kind, pattern in _TYPES:
            fits = value.rlike(pattern) & value.try_cast(kind).isNotNull()
            if kind in ("bigint", "double"):
                fits &= ~value.rlike(r"^[+-]?0\d")
            checks.append(F.bool_and(F.when(given, fits)).alias(f"{kind}_{i}"))
    found = numbered.agg(*checks).first()
    shown = []
    for i, name in enumerate(df.columns):
        kind = next((k for k, _ in _TYPES if i in places and found[f"{k}_{i}"]), None)
        value = F.col(f"c{i}")
        shown.append((F.nullif(F.trim(value), F.lit("")).cast(kind) if kind else value).alias(name))
    return numbered.select(*shown)


def read_clean(spark: SparkSession, path: str, fmt: str | None = None, exclude_names: Sequence[str] = (),
               exclude_patterns: Sequence[str] = (), schema: StructType | str | None = None, infer: bool = False) -> DataFrame:
    """Read a file, drop columns by raw header, then clean the remaining names; ``infer`` types what is left."""
    kept = drop_columns(read_file(spark, path, fmt, schema), exclude_names, exclude_patterns)
    return clean_names(typed_columns(kept) if infer and schema is None else kept)


def read_many(spark: SparkSession, paths: Sequence[str], fmt: str | None = None,
              schema: StructType | str | None = None) -> DataFrame:
    """Append several files by column name; columns absent from one are null there."""
    if schema is not None:
        return read_file(spark, paths, fmt, schema)
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_file(spark, p, fmt) for p in paths]
    )


def read_table(spark: SparkSession, source: str, fmt: str | None = None, **options) -> DataFrame:
    """A catalog table, or with ``fmt`` (such as ``jdbc``) an external one."""
    if fmt is None:
        return spark.table(source)
    if fmt == "jdbc":
        return spark.read.format("jdbc").options(dbtable=source, **options).load()
    return spark.read.format(fmt).options(**options).load(source)


def pull_responses(df: DataFrame, id_map: Mapping[str, str], bad_ids: Sequence[str] = ("unknown", ""),
                   ids: DataFrame | range | Sequence | None = None, id_col: str = "id",
                   out: str = "record_id") -> DataFrame:
    """Responses with a usable id: drop bad and null ids, correct mistyped ones, keep the given participants."""
    value = F.col(id_col)
    corrected = value
    for old, new in id_map.items():
        corrected = F.when(value == old, new).otherwise(corrected)
    kept = df.filter(value.isNotNull() & ~value.isin(*bad_ids)).withColumn(out, corrected)
    if isinstance(ids, range):
        as_number = F.col(out).try_cast("bigint")
        return kept.filter(as_number.between(ids[0], ids[-1]))
    return kept if ids is None else subset_ids(kept, out, ids)
