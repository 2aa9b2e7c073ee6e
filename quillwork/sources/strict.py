"""Strict CSV and JSONL scans, and header rules (SRC-4 to SRC-12, SRC-15, K-10)."""

from __future__ import annotations

import csv
import gzip
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.operators.contracts import ContractError
from quillwork.operators.scoring import strict_json

#: SRC-7: the longest field, in characters; a longer one is an error, never cut.
MAX_FIELD = 67_108_864


def header(spark: SparkSession, path: str) -> list[str]:
    """The names of a CSV's first record, read through Spark's file system; missing, blank or repeated ones are errors."""
    files = spark.read.format("binaryFile").load(path).select("path").orderBy("path").limit(1).collect()
    if not files:
        raise ContractError(f"no file in {path}")
    stream_path = spark._jvm.org.apache.hadoop.fs.Path(files[0].path)
    stream = stream_path.getFileSystem(spark._jsc.hadoopConfiguration()).open(stream_path)
    try:
        data = bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, 1 << 20)))
    finally:
        stream.close()
    if files[0].path.endswith(".gz"):
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as unpacked:
            data = unpacked.read1(1 << 20)
    text = data.decode("utf-8-sig", "ignore")
    names = next(csv.reader(io.StringIO(text)), [])
    blank = [n for n in names if not n.strip()]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if not names or blank or repeated:
        raise ContractError(f"bad header: {len(blank)} blank, repeated {repeated}")
    return names


def read_csv(spark: SparkSession, path: str, required: list[str] | None = None, exact: list[str] | None = None) -> DataFrame:
    """SRC-5 to SRC-8: all columns as text, '' for blank cells; a row of another length or too long a field is an error.

    The header is checked first, as Spark renames repeated names and drops surplus cells. gzip by suffix; a byte order
    mark is skipped; fields may hold line breaks.
    """
    names = header(spark, path)
    if exact is not None and names != exact:
        raise ContractError(f"the header differs: {names}")
    if missing := sorted(set(required or []) - set(names)):
        raise ContractError(f"columns are missing: {missing}")
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", False)
    df = read.option("maxCharsPerColumn", MAX_FIELD).option("emptyValue", "").option("nullValue", "\0").schema(schema).csv(path)
    return df.fillna("")


def resolve_aliases(names: list[str], aliases: dict[str, list[str]], required: list[str]) -> dict[str, str]:
    """SRC-9: column of each known name: the first alias that a header has, whatever its case."""
    lower = {n.lower().strip(): n for n in reversed(names)}
    found = {}
    for name, options in aliases.items():
        column = next((lower[o.lower()] for o in options if o.lower() in lower), None)
        if column is not None:
            found[name] = column
    if missing := [n for n in required if n not in found]:
        raise ContractError(f"no column for {missing}")
    return found


def select_aliases(df: DataFrame, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    found = resolve_aliases(df.columns, aliases, required)
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in found.items()])


def layout(names: list[str], layouts: dict[str, list[str]]) -> str:
    """SRC-15: the name of the fixed layout that a header is."""
    found = [k for k, columns in layouts.items() if columns == names]
    if len(found) != 1:
        raise ContractError(f"the header is none of {sorted(layouts)}")
    return found[0]


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC-10: one JSON object a line, blank lines skipped; repeated keys, NaN, overflow or text around it are errors."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    canonical = strict_json(F.col("value"))
    checked = F.coalesce(canonical, F.raise_error(F.concat(F.lit("not strict JSON: "), F.substring("value", 1, 80))))
    return lines.select(F.from_json(checked, schema).alias("row")).select("row.*")


def read_json(path: str) -> dict:
    """SRC-11: a small JSON document of the driver's."""
    with open(path, encoding="utf-8-sig") as f:
        return json.load(f)


def id_filter(df: DataFrame, key: str = "event_id", column: str | None = None, equals: str | None = None) -> DataFrame:
    """SRC-12: the distinct ids of rows whose column is truthy, or equals a value; of all rows without a column."""
    rows = df
    if column is not None:
        text = F.lower(F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))))
        rows = df.filter(F.col(column).cast("string") == equals if equals is not None else text.isin("1", "true", "t", "yes", "y"))
    return rows.select(key).distinct()


def guard_header(columns: list[str], public: list[str], private: list[str]) -> None:
    """K-10: refuses a public table whose columns aren't the public list, or that has a private one."""
    if columns != public or (leaked := sorted(set(columns) & set(private))):
        raise ContractError(f"columns are not the public ones: {columns if columns != public else leaked}")
