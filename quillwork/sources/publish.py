"""Publication: staged, counted, hashed, renamed once (K-1 to K-5, K-8, K-9, K-11 to K-13, R-1, R-2, R-5, R-14)."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.text import clean
from quillwork.operators.contracts import ContractError


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def clean_cells(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """K-1, K-2: white space of every text cell collapsed, but for columns whose line breaks mean something."""
    return df.select(*[clean(F.col(c)).alias(c) if t == "string" and c not in keep else F.col(c) for c, t in df.dtypes])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """R-1, R-2: file, length and SHA-256 of every data file below a path, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(~name.startswith("_") & ~name.startswith(".")).select(name.alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def publish(df: DataFrame, path: str, fmt: str = "parquet", receipt: dict | None = None, **options) -> dict:
    """K-5: writes to a new folder beside ``path``, reads it back, and renames it once. An existing path or another
    writer's lock is refused; a failure leaves neither the path nor the stage. The receipt is in _RECEIPT.json.
    """
    spark = df.sparkSession
    fs, target = _fs(spark, path)
    _, lock = _fs(spark, path.rstrip("/") + ".lock")
    stage_path = f"{path.rstrip('/')}.stage-{uuid.uuid4().hex}"
    _, stage = _fs(spark, stage_path)
    if fs.exists(target):
        raise ContractError(f"{path} exists")
    if not fs.createNewFile(lock):
        raise ContractError(f"{path} is being written")
    try:
        df.write.format(fmt).options(**options).save(stage_path)
        rows = spark.read.format(fmt).options(**options).schema(df.schema).load(stage_path).count()
        files = [r.asDict() for r in manifest(spark, stage_path).orderBy("file").collect()]  # a row for each written file
        told = {"rows": rows, "columns": df.columns, "files": files} | (receipt or {})
        write_text(spark, f"{stage_path}/_RECEIPT.json", json.dumps(told, sort_keys=True))
        if fs.exists(target) or not fs.rename(stage, target):
            raise ContractError(f"{path} exists")
        return told
    finally:
        fs.delete(stage, True)
        fs.delete(lock, False)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """K-4: replaces a small file: written beside it, then renamed over it."""
    fs, target = _fs(spark, path)
    _, part = _fs(spark, f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    out.write(text.encode())
    out.close()
    if fs.exists(target):
        fs.delete(target, False)
    fs.rename(part, target)


def read_text(spark: SparkSession, path: str) -> str:
    fs, source = _fs(spark, path)
    stream = fs.open(source)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def verify(spark: SparkSession, path: str) -> dict:
    """R-2, R-14: the receipt of a published path, after its files' names, lengths and hashes were compared with it."""
    told = json.loads(read_text(spark, f"{path}/_RECEIPT.json"))
    found = [r.asDict() for r in manifest(spark, path).orderBy("file").collect()]
    if found != told["files"]:
        raise ContractError(f"{path} differs from its receipt")
    return told


def point_latest(spark: SparkSession, root: str, name: str) -> None:
    """K-8: names the latest published folder in _LATEST, once it has its receipt."""
    verify(spark, f"{root}/{name}")
    write_text(spark, f"{root}/_LATEST", name)


def latest(spark: SparkSession, root: str) -> str:
    return f"{root}/{read_text(spark, f'{root}/_LATEST').strip()}"


def split_blinded(df: DataFrame, public: list[str], private: list[str], key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """K-13: a public and a private table that share an audit id, the place in a hash order that tells nothing."""
    numbered = df.withColumn("audit_id", F.substring(F.sha2(F.concat_ws("|", F.lit(order), F.col(key).cast("string")), 256), 1, 16))
    return numbered.select("audit_id", *public), numbered.select("audit_id", key, *private)


def report(title: str, sections: dict[str, DataFrame], rows: int = 200) -> str:
    """K-11, K-12: Markdown tables of small aggregates; a table of over ``rows`` rows is refused, not cut."""
    lines = [f"# {title}"]
    for name, df in sections.items():
        found = df.limit(rows + 1).collect()
        if len(found) > rows:
            raise ContractError(f"{name} has over {rows} rows")
        lines += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found]
    return "\n".join(lines) + "\n"
