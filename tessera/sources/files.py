"""Sources and sinks: Markdown folders, JSON lines, CSV, run partitions, audited writes, content hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FRONT = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def _path(spark: SparkSession, path: str):
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    found, system = _path(spark, path)
    return system.exists(found)


def markdown(spark: SparkSession, folder: str, metadata_keys: Sequence[str] = ("title", "doi", "authors", "year", "journal")) -> DataFrame:
    """(document_id, path, raw_text, metadata, text) by Markdown file; the id is the file's name without its suffix.

    A block between lines of dashes at the top is metadata if it has one of the keys; otherwise it belongs to the text.
    """
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.col("value").alias("raw_text"), F.input_file_name().alias("path"))
    block = F.regexp_extract("raw_text", _FRONT, 1)
    known = block.rlike(rf"(?im)^\s*(?:{'|'.join(metadata_keys)})\s*:")
    name = F.regexp_extract(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), r"([^/]+)\.md$", 1)
    return files.select(name.alias("document_id"), "path", "raw_text", F.when(known, block).alias("metadata"), F.when(known, F.regexp_replace("raw_text", _FRONT, "")).otherwise(F.col("raw_text")).alias("text"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str | None = None, missing_ok: bool = True) -> DataFrame:
    """JSON lines; a malformed line is an error. A path that is not there gives no rows, if the schema is known."""
    if not exists(spark, path):
        if not missing_ok or schema is None:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def tolerant_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole JSON documents; what cannot be read is a row of nulls with its text in _corrupt_record."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(f"{schema}, _corrupt_record string").json(path)


def canonical_lines(df: DataFrame) -> DataFrame:
    """(value): each row as JSON with its keys in order and nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    canonical_lines(df).write.mode("overwrite").text(path)


def union_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all frames, with the sorted union of their columns."""
    frames = list(frames)
    found = frames[0]
    for f in frames[1:]:
        found = found.unionByName(f, allowMissingColumns=True)
    return found.select(*sorted(found.columns))


def write_csv(df: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """CSV with a header, by default all columns in order of name; nested values as JSON."""
    columns = columns or sorted(df.columns)
    kinds = {f.name: f.dataType for f in df.schema}
    nested = (T.ArrayType, T.MapType, T.StructType)
    cells = [(F.to_json(c) if isinstance(kinds[c], nested) else F.col(c)).alias(c) for c in columns]
    df.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, all columns strings."""
    return spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)


def write_run(df: DataFrame, base: str, run: str, method: str) -> None:
    """Records of one method in one run, as a partition of its own that replaces an earlier one."""
    df.drop("run_name", "method_name").write.mode("overwrite").json(f"{base}/run_name={run}/method_name={method}")


def read_run(spark: SparkSession, base: str, run: str, method: str | None = None) -> DataFrame:
    """Records of a run, of one method or of all; other partitions are not read."""
    found = spark.read.json(base).where(F.col("run_name") == run)
    return found if method is None else found.where(F.col("method_name") == method)


def methods_of_run(spark: SparkSession, base: str, run: str) -> list[str]:
    return sorted(r[0] for r in spark.read.json(base).where(F.col("run_name") == run).select("method_name").distinct().collect())


def install(df: DataFrame, path: str, problems: Callable[[DataFrame], DataFrame]) -> int:
    """Write, audit, publish: the rows go to a staging folder and take the path only if `problems` of them is empty. Returns their number.

    An existing path is never overwritten.
    """
    spark = df.sparkSession
    if exists(spark, path):
        raise FileExistsError(path)
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    written = spark.read.parquet(staged)
    found = problems(written).take(5)
    source, system = _path(spark, staged)
    if found:
        system.delete(source, True)
        raise ValueError(f"not installed: {[r.asDict() for r in found]}")
    system.rename(source, _path(spark, path)[0])
    return spark.read.parquet(path).count()


def content_hash(df: DataFrame, volatile: Sequence[str] = ("run_name", "created_at")) -> str:
    """SHA-256 of the rows' contents without volatile columns, whatever their order and partitions.

    Each row is hashed where it is; the digest is over how many rows there are and the sums of four parts of the hashes,
    so that nothing is sorted or gathered.
    """
    lines = canonical_lines(df.drop(*volatile)).select(F.sha2("value", 256).alias("h"))
    parts = [F.sum(F.conv(F.substr("h", F.lit(16 * k + 1), F.lit(15)), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    whole = lines.agg(F.sha2(F.concat_ws("|", F.count("*").cast("string"), *(F.coalesce(p, F.lit("0")) for p in parts)), 256))
    return whole.first()[0]


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """(name, sha256, bytes) of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = _path(spark, folder)[1].makeQualified(_path(spark, folder)[0]).toString()
    return files.select(F.replace("path", F.lit(root.rstrip("/") + "/")).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def dealt(df: DataFrame) -> DataFrame:
    """`df` over as many partitions as the session has cores, if it is read in fewer: else a file of one block is one task's work, however many texts it holds."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def cut(df: DataFrame) -> DataFrame:
    """`df`, written to the folder that spark.checkpoint.dir names."""
    context = df.sparkSession.sparkContext
    if not df.sparkSession.conf.get("spark.checkpoint.dir", None) and not context.getCheckpointDir():
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()
