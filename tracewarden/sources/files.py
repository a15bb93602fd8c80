"""File sources and sinks: CSV, JSON lines, Parquet splits, predictions, file digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"


# --- CSV ---------------------------------------------------------------------------------------
def probe_csv_schema(spark: SparkSession, path: str) -> T.StructType:
    """Infer types once from the whole file, to be frozen and passed to every later read."""
    return spark.read.csv(path, header=True, inferSchema=True).schema


def csv_header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True, enforceSchema=False).columns


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the frozen types. A cell that does not fit its type fails the job instead of becoming null."""
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def read_csv_with_rejects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects): a reject keeps its text as ``line``, its ``file`` and ``line_number``, beside the cells that could be read.

    Cells go by the names of the header, in whatever order it has them. Files whose header is not the
    same, or does not name exactly the columns of ``schema``, are refused. A record is one line; the header is line 1.
    """
    from .capture import capture_order

    lines = capture_order(spark.read.text(path), "_at", file="_path")
    heads = lines.groupBy("_path").agg(F.min("_at").alias("_first"), F.min_by("value", "_at").alias("_head"))
    told = heads.select("_head").distinct().limit(2).collect()
    names = [] if len(told) != 1 else [c.strip().strip('"') for c in told[0]["_head"].removeprefix("\ufeff").split(",")]
    if sorted(names) != sorted(schema.fieldNames()):
        raise ValueError(f"headers {[r['_head'] for r in told]} do not name the columns {schema.fieldNames()}")
    wide = T.StructType([*(schema[n] for n in names), T.StructField(CORRUPT, T.StringType())])
    body = lines.join(heads.select("_path", "_first"), "_path").where("_at > _first and length(value) > 0")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    rows = body.withColumn("_r", F.from_csv("value", wide.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options))
    bad, cells = F.col(f"_r.{CORRUPT}").isNotNull(), [F.col("_r")[n].alias(n) for n in schema.fieldNames()]
    where = [F.col("value").alias("line"), F.col("_path").alias("file"), (F.col("_at") - F.col("_first") + 1).alias("line_number")]
    return rows.where(~bad).select(*cells), rows.where(bad).select(*where, *cells)


def write_csv_report(df: DataFrame, path: str) -> None:
    """One CSV file, for reports that are small by construction."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


# --- JSON lines --------------------------------------------------------------------------------
def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects). Blank lines are skipped; a reject keeps its text and file."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select("value", F.col("_metadata.file_path").alias("_file"))
    parsed = lines.withColumn("r", F.from_json("value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    bad = F.col(f"r.{CORRUPT}").isNotNull() | F.col("r").isNull()
    return (
        parsed.where(~bad).select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]),
        parsed.where(bad).select(F.col("value").alias("line"), F.col("_file").alias("file")),
    )


def require_stream(rows: DataFrame, rejects: DataFrame, key: str = "event_id") -> None:
    """Refuse an alert stream that is empty, malformed or repeats an id."""
    bad = rejects.limit(3).collect()
    if bad:
        raise ValueError(f"invalid JSON, for example {[(r['file'], r['line'][:80]) for r in bad]}")
    if rows.isEmpty():
        raise ValueError("empty alert stream")
    twice = rows.groupBy(key).count().where("count > 1").limit(3).collect()
    if twice:
        raise ValueError(f"duplicate ids, for example {[r[key] for r in twice]}")


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Compact JSON lines, nulls written out."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


# --- Parquet -----------------------------------------------------------------------------------
def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One dataset partitioned by split, so that a reader of one split opens only its files."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def read_split(spark: SparkSession, path: str, split: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split).select(*columns)


def write_predictions(df: DataFrame, path: str) -> None:
    """(model, row_id, y_true, y_pred, prob), partitioned by model."""
    df.select("model", "row_id", "y_true", "y_pred", "prob").write.mode("append").partitionBy("model").parquet(path)


def read_predictions(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.where(F.col("model").isin(*models)) if models else df


def flatten_probabilities(df: DataFrame, labels: list[str], prob: str = "prob") -> DataFrame:
    """Scored rows for a CSV sink: one ``prob_<label>`` column per class."""
    kept = [c for c in df.columns if c != prob]
    return df.select(*kept, *[F.get(prob, F.lit(i)).alias(f"prob_{name}") for i, name in enumerate(labels)])


# --- digests -----------------------------------------------------------------------------------
def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, sha256) of files; one file's bytes must fit a task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def directory_digest(files: DataFrame, root: Column | None = None) -> DataFrame:
    """One digest over all file digests in path order. A folder of more than 100,000 files is refused."""
    name = root if root is not None else F.col("path")
    ordered = F.array_sort(F.collect_list(F.struct(name.alias("name"), "sha256")))
    few = files.where(F.when(files.agg(F.count("*")).scalar() <= 100_000, F.lit(True)).otherwise(F.raise_error(F.lit("too many files for one digest"))))
    return few.agg(F.sha2(F.array_join(F.transform(ordered, lambda f: f["sha256"]), ""), 256).alias("digest"))
