"""Files between the stages: JSON lines, CSV, vectors, gold questions, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from passagemill import schemas
from passagemill.functions import text as X


def read_json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """Records of a file of JSON lines; a bad line is an error, or skipped if ``tolerant``. A missing file is an error."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_sources_csv(docs: DataFrame, path: str, note: str = "") -> None:
    """One line per document, with its number of words."""
    rows = docs.select("source_id", "scheme_name", "category", "plan", "url", "fetched_at", "http_status", X.word_count(F.col("text")).alias("word_count"), F.lit(note).alias("notes"))
    rows.write.mode("overwrite").option("header", True).csv(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, embedding) of a folder; none if it isn't there, without the files of it that can't be read."""
    try:
        return spark.read.schema(schemas.VECTOR).option("ignoreCorruptFiles", True).parquet(path)
    except Exception:  # noqa: BLE001 - the reader raises different errors for what isn't there
        return spark.createDataFrame([], schemas.VECTOR)


def write_vectors(vectors: DataFrame, path: str) -> None:
    """Vectors with eight decimals."""
    rounded = F.transform("embedding", lambda x: F.round(x.cast("double"), 8).cast("float"))
    vectors.select("chunk_id", rounded.alias("embedding")).write.mode("overwrite").parquet(path)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Questions of a JSON file {questions: [...]}."""
    whole = spark.read.schema(f"questions array<struct<{schemas.GOLD.replace(' ', ':').replace(',:', ',')}>>").option("multiLine", True).json(path)
    return whole.select(F.explode("questions").alias("q")).select("q.*")


def _file_system(spark: SparkSession, path: str):
    """The path and the file system that holds it, whatever its kind."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _file_system(spark, path)
    return fs.exists(where)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table beside the one at ``path`` and put it in its place, so that a failed write loses nothing."""
    spark = df.sparkSession
    target, fs = _file_system(spark, path)
    beside, old = (_file_system(spark, path + x)[0] for x in ("._new", "._old"))
    df.write.mode("overwrite").parquet(path + "._new")
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(beside, target)
    fs.delete(old, True)


def restore_folders(spark: SparkSession, path: str) -> None:
    """Undo a ``replace_folders`` that broke off: folders that were put aside come back."""
    old, fs = _file_system(spark, path + "._old")
    if not fs.exists(old):
        return
    for f in fs.listStatus(old):
        target = _file_system(spark, f"{path}/{f.getPath().getName()}")[0]
        fs.delete(target, True)
        fs.rename(f.getPath(), target)
    fs.delete(old, True)


def replace_folders(df: DataFrame, path: str, column: str, values: list[int]) -> None:
    """Put the rows of ``df`` in the place of those folders of the table at ``path``, divided by ``column``, that hold
    ``values``; the rows are written beside before anything is touched. ``restore_folders`` undoes what broke off."""
    spark = df.sparkSession
    target, fs = _file_system(spark, path)
    df.repartition(column).write.mode("overwrite").partitionBy(column).parquet(path + "._new")
    old = _file_system(spark, path + "._old")[0]
    fs.mkdirs(target)
    fs.mkdirs(old)
    for v in values:
        there, beside, aside = (_file_system(spark, f"{p}/{column}={v}")[0] for p in (path, path + "._new", path + "._old"))
        if fs.exists(there):
            fs.rename(there, aside)
        if fs.exists(beside):
            fs.rename(beside, there)
    fs.delete(old, True)
    fs.delete(_file_system(spark, path + "._new")[0], True)


METRIC_KEYS = [f.split()[0] for f in schemas.METRIC.split(", ")]


def append_metrics(spark: SparkSession, path: str, records: list[dict]) -> bool:
    """Append records to the log, with the allowed keys only; a failure is reported, not raised."""
    try:
        rows = [tuple(r.get(k) for k in METRIC_KEYS) for r in records]
        spark.createDataFrame(rows, schemas.METRIC).withColumn("ts", F.coalesce("ts", X.utc_now())).coalesce(1).write.mode("append").json(path)
        return True
    except Exception:  # noqa: BLE001 - a log must not stop what it logs
        return False


def status(spark: SparkSession, paths: dict[str, str]) -> dict[str, int | None]:
    """Rows of each table, None for those that are missing."""
    return {name: spark.read.parquet(p).count() if exists(spark, p) else None for name, p in paths.items()}
