"""Readers of corpora, logs and artifacts, and their writers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T


def markdown(spark: SparkSession, path: str, recursive: bool = False, glob: str = "*.md") -> DataFrame:
    """(file_path, stem, title, text) of the non-blank files, sorted names not needed: rows are keyed by path."""
    read = spark.read.text(path, wholetext=True, pathGlobFilter=glob, recursiveFileLookup=recursive)
    rows = read.select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("text"))
    stem = F.regexp_replace(T.base_name(F.col("file_path")), r"\.[^.]*$", "")
    return rows.where(F.col("text").rlike(r"\S")).select("file_path", stem.alias("stem"), T.title(F.col("text"), stem).alias("title"), "text")


def binary(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, length, content) for a page parser run with mapInPandas or mapInArrow."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path).select("path", "length", "content")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log; blank lines are skipped, a bad line gives a row whose _corrupt_record holds it."""
    return spark.read.schema(f"{schema}, _corrupt_record string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record")


def jsonl_until_bad(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a log of JSON lines, each file up to its first line that is no JSON; blank lines are skipped.

    A file's lines are in the order of its splits, and of a split's rows, so a
    file is not read by one task: the place of its first bad line is a minimum
    over all of them, joined back by file.
    """
    at = F.struct(F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("row"))
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("file"), at.alias("at"), F.trim(F.regexp_replace("value", r"^\s+|\s+$", "")).alias("line")).where("line <> ''")
    bad = lines.where(F.try_parse_json("line").isNull()).groupBy("file").agg(F.min("at").alias("bad"))
    good = lines.join(bad, "file", "left").where("bad is null or at < bad")
    return good.select(F.from_json("line", schema).alias("r")).select("r.*")


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document a file, plain or gzip."""
    return spark.read.schema(schema).json(path, multiLine=True)


def pending(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs whose output does not exist yet."""
    return inputs.join(outputs.select(key).distinct(), key, "left_anti")


def inputs(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of a file or of a folder's files, in the order of their paths; empty files are left out, a missing path raises. Contents are not read."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length").orderBy("path")


def trace(rows: DataFrame, key: str, value, column: str, schema: str) -> DataFrame:
    """The rows of one key, their JSON column read by its schema."""
    return rows.where(F.col(key) == F.lit(value)).withColumn(column, F.from_json(column, schema))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What a run has saved so far; no rows where there is nothing yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def save_checkpoint(rows: DataFrame, path: str) -> None:
    """More rows of a run; it goes on with ``pending(all, checkpoint, key)``."""
    rows.write.mode("append").parquet(path)


def stored(rows: DataFrame) -> DataFrame:
    """The rows out of a table written now in the folder that all executors share: what several parts of a plan read is then made once."""
    from ..streaming.events import work_dir

    path = work_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def append_jsonl(rows: DataFrame, path: str, gzip: bool = False) -> None:
    w = rows.write.mode("append")
    (w.option("compression", "gzip") if gzip else w).json(path)


def rewrite_jsonl(rows: DataFrame, path: str) -> None:
    """Replace a log by rows that may be read from it: written beside it first, then renamed, so it is there in full at any time but between two renames."""
    spark = rows.sparkSession
    new, old = f"{path}.new", f"{path}.old"
    rows.write.mode("overwrite").json(new)
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(make(old), True)
    if fs.exists(make(path)):
        fs.rename(make(path), make(old))
    fs.rename(make(new), make(path))
    fs.delete(make(old), True)


def log_lines(rows: DataFrame, path: str) -> None:
    """Append rows to a log of JSON lines, nulls left out."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("append").text(path)


def filtered(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """parts(key, idx, paragraph, kept) -> (key, text, total, kept, removed, details): what is left of each document in order, and what was decided."""
    all_ = F.array_sort(F.collect_list(F.struct("idx", "paragraph", "kept"))).alias("p")
    g = parts.groupBy(key).agg(all_)
    left = F.transform(F.filter("p", lambda x: x["kept"]), lambda x: x["paragraph"])
    total = F.size("p")
    return g.select(key, F.array_join(left, "\n\n").alias("text"), total.alias("total"), F.size(left).alias("kept"), (total - F.size(left)).alias("removed"), F.transform("p", lambda x: F.struct(x["idx"].alias("idx"), x["kept"].alias("kept"))).alias("details"))


def write_filtered(parts: DataFrame, path: str, key: str = "doc_id") -> None:
    """Filtered texts and what was decided about them, as two outputs; a folder for each document would not scale."""
    rows = filtered(parts, key)
    rows.select(key, "text").write.mode("overwrite").parquet(f"{path}/text")
    rows.drop("text").write.mode("overwrite").json(f"{path}/meta")


def write_triple(rows: DataFrame, path: str, key: str = "doc_id") -> None:
    """rows(key, markdown, metadata, layout) as three outputs that meet again by key."""
    rows.select(key, "markdown").write.mode("overwrite").parquet(f"{path}/markdown")
    for name in ("metadata", "layout"):
        rows.select(key, name).write.mode("overwrite").json(f"{path}/{name}")


def write_eval_set(questions: DataFrame, path: str, by: list[str]) -> None:
    """Questions, and their numbers by each of the columns and in all."""
    from ..operators.evalset import distributions

    questions.write.mode("overwrite").json(f"{path}/questions")
    distributions(questions, by).write.mode("overwrite").json(f"{path}/metadata")


def append_stages(rows: DataFrame, path: str) -> None:
    """More stage rows of traces; a reader pivots them."""
    rows.write.mode("append").partitionBy("stage").parquet(path)


def plain_metadata(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Metadata a vector store takes: numbers and truth values as they are, anything else as text."""
    kinds = dict(rows.dtypes)
    simple = ("int", "bigint", "smallint", "tinyint", "double", "float", "boolean")
    text = lambda c: F.to_json(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c).cast("string")
    return rows.select(*[F.col(c) if c not in columns or kinds[c] in simple else text(c).alias(c) for c in rows.columns])


def without_payload(rows: DataFrame, suffix: str = "_data") -> DataFrame:
    """Rows for a listing: columns of payload are not read at all."""
    return rows.select(*[c for c in rows.columns if not c.endswith(suffix)])


def chunk_id(stem, collection, index):
    """A chunk's id within all collections."""
    return F.concat_ws("_", stem, F.concat(F.lit("idx"), collection.cast("string")), F.concat(F.lit("chunk"), index.cast("string")))


def write_collection(rows: DataFrame, path: str, key: str = "chunk_id") -> None:
    """Append to a vector collection, partitioned by collection. An id stands once in its collection, also after several appends: rows whose id is there already are left out."""
    spark = rows.sparkSession
    new = rows.dropDuplicates(["collection", key])
    if exists(spark, path):
        new = new.join(spark.read.schema(rows.select("collection", key).schema).parquet(path), ["collection", key], "left_anti")
    new.write.mode("append").partitionBy("collection").parquet(path)


def collection(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("collection") == name)


@dataclass(frozen=True)
class Params:
    """Settings of the retrieval funnel."""

    k_papers: int = 30
    m_chunks: int = 20
    n_final: int = 5
    lexical_weight: float = 0.3
    dense_weight: float = 0.7
    max_rerank: int = 50
    grounded: float = 0.5
    paths: dict[str, str] = field(default_factory=dict)


def resolve(config: dict) -> dict:
    """Nested settings with ``${a.b}`` replaced by the value at that path; unknown names stay."""

    def at(name: str):
        out = config
        for part in name.split("."):
            out = out.get(part) if isinstance(out, dict) else None
        return out

    def walk(x):
        if isinstance(x, dict):
            return {k: walk(v) for k, v in x.items()}
        if isinstance(x, list):
            return [walk(v) for v in x]
        if isinstance(x, str):
            for _ in range(8):
                y = re.sub(r"\$\{([^}]+)\}", lambda m: m[0] if at(m[1]) is None else str(at(m[1])), x)
                if y == x:
                    break
                x = y
        return x

    return walk(config)


def load_yaml(path: str, environment: str | None = None) -> dict:
    """Settings of a YAML file; ``environment`` picks its sub-tree of paths where there is one."""
    import yaml

    with open(path) as f:
        config = yaml.safe_load(f) or {}
    if environment and isinstance(config.get("paths"), dict) and environment in config["paths"]:
        config["paths"] = config["paths"][environment]
    return resolve(config)
