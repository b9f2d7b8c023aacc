"""What several corpus operators share: the shared folder, written tables, text constants."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words, as characters and as a Java pattern.
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"

#: The columns of the documents table, in order; the pipeline's stages keep them.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset (tests on one machine) a folder of this process is set, for
    local masters only: on a cluster a machine's own folder is not shared.
    """
    sc = spark.sparkContext
    own = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if own:
        return own.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="corpus-shared-"))
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def materialise(df: DataFrame, name: str = "table", **options: object) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage like a reliable checkpoint (a lost executor costs nothing
    that was written) and leaves a columnar table that later scans can prune.
    """
    spark = df.sparkSession
    path = f"{new_path(spark, name)}/data"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_files(uri: str):
    """(filesystem, path) of pyarrow for a Hadoop-style URI, for files that executors write."""
    from pyarrow import fs

    if uri.startswith("s3a://"):
        uri = "s3://" + uri[len("s3a://") :]
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null for null.

    Every kind of white space becomes a blank first, so that counting needs no regular
    expression: words begin where a blank is followed by a character that is none.
    """
    blanks = F.translate(text, SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.size(F.filter(F.split(blanks, " "), lambda w: w != "")).cast("long")


def aside(docs: DataFrame, own: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """The columns ``own`` as far as they are there, with all others in one struct, so that no name of theirs can clash with an
    operator's; and how each of the others comes out of it again."""
    kept = {c.lower(): c for c in docs.columns}
    names = [kept[c] for c in own if c in kept]
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    others = [c for c in docs.columns if c not in names]
    rest = F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(others)]) if others else F.lit(None).cast("int")
    rows = docs.select(*[quoted(c).alias(c.lower()) for c in names], rest.alias("_aside"))
    return rows, {c: F.col("_aside")[f"c{i}"] for i, c in enumerate(others)}


def ordered_first(*columns: Column) -> Column:
    """A struct that orders by ``columns`` with nulls after all values."""
    return F.struct(*[c for x in columns for c in (x.isNull(), x)])


def quiet_tokenizers() -> None:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
