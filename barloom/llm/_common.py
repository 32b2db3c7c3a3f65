"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words (space and \x09-\x0D).
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TABLE = str.maketrans(UPPER, UPPER.lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new path below the folder that driver and executors share.

    The cluster names the folder in ``spark.checkpoint.dir``. Where that is
    missing, a temporary folder serves if driver and executors are one process;
    on a cluster it is an error, as executors would not see the driver's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/barloom-{label}-{uuid.uuid4().hex}"


#: Rows of texts in a batch that goes to a Python worker, at most.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound Arrow batches by ``rows``, so that texts are not held by the ten thousand.

    The setting is read when a query runs, so it stays for the session: other queries of it get small batches too.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage, so that the loss of an executor recomputes nothing
    that lies before this point.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


class WordHashes(dict):
    """64-bit hashes of words in UTF-8, remembered up to a number."""

    KEEP = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) > self.KEEP:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_KEPT: dict = {"of": None}


def kept(group: str, name, make):
    """What a Python worker keeps between tasks, for one group at a time.

    Workers outlive an operator; the first call of another group lets go of
    what the last one kept, so that memory follows the largest, not the sum.
    """
    if _KEPT["of"] != group:
        _KEPT.clear()
        _KEPT["of"] = group
    if name not in _KEPT:
        _KEPT[name] = make()
    return _KEPT[name]


#: The reflected polynomial of the cyclic redundancy check, bit by bit over the decimal digits.
CRC32_SQL = """xor(4294967295, list_reduce(list_prepend(4294967295::bigint, flatten([[ascii(d) + 256, 0, 0, 0, 0, 0, 0, 0] FOR d IN string_split(doc_id::varchar, '')])),
    lambda a, x: CASE WHEN xor(a, CASE WHEN x > 0 THEN x - 256 ELSE 0 END) & 1 = 1 THEN xor(3988292384, xor(a, CASE WHEN x > 0 THEN x - 256 ELSE 0 END) >> 1) ELSE xor(a, CASE WHEN x > 0 THEN x - 256 ELSE 0 END) >> 1 END))"""
