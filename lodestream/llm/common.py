"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that separate words: space and tab to carriage return.
SPACES = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, or that with underscores before it, whichever no column of ``df`` has (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session in one process without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lodestream-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def _checkpoint_folder(spark: SparkSession) -> None:
    """Name the checkpoint folder where the session hasn't."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table that this library wrote into the shared folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, so that lost executors cost no recomputation."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """As ``checkpointed``, but as a Parquet table there: a fraction of the size, for many slim rows."""
    spark = df.sparkSession
    _checkpoint_folder(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def swept(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more: it learns of them when the driver's garbage is collected."""
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, size: int = 16_000_000) -> Iterator[None]:
    """Arrow batches of at most about ``size`` bytes, for rows that carry whole texts."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def mapped(
    df: DataFrame,
    columns: Sequence[str],
    keep: Sequence[str],
    added: Sequence[tuple[str, T.DataType]],
    function: Callable[..., Sequence[pa.Array]],
    setup: Callable[[], object] | None = None,
) -> DataFrame:
    """``keep`` of ``df`` and the columns ``added``, which ``function`` makes from the Arrow arrays of ``columns``.

    A narrow step: no shuffle, memory bounded by one Arrow batch. ``setup`` runs once in a task; its result is the first argument.
    """
    wanted = list(dict.fromkeys([*keep, *columns]))
    # Places, not names, reach the function: extra columns and clashing or odd names are no concern of it.
    source = df.select(*[column(c).alias(f"c{k}") for k, c in enumerate(wanted)])
    n_keep = len(keep)
    where = [wanted.index(c) for c in columns]
    schema = T.StructType([*source.schema.fields[:n_keep], *(T.StructField(f"m{k}", t) for k, (_, t) in enumerate(added))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (setup(),) if setup else ()
        for batch in batches:
            if not batch.num_rows:
                continue
            made = function(*first, *(batch.column(i) for i in where))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_keep], *made], names=schema.names)

    return source.mapInArrow(run, schema).toDF(*keep, *(n for n, _ in added))


def texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def decoded(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit numbers (two multiply-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_B = 0xD6E8FEB86659FD93


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            made = []
            for base in (_B, pow(_B, -1, 1 << 64)):
                x = np.full(size, np.uint64(base))
                x[0] = 1
                made.append(np.multiply.accumulate(x))
            self.up, self.down = made
        return self.up[:n], self.down[:n]


POWERS = Powers()


#: Texts of the sample that tells hot hashes, how many of them have a hot one at least, and the most hot ones: 0.5 MB.
SAMPLE_TEXTS, SAMPLE_LEAST, MOST_HOT = 4000, 8, 1 << 16


def hot_hashes(keyed: DataFrame, n_texts: int, function: Callable[[bytes], np.ndarray], sample: int | None = None, least: int | None = None) -> np.ndarray:
    """Hashes that very many texts have, sorted, from a sample of rows (t, text) of ``n_texts`` texts; each stands in two texts or more, surely.

    What is hot only decides which way a hash goes: its rows never gather under one key. The bounds are above.
    """
    sample, least = sample or SAMPLE_TEXTS, least or SAMPLE_LEAST
    chosen = keyed.where(F.pmod(F.xxhash64(F.lit(5), "t"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / max(1, n_texts))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = np.unique(function(raw)).view(np.int64)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), key, np.int64))], names=["h", "t"])

    counts = chosen.select("t", "text").mapInArrow(run, "h long, t long").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi"))
    rows = counts.where((F.col("n") >= least) & (F.col("lo") != F.col("hi"))).orderBy(F.desc("n"), "h").limit(MOST_HOT).select("h").collect()
    return np.sort(np.array([r["h"] for r in rows], np.int64).view(np.uint64))


def among(hashes: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted array."""
    if not len(sorted_):
        return np.zeros(len(hashes), bool)
    place = np.minimum(np.searchsorted(sorted_, hashes), len(sorted_) - 1)
    return sorted_[place] == hashes


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file, from the folder in LODESTREAM_TOKENIZERS or the installed package."""
    folder = os.environ.get("LODESTREAM_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
