"""What the operators of this subpackage share: words, table reading, written intermediates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..workspace import Workspace, shared_folder

__all__ = ["SPACES", "Workspace", "crc_bucket", "shared_folder", "small_side", "table", "words_of"]

#: A word is a run of anything but these six characters.
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """The words of a text; of null or white space, none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def crc_bucket(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo n: the folds of the contracts. A null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def small_side(df: DataFrame, most_rows: int, most_bytes: int = 64 << 20) -> DataFrame:
    """A join's small side: broadcast if its files are at most ``most_bytes`` and a count proves it has at most ``most_rows`` rows, else left to a shuffled join. ``df`` should be a written table."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return F.broadcast(df) if size <= most_bytes and df.limit(most_rows + 1).count() <= most_rows else df
