"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.lineage import cut, shared_dir

__all__ = ["bounded_batches", "cut", "fresh", "shared_dir", "small", "steps", "table", "with_fields", "without"]

#: Characters handled in one vectorised step; a longer single text is a step of its own.
STEP_CHARS = 500_000
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """`schema` with `fields` at its end; an older column of such a name is replaced."""
    names = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in names] + list(fields))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that `df` does not have."""
    name, taken = f"__{stem}", {c.lower() for c in df.columns}
    while name in taken:
        name = f"_{name}"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Rows are whole documents, so batches to Python are bounded by bytes (8 MB unless the session says less)."""
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "8m")


def steps(lengths: list[int], most: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most `most` characters, one row at least."""
    begin = held = 0
    for i, n in enumerate(lengths):
        if i > begin and held + n > most:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(lengths):
        yield begin, len(lengths)


#: Bytes up to which a small side is broadcast; a larger one is shuffled.
BROADCAST_BYTES = 10 << 20


def _bytes(value: Column, kind: T.DataType) -> Column:
    """About the bytes that a value takes in a row."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        if isinstance(inner, (T.StringType, T.BinaryType, T.ArrayType, T.StructType)):
            return F.coalesce(F.aggregate(value, F.lit(24).cast("long"), lambda acc, x: acc + _bytes(x, inner)), F.lit(24))
        return 24 + 8 * F.greatest(F.size(value), F.lit(0))
    if isinstance(kind, T.StructType):
        return sum((_bytes(value[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(16)


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, which must be cut or cheap, broadcast if its rows take at most `most` bytes, as summed up."""
    total = df.agg(F.sum(sum((_bytes(F.col(f"`{f.name}`"), f.dataType).cast("long") for f in df.schema.fields), F.lit(0)))).first()[0]
    return F.broadcast(df) if (total or 0) <= most else df


def without(df: DataFrame, dropped: DataFrame, id: str = "doc_id", most: int = BROADCAST_BYTES) -> DataFrame:
    """The rows of `df` whose id is not in `dropped` (column id); null ids stay, rows that repeat an id share its fate.

    The ids are measured first: few are broadcast, so `df` is not shuffled; more are joined.
    """
    name = fresh(df, "gone")
    gone = small(cut(dropped.select(F.col("id").alias(name))), most)
    return df.join(gone, df[id] == gone[name], "left_anti")
