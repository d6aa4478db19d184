"""What the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut, scratch, shared_dir  # noqa: F401

#: Python kernels take at most this many rows, and about this many characters, at once.
ROWS, CHARS = 512, 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """Each batch in slices of ROWS rows at most, whose column ``text`` holds CHARS bytes at most, or is a single row."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        at = size = 0
        for i, n in enumerate(sizes.tolist()):
            if i > at and (i - at == ROWS or size + n > CHARS):
                yield batch.slice(at, i - at)
                at, size = i, 0
            size += n
        if at < batch.num_rows:
            yield batch.slice(at)


def slices(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[list[list]]:
    """The columns of each of ``parts`` as lists. Null texts come as ""."""
    for part in parts(batches, text):
        cols = [c.to_pylist() for c in part.columns]
        cols[text] = [x or "" for x in cols[text]]
        yield cols


def map_texts(df: DataFrame, keys: list[str], text: str, kernel: Callable[[list[list]], dict[str, list]], schema: str) -> DataFrame:
    """``kernel`` over slices of (keys..., text); it returns the columns of ``schema``.

    Only these columns reach Python, so further columns of ``df`` cannot clash with those made.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [x.split(" ")[0] for x in schema.replace("\n", " ").split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in slices(batches, len(keys)):
            out = kernel(cols)
            yield pa.RecordBatch.from_arrays([pa.array(out[f], t) for f, t in zip(fields, kinds)], fields)

    kinds = list(to_arrow_schema(_parse_datatype_string(schema)).types)
    picked = [F.col(f"`{k}`") for k in keys] + [F.col(f"`{text}`").cast("string")]
    return df.select(*picked).mapInArrow(run, schema)


def map_rows(docs: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """``run`` over whole rows of ``docs``, whose columns it must not rename; their names may hold any characters."""
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


class Rounds:
    """Tables of an iteration, written to the shared folder; all but the last two are deleted again.

    A checkpointed frame keeps the constraints of the plan it came from, which grow from round to round until planning
    takes longer than the work; a written table starts afresh.
    """

    def __init__(self, spark: SparkSession):
        self._spark, self._place, self._kept = spark, scratch(spark, "rounds"), []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self._place}/{len(self._kept)}"
        df.write.parquet(path)
        self._kept.append(path)
        if len(self._kept) > 2:
            old = self._spark._jvm.org.apache.hadoop.fs.Path(self._kept[-3])
            old.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(old, True)
        return self._spark.read.schema(df.schema).parquet(path)
