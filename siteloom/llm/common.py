"""What the operators on texts share."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from siteloom.session import ship, table

#: Texts are handed to the workers' functions in slices of at most so many rows and about so many characters.
SLICE_ROWS, SLICE_CHARS = 512, 1_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def slices(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch with their texts (null: empty); a long text is a part of its own. Only a part's texts are Python strings at one time."""
    for top in range(0, batch.num_rows, SLICE_ROWS):
        part = batch.slice(top, SLICE_ROWS)
        texts = [t or "" for t in part.column(text_col).to_pylist()]
        first = held = 0
        for k, text in enumerate(texts):
            held += len(text)
            if held >= SLICE_CHARS or k + 1 == len(texts):
                yield part.slice(first, k + 1 - first), texts[first : k + 1]
                first, held = k + 1, 0


def fresh(columns: list[str], name: str) -> str:
    """name, longer by so many underscores that no column has it (names are compared without case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """What this worker process has freed goes back to the system. Workers outlive their tasks and stages, and
    Arrow and the C library would otherwise hold on to what the batches of an earlier one took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def map_texts(df: DataFrame, keep: list[str], text_col: str, schema: str, make: Callable[[], Callable[[list[str]], dict[str, list]]]) -> DataFrame:
    """The columns `keep` of df and those that make()(texts) gives for its texts (null: empty).

    make is called once for each task, so what it builds serves all batches. Only `keep` and the
    text travel to the workers. schema: DDL of the added columns.
    """
    ship(df.sparkSession)
    added = StructType.fromDDL(schema)
    hidden = fresh(keep, "__text")
    sent = df.select(*[F.col(c) for c in keep], F.col(text_col).alias(hidden))
    out = StructType([sent.schema[c] for c in keep] + added.fields)
    names = [f.name for f in added.fields]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out)

    def run(batches):
        give_back()
        work = make()
        for batch in batches:
            for part, texts in slices(batch, hidden):
                got = work(texts)
                cols = [part.column(c).cast(arrow.field(c).type) for c in keep]
                cols += [pa.array(got[n], type=arrow.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays(cols, schema=arrow)
        give_back()

    return sent.mapInArrow(run, out)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
