"""Helpers of the text operators: Arrow batches, words of whole texts, bounded word caches, staged tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loadspan.session import shared_dir

#: Rows of an Arrow batch: 500 texts of 100,000 characters are 50 MB.
BATCH_ROWS = 500
#: Bytes of text that are split into words at a time.
CHUNK_BYTES = 1 << 20


def configure(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, as texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    if pa.types.is_null(column.type):
        return [b""] * len(column)
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: Sequence[bytes], limit: int = CHUNK_BYTES) -> Iterator[Sequence[bytes]]:
    """Runs of texts of about ``limit`` bytes; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > limit:
            yield texts[start:i]
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield texts[start:]


def schema_fields(ddl: str) -> list[str]:
    return [part.split()[0] for part in ddl.split(",")]


def map_texts(
    docs: DataFrame, make: Callable[[], Callable[[list[bytes]], list[list]]], ddl: str, id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """A row for each text: the id, then what the function made by ``make`` returns as columns of ``ddl``.

    ``make`` runs once in each task; its function gets UTF-8 texts and returns one list for each
    column. Columns of ``docs`` other than the id and the text are not read, so theirs may have any name.
    """
    from pyspark.sql.types import StructType

    kind = StructType.fromDDL(ddl)
    out = StructType([docs.schema[id_column], *kind.fields])
    source = docs.select(F.col(id_column), F.col(text_column).alias("_text" if id_column != "_text" else "_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        fn = make()
        for batch in batches:
            columns: list[list] = [[] for _ in kind.fields]
            for part in chunks(raw_texts(batch.column(1))):
                for column, values in zip(columns, fn(part), strict=True):
                    column.extend(values)
            arrays = [batch.column(0).cast(schema.field(0).type)]
            arrays += [pa.array(c, type=schema.field(i + 1).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, out)


class WordCache:
    """Values of words, made for many new words at once and kept for the last ``cap`` to ``2 * cap`` words."""

    def __init__(self, make: Callable[[list[bytes]], list], cap: int = 60_000) -> None:
        self.make, self.cap = make, cap
        self.fresh: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}

    def of(self, texts: Sequence[Sequence[bytes]]) -> dict[bytes, object]:
        """A mapping that has every word of ``texts``."""
        self._turn()
        missing: set[bytes] = set()
        for words in texts:
            missing |= set(words).difference(self.fresh)
        self._add(missing)
        return self.fresh

    def values(self, texts: Sequence[Sequence[bytes]]) -> list[list]:
        """The values of the words of each text, for values that are never None: words that are known are looked up once."""
        self._turn()
        get = self.fresh.get
        out = [list(map(get, words)) for words in texts]
        gaps = [i for i, found in enumerate(out) if None in found]
        self._add({word for i in gaps for word, value in zip(texts[i], out[i]) if value is None})
        for i in gaps:
            out[i] = list(map(get, texts[i]))
        return out

    def _turn(self) -> None:
        if len(self.fresh) > self.cap:
            self.old, self.fresh = self.fresh, {}

    def _add(self, missing: set[bytes]) -> None:
        fresh, old = self.fresh, self.old
        unknown = []
        for word in missing:
            value = old.get(word)
            if value is None:
                unknown.append(word)
            else:
                fresh[word] = value
        if unknown:
            fresh.update(zip(unknown, self.make(unknown), strict=True))


def stage(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table into the shared folder and read it back: it ends the lineage and outlives lost executors."""
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal few large input splits over the shuffle width; the dealing is by content, so a retried task repeats it."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *df.columns)
