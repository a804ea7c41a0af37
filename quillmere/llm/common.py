"""Helpers that the operators share: bounded Arrow slices, word codes, shared storage, hashes.

Words are split by Arrow's C++ kernels and dictionary-coded per slice, so the operators work on
integer arrays; Python objects are made per distinct word, not per word.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in a slice; one longer text makes a slice of its own.
SLICE_BYTES = 3 << 20

#: Bytes of an Arrow batch on its way to a Python worker, held several times over in the JVM's own memory.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, one of our own
    in local mode, as in tests, and an error on a cluster, whose machines would not see it."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not set_dir:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        set_dir = "file:///tmp/checkpoints"
    return set_dir.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/quillmere/{what}-{uuid.uuid4().hex}"


#: Rows of a small table that one task writes, so that it has few files however many partitions a shuffle has.
FILE_ROWS = 1 << 17


def written(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there and lost executors cost only their own tasks.

    rows: about how many narrow rows there are at most, where that is known (wide ones, such as pairs with their sets, count as
    many); then at most one task for each FILE_ROWS of them writes, and a small table has few files."""
    spark = df.sparkSession
    path = new_path(spark, what)
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillmere_path = path  # type: ignore[attr-defined]
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` that no later plan reads."""
    path = getattr(df, "_quillmere_path", None)
    if path:
        delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _trim = None


def released() -> None:
    """Gives the machine what this process holds free: Python workers live on, for other slices and other stages' tasks."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _joined(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """The same rows, several small batches as one of about size bytes."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            batch = held[0] if len(held) == 1 else pa.concat_batches(held)
            held, held_bytes = [], 0  # parts go before their whole is worked on
            yield batch
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def text_batches(batches: Iterator[pa.RecordBatch], column: str = "text", slice_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most slice_bytes of text; nulls in ``column`` stay null."""
    for batch in _joined(batches, slice_bytes) if slice_bytes > BATCH_BYTES else batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + slice_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's limit of bytes in an Arrow batch to BATCH_BYTES; a lower one stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    said = spark.conf.get(key, None)
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(said) if said and not said.startswith("-") else 0
    if not 0 < now <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def map_text(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, column: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """mapInArrow over bounded slices of text."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        for batch in text_batches(batches, column, slice_bytes):
            yield function(batch)
            released()

    return df.mapInArrow(run, schema)


def filter_text(df: DataFrame, keep: Callable[[pa.RecordBatch], np.ndarray | pa.Array], text_col: str = "text", id_col: str = "doc_id", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of df, all columns as they are, for which ``keep`` says so; it gets slices (doc_id, text) and
    gives a flag a row. Each row is judged where it is: no shuffle, whatever its id."""
    bounded_batches(df.sparkSession)
    names = df.columns
    at = [[x.lower() for x in names].index(c.lower()) for c in (id_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_cpu_count(1)
        named = (pa.RecordBatch.from_arrays(b.columns, [f"c{i}" for i in range(b.num_columns)]) for b in batches)  # names may repeat
        for batch in text_batches(named, f"c{at[1]}", slice_bytes):
            flags = keep(pa.RecordBatch.from_arrays([batch.column(i) for i in at], ["doc_id", "text"]))
            yield pa.RecordBatch.from_arrays(batch.filter(pa.array(flags)).columns, names)
            released()

    return df.mapInArrow(run, df.schema)


def filled(array: pa.Array) -> pa.Array:
    """Strings with null as empty."""
    return pc.fill_null(array, "") if array.null_count else array  # filling copies all texts


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text (null: none): codes of all words in order, the first
    word's position for each text plus the end, and the distinct words that the codes stand for."""
    split = pc.ascii_split_whitespace(filled(texts))
    offsets = np.asarray(split.offsets, dtype=np.int64)
    coded = split.values.dictionary_encode()
    del split  # as large as the texts, or larger
    codes, words = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
    del coded
    base = int(offsets[0]) if len(offsets) else 0
    codes, offsets = codes[base : int(offsets[-1])], offsets - base
    empty = pc.index(words, "").as_py()
    if empty >= 0:  # white space at either end leaves empty strings
        keep = codes != empty
        before = np.concatenate(([0], np.cumsum(keep)))
        codes, offsets = codes[keep], before[offsets]
    return codes, offsets, words


#: Bytes of words as they are, A-Z in lower case, all other ASCII as a space.
_WORD_BYTES = np.array([b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256)], np.uint8)


def letters_and_digits(texts: pa.Array) -> pa.Array:
    """Texts (null: empty) with A-Z lower-cased and every ASCII character but letters and digits made a
    space; each byte stays where it was, so offsets are those of the original."""
    texts = filled(texts)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    low, high = (int(offsets[0]), int(offsets[-1])) if len(texts) else (0, 0)
    data = texts.buffers()[2]
    plain = _WORD_BYTES[np.frombuffer(data, np.uint8)[low:high]] if data is not None else np.empty(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer((offsets - low).astype(np.int32)), pa.py_buffer(plain))


def lower_ascii(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(filled(texts))


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the UTF-8 bytes of each distinct word."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words))


def mixed(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit mix; a different order of the same values for each seed."""
    x = values ^ np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def row_ids(offsets: np.ndarray) -> np.ndarray:
    """The text's number for each word."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def gathered(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return np.arange(total, dtype=np.int64) + shift


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """Just the named input columns, under the operator's own names; others, whatever their names, play no part."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])
