"""Helpers shared by the corpus operators: Arrow maps over texts, fingerprints,
reliable cuts of the lineage, and connected components on edge tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructField, StructType

from menuloom.session import reliable_checkpoint

# Rows handed to a function of texts at a time; only memory depends on it.
SLICE_ROWS = 256
#: White space of ASCII: everything else belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def map_texts(
    df: DataFrame,
    keep: Sequence[str],
    fields: Sequence[StructField],
    make: Callable[[], Callable[[list], list]],
    text: str = "text",
) -> DataFrame:
    """One row out for each row of ``df``: the columns ``keep`` as they are, then
    ``fields`` computed from the text. ``make`` runs once in each task and gives a
    function from a list of texts (None for null) to one list of values per field.
    It needs no shuffle and holds one slice of a batch at a time."""
    fields, keep = list(fields), list(keep)
    source = df.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = StructType([*(source.schema[k] for k in keep), *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                made = work(part.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(i) for i in range(len(keep))), *(pa.array(v, k) for v, k in zip(made, kinds, strict=True))], names
                )

    return source.mapInArrow(run, schema)


def rewrite_texts(df: DataFrame, make: Callable[[], Callable[[list], tuple[list, list]]], text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """All columns of ``df``, with rows dropped and texts replaced as the made
    function says: it gives for a list of texts whether to keep each row, and the
    new texts. ``length`` is the column that holds the text's length, if there is one."""
    schema, names = df.schema, df.columns
    at, size_at = names.index(text), names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                old = part.column(at).to_pylist()
                keep, new = work(old)
                columns = [part.column(i) for i in range(len(names))]
                changed = [i for i, (a, b) in enumerate(zip(old, new, strict=True)) if a != b]
                if changed:
                    columns[at] = pa.array(new, columns[at].type)
                    if size_at is not None:
                        sizes = columns[size_at].to_pylist()
                        for i in changed:
                            sizes[i] = len(new[i])
                        columns[size_at] = pa.array(sizes, columns[size_at].type)
                out = pa.RecordBatch.from_arrays(columns, names)
                yield out if all(keep) else out.filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, schema)


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between ASCII white space; ``lower`` changes A-Z only."""
    if text is None:
        return []
    raw = utf8(text)
    return (raw.lower() if lower else raw).split()


def word_names(words: Sequence[bytes]) -> np.ndarray:
    """A 64-bit name for each word, the same on every machine."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) | np.uint64(1)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Indices of pairs that join all that the pairs join, n - 1 at most."""
    up = np.arange(n)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    keep = []
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = root(i), root(j)
        if i != j:
            up[max(i, j)] = min(i, j)
            keep.append(k)
    return np.array(keep, np.int64)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge table as rows (node, component), the
    component being its smallest node; nodes without an edge are absent.

    Alternates large and small stars: every round is two aggregations and joins on
    the edge table, which never grows, and is fixed with a checkpoint. No component
    is gathered anywhere; a hub with many edges is split by the skew join."""
    low, high = F.least(a, b), F.greatest(a, b)
    e = reliable_checkpoint(edges.select(high.alias("u"), low.alias("v")).where("u <> v").distinct())
    mark = _mark(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = reliable_checkpoint(small.union(first).distinct())
        new = _mark(e)
        if new == mark:
            break
        mark = new
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first())


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables that its job has written and read."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def travelling(spark: SparkSession, thing: object) -> Broadcast:
    """An object of this package, sent once to each executor; ``arrived`` gives it back in a task.
    It is pickled by value into bytes, so workers need no copy of the package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def arrived(sent: Broadcast) -> object:
    return cloudpickle.loads(sent.value)
