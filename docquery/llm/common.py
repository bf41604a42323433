"""What the operators of this folder share: tables, shared storage, words of a text batch."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_written: dict[str, tuple[SparkSession, dict[str, object]]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or what ``setCheckpointDir`` named.

    A folder of this machine is used only where neither is set and the executors are on this machine (tests).
    """
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base is None:
        named = sc._jsc.sc().getCheckpointDir()
        base = named.get() if named.isDefined() else None
    if base is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if sc.applicationId not in _own:
            _own[sc.applicationId] = tempfile.mkdtemp(prefix="docquery-")
            atexit.register(shutil.rmtree, _own[sc.applicationId], ignore_errors=True)
        base = _own[sc.applicationId]
    return f"{base.rstrip('/')}/llm-{sc.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing.

    The planner then knows the table's true size, so joins against it are broadcast only when it is small.
    The files are removed once no plan refers to them any more (Spark cleans shuffles by the same rule), which is seen when
    the next table is written, and at the latest when the Python process ends.
    """
    spark = df.sparkSession
    root = shared_dir(spark)
    _sweep(root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if root not in _written:
        _written[root] = (spark, {})
        atexit.register(_remove, root)
    out = spark.read.schema(df.schema).parquet(path)
    # every plan that is made from the table holds its list of files
    files = out._jdf.queryExecution().analyzed().relation().location()
    _written[root][1][path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(files)
    return out


def _sweep(root: str) -> None:
    """Delete the tables that the JVM's garbage collector found unused."""
    spark, paths = _written.get(root, (None, {}))
    for path in [path for path, files in paths.items() if files.refersTo(None)]:
        del paths[path]
        _delete(spark.sparkContext, path)


def _delete(sc: SparkContext, name: str) -> None:
    path = sc._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def _remove(root: str) -> None:
    spark, _ = _written.pop(root, (None, None))
    sc = spark and spark.sparkContext
    if sc is None or sc._jsc is None:
        return
    try:
        _delete(sc, root)
    except Exception:  # the JVM may be gone already; leftovers are then the cluster's to clean
        pass


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each stem."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def shards_for(rows: int, rows_each: int) -> int:
    return max(1, math.ceil(rows / rows_each))


def doc_key(df: DataFrame) -> F.Column:
    """128 bits that stand for a row's doc_id and text; null differs from every value."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat(F.length(parts[0]).cast("string"), F.lit(":"), *parts).cast("binary")))


def batch_texts(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def lean(spark: SparkSession) -> None:
    """Batches of texts for Python of at most 1,000 rows: texts are long, and Arrow's buffers lie outside the heap on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= 1000:
        spark.conf.set(name, "1000")


def map_texts(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    lean(df.sparkSession)
    return df.mapInArrow(f, schema)


def split_words(texts: pa.Array, pattern: str | None = r"[^\p{L}\p{N}]+") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of a batch: 64-bit hash of each, the document it is in, and document starts (one more than documents).

    With ``pattern`` None, words are what white space separates, as they are written.
    """
    low = texts if pattern is None else pc.replace_substring_regex(pc.utf8_lower(texts), pattern, " ")
    lists = pc.ascii_split_whitespace(low) if pattern is None else pc.split_pattern(low, " ")
    flat = lists.flatten()
    starts = np.asarray(lists.offsets, dtype=np.int64)
    starts = starts - starts[0]
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(starts))
    keep = np.asarray(pc.binary_length(flat)) > 0
    encoded = flat.dictionary_encode()
    codes = np.asarray(encoded.indices, dtype=np.int64)[keep]
    doc = doc[keep]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, encoded.dictionary.to_pylist()), dtype=np.uint64, count=len(encoded.dictionary))
    out = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(np.bincount(doc, minlength=len(texts)), out=out[1:])
    return hashes[codes] if len(codes) else np.zeros(0, np.uint64), doc, out


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of one hold about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to


def large_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Join record batches until the texts of one hold about ``limit`` bytes, and cut longer ones: for work that is cheaper by the distinct word."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in small_batches(batches, column, limit):
        own = pc.sum(pc.binary_length(batch.column(batch.schema.get_field_index(column)))).as_py() or 0
        if held and size + own > limit:
            yield _joined(held)
            held, size = [], 0
        held.append(batch)
        size += own
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)
