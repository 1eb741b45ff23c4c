"""Helpers shared by the operators: Arrow column maps and word hashes."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str | None, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes in ``column``; a longer value is a part of its own."""
    if column is None or not batch.num_rows:
        yield batch
        return
    sizes = np.array([0 if v is None else v for v in pa.compute.binary_length(batch.column(column)).to_pylist()])
    part = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for begin, end in zip(edges, edges[1:], strict=False):
        yield batch.slice(begin, end - begin)


def add_columns(
    df: DataFrame,
    compute: Callable[[pa.RecordBatch], Sequence],
    new: str | T.StructType,
    sized_by: str | None = "text",
    drop: Sequence[str] = (),
) -> DataFrame:
    """``df`` with columns that ``compute`` makes from Arrow batches; nothing is shuffled.

    Columns of ``df`` with the names of new ones, or named in ``drop``, are left out.
    """
    new = T.StructType.fromDDL(new) if isinstance(new, str) else new
    names = set(new.fieldNames()) | set(drop)
    old = [f for f in df.schema.fields if f.name not in names]
    old_names = [f.name for f in old]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in new.fields]
        try:
            for batch in batches:
                for part in slices(batch, sized_by):
                    made = [pa.array(v, kind) for v, kind in zip(compute(part), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(n) for n in old_names), *made], names=[*old_names, *new.fieldNames()]
                    )
        finally:
            release_memory()

    return df.mapInArrow(run, T.StructType([*old, *new.fields]))


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D; exactly what splitting bytes does."""
    return [] if text is None else text.encode().split()


def lower_ascii(text: str) -> bytes:
    return text.encode().lower()  # bytes.lower changes A-Z only


def word_hashes(words: Sequence[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that leaves no pattern of its input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, size: int, factor: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A hash of every ``size`` consecutive words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, step = np.zeros(n, np.uint64), np.uint64(factor | 1)
    for k in range(size):
        total = total * step + hashes[k : k + n]
    return mix(total)


def release_memory() -> None:
    """Give freed memory back to the system: workers serve later stages, whose memory it would take."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc
        trim(0)


def worker_cache(key: str, build: Callable[[], object], keep: int = 1) -> object:
    """What ``build`` makes, kept in the worker process for later tasks; what was kept before goes first."""
    store = sys.modules.setdefault("_hiresift_worker_cache", types.ModuleType("_hiresift_worker_cache")).__dict__
    held = store.setdefault("held", {})
    if key not in held:
        if len(held) >= keep:
            while len(held) >= keep:
                held.pop(next(iter(held)))
            release_memory()
        held[key] = build()
    return held[key]
