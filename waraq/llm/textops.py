"""Arrow and numpy helpers that the operators share inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH_BYTES = 4 << 20


def by_bytes(batches: Iterator[pa.RecordBatch], column: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about ``limit`` bytes of the given text column, one row at least.

    Memory that Arrow no longer uses goes back after each batch, as workers live on from task to task."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        yield batch.slice(start)
        del batch
        pa.default_memory_pool().release_unused()


def texts_of(array: pa.Array) -> list[str]:
    """The texts of an Arrow column; null counts as empty."""
    return ["" if t is None else t for t in array.to_pylist()]


def utf8_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The concatenated UTF-8 bytes of an Arrow string column and the row offsets into them; null counts as empty."""
    array = pc.fill_null(array, "")
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    offsets = np.frombuffer(array.buffers()[1], dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = array.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def fold_of(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def bounded_sample(df, key: Column, rows: int, bound: int):
    """About ``bound`` rows of ``rows``, chosen by the hash of ``key`` alone, so the choice is the same on every run."""
    share = min(1.0, bound / max(rows, 1))
    return df if share >= 1 else df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))


def splitmix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step over a uint64 array."""
    with np.errstate(over="ignore"):
        z = x + np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))
