"""64-bit SimHash fingerprints of word shingles, computed in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shingles whose bits are summed at once, so that memory does not grow with a text.
AT_ONCE = 1 << 15


def fingerprint(text: str | None, size: int) -> int:
    """The SimHash of a text's shingles of ``size`` words, A-Z lower-cased, by XXH64 with seed 42.

    A bit is 1 if it is 1 in over half the hashes; a text without words has 0, one with fewer words than a shingle has
    one shingle of them all."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones = np.zeros(64, np.int64)
    for a in range(0, n, AT_ONCE):
        hashes = np.array([xxh64_intdigest(b" ".join(words[i : i + size]), 42) for i in range(a, min(n, a + AT_ONCE))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > n))


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, size) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id and fp (as a signed long) of every row of (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_prints(size), "doc_id long, fp long")
