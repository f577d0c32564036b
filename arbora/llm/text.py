"""Expressions for words and lines, and slices of batches, that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word separators: space and the ASCII controls tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words of a text, in order; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def joined_hashes(hashes: Column, step: int) -> Column:
    """Hashes of windows twice as long: each with the one ``step`` words further on."""
    return bind(hashes, lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - step, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(a, i + step))))


def window_hashes(w: Column, steps: tuple[int, ...]) -> Column:
    """Hashes of every window of ``w``; steps (1, 2, 4) make windows of 8 words."""
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    for step in steps:
        hashes = joined_hashes(hashes, step)
    return hashes


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a text or binary column; a row is never cut."""
    begin, size = 0, 0
    for i, text in enumerate(batch.column(column)):
        size += len(text.as_buffer()) if text.is_valid else 0
        if size >= most:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0
    if begin < batch.num_rows:
        yield batch.slice(begin)
