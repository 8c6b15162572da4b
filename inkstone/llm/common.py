"""Shared helpers: reading tables, the word rule, hashes, tables kept in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.plans.kept import Scratch, dropped, folder, kept

#: Tables in the shared folder: kept once, dropped when nothing reads them any more.
keep, drop_kept, shared_folder = kept, dropped, folder
__all__ = ["Scratch", "WORD_PATTERN", "WordHasher", "drop_kept", "hashed_words", "keep", "mix64", "n_words", "shared_folder", "shingle_hashes", "slices", "table", "words_of"]

#: A word: a longest run without ASCII space and without the characters 9 to 13.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_UPPER_TO_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table's Parquet rows, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """UTF-8 words; bytes.split() cuts at exactly the six ASCII white-space bytes of the word rule."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(_UPPER_TO_LOWER) if lower else raw).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """A finishing permutation of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of words, remembered within a bounded dictionary."""

    def __init__(self, limit: int = 500_000):
        import xxhash

        self._digest, self._known, self._limit = xxhash.xxh64_intdigest, {}, limit

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known, digest = self._known, self._digest
        if len(known) > self._limit:
            known.clear()
        get = known.get
        out = [get(w) for w in words]
        if None in out:
            for i, x in enumerate(out):
                if x is None:
                    w = words[i]
                    out[i] = known[w] = digest(w)
        return np.array(out, dtype=np.uint64)


def hashed_words(column) -> tuple[np.ndarray, np.ndarray]:
    """WordHasher's hashes of the lower-cased words of an Arrow column of texts, text after text, and how many words each text has (null: none)."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    words = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column, "")))
    flat, sizes = words.flatten(), np.asarray(pc.list_value_length(words)).astype(np.int64)
    real = np.asarray(pc.binary_length(flat)) > 0  # white space at a text's ends parts off empty words
    if not real.all():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[real], minlength=len(sizes))
        flat = flat.filter(pa.array(real))
    told = flat.dictionary_encode()
    each = told.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64, len(each))
    return (hashes[told.indices.to_numpy()] if len(each) else hashes), sizes


#: Odd multipliers, one for each place of a shingle.
_TIMES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(word_hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all runs of `width` words in order; fewer words make one run, none makes none."""
    n = len(word_hashes)
    width = min(width, n)
    total = np.full(max(0, n - width + 1) if n else 0, width, dtype=np.uint64)
    for j in range(width):
        total += word_hashes[j : n - width + 1 + j] * _TIMES[j]
    return mix64(total)


def slices(batches: Iterator, column: str, budget: int = 4_000_000) -> Iterator:
    """Cut Arrow batches so that the strings of `column` in each piece hold about `budget` bytes, one row at least."""
    import pyarrow.compute as pc

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        if sizes.sum() <= budget:
            yield batch
            continue
        part = np.cumsum(sizes) // budget
        starts = [0, *(np.nonzero(np.diff(part))[0] + 1), batch.num_rows]
        for a, b in zip(starts[:-1], starts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
