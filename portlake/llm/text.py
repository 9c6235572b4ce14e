"""Texts inside a task: Arrow slices of bounded size, words, word hashes and n-gram hashes."""

from __future__ import annotations

import ctypes
import gc
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 8 << 20
CACHE_WORDS = 400_000
#: Longer keys are worked out each time they come, so a table of keys has a bound in bytes.
KEY_BYTES = 64
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: The work that this worker process did last, and what empties the tables that it keeps between tasks.
_last: list[str] = [""]
KEPT: list[Callable[[], None]] = []


def give_back() -> None:
    """Return freed memory to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def turn_to(work: str) -> None:
    """Drop what was kept for another kind of work."""
    if _last[0] != work:
        _last[0] = work
        for empty in KEPT:
            empty()
        give_back()


def tidy(run: Callable, work: str) -> Callable:
    """`run` for `mapInArrow`, in workers that serve several stages: tables kept by another kind of work are dropped before a task, and
    freed memory goes back to the system before and after it.  Tables of the same work stay for the next task."""

    def told(batches):
        turn_to(work)
        try:
            yield from run(batches)
        finally:
            give_back()

    return told


def text_rows(docs: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text as UTF-8 bytes): a null text is an empty one; other columns stay out, whatever their names.

    Columns named in `keep` ride along as keep_0, keep_1, ...; `restored` gives them their names back.
    """
    more = [F.col(f"`{c}`").alias(f"keep_{k}") for k, c in enumerate(keep)]
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"), *more)


def restored(made: DataFrame, keep: tuple[str, ...], *own: str) -> DataFrame:
    """The columns `own` and those that rode along, under their names."""
    return made.select(*own, *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)])


def ddl(rows: DataFrame, *more: str) -> str:
    """Schema of `rows` without the text, and more fields."""
    return ", ".join([*[f"{c} {t}" for c, t in rows.dtypes if c != "text"], *more])


def with_rides(batch: pa.RecordBatch, names: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    """A batch of everything but the text in `batch`, and more columns."""
    kept = [n for n in batch.schema.names if n != "text"]
    schema = pa.schema([batch.schema.field(n) for n in kept] + [pa.field(*n) for n in names])
    return batch_of(schema, *[batch.column(n) for n in kept], *columns)


def text_hash(text_col: str = "text") -> Column:
    """Tells texts under one id apart; a null text is an empty one."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def in_fold(id_col: str = "doc_id") -> Column:
    """True for rows that models may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 != 1


def smallest(rows: DataFrame, n: int, *then: str) -> list:
    """The `n` rows with the smallest `h`, a 64-bit hash, ties by the columns `then`.

    Only rows below a hash that some 4 n of them stay under are sorted, so one task meets a fixed number of rows at every
    size of the table.  Rows that repeat a key share its hash; if too few others are left, the limit is raised.
    """
    total = rows.count()
    share = min(1.0, (4 * n + 200) / max(1, total))
    while True:
        below = rows.where(F.col("h") < int((2 * share - 1) * 2**63)) if share < 1 else rows
        got = below.orderBy("h", *then).limit(n).collect()
        if len(got) == n or share >= 1:
            return got
        share = min(1.0, 8 * share)


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows with about `limit` bytes of text each; a longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """Arrow batch from columns in the order of `schema`."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def as_text(texts: pa.Array) -> pa.Array:
    """UTF-8 bytes as an Arrow string array; bytes that are no UTF-8 become replacement characters."""
    try:
        return texts.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def coded(lists: pa.ListArray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Lists of words as (distinct words, number of each word in a row, where each list ends)."""
    ends = lists.offsets.to_numpy().astype(np.int64)
    codes = lists.values.dictionary_encode()
    return codes.dictionary.cast(pa.binary()).to_pylist(), codes.indices.to_numpy()[ends[0] : ends[-1]], ends[1:] - ends[0]


def words_of(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of the texts: the distinct ones, the number of each in a row, and where each text's words end."""
    words, code, ends = coded(pc.ascii_split_whitespace(as_text(texts)))  # Arrow's ASCII white space is exactly these characters
    if b"" in words:  # at the edges of a text
        keep = code != words.index(b"")
        ends = np.concatenate([[0], np.cumsum(keep)])[ends]
        code = code[keep]
    return words, code, ends


class WordTable:
    """A number for each distinct word, computed once per task while the table has room; words above `KEY_BYTES` are never kept."""

    def __init__(self, value, dtype, limit: int = CACHE_WORDS):
        self.value, self.dtype, self.limit, self.known = value, dtype, limit, {}

    def values(self, words: list[bytes]) -> list:
        new = [w for w in words if w not in self.known and len(w) <= KEY_BYTES]
        if len(new) + len(self.known) > self.limit:
            self.known, old = {}, self.known
            self.known.update([(w, old[w]) for w in words if w in old])
        value, known = self.value, self.known
        known.update([(w, value(w)) for w in new])
        return [known[w] if w in known else value(w) for w in words]

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.array(self.values(words), self.dtype)


def sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of stretches of `values`, each on its own, so that a sum doesn't depend on what stands beside it."""
    out = np.zeros(len(ends))
    some = np.flatnonzero(ends > starts)
    if len(some):
        cuts = np.stack([starts[some], ends[some]], 1).ravel()
        out[some] = np.add.reduceat(np.append(values.astype(np.float64), 0.0), cuts)[::2]
    return out


def plain_hash() -> WordTable:
    """64-bit hashes of words as they stand."""
    return WordTable(xxhash.xxh3_64_intdigest, np.uint64)


_EDGES = re.compile(r"^\W+|\W+$")


def folded(word: bytes) -> str:
    """Lower case without punctuation at the edges; empty if nothing is left."""
    return _EDGES.sub("", word.decode("utf-8", "replace").lower())


def mixed(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of `n` neighbouring entries of `h`."""
    count = max(0, len(h) - n + 1)
    out = h[:count].copy()
    for k in range(1, n):
        out *= _MULTIPLIER
        out += h[k : k + count]
    return mixed(out)


def starts_of(ends: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), ends[:-1]]) if len(ends) else ends
