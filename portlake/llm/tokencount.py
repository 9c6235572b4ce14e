"""Token counts without ids: pieces per distinct pre-token, joined to the pre-tokens of each document.

1. Every task lists its distinct pre-tokens with their frequencies; one sum per pre-token gives the vocabulary.
2. The library counts the pieces of each distinct pre-token once.
3. The most frequent pre-tokens (at most a fixed number) are joined inside the tasks; all others through a shuffle on
   the pre-token, which no longer holds any frequent, hence hot, key.
4. Sums per document.
"""

from __future__ import annotations

import os
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import text
from .vocab import chunks, word_rule

FREQUENT = 200_000
FREQUENT_LENGTH = 64
SLICE_BYTES = 4 << 20
#: Below this code point all libraries agree on what a letter is.
_LEAD, _BEYOND = " ", "\u0250"


class PreTokens:
    """The library's own pre-tokens of whole texts, with the cuts of a distinct word made once per worker."""

    def __init__(self, path: str, limit: int = 150_000):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library, self.rule, self.limit = Tokenizer.from_file(path), word_rule(path), limit
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.known: dict[bytes, tuple[str, ...]] = {}

    def cut(self, part: str) -> tuple[str, ...]:
        """Pre-tokens of a stretch of text; an added token inside it stands for itself."""
        if any(s in part for s in self.specials):
            at, special = min((part.find(s), s) for s in self.specials if s in part)
            return (*self.cut(part[:at]), special, *self.cut(part[at + len(special) :]))
        norm = self.library.normalizer.normalize_str(part) if self.library.normalizer else part
        if not self.library.pre_tokenizer or self.rule == "whole":
            return (part,)
        if self.rule == "bare":
            return tuple(w.decode() for w in part.encode().split())
        return tuple(norm[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(norm))

    def count(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pre-tokens, and for each text and pre-token in it: text, number of the pre-token, frequency."""
        keys, code, ends = chunks(texts, self.rule)
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        pairs, times = np.unique(doc * len(keys) + code, return_counts=True)
        doc, code = np.divmod(pairs, max(1, len(keys)))
        if len(self.known) + len(keys) > self.limit:
            self.known = {k: self.known[k] for k in keys if k in self.known}
        number: dict[str, int] = {}
        flat: list[int] = []
        sizes = np.empty(len(keys), np.int64)
        for k, key in enumerate(keys):
            parts = self.known.get(key)
            if parts is None:
                word = key.decode("utf-8", "replace")
                body = word[1:] if word[:1] == _LEAD else word
                if self.rule == "spaced" and body.isalpha() and max(body) < _BEYOND:
                    parts = (word,)  # letters only: one pre-token
                else:
                    parts = self.cut(word)
                    if len(key) <= text.KEY_BYTES:
                        self.known[key] = parts
            sizes[k] = len(parts)
            flat += [number.setdefault(p, len(number)) for p in parts]
        begin, size = np.cumsum(sizes) - sizes, sizes[code]
        stop = np.cumsum(size)
        piece = np.array(flat, np.int64)[np.repeat(begin[code] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)]
        pairs, back = np.unique(np.repeat(doc, size) * max(1, len(number)) + piece, return_inverse=True)
        doc, piece = np.divmod(pairs, max(1, len(number)))
        return list(number), doc, piece, np.bincount(back, np.repeat(times, size), len(pairs)).astype(np.int64)


@lru_cache(maxsize=2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def vocabulary_of(rows: DataFrame, path: str, room: int = 300_000) -> DataFrame:
    """(piece, n): each distinct pre-token with its frequency over all texts."""
    schema = pa.schema([("piece", pa.string()), ("n", pa.int64())])

    def run(batches):
        seen: Counter = Counter()
        for b in text.slices(batches, SLICE_BYTES):
            pieces, _, piece, n = pre_tokens(path).count(b.column("text"))
            for p, k in zip(pieces, np.bincount(piece, n, len(pieces)).astype(np.int64).tolist()):
                seen[p] += k
            if len(seen) > room:
                yield text.batch_of(schema, list(seen), list(seen.values()))
                seen = Counter()
        if seen:
            yield text.batch_of(schema, list(seen), list(seen.values()))

    return rows.select("text").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def piece_counts(pieces: DataFrame, path: str) -> DataFrame:
    """Adds `tokens`: how many ids the library gives a pre-token; each is encoded once."""
    schema = pa.schema([("piece", pa.string()), ("n", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        library = pre_tokens(path).library
        for b in batches:
            ids = library.encode_batch_fast(b.column("piece").to_pylist(), add_special_tokens=False)
            yield text.batch_of(schema, b.column("piece"), b.column("n"), [len(e) for e in ids])

    return pieces.mapInArrow(run, "piece string, n long, tokens long")


def most_frequent(counted: DataFrame, room: int) -> DataFrame:
    """(piece, tokens) of the pre-tokens above a frequency that at most `room` of them reach.

    The frequency comes from counts on a logarithmic scale, some hundred rows; only what lies above it leaves Spark."""
    short = counted.where(F.length("piece") <= FREQUENT_LENGTH).withColumn("step", F.floor(16 * F.log("n")))
    steps = sorted(((r["step"], r["count"]) for r in short.groupBy("step").count().collect()), reverse=True)
    at, held = None, 0
    for step, count in steps:
        held += count
        if held > room:
            break
        at = step
    return short.where(F.lit(False) if at is None else F.col("step") >= at).select("piece", "tokens")


def count_tokens(docs: DataFrame, vocabulary: str, frequent: int = FREQUENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens.

    A null text counts as empty, with no tokens.  Strings of added tokens inside a text count as the library
    counts them.  Rows that repeat an id and text come back as often as they came; a null id is kept.  Texts
    of any length are counted whole.
    """
    rows = text.text_rows(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    counted = cut(piece_counts(vocabulary_of(rows, vocabulary), vocabulary))
    top = most_frequent(counted, frequent).toPandas()
    common = rows.sparkSession.sparkContext.broadcast(dict(zip(top["piece"], map(int, top["tokens"]))))
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_bytes", pa.int64()), ("copies", pa.int64()), ("piece", pa.string()), ("rare", pa.bool_()), ("n", pa.int64())])

    def run(batches):
        for b in text.slices(batches, SLICE_BYTES):
            pieces, doc, piece, n = pre_tokens(vocabulary).count(b.column("text"))
            each = np.fromiter((common.value.get(p, -1) for p in pieces), np.int64, len(pieces))[piece]
            rows_ = len(b)
            sure = np.bincount(doc, np.where(each >= 0, n * each, 0), rows_).astype(np.int64)
            rare = np.flatnonzero(each < 0)
            at = pa.array(np.concatenate([np.arange(rows_), doc[rare]]))
            own = pa.array([str(d) for d in b.column("doc_id").to_pylist()], pa.string())
            names = pa.array([pieces[p] for p in piece[rare].tolist()], pa.string())
            flag = np.arange(rows_ + len(rare)) >= rows_
            yield text.batch_of(
                schema, b.column("doc_id").take(at), b.column("digest").take(at), pc.binary_length(b.column("text")).cast(pa.int64()).take(at),
                (~flag).astype(np.int64), pa.concat_arrays([own, names]), flag, np.concatenate([sure, n[rare]]))

    parts = rows.withColumn("digest", F.xxhash64("text")).mapInArrow(run, "doc_id long, digest long, n_bytes long, copies long, piece string, rare boolean, n long")
    # a document's own row carries the tokens of its frequent pre-tokens; it matches nothing and is dealt out by its id
    summed = parts.join(counted.select("piece", F.lit(True).alias("rare"), "tokens"), ["piece", "rare"], "left").groupBy("doc_id", "digest", "n_bytes").agg(
        F.sum("copies").alias("copies"), F.sum(F.col("n") * F.coalesce("tokens", F.lit(1))).alias("n_tokens"))
    return summed.select("doc_id", "n_bytes", F.expr("n_tokens div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy")
