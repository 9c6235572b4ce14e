"""Quality rules: fixed counts of a text, then a calibrated logistic regression on hashed n-grams.

Features are hashed words, hashed word pairs and hashed character runs, each as shares of its kind, so that a text's
length does not matter.  The model is fitted on a bounded sample of labelled rows in one task, calibrated on rows of the sample that
the fit did not see, and applied to Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import linear, text

#: The fit: so many labelled rows of each label, chosen by a hash of the id.
FIT_ROWS = 2000
DIMS = 1 << 18
RUNS = (2, 3, 4)
KEEP_AT = 0.5
MIN_WORDS, MAX_REPEATED = 10, 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FIRST = (np.arange(256) & 0xC0) != 0x80  # the first byte of a code point
_MASK = np.uint64(DIMS - 1)


class Slice:
    """Texts of a slice as one run of bytes and one run of words, with what the rules and features need."""

    def __init__(self, texts: pa.Array, hashes: text.WordTable):
        self.texts = texts.to_pylist()
        self.bytes = np.frombuffer(b"".join(self.texts), np.uint8)
        self.byte_ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.byte_starts = text.starts_of(self.byte_ends)
        words, code, self.ends = text.words_of(texts)
        self.starts = text.starts_of(self.ends)
        self.hashes = hashes(words)[code]

    def counts(self) -> dict[str, np.ndarray]:
        at = (self.byte_starts, self.byte_ends)
        return {
            "n_words": self.ends - self.starts,
            "word_chars": text.sums(_FIRST[self.bytes] & ~_SPACE[self.bytes], *at).astype(np.int64),
            "n_symbols": text.sums(_SYMBOL[self.bytes], *at).astype(np.int64),
            "n_dup_lines": np.array([duplicate_lines(t) for t in self.texts], np.int64),
            "n_repeat_words": self.repeated(5),
        }

    def repeated(self, n: int) -> np.ndarray:
        """Words in windows of `n` words that occur twice or more in their text."""
        count = len(self.hashes) - n + 1
        if count <= 0:
            return np.zeros(len(self.ends), np.int64)
        owner = np.repeat(np.arange(len(self.ends)), self.ends - self.starts)
        inside = np.flatnonzero(owner[:count] == owner[n - 1 :])
        window = text.ngrams(self.hashes, n)[inside] ^ text.mixed(owner[inside].astype(np.uint64))
        order = np.argsort(window)
        same = window[order][1:] == window[order][:-1]
        twice = np.zeros(len(inside), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        steps = np.zeros(len(self.hashes) + 1, np.int64)
        begin = inside[twice]
        np.add.at(steps, begin, 1)
        np.add.at(steps, begin + n, -1)
        return text.sums(np.cumsum(steps[:-1]) > 0, self.starts, self.ends).astype(np.int64)

    def features(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each kind: hashed values in a row, and where each text's values start and end."""
        pairs = text.ngrams(self.hashes, 2)
        last = np.minimum(np.maximum(self.ends - 1, self.starts), len(pairs))
        out = [(text.mixed(self.hashes) & _MASK, self.starts, self.ends), (text.mixed(pairs ^ np.uint64(7)) & _MASK, np.minimum(self.starts, last), last)]
        low = self.bytes.astype(np.uint32)
        for n in RUNS:
            count = max(0, len(low) - n + 1)
            h = np.full(count, n, np.uint32)
            for k in range(n):
                h *= np.uint32(0x01000193)
                h ^= low[k : k + count]
            h *= np.uint32(0x9E3779B1)
            end = np.maximum(self.byte_ends - n + 1, self.byte_starts)
            out.append((h >> np.uint32(32 - DIMS.bit_length() + 1), np.minimum(self.byte_starts, count), np.minimum(end, count)))
        return out

    def scores(self, weights: np.ndarray, bias: float) -> np.ndarray:
        z = np.full(len(self.ends), bias)
        for values, starts, ends in self.features():
            z += text.sums(weights[values], starts, ends) / np.maximum(1, ends - starts)
        return z

    def sparse(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's features as (index, share)."""
        kinds = self.features()
        out = []
        for k in range(len(self.ends)):
            index, share = [], []
            for values, starts, ends in kinds:
                found, times = np.unique(values[starts[k] : ends[k]], return_counts=True)
                index.append(found.astype(np.int32))
                share.append((times / max(1, ends[k] - starts[k])).astype(np.float32))
            out.append((np.concatenate(index), np.concatenate(share)))
        return out


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line and not line.isspace()] if b"\n" in data else []
    return len(lines) - len(set(lines))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, salt: str) -> DataFrame:
    """(text, label, h): at most `rows` labelled documents of each label, chosen by a hash of the id; written, so that the fit
    reads these rows only.  Of rows that repeat an id, the smallest text counts."""
    spark = docs.sparkSession
    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"), F.xxhash64(F.lit(salt), "doc_id").alias("h")).distinct()
    picked = [tuple(r) for k in (0, 1) for r in text.smallest(marked.where((F.col("label") == k) & F.col("doc_id").isNotNull()), rows, "doc_id")]
    few = spark.createDataFrame(picked, marked.schema).distinct()  # at most 2 x `rows` rows
    found = docs.where(F.col("text").isNotNull()).select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(few), "doc_id")
    return cut(found.groupBy("doc_id", "label", "h").agg(F.min("text").alias("text")).select("text", "label", "h"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = FIT_ROWS) -> dict | None:
    """The model: weights, bias, calibration; None if the labelled rows lack one of the labels.

    `docs` (doc_id, text) and `labels` (doc_id, `label` 0 or 1); at most `rows` rows of each label are used, in one task.
    """

    def run(batches):
        hashes, found, labels_, order = text.plain_hash(), [], [], []
        for b in text.slices(batches, 1 << 20):
            found += Slice(b.column("text"), hashes).sparse()
            labels_ += b.column("label").to_pylist()
            order += b.column("h").to_pylist()
        y, part = np.array(labels_, np.int64), np.array(order, np.int64) % 4 == 0  # a quarter calibrates
        if len(set(y[~part])) < 2 or len(set(y[part])) < 2:
            return
        rest = [found[k] for k in np.flatnonzero(part)]
        learn = [found[k] for k in np.flatnonzero(~part)]
        found.clear()
        w, bias = linear.fit_sparse(learn, y[~part], DIMS)
        z = np.array([w[i] @ v + bias for i, v in rest])
        a, b0 = linear.calibrate(z, y[part])
        yield text.batch_of(pa.schema([("w", pa.binary()), ("bias", pa.float64()), ("a", pa.float64()), ("b", pa.float64())]), [w.astype(np.float32).tobytes()], [bias], [a], [b0])

    got = sample(docs, labels, label, rows, "quality").repartition(1).sortWithinPartitions("h", "label", "text").mapInArrow(text.tidy(run, "quality"), "w binary, bias double, a double, b double").first()
    return got and {"w": bytes(got["w"]), "bias": got["bias"], "a": got["a"], "b": got["b"]}


def assess(docs: DataFrame, model: dict | None, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept, and the columns in `keep`.

    A null or empty text has no words and fails the base rules.  `quality` is the calibrated probability of label 1, 1 without a
    model; a text is kept if it passes the base rules and has `quality` of at least `keep_at`.
    """
    rows = text.text_rows(docs, id_col, text_col, keep)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights = np.frombuffer(sent.value["w"], np.float32) if sent.value else None
        hashes = text.plain_hash()
        for b in text.slices(batches, 1 << 20):
            s = Slice(b.column("text"), hashes)
            counts = s.counts()
            n, again = counts["n_words"], counts["n_repeat_words"]
            failed = (n < MIN_WORDS) | (100 * again > MAX_REPEATED * n)
            p = np.ones(len(n)) if weights is None else linear.sigmoid(sent.value["a"] * s.scores(weights, sent.value["bias"]) + sent.value["b"])
            told = [*[(c, pa.int64()) for c in names], ("base_failed", pa.bool_()), ("quality", pa.float64()), ("kept", pa.bool_())]
            yield text.with_rides(b, told, *[counts[c] for c in names], failed, p, ~failed & (p >= keep_at))

    made = rows.mapInArrow(text.tidy(run, "quality"), text.ddl(rows, *[f"{c} long" for c in names], "base_failed boolean", "quality double", "kept boolean"))
    return text.restored(made, keep, "doc_id", *names, "base_failed", "quality", "kept")
