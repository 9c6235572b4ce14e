"""Phrases that stand together more often than their parts: counts from FM-indexes of shards, summed across shards.

1. A task turns its documents into shards of bounded size, one language each, and writes each shard's words and
   its sequence of word numbers.
2. The index of a shard gives its words and word pairs with their counts.  They are summed over all shards under a hash, each
   count cut off at the smallest count that matters; what reaches it goes back, by its number, to the shards that hold it.
   Two pairs under one hash can only let too much through, never too little.
3. Each shard is indexed in both directions and its patterns are extended by a word at a time, to the left and to the
   right in turn, where the new pair came back from step 2: no phrase that is frequent overall is missed.
4. Phrases are summed over the shards by their text.  Parts and longer phrases of a frequent phrase meet in joins of the
   frequent phrases alone, and ranks come from a range-partitioned sort.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..ordered import running
from ..session import cut
from . import text
from .fmindex import BREAK, BothWays, OneWay

MIN_COUNT, MAX_WORDS, TOP, SHARE = 30, 4, 2000, 80
#: Words of a shard; how many shards' worth of words a task has open; bytes of the table that a task turns into shards.
SHARD_WORDS, OPEN_SHARDS, TASK_BYTES = 4_000_000, 6, 64 << 20
#: Word numbers, and words of the vocabulary, in a row of a shard; level of their compression.
CHUNK, LEVEL = 4096, 1
UNKNOWN = "und"
_FOLD = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c | 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS, _CODES, _LIVE = 0, 1, 2
_ROWS = [("kind", pa.int32()), ("shard", pa.int64()), ("lang", pa.string()), ("seq", pa.int32()), ("n", pa.int64()), ("data", pa.binary())]
#: Bits of a shard's number within its task, and of a word or pair within its shard.
_SHARD_BITS, _PLACE_BITS = 14, 26
#: Bits of a hash, and of the count beside it: 48 bits part far more pairs than a corpus holds.
_HASH_BITS, _COUNT_BITS = 48, 15


def packed(codes: np.ndarray) -> bytes:
    """Word numbers by bytes of equal weight, compressed."""
    return zstandard.compress(np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes(), LEVEL)


def unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<i4").ravel()


def pieces(texts: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct words, and all texts as one row of word numbers in which 0 ends each piece (words count from 1)."""
    plain = text.as_text(pa.array([t.translate(_FOLD).replace(b"\n", b" \n ") + b" \n" for t in texts.to_pylist()], pa.binary()))
    words, code, _ = text.coded(pc.split_pattern(plain, " "))
    number = np.arange(1, len(words) + 1)
    if b"\n" in words:
        number[words.index(b"\n")] = BREAK
    if b"" in words:
        number[words.index(b"")] = -1
    code = number[code]
    code = code[code >= 0]
    return words, code[(code != BREAK) | np.append(True, code[:-1] != BREAK)]  # breaks in a row are one


class Shard:
    """Documents of one language as word numbers."""

    def __init__(self, lang: str):
        self.lang, self.number, self.parts, self.size = lang, {}, [np.zeros(1, np.int32)], 0

    def add(self, texts: pa.Array) -> int:
        words, code = pieces(texts)
        used, place = np.unique(code, return_inverse=True)
        mine = np.array([self.number.setdefault(words[k - 1], len(self.number) + 1) if k else BREAK for k in used.tolist()], np.int32)
        self.parts.append(mine[place])
        self.size += len(code)
        return len(code)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        """The vocabulary, with the number of words in the first row, and the word numbers."""
        schema = pa.schema(_ROWS)
        codes, words = np.concatenate(self.parts), list(self.number)
        if not words:
            return
        count = int((codes != BREAK).sum())
        chunk = [zstandard.compress(b" ".join(words[k : k + CHUNK]), LEVEL) for k in range(0, len(words), CHUNK)]
        m = len(chunk)
        yield text.batch_of(schema, np.full(m, _WORDS), np.full(m, shard), [self.lang] * m, np.arange(m), [count] + [0] * (m - 1), chunk)
        for k in range(0, len(codes), 64 * CHUNK):
            chunk = [packed(codes[a : a + CHUNK]) for a in range(k, min(k + 64 * CHUNK, len(codes)), CHUNK)]
            m = len(chunk)
            yield text.batch_of(schema, np.full(m, _CODES), np.full(m, shard), [self.lang] * m, np.arange(m) + k // CHUNK, np.zeros(m, np.int64), chunk)


def tasks(docs: DataFrame) -> int:
    """How many tasks make the shards: one for `TASK_BYTES` of the table as Spark knows its size, at least one a core.

    The more text a task has of a language, the fewer counts of the same pair travel."""
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), 1 << 20)


def shards(docs: DataFrame, lang_col: str, text_col: str, shard_words: int) -> DataFrame:
    """The rows of all shards; a shard never leaves its task before it is whole.

    A language's shard is closed when it is full itself, not when all languages together are: each shard that holds a
    frequent phrase counts it in a row of its own, so shards of parts of a language make several times the rows.
    """
    rows = docs.coalesce(tasks(docs)).select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))

    def run(batches):
        base, made = TaskContext.get().partitionId() << _SHARD_BITS, 0
        open_: dict[str, Shard] = {}
        for b in text.slices(batches, 4 << 20):
            for lang in b.column("lang").unique().to_pylist():
                open_.setdefault(lang, Shard(lang)).add(b.column("text").filter(pc.equal(b.column("lang"), lang)))
            largest = max(open_, key=lambda name: open_[name].size, default=None)
            while open_ and (open_[largest].size >= shard_words or sum(s.size for s in open_.values()) >= OPEN_SHARDS * shard_words):
                yield from open_.pop(largest).rows(base + made)
                made += 1
                largest = max(open_, key=lambda name: open_[name].size, default=None)
        for shard in open_.values():
            yield from shard.rows(base + made)
            made += 1
        if made > 1 << _SHARD_BITS:
            raise ValueError("too many shards in one task: read the table in more parts")

    return rows.mapInArrow(run, "kind int, shard long, lang string, seq int, n long, data binary")


class Parts:
    """A shard's rows put together: its language, words, word numbers, and what came back to it."""

    def __init__(self, held: dict):
        self.lang, self.words = held["lang"], b" ".join([zstandard.decompress(c) for c in held[_WORDS]]).split(b" ")
        self.codes = np.concatenate([unpacked(c) for c in held[_CODES]])
        self.live = np.concatenate(held[_LIVE]) if _LIVE in held else np.zeros(0, np.int64)


def by_shard(batches) -> Iterator[tuple[int, Parts]]:
    """(shard, its parts) from rows in the order of (shard, kind, seq)."""
    shard, held = None, {}
    for b in batches:
        which, kind = b.column("shard").to_numpy(), b.column("kind").to_numpy()
        edges = np.flatnonzero(np.append(True, (which[1:] != which[:-1]) | (kind[1:] != kind[:-1]))) if len(which) else np.zeros(0, np.int64)
        for a, z in zip(edges.tolist(), [*edges[1:].tolist(), len(which)]):
            if which[a] != shard:
                if held:
                    yield shard, Parts(held)
                shard, held = int(which[a]), {}
            if kind[a] == _LIVE:
                held.setdefault(_LIVE, []).append(b.column("n").slice(a, z - a).to_numpy().copy())
            else:
                held["lang"] = b.column("lang")[a].as_py()
                held.setdefault(int(kind[a]), []).extend(b.column("data").slice(a, z - a).to_pylist())
    if held:
        yield shard, Parts(held)


def dealt(rows: DataFrame) -> DataFrame:
    return rows.select("kind", "shard", "lang", "seq", "n", "data").repartition("shard").sortWithinPartitions("shard", "kind", "seq")


def grams(made: DataFrame, least: int) -> DataFrame:
    """(x, at): a hash of each word and word pair of each shard with its count (at most `least`), and its shard and number there."""
    schema = pa.schema([("x", pa.int64()), ("at", pa.int64())])
    if least >= 1 << _COUNT_BITS:
        raise ValueError(f"counts from {1 << _COUNT_BITS} on are not told apart here")

    def run(batches):
        for shard, parts in by_shard(batches):
            symbols = len(parts.words) + 1
            each = np.bincount(parts.codes, minlength=symbols)
            of, before, _, n, _ = OneWay(parts.codes, 1).extensions((np.cumsum(each) - each)[1:], each[1:], symbols)
            hashes = np.array([0, *[xxhash.xxh3_64_intdigest(w) for w in parts.words]], np.uint64)
            salt = np.uint64(xxhash.xxh3_64_intdigest(parts.lang.encode()))
            h = text.mixed(hashes + salt)
            h = np.concatenate([h[1:], text.mixed(h[before] + hashes[of + 1] * np.uint64(3))]) >> np.uint64(64 - _HASH_BITS)
            x = h.astype(np.int64) << _COUNT_BITS | np.minimum(np.concatenate([each[1:], n]), least)
            for k in range(0, len(x), 100_000):
                yield text.batch_of(schema, x[k : k + 100_000], shard << _PLACE_BITS | np.arange(k, min(k + 100_000, len(x))))

    return dealt(made).mapInArrow(run, "x long, at long")


def enumerated(parts: Parts, max_words: int) -> Iterator[tuple]:
    """(words of the phrase, phrase, n, n_left, n_right) as arrays, for all phrases whose words and neighbouring pairs are live."""
    symbols = len(parts.words) + 1
    index = BothWays(parts.codes, symbols, max_words)
    names = pa.array([b"", *parts.words], pa.binary())
    live = np.sort(parts.live)
    p = index.single(live[live < symbols - 1] + 1)
    pairs = np.zeros(0, np.int64)
    for length in range(1, max_words + 1):
        if length == 2:  # in the order in which `grams` numbered them
            p = index.extended(index.single(np.arange(1, symbols)), True).where(live[live >= symbols - 1] - (symbols - 1))
            pairs = np.sort(p.words[0].astype(np.int64) << 32 | p.words[1])
        elif length > 2:
            leftwards = length % 2 == 0
            p = index.extended(p, leftwards)
            new = p.words[0].astype(np.int64) << 32 | p.words[1] if leftwards else p.words[-2].astype(np.int64) << 32 | p.words[-1]
            p = p.where(pairs[np.minimum(np.searchsorted(pairs, new), len(pairs) - 1)] == new)
        if not len(p.size):
            return
        columns = [names.take(pa.array(w)) for w in p.words]
        phrase = columns[0] if length == 1 else pc.binary_join_element_wise(*columns, pa.scalar(b" ", pa.binary()))
        yield length, text.as_text(phrase), p.size, *index.inner(p)


def phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, lang_col: str = "lang", text_col: str = "text", shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f, n_left, n_right) of all phrases of up to `max_words` words that occur `min_count` times,
    and (lang, n): all words of a language.  n_left and n_right count the occurrences with a word before or after them."""
    made = cut(shards(docs, lang_col, text_col, shard_words))
    totals = made.where(F.col("kind") == _WORDS).groupBy("lang").agg(F.sum("n").alias("n"))
    h = F.shiftright("x", _COUNT_BITS)
    found = grams(made, min_count).repartition(h)  # two numbers a row travel; hash and count are parted behind the shuffle
    reached = found.withColumn("f", F.sum(F.col("x").bitwiseAND((1 << _COUNT_BITS) - 1)).over(Window.partitionBy(h))).where(F.col("f") >= min_count)
    live = reached.select(
        F.lit(_LIVE).alias("kind"), F.shiftright("at", _PLACE_BITS).alias("shard"), F.lit(None).cast("string").alias("lang"), F.lit(0).alias("seq"),
        F.col("at").bitwiseAND((1 << _PLACE_BITS) - 1).alias("n"), F.lit(None).cast("binary").alias("data"))
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("words", pa.int32()), ("n", pa.int64()), ("n_left", pa.int64()), ("n_right", pa.int64())])

    def run(batches):
        for _, parts in by_shard(batches):
            if len(parts.live):
                for length, phrase, n, left, right in enumerated(parts, max_words):
                    for k in range(0, len(n), 100_000):
                        m = len(n[k : k + 100_000])
                        yield text.batch_of(schema, [parts.lang] * m, phrase.slice(k, m), np.full(m, length), n[k : k + m], left[k : k + m], right[k : k + m])

    found = dealt(made.unionByName(live)).mapInArrow(run, "lang string, phrase string, words int, n long, n_left long, n_right long")
    summed = found.groupBy("lang", "phrase").agg(F.first("words").alias("words"), F.sum("n").alias("f"), F.sum("n_left").alias("n_left"), F.sum("n_right").alias("n_right"))
    return cut(summed.where(F.col("f") >= min_count)), totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, share: int = SHARE, lang_col: str = "lang", text_col: str = "text",
                 shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score, n_left, n_right: the first `top` phrases of each language.

    a is how often the phrase occurs; of its cuts in two, that with the lowest score floor(2000000 a / (l + r)) counts, the
    first one of equals; l and r are the counts of its parts, n the words of the language.  A phrase inside a longer one of
    at most `max_words` words that occurs at least `share` percent as often is left out.

    Texts are lower-cased in A-Z and cut at `[.,;:!?\\x0A-\\x0D]`; phrases do not cross such a cut.  A null text is empty, a null
    language `und`.  Repeated rows count as often as they stand; no column but the two is read.  An empty table gives no rows.
    """
    known, totals = phrases(docs, min_count, max_words, lang_col, text_col, shard_words)
    whole = F.split("phrase", " ")
    run_of = lambda begin, size: F.concat_ws(" ", F.slice("w", begin, size))
    long = known.where("words > 1").withColumn("w", whole)
    cuts = long.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "w", "words")
    cuts = cuts.select("lang", "phrase", "a", "k", run_of(F.lit(1), F.col("k")).alias("head"), run_of(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    count = known.select("lang", "phrase", "f")
    cuts = cuts.join(count.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"]).join(count.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("CAST(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(19, 0)) DIV (CAST(l AS DECIMAL(19, 0)) + CAST(r AS DECIMAL(19, 0))) AS BIGINT)")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inner = F.expr("flatten(transform(sequence(2, words - 1), s -> transform(sequence(1, words - s + 1), b -> concat_ws(' ', slice(w, b, s)))))")
    around = long.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("around"))
    left_out = F.expr(f"CAST(100 AS DECIMAL(3, 0)) * CAST(around AS DECIMAL(19, 0)) >= CAST({int(share)} AS DECIMAL(3, 0)) * CAST(a AS DECIMAL(19, 0))")
    stay = scored.join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | ~left_out)
    stay = stay.join(known.select("lang", "phrase", "n_left", "n_right"), ["lang", "phrase"]).select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"), "n_left", "n_right")
    ranked = running(stay, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]).where(F.col("rn") <= top).drop("n")
    # one row a language on this side, however long the table
    return ranked.join(totals, "lang").select("lang", F.col("rn").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "n_left", "n_right")
