"""Benchmark decontamination: rare word n-grams join documents to items, then local alignment; no passage is lost on the way.

1. The n-grams are pairs of words at most 2 places apart.  A pair of an item that stands in a document in the same order
   at most 2 places apart links the item's two places.
2. An alignment gains MATCH for a matched word.  A matched word without a link has 2 or more errors to the next one,
   which cost what it gained.  So an alignment of score s has p = s / MATCH linked places, and one that starts and
   ends in linked places scores no less.  With m matches it covers 3 m - s words at most.
3. Of an item's m places any m - p + t hold t linked ones.  Those whose pairs are rarest in the documents are its seeds,
   so only rare pairs leave the documents.  They meet the seeds in a shuffle join; a stretch with t seed places goes on.
4. The texts of such stretches come once per digest; where enough linked places lie close by, Smith-Waterman decides.  The score
   is the best local alignment over that of an unchanged copy; documents with a score of at least `min_score` are contaminated.

Neither side is collected: tasks get bitmaps of at most 2^27 bits, which only spare rows that would meet nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from . import text

WORDS, MIN_SCORE = 3, 0.5
MATCH, MISMATCH, GAP = 2, -1, -1
#: How far apart linked words may be; with MATCH = 2 and errors of 1, a wider step pays for the match before it.
NEAR = 2
#: Seed places that a stretch must hold (t above): more of them mean more seeds and fewer stretches.
AGREE = 3
#: Words of a block; an item's stretch is two neighbouring blocks, doubled until a block is as long as its alignments.
BLOCK = 128
#: Bits of a bitmap at most.
MAP_BITS = 27
#: Words of stretches aligned together, and items held by a task.
HELD_WORDS, HELD_ITEMS = 100_000, 4_096


#: What `text.folded` strips among ASCII.
_PLAIN_EDGES = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c == "_"))


def _folded_hash(word: str) -> int:
    """Hash of a word in lower case without punctuation at its edges; 0 for a word of punctuation only."""
    plain = word.strip(_PLAIN_EDGES)
    if not plain.isalnum():  # letters of other kinds may have punctuation of other kinds around them
        plain = text.folded(word.encode())
    return xxhash.xxh3_64_intdigest(plain) if plain else 0


def folded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded hashes of all texts' words in a row, where each text's words end, and each word's place in its text."""
    lists = pc.ascii_split_whitespace(text.as_text(texts))
    ends = lists.offsets.to_numpy().astype(np.int64)
    codes = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
    words, code, ends = codes.dictionary.to_pylist(), codes.indices.to_numpy(), ends[1:] - ends[0]
    if "" in words:  # at the edges of a text
        keep = code != words.index("")
        code, ends = code[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
    h = np.array([xxhash.xxh3_64_intdigest(w) if w.isalnum() else _folded_hash(w) for w in map(str.lower, words)], np.uint64)[code]
    place = np.arange(len(h)) - np.repeat(text.starts_of(ends), np.diff(ends, prepend=0))
    keep = h != 0
    return h[keep], np.concatenate([[0], np.cumsum(keep)])[ends], place[keep]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: score, begin and end of the passage's words in it."""
    n = len(passage)
    steps = -GAP * np.arange(n + 1)
    best = np.zeros(n + 1, np.int64)
    begin = np.arange(n + 1)  # where the alignment that ends here began
    top = (0, 0, 0)
    for word in item:
        across = best[:-1] + np.where(passage == word, MATCH, MISMATCH)
        down = best + GAP
        new = np.maximum(down, 0)
        new[1:] = np.maximum(new[1:], across)
        start = np.where(new == 0, np.arange(n + 1), begin)
        start[1:] = np.where((new[1:] == across) & (new[1:] > 0), begin[:-1], start[1:])
        # gaps in the item: the best value to the left less one gap a word
        level = new + steps
        reach = np.maximum.accumulate(level)
        source = np.maximum.accumulate(np.where(level == reach, np.arange(n + 1), 0))
        after = reach - steps
        start = np.where(after > new, start[source], start)
        best, begin = after, start
        at = int(best.argmax())
        if best[at] > top[0]:
            top = (int(best[at]), int(begin[at]), at)
    return top


def best_scores(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """The scores of `align` for pairs of items and passages, side by side."""
    wide = np.zeros((len(passages), max(map(len, passages))), np.int64)
    for row, p in zip(wide, passages):
        row[: len(p)] = p
    words = np.full((max(map(len, items)), len(items)), -1, np.int64)
    for k, w in enumerate(items):
        words[: len(w), k] = w
    steps = -GAP * np.arange(wide.shape[1] + 1, dtype=np.int32)
    best = np.zeros((len(passages), wide.shape[1] + 1), np.int32)
    top = np.zeros(len(items), np.int32)
    for word in words:
        new = np.maximum(best + np.int32(GAP), 0)
        across = best[:, :-1] + np.where(wide == word[:, None], np.int32(MATCH), np.int32(MISMATCH))
        new[:, 1:] = np.maximum(new[:, 1:], across)
        best = np.maximum.accumulate(new + steps, 1) - steps
        np.maximum(top, best.max(1), out=top)
    return top


def pair_keys(h: np.ndarray, step: int) -> np.ndarray:
    """64-bit hashes of the words `step` places apart, at the place of the first; of the words alone for step 0."""
    return text.mixed(h[: len(h) - step] * text._MULTIPLIER + (h[step:] if step else np.uint64(0))) if step < len(h) else h[:0]


class Item:
    """What an item asks of a document."""

    def __init__(self, words: np.ndarray, n: int, min_score: float, block: int = BLOCK):
        self.words, size = words, len(words)
        least = min_score * MATCH * size
        self.whole = size < n  # found as a whole only
        #: Whether a single word may do.
        self.single = size == 1 or not self.whole and least <= MATCH
        #: Linked places that an alignment needs, the words it covers at most, and the score it must reach.
        self.places = size if self.whole else max(1, int(np.ceil(least / MATCH)))
        self.reach = size if self.whole else max(1, int(np.floor(3 * size - least)))
        self.least = MATCH * size if self.whole else least
        self.steps = (0,) if self.single else range(1, NEAR + 1)
        self.level = max(0, int(np.ceil(np.log2(self.reach / block))))
        self.keys = np.unique(np.concatenate([pair_keys(words, d) for d in self.steps]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and the keys of their pairs."""
        made = [(d, pair_keys(self.words, d)) for d in self.steps]
        places = [np.arange(len(k)) + off for d, k in made for off in ((0, d) if d else (0,))]
        return np.concatenate(places), np.concatenate([k for d, k in made for _ in ((0, d) if d else (0,))])

    def stretches(self, keys: dict[int, np.ndarray], low: int, high: int) -> Iterator[tuple[int, int, int]]:
        """Begin, end and linked places of the stretches of [low, high) that may hold an alignment."""
        linked = np.zeros(high - low, bool)
        for d in self.steps:
            if high - d > low:
                here = keys[d][low : high - d]
                at = np.searchsorted(self.keys, here)
                hit = self.keys[np.minimum(at, len(self.keys) - 1)] == here
                linked[: len(here)] |= hit
                linked[d:] |= hit
        at = np.flatnonzero(linked) + low
        if len(at) < self.places:
            return
        begins = np.flatnonzero(at[self.places - 1 :] - at[: len(at) - self.places + 1] < self.reach)
        if not len(begins):
            return
        a, z = at[begins], np.minimum(at[begins] + self.reach, high)
        first = np.flatnonzero(np.append(True, a[1:] > z[:-1]))
        for b, e in zip(a[first].tolist(), z[np.append(first[1:], len(a)) - 1].tolist()):
            yield b, e, int(np.searchsorted(at, e) - np.searchsorted(at, b))

    def copies(self, h: np.ndarray, low: int, high: int) -> np.ndarray:
        """Where the whole item stands in [low, high)."""
        count = max(0, high - low - len(self.words) + 1)
        same = np.ones(count, bool)
        for d, w in enumerate(self.words):
            same &= h[low + d : low + d + count] == w
        return np.flatnonzero(same) + low


def item_words(texts: Iterable[bytes]) -> list[np.ndarray]:
    h, ends, _ = folded_words(pa.array(texts, pa.binary()))
    return [h[a:z] for a, z in zip(text.starts_of(ends), ends)]


class Bitmap:
    """A set of 64-bit hashes, perhaps with others: one bit for each run of hashes."""

    def __init__(self, hashes: DataFrame):
        """`hashes` has one long column; some 64 bits a row up to 2^MAP_BITS, so the size has a bound at any number of rows."""
        name = hashes.columns[0]
        bits = min(MAP_BITS, max(12, int(64 * hashes.count()).bit_length()))
        slots = hashes.select(F.shiftrightunsigned(name, 64 - bits).alias("s"))
        words = slots.groupBy(F.shiftright("s", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s & 63 AS int)))").alias("b")).toPandas()
        self.shift = np.uint64(64 - bits)
        self.words = np.zeros(1 << (bits - 6), np.uint64)
        self.words[words["w"].to_numpy(np.int64)] = words["b"].to_numpy(np.int64).view(np.uint64)

    def holds(self, h: np.ndarray) -> np.ndarray:
        slot = h >> self.shift
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def _places(items: DataFrame, n: int, min_score: float, agree: int, block: int) -> DataFrame:
    """(item, place, key, spare, agree, level, single): the pairs at each place of each item, and what the item asks for."""
    schema = pa.schema([("item", pa.binary()), ("place", pa.int64()), ("key", pa.int64()), ("spare", pa.int64()), ("agree", pa.int64()), ("level", pa.int32()), ("single", pa.bool_())])

    def run(batches):
        for b in text.slices(batches):
            made = [[np.zeros(0, np.int64)] * 7]
            for k, words in enumerate(item_words(b.column("text").to_pylist())):
                if len(words):
                    item = Item(words, n, min_score, block)
                    place, key = item.links()
                    told = [len(words) - item.places, min(agree, item.places), item.level, item.single]
                    made.append([np.full(len(place), k), place, key.view(np.int64), *[np.full(len(place), x) for x in told]])
            rows = [np.concatenate(x) for x in zip(*made)]
            yield text.batch_of(schema, b.column("digest").take(pa.array(rows[0], pa.int64())), *rows[1:5], pa.array(rows[5].astype(np.int32)), pa.array(rows[6].astype(bool)))

    return items.mapInArrow(text.tidy(run, "decontam"), "item binary, place long, key long, spare long, agree long, level int, single boolean").distinct()


def _pairs(rows: DataFrame, wanted: Bitmap, single: bool, size: int, counted: bool) -> DataFrame:
    """The documents' pairs among `wanted`: (key, n) for their number if `counted`, else (key, digest, block), each once a block."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)
    fields = [("key", pa.int64()), ("n", pa.int64())] if counted else [("key", pa.int64()), ("digest", pa.binary()), ("block", pa.int64())]

    def run(batches):
        wanted = sent.value
        for b in text.slices(batches):
            h, ends, _ = folded_words(b.column("text"))
            doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            got = []
            for d in range(0 if single else 1, NEAR + 1):
                key = pair_keys(h, d)
                at = np.flatnonzero(wanted.holds(key) & (doc[: len(key)] == doc[len(doc) - len(key) :]))
                got.append((key[at].view(np.int64), at))
            key, at = (np.concatenate(x) for x in zip(*got))
            if counted:
                yield text.batch_of(pa.schema(fields), *np.unique(key, return_counts=True))
                continue
            block, doc = (at - text.starts_of(ends)[doc[at]]) // size if len(at) else at, doc[at]
            order = np.lexsort((key, block, doc))
            key, block, doc = key[order], block[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (block[1:] != block[:-1]) | (doc[1:] != doc[:-1])
            yield text.batch_of(pa.schema(fields), key[new], b.column("digest").take(pa.array(doc[new], pa.int64())), block[new])

    made = rows.select("text") if counted else rows.select("digest", "text")
    return made.mapInArrow(text.tidy(run, "decontam"), "key long, n long" if counted else "key long, digest binary, block long")


def _seeds(places: DataFrame, counts: DataFrame) -> DataFrame:
    """(key, item, place, agree, level): the pairs at an item's rarest places, as many places as any alignment must meet in `agree`.

    A place costs what its pairs bring to the join; pairs that no document holds cost nothing and are left out at the end."""
    owners = places.groupBy("key").agg(F.count(F.lit(1)).alias("_owners"))
    cost = counts.join(owners, "key").select("key", (F.col("n") * F.col("_owners")).alias("_cost"))
    ofp = places.join(cost, "key", "left").groupBy("item", "place", "spare", "agree", "level").agg(
        F.sum(F.coalesce("_cost", F.lit(0))).alias("_cost"), F.collect_list(F.when(F.col("_cost") > 0, F.col("key"))).alias("_keys"))
    rank = F.row_number().over(Window.partitionBy("item").orderBy("_cost", "place"))
    kept = ofp.withColumn("_r", rank).where(F.col("_r") <= F.col("spare") + F.col("agree"))
    return kept.select(F.explode("_keys").alias("key"), "item", "place", "agree", "level")


def _stretches(pairs: DataFrame, seeds: DataFrame) -> DataFrame:
    """(digest, item, level, regions): texts and items that share enough seed places within two neighbouring blocks."""
    met = pairs.join(seeds, "key").withColumn("_b", F.expr("shiftright(block, level)"))
    near = met.select("digest", "item", "agree", "level", "place", F.explode(F.array(F.col("_b"), F.col("_b") - 1)).alias("region"))
    enough = near.groupBy("digest", "item", "agree", "level", "region").agg(F.count_distinct("place").alias("_n")).where(F.col("_n") >= F.col("agree"))
    return enough.groupBy("digest", "item", "level").agg(F.sort_array(F.collect_list("region")).alias("regions"))


def _chosen(rows: DataFrame, wanted: Bitmap) -> DataFrame:
    """Rows whose text may be among those `wanted`."""
    sent = rows.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(sent.value.holds(b.column("mark").to_numpy().view(np.uint64))))

    return rows.mapInArrow(text.tidy(run, "decontam"), rows.schema)


def _verified(texts: DataFrame, n: int, min_score: float, block: int) -> DataFrame:
    """(digest, item, score, begin, end, seeds) of the texts and items in (digest, text, asked) whose alignment reaches the score."""
    schema = pa.schema([("digest", pa.binary()), ("item", pa.binary()), ("score", pa.float64()), ("begin", pa.int64()), ("end", pa.int64()), ("seeds", pa.int64())])

    def run(batches):
        known: dict[bytes, Item] = {}
        for b in text.slices(batches):
            h, ends, place = folded_words(b.column("text"))
            keys = {d: pair_keys(h, d) for d in range(NEAR + 1)}
            out: dict[tuple[int, bytes], tuple] = {}
            held, load = [], 0
            for doc, (start, stop, asked) in enumerate(zip(text.starts_of(ends).tolist(), ends.tolist(), b.column("asked").to_pylist())):
                for ask in asked:
                    if ask["item"] not in known:
                        if len(known) >= HELD_ITEMS:
                            known.clear()
                        known[ask["item"]] = Item(item_words([ask["words"]])[0], n, min_score, block)
                    item, size = known[ask["item"]], block << ask["level"]
                    for low, high in _joined([(max(start, start + r * size), min(stop, start + (r + 2) * size)) for r in ask["regions"]]):
                        if item.whole:
                            at = item.copies(h, low, high)
                            if len(at) and (doc, ask["item"]) not in out:
                                out[doc, ask["item"]] = (item.least, -int(at[0]), int(at[0]) + item.reach, len(at), item)
                            continue
                        for a, z, links in item.stretches(keys, low, high):
                            held.append((doc, ask["item"], item, a, z, links))
                            load += z - a
                            if load > HELD_WORDS:
                                _align(h, held, out)
                                held, load = [], 0
            _align(h, held, out)
            told = []
            for (doc, key), (score, a, z, links, item) in out.items():
                begin, end = (0, z + a) if item.whole else align(item.words, h[-a:z])[1:]
                told.append((doc, key, score / (MATCH * len(item.words)), int(place[begin - a]), int(place[end - a - 1]) + 1, links))
            doc, *rest = zip(*told) if told else [()] * 6
            yield text.batch_of(schema, b.column("digest").take(pa.array(doc, pa.int64())), *rest)

    return texts.mapInArrow(text.tidy(run, "decontam"), "digest binary, item binary, score double, begin long, end long, seeds long")


def _joined(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted stretches with those that overlap made one."""
    out: list[tuple[int, int]] = []
    for a, z in parts:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _align(h: np.ndarray, held: list[tuple], out: dict[tuple[int, bytes], tuple]) -> None:
    """Adds the best stretch of each text and item to `out` where its alignment reaches the score; ties go to the first."""
    order = sorted(held, key=lambda x: x[4] - x[3])
    for first in range(0, len(order), 256):
        some = order[first : first + 256]
        scores = best_scores([x[2].words.view(np.int64) for x in some], [h[a:z].view(np.int64) for *_, a, z, _ in some])
        for (doc, key, item, a, z, links), score in zip(some, scores.tolist()):
            if score and score >= item.least and (score, -a) > out.get((doc, key), (0, 0))[:2]:
                out[doc, key] = (score, -a, z, links, item)


def _digest(column: str) -> Column:
    return F.unhex(F.md5(column))


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, min_score: float = MIN_SCORE, agree: int = AGREE, block: int = BLOCK,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item found in it: doc_id, text_hash, item_id, score (0 to 1), begin and end (words of the document), seeds (linked places there).

    Null and empty texts match nothing; an item with fewer than `n` words is found as a whole only.  Repeated documents
    and items each give their rows.  Null ids are carried as nulls.  An empty benchmark or table gives no rows.
    """
    rows = text.text_rows(docs, id_col, text_col).select(
        F.col("doc_id").cast("long").alias("doc_id"), _digest("text").alias("digest"), "text")
    listed = cut(text.text_rows(benchmark, item_col, item_text).select(F.col("doc_id").cast("long").alias("item_id"), _digest("text").alias("item"), "text"))
    items = cut(listed.groupBy("item").agg(F.first("text").alias("text")))
    places = cut(_places(items.select(F.col("item").alias("digest"), "text"), n, min_score, agree, block))
    single = not places.where("single").isEmpty()
    counts = _pairs(rows, Bitmap(places.select("key").distinct()), single, block, True).groupBy("key").agg(F.sum("n").alias("n"))
    seeds = cut(_seeds(places, counts))
    asked = cut(_stretches(_pairs(rows, Bitmap(seeds.select("key").distinct()), single, block, False), seeds))
    marked = _chosen(rows.withColumn("mark", F.xxhash64("digest")), Bitmap(asked.select(F.xxhash64("digest").alias("mark")).distinct()))
    chosen = cut(marked.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"), "digest", "text"))
    lists = asked.join(items.withColumnRenamed("text", "words"), "item").groupBy("digest").agg(F.collect_list(F.struct("item", "words", "level", "regions")).alias("asked"))
    texts = chosen.groupBy("digest").agg(F.first("text").alias("text")).join(lists, "digest")
    found = cut(_verified(texts.select("digest", "text", "asked"), n, min_score, block))
    told = chosen.select("doc_id", "text_hash", "digest").join(found, "digest").join(listed.select("item", "item_id"), "item")
    return told.select("doc_id", "text_hash", "item_id", "score", "begin", "end", "seeds")
