"""Join of documents by the Jaccard similarity of their word shingles: MinHash bands, then exact counts.

1. Each document becomes a set of hashed shingles, a digest of that set and a MinHash signature of
   `trees` x `depth` values.  Documents with equal sets are one text from here on.
2. A tree is one stretch of the signature, compared by a prefix of fixed depth: the deepest at which two texts at the
   threshold share one in some tree with the target probability.  So this is banding; a pair that shares a deeper
   prefix shares this one.  Each shared prefix ties its texts to one of them, and the tied texts form candidate groups.
3. The sets of a candidate group are compared exactly, all with all, in blocks of bounded size: a task
   multiplies the incidence matrices of two blocks and returns sums and a spanning forest, never pairs.
4. The verified links make the classes.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import text
from .graph import components

WORDS, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 8, 0.995
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 1 << 20


def prefix_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix by which two sets of similarity `threshold` meet in some tree with probability `recall`."""
    for d in range(depth, 0, -1):
        if 1 - (1 - threshold**d) ** trees >= recall:
            return d
    raise ValueError("too few trees for this recall")


def multipliers(n: int) -> np.ndarray:
    """Odd 32-bit factors, one for each value of a signature."""
    return text.mixed(np.arange(1, n + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)


def shingles(texts: pa.Array, hashes: text.WordTable, n: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct runs of `n` words; a shorter text is one run, one without words has none."""
    words, code, ends = text.words_of(texts)
    h = hashes(words)[code]
    grams = text.ngrams(h, n)
    out = []
    for a, b in zip(text.starts_of(ends), ends):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        else:
            out.append(text.ngrams(h[a:b], int(b - a)) if b > a else np.zeros(0, np.uint64))
    return out


def signature(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    low = (found & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(low), 1024):
        np.minimum(out, (factors[:, None] * low[None, k : k + 1024]).min(1), out=out)
    return out


def prints(docs: DataFrame, n: int, values: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, digest, signature) of every row of (doc_id, text_hash, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("signature", pa.binary())])

    def run(batches):
        hashes, factors = text.plain_hash(), multipliers(values)
        for b in text.slices(batches):
            sets = shingles(b.column("text"), hashes, n)
            yield text.batch_of(schema, b.column("doc_id"), b.column("text_hash"), [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [signature(s, factors).tobytes() for s in sets])

    return docs.mapInArrow(text.tidy(run, "ngram_join"), "doc_id long, text_hash long, n_shingles long, digest binary, signature binary")


def candidates(found: DataFrame, threshold: float, trees: int, depth: int, recall: float) -> DataFrame:
    """(a, b): texts that share a prefix, each tied to the smallest digest under that prefix."""
    keep = prefix_depth(threshold, trees, depth, recall)
    prefix = [F.xxhash64(F.lit(t), F.substring("signature", 4 * depth * t + 1, 4 * keep)) for t in range(trees)]
    nodes = found.where("n_shingles > 0").select("digest", F.explode(F.array(*prefix)).alias("prefix"))
    hubs = nodes.groupBy("prefix").agg(F.min("digest").alias("hub"), F.max("digest").alias("far")).where("hub <> far").drop("far")
    return nodes.join(hubs, "prefix").where("digest <> hub").select(F.col("digest").alias("a"), F.col("hub").alias("b")).distinct()


def intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, by products of slices of their incidence matrices."""
    sizes = [len(s) for s in (*left, *right)]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    ids, column, times = np.unique(np.concatenate([*left, *right]), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    rank = np.cumsum(times > 1) - 1
    column = rank[column]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(left), len(right)), np.float64)
    width = max(256, (4 << 20) // max(1, len(sizes)))
    edges = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else 0) + width + 1, width))
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        if b > a:
            part = np.zeros((len(sizes), width), np.float32)
            part[owner[a:b], column[a:b] - k * width] = 1
            out += part[: len(left)] @ part[len(left) :].T
    return out


def forest(pairs: Iterable[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Those of the pairs that join two trees."""
    parent = list(range(n))
    out = []
    for a, b in pairs:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((a, b))
    return out


def verify(blocks: DataFrame, threshold: float) -> DataFrame:
    """(a, b, texts, docs): spanning links of each pair of blocks (b set), and link counts of each text (b null).

    `blocks` has a row per text and block pair: key, i, j, own, node, copies, set.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("texts", pa.int64()), ("docs", pa.int64())])

    def compare(rows):
        _, i, j, *_ = rows[0]
        rows = [(r[3], r[4], r[5], np.frombuffer(r[6], np.uint64)) for r in rows]
        left = [r for r in rows if r[0] == i]
        right = left if i == j else [r for r in rows if r[0] == j]
        if not left or not right or (i == j and len(left) < 2):
            return []
        sizes = [np.array([len(r[3]) for r in side], np.float64) for side in (left, right)]
        both = intersections([r[3] for r in left], [r[3] for r in right])
        linked = both >= threshold * (sizes[0][:, None] + sizes[1][None, :] - both) - 1e-9
        if i == j:
            np.fill_diagonal(linked, False)
        weight = [np.array([r[2] for r in side], np.int64) for side in (left, right)]
        out = [(r[1], None, int(c), int(w)) for r, c, w in zip(left, linked.sum(1), linked @ weight[1]) if c]
        a, b = np.nonzero(linked)
        if i == j:
            a, b = a[a < b], b[a < b]
        else:
            out += [(r[1], None, int(c), int(w)) for r, c, w in zip(right, linked.sum(0), weight[0] @ linked) if c]
            b = b + len(left)
        names = [r[1] for r in left] + ([] if i == j else [r[1] for r in right])
        return out + [(names[x], names[y], 0, 0) for x, y in forest(zip(a.tolist(), b.tolist()), len(names))]

    def run(batches):
        rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
        held = []
        for _, group in groupby(rows, lambda r: r[:3]):
            held += compare(list(group))
            if len(held) > 10_000:
                yield text.batch_of(schema, *zip(*held))
                held = []
        if held:
            yield text.batch_of(schema, *zip(*held))

    dealt = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(text.tidy(run, "ngram_join"), "a binary, b binary, texts long, docs long")


def similar(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, class_id, class_hash, n_links, n_texts, n_copies.

    Two documents are linked if the Jaccard similarity of their sets of `words`-word runs is at least
    `threshold`; class_id is the smallest doc_id that links lead to, class_hash the smallest text_hash under it.  n_links counts the other documents linked to
    this one, n_texts the other texts among them and n_copies the documents with the same set, this one included.

    A text with fewer words is one run.  A null or empty text, or one without words, links to nothing: its
    class is its own id and text.  A document without an id takes part like any other; a class of such documents only has
    no class_id and is known by its class_hash.  Repeated rows count as copies.  Other columns are left out.
    """
    rows = text.text_rows(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), "text")
    found = cut(prints(rows, words, trees * depth))
    each = found.groupBy("digest", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n_shingles"))
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    texts = each.groupBy("digest").agg(  # `own`: the row whose text is fetched, if possible one that stands once
        F.min(name).alias("first"), F.min(F.struct((F.col("copies") > 1).alias("again"), "doc_id", "text_hash")).alias("own"), F.sum("copies").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    tied = components(candidates(found, threshold, trees, depth, recall))
    members = cut(tied.join(texts, tied["node"] == texts["digest"]).select("root", "node", F.col("own.again").alias("again"), F.col("own.doc_id").alias("own_id"), F.col("own.text_hash").alias("own_hash"), "copies", "n_shingles"))
    groups = members.groupBy("root").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    schema = pa.schema([("root", pa.binary()), ("node", pa.binary()), ("copies", pa.int64()), ("set", pa.binary())])

    def sets(batches):
        hashes = text.plain_hash()
        for b in text.slices(batches):
            made = shingles(b.column("text"), hashes, words)
            nodes = b.column("node").to_pylist()
            same = [xxhash.xxh3_128_digest(s.tobytes()) == n for s, n in zip(made, nodes)]  # another text may have the same id
            keep = pa.array(same)
            yield text.batch_of(schema, b.column("root").filter(keep), b.column("node").filter(keep), b.column("copies").filter(keep), [s.tobytes() for s, k in zip(made, same) if k])

    # candidates grow with the documents, so they are never broadcast, not even where they happen to be few
    wanted = rows.join(members.hint("merge"), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("text_hash") == F.col("own_hash"))).select("root", "node", "again", "copies", "text")
    once = wanted.where("again").groupBy("root", "node", "copies").agg(F.min("text").alias("text"))  # rows that repeat id and text
    chosen = wanted.where("NOT again").drop("again").unionByName(once)
    made = chosen.mapInArrow(text.tidy(sets, "ngram_join"), "root binary, node binary, copies long, set binary").join(groups, "root")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("own")).alias("i"), F.greatest(k, F.col("own")).alias("j")))
    blocks = made.withColumn("own", own).withColumn("pair", F.explode(others)).select(F.col("root").alias("key"), "pair.i", "pair.j", "own", "node", "copies", "set")
    checked = cut(verify(blocks, threshold))
    links = checked.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("texts").alias("texts"), F.sum("docs").alias("docs"))
    roots = components(checked.where("b is not null").select("a", "b"))
    classes = roots.join(texts, roots["node"] == texts["digest"]).groupBy("root").agg(F.min("first").alias("class"))
    linked = roots.join(classes, "root").select(F.col("node").alias("digest"), "class").join(links, "digest")
    told = texts.select("digest", "first", "copies").join(linked, "digest", "left")
    empty = F.col("n_shingles") == 0
    out = found.select("doc_id", "text_hash", "digest", "n_shingles").join(told, "digest")
    return out.select(
        "doc_id", "text_hash", F.when(empty, F.col("doc_id")).otherwise(F.coalesce("class", "first")["doc_id"]).alias("class_id"),
        F.when(empty, F.col("text_hash")).otherwise(F.coalesce("class", "first")["text_hash"]).alias("class_hash"),
        F.when(empty, 0).otherwise(F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_texts"), F.when(empty, 1).otherwise(F.col("copies")).cast("long").alias("n_copies"))
