"""The n-gram join and decontamination against brute force, and the pipeline."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from common import odd_docs
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from portlake.llm import decontam, graph, ngram_join

SMALL = "/root/testdata/sf0.001"


def brute(rows, threshold=0.8, n=5):
    """{doc_id: (class_id, links)} for unique ids."""
    sets = {}
    for d, t in rows:
        w = (t or "").split()
        sets[d] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    parent, links = {d: d for d in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (find(d), links[d]) for d in sets}


def test_join_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar(docs).collect()}
    assert got == brute([tuple(r) for r in docs.collect()])


def test_large_group_in_blocks(spark):
    """A group of near copies over several blocks: no link is lost, none is invented."""
    rng = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for d in range(700):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(120)] = f"x{rng.randrange(50)}"
        rows.append((d, " ".join(w)))
    want = brute(rows)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(v[1] for v in got.values()) == sum(v[1] for v in want.values()) and got == want


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold are found."""
    rows = []
    for p in range(300):
        w = [f"a{p}_{k}" for k in range(104)]
        rows += [(2 * p, " ".join(w)), (2 * p + 1, " ".join([*w[:50], "z", *w[51:100], "q", "r"][:100] + w[100:]))]
    want = {d: v for d, v in brute(rows[:40]).items()}
    linked = sum(v[1] for v in want.values()) / len(want)
    got = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).agg(F.sum("n_links")).first()[0]
    assert got >= 0.97 * linked * len(rows)


def test_depth_shortens_with_recall():
    assert ngram_join.prefix_depth(0.8, 16, 8, 0.5) == 8 > ngram_join.prefix_depth(0.8, 16, 8, 0.995) == 5
    with pytest.raises(ValueError):
        ngram_join.prefix_depth(0.8, 1, 8, 0.9)


def test_awkward_join(spark):
    docs, rows = odd_docs(spark)
    got = ngram_join.similar(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[d][0].class_id == d and by[d][0].n_links == 0 for d in (0, 1, 2, 3))
    assert by[12][0].class_id == by[None][0].class_id == 11 and by[11][0].n_links == 2 and by[11][0].n_copies == 3
    assert ngram_join.similar(docs.limit(0)).count() == 0


def by_row(rows, threshold=0.8, n=5):
    """(id, text, class id, links, texts, copies) of every row, rows compared with rows."""
    sets = []
    for _, t in rows:
        w = (t or "").split()
        sets.append(frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    linked = lambda a, b: sets[a] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    near = [[b for b in range(len(rows)) if b != a and linked(a, b)] for a in range(len(rows))]
    out = []
    for a, (d, t) in enumerate(rows):
        reached, todo = {a}, [a]
        while todo:
            new = set(near[todo.pop()]) - reached
            reached |= new
            todo += new
        ids = [rows[b][0] for b in reached if rows[b][0] is not None]
        out.append((d, t, min(ids, default=None), len(near[a]), len({sets[b] for b in near[a]} - {sets[a]}), 1 + sum(sets[b] == sets[a] for b in near[a])))
    return sorted(out, key=repr)


def test_repeated_and_missing_ids(spark):
    """Rows that repeat an id next to a near copy, one id for several texts, and near copies that only rows without an id carry."""
    w = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(w), " ".join([*w, "x"]), " ".join(["y", *w])
    p, q = " ".join(f"p{k}" for k in range(50)), " ".join(f"p{k}" for k in range(51))
    rows = [(1, a), (1, a), (3, b), (None, c), (None, a), (None, a), (7, b), (7, p), (None, q), (None, None), (8, "alone here"), (None, "no id at all but the same")] + [(None, "z " + " ".join(w[20:50])), (None, " ".join(w[20:50]) + " z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = {r.text_hash: r.text for r in docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash")).distinct().collect()}
    got = [(r.doc_id, names[r.text_hash], r.class_id, r.n_links, r.n_texts, r.n_copies) for r in ngram_join.similar(docs).collect()]
    assert sorted(got, key=repr) == by_row(rows)
    kept = corpus_pipeline.near_duplicates(spark, docs.withColumn("lang", F.lit("en")), SMALL).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None) == [(1, a), (7, p), (8, "alone here")]
    assert len([r for r in kept if r.doc_id is None]) == 3  # no text, the lone one, and one of the two near copies


def test_many_repeats_cost_no_pairs(spark):
    """2,000 rows under one id and a near copy of them: links by row, work by text."""
    w = [f"w{k}" for k in range(60)]
    rows = [(1, " ".join(w))] * 2000 + [(2, " ".join([*w, "x"]))]
    got = {(r.doc_id, r.n_links, r.n_texts, r.n_copies, r.class_id) for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 2000, 1, 2000, 1), (2, 2000, 1, 1, 1)}


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, 100 + k) for k in range(1, 50)] + [(200 + rng.randrange(40), 200 + rng.randrange(40)) for _ in range(25)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_intersections():
    rng = np.random.default_rng(0)
    left = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (0, 5, 400, 2000)]
    right = [np.unique(rng.integers(0, 3000, n).astype(np.uint64)) for n in (1, 700, 0)]
    assert ngram_join.intersections(left, right).tolist() == [[len(np.intersect1d(a, b)) for b in right] for a in left]


def smith_waterman(item, passage):
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i, j in itertools.product(range(len(item)), range(len(passage))):
        h[i + 1, j + 1] = max(0, h[i, j] + (2 if item[i] == passage[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return h.max()


def test_alignment_against_the_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        item, passage = rng.integers(0, 6, rng.integers(1, 15)), rng.integers(0, 6, rng.integers(0, 25))
        score, begin, end = decontam.align(item, passage)
        assert score == smith_waterman(item, passage)
        assert smith_waterman(item, passage[begin:end]) == score


def test_edited_copies(spark):
    rng = random.Random(4)
    words = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choices(words, k=40))) for k in range(30)]
    docs, truth = [], set()
    for d in range(200):
        body = rng.choices(words, k=300)
        if d % 4 == 0:
            k = rng.randrange(30)
            copy = items[k][1].split()
            for _ in range(6):  # words changed, dropped and put in
                p = rng.randrange(len(copy))
                copy[p : p + 1] = [[rng.choice(words)], [], [copy[p], rng.choice(words)]][rng.randrange(3)]
            at = rng.randrange(300)
            body[at:at] = [w.upper() + "," for w in copy]
            truth.add((d, k))
        docs.append((d, " ".join(body)))
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    texts = dict(docs)
    for r in got:  # the passage, but for a few words at its edges
        inside = [w.endswith(",") for w in texts[r.doc_id].split()[r.begin : r.end]]
        assert 30 <= len(inside) <= 65 and sum(inside) >= 0.9 * len(inside)


@pytest.mark.parametrize("agree, block", [(3, 128), (1, 16)])
def test_single_copies_with_many_edits(spark, agree, block):
    """One edited copy of an item is found however its edits lie, if its alignment reaches the score."""
    rng = random.Random(6)
    words = [f"v{k}" for k in range(300)]
    items = [(k, rng.choices(words, k=40)) for k in range(24)] + [(24 + k, rng.choices(words, k=3 + k)) for k in range(6)]
    docs = []

    def put(copy):
        body = rng.choices(words, k=rng.randrange(90))
        at = rng.randrange(len(body) + 1)
        docs.append((len(docs), body[:at] + copy + body[at:]))

    for k, w in items:
        for step in (5, 4, 3):
            put([f"x{p}" if p % step == step - 1 else x for p, x in enumerate(w)])
        put([y for p, x in enumerate(w) for y in (x, f"x{p}")])  # no two neighbours are left
        for share in (0.2, 0.25, 0.35):
            put([f"x{p}" if rng.random() < share else x for p, x in enumerate(w)])
            put([x for x in w if rng.random() > share])
    put(rng.choices(words[:12], k=400))
    want = {(d, i): smith_waterman(w, t) / (2 * len(w)) for d, t in docs for i, w in items}
    want = {x: s for x, s in want.items() if s >= 0.5}
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(frame, bench, agree=agree, block=block).collect()}
    assert got == want
    assert all((10 * k + e, k) in want for k in range(24) for e in (0, 1, 2, 3))


@pytest.mark.parametrize("score", [0.3, 0.5, 0.8])
def test_short_items_and_other_scores(spark, score):
    """What the whole table of alignments gives, for items from one word up."""
    rng = random.Random(8)
    words = [f"v{k}" for k in range(25)]
    items = [rng.choices(words, k=k) for k in (1, 2, 3, 4, 9, 20)]
    texts = [rng.choices(words, k=rng.randrange(120)) for _ in range(40)]
    want = {(d, k): smith_waterman(w, t) / (2 * len(w)) for d, t in enumerate(texts) for k, w in enumerate(items) if t}
    want = {x: s for x, s in want.items() if s >= (1 if len(items[x[1]]) < 3 else score)}
    frame = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(frame, bench, min_score=score).collect()} == want


def test_many_items_and_a_long_text(spark):
    """A text of common words costs by its seeds, not by the number of items; copies far apart in it are found."""
    rng = random.Random(9)
    words = [f"v{k}" for k in range(3000)]
    items = [rng.choices(words, k=30) for _ in range(10_000)]
    long = rng.choices(words[:60], k=300_000)
    planted = {k: 29_000 * n for n, k in enumerate((5, 77, 4_000, 9_999, 1_234))}
    for k, at in planted.items():
        long[at : at + 30] = items[k]
    frame = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(rng.choices(words, k=500)))], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.score, r.begin) for r in decontam.contaminated(frame, bench).collect()}
    assert got == {(1, k): (1.0, at) for k, at in planted.items()}


def test_awkward_decontamination(spark):
    docs, rows = odd_docs(spark)
    bench = spark.createDataFrame([(1, "same text twice here now", 0), (2, None, 0), (3, "", 0), (4, "word", 0), (4, "word", 0), (5, "...", 0)], "item_id long, text string, score int")
    got = Counter((r.doc_id, r.item_id) for r in decontam.contaminated(docs, bench).collect())
    assert got == Counter({(11, 1): 1, (12, 1): 1, (None, 1): 1, (4, 4): 4})
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.contaminated(docs.limit(0), bench).count() == 0


def test_small_table_by_search(spark):
    docs, bench = ({r[0]: " ".join(r[1].lower().split()) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(k, "text").collect()} for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    found = {(r.doc_id, r.item_id) for r in entry.queries()["op9_decontamination"](spark, SMALL).collect()}
    assert {(d, i) for d, t in docs.items() for i, b in bench.items() if b in t} <= found


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    before = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= before, name
        if name == "ngram_join":
            assert {d for d, (c, _) in brute(texts).items() if c == d} == set(ids)
        if name == "decontamination":
            assert before - set(ids) == {r.doc_id for r in decontam.contaminated(last, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
        before, texts, last = set(ids), [(r.doc_id, r.text) for r in docs.collect()], docs
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in pieces} == before
    assert sum(r.length for r in pieces) == sum({r.doc_id: r.doc_tokens for r in pieces}.values())


def test_awkward_pipeline(spark):
    docs, _ = odd_docs(spark)
    docs = docs.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SMALL).count() >= 0
        assert stage(spark, docs.limit(0), SMALL).count() == 0
    stays = corpus_pipeline.near_duplicates(spark, docs, SMALL)
    assert Counter(r.text for r in stays.collect())["same text twice here now"] == 1
