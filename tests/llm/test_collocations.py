"""The FM-index and the collocations against counting by hand."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from portlake.llm import collocation
from portlake.llm.fmindex import BothWays, rotations


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", low)]


def by_hand(rows, least, top, share=80, longest=4):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for words in pieces(text):
            total[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    count[lang or "und"][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in count.items():
        chosen = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        told = []
        for p, a in chosen.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in chosen.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            told.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, r + 1, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(told)[:top])]
    return sorted(out)


def texts(n, seed):
    rng = random.Random(seed)
    words = ["The", "old", "sea", "port", "of", "É", "x\x1cy", "\x00", "日本", "of", "a"]
    body = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " old sea port "]) for _ in range(rng.randrange(40)))
    rows = [(body(), rng.choice(["en", "en", "en", "de", None])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), (" \n.", "fr"), ("word", "fr"), ("tie tie tie tie tie tie", "fr")] + [("same text again", "en")] * 9 + [("old sea port " * 3000, "en")]


@pytest.mark.parametrize("shard_words", [50, 3_000_000])
def test_collocations_equal_counting(spark, shard_words):
    rows = texts(120, 1)
    made = spark.createDataFrame([(t, lang, "clash", "clash", 1, 2) for t, lang in rows], "text string, lang string, phrase string, h string, n int, rank int").repartition(4)
    got = collocation.collocations(made, min_count=3, top=40, shard_words=shard_words)
    assert sorted(tuple(r)[:8] for r in got.collect()) == by_hand(rows, 3, 40)


def test_continuations_are_counted(spark):
    made = spark.createDataFrame([("a b c. a b, x a b",)] * 2, "text string").selectExpr("text", "CAST(NULL AS STRING) AS lang")
    got = {r["phrase"]: (r["a"], r["n_left"], r["n_right"]) for r in collocation.collocations(made, min_count=2, share=101).collect()}
    assert got == {"a b": (6, 2, 2), "b c": (2, 2, 0), "a b c": (2, 0, 0), "x a": (2, 0, 2), "x a b": (2, 0, 0)}


def test_shards_fill_up_by_language(spark):
    """Each shard of a language but the last one of a task is full, so that a phrase is counted in few of them; all words are kept."""
    rows = [(f"w{k} a b c d e f g h i", ["en", "de", "fr"][k % 3]) for k in range(600)]
    made = spark.createDataFrame(rows, "text string, lang string").repartition(1)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(limit, "10")
    try:
        got = collocation.shards(made, "lang", "text", 500).where("kind = 0").groupBy("shard", "lang").agg(F.sum("n").alias("n")).collect()
    finally:
        spark.conf.unset(limit)
    by_lang = {lang: sorted(r["n"] for r in got if r["lang"] == lang) for lang in ("en", "de", "fr")}
    assert {lang: sum(n) for lang, n in by_lang.items()} == {"en": 2000, "de": 2000, "fr": 2000}
    assert all(n >= 400 for sizes in by_lang.values() for n in sizes[1:])


def test_open_shards_are_bounded(spark):
    """With many languages the largest of the open shards is closed, whole or not."""
    rows = [("a b c d e f g h i", f"l{k % 40}") for k in range(800)]
    made = spark.createDataFrame(rows, "text string, lang string").repartition(1)
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(limit, "10")
    try:
        got = collocation.shards(made, "lang", "text", 100).where("kind = 0").groupBy("shard").agg(F.sum("n").alias("n")).collect()
    finally:
        spark.conf.unset(limit)
    assert sum(r["n"] for r in got) == 7200 and len(got) > 40


def test_empty_tables(spark):
    for rows in ([], [(None, None)], [("", "en"), (".", "de")]):
        assert collocation.collocations(spark.createDataFrame(rows, "text string, lang string")).collect() == []


def test_index_equals_scanning():
    rng = np.random.default_rng(2)
    codes = np.append(0, rng.integers(0, 5, 400)).astype(np.int64)
    codes[-1] = 0
    index = BothWays(codes, 5, 4)
    level = index.single(np.arange(1, 5))
    for length in range(2, 5):
        level = index.extended(level, length % 2 == 0)
        windows = Counter(tuple(codes[i : i + length].tolist()) for i in range(len(codes) - length + 1))
        want = {w: n for w, n in windows.items() if 0 not in w}
        words = list(zip(*(w.tolist() for w in level.words)))
        assert dict(zip(words, level.size.tolist())) == want
        left, right = index.inner(level)
        for w, a, b in zip(words, left.tolist(), right.tolist()):
            at = [i for i in range(len(codes) - length + 1) if tuple(codes[i : i + length].tolist()) == w]
            assert a == sum(codes[i - 1] != 0 for i in at) and b == sum(codes[i + length] != 0 for i in at)


def test_rotations_are_sorted_by_their_first_words():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 3, 200)
    order = rotations(codes, 4)
    heads = [tuple(np.roll(codes, -i)[:4].tolist()) + (i,) for i in order.tolist()]
    assert heads == sorted(heads)
