"""Language ID, quality rules and toxicity: brute force where there is one, accuracy on rows left out of the fit."""

import itertools
import re

import numpy as np
import pyarrow as pa
import public_tokenizers
from common import odd_docs
from pyspark.sql import functions as F

import __spark_entry__ as entry
from portlake.llm import chain, langid, linear, quality, text, toxicity

DATA = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_accuracy(spark):
    got = entry.queries()["op8_language_id"](spark, DATA).toPandas()
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").toPandas()
    held = got[got.held_out].merge(docs, on="doc_id")
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (held.lang_pred == held.lang).mean() > 0.95
    assert got.rejected.mean() < 0.05


def test_awkward_languages(spark):
    docs, rows = odd_docs(spark)
    known = langid.fit(spark.createDataFrame([(k, t, lang) for k in range(20) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"))], "doc_id long, text string, lang string"))
    got = langid.classify(docs, known, keep=("score", "digest")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].lang_pred == by[1].lang_pred == by[2].lang_pred == "und" and by[0].rejected and by[0][2] == 0
    assert {r.digest for r in got} == {"clash"}
    assert {r.lang_pred for r in langid.classify(docs, {}).collect()} == {"und"}
    assert langid.classify(docs.limit(0), known).count() == 0 and langid.fit(docs.where("lang = 'xx'")) == {}


def base_counts(t):
    t = t or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = {}
    for k in range(len(words) - 4):
        windows.setdefault(tuple(words[k : k + 5]), []).append(k)
    covered = {j for at in windows.values() if len(at) > 1 for k in at for j in range(k, k + 5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_base_counts(spark):
    docs, rows = odd_docs(spark)
    more = ["a b c d e a b c d e f", "x\nx\n \nx y\nx y", "#|a <b> é*", "one " * 40, "a b c d e\n" * 3]
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, t) for k, t in enumerate(more)], "doc_id long, text string")).withColumn("kept", F.lit(1))
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit(1).alias("kept"))
    docs = docs.unionByName(sample)
    got = quality.assess(docs, None, keep=("text",)).collect()
    assert len(got) == docs.count()
    for r in got:
        want = base_counts(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and r.kept == (not r.base_failed)
    assert quality.assess(docs.limit(0), None).count() == 0


def test_quality_on_rows_left_out(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels.where(text.in_fold()))
    got = quality.assess(docs, model).join(labels.where(~text.in_fold()).withColumnRenamed("quality", "truth"), "doc_id").toPandas()
    assert ((got.quality >= 0.5) == (got.truth == 1)).mean() > 0.93
    assert got[got.truth == 1].kept.mean() > 0.9
    assert quality.fit(docs, labels.where("quality = 1")) is None


def test_scores_equal_sparse_features():
    s = quality.Slice(pa.array([b"a bc a", b"", "é x".encode(), b"abcd abcd"], pa.binary()), text.plain_hash())
    w = np.random.default_rng(0).normal(size=quality.DIMS)
    assert np.allclose(s.scores(w, 0.25), [w[i] @ v + 0.25 for i, v in s.sparse()])


def test_calibration():
    rng = np.random.default_rng(0)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < linear.sigmoid(2 * z - 1)).astype(int)
    a, b = linear.calibrate(z, y)
    assert abs(a - 2) < 0.25 and abs(b + 1) < 0.2
    theta = linear.fit_dense(np.array([[0.0], [1.0]] * 50), np.array([0, 1] * 50))
    assert linear.sigmoid(theta @ [1, 1]) > 0.9 > 0.1 > linear.sigmoid(theta @ [0, 1])


def test_marginals_against_all_taggings():
    rng = np.random.default_rng(3)
    sizes = [1, 3, 5, 2, 6]
    score, start, trans = rng.normal(size=sum(sizes)), rng.random(2) + 0.1, rng.random((2, 2)) + 0.1
    first = np.zeros(sum(sizes), bool)
    first[np.cumsum([0] + sizes[:-1])] = True
    one, joint = chain.marginals(score, first, start, trans, pairs=True)
    at = 0
    for n in sizes:
        weight, ones, both = 0.0, np.zeros(n), np.zeros((2, 2, n))
        for tags in itertools.product((0, 1), repeat=n):
            w = start[tags[0]] * np.prod([trans[a, b] for a, b in zip(tags, tags[1:])]) * np.exp(sum(s * t for s, t in zip(score[at:], tags)))
            weight += w
            ones += w * np.array(tags)
            for k in range(1, n):
                both[tags[k - 1], tags[k], k] += w
        assert np.allclose(one[at : at + n], ones / weight) and np.allclose(joint[:, :, at + 1 : at + n], both[:, :, 1:] / weight)
        at += n
    assert len(chain.marginals(np.zeros(0), np.zeros(0, bool), start, trans)) == 0


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.fit(docs.where(text.in_fold()), labels)
    held = toxicity.score(docs, model).where(~text.in_fold()).join(labels, "doc_id").join(docs, "doc_id").toPandas()
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.97
    assert (held[held.toxic == 0].predicted == 0).mean() > 0.99
    for r in held[held.predicted == 1].head(20).itertuples():
        for s in r.spans:
            assert WORD.fullmatch(r.text[s["begin"] : s["end"]].split()[0]) and s["p"] >= 0.5


def test_awkward_toxicity(spark):
    docs, rows = odd_docs(spark)
    bad = [(k, f"good words here {'vilest' if k % 2 else 'kindest'} of all and more of it", k % 2) for k in range(200)]
    learn = spark.createDataFrame([(k, t) for k, t, _ in bad], "doc_id long, text string")
    model = toxicity.fit(learn, spark.createDataFrame([(k, y) for k, _, y in bad], "doc_id long, toxic int"))
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    told = toxicity.score(spark.createDataFrame([(1, "ünd so vilest it is")], "doc_id long, text string"), model).first()
    assert told.predicted == 1 and [(s.begin, s.end) for s in told.spans] == [(7, 13)]
    assert toxicity.fit(learn, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")) is None
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0} and toxicity.score(docs.limit(0), model).count() == 0


def small(spark):
    """Every 7th text of the table, with awkward ones: enough for results by hand."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id % 7 = 0").select("doc_id", "text")
    odd = odd_docs(spark)[0].where("doc_id <> 4").select((F.col("doc_id") + 100_000).alias("doc_id"), "text")  # id 4 has three texts
    return docs.unionByName(odd)


def test_languages_equal_compressing_by_hand(spark):
    """Each text alone, piece by piece, with each dictionary alone: the smallest sum wins, narrow ones are rejected."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    known = langid.fit(docs.where(text.in_fold()))
    params = langid.zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
    body = {r.doc_id: (r.text or "").encode() for r in small(spark).collect() if r.doc_id is not None}
    for r in langid.classify(small(spark).where("doc_id is not null").dropDuplicates(["doc_id"]).join(spark.createDataFrame([(d,) for d in body], "doc_id long"), "doc_id"), known, keep=("text",)).collect():
        plain = b" ".join(w for w in re.split(rb"[^a-z\x80-\xff]+", (r.text or "").encode().lower()) if w)
        size = {}
        for lang, data in known.items():
            fresh = lambda: langid.zstandard.ZstdCompressor(dict_data=langid.zstandard.ZstdCompressionDict(data, dict_type=langid.zstandard.DICT_TYPE_RAWCONTENT), compression_params=params)  # noqa: E731, B023
            size[lang] = sum(len(fresh().compress(plain[k : k + langid.PIECE])) for k in range(0, len(plain), langid.PIECE))
        if not any(c.isalpha() for c in plain.decode()):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0, True)
            continue
        least, second = sorted((n, lang) for lang, n in size.items())[:2]
        assert r.lang_pred == least[1] and r.rejected == (1 - least[0] / second[0] < langid.MARGIN)


def test_quality_verdicts_equal_the_model_by_hand(spark):
    """Features, probability and verdict of each text alone, from the written weights."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = quality.fit(docs, labels)
    w = np.frombuffer(model["w"], np.float32).astype(np.float64)
    for r in quality.assess(small(spark), model, keep=("text",)).collect():
        (index, share), = quality.Slice(pa.array([(r.text or "").encode()], pa.binary()), text.plain_hash()).sparse()
        p = 1 / (1 + np.exp(-(model["a"] * (w[index] @ share + model["bias"]) + model["b"])))
        words = base_counts(r.text)
        failed = words[0] < 10 or 100 * words[4] > 20 * words[0]
        assert abs(p - r.quality) < 1e-5 and r.base_failed == failed and (r.kept == (not failed and p >= 0.5) or abs(p - 0.5) < 1e-5)


def test_toxicity_equals_the_field_by_hand(spark):
    """Forward and backward sums of each text alone, word by word, and the score from them."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model = toxicity.fit(docs.select("doc_id", "text").where(text.in_fold()), labels)
    start, trans = model["start"], model["trans"]
    for r in toxicity.score(small(spark).where("length(text) < 20000 or text is null"), model).join(small(spark), "doc_id").collect():
        words = WORD.findall(r.text or "")
        emit = [np.array([1.0, np.exp(model["w"][np.frombuffer(toxicity.word_features(w.encode()), np.uint32)].sum() + model["bias"])]) for w in words]
        ahead, behind = [], [np.ones(2)]
        for k, e in enumerate(emit):
            f = (start if k == 0 else ahead[-1] @ trans) * e
            ahead.append(f / f.sum())
        for e in reversed(emit[1:]):
            b = trans @ (e * behind[0])
            behind.insert(0, b / b.sum())
        one = np.array([(f * b)[1] / (f @ b) for f, b in zip(ahead, behind)]) if words else np.zeros(0)
        s = toxicity.summary(one, np.array([len(one)]))
        want = linear.sigmoid(np.append(s[0], 1.0) @ model["theta"])
        assert abs(want - r.score) < 1e-6 and (r.predicted == (want >= toxicity.PREDICT_AT) or abs(want - toxicity.PREDICT_AT) < 1e-6)


def test_scores_do_not_depend_on_the_batch(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    model, toxic = quality.fit(docs, labels), toxicity.fit(docs.select("doc_id", "text"), labels)
    both = []
    for parts in (1, 13):
        dealt = small(spark).where("doc_id is not null").repartition(parts)
        both.append((sorted(map(tuple, quality.assess(dealt, model).collect())), sorted((r.doc_id, r.score) for r in toxicity.score(dealt, toxic).collect())))
    assert both[0][0] == both[1][0] and np.allclose([s for _, s in both[0][1]], [s for _, s in both[1][1]], rtol=0, atol=1e-12)


def test_fits_read_their_sample_only(spark):
    """The one-task fit reads written rows, no more than the sample; the scan and the join before it stay parallel."""
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    got = quality.sample(docs, labels, "quality", 30, "quality")
    assert "Join" not in got._jdf.queryExecution().toString() and sorted(r["count"] for r in got.groupBy("label").count().collect()) == [30, 30]
    repeated = docs.unionByName(docs).unionByName(docs.withColumn("text", F.concat("text", F.lit(" x"))))
    assert sorted(r["count"] for r in quality.sample(repeated, labels.unionByName(labels), "quality", 30, "quality").groupBy("label").count().collect()) == [30, 30]


def test_smallest_rows(spark):
    rows = spark.range(20_000).withColumn("h", F.xxhash64("id"))
    want = [r.id for r in rows.orderBy("h").limit(25).collect()]
    assert [r.id for r in text.smallest(rows, 25, "id")] == want
    assert len(text.smallest(rows.limit(7), 25, "id")) == 7 and text.smallest(rows.limit(0), 25, "id") == []
    one = spark.range(5000).select(F.lit(3).alias("id"), F.xxhash64(F.lit(3)).alias("h")).unionByName(rows.limit(10))
    assert len(text.smallest(one, 300, "id")) == 300


def test_word_tables_keep_short_words_only():
    table = text.plain_hash()
    long = b"x" * 5000
    assert table([long, b"a", long])[0] == table([long])[0] and set(table.known) == {b"a"}


def test_a_worker_drops_the_tables_of_other_work():
    """What one stage of the pipeline keeps in a worker does not stay through the next; tables of the same work do."""
    from pyspark import cloudpickle

    from portlake.llm import vocab

    def task(work):
        return list(cloudpickle.loads(cloudpickle.dumps(text.tidy(lambda batches: iter(batches), work)))([1, 2]))

    assert task("packing") == [1, 2]
    first = vocab.tokens(public_tokenizers.path("byte_bpe_50k.json"))
    task("packing")
    assert vocab.tokens(public_tokenizers.path("byte_bpe_50k.json")) is first
    task("langid")
    assert vocab.tokens.cache_info().currsize == 0


def test_stages_send_texts_in_small_batches(spark):
    """A stage's tasks meet long texts in batches of some megabytes, not 10,000 rows at once, and no text is lost or cut."""
    import corpus_pipeline

    docs = spark.range(200).selectExpr("id AS doc_id", "repeat('alpha beta ', 10000) AS text", "'en' AS lang").coalesce(1)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    try:
        dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
        sizes = [r["n"] for r in docs.select("text").mapInArrow(lambda batches: (pa.record_batch({"n": [b.nbytes]}) for b in batches), "n long").collect()]
        spark.conf.set(limit, "1000000")
        dict(corpus_pipeline.STAGES)["packing"](spark, docs, "")
        assert spark.conf.get(limit) == "1000000"
    finally:
        spark.conf.unset(limit)
    assert sum(sizes) >= 200 * 110_000 and max(sizes) <= 7 << 20
