"""Toxic spans by a linear-chain conditional random field, document scores from its marginals.

1. Over all labelled documents that may be learned from, each hashed feature of a word (the word, its beginnings,
   its endings) is counted in toxic and in clean documents.
2. Words of toxic documents with a feature that clearly belongs to toxic documents are labelled toxic.
3. The field is fitted on those labels over a bounded sample, and a logistic regression on sums and maxima of its marginals over other rows of the sample.
4. All texts: marginals of every word, document score, and the spans whose words are more likely toxic than not.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import chain, linear, text

#: The fit: so many labelled rows of each label, chosen by a hash of the id; half of them for the field.
FIT_ROWS = 1000
DIMS = 1 << 18
#: A feature is toxic if the lower bound of its log odds is at least this, and so many documents hold it.
ODDS, SUPPORT = 2.0, 5
PREDICT_AT, SPAN_AT = 0.7, 0.5
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def word_features(word: bytes) -> bytes:
    """Numbers of a word's features: the word without marks at its edges, three beginnings, two endings."""
    w = text.folded(word)
    named = ("w" + w, "a" + w[:3], "b" + w[:4], "c" + w[:5], "y" + w[-3:], "z" + w[-4:])
    return np.array([zlib.crc32(f.encode()) % DIMS for f in named], np.uint32).tobytes()


N_FEATURES = len(np.frombuffer(word_features(b"x"), np.uint32))


def features_of(words: list[bytes], table: text.WordTable) -> np.ndarray:
    """One row of feature numbers per distinct word."""
    return np.frombuffer(b"".join(table.values(words)), np.uint32).reshape(-1, N_FEATURES)


def labelled(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) of the documents with a label 0 or 1."""
    marked = labels.where(F.col(label).isin(0, 1)).select("doc_id", F.col(label).cast("int").alias("label"))
    # labels grow with the documents, so they are never broadcast, not even where they happen to be few
    return docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(marked.hint("merge"), "doc_id")


def evidence(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counts[feature, label], documents[label]) over all `rows`: in how many documents each feature occurs."""
    schema = pa.schema([("feature", pa.int64()), ("label", pa.int32()), ("n", pa.int64())])

    def run(batches):
        table, total, docs_ = text.WordTable(word_features, object), np.zeros((2, DIMS + 1), np.int64), 0
        for b in text.slices(batches):
            y = b.column("label").to_numpy()
            words, code, ends = text.words_of(b.column("text"))
            doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            doc, code = np.divmod(np.unique(doc * max(1, len(words)) + code), max(1, len(words)))
            pairs = np.unique(np.repeat(doc, N_FEATURES) * DIMS + features_of(words, table)[code].reshape(-1))
            doc, feature = np.divmod(pairs, DIMS)
            for k in (0, 1):
                total[k] += np.bincount(feature[y[doc] == k], minlength=DIMS + 1)
                total[k, DIMS] += (y == k).sum()
        for k in (0, 1):
            at = np.flatnonzero(total[k])
            yield text.batch_of(schema, at, np.full(len(at), k, np.int32), total[k][at])

    # at most one row per feature number and label, whatever the number of documents
    found = rows.select("text", "label").mapInArrow(run, "feature long, label int, n long").groupBy("feature", "label").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((DIMS + 1, 2), np.int64)
    counts[found["feature"].to_numpy(np.int64), found["label"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return counts[:DIMS], counts[DIMS]


def toxic_features(counts: np.ndarray, docs_: np.ndarray) -> np.ndarray:
    """Which features clearly belong to toxic documents."""
    a, b = counts[:, 1] + 0.5, counts[:, 0] + 0.5
    odds = np.log(a / (docs_[1] + 1)) - np.log(b / (docs_[0] + 1))
    return (odds - 1.64 * np.sqrt(1 / a + 1 / b) >= ODDS) & (counts[:, 1] >= SUPPORT)


def summary(one: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each text: log of the expected toxic words, of their share, and the log odds of the most toxic word."""
    starts = text.starts_of(ends)
    mass = text.sums(one, starts, ends)
    top = np.zeros(len(ends))
    some = ends > starts
    if some.any():
        top[some] = np.maximum.reduceat(one, starts[some])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.log(mass + 1e-3), np.log(mass / np.maximum(1, ends - starts) + 1e-5), np.log(top / (1 - top))], 1)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = FIT_ROWS) -> dict | None:
    """The model from `docs` (doc_id, text) and `labels` (doc_id, `label` 0 or 1); None if a label is missing.

    Counts cover all rows; the field and the document scores are fitted on at most `rows` rows of each label, in one task.
    """
    known = cut(labelled(docs, labels, label))
    counts, docs_ = evidence(known)
    if not docs_.all():
        return None
    toxic = docs.sparkSession.sparkContext.broadcast(np.packbits(toxic_features(counts, docs_)).tobytes())
    h = F.xxhash64(F.lit("toxicity"), "doc_id")
    ids = known.select("doc_id", "label", h.alias("h"))
    # a text is taken by its id (of rows that repeat one, the smallest text); the sample is written, so that the fit reads these rows only
    chosen = [tuple(r) for k in (0, 1) for r in text.smallest(ids.where((F.col("label") == k) & F.col("doc_id").isNotNull()), rows, "doc_id")]
    few = docs.sparkSession.createDataFrame(chosen, ids.schema).distinct()  # at most 2 x `rows` rows
    sample = cut(known.join(F.broadcast(few), ["doc_id", "label"]).groupBy("doc_id", "label", "h").agg(F.min("text").alias("text")))
    names = ("w", "bias", "start", "trans", "theta")

    def run(batches):
        table, marks = text.WordTable(word_features, object), np.unpackbits(np.frombuffer(toxic.value, np.uint8)).astype(bool)
        feats, tags, firsts, sizes, y, part = [], [], [], [], [], []
        for b in text.slices(batches):
            words, code, ends = text.words_of(b.column("text"))
            each = features_of(words, table) if words else np.zeros((0, N_FEATURES), np.uint32)
            rows_ = np.repeat(b.column("label").to_numpy(), np.diff(ends, prepend=0))
            first = np.zeros(len(code), bool)
            first[text.starts_of(ends)[np.diff(ends, prepend=0) > 0]] = True
            feats.append(each[code])
            tags.append((marks[each].any(1)[code] & (rows_ == 1)).astype(np.int64))
            firsts.append(first)
            sizes.append(np.diff(ends, prepend=0))
            y.append(b.column("label").to_numpy())
            part.append(b.column("h").to_numpy() % 2 == 0)
        if not sizes:
            return
        feats, tags, firsts, sizes, y, part = (np.concatenate(x) for x in (feats, tags, firsts, sizes, y, part))
        if len(set(y[part])) < 2:
            part[:] = True
        mine = np.repeat(part, sizes)
        w, bias, start, trans = chain.fit(feats[mine].astype(np.int64), tags[mine], firsts[mine], DIMS)
        rest = ~part if len(set(y[~part])) == 2 else part
        other = np.repeat(rest, sizes)
        one = chain.marginals(w[feats[other]].sum(1) + bias, firsts[other], start, trans)
        theta = linear.fit_dense(summary(one, np.cumsum(sizes[rest])), y[rest])
        yield text.batch_of(pa.schema([(n, pa.binary()) for n in names]), *[[np.asarray(v, np.float64).tobytes()] for v in (w, bias, start, trans, theta)])

    got = sample.select("text", "label", "h").repartition(1).sortWithinPartitions("h", "label", "text").mapInArrow(run, ", ".join(f"{n} binary" for n in names)).first()
    if not got:
        return None
    model = {n: np.frombuffer(bytes(got[n]), np.float64) for n in names}
    return model | {"trans": model["trans"].reshape(2, 2), "bias": float(model["bias"][0])}


def spans_of(data: bytes, one: np.ndarray, at: float = SPAN_AT) -> list[dict]:
    """Runs of words with a marginal of at least `at`, in code points: begin, end, highest marginal."""
    out: list[dict] = []
    last = -2
    for k, m in enumerate(_WORD.finditer(data.decode("utf-8", "replace"))):
        if one[k] >= at:
            if last == k - 1:
                out[-1]["end"] = m.end()
                out[-1]["p"] = max(out[-1]["p"], float(one[k]))
            else:
                out.append({"begin": m.start(), "end": m.end(), "p": float(one[k])})
            last = k
    return out


def score(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), predicted, spans [(begin, end, p)] in code points.

    A null or empty text has the score of a text without a toxic word.  Without a model the score is 0.
    """
    rows = text.text_rows(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def run(batches):
        model = sent.value
        if model:
            weight = text.WordTable(lambda w: float(model["w"][np.frombuffer(word_features(w), np.uint32)].sum() + model["bias"]), np.float64)
        for b in text.slices(batches):
            n = len(b)
            p, spans = np.zeros(n), [[] for _ in range(n)]
            if model:
                words, code, ends = text.words_of(b.column("text"))
                starts = text.starts_of(ends)
                first = np.zeros(len(code), bool)
                first[starts[ends > starts]] = True
                one = chain.marginals(weight(words)[code], first, model["start"], model["trans"])
                p = linear.sigmoid(np.column_stack([summary(one, ends), np.ones(n)]) @ model["theta"])
                hit = np.searchsorted(ends, np.flatnonzero(one >= SPAN_AT), "right")
                for k in np.unique(hit).tolist():
                    spans[k] = spans_of(b.column("text")[k].as_py(), one[starts[k] : ends[k]])
            yield text.with_rides(b, [("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(span))], p, (p >= PREDICT_AT).astype(np.int32), spans)

    return rows.mapInArrow(run, text.ddl(rows, "score double", "predicted int", "spans array<struct<begin:long,end:long,p:double>>"))
