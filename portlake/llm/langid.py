"""Language by compression: the language whose dictionary makes a text smallest, unless others come close.

Each language has a raw-content dictionary of training text.  A text is compressed piece by piece with each of
them; the sizes are added up over the whole text, so that long texts do not drown the dictionary in their own words.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text

#: The fit: so many documents a language, so many bytes of each, so many bytes of dictionary.
FIT_DOCS, FIT_BYTES, DICTIONARY = 600, 400, 100_000
LEVEL, PIECE = 6, 2048
#: Below this lead of the smallest size over the next one, as a share of the latter, a text is rejected.
MARGIN = 0.004
UNKNOWN = "und"
_LETTERS = bytes(c | 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def letters(data: bytes) -> bytes:
    """Lower-case words with single spaces; ASCII digits and marks fall away."""
    return b" ".join(data.translate(_LETTERS).split())


def has_letter(data: bytes) -> bool:
    plain = letters(data)
    return bool(plain) and (any(97 <= c <= 122 for c in plain) or any(c.isalpha() for c in plain.decode("utf-8", "replace")))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, bytes]:
    """A dictionary for each language of `docs`, from at most `FIT_DOCS` documents each, chosen by a hash of the id."""
    order = Window.partitionBy("lang").orderBy("h", "doc_id", "part")
    body = F.trim(F.col(text_col))
    h = F.xxhash64(F.lit("langid"), F.col(id_col))
    room = F.greatest(F.length(body) - FIT_BYTES, F.lit(1))
    rows = docs.where(F.col(lang_col).isNotNull() & (F.length(body) > 0)).select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), h.alias("h"), F.substring(body, F.pmod(h, room).cast("int") + 1, F.lit(FIT_BYTES)).alias("part"))
    total = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    share = {lang: min(1.0, (4 * FIT_DOCS + 200) / n) for lang, n in total.items()}
    while total:
        # only rows under a hash that some 4 x FIT_DOCS rows of their language stay under are ranked
        limits = docs.sparkSession.createDataFrame([(lang, int((2 * s - 1) * 2**63) if s < 1 else None) for lang, s in share.items()], "lang string, below long")
        few = rows.join(F.broadcast(limits), "lang").where(F.col("below").isNull() | (F.col("h") < F.col("below")))
        chosen = few.withColumn("k", F.row_number().over(order)).where(F.col("k") <= FIT_DOCS).toPandas().sort_values(["lang", "k"])
        got = chosen.groupby("lang").size().to_dict()
        short = [lang for lang, n in total.items() if got.get(lang, 0) < min(n, FIT_DOCS) and share[lang] < 1]
        if not short:
            break
        share |= {lang: min(1.0, 8 * share[lang]) for lang in short}
    else:
        return {}
    return {lang: b" ".join(letters(p.encode()) for p in g["part"])[:DICTIONARY] for lang, g in chosen.groupby("lang")}


def compressors(dictionaries: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    out = []
    for lang, data in sorted(dictionaries.items()):
        params = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        words = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(compression_params=params)
        out.append((lang, zstandard.ZstdCompressor(dict_data=words, compression_params=params)))
    return out


def classify(docs: DataFrame, dictionaries: dict[str, bytes], margin: float = MARGIN, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, margin, rejected, and the columns named in `keep`.

    `und`, score 0 and rejected: a null or empty text, one without a letter, or no language learned.  Equal sizes
    give the first language by name, and a rejection.  score is margin / (margin + 5 x the limit), 0 to 1.
    """
    told = [("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("rejected", pa.bool_())]
    rows = text.text_rows(docs, id_col, text_col, keep)
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        models = compressors(sent.value)
        for b in text.slices(batches):
            cols: list[list] = [[], [], [], []]
            for data in b.column("text").to_pylist():
                lang, lead, rejected = UNKNOWN, 0.0, True
                plain = letters(data)
                if models and has_letter(data):
                    parts = [plain[k : k + PIECE] for k in range(0, len(plain), PIECE)]
                    sizes = sorted((sum(len(m.compress(p)) for p in parts), name) for name, m in models)
                    lang = sizes[0][1]
                    lead = 1.0 if len(sizes) == 1 else 1 - sizes[0][0] / sizes[1][0]
                    rejected = lead < margin
                for c, v in zip(cols, (lang, lead / (lead + 5 * margin) if lead else 0.0, lead, rejected)):
                    c.append(v)
            yield text.with_rides(b, told, *cols)

    made = rows.mapInArrow(text.tidy(run, "langid"), text.ddl(rows, "lang_pred string", "score double", "margin double", "rejected boolean"))
    return text.restored(made, keep, "doc_id", "lang_pred", "score", "margin", "rejected")
