"""Small frames with every awkward row, and the library's answers."""

from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

LONG = "alpha beta gamma. " * 30_000
ODD = [
    None, "", " ", "\n", "word", "The. <|endoftext|> a<|endoftext|>b. É, x×. don't. 's, A's.", "a   b\tc\n\n d \r\n e", "ΣΑΣ. Σ ́x é. K", "3.5, 7! <|ENDOFTEXT|>.",
    "한국어. 　 x y", "\x1c a\x1cb\x00. c", "same text twice here now", "same text twice here now", "  lead trail  ", "x" * 3000, LONG]


def odd_docs(spark):
    """Nulls, empty, long and repeated texts, a null id, repeated ids, and columns with names that operators use."""
    rows = [(k, t, "en", k % 2) for k, t in enumerate(ODD)] + [(None, "same text twice here now", None, 1), (4, "word", "en", 0), (4, "other", "de", 0)]
    made = spark.createDataFrame([(*r, "clash", 7, 0.5) for r in rows], "doc_id long, text string, lang string, quality int, digest string, row int, score double")
    return made.repartition(3), rows


@lru_cache
def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids
