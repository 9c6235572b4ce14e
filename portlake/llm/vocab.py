"""Token ids of whole texts by the tokenizers library, each distinct word encoded once per worker.

The library spends most of its time on words it has met before.  Where the tokenizer's own rules make a
word's ids independent of the words around it, a text is cut at single spaces and line ends, the distinct
words are encoded by the library, and the text's ids are looked up; marks at the end of a word, which these
tokenizers always part from it, are cut off first.  Texts in which such a cut could change
the result (runs of white space), and tokenizers with other rules, go through the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import text

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Text dealt with at a time, and distinct words (of at most `text.KEY_BYTES`) whose ids a worker keeps; both set its memory.
SLICE_BYTES, KNOWN_WORDS = 6 << 20, 400_000
_WHITE = rb"[ \n\t\r\x0b\x0c]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
_RUN = re.compile(rb"[ \n](?:" + _WHITE + rb")|(?:" + _WHITE + rb")[ \n]")
_RARE_WHITE = (b"\t", b"\r", b"\x0b", b"\x0c", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
#: A letter or digit and marks behind it: these tokenizers always part them (an apostrophe may start a contraction).
_MARKS = "([A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,;:!?)]+)"
_JOIN = b"\0"  # in front of marks that have no space before them


def has_run(data: bytes) -> bool:
    """Whether two white characters meet, one of them a space or line end."""
    if b"  " in data or b"\n\n" in data or b" \n" in data or b"\n " in data:
        return True
    return any(w in data for w in _RARE_WHITE) and bool(_RUN.search(data))


def word_rule(path: str) -> str:
    """`spaced`: a space belongs to the word after it; `bare`: white space is dropped; `whole`: neither is known to hold."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, norm, after = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}, spec.get("post_processor")
    if spec["model"].get("type") != "BPE" or any(t.get("lstrip") or t.get("rstrip") or t.get("normalized") or re.search(r"\s|" + _MARKS, t["content"]) for t in spec.get("added_tokens", [])):
        return "whole"
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not norm and not after:
        return "spaced"
    steps = before.get("pretokenizers") or []
    split = steps[0] if steps else {}
    letters = split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") and split.get("pattern", {}).get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+")
    parts = [n.get("type") for n in norm.get("normalizers", [])]
    if letters and set(parts) <= {"NFC", "Replace", "Lowercase"} and spec["model"].get("end_of_word_suffix") and not after:
        return "bare"
    return "whole"


def chunks(texts: pa.Array, rule: str, fold: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Stretches of text that a tokenizer of this rule treats on their own: the distinct ones, the number of each in a row,
    and where each text's stretches end.  A text that cannot be cut is one stretch.  `fold`: ASCII letters in lower case."""
    if rule == "bare":
        plain = text.as_text(texts)
        return text.coded(pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(plain) if fold else plain, _MARKS, r"\1 \2")))
    raw = texts.to_pylist()
    whole = [k for k, t in enumerate(raw) if rule == "whole" or _JOIN in t or has_run(t)]
    if whole:
        mask = np.ones(len(raw), bool)
        mask[whole] = False
        keys, codes, ends = chunks(texts.filter(pa.array(mask)), rule) if mask.any() else ([], np.zeros(0, np.int64), np.zeros(0, np.int64))
        sizes = np.ones(len(raw), np.int64)
        sizes[mask] = np.diff(ends, prepend=0)
        ends = np.cumsum(sizes)
        out = np.empty(ends[-1], np.int64)
        at = np.repeat(mask, sizes)
        out[at] = codes
        out[~at] = len(keys) + np.arange(len(whole))
        return keys + [raw[k] for k in whole], out, ends
    lines = pc.replace_substring(text.as_text(texts), "\n", " \n ")
    words, code, ends = text.coded(pc.split_pattern(pc.replace_substring_regex(lines, _MARKS, "\\1 \0\\2"), " "))
    n, first = len(words), np.zeros(len(code), bool)
    first[text.starts_of(ends)] = True  # an empty text has one empty word
    if b"\n" in words:
        line = np.flatnonzero(code == words.index(b"\n"))
        first[line] = True
        first[line + 1] = True
    code = code.astype(np.int64) + n * first
    used = np.bincount(code, minlength=2 * n) > 0
    keys = [words[k - n] if k >= n else b" " + words[k] for k in np.flatnonzero(used).tolist()]
    return [k[2:] if k[1:2] == _JOIN else k for k in keys], (np.cumsum(used) - 1)[code], ends


class Tokens:
    """Ids of texts, without added special tokens."""

    def __init__(self, path: str, limit: int):
        from tokenizers import Tokenizer

        self.rule, self.limit = word_rule(path), limit
        text.give_back()  # the file's objects go before the library reads it: both at once set the peak of a worker
        self.library = Tokenizer.from_file(path)
        text.give_back()
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.known: dict[bytes, bytes] = {}
        self.sizes = self._sizes()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.folds = self.rule == "bare" and "Lowercase" in str(self.library.normalizer)

    def _ids(self, texts: list[str]) -> list[bytes]:
        kind = "H" if self.dtype.itemsize == 2 else "I"
        return [array(kind, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _sizes(self) -> np.ndarray:
        """Bytes of text that each id stands for, in a byte-level vocabulary."""
        added = {k: len(t.content.encode()) for k, t in self.library.get_added_tokens_decoder().items()}
        names = (self.library.id_to_token(k) or "" for k in range(self.library.get_vocab_size(with_added_tokens=True)))
        return np.array([added.get(k, len(n.removesuffix("</w>") if self.rule == "bare" else n)) for k, n in enumerate(names)], np.int64)

    def _word_ids(self, words: list[bytes]) -> list[bytes]:
        """Ids of words, all in one text where it can be cut again by the bytes that its ids stand for."""
        plain = lambda: self._ids([w.decode("utf-8", "replace") for w in words])
        joined = (b" " if self.rule == "bare" else b"").join(words)
        if len(words) < 50 or has_run(joined):
            return plain()
        try:
            whole = joined.decode()
        except UnicodeDecodeError:
            return plain()
        if self.rule == "bare":
            sizes = [len(w.encode()) for w in self.library.normalizer.normalize_str(whole).split(" ")]
        else:
            sizes = [len(w) for w in words]
        ids = np.array(self.library.encode_batch_fast([whole], add_special_tokens=False)[0].ids, self.dtype)
        want, have = np.cumsum(sizes), np.cumsum(self.sizes[ids])
        at = np.searchsorted(have, want)
        if len(want) != len(words) or not len(have) or want[-1] != have[-1] or (have[at] != want).any():
            return plain()
        data, ends = ids.tobytes(), ((at + 1) * self.dtype.itemsize).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends)]

    def learn(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct stretches of text; when there is no room, only what these use stays known."""
        known = self.known
        new = {w for w in words if w not in known}
        long = [w for w in new if len(w) > text.KEY_BYTES]  # among them texts that could not be cut
        new.difference_update(long)
        if len(new) + len(known) > self.limit:
            stay = [(w, known[w]) for w in words if w in known]
            known.clear()
            known.update(stay)
        after = [w for w in new if self.rule == "bare" and w or self.rule == "spaced" and len(w) > 1 and w[0] == 32]
        known.update(zip(after, self._word_ids(after)))
        other = list(new.difference(after))
        known.update(zip(other, self._ids([w.decode("utf-8", "replace") for w in other])))
        once = dict(zip(long, self._ids([w.decode("utf-8", "replace") for w in long])))
        return [known[w] if len(w) <= text.KEY_BYTES else once[w] for w in words]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids end."""
        fold = self.folds and not any(pc.any(pc.match_substring(texts, a, ignore_case=True)).as_py() for a in self.added)
        words, code, ends = chunks(texts, self.rule, fold)
        each = self.learn(words)
        sizes = np.fromiter(map(len, each), np.int64, len(each)) // self.dtype.itemsize
        pool = np.frombuffer(b"".join(each), self.dtype)
        begin = np.cumsum(sizes) - sizes
        size = sizes[code]
        stop = np.cumsum(size)
        at = np.arange(stop[-1] if len(stop) else 0, dtype=np.int32)  # a slice has far fewer ids
        at += np.repeat((begin[code] - (stop - size)).astype(np.int32), size)
        ids = pool[at]
        pa.default_memory_pool().release_unused()
        return ids, np.concatenate([[0], stop])[ends]


@lru_cache(maxsize=2)
def tokens(path: str, limit: int = KNOWN_WORDS) -> Tokens:
    """One per worker process and vocabulary."""
    return Tokens(path, limit)


text.KEPT.append(tokens.cache_clear)
