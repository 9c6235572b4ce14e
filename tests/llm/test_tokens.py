"""Token counts, token files and packing against the library itself."""

import heapq
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from common import ODD, ids_of, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st

from portlake.llm import packing, tokencount, tokenfile, vocab

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
LETTERS = st.lists(st.sampled_from(list("aBé .,'!)\n\t ß3<|") + ["́", "Σ", "<|endoftext|>", " the", "İ"]), max_size=40).map("".join)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("name", [BYTE, WORD])
@settings(max_examples=60, deadline=None)
@given(st.lists(LETTERS, max_size=6))
def test_ids_equal_the_library(name, texts):
    ids, ends = vocab.tokens(public_tokenizers.path(name)).encode(pa.array([t.encode() for t in texts], pa.binary()))
    assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [ids_of(name, t) for t in texts]


def test_counts(spark):
    docs, rows = odd_docs(spark)
    got = tokencount.count_tokens(docs, public_tokenizers.path(BYTE), frequent=5).collect()
    want = Counter((d, len((t or "").encode()), len(ids_of(BYTE, t))) for d, t, *_ in rows)
    assert Counter(map(tuple, got)) == want
    assert tokencount.count_tokens(docs.limit(0), public_tokenizers.path(BYTE)).count() == 0


def test_counts_other_vocabulary(spark):
    docs, rows = odd_docs(spark)
    got = tokencount.count_tokens(docs, public_tokenizers.path(WORD)).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((d, len(ids_of(WORD, t))) for d, t, *_ in rows)


def test_code_is_optimal_and_limited():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 300)
    heap, n = [(int(c), k, [k]) for k, c in enumerate(counts)], 300
    depth = np.zeros(300, int)
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        depth[a[2] + b[2]] += 1
        heapq.heappush(heap, (a[0] + b[0], n, a[2] + b[2]))
        n += 1
    assert depth.max() <= tokenfile.MAX_BITS
    assert (counts * depth).sum() == (counts * tokenfile.code_lengths(counts)).sum()
    steep = 2 ** np.arange(40)
    lengths = tokenfile.code_lengths(steep)
    assert lengths.max() == 16 and np.exp2(-lengths.astype(float)).sum() == 1


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 5000])
def test_blocks_round_trip(n):
    ids = np.random.default_rng(n).zipf(1.3, 6000) % 700
    code = tokenfile.Code(tokenfile.code_lengths(np.bincount(ids, minlength=700)))
    blocks = code.encode(ids[: n + 3], np.array([n, n, n + 3]))
    back = code.decode(b"".join(blocks))
    assert [b.tolist() for b in back] == [ids[:n].tolist(), [], ids[n : n + 3].tolist()]
    assert code.decode(blocks[2])[0].tolist() == ids[n : n + 3].tolist()


def test_files(spark):
    docs, rows = odd_docs(spark)
    folder = tokenfile.write_files(docs, public_tokenizers.path(WORD), end_id=2)
    got = sorted(tokenfile.read_files(spark, folder).collect(), key=lambda r: r.start)
    order = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert order == sorted(order)
    assert np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist() == [r.start for r in got]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((d, len(i), crc(i)) for d, t, *_ in rows for i in [ids_of(WORD, t) + [2]])
    assert max(r.n_tokens for r in got) > tokenfile.BLOCK_IDS  # one document fills several blocks
    empty = tokenfile.write_files(docs.limit(0), public_tokenizers.path(WORD), end_id=2)
    assert tokenfile.read_files(spark, empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000])
def test_binary_pieces(n):
    pieces = packing.binary_pieces(n, 1024)
    assert [s for s, _ in pieces] == np.cumsum([0] + [k for _, k in pieces])[:-1].tolist()
    assert sum(k for _, k in pieces) == n and all(k & (k - 1) == 0 and k <= 1024 for _, k in pieces)


def test_packing(spark):
    docs, rows = odd_docs(spark)
    got = packing.pack(docs, public_tokenizers.path(BYTE), end_id=0).collect()
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    assert all(len(r.ids) == 4 * r.length and r.length & (r.length - 1) == 0 for r in got)
    want = Counter()
    for d, t, *_ in rows:
        ids = ids_of(BYTE, t) + [0]
        want.update((d, s, crc(ids[s : s + k]), len(ids)) for s, k in packing.binary_pieces(len(ids), 1024))
    assert Counter((r.doc_id, r.start, zlib.crc32(r.ids), r.doc_tokens) for r in got) == want
    by_length = sorted(got, key=lambda r: r.sequence_id)
    assert [r.length for r in by_length] == sorted((r.length for r in got), reverse=True)
    assert packing.pack(docs.limit(0), public_tokenizers.path(BYTE), end_id=0).count() == 0
    assert len(ODD) == len(rows) - 3


def test_caches_hold_no_long_stretches():
    """Texts that cannot be cut go through the library whole and leave nothing behind."""
    import pyarrow as pa

    from portlake.llm import text, tokencount, vocab

    texts = [f"a  text that is {k} not cut because of its double space, and longer than any word" for k in range(50)]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        path = public_tokenizers.path(name)
        model, counts = vocab.Tokens(path, 1000), tokencount.PreTokens(path)
        ids, ends = model.encode(pa.array([t.encode() for t in texts], pa.binary()))
        assert [ids[a:b].tolist() for a, b in zip([0, *ends], ends)] == [ids_of(name, t) for t in texts]
        counts.count(pa.array([t.encode() for t in texts], pa.binary()))
        assert all(len(k) <= text.KEY_BYTES for k in [*model.known, *counts.known])
