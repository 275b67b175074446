import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def slow():
    return Tokenizer.from_file(JSON)


@pytest.fixture(scope="module")
def fast():
    return packing.Encoder(JSON, RANKS, public_tokenizers.PATTERN)


def check(df, slow, capacity=1024):
    rows = packing.pack(df, JSON, RANKS, public_tokenizers.PATTERN, capacity).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc in df.collect():
        ids = np.array(slow.encode(doc.text or "", add_special_tokens=False).ids + [0], "<u4")
        own = sorted(pieces[doc.doc_id], key=lambda r: r.start)
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]]
        n = sum(r.length for r in own)
        assert n <= capacity
    return rows


def padding(rows, capacity=1024):
    """Padding and tokens, without the last sequence of every worker."""
    filled = defaultdict(int)
    for r in rows:
        filled[r.sequence_id] += r.length
    last = {}
    for s in filled:
        last[s >> 33] = max(s, last.get(s >> 33, s))
    whole = [n for s, n in filled.items() if s not in last.values()]
    return sum(capacity - n for n in whole), sum(whole)


def test_documents(documents, slow):
    check(documents, slow)


def test_little_padding_and_few_cuts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = packing.pack(docs, JSON, RANKS, public_tokenizers.PATTERN).collect()
    pad, tokens = padding(rows)
    assert pad < 0.01 * tokens and len(rows) < 3 * docs.count()


def test_bins_hold_the_fixed_number_of_their_class():
    bins = packing.Bins(0, 1024)
    pieces = [packing.Piece(i, 0, np.zeros(n, "<u4"), n) for i, n in enumerate([1024, 500, 512, 340, 330, 341, 1, 200, 513])]
    out = [r for p in pieces for r in bins.add(p)]
    assert [(r[0], r[5], r[6]) for r in out] == [(0, 0, 0), (1, 1, 0), (2, 1, 500), (3, 2, 0), (4, 2, 340), (5, 2, 670), (8, 3, 0)]
    assert sorted(bins.waiting) == [5, 1024]
    rest = list(bins.finish())
    assert [(r[0], r[2], r[5], r[6]) for r in rest] == [(7, 200, 4, 0), (6, 1, 4, 200)]


def test_the_rest_is_laid_end_to_end():
    bins = packing.Bins(0, 16)
    for i, n in enumerate([5, 6, 3, 4]):
        assert not list(bins.add(packing.Piece(i, 10, np.arange(n, dtype="<u4"), 20)))
    rows = list(bins.finish())
    assert [r[:3] + r[4:] for r in rows] == [(1, 10, 6, 20, 0, 0), (0, 10, 5, 20, 0, 6), (3, 10, 4, 20, 0, 11), (2, 10, 1, 20, 0, 15), (2, 11, 2, 20, 1, 0)]
    assert rows[4][3] == zlib.crc32(np.array([1, 2], "<u4"))


def test_the_same_rows_in_any_run(spark, documents):
    mixed = documents.repartition(5)
    packed = packing.pack(mixed, JSON, RANKS, public_tokenizers.PATTERN)
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, packed.collect())) == sorted(map(tuple, packed.collect()))


def test_awkward_rows(docs, slow):
    rows = [(1, None), (2, ""), (3, "a"), (4, "word " * 5000), (5, "<|endoftext|> in a text"), (6, "中文 مر \U0001f600 \x85 \x1c x\xa0y"), (None, "no id")]
    check(docs(rows, {"length": F.lit(1), "offset": F.lit(0), "sequence_id": F.lit("s")}), slow)
    assert packing.pack(docs([]), JSON).count() == 0


def test_repeated_rows_are_packed_each(docs):
    rows = packing.pack(docs([(1, "a b c")] * 3), JSON, RANKS, public_tokenizers.PATTERN).collect()
    assert sum(r.length for r in rows) == 3 * rows[0].doc_tokens


@given(st.integers(1, 100_000))
def test_cut(n):
    parts = packing.cut(n)
    assert sum(parts) == n and min(parts) > 0
    for p in parts[: n // 1024]:
        assert p == 1024
    for p in parts:
        slot = 1024 // (1024 // p)
        assert slot - p <= packing.SLACK * slot


_FAST = packing.Encoder(JSON, RANKS, public_tokenizers.PATTERN)


@given(st.text())
def test_encoder_agrees_with_tokenizers(text):
    assert _FAST(text) == _FAST.slow.encode(text, add_special_tokens=False).ids


def test_encoder_on_edges(fast, slow):
    for text in ["it's  a   test\n\n x", "\t\ttabs", "a\r\nb \r c", " lead", "trail ", "x" * 3000, "1234567890", "\xa0\xa0x", "\xad soft", "caf\xe9 \xd8re", "\x85", "\x1f", " ", "<|endoftext|>"]:
        assert fast(text) == slow.encode(text, add_special_tokens=False).ids, text
