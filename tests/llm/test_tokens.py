from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm.encoding import UnitEncoder, resynchronised
from geoloom.llm.token_files import token_files
from geoloom.llm.tokens import token_counts
from geoloom.llm.wavelet import WaveletMatrix, from_bytes, to_bytes

BPE = public_tokenizers.path("byte_bpe_50k.json")
TOOL = UnitEncoder(BPE, memo_units=50)
ODD = ["", "a", "  a", "a  b", " a b ", "a\n b", "x<|endoftext|> y <|endoftext|>z  ", "\u3000d e", "it's  we'll\t\t x\n\n  y ", "tail \n", "ñ é ü 日本 語  x", "\x85 a\xa0 b", "a\x1c b", "foo, bar.\nBaz, 12 3.4 ß"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.text(st.characters(codec="utf-8"), max_size=40)), max_size=6))
def test_batches_equal_whole_texts(texts):
    ids, bounds = TOOL.encode_many(texts)
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [TOOL.encode_whole(x) for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(ODD), st.sampled_from(["x" * 90, "\n" * 40, " " * 30]), st.text(st.characters(codec="utf-8"), max_size=30)), max_size=8), st.integers(2, 60), st.integers(1, 20))
def test_resynchronised_chunks_equal_whole_texts(parts, chunk, overlap):
    text = "".join(parts)
    assert resynchronised(text, TOOL.spans, chunk, overlap)[0] == len(TOOL.encode_whole(text))


def test_overlaps_widen_until_they_align():
    text = "word " * 20 + "x" * 500 + " word" * 20
    n, chunks = resynchronised(text, TOOL.spans, 60, 5)
    assert n == len(TOOL.encode_whole(text)) and chunks > 5


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_of_a_table(spark, docs, name):
    path = public_tokenizers.path(name)
    texts = [*ODD, None, "long word " * 9000, "same", "same"]
    rows = token_counts(docs(texts, n_tokens="clash"), path, chunk_chars=5000, overlap_chars=50).orderBy("doc_id").collect()
    tool = UnitEncoder(path)
    assert [r.n_tokens for r in rows] == [len(tool.encode_whole(t or "")) for t in texts]
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for t in texts] and [r.over_limit for r in rows] == [r.n_tokens > 512 for r in rows]
    assert token_counts(docs(["x"]).limit(0), path).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300))
def test_wavelet_matrix(values):
    ids = np.array(values, dtype="<u2")
    matrix = WaveletMatrix.build(ids)
    assert matrix.decode().tolist() == values
    for value in {*values[:5], 7}:
        places = [k for k, x in enumerate(values) if x == value]
        assert matrix.count(value) == len(places) and matrix.find(value) == places
        assert all(matrix.rank(value, i) == sum(p < i for p in places) for i in range(0, len(values) + 1, 17))
    assert all(matrix.access(i) == values[i] for i in range(0, len(values), 11))


def test_wavelet_ranks_over_steps():
    rng = random.Random(3)
    values = [rng.choice([1, 2, 500, 65535]) for _ in range(20_000)]
    doc_ids, starts, lengths, matrix = from_bytes(to_bytes([4, 9], [12_000, 8_000], np.array(values, dtype="<u2")))
    assert (doc_ids.tolist(), starts.tolist(), lengths.tolist()) == ([4, 9], [0, 12_000], [12_000, 8_000])
    places = [k for k, x in enumerate(values) if x == 500]
    assert [matrix.select(500, n) for n in range(0, len(places), 999)] == places[::999] and matrix.rank(500, 15_000) == sum(p < 15_000 for p in places)
    assert [matrix.access(i) for i in (0, 4095, 4096, 19_999)] == [values[i] for i in (0, 4095, 4096, 19_999)]


def test_compressed_planes_answer_over_blocks():
    rng = np.random.default_rng(4)
    ids = np.minimum(rng.zipf(1.3, 700_000), 50_000).astype("<u2")
    data = to_bytes([1], [len(ids)], ids)
    assert len(data) < 0.7 * ids.nbytes  # planes, ranks and directory
    matrix = from_bytes(data)[3]
    assert (matrix.decode() == ids).all()
    for i in rng.integers(0, len(ids), 200).tolist():
        assert matrix.access(i) == ids[i]
    for value in (1, 2, 77, 50_000):
        places = np.flatnonzero(ids == value)
        assert matrix.count(value) == len(places) and matrix.rank(value, 400_001) == (places < 400_001).sum()
        assert [matrix.select(value, k) for k in (0, len(places) // 2, len(places) - 1)] == places[[0, len(places) // 2, -1]].tolist()
    assert all(len(p.open) <= 8 for p in matrix.planes)


def test_documents_without_an_id_come_first(spark):
    table = spark.createDataFrame([(2, "a b"), (None, "c"), (-5, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in token_files(table, BPE).collect()}
    assert rows[None].start == 0 and rows[-5].start == rows[None].n_tokens and rows[2].start == rows[-5].start + 1


def test_files_round_trip(spark, docs, sf_dir):
    some = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    more = docs([None, "", "a b", "long " * 5000]).selectExpr("doc_id + 100000 as doc_id", "text")
    given_ = some.union(more)
    rows = token_files(given_, BPE, shard_tokens=20_000).orderBy("doc_id").collect()
    tool, start = UnitEncoder(BPE), 0
    for row, want in zip(rows, given_.orderBy("doc_id").collect(), strict=True):
        ids = [*tool.encode_whole(want.text or ""), 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (want.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
    assert len({r.file for r in rows}) > 4
    assert token_files(some.limit(0), BPE).count() == 0
