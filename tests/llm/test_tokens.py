"""Tokenised outputs against the tokenizers themselves."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import byte_bpe, packing, token_output
from quillspark.llm.tokens import WordEncoder, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def encoder():
    return WordEncoder(tokenizer_path())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("aAbZ é\n\t.,'|<>!&0１ǅİıſK中ع́\x1c\x00😀ΣςI", max_size=40), max_size=6))
def test_words_encode_as_whole_texts(tokenizer, encoder, texts):
    texts = [*texts, "it's we'LL. <|endoftext|> x<|STARTOFTEXT|>!", ""]
    ids, bounds = encoder.encode(pa.array(texts))
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_forgotten_words_encode_the_same(tokenizer, monkeypatch):
    monkeypatch.setattr("quillspark.llm.tokens.CACHED_WORDS", 5)
    encoder = WordEncoder(tokenizer_path())
    for text in ("one two three four five six seven", "two eight nine " + "z" * 200, "one two"):
        ids, _ = encoder.encode(pa.array([text]))
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def ordered(rows):
    return sorted(((d, t or "") for d, t, *_ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))


def test_shards_round_trip(spark, odd_docs, odd_rows, tokenizer, tmp_path):
    manifest = token_output.write_shards(odd_docs, folder=str(tmp_path / "out"), rows_per_shard=4)
    got = token_output.read_shards(manifest).orderBy("start").collect()
    want, start = [], 0
    for d, t in ordered(odd_rows):
        ids = np.array(tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    found = {}
    for row in manifest.collect():
        shard = token_output.Shard(row["base"])
        for key in (5, 18, 19, 11, 12345):
            found.setdefault(key, []).extend(x.tolist() for x in shard.get(key))
    assert found[12345] == [] and len(found[18]) == 2 and len(found[19]) == 2 and found[5] == [[1]]
    assert found[11] == [tokenizer.encode(dict(ordered(odd_rows))[11], add_special_tokens=False).ids + [1]]


def test_no_documents(no_docs, tmp_path):
    assert token_output.read_shards(token_output.write_shards(no_docs, folder=str(tmp_path / "none"))).collect() == []
    assert packing.pack(packing.pieces(no_docs)).collect() == []
    assert byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(no_docs))).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(-(2**63), 2**63 - 1), max_size=300))
def test_perfect_hash_is_minimal(keys):
    keys = np.array(sorted(keys), np.int64)
    mph = token_output.PerfectHash.build(keys)
    assert sorted(mph.slots(keys).tolist()) == list(range(len(keys)))


def test_byte_bpe(odd_docs, odd_rows, monkeypatch):
    encoding = byte_bpe.load_encoding(byte_bpe.ranks_path(), byte_bpe.split_pattern())
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(odd_docs))).collect()
    want = []
    for d, t, *_ in odd_rows:
        ids = encoding.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


@settings(max_examples=80, deadline=None)
@given(st.text("ab1 \n\t'sé\x1c\x85中", max_size=200), st.integers(1, 20))
def test_safe_pieces_change_no_ids(text, size):
    encoding = byte_bpe.load_encoding(byte_bpe.ranks_path(), byte_bpe.split_pattern())
    pieces = byte_bpe.safe_pieces(text, size)
    assert "".join(pieces) == text
    assert [i for p in pieces for i in encoding.encode_ordinary(p)] == encoding.encode_ordinary(text)


def test_ids_inside_a_character_decode_to_raw_bytes(spark):
    encoding = byte_bpe.load_encoding(byte_bpe.ranks_path(), byte_bpe.split_pattern())
    ids = [i for i in range(300) if encoding.decode_bytes([i]) == b"\xe4"]
    row = byte_bpe.decode(spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids array<int>")).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]) for r in row] == [b"\xe4", b""]


def placed_rows(docs, **options):
    return packing.pack(packing.pieces(docs), **options).toPandas().sort_values(["sequence_id", "offset"])


@pytest.mark.parametrize("options", [{}, {"per_partition": 3}, {"capacity": 2048, "per_partition": 2, "rounds": 2}])
def test_packing_places_every_piece_once(odd_docs, odd_rows, tokenizer, options):
    got, want = placed_rows(odd_docs, **options), []
    for d, t, *_ in odd_rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, i // 2048, i, len(ids[i:i + 2048]), zlib.crc32(np.array(ids[i:i + 2048], "<u4").tobytes())) for i in range(0, len(ids), 2048)]
    rows = [(None if r.doc_id != r.doc_id else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.itertuples()]
    assert sorted(rows, key=str) == sorted(want, key=str)
    lengths = got.groupby("sequence_id")["length"]
    assert (got["offset"] == lengths.cumsum() - got["length"]).all() and lengths.sum().max() <= 2048
    if not options:
        assert got["sequence_id"].nunique() == packing.lower_bound(got["length"].to_numpy(), 2048)


def fewest(lengths, capacity):
    best = len(lengths)

    def put(i, free):
        nonlocal best
        if len(free) >= best:
            return
        if i == len(lengths):
            best = len(free)
            return
        for j in range(len(free)):
            if free[j] >= lengths[i]:
                put(i + 1, free[:j] + [free[j] - lengths[i]] + free[j + 1:])
        put(i + 1, [*free, capacity - lengths[i]])

    put(0, [])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_lower_bound_never_exceeds_the_fewest(lengths):
    lengths = np.array(sorted(lengths, reverse=True))
    where, offset, free = packing.best_fit_decreasing(lengths, 20)
    assert packing.lower_bound(lengths, 20) <= fewest(lengths.tolist(), 20) <= len(free)
    assert all((lengths[where == s].sum() == 20 - free[s]) for s in range(len(free)))


def test_bound_sees_that_three_large_pieces_need_three_sequences():
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3
    assert packing.lower_bound(np.array([7, 7, 7, 7, 7]), 20) == 3
