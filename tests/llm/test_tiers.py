"""Hierarchical packing against the tokenizer itself."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import tiers
from quillspark.llm.byte_words import ByteWordEncoder, byte_tokenizer_path


@pytest.fixture(scope="module")
def encoder():
    return ByteWordEncoder(byte_tokenizer_path())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("aAbZ é\n\t.,'|<>!&0１ſK中ع́\x1c\x85\x00\xa0😀s", max_size=40), max_size=6))
def test_parts_encode_as_whole_texts(encoder, texts):
    assert encoder.cuts
    texts = [*texts, "it's we'll  don't\n\n x,. y?! z", ""]
    for group in (texts, [*texts, "a <|endoftext|>b  <|endoftext|>  c", "x.<|endoftext|>!"]):
        ids, bounds = encoder.encode(pa.array(group))
        want = [e.ids for e in encoder.tokenizer.encode_batch(group, add_special_tokens=False)]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want


def test_all_marks_in_use(encoder):
    text = "one\x1f two\x1e three\x1d   four."
    ids, bounds = encoder.encode(pa.array([text, "five"]))
    assert ids[:bounds[1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_long_white_space(encoder):
    for text in ("word" + " " * 3_000_000 + "word", "\n" * 2_000_000):
        ids, _ = encoder.encode(pa.array([text]))
        assert encoder.tokenizer.decode(ids.tolist()) == text


def covers(rows, documents):
    """Each id in one piece, sequences gapless and full, right checksums. ``documents``: (doc_id, ids) with repeats."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], r["length"], r["ids_crc32"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
    expected = defaultdict(list)
    for d, ids in documents:
        expected[d, len(ids)].append(np.array(ids, "<u4").tobytes())
    assert set(pieces) == set(expected)
    for key, found in pieces.items():
        # texts of one id and length: their pieces are told apart by checksum, which a single text makes exact
        assert sum(n for _, n, _ in found) == key[1] * len(expected[key])
        if len(expected[key]) == 1:
            at = 0
            for start, n, crc in sorted(found):
                assert start == at and crc == zlib.crc32(expected[key][0][4 * at:4 * (at + n)])
                at += n
        else:
            covered = Counter(i for start, n, _ in found for i in range(start, start + n))
            assert set(covered.values()) == {len(expected[key])}
            assert all(any(crc == zlib.crc32(t[4 * s:4 * (s + n)]) for t in expected[key]) for s, n, crc in found)
    for items in sequences.values():
        at = 0
        for offset, n, tier in sorted(items):
            assert offset == at and n > 0
            at += n
        assert at == items[0][2] <= 2048 and at & (at - 1) == 0
    return {s: items[0][2] for s, items in sequences.items()}


def test_odd_rows(spark, odd_docs, odd_rows, encoder):
    for per_partition in (20_000, 2):
        rows = tiers.deal_steps(tiers.pack(odd_docs, per_partition=per_partition), 4096).collect()
        want = [(r[0], encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in odd_rows]
        covers(rows, want)


def test_whole_sample(spark, sample, encoder):
    placed = tiers.deal_steps(tiers.pack(sample.repartition(5)), 32 * 2048)
    rows = placed.collect()
    want = [(r["doc_id"], encoder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]) for r in sample.collect()]
    size = covers(rows, want)
    small = [s for s in size.values() if s < 256]
    assert len(small) <= 8  # only the rest of all is cut into smaller powers of two
    steps = defaultdict(Counter)
    for s, step in {(r["sequence_id"], r["step"]) for r in rows}:
        steps[step][size[s]] += 1
    assert set(steps) == set(range(len(steps))) and len(steps) == -(-sum(size.values()) // (32 * 2048))
    for tier in set(size.values()):
        counts = [c[tier] for c in steps.values()]
        assert max(counts) - min(counts) <= 1
    assert max(sum(c.values()) for c in steps.values()) - min(sum(c.values()) for c in steps.values()) <= 1


def test_whole_documents_are_preferred():
    packer = tiers.Tiers()
    ids = memoryview(np.arange(5000, dtype="<u4").tobytes())
    for i, n in enumerate((1500, 548, 1100, 700, 248, 2048, 256)):
        packer.add(i, ids[:4 * n])
    packer.pack()
    assert not packer.rests() and {p[7] for p in packer.placed} == {2048, 256} and len(packer.placed) == 7


def test_any_lengths():
    rng = random.Random(2)
    for _ in range(200):
        lengths = [rng.choice((1, 3, 255, 256, 257, 600, 1023, 1024, 2047, 2049, 5000, rng.randint(1, 3000))) for _ in range(rng.randint(0, 12))]
        packer, ids = tiers.Tiers(), memoryview(np.arange(5000, dtype="<u4").tobytes())
        for i, n in enumerate(lengths):
            packer.add(i, ids[:4 * n])
            if rng.random() < 0.3:
                packer.pack()
                packer.keep()
        packer.pack()
        assert sum(n for n, _ in packer.rests()) < 256
        packer.finish()
        names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "part", "nth")
        covers([dict(zip(names, p)) for p in packer.placed], [(i, range(n)) for i, n in enumerate(lengths)])


def test_no_documents(no_docs):
    assert tiers.deal_steps(tiers.pack(no_docs)).collect() == []
    with pytest.raises(ValueError):
        tiers.pack(no_docs, tiers=(2000,))
