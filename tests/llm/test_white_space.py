"""Byte-level BPE of texts with very long runs of white space."""

import pytest

from quillspark.llm import byte_bpe


@pytest.fixture(scope="module")
def encoding():
    return byte_bpe.load_encoding(byte_bpe.ranks_path(), byte_bpe.split_pattern())


@pytest.mark.parametrize("space", [" ", "\n", "\t", " ", "\x85", " \n", "\xa0 "])
@pytest.mark.parametrize("after", ["", "word", "\x1cword", "!", "7"])
def test_runs_equal_the_whole(encoding, space, after):
    """As long as the pattern's engine still walks it."""
    for n in (byte_bpe.LONG_RUN // len(space) + 7, 100_000):
        text = "a word" + space * n + after + " tail" * 20_000 * (after != "")
        assert byte_bpe._encode(encoding, text) == encoding.encode_ordinary(text)


@pytest.mark.parametrize("text", ["word" + " " * 5_000_000 + "word", "\n" * 5_000_000, " \t" * 2_500_000 + "x", "　" * 2_000_000 + "end"], ids=["blanks", "lines", "tabs", "wide"])
def test_millions(encoding, text):
    ids = byte_bpe._encode(encoding, text)
    assert encoding.decode_bytes(ids) == text.encode()
    # the run's ids don't depend on how long it is, but for its ends
    short = byte_bpe._encode(encoding, text[:4] + text[4:60_004] + text[-4:])
    assert ids[:200] == short[:200]


def test_one_padded_document(spark):
    docs = spark.createDataFrame([(1, "a" + " " * 3_000_000 + "b"), (2, "short")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in byte_bpe.decode(byte_bpe.encode(docs)).collect()}
    assert bytes(got[1]["decoded"]) == b"a" + b" " * 3_000_000 + b"b" and bytes(got[2]["decoded"]) == b"short"
