"""Matrix BPE against tiktoken and against one merge after another."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from quern.llm import bpe_rounds
from quern.llm.bpe_rounds import Ranks

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as f:
        return Ranks.parse(f.read())


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, np.int32).tolist()


def one_by_one(rank, piece):
    if piece in rank:
        return [rank[piece]]
    parts = [bytes([b]) for b in piece]
    while True:
        least, i = min(((rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, 0))
        if least == 1 << 60:
            return [rank[x] for x in parts]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def texts():
    r = random.Random(7)
    parts = [
        lambda n: "".join(r.choice("ab") for _ in range(n)),
        lambda n: r.choice("a =-\n\t") * n,
        lambda n: "".join(chr(r.randrange(32, 0x3000)) for _ in range(n)),
        lambda n: "".join(r.choice(["the", "ing", "ation", " ", "  ", "\n\n", "'s", "'LL", "12", "é", "ß", "日本"]) for _ in range(n)),
        lambda n: "".join(chr(r.choice([r.randrange(0x4E00, 0x9FFF), r.randrange(0x1F300, 0x1F600), 0x2028, 0x1C, 0x85, 0xA0])) for _ in range(n)),
        lambda n: r.choice(["ab", "aab", "-=", "  \n", "の", "ha"]) * n,
    ]
    return [r.choice(parts)(r.choice([1, 3, 10, 50, 400, 2000])) for _ in range(400)] + ["", "<|endoftext|>", "a" * 200_000]


def test_against_the_library(ranks, library):
    for text, raw in zip(texts(), ranks.encode(texts()), strict=True):
        assert ids(raw) == library.encode_ordinary(text), text[:80]


def test_any_ranks():
    """Vocabularies whose tokens no training would give, in which a merge can make a pair of lower rank."""
    r = random.Random(5)
    for _ in range(120):
        tokens = [bytes([b]) for b in range(256)] + list({bytes(r.choice(b"abc") for _ in range(r.randrange(2, 7))) for _ in range(r.randrange(1, 60))})
        r.shuffle(tokens)
        own = Ranks({t: i for i, t in enumerate(tokens)})
        pieces = [bytes(r.choice(b"abcd") for _ in range(r.randrange(1, 40))) for _ in range(40)]
        assert [ids(x) for x in own.encode_pieces(pieces)] == [one_by_one(own.rank, p) for p in pieces]


def test_forgetting(ranks, monkeypatch):
    """What a worker remembers is bounded, and a batch that is larger still comes out whole."""
    with open(PATH, "rb") as f:
        own = Ranks.parse(f.read())
    monkeypatch.setattr(bpe_rounds, "REMEMBERED", 20)
    batches = [[f"word{i} and more{i}x " + "y" * 100] * 2 for i in range(30)]
    assert [own.encode(b) for b in batches] == [ranks.encode(b) for b in batches]
    assert own.held < 100


def test_a_byte_is_missing():
    with pytest.raises(ValueError):
        Ranks({b"a": 0, b"b": 1})


def test_query(spark, library, tmp_path):
    given = [(1, "Hello, world's 12 best"), (2, None), (3, ""), (3, "é" * 30_000), (None, "a\x00b c"), (1, "Hello, world's 12 best"), (9, " ".join(texts()))]
    spark.createDataFrame(given, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for key, text in given:
        own = library.encode_ordinary(text or "")
        want.append((key, len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(library.decode_bytes(own)).hexdigest()))
    assert sorted(map(tuple, bpe_rounds.op12_bytebpe(spark, str(tmp_path)).collect()), key=str) == sorted(want, key=str)


def test_clashing_names_and_no_rows(spark):
    docs = spark.createDataFrame([("x", "ab", 1.5, "kept")], "text string, ids string, n_tokens double, decoded_too string")
    done = bpe_rounds.encode_documents(docs, PATH)
    assert done.columns == ["text", "decoded_too", "n_tokens", "ids", "decoded"]
    assert done.first()["decoded"] == b"x" and done.first()["n_tokens"] == 1
    assert bpe_rounds.encode_documents(docs.limit(0), PATH).count() == 0
