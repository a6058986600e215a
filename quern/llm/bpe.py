"""Byte-level BPE encoding and decoding.

Encoding: an Aho-Corasick automaton over all token byte strings gives, in one
scan of a piece, the longest token starting at each byte. Tokens are then laid
left to right; a token may follow another only if merging their joined bytes
gives back exactly these two (the pair-compatibility table, memoised). A
position from which no compatible token continues is marked and never tried
again, so each (position, token) is tried once: the exact result of applying
merges by rank, in time linear in the piece.

Decoding: one blob of all tokens' bytes and a table of offsets into it; the
bytes of all texts of a batch are gathered at once, from the ids just made.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm._spark import read, small_batches
from quern.llm._text import list_array, steps, with_columns

#: How byte-level vocabularies cut text into pieces (fixed value); white space is Unicode's property.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same cut by the faster standard module, for texts of the letters up to U+024F, in which these classes say the same.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
LATIN_PIECES = re.compile(rf" ?[{_LATIN}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\t-\r {_LATIN}0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
LATIN_TEXT = re.compile("[\t-\r -~¡-©«-±´¶-¸»¿-ɏ‘-…]*")
#: Letters of distinct pieces, and pairs of tokens, that a Python worker remembers; then it starts anew. Longer pieces are not remembered.
REMEMBERED, PAIRS, LONGEST = 4_000_000, 500_000, 64
#: Tokens decoded at once.
_STEP = 1 << 20


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, by rule."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Tokenizer:
    """Tables of one vocabulary. Byte strings are held as latin-1 text, one letter a byte."""

    token_id: dict[str, int]
    rank: dict[int, int]  # of a merged token; single bytes have none
    halves: dict[int, tuple[int, int]]
    merged: dict[tuple[int, int], int]
    special: dict[str, int]
    table: pa.Array  # the bytes of each id: one blob and the offsets into it
    letters: list[str] = field(default_factory=list)
    fits: dict[tuple[int, int], bool] = field(default_factory=dict)
    shorter: dict[int, int] = field(default_factory=dict)
    known: dict[str, bytes] = field(default_factory=dict)
    held: int = 0

    @classmethod
    def parse(cls, text: str) -> Tokenizer:
        """From the JSON of a byte-level BPE without normaliser, prefix space or dropout."""
        spec, byte = json.loads(text), byte_letters()
        raw = lambda s: "".join(chr(byte[c]) for c in s)
        vocab = spec["model"]["vocab"]
        token_id = {raw(s): i for s, i in vocab.items()}
        rank, halves, merged = {}, {}, {}
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            merged[left, right] = r
            if whole not in rank:
                rank[whole], halves[whole] = r, (left, right)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = max([*token_id.values(), *special.values()]) + 1
        parts, letters = [b""] * size, [""] * size
        for s, i in token_id.items():
            parts[i], letters[i] = s.encode("latin-1"), s
        for s, i in special.items():
            parts[i] = s.encode()
        return cls(token_id, rank, halves, merged, special, pa.array(parts, pa.large_binary()), letters)

    def __post_init__(self):
        self.automaton = ahocorasick.Automaton()
        for s, i in self.token_id.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.pieces = regex.compile(PIECES)
        self.splits = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def compatible(self, left: int, right: int) -> bool:
        """Whether BPE of the joined bytes of both tokens gives these two tokens.

        The merges that made both are undone from the latest back. If, at any
        moment, the two pieces that meet at the border could merge earlier than
        the merge undone last, BPE would have crossed the border.
        """
        if (known := self.fits.get((left, right))) is not None:
            return known
        if len(self.fits) >= PAIRS:
            self.fits.clear()
        a, b, before, out = left, right, 1 << 60, True
        while True:
            if self.merged.get((a, b), before) < before:
                out = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # of equal merges, that further left comes first, and so is undone last
            if ra > rb:
                before, a = ra, self.halves[a][1]
            else:
                before, b = rb + 1, self.halves[b][0]
        self.fits[left, right] = out
        return out

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        if (found := self.shorter.get(token)) is None:
            s = self.letters[token]
            found = next((self.token_id[s[:k]] for k in range(len(s) - 1, 0, -1) if s[:k] in self.token_id), -1)
            self.shorter[token] = found
        return found

    def encode_piece(self, piece: str) -> list[int]:
        """piece: latin-1 text of the bytes."""
        n, letters = len(piece), self.letters
        longest = [(0, -1)] * n
        for end, match in self.automaton.iter(piece):
            at = end - match[0] + 1
            if match[0] > longest[at][0]:
                longest[at] = match
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0][1] if n else -1
        while at < n:
            while token >= 0:
                end = at + len(letters[token])
                if not dead[end] and (not out or self.compatible(out[-1], token)):
                    break
                token = self.next_shorter(token)
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at][1] if at < n else -1
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte")
                dead[at] = 1
                token = out.pop()
                at -= len(letters[token])
        return out

    def encode_ordinary(self, text: str) -> bytes:
        known, parts = self.known, (LATIN_PIECES if LATIN_TEXT.fullmatch(text) else self.pieces).findall(text)
        try:
            return b"".join(map(known.__getitem__, parts))
        except KeyError:
            return b"".join([known.get(p) or self._learn(p) for p in parts])

    def _learn(self, piece: str) -> bytes:
        ids = np.array(self.encode_piece(piece.encode().decode("latin-1")), np.int32).tobytes()
        if len(piece) <= LONGEST:
            if self.held > REMEMBERED:
                self.known.clear()
                self.held = 0
            self.known[piece] = ids
            self.held += len(piece)
        return ids

    def encode(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers; strings of special tokens become these tokens."""
        if self.splits is None or not any(s in text for s in self.special):
            return self.encode_ordinary(text)
        return b"".join(np.array([self.special[p]], np.int32).tobytes() if p in self.special else self.encode_ordinary(p) for p in self.splits.split(text))

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> list[str]:
        """The texts of lists of ids (rows: where each begins). Bytes that are no UTF-8 become U+FFFD."""
        texts, i = [], 0
        while i < len(rows) - 1:
            j = max(i + 1, int(np.searchsorted(rows, rows[i] + _STEP, "right")) - 1)
            found = self.table.take(pa.array(ids[rows[i] : rows[j]]))
            ends, data = np.frombuffer(found.buffers()[1], np.int64), found.buffers()[2]
            cuts = ends[rows[i : j + 1] - rows[i]].tolist()
            data = memoryview(data) if data is not None else b""
            texts += [str(data[a:b], "utf-8", "replace") for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            i = j
        return texts


_loaded: dict[int, Tokenizer] = {}


def _tokenizer(shared) -> Tokenizer:
    """One for each worker process and vocabulary."""
    text = shared.value
    if (key := hash(text)) not in _loaded:
        _loaded.clear()
        _loaded[key] = Tokenizer.parse(text)
    return _loaded[key]


def _vocabulary(spark: SparkSession, path: str):
    """The tokenizer's JSON, read by the driver and sent to executors: one vocabulary, a few MB whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _encoded(tokenizer: Tokenizer, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts and where each text's begin."""
    parts = [tokenizer.encode(t) if t else b"" for t in texts]
    return np.frombuffer(b"".join(parts), np.int32), np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)


def bpe_encode(spark: SparkSession, text: Column, path: str) -> Column:
    """The ids of a text, array<int>; a null text has none. path: a tokenizer's JSON, read by the driver."""
    shared = _vocabulary(spark, path)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        ids, rows = _encoded(_tokenizer(shared), texts.to_pylist())
        return list_array(ids, rows, pa.int32())

    return encode(text)


def bpe_decode(spark: SparkSession, ids: Column, path: str) -> Column:
    """The text of an array of ids, special tokens included; of null, the empty text. Unknown ids fail."""
    shared = _vocabulary(spark, path)

    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        if lists.null_count:
            lists = lists.fill_null([])
        rows = lists.offsets.to_numpy().astype(np.int64)
        ids = lists.values.to_numpy(zero_copy_only=False)[rows[0] : rows[-1]]
        return pa.array(_tokenizer(shared).decode(ids, rows - rows[0]), pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with n_tokens long, ids array<int> and decoded string (in place of columns of those names).

    One pass: what was just encoded is decoded again. Null and empty texts have no
    ids and the empty text. Rows that repeat are encoded each. A text's ids and the
    text are held in one task, never two texts beyond a batch.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = _vocabulary(spark, path)

    def run(batches):
        tokenizer = _tokenizer(shared)
        for batch in batches:
            for part in steps(batch, "text"):
                ids, rows = _encoded(tokenizer, part.column(part.schema.get_field_index("text")).to_pylist())
                new = {"n_tokens": pa.array(np.diff(rows)), "ids": list_array(ids, rows, pa.int32()), "decoded": pa.array(tokenizer.decode(ids, rows), pa.string())}
                yield with_columns(part, new)

    kept = [f for f in docs.schema if f.name not in ("n_tokens", "ids", "decoded")]
    return docs.mapInArrow(run, StructType(kept + StructType.fromDDL("n_tokens long, ids array<int>, decoded string").fields))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
