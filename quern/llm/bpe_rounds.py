"""Byte-level BPE by rounds over matrices.

A text is cut into pieces, and pieces further where no token of the vocabulary
holds the two bytes that meet, so that no merge can cross. Distinct pieces not
seen before are put in padded matrices, one for each range of lengths. In a
round every row finds its leftmost pair of least rank and merges it; then rows
close up, and rows without a pair leave. Pairs are looked up in a hash table of
all pairs of tokens whose joined bytes are a token.

Where a row's least pair stands in several places, a round merges all of them
if no pair that this makes has a lower rank, which is what one merge after
another would come to.

Decoding gathers the bytes of all ids of a batch by an offset table.
"""

from __future__ import annotations

import base64
import itertools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm._spark import read, small_batches
from quern.llm._text import list_array, steps, with_columns
from quern.llm.bpe import LATIN_PIECES, LATIN_TEXT, LONGEST, PIECES, REMEMBERED

#: Rank of a pair that is no token.
NONE = np.int32((1 << 31) - 1)
#: Longest rows of each matrix, doubled from here; numbers in one matrix at most.
NARROWEST, CELLS = 4, 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """Open addressing over pairs of ids: the id of the joined token, NONE where there is none."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        bits = max(4, int(len(joined) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        keys, values = self._key(left, right), joined.astype(np.int32)
        at = self._slot(keys)
        while len(keys):  # each round every free slot takes one of the keys that ask for it
            free = self.keys[at] == -1
            slots, who = np.unique(at[free], return_index=True)
            who = np.flatnonzero(free)[who]
            self.keys[slots], self.values[slots] = keys[who], values[who]
            rest = np.ones(len(keys), bool)
            rest[who] = False
            keys, values, at = keys[rest], values[rest], (at[rest] + 1) & self.mask

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _MULTIPLIER >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Negative ids stand for nothing and have no pairs."""
        shape, left, right = left.shape, left.ravel(), right.ravel()
        keys = self._key(left, right)
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], NONE)
        rest = np.flatnonzero((held != keys) & (held != -1))
        keys, at = keys[rest], at[rest]
        while len(rest):
            at = (at + 1) & self.mask
            held = self.keys[at]
            hit = held == keys
            out[rest[hit]] = self.values[at[hit]]
            on = ~hit & (held != -1)
            rest, keys, at = rest[on], keys[on], at[on]
        out[(left < 0) | (right < 0)] = NONE
        return out.reshape(shape)


@dataclass
class Ranks:
    """A vocabulary of byte strings by rank, which is also their id."""

    rank: dict[bytes, int]
    known: dict[str, bytes] = field(default_factory=dict)
    held: int = 0

    @classmethod
    def parse(cls, data: bytes) -> Ranks:
        """Lines of a base64 token and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)})

    def __post_init__(self):
        size = max(self.rank.values()) + 1
        tokens = [b""] * size
        for t, i in self.rank.items():
            tokens[i] = t
        self.table = pa.array(tokens, pa.large_binary())
        self.of_byte = np.full(256, -1, np.int32)
        self.meets = np.zeros((256, 256), bool)  # whether a token holds these two bytes one after the other
        left, right, joined = [], [], []
        for t, i in self.rank.items():
            if len(t) == 1:
                self.of_byte[t[0]] = i
            for a, b in itertools.pairwise(t):
                self.meets[a, b] = True
            for k in range(1, len(t)):
                if (a := self.rank.get(t[:k])) is not None and (b := self.rank.get(t[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    joined.append(i)
        if (self.of_byte < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        self.pairs = PairTable(*(np.array(x, np.int32) for x in (left, right, joined)))
        self.pieces = regex.compile(PIECES)

    def cut(self, text: str) -> list[str]:
        return (LATIN_PIECES if LATIN_TEXT.fullmatch(text) else self.pieces).findall(text)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as 32-bit integers. A piece that is a token is that token."""
        out: list = [None] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            if (whole := self.rank.get(p)) is not None:
                out[i] = np.int32(whole).tobytes()
            else:
                todo.append(i)
        if todo:
            data = np.frombuffer(b"".join(pieces[i] for i in todo), np.uint8)
            first = np.cumsum([0] + [len(pieces[i]) for i in todo])
            fresh = np.ones(len(data) + 1, bool)
            fresh[1:-1] = ~self.meets[data[:-1], data[1:]]
            fresh[first] = True
            starts = np.flatnonzero(fresh)  # of the runs that merges stay within
            ids, counts = self._merge_all(self.of_byte[data], starts)
            ends = np.cumsum(counts)[np.searchsorted(starts, first[1:]) - 1]
            raw, at = ids.tobytes(), 0
            for i, end in zip(todo, ends.tolist(), strict=True):
                out[i] = raw[4 * at : 4 * end]
                at = end
        return out

    def _merge_all(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merged ids of all runs one after another, and how many each run has. Runs of like length share a matrix."""
        sizes = np.diff(starts)
        counts, merged = np.ones(len(sizes), np.int64), ids.copy()  # a run's ids stay where it begins, until all are gathered
        low, high = 1, NARROWEST
        while low < (sizes.max(initial=0)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            width = min(high, int(sizes[rows].max(initial=0)))
            for at in range(0, len(rows), most := max(1, CELLS // max(1, width))):
                some = rows[at : at + most]
                cells = starts[some, None] + np.arange(width)
                own = np.arange(width) < sizes[some, None]
                matrix = np.where(own, ids[np.minimum(cells, len(ids) - 1)], -1)
                done = self._rounds(matrix)
                counts[some] = (done >= 0).sum(1)
                merged[cells[own]] = done[own]
            low, high = high, high * 2
        keep = np.arange(len(ids)) - np.repeat(starts[:-1], sizes) < np.repeat(counts, sizes)
        return merged[keep], counts

    def _rounds(self, matrix: np.ndarray) -> np.ndarray:
        """Rows of ids, padded by -1 at the end, merged to the last."""
        out = np.full_like(matrix, -1)
        live, now = np.arange(len(matrix)), matrix
        ranks = self.pairs.find(now[:, :-1], now[:, 1:])
        while True:
            least = ranks.min(1, initial=NONE)
            over = least == NONE
            if over.any():
                out[live[over], : now.shape[1]] = now[over]
                live, now, ranks, least = live[~over], now[~over], ranks[~over], least[~over]
                if not len(live):
                    return out
                width = int((now >= 0).sum(1).max())
                now, ranks = now[:, :width], ranks[:, : width - 1]
            rows = np.arange(len(now))
            chosen = self._chosen(now, ranks, least)
            r, c = np.nonzero(chosen)
            now = now.copy()
            now[r, c] = least[r]
            now[r, c + 1] = -2
            keep = now != -2
            # rows close up: what stays moves left, and the right is padding again
            to = keep.cumsum(1) - 1
            closed = np.full_like(now, -1)
            closed[np.broadcast_to(rows[:, None], now.shape)[keep], to[keep]] = now[keep]
            # a pair keeps its rank unless one of its two is new
            kept = np.full((len(now), now.shape[1] - 1), NONE, np.int32)
            stays = keep[:, :-1] & keep[:, 1:]
            a, b = np.nonzero(stays)
            kept[a, to[a, b]] = ranks[a, b]
            at = to[r, c]
            for near in (at - 1, at):
                ok = (near >= 0) & (near < kept.shape[1])
                x, y = r[ok], near[ok]
                kept[x, y] = self.pairs.find(closed[x, y], closed[x, y + 1])
            now, ranks = closed, kept

    def _chosen(self, now: np.ndarray, ranks: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Where each row merges: at its leftmost pair of least rank, and at all further ones if none of the pairs made on the way would come first."""
        rows = np.arange(len(now))
        first = ranks.argmin(1)
        chosen = np.zeros(ranks.shape, bool)
        chosen[rows, first] = True
        same = ranks == least[:, None]
        several = np.flatnonzero(same.sum(1) > 1)
        if not len(several):
            return chosen
        same, own, rank = same[several], now[several], least[several]
        # of pairs that overlap, as in aaa, every other one from the left
        place = np.arange(same.shape[1])
        begins = same & ~np.pad(same, ((0, 0), (1, 0)))[:, :-1]
        run = place - np.maximum.accumulate(np.where(begins, place, 0), axis=1)
        same &= run % 2 == 0
        r, c = np.nonzero(same)
        before = np.where(c > 0, own[r, c - 1], -1)
        before[(c > 1) & same[r, np.maximum(c - 2, 0)]] = -3
        before = np.where(before == -3, rank[r], before)  # merged just before, from the left
        after = np.where(c + 2 < own.shape[1], own[r, np.minimum(c + 2, own.shape[1] - 1)], -1)
        made = np.minimum(self.pairs.find(before, rank[r]), self.pairs.find(rank[r], after))
        early = np.zeros(len(several), bool)
        early[r[made < rank[r]]] = True
        chosen[several[~early]] = same[~early]
        return chosen

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as 32-bit integers. Pieces are remembered, up to REMEMBERED letters; of a batch, all new ones are merged together."""
        cut = [self.cut(t) if t else [] for t in texts]
        new = [p for p in dict.fromkeys(itertools.chain.from_iterable(cut)) if p not in self.known]
        found = self.known
        if new:
            ids = self.encode_pieces([p.encode() for p in new])
            fresh = dict(zip(new, ids, strict=True))
            if self.held > REMEMBERED:
                found, self.known, self.held = self.known | fresh, {}, 0  # this batch still needs the old ones
            short = {p: i for p, i in fresh.items() if len(p) <= LONGEST}
            self.known |= short
            self.held += sum(map(len, short))
            if found is self.known and len(short) < len(fresh):
                found = self.known | {p: i for p, i in fresh.items() if len(p) > LONGEST}
        return [b"".join(map(found.__getitem__, parts)) for parts in cut]

    def decode(self, ids: np.ndarray, rows: np.ndarray) -> pa.Array:
        """The bytes of lists of ids (rows: where each begins)."""
        found = self.table.take(pa.array(ids))
        ends = np.frombuffer(found.buffers()[1], np.int64)[: len(ids) + 1]
        return pa.Array.from_buffers(pa.large_binary(), len(rows) - 1, [None, pa.py_buffer(np.ascontiguousarray(ends[rows])), found.buffers()[2]])


_loaded: dict[int, Ranks] = {}


def _ranks(shared) -> Ranks:
    """One for each worker process and vocabulary."""
    data = shared.value
    if (key := hash(data)) not in _loaded:
        _loaded.clear()
        _loaded[key] = Ranks.parse(data)
    return _loaded[key]


def encode_documents(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """docs with n_tokens long, ids array<int> and decoded binary (in place of columns of those names).

    path: ranks in lines of base64 and number, read by the driver and sent to
    executors, a few MB whatever the corpus. Each match of the vocabulary's
    pattern is encoded by itself, and there are no special tokens. What was just
    encoded is decoded again. Null and empty texts have no ids and no bytes; rows
    that repeat are encoded each. A task holds a step of texts and what it
    remembers, both bounded, or one text.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        ranks = _ranks(shared)
        for batch in batches:
            for part in steps(batch, column):
                coded = ranks.encode(part.column(part.schema.get_field_index(column)).to_pylist())
                ids, rows = np.frombuffer(b"".join(coded), np.int32), np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int64)
                yield with_columns(part, {"n_tokens": pa.array(np.diff(rows)), "ids": list_array(ids, rows, pa.int32()), "decoded": ranks.decode(ids, rows).cast(pa.binary())})

    kept = [f for f in docs.schema if f.name not in ("n_tokens", "ids", "decoded")]
    return docs.mapInArrow(run, StructType(kept + StructType.fromDDL("n_tokens long, ids array<int>, decoded binary").fields))


def op12_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    done = encode_documents(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
