"""Language-model scores by context-tree weighting.

Text is a sequence of bytes (A-Z in lower case) and one end symbol. Each byte is
eight binary decisions; each decision has a context tree over the DEPTH bytes
before it. A node's own estimate is Krichevsky-Trofimov's; its weighted
probability is half of that and half of the product of its children's, so all
depths are mixed by the evidence of the whole training corpus. A context that
training has not seen is predicted by the deepest one that it has.

All of it is sums over byte n-grams, so Spark computes it. Tasks read whole
texts in chunks of CHUNK_BYTES; of each chunk they write the texts, its distinct
n-grams packed by their nearest context bytes, and its distinct words. N-grams
are summed by these context bytes, levels are summed upwards, weights are passed
downwards, and each n-gram gets the code length of its last byte. The n-grams
and words of every chunk are joined with the model's and dealt back to the
chunk, whose texts are scored by the little table of what they hold. So
nothing of the model passes through the driver or a broadcast, and the memory of
a task is that of a chunk, whatever the corpus.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm._spark import crc32_mod, dropped, read, small_batches, written
from quern.llm._text import Counter, Words, mix, steps, text_bytes

DEPTH = 5
END = 255  # a byte that UTF-8 never holds
#: Bytes of text whose n-grams are counted and looked up together.
CHUNK_BYTES = 32 << 20
#: Chunks that one task meets by one context; more of a frequent context are dealt to several.
FAN = 256
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: Words of the base score: what is not ASCII white space. Byte 0 is a letter, so it is written as 255.
TOKEN = _LOW.copy()
TOKEN[0] = 255
TOKEN[[9, 10, 11, 12, 13, 32]] = 0


def grams_of(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end: the byte in the lowest place, then the bytes before it, nearest first. And where each text's begin."""
    size = np.diff(offsets)
    n = len(size)
    padded = np.full(len(data) + depth * (n + 1), END, np.uint8)
    owner = np.repeat(np.arange(n), size)
    at = np.arange(len(data)) + depth * (owner + 1)
    padded[at] = _LOW[data]
    starts = np.concatenate([[0], np.cumsum(size + 1)])
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], size + 1) + np.repeat(offsets[:-1] + depth * np.arange(1, n + 1), size + 1)
    key = np.zeros(len(padded), np.uint64)
    for k in range(depth + 1):
        key[k:] |= padded[: len(padded) - k].astype(np.uint64) << np.uint64(8 * k)
    return key[place], starts


TEXT, GRAM, WORD = 2, 1, 0
#: n-grams of a step when packed rows are worked on.
_STEP = 1 << 20


def _near(depth: int) -> int:
    return min(NEAR, depth)


def split_keys(keys: np.ndarray, depth: int) -> np.ndarray:
    """n-grams in another order of bits: the nearest context bytes, then those further off, then the last byte. Sorted, those of one nearest context stand together."""
    n = _near(depth)
    near = (keys >> np.uint64(8)) & np.uint64((1 << (8 * n)) - 1)
    rest = (keys >> np.uint64(8 + 8 * n)) << np.uint64(8) | keys & np.uint64(255)
    return near << np.uint64(32) | rest


def whole_keys(near: np.ndarray, rest: np.ndarray, depth: int) -> np.ndarray:
    """The n-grams again, of the nearest context and the rest."""
    rest = rest.astype(np.uint64)
    return rest & np.uint64(255) | near.astype(np.uint64) << np.uint64(8) | (rest >> np.uint64(8)) << np.uint64(8 + 8 * _near(depth))


def packed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
    """Sorted split keys with values, by nearest context: that context, the rests as 32-bit numbers and the values, as bytes."""
    near = (keys >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]])) if len(near) else np.empty(0, np.int64)
    ends = np.append(first[1:], len(near))[: len(first)]
    rest = (keys & np.uint64((1 << 32) - 1)).astype(np.uint32)
    return near[first], [rest[a:b].tobytes() for a, b in zip(first, ends, strict=True)], [values[a:b].tobytes() for a, b in zip(first, ends, strict=True)]


def unpacked(blobs: pa.Array, dtype) -> np.ndarray:
    """All values of some rows, one after another."""
    if isinstance(blobs, pa.ChunkedArray):
        blobs = blobs.combine_chunks()
    if not len(blobs):
        return np.empty(0, dtype)
    kind = np.int64 if pa.types.is_large_binary(blobs.type) else np.int32
    ends = np.frombuffer(blobs.buffers()[1], kind)[blobs.offset : blobs.offset + len(blobs) + 1]
    data = blobs.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view(dtype) if data is not None and ends[-1] > ends[0] else np.empty(0, dtype)


def _frozen(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _chunks(docs: DataFrame, depth: int) -> DataFrame:
    """docs: doc_id, text, learn → what each chunk holds.

    kind TEXT: texts (an Arrow stream of doc_id and text) and n, of them to learn
    from. kind GRAM: near, keys and counts (0 if seen in other texts alone). kind
    WORD: one and two (128 bits of hash), n, and near: whether another word of the
    chunk has the same first half.
    """
    schema = pa.schema([("kind", pa.int32()), ("chunk", pa.int64()), ("near", pa.int64()), ("one", pa.int64()), ("two", pa.int64()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary()), ("texts", pa.binary())])

    def rows(kind: int, chunk: int, size: int, **columns) -> pa.RecordBatch:
        full = {"kind": pa.array(np.full(size, kind), pa.int32()), "chunk": pa.array(np.full(size, chunk), pa.int64())} | columns
        return pa.RecordBatch.from_arrays([full.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in schema], schema=schema)

    def run(batches):
        chunk, size, grams, words = uuid.uuid4().int >> 65, 0, Counter(), []

        def close():
            near, keys, counts = packed(*(x.astype(t) for x, t in zip(grams.merge(), (np.uint64, np.uint32), strict=True)))
            for a in range(0, len(near), 1 << 12):
                b = min(a + (1 << 12), len(near))
                yield rows(GRAM, chunk, b - a, near=pa.array(near[a:b]), keys=pa.array(keys[a:b], pa.binary()), counts=pa.array(counts[a:b], pa.binary()))
            one, two, n = _word_sums([np.concatenate(x) for x in zip(*words, strict=True)]) if words else [np.empty(0, np.uint64)] * 3
            same = one[1:] == one[:-1]
            apart = np.append(same, False) | np.append(False, same) if len(one) else np.empty(0, bool)
            for a in range(0, len(one), 1 << 14):
                part = slice(a, a + (1 << 14))
                yield rows(WORD, chunk, len(one[part]), near=pa.array(apart[part].astype(np.int64)), one=pa.array(one[part].view(np.int64)), two=pa.array(two[part].view(np.int64)), n=pa.array(n[part].astype(np.int64)))

        for batch in batches:
            for part in steps(batch, "text"):
                data, offsets = text_bytes(part.column(1))
                learn = np.asarray(part.column(2).to_pylist(), bool)
                key, at = grams_of(data, offsets, depth)
                key, of = split_keys(key, depth), np.repeat(learn, np.diff(at))
                known, times = np.unique(key[of], return_counts=True)
                grams.add(known, times)
                other = np.unique(key[~of])
                grams.add(other, np.zeros(len(other), np.int64))
                w = Words(data, offsets, TOKEN, wide=True)
                words.append(_word_sums([w.hash, w.more, np.repeat(learn, w.counts()).astype(np.int64)]))
                if len(words) > 16:
                    words = [_word_sums([np.concatenate(x) for x in zip(*words, strict=True)])]
                yield rows(TEXT, chunk, 1, n=pa.array([int(learn.sum())]), texts=pa.array([_frozen(part.select(["doc_id", "text"]))], pa.binary()))
                size += len(data) + part.num_rows
                if size >= CHUNK_BYTES:
                    yield from close()
                    chunk, size, grams, words = uuid.uuid4().int >> 65, 0, Counter(), []
        yield from close()

    return docs.select("doc_id", "text", "learn").mapInArrow(run, "kind int, chunk long, near long, one long, two long, n long, keys binary, counts binary, texts binary")


def _word_sums(words: list[np.ndarray]) -> list[np.ndarray]:
    """Numbers summed by word, of two hashes. Words that share the first stand in runs of the second, of which one may come twice; sums are of what comes."""
    one, two, n = words
    order = np.argsort(one, kind="stable")
    one, two, n = one[order], two[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])) if len(one) else np.empty(0, np.int64)
    return [one[first], two[first], np.add.reduceat(n, first) if len(first) else n]


def _log_gamma(x: Column) -> Column:
    """By Stirling's series at x + 8; exact to about 1e-12 for x >= 0.5."""
    s, low = x + 8, x
    for i in range(1, 8):
        low = low * (x + i)
    return (s - 0.5) * F.log(s) - s + 0.5 * math.log(2 * math.pi) + 1 / (12 * s) - 1 / (360 * s * s * s) + 1 / (1260 * s * s * s * s * s) - F.log(low)


def _log_kt(zeros: Column, ones: Column) -> Column:
    """Log of the KT probability of so many zeros and ones."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - math.log(math.pi) - _log_gamma(zeros + ones + 1.0)


def _kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """_log_kt of arrays."""

    def log_gamma(x):
        s, low = x + 8, x.copy()
        for i in range(1, 8):
            low *= x + i
        return (s - 0.5) * np.log(s) - s + 0.5 * math.log(2 * math.pi) + 1 / (12 * s) - 1 / (360 * s**3) + 1 / (1260 * s**5) - np.log(low)

    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - math.log(math.pi) - log_gamma(zeros + ones + 1.0)


#: Context bytes by which n-grams are dealt. What hangs below one such context has 256**(DEPTH + 1 - NEAR) n-grams at most.
NEAR = 3


def _mask(depth: int) -> np.uint64:
    """Keeps a node's bits and the nearest bytes of its context."""
    return np.uint64((1 << (8 * depth + 8)) - 1)


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return (keys[first], *(np.add.reduceat(v[order], first) if len(first) else v for v in values))


def _decisions(keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each of the eight bits of an n-gram's last byte: the node (context and the bits before it) and the bit."""
    context, byte = (keys >> np.uint64(8)) << np.uint64(8), keys & np.uint64(255)
    for j in range(8):
        yield context | np.uint64(1 << j) | (byte >> np.uint64(8 - j)), ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)


def _levels(keys: np.ndarray, n: np.ndarray, depth: int, near: int) -> list[tuple[np.ndarray, ...]]:
    """Nodes with zeros, ones, and at depths above `near` their weighted log probability; at `near` the sum of their children's. From `near` down."""
    nodes, bits = zip(*_decisions(keys), strict=True)
    nodes, bits, times = np.concatenate(nodes), np.concatenate(bits), np.tile(n.astype(np.float64), 8)
    node, zeros, ones = _summed(nodes, times * ~bits, times * bits)
    out = [(node, zeros, ones, _kt(zeros, ones) if depth > near else np.zeros(len(node)))]
    for d in range(depth - 1, near - 1, -1):
        node, zeros, ones, below = _summed(node & _mask(d), zeros, ones, out[-1][3])
        out.append((node, zeros, ones, np.logaddexp(_kt(zeros, ones), below) - math.log(2) if d > near else below))
    return out[::-1]


def _merged(rows: DataFrame, by: list[str], dtype) -> DataFrame:
    """Packed counts (near, keys, counts) summed by `by`, which begins with near: a row for each of its values, or fewer. Rows stream through a task, sorted."""

    def run(batches):
        now, held = None, Counter()

        def out():
            keys, counts = held.merge()
            near, keys, counts = packed(keys, counts)
            yield pa.RecordBatch.from_pydict({"near": pa.array(near), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

        for batch in batches:
            groups = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in by], 1)
            size = np.diff(np.frombuffer(batch.column(batch.schema.get_field_index("keys")).buffers()[1], np.int32)[: batch.num_rows + 1]) // 4
            near = groups[:, 0].astype(np.uint64)
            keys = unpacked(batch.column(batch.schema.get_field_index("keys")), np.uint32).astype(np.uint64) | np.repeat(near, size) << np.uint64(32)
            counts = unpacked(batch.column(batch.schema.get_field_index("counts")), dtype).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(size)])
            cuts = np.flatnonzero((groups[1:] != groups[:-1]).any(1)) + 1
            # whole groups of a batch are summed at once; what the last one has goes on
            last = cuts[-1] if len(cuts) else 0
            if len(cuts) or now is None or (groups[0] != now).any():
                if now is not None and (groups[0] != now).any():
                    yield from out()
                    held.parts, held.size = [], 0
                if len(cuts):
                    held.add(keys[: ends[last]], counts[: ends[last]])
                    yield from out()
                    held.parts, held.size = [], 0
            now = groups[-1]
            held.add(keys[ends[last] :], counts[ends[last] :])
        if now is not None:
            yield from out()

    return rows.select(*by, "keys", "counts").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "near long, keys binary, counts binary")


def _in_steps(batches, value: str, dtype, depth: int):
    """Packed rows, some at a time: the rows, their n-grams, the values and the number of each row."""
    for batch in batches:
        ends = np.frombuffer(batch.column(batch.schema.get_field_index("keys")).buffers()[1], np.int32)[: batch.num_rows + 1].astype(np.int64) // 4
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, ends[i] + _STEP, "right")) - 1)
            part = batch.slice(i, j - i)
            size = np.diff(ends[i : j + 1])
            near = np.repeat(part.column(part.schema.get_field_index("near")).to_numpy(), size)
            keys = whole_keys(near, unpacked(part.column(part.schema.get_field_index("keys")), np.uint32), depth)
            yield part, keys, unpacked(part.column(part.schema.get_field_index(value)), dtype), size
            i = j


def gram_scores(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """near, keys, counts (one row a context) → near, keys, scores: log10 of the probability of the last byte in its context.

    Levels deeper than the nearest context bytes are summed and weighted within a
    task, context by context; the few nodes above are sums and joins of their own.
    """
    near = _near(depth)

    def up(batches):
        for _, keys, n, _ in _in_steps(batches, "counts", np.int64, depth):
            node, zeros, ones, below = _levels(keys, n, depth, near)[0]
            yield pa.RecordBatch.from_pydict({"node": pa.array(node.astype(np.int64)), "n0": pa.array(zeros), "n1": pa.array(ones), "below": pa.array(below)})

    top = grams.mapInArrow(up, "node long, n0 double, n1 double, below double")
    levels = {}
    for d in range(near, -1, -1):
        if d < near:
            at = F.expr(f"node & {int(_mask(d))}").alias("node")
            top = levels[d + 1].groupBy(at).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("w").alias("below"))
        own = _log_kt(F.col("n0"), F.col("n1"))
        if d == depth:
            weighted = top.withColumn("w", own).withColumn("stop", F.lit(1.0))
        else:
            both = F.greatest("own", "below") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("below")))) - math.log(2)
            weighted = top.withColumn("own", own).withColumn("w", both).withColumn("stop", F.exp(F.col("own") - math.log(2) - F.col("w")))
        levels[d] = written(weighted.select("node", "n0", "n1", "w", "stop"), "level")

    # mixed: what the levels above add; left: the weight that goes on below; before: the estimate if the tree ends here
    estimate = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1)
    down = None
    for d in range(near + 1):
        if down is None:
            here = levels[0].withColumns({"mixed": F.lit(0.0), "left": F.lit(1.0), "before": F.lit(0.5)})
        else:
            own = levels[d].withColumn("parent", F.expr(f"node & {int(_mask(d - 1))}"))
            here = own.join(down.withColumnRenamed("node", "parent"), "parent")
        chance = F.when(F.col("n0") + F.col("n1") > 0, F.col("mixed") + F.col("left") * estimate).otherwise(F.col("before"))
        down = here.select("node", (F.col("mixed") + F.col("left") * F.col("stop") * estimate).alias("mixed"), (F.col("left") * (1 - F.col("stop"))).alias("left"), chance.alias("before"))

    def score(batches):
        for part, keys, n, size in _in_steps(batches, "counts", np.int64, depth):
            states = part.column(part.schema.get_field_index("states")).flatten()
            order = np.argsort(states.field("node").to_numpy(), kind="stable")
            node, mixed, left, before = (states.field(c).to_numpy()[order] for c in ("node", "mixed", "left", "before"))
            node = node.astype(np.uint64)
            for i, (here, zeros, ones, w) in enumerate(_levels(keys, n, depth, near)[1:], 1):
                d = near + i
                at = np.searchsorted(node, here & _mask(d - 1))
                guess = (ones + 0.5) / (zeros + ones + 1)
                stop = np.exp(_kt(zeros, ones) - math.log(2) - w) if d < depth else np.ones(len(here))
                mixed, left, before, node = mixed[at] + left[at] * stop * guess, left[at] * (1 - stop), np.where(zeros + ones > 0, mixed[at] + left[at] * guess, before[at]), here
            total = np.zeros(len(keys))
            for at, bit in _decisions(keys):
                p = before[np.searchsorted(node, at)]
                total += np.log10(np.where(bit, p, 1 - p))
            ends = np.concatenate([[0], np.cumsum(size)])
            scores = [total[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"near": part.column(part.schema.get_field_index("near")), "keys": part.column(part.schema.get_field_index("keys")), "scores": pa.array(scores, pa.binary())})

    # a context of three bytes has 255 nodes at most
    states = down.groupBy(F.expr(f"(node >> 8) & {(1 << (8 * near)) - 1}").alias("near")).agg(F.collect_list(F.struct("node", "mixed", "left", "before")).alias("states"))
    return grams.join(states, "near").mapInArrow(score, "near long, keys binary, scores binary")


def _looked_up(asked: DataFrame, scores: DataFrame, parts: DataFrame) -> DataFrame:
    """chunk, near, keys, scores: the scores of each chunk's n-grams. asked: chunk, near, keys; parts: near, parts for contexts that many chunks ask for.

    Of each context the model's row comes first, then the chunks', one at a time.
    """
    n = F.coalesce("parts", F.lit(1))
    own = asked.join(parts, "near", "left").select("near", F.pmod("chunk", n).alias("part"), F.lit(1).alias("turn"), "chunk", "keys", F.lit(None).cast("binary").alias("scores"))
    model = scores.join(parts, "near", "left").select("near", F.explode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("part"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("chunk"), "keys", "scores")

    def run(batches):
        now, keys, values = None, None, None
        for batch in batches:
            out = ([], [], [], [])
            near, part, turn, chunk, asked, scores = (batch.column(i) for i in range(6))
            for i, (a, p, t, c) in enumerate(zip(near.to_pylist(), part.to_pylist(), turn.to_pylist(), chunk.to_pylist(), strict=True)):
                wanted = np.frombuffer(asked[i].as_buffer(), np.uint32)
                if t == 0:
                    now, keys, values = (a, p), wanted, np.frombuffer(scores[i].as_buffer(), np.float64)
                elif now != (a, p):
                    raise ValueError("a context without its row in the model")
                else:
                    for x, y in zip(out, (c, a, asked[i].as_py(), values[np.searchsorted(keys, wanted)].tobytes()), strict=True):
                        x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["chunk", "near", "keys", "scores"])

    both = own.union(model).repartition("near", "part").sortWithinPartitions("near", "part", "turn")
    return both.mapInArrow(run, "chunk long, near long, keys binary, scores binary")


class Table:
    """Numbers by 64-bit key (never 0): open addressing, built and looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        size = 1 << max(4, (5 * len(keys) // 4).bit_length())
        self.keys, self.values, self.mask = np.zeros(size, np.uint64), np.zeros(size, values.dtype), np.uint64(size - 1)
        left, slot = np.arange(len(keys)), mix(keys) & self.mask
        while len(left):
            free = self.keys[slot[left]] == 0
            at, first = np.unique(slot[left[free]], return_index=True)
            won = left[free][first]
            self.keys[at], self.values[at] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their numbers (0 for the others)."""
        slot = mix(keys) & self.mask
        there = self.keys[slot]
        hit = there == keys
        out = np.where(hit, self.values[slot], self.values.dtype.type(0))
        left = np.flatnonzero(~hit & (there != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            there = self.keys[slot[left]]
            same = there == keys[left]
            hit[left[same]] = True
            out[left[same]] = self.values[slot[left[same]]]
            left = left[~same & (there != 0)]
        return hit, out


class _Found:
    """What a chunk's texts hold: scores by n-gram, training counts by word."""

    def __init__(self):
        self.grams, self.words, self.ready = [], [], False

    def settle(self) -> None:
        keys, scores = (np.concatenate(x) for x in zip(*self.grams, strict=True))
        self.table = Table(keys + np.uint64(1), scores)
        one, two, n = (np.concatenate(x) for x in zip(*self.words, strict=True)) if self.words else [np.empty(0, np.uint64)] * 3
        order = np.lexsort((two, one))
        self.one, self.two, self.n = one[order], two[order], n[order]
        self.grams, self.words, self.ready = [], [], True

    def counts(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The training counts of words, all of which are there; the second half of a hash counts where the first is that of several."""
        at = np.searchsorted(self.one, one)
        while len(off := np.flatnonzero((self.two[at] != 0) & (self.two[at] != two | np.uint64(1)))):
            at[off] += 1
        return self.n[at]


def _scored(rows: DataFrame, id_type, depth: int) -> DataFrame:
    """doc_id, words, known, logs, score of the texts of each chunk, from chunk, kind, near, one, two, n, keys, scores and texts: what a chunk holds, then its texts."""

    def run(batches):
        now, found = None, _Found()
        for batch in batches:
            chunk, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((chunk[1:] != chunk[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(chunk)), strict=True):
                if a == b:
                    continue
                if chunk[a] != now:
                    now, found = chunk[a], _Found()
                near, one, two, n, keys, scores, texts = (batch.column(i).slice(a, b - a) for i in range(2, 9))
                if kind[a] == WORD:
                    found.words.append((one.to_numpy().view(np.uint64), two.to_numpy().view(np.uint64), n.to_numpy()))
                elif kind[a] == GRAM:
                    rest = unpacked(keys, np.uint32)
                    size = pc.binary_length(keys).to_numpy() // 4
                    found.grams.append((rest.astype(np.uint64) | np.repeat(near.to_numpy().astype(np.uint64), size) << np.uint64(32), unpacked(scores, np.float64)))
                else:
                    if not found.ready:
                        found.settle()
                    for blob in texts:
                        for part in pa.ipc.open_stream(blob.as_buffer()):
                            yield score(part, found)

    def score(part: pa.RecordBatch, found: _Found) -> pa.RecordBatch:
        data, offsets = text_bytes(part.column(1))
        key, at = grams_of(data, offsets, depth)
        total = np.add.reduceat(found.table.find(split_keys(key, depth) + np.uint64(1))[1], at[:-1])
        w = Words(data, offsets, TOKEN, wide=True)
        n = found.counts(w.hash, w.more)
        owner = np.repeat(np.arange(len(offsets) - 1), w.counts())
        logs = np.bincount(owner, np.log10(n + 1.0), len(offsets) - 1)
        known = np.bincount(owner, n > 0, len(offsets) - 1).astype(np.int64)
        return pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (w.counts().astype(np.int64), known, logs, total))], names=["doc_id", "words", "known", "logs", "score"])

    schema = StructType([id_type, *StructType.fromDDL("words long, known long, logs double, score double").fields])
    return rows.repartition("chunk").sortWithinPartitions("chunk", "kind").mapInArrow(run, schema)


def score_texts(docs: DataFrame, learn: Column, depth: int = DEPTH) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs (doc_id, text).

    learn: which rows to learn from. score: log10 of the probability of the
    text's bytes, A-Z in lower case, and its end. base_score: log10 of that of its
    words and end under add-one counts. Null texts are empty: an end alone. With
    nothing to learn from, every bit costs a bit and base_score is 0. Repeated
    rows each get their score. Words are told apart by 128 bits of hash.
    """
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    chunks = written(_chunks(rows, depth), "chunks")
    asked = chunks.where(F.col("kind") == GRAM)
    # contexts that more than FAN chunks hold: none in a small corpus
    parts = asked.groupBy("near").agg(F.count("*").alias("n")).where(F.col("n") > FAN).select("near", F.ceil(F.col("n") / FAN).alias("parts"))
    parts = written(parts, "parts")
    dealt = asked.join(parts, "near", "left").withColumn("part", F.pmod("chunk", F.coalesce("parts", F.lit(1))))
    grams = _merged(dealt, ["near", "part"], np.uint32)
    if not parts.isEmpty():
        grams = _merged(written(grams, "grams"), ["near"], np.int64)
    grams = written(grams, "grams")
    scores = written(gram_scores(grams, depth), "scores")
    dropped(grams)

    words = chunks.where(F.col("kind") == WORD).select("chunk", "near", "one", "two", "n")
    totals = written(words.groupBy("one", "two").agg(F.sum("n").alias("total")), "words")
    total, distinct = totals.agg(F.coalesce(F.sum("total"), F.lit(0)), F.count_if(F.col("total") > 0)).first()
    ends = chunks.where(F.col("kind") == TEXT).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total, distinct = total + ends, distinct + (ends > 0)

    none = lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    found = _looked_up(asked.select("chunk", "near", "keys"), scores, parts)
    found = found.select("chunk", F.lit(GRAM).alias("kind"), "near", *none("long", "one", "two", "n"), "keys", "scores", *none("binary", "texts"))
    known = words.join(totals, ["one", "two"]).select("chunk", "one", F.when(F.col("near") == 1, F.col("two").bitwiseOR(F.lit(1))).otherwise(F.lit(0)).alias("two"), "total")
    known = written(known, "known").select("chunk", F.lit(WORD), *none("long", "near"), "one", "two", "total", *none("binary", "keys", "scores", "texts"))
    texts = chunks.where(F.col("kind") == TEXT).select("chunk", "kind", *none("long", "near", "one", "two", "n"), *none("binary", "keys", "scores"), "texts")
    done = _scored(found.union(known).union(texts), rows.schema["doc_id"], depth)
    n = F.col("words") + 1
    return done.select(
        "doc_id",
        n.alias("n_tokens"),
        (F.col("known") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + math.log10(ends + 1) - n * math.log10(total + distinct + 1)).alias("base_score"),
        "score",
    )


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    remainder = crc32_mod(F.col("doc_id"), 7)
    scored = score_texts(read(spark, sf_dir, "documents").select("doc_id", "text"), remainder != 2)
    return scored.select("doc_id", (remainder == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
