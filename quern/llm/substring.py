"""Substring dedup by compact windows: passages that near-repeat across documents.

Tokens are word 5-grams. For one hash function the Cartesian tree over a text's
token hashes gives, for each token, the widest range in which its hash is the
least: all passages inside that range and around that token share one signature
(a compact window). Only windows that hold a passage of MIN_WORDS words are
kept, about 2 in 47 tokens. Documents meet where they have a window with the
same hash function and value; a window that no other document has is dropped.

What meets may share no more than a line around the token, and so may the first
document of a group with any other. So the windows that are left are looked at
once more, by what stands around the token:

- exact repeats, in windows of one function. Windows that agree as far as a
  passage can reach are tied as they stand, and one goes on for all. Of the
  others, those that share half a passage to either side are tied by every run of
  a passage's length on that side. A run lies in one window alone, so this finds
  each run of MIN_WORDS words that two documents share, whatever else shares its
  token.
- near repeats, by the first grouping and by the least token with the tokens next
  to it. Ranges aligned at the token are intersected, and overlapping ranges
  under at least NEED of HASHES functions are a candidate, which is verified on
  the words of both.

Within a group every document is tied to the group's first document, not to
every other: tasks tie their own documents before the shuffle, so a passage that
a third of all documents hold costs each task one row, and the pairs grow with
the documents. Passages tied directly or through others form one class.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quern.llm._graph import components, sorted_groups
from quern.llm._spark import read, small_batches, written
from quern.llm._text import SHINGLE_WORDS, Words, mix, shingles, steps, text_bytes, with_columns

MIN_WORDS, HASHES, NEED, THRESHOLD = 50, 4, 2, 0.8
#: Tokens without a match that a passage may span: two changed words apart.
GAP = 2 * SHINGLE_WORDS
#: Windows that a task holds before it ties and hands them on.
HELD = 1 << 19
#: Words to which the stretches compared are rounded, so that documents ask for few different ones of a common leader.
_ROUND = 16
#: Tokens on either side that near repeats share with the least one.
BESIDE = 3
#: In place of a hash function: an exact run; all that a passage can reach; half a passage to the left, to the right.
EXACT, AROUND, LEFT, RIGHT = -1, -2, -3, -4


def _slide(a: np.ndarray, size: int, op) -> np.ndarray:
    """op over every run of so many elements, by doubling."""
    width = 1
    while 2 * width <= size:
        a, width = op(a[:-width], a[width:]), 2 * width
    return op(a[: len(a) - (size - width)], a[size - width :]) if width < size else a


def compact_windows(values: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions with the first and last of the range in which each has the least value; ranges of at least so many tokens.

    values: positive, text after text; starts: where each text begins, and the
    end. Of equal values the first counts as the least. A token whose range is
    long enough is the least of some run of that length, and so is the next
    smaller one on either side: the tree is built over these tokens alone.
    """
    n = len(starts) - 1
    shift = np.repeat(np.arange(n), np.diff(starts))
    padded = np.zeros(len(values) + n, np.uint64)
    where = np.arange(len(values)) + shift
    padded[where] = values
    ends = starts[1:] + np.arange(n)  # a zero behind each text
    empty = np.empty(0, np.int64)
    if len(padded) < least:
        return empty, empty, empty
    low = _slide(padded, least, np.minimum)
    edge = np.zeros(least - 1, np.uint64)
    high = _slide(np.concatenate([edge, low, edge]), least, np.maximum)
    chosen = np.flatnonzero((padded == high) & (padded > 0))
    at = np.sort(np.concatenate([chosen, ends]))
    value, place = padded[at].tolist(), at.tolist()
    left, right = [0] * len(at), [0] * len(at)
    stack: list[int] = []
    for i, v in enumerate(value):
        while stack and value[stack[-1]] > v:
            right[stack.pop()] = place[i] - 1
        left[i] = place[stack[-1]] + 1 if stack else 0
        if v:
            stack.append(i)
        else:
            stack = [i]
    first, last = np.array(left, np.int64), np.array(right, np.int64)
    keep = (padded[at] > 0) & (last - first + 1 >= least)
    back = np.cumsum(padded == 0)  # zeros before a place, which are no tokens; every text ends with one
    at, first, last = at[keep], first[keep], last[keep]
    return at - back[at], first - back[at], last - back[at]


_SEEDS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def windows_of(grams: np.ndarray, starts: np.ndarray, hashes: int, least: int) -> dict[str, np.ndarray]:
    """All compact windows of some texts: key (function and value), row, pos, lo, hi (tokens of the text) and h."""
    parts = []
    for h in range(hashes):
        values = np.maximum(mix(grams ^ _SEEDS[h]), np.uint64(1))
        at, lo, hi = compact_windows(values, starts, least)
        row = np.searchsorted(starts, at, "right") - 1
        key = mix(values[at] + _SEEDS[32 + h]).view(np.int64)
        parts.append((key, row, at - starts[row], lo - starts[row], hi - starts[row], np.full(len(at), h)))
    return dict(zip(("key", "row", "pos", "lo", "hi", "h"), (np.concatenate(x) for x in zip(*parts, strict=True)), strict=True))


_ODD = np.uint64(0x9E3779B97F4A7C15)


def doubled(tokens: np.ndarray, most: int) -> list[np.ndarray]:
    """Hashes of every run of 1, 2, 4, ... tokens, up to `most`; not linear, so that no pattern makes runs collide."""
    out = [tokens]
    while 2 << (len(out) - 1) <= most and len(out[-1]) > 1 << (len(out) - 1):
        width = 1 << (len(out) - 1)
        out.append(mix(mix(out[-1][:-width]) * _ODD + out[-1][width:]))
    return out


def run_hash(runs: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of the tokens first to last, from two runs of `doubled` that cover them, and of their number."""
    size = last - first + 1
    power = np.frexp(size.astype(np.float64))[1] - 1  # of two, at most the size
    out = np.empty(len(first), np.uint64)
    for p in np.unique(power):
        at = np.flatnonzero(power == p)
        out[at] = mix(mix(runs[p][first[at]]) * _ODD + runs[p][last[at] - (1 << int(p)) + 1])
    return mix(out + size.astype(np.uint64))


def tie(key, doc, pos, lo, hi, h, known, least: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of windows sorted by key, doc and pos, those whose group holds two documents, and of these: which are of the group's first document, and the tie of each other to its first window.

    known: rows that stand for a group with two documents. A tie is the leader,
    the range s to e that both share, and k, how much further on the leader has
    it; lead and s are -1 where the range is too narrow for a passage or both
    are of one document.
    """
    n = len(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if n else np.empty(0, np.int64)
    size = np.diff(np.append(first, n))
    met = np.repeat((doc[first + size - 1] != doc[first]) | np.maximum.reduceat(known, first).astype(bool), size) if n else np.empty(0, bool)
    lead = np.repeat(first, size)
    before = np.minimum(pos - lo, pos[lead] - lo[lead])
    after = np.minimum(hi - pos, hi[lead] - pos[lead])
    wide = (before + after + 1 >= THRESHOLD * least) & (doc != doc[lead])
    return met, {"of_lead": doc == doc[lead], "lead": np.where(wide, doc[lead], -1), "s": np.where(wide, pos - before, -1), "e": np.where(wide, pos + after, -1), "k": np.where(wide, pos[lead] - pos, 0)}


_TIE = "doc long, pos int, lo int, hi int, h int, lead long, s int, e int, k int"
#: A window on its way: `at` is pos and h, `range` lo and hi, `span` s and e. state: KNOWN if it stands for a group with two documents, PASSING if tied.
_ROW = "key long, doc long, state int, at long, range long, lead long, span long, k int"
KNOWN, PASSING = 1, 2


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(name, pa.int64() if kind == "long" else pa.int32()) for name, kind in (c.split() for c in ddl.split(", "))])


def _batches(columns: dict[str, np.ndarray], ddl: str) -> Iterator[pa.RecordBatch]:
    schema = _schema(ddl)
    for a in range(0, len(columns["doc"]), 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(columns[f.name][a : a + (1 << 14)].astype(np.int64)).cast(f.type) for f in schema], schema=schema)


def _packed(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows with key, state and the columns of _TIE in fewer and wider columns."""
    two = lambda a, b: np.where(a < 0, -1, (a << 32) | b)
    return {c: rows[c] for c in ("key", "doc", "state", "lead", "k")} | {"at": (rows["pos"] << 8) | (rows["h"] + 8), "range": two(rows["lo"], rows["hi"]), "span": two(rows["s"], rows["e"])}


def _unpacked(table: pa.Table) -> dict[str, np.ndarray]:
    rows = {f: table[f].to_numpy().astype(np.int64) for f in table.column_names}
    at, own, span, low = rows.pop("at"), rows.pop("range"), rows.pop("span"), (1 << 32) - 1
    return rows | {"pos": at >> 8, "h": (at & 255) - 8, "lo": own >> 32, "hi": own & low, "s": span >> 32, "e": np.where(span < 0, -1, span & low)}


def _joined(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Ties of exact runs that go on from one another as one tie each; the others as they are."""
    exact = rows["h"] == EXACT
    own = {c: x[exact] for c, x in rows.items()}
    order = np.lexsort([own[c] for c in ("s", "k", "lead", "doc")])
    own = {c: x[order] for c, x in own.items()}
    fresh = np.ones(len(order), bool)
    fresh[1:] = (own["s"][1:] > own["e"][:-1] + 1) | np.logical_or.reduce([own[c][1:] != own[c][:-1] for c in ("k", "lead", "doc")])
    first = np.flatnonzero(fresh)
    ends = own["e"][np.append(first[1:], len(order)) - 1] if len(first) else own["e"]
    own = {c: x[first] for c, x in own.items()} | {"e": ends}
    return {c: np.concatenate([x[~exact], own[c]]) for c, x in rows.items()}


def _ties(rows: DataFrame, windows: Callable, least: int) -> DataFrame:
    """doc, pos, lo, hi, h, lead, s, e, k: every window that another document has too, with its tie. One shuffle, of windows.

    windows: of a piece of a batch of rows with text, gives key, doc, pos, lo, hi and h.
    """

    def tie_own(batches):
        held, size = [], 0

        def out():
            if not held:
                return
            key, doc, pos, lo, hi, h = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((pos, doc, key))
            rows = dict(zip(("key", "doc", "pos", "lo", "hi", "h"), (x[order] for x in (key, doc, pos, lo, hi, h)), strict=True))
            met, found = tie(*rows.values(), np.zeros(len(order), np.int64), least)
            rows |= {"state": met * KNOWN, **{c: found[c] for c in ("lead", "s", "e", "k")}}
            # of a group with two documents the first one stands for all; the others travel with their tie by a key of their own
            passing = met & ~found["of_lead"]
            yield from _batches(_packed({c: x[~passing] for c, x in rows.items()}), _ROW)
            done = _joined({c: x[passing] for c, x in rows.items()})
            done["key"] = mix(done["doc"].view(np.uint64) + done["pos"].astype(np.uint64)).view(np.int64)
            yield from _batches(_packed(done | {"state": np.full(len(done["doc"]), PASSING)}), _ROW)

        for batch in batches:
            for part in steps(batch, "text"):
                held.append(windows(part))
                size += len(held[-1][0])
                if size > HELD:
                    yield from out()
                    held, size = [], 0
        yield from out()

    def tie_all(batches):
        names = [f.name for f in _schema(_TIE)]
        for table, _ in sorted_groups(batches, ["key"]):
            rows = _unpacked(table)
            passing = rows["state"] == PASSING
            yield from _batches({c: rows[c][passing] for c in names}, _TIE)
            own = {c: x[~passing] for c, x in rows.items()}
            met, found = tie(*(own[c] for c in ("key", "doc", "pos", "lo", "hi", "h", "state")), least)
            yield from _batches(_joined({c: (found if c in found else own)[c][met] for c in names}), _TIE)

    dealt = rows.mapInArrow(tie_own, _ROW).repartition("key").sortWithinPartitions("key", "doc", "at")
    return dealt.mapInArrow(tie_all, _TIE)


def first_ties(docs: DataFrame, hashes: int, least: int) -> DataFrame:
    """Ties of all windows of docs (doc, text), by function and value."""

    def windows(part):
        grams, starts = shingles(Words(*text_bytes(part.column(1))))
        w = windows_of(grams, starts, hashes, least)
        doc = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[w["row"]]
        return w["key"], doc, w["pos"], w["lo"], w["hi"], w["h"]

    return _ties(docs, windows, least)


def _windows_in(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of rows with doc, text and windows (a list of pos, lo, hi, h): the tokens of all texts; of each window its text's start among them, its doc, pos, lo, hi and h."""
    grams, starts = shingles(Words(*text_bytes(part.column(1))))
    lists = part.column(2)
    row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    w = lists.flatten()
    doc = part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[row]
    return grams, starts[:-1][row], doc, *(w.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "lo", "hi", "h"))


def _by_doc(windows: DataFrame) -> DataFrame:
    return windows.groupBy("doc").agg(F.collect_list(F.struct("pos", "lo", "hi", "h")).alias("windows"))


def surrounding_ties(docs: DataFrame, met: DataFrame, least: int) -> DataFrame:
    """Ties of the windows in met (doc, pos, lo, hi, h) by what stands around them.

    Near (h as it is): by the least token and BESIDE tokens on either side. Of
    the first function AROUND, by all that a passage around the token can reach,
    and LEFT and RIGHT, by half a passage.
    """
    left = (least - 1) // 2
    right = least - left

    def windows(part):
        grams, start, doc, pos, lo, hi, h = _windows_in(part)
        runs = doubled(grams, 2 * least)
        out = []

        def add(kind, at, first, last, low, high, salt):
            key = mix(run_hash(runs, start[at] + first, start[at] + last) + mix(grams[start[at] + pos[at]] + _SEEDS[salt]))
            out.append((key.view(np.int64), doc[at], pos[at], low, high, np.full(len(at), kind)))

        for f in np.unique(h):
            at = np.flatnonzero((h == f) & (pos - BESIDE >= lo) & (pos + BESIDE <= hi))
            add(f, at, pos[at] - BESIDE, pos[at] + BESIDE, lo[at], hi[at], f)
        at = np.flatnonzero(h == 0)
        first, last = np.maximum(lo[at], pos[at] - least + 1), np.minimum(hi[at], pos[at] + least - 1)
        add(AROUND, at, first, last, first, last, 40)
        out[-1] = (mix(out[-1][0].view(np.uint64) + (pos[at] - first).astype(np.uint64)).view(np.int64), *out[-1][1:])
        at = np.flatnonzero((h == 0) & (pos - left >= lo))
        add(LEFT, at, pos[at] - left, pos[at], lo[at], hi[at], 41)
        at = np.flatnonzero((h == 0) & (pos + right <= hi))
        add(RIGHT, at, pos[at], pos[at] + right, lo[at], hi[at], 42)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    return _ties(docs.join(_by_doc(met), "doc").select("doc", "text", "windows"), windows, least)


def run_ties(docs: DataFrame, halves: DataFrame, least: int) -> DataFrame:
    """Ties of every run of a passage's length in the windows of halves (doc, pos, lo, hi, h: LEFT or RIGHT), on that side."""
    left = (least - 1) // 2

    def windows(part):
        grams, start, doc, pos, lo, hi, h = _windows_in(part)
        most = np.minimum(pos, hi - least + 1)
        first = np.where(h == LEFT, np.maximum(lo, pos - least + 1), np.maximum(lo, pos - left + 1))
        times = np.maximum(np.where(h == LEFT, np.minimum(pos - left, most), most) - first + 1, 0)
        own = np.repeat(np.arange(len(pos)), times)
        at = first[own] + np.arange(len(own)) - np.repeat(np.cumsum(times) - times, times)
        key = run_hash(doubled(grams, least), start[own] + at, start[own] + at + least - 1)
        return key.view(np.int64), doc[own], at, at, at + least - 1, np.full(len(own), EXACT)

    return _ties(docs.join(_by_doc(halves), "doc").select("doc", "text", "windows"), windows, least)


def ties_by_doc(ties: DataFrame, need: int) -> DataFrame:
    """doc, lead, exact, s, e, k0, k1: exact runs, and stretches to verify, from all ties (doc, lead, s, e, k, h).

    Exact ties of one pair and alignment that overlap are one run. Near ties that
    lie in an exact run of their document are left out; those of one pair and
    about one alignment that overlap are a stretch, if they are of at least
    `need` functions. One shuffle; a task holds the ties of one document at least.
    """

    def islands(doc, lead, k, s, e, slack: int, gap: int):
        """In the order of doc, lead, alignment and place: rows, and where each island begins."""
        order = np.lexsort((k, lead, doc))
        doc, lead, k = doc[order], lead[order], k[order]
        group = np.cumsum(np.concatenate([[0], (doc[1:] != doc[:-1]) | (lead[1:] != lead[:-1]) | (k[1:] - k[:-1] > slack)])) if len(order) else order
        again = np.lexsort((s[order], group))
        order, group = order[again], group[again]
        wide = np.int64(1 << 32)  # beyond any place
        reach = np.maximum.accumulate(group * wide + e[order]) if len(order) else order
        fresh = np.ones(len(order), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (group[1:] * wide + s[order][1:] > reach[:-1] + gap)
        return order, np.flatnonzero(fresh)

    def run(batches):
        for table, _ in sorted_groups(batches, ["doc"]):
            doc, lead, s, e, k, h = (table[c].to_numpy().astype(np.int64) for c in ("doc", "lead", "s", "e", "k", "h"))
            exact = h < 0
            order, first = islands(*(x[exact] for x in (doc, lead, k, s, e)), 0, 1)
            own = [x[exact][order] for x in (doc, lead, s, e, k)]
            if len(first):
                own = [own[0][first], own[1][first], own[2][first], np.maximum.reduceat(own[3], first), own[4][first]]
            # the furthest end of any run of the document that begins no later
            number = np.unique(doc, return_inverse=True)[1].astype(np.int64)
            wide = np.int64(1 << 32)
            run_doc = number[exact][order][first] if len(first) else number[:0]
            by = np.lexsort((own[2], run_doc))
            begins, reach = run_doc[by] * wide + own[2][by], np.maximum.accumulate(run_doc[by] * wide + own[3][by]) if len(by) else own[3]
            near = np.flatnonzero(~exact)
            if len(begins):
                at = np.searchsorted(begins, number[near] * wide + s[near], "right") - 1
                near = near[(at < 0) | (reach[np.maximum(at, 0)] < number[near] * wide + e[near])]
            order, first = islands(*(x[near] for x in (doc, lead, k, s, e)), GAP, GAP + 1)
            order = near[order]
            if len(first):
                functions = np.bitwise_or.reduceat(np.int64(1) << h[order], first)
                some = np.bitwise_count(functions) >= need
                at = order[first][some]
                found = [doc[at], lead[at], s[at], np.maximum.reduceat(e[order], first)[some], np.minimum.reduceat(k[order], first)[some], np.maximum.reduceat(k[order], first)[some]]
            else:
                found = [doc[:0]] * 6
            both = [np.concatenate([x, y]) for x, y in zip([*own, own[4]], found, strict=True)]
            columns = dict(zip(("doc", "lead", "s", "e", "k0", "k1"), map(pa.array, both), strict=True))
            yield pa.RecordBatch.from_pydict(columns | {"exact": pa.array(np.arange(len(both[0])) < len(own[0]))})

    rows = ties.select("doc", "lead", "s", "e", "k", "h").repartition("doc").sortWithinPartitions("doc")
    return rows.mapInArrow(run, "doc long, lead long, s long, e long, k0 long, k1 long, exact boolean")


def matching_passages(a: np.ndarray, b: np.ndarray, s: int, e: int, least: int) -> list[tuple[int, int, int, int, float]]:
    """Verified passages of two token sequences around tokens s to e of a: first and last token in a and in b, and Jaccard similarity.

    A passage is a run of at least `least` tokens of a that b holds, with gaps of
    at most GAP. A run whose similarity is below the threshold is cut where its
    alignment with b jumps, or else at its widest gap, and its parts are tried.
    """
    if not len(a) or not len(b):
        return []
    order = np.argsort(b, kind="stable")
    ranked = b[order]
    place = np.minimum(np.searchsorted(ranked, a), len(b) - 1)
    at = np.flatnonzero(ranked[place] == a)
    if not len(at):
        return []
    there = order[place]
    out, left = [], [p for p in np.split(at, np.flatnonzero(np.diff(at) > GAP + 1) + 1) if p[0] <= e and p[-1] >= s]
    while left:
        run = left.pop()
        x, y = int(run[0]), int(run[-1])
        if y - x + 1 < least:
            continue
        shift = there[run] - run
        middle = np.sort(shift)[len(shift) // 2]  # where the run begins in b, as most tokens have it
        near = there[run][np.abs(shift - middle) <= y - x + 1]
        u, v = int(near.min()), int(near.max())
        one, two = np.unique(a[x : y + 1]), np.unique(b[u : v + 1])
        common = len(np.intersect1d(one, two, assume_unique=True))
        similar = common / (len(one) + len(two) - common)
        if similar >= THRESHOLD - 1e-9:
            out.append((x, y, u, v, similar))
            continue
        if len(jumps := np.flatnonzero(np.abs(np.diff(shift)) > GAP)):  # b has its parts apart
            left += np.split(run, jumps + 1)
            continue
        gaps = np.diff(run)
        widest = np.flatnonzero(gaps == gaps.max())
        if gaps.max() > 1:
            cut = int(widest[np.argmin(np.abs(widest - len(gaps) // 2))]) + 1
            left += [run[:cut], run[cut:]]
    return sorted(out)


def _slices(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """doc, x, y, slice: words x to y of each text and the few behind that their last tokens reach into. asked: doc, x, y, distinct."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                data, offsets = text_bytes(part.column(1))
                w, raw = Words(data, offsets), data.tobytes()
                docs, lists = part.column(0).to_pylist(), part.column(2)
                rows = []
                for i, doc in enumerate(docs):
                    first, last = w.of[i], w.of[i + 1]
                    for r in lists[i].values.to_pylist():
                        a, b = first + r["x"], min(last, first + r["y"] + SHINGLE_WORDS - 1)
                        rows.append((doc, r["x"], r["y"], raw[w.start[a] : w.end[b - 1]].decode() if a < b else ""))
                yield pa.RecordBatch.from_pydict({"doc": pa.array([r[0] for r in rows], pa.int64()), "x": pa.array([r[1] for r in rows], pa.int64()), "y": pa.array([r[2] for r in rows], pa.int64()), "slice": pa.array([r[3] for r in rows], pa.string())})

    by_doc = asked.groupBy("doc").agg(F.collect_list(F.struct("x", "y")).alias("asked"))
    return texts.join(by_doc, "doc").select("doc", "text", "asked").mapInArrow(run, "doc long, x long, y long, slice string")


def near_passages(texts: DataFrame, islands: DataFrame, min_words: int) -> DataFrame:
    """doc, lead, start, end, lead_start, lead_end: passages verified around stretches of pairs (doc, lead, s, e, k0, k1).

    Both sides' stretches are cut from the texts in one pass, by document; a
    leader's are few however many documents ask for them.
    """
    least = min_words - SHINGLE_WORDS + 1
    beyond = least // 2
    down = lambda c: F.greatest(F.lit(0), F.floor((c - beyond) / _ROUND) * _ROUND).cast("long")
    up = lambda c: ((F.floor((c + beyond) / _ROUND) + 1) * _ROUND).cast("long")
    bounds = {"x": down(F.col("s")), "y": up(F.col("e")), "u": down(F.col("s") + F.col("k0")), "v": up(F.col("e") + F.col("k1"))}
    islands = written(islands.withColumns(bounds), "islands")
    asked = islands.select("doc", "x", "y").union(islands.select("lead", "u", "v")).distinct()
    slices = written(_slices(texts, asked), "slices")
    both = islands.join(slices, ["doc", "x", "y"]).join(slices.toDF("lead", "u", "v", "lead_slice"), ["lead", "u", "v"])

    def verify(batches):
        for batch in batches:
            for part in steps(batch, "slice"):
                a, of_a = shingles(Words(*text_bytes(part.column(0))))
                b, of_b = shingles(Words(*text_bytes(part.column(1))))
                rows = []
                for i, (doc, lead, s, e, x, u) in enumerate(zip(*(part.column(c).to_pylist() for c in range(2, 8)), strict=True)):
                    for p, q, m, n, _ in matching_passages(a[of_a[i] : of_a[i + 1]], b[of_b[i] : of_b[i + 1]], s - x, e - x, least):
                        rows.append((doc, lead, p + x, q + x + SHINGLE_WORDS, m + u, n + u + SHINGLE_WORDS))
                names = ("doc", "lead", "start", "end", "lead_start", "lead_end")
                yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)})

    found = both.select("slice", "lead_slice", "doc", "lead", "s", "e", "x", "u").mapInArrow(verify, "doc long, lead long, start long, end long, lead_start long, lead_end long")
    return found.distinct()


def _pieces(batches):
    """Passages with the ranges that earlier documents hold (sorted) → those ranges, united, and what lies between them."""
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            at, runs = r["start"], []
            for c in r["cuts"]:
                if runs and c["start"] < runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], c["end"])
                else:
                    runs.append([c["start"], c["end"]])
            for start, end in [*runs, [r["end"], r["end"]]]:
                rows += [(r["root"], r["doc"], a, b, keep) for a, b, keep in ((at, start, True), (start, end, False)) if a < b]
                at = end
        names = ("root", "doc", "start", "end")
        yield pa.RecordBatch.from_pydict({n: pa.array([r[i] for r in rows], pa.int64()) for i, n in enumerate(names)} | {"keep": pa.array([r[4] for r in rows], pa.bool_())})


def numbered(docs: DataFrame) -> DataFrame:
    """doc, doc_id, copy, text of docs (doc_id, text): one row for each text under a doc_id.

    doc tells them apart: the doc_id, or where that stands for several texts a
    hash of both, beyond the ids of others. copy: a hash of the text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text").where("doc_id IS NOT NULL")
    several = rows.groupBy("doc_id").agg(F.count("*").alias("n"), (F.min("copy") < F.max("copy")).alias("differ")).where("n > 1")
    several = written(several.drop("n"), "several")  # commonly none; Spark sees how large it is
    single = rows.join(several, "doc_id", "left_anti").select(F.col("doc_id").alias("doc"), "doc_id", "copy", "text")
    later = F.xxhash64("doc_id", "copy").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    doc = F.when(F.col("differ"), later).otherwise(F.col("doc_id"))
    repeated = rows.join(several, "doc_id").select(doc.alias("doc"), "doc_id", "copy", "text").dropDuplicates(["doc"])
    return single.union(repeated)


def passages(docs: DataFrame, min_words: int = MIN_WORDS, hashes: int = HASHES, need: int = NEED) -> DataFrame:
    """doc_id, copy, start, end, first_doc_id, first_start, keep, n_docs: passages of at least min_words words that near-repeat in another document.

    docs: doc_id, text. start and end: the first word and past the last, words
    being as in near-duplicate search. All passages tied together are a class,
    named by the document and start of its first passage; n_docs: documents in
    the class. keep: whether no earlier document was found to hold these words;
    a passage that earlier documents hold in part is given as its parts, which
    may be shorter. Null and empty texts and texts below min_words have no
    passages. Rows with a null doc_id take no part; rows that repeat a doc_id
    and text count as one document, and those that repeat a doc_id with another
    text are documents of their own, which copy (a hash of the text) tells apart
    and which come after the others, in the order of a hash.
    """
    spark = docs.sparkSession
    small_batches(spark)
    all_texts = numbered(docs)
    texts = all_texts.select("doc", "text")
    least = min_words - SHINGLE_WORDS + 1
    met = written(first_ties(texts, hashes, least), "ties")
    around = written(surrounding_ties(texts, met, least), "ties")
    # one of the windows that agree around their token goes on for all, if others share half a passage with it
    exact = around.where(f"h < {EXACT}")
    on = lambda kind: F.max(F.when(F.col("h") == kind, True)).alias({LEFT: "left", RIGHT: "right"}[kind])
    halves = exact.groupBy("doc", "pos").agg(F.max(F.when((F.col("h") == AROUND) & (F.col("s") >= 0), True)).alias("tied"), on(LEFT), on(RIGHT), *[F.max(F.when(F.col("h") != AROUND, F.col(c))).alias(c) for c in ("lo", "hi")])
    sides = F.explode(F.array_compact(F.array(F.when(F.col("left"), LEFT), F.when(F.col("right"), RIGHT)))).alias("h")
    halves = halves.where("tied IS NULL AND lo IS NOT NULL").select("doc", "pos", "lo", "hi", sides)
    runs = written(run_ties(texts, halves, least), "ties")
    ties = met.union(around.where(f"h >= {AROUND}")).union(runs).where("s >= 0")
    found = written(ties_by_doc(ties, need), "found")
    words = lambda c: F.col(c) + SHINGLE_WORDS
    same = found.where("exact").select("doc", "lead", F.col("s").alias("start"), words("e").alias("end"), (F.col("s") + F.col("k0")).alias("lead_start"), (words("e") + F.col("k0")).alias("lead_end"))
    tied = written(same.union(near_passages(texts, found.where("NOT exact"), min_words)), "tied")

    # ranges of one document that overlap hang together; equal ranges fall together before they meet in a window
    spans = tied.select("doc", "start", "end", F.lit(True).alias("cut")).union(tied.select("lead", "lead_start", "lead_end", F.lit(False)))
    spans = spans.groupBy("doc", "start", "end").agg(F.max("cut").alias("cut"))
    by = Window.partitionBy("doc").orderBy("start", F.desc("end"))
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("fresh", F.coalesce(F.col("start") >= reach, F.lit(True)).cast("int")).withColumn("island", F.sum("fresh").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    spans = spans.withColumn("node", F.xxhash64("doc", "island"))
    spans = written(spans.select("doc", "start", "end", "cut", "node"), "spans")
    named = tied.join(spans.withColumnRenamed("node", "a"), ["doc", "start", "end"]).select("a", F.col("lead").alias("doc"), F.col("lead_start").alias("start"), F.col("lead_end").alias("end"))
    edges = named.join(spans.withColumnRenamed("node", "b"), ["doc", "start", "end"]).select("a", "b")
    roots = components(edges)
    cuts = F.sort_array(F.collect_list(F.when(F.col("cut"), F.struct("start", "end"))))
    whole = spans.groupBy("node").agg(F.first("doc").alias("doc"), F.min("start").alias("start"), F.max("end").alias("end"), cuts.alias("cuts")).join(roots, "node")
    whole = written(whole.select("root", "doc", "start", "end", "cuts").mapInArrow(_pieces, "root long, doc long, start long, end long, keep boolean"), "passages")
    # a class's documents are counted within tasks; from a table, its one row meets its passages in a join that Spark can split
    once = whole.groupBy("root", "doc").agg(F.min("start").alias("start"))
    first = written(once.groupBy("root").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n_docs")), "first")
    ids = written(all_texts.select("doc", "doc_id", "copy"), "ids")
    first = written(first.join(ids.select(F.col("doc").alias("_doc"), F.col("doc_id").alias("first_doc_id")), F.col("first.doc") == F.col("_doc")).select("root", "first_doc_id", F.col("first.start").alias("first_start"), "n_docs"), "first")
    return whole.join(first, "root").join(ids, "doc").select("doc_id", "copy", "start", "end", "first_doc_id", "first_start", "keep", "n_docs")


def without_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the passages that are not kept cut out of text, n_chars (if there) counted anew; rows left without words go.

    Only rows that lose a passage can go. Their blanks around a cut stay. Other
    rows and columns stay as they are. A passage is cut from the text that it was
    found in, not from another under the same doc_id.
    """
    spans = found.where("NOT keep").groupBy(F.col("doc_id").alias("_doc"), F.col("copy").alias("_copy")).agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("_spans"))
    joined = docs.join(spans, (F.col("doc_id").cast("long") == F.col("_doc")) & (F.xxhash64("text") == F.col("_copy")), "left").drop("_doc", "_copy")
    columns = docs.columns

    def cut(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                lists = part.column(part.schema.get_field_index("_spans")).to_pylist()
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                keep = [True] * len(texts)
                for i, spans in enumerate(lists):
                    if not spans or not texts[i]:
                        continue
                    raw = texts[i].encode()
                    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
                    out, at, left = [], 0, len(w.start)
                    for s in spans:
                        if s["start"] >= len(w.start):
                            continue
                        last = min(s["end"], len(w.start))
                        out.append(raw[at : max(at, w.start[s["start"]])])
                        at = max(at, int(w.end[last - 1]))
                        left -= last - s["start"]
                    texts[i] = (b"".join(out) + raw[at:]).decode()
                    keep[i] = left > 0
                new = {"text": pa.array(texts, pa.string())}
                if "n_chars" in columns:
                    old = part.column(part.schema.get_field_index("n_chars"))
                    new["n_chars"] = pa.array([len(t) if s and t is not None else o for t, s, o in zip(texts, lists, old.to_pylist(), strict=True)], old.type)
                yield with_columns(part, new).select(columns).filter(pa.array(keep))

    small_batches(docs.sparkSession)
    return joined.mapInArrow(cut, StructType([docs.schema[c] for c in columns]))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
