"""Substring dedup by super-k-mers.

A window is `window` consecutive words. Its minimiser is the least hash of the short word runs inside. Consecutive windows of one
text with one minimiser travel together: their words are packed as one string (a super-k-mer) that goes to the minimiser's bucket.
Equal windows have equal minimisers, so all their occurrences meet in one bucket, where sorting tells which of them is the first.

Before that, each task keeps one of its equal super-k-mers, the earliest, and marks the windows of the others itself: a group of
copies sends a bucket at most one string per task, however large the group is. And a first pass over the minimisers alone, eight
bytes for a super-k-mer, finds those that occur once: no window there can repeat, and its string stays at home. What is known of the
others fits a bitmap of bounded size; where it is too small for the corpus, strings travel in vain, and the result is the same. It
also finds minimisers that a bucket's task would choke on: these come last in the order of runs, for all windows alike, so that their
windows are spread by the next least run (and by their own hash, where a window has no other).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.frames import extend, row_key, shuffle_partitions
from lumenframe.llm.words import SPACED, Words, mix, same_bytes, slices, split_words, trim, windows

#: Words of the runs that minimisers are chosen from.
RUN = 6
#: Bytes of the bitmap of repeated minimisers: it is sent to every task.
FILTER_BYTES = 16 << 20
#: Text over which a task looks for equal super-k-mers before it sends them.
SCOPE_BYTES = 8 << 20
#: Text that is looked at in one go.
PIECE_BYTES = 1 << 20
#: A minimiser that fills over a fourth of its part, with at least so many super-k-mers, is hot: its windows go by their next minimiser.
HOT_LEAST = 1_000
#: Packed text that a bucket task takes at a time; a minimiser's strings stay together.
CHUNK_BYTES = 1 << 20

_LAST = np.uint64(2**64 - 1)
_KMER = "part int, mini long, words binary, id long, hash long, at int, run int"


def minimisers(words: Words, window: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each window the word it starts with, its minimiser, and whether hot runs had a say in that; the hashes of the runs that start
    at each word. hot: runs that come after all others in the order; windows of nothing else have their own hash as minimiser."""
    run = min(RUN, window)
    at = windows(words, run)
    runs = np.full(len(words.start), _LAST)
    if len(at):
        runs[at] = words.hashes(at, at + run - 1)

    def least(values: np.ndarray) -> np.ndarray:
        wide, span = 1, window - run + 1
        while wide * 2 <= span:
            values = np.minimum(values[: len(values) - wide], values[wide:]) if len(values) > wide else values[:0]
            wide *= 2
        if wide < span:
            gap = span - wide
            values = np.minimum(values[: len(values) - gap], values[gap:]) if len(values) > gap else values[:0]
        return values

    at = windows(words, window)
    mini = least(runs)[at]
    moved = np.zeros(len(at), bool)
    if hot is not None and len(hot) and len(at):
        moved = np.isin(mini, hot)
        if moved.any():
            mini = least(np.where(np.isin(runs, hot), _LAST, runs))[at]
            alone = np.flatnonzero(moved & (mini == _LAST))
            mini[alone] = words.hashes(at[alone], at[alone] + window - 1)
    return at, mini, moved, runs


def _runs(at: np.ndarray, mini: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of adjacent windows with one minimiser."""
    new = np.ones(len(at), bool)
    new[1:] = (mini[1:] != mini[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(at)) - 1


@dataclass(frozen=True)
class Repeated:
    """A bitmap of the minimisers that occur more than once, a slice of it for each part; it may hold others as well."""

    bits: np.ndarray  # parts x bytes
    hot: np.ndarray  # hot minimisers

    def holds(self, mini: np.ndarray) -> np.ndarray:
        part, place = _place(mini, *self.bits.shape)
        return (self.bits[part, place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)


def _place(mini: np.ndarray, parts: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each minimiser, and its bit in that part's slice of `size` bytes."""
    spread = mix(mini.view(np.uint64))
    return (spread % np.uint64(parts)).astype(np.int64), (mix(spread) % np.uint64(8 * size)).astype(np.int64)


def _occurrences(words: Words, window: int) -> list[np.ndarray]:
    """The minimiser of each super-k-mer, and once more of those whose minimal run stands in them twice: they may repeat a window
    of their own."""
    at, mini, _, runs = minimisers(words, window)
    if not len(at):
        return []
    first, last = _runs(at, mini)
    size = last - first + 1 + window - min(RUN, window)
    ends = np.cumsum(size)
    place = np.arange(ends[-1]) + np.repeat(at[first] - ends + size, size)
    twice = np.add.reduceat((runs[place] == np.repeat(mini[first], size)).astype(np.int64), ends - size) > 1
    return [mini[first], mini[first[twice]]]


def _mini_batches(window: int, parts: int):
    """To rows (part, minis, counts): the minimisers of all super-k-mers of a batch; counts has the numbers of the first of them, those
    that stand there more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for piece in slices(batch, "__text", PIECE_BYTES):
                found += _occurrences(split_words(piece.column("__text"), SPACED), window)
            values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
            if not len(values):
                continue
            part, _ = _place(values, parts, 1)
            order = np.lexsort((counts == 1, part))
            values, counts, part = values[order], counts[order].astype(np.int32), part[order]
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            more = [counts[a:b][counts[a:b] > 1].tobytes() for a, b in spans]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()), pa.array(more, pa.binary())], names=["part", "minis", "counts"])
        trim()

    return run


def _bitmap_batches(parts: int, size: int):
    """Of all minimisers of a part: the slice of the bitmap with those that come twice, and the hot ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for part, minis, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "minis", "counts")), strict=True):
                held.setdefault(part, []).append((minis, counts))
        for part, packs in held.items():
            values = np.concatenate([np.frombuffer(x, np.uint64) for x, _ in packs])
            counts = np.ones(len(values), np.int64)
            at = 0
            for minis, more in packs:
                counts[at : at + len(more) // 4] = np.frombuffer(more, np.int32)
                at += len(minis) // 8
            order = np.argsort(values)
            values, counts = values[order], counts[order]
            first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            values, counts = values[first], np.add.reduceat(counts, first)
            _, place = _place(values[counts > 1], parts, size)
            bits = np.zeros(8 * size, bool)
            bits[place] = True
            hot = values[(counts >= HOT_LEAST) & (4 * counts > counts.sum())]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary()), pa.array([hot.tobytes()], pa.binary())], names=["part", "bits", "hot"])
        trim()

    return run


def repeated_minimisers(rows: DataFrame, window: int, parts: int) -> Repeated:
    """The driver gets the bitmap, FILTER_BYTES in all, and fewer than four hot minimisers of each part."""
    size = max(64, FILTER_BYTES // parts)
    dealt = rows.select("__text").mapInArrow(_mini_batches(window, parts), "part int, minis binary, counts binary").repartitionById(parts, "part")
    bits, hot = np.zeros((parts, size), np.uint8), [b""]
    for r in dealt.mapInArrow(_bitmap_batches(parts, size), "part int, bits binary, hot binary").toLocalIterator():
        bits[r.part] = np.frombuffer(r.bits, np.uint8)
        hot.append(bytes(r.hot))
    return Repeated(bits, np.sort(np.frombuffer(b"".join(hot), np.uint64)))


class _Scope:
    """Super-k-mers of some text: the earliest of equal ones, and the marked runs of windows of the others."""

    def __init__(self, window: int, repeated: Repeated):
        self.window, self.repeated, self.kept, self.marked, self.bytes = window, repeated, {}, {}, 0
        self.more: dict[tuple[bytes, int], tuple] = {}  # by words and text: other texts of the same id, at the same place

    def add(self, ids: list, hashes: list, words: Words) -> None:
        at, mini, moved, _ = minimisers(words, self.window, self.repeated.hot)
        self.bytes += len(words.buf)
        if not len(at):
            return
        first, last = _runs(at, mini)
        # Of minimisers that took a hot one's place nothing is known: their windows may repeat.
        again = self.repeated.holds(mini[first]) | np.logical_or.reduceat(moved, first)
        first, last = first[again], last[again]
        buf = words.buf.tobytes()
        doc = words.doc_of()[at[first]].tolist()
        begin = words.start[at[first]].tolist()
        stop = words.end[at[last] + self.window - 1].tolist()
        local = (at[first] - words.docs[words.doc_of()[at[first]]]).tolist()
        size = (last - first + 1).tolist()
        kept = self.kept
        for d, b, e, p, n, m in zip(doc, begin, stop, local, size, mini[first].view(np.int64).tolist(), strict=True):
            key = buf[b:e]
            here = (ids[d], p, hashes[d], n, m)
            held = kept.get(key)
            if held is None:
                kept[key] = here
            elif held[:2] < here[:2]:
                self.mark(here)
            elif held[:2] > here[:2]:
                kept[key] = here
                self.mark(held)
            elif held[2] != here[2]:  # another text of the same id: it shares the place, and needs its own answer
                self.more.setdefault((key, here[2]), here)

    def mark(self, kmer: tuple) -> None:
        runs = self.marked.setdefault((kmer[0], kmer[2]), [])
        if runs and runs[-1][0] + runs[-1][1] == kmer[1]:
            runs[-1][1] += kmer[3]
        else:
            runs.append([kmer[1], kmer[3]])


def _kmer_batches(window: int, parts: int, sent: Broadcast):
    """To super-k-mers, each with its part; the marked runs of windows among them have no words."""
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def flush(scope: _Scope) -> Iterator[pa.RecordBatch]:
        rows = [(v[4], k, v[0], v[2], v[1], v[3]) for k, v in scope.kept.items()]
        rows += [(v[4], k, v[0], v[2], v[1], v[3]) for (k, _), v in scope.more.items()]
        # A marked run goes wherever its document's hash leads: it only passes through.
        rows += [(int(h), None, i, h, p, n) for (i, h), runs in scope.marked.items() for p, n in runs]
        if rows:
            part, _ = _place(np.array([r[0] for r in rows], np.int64), parts, 1)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *columns], names=["part", "mini", "words", "id", "hash", "at", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeated = sent.value
        scope = _Scope(window, repeated)
        for batch in batches:
            for piece in slices(batch, "__text", PIECE_BYTES):
                scope.add(piece.column("__id").to_pylist(), piece.column("__hash").to_pylist(), split_words(piece.column("__text"), SPACED))
                if scope.bytes >= SCOPE_BYTES:
                    yield from flush(scope)
                    scope = _Scope(window, repeated)
        yield from flush(scope)
        del scope
        trim()

    return run


def _later_windows(rows: list[tuple], window: int) -> Iterator[tuple[int, int, int, int]]:
    """Of super-k-mers (words, id, at, hash) the runs of windows that also start earlier: (id, hash, at, windows)."""
    joined = b" ".join(r[0] for r in rows) + b" "
    buf = np.frombuffer(joined, np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(r[0]) + 1 for r in rows])])
    end = np.flatnonzero(buf == 0x20)
    start = np.concatenate([[0], end[:-1] + 1])
    words = Words(buf, start, end, np.searchsorted(end, bounds))
    at = windows(words, window)
    owner = words.doc_of()[at]
    ids = np.array([r[1] for r in rows], np.int64)[owner]
    place = at - words.docs[owner] + np.array([r[2] for r in rows], np.int64)[owner]
    hashes = words.hashes(at, at + window - 1)
    order = np.lexsort((place, ids, hashes))
    new = np.ones(len(at), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    lead = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    length = words.end[at + window - 1] - words.start[at]
    rest = np.flatnonzero(~new)
    x, y = order[rest], lead[rest]
    equal = (length[x] == length[y]) & same_bytes(buf, words.start[at[x]], words.start[at[y]], length[x])
    later = np.zeros(len(at), bool)
    after = (ids[x] > ids[y]) | (ids[x] == ids[y]) & (place[x] > place[y])
    later[x[equal & after]] = True
    if not equal.all():  # two different windows have one 64-bit hash: tell them apart by their words
        for h in np.unique(hashes[x[~equal]]):
            first: dict[bytes, tuple] = {}
            for i in order[hashes[order] == h]:
                text = joined[words.start[at[i]] : words.end[at[i] + window - 1]]
                later[i] = (ids[i], place[i]) > first.setdefault(text, (ids[i], place[i]))
    hit = np.flatnonzero(later)
    if len(hit):
        cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)) + 1
        for run in np.split(hit, cut):
            r = rows[owner[run[0]]]
            yield r[1], r[3], int(place[run[0]]), len(run)


def _bucket_batches(window: int):
    """Takes rows in the order of minimiser, words, id and place; gives runs of windows that are to go: id, hash, at, run."""

    def chunks(batches: Iterator[pa.RecordBatch], out: list[tuple]) -> Iterator[list[tuple]]:
        rows: list[tuple] = []
        size, last, lead = 0, None, None
        for batch in batches:
            for mini, words, i, h, at, run in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                if words is None:
                    out.append((i, h, at, run))
                    continue
                if mini != last and size >= CHUNK_BYTES:
                    yield rows
                    rows, size = [], 0
                if mini == last and lead and lead[0] == words and (lead[1], lead[2]) < (i, at):
                    out.append((i, h, at, run))  # an equal super-k-mer came before: all its windows did
                    continue
                last, lead = mini, (words, i, at)
                rows.append((words, i, at, h))
                size += len(words)
        yield rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for rows in chunks(batches, out):
            if rows:
                out += _later_windows(rows, window)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "hash", "at", "run"])
                out.clear()
        trim()

    return run


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Runs of windows whose words also start earlier: __id, __hash (of the text), at (first word) and run (windows)."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(*row_key(id_col, text_col), F.col(f"`{text_col}`").alias("__text"))
    repeated = spark.sparkContext.broadcast(repeated_minimisers(rows, window, parts))
    kmers = rows.mapInArrow(_kmer_batches(window, parts, repeated), _KMER).repartitionById(parts, "part")
    return kmers.sortWithinPartitions("mini", "words", "id", "at").mapInArrow(_bucket_batches(window), "__id long, __hash long, at int, run int")


def _kept_batches(window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", PIECE_BYTES):
                words = split_words(part.column("__text"), SPACED)
                buf = words.buf.tobytes()
                runs = part.column("__runs").to_pylist()
                removed = np.zeros(part.num_rows, np.int64)
                kept = []
                for d in range(part.num_rows):
                    a, b = int(words.docs[d]), int(words.docs[d + 1])
                    text = buf[words.start[a] : words.end[b - 1]] if b > a else b""
                    if runs[d]:
                        cover = np.zeros(b - a + 1, np.int64)
                        for r in runs[d]:
                            cover[r["at"]] += 1
                            cover[r["at"] + r["run"] + window - 1] -= 1
                        gone = np.cumsum(cover[:-1]) > 0
                        removed[d] = int(gone.sum())
                        mask = np.repeat(~gone, words.end[a:b] - words.start[a:b] + 1)
                        text = words.buf[words.start[a] : words.end[b - 1] + 1][mask].tobytes()[:-1]
                    kept.append(text)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(words.counts, pa.int64()), pa.array(removed), pa.array(kept, pa.binary()).cast(pa.string())], names=[*names, "n_words", "n_removed", "kept"]
                )
        trim()

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """Per row: id_col, n_words, n_removed and kept (the words that stay, joined by one space).

    A word goes if a window that covers it also starts earlier: at a smaller id, or earlier in the same id. A null id counts as
    smaller than all; rows of one id are one document as far as order goes, and equal rows lose the same words. A null or empty
    text has no words. Windows are judged on the input. An empty table gives no rows; no other column is looked at.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col), *row_key(id_col, text_col), F.col(f"`{text_col}`").alias("__text"))
    runs = repeated_runs(docs, id_col, text_col, window).groupBy("__id", "__hash").agg(F.collect_set(F.struct("at", "run")).alias("__runs"))
    joined = rows.join(runs, ["__id", "__hash"], "left").select(F.col(f"`{id_col}`").alias("__k"), "__text", "__runs")
    schema = extend(joined.select("__k").schema, "n_words long, n_removed long, kept string")
    return joined.mapInArrow(_kept_batches(window, ["__k"]), schema).withColumnRenamed("__k", id_col)
