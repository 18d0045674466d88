"""Benchmark decontamination with suffix arrays over the training text.

Each task sorts the suffixes of its shard of documents, word by word, and binary-searches every benchmark suffix in that order. That
gives the suffix's longest verbatim match in the shard; where it covers a window, the range of entries that share the window's words
gives all its places, and the documents there are affected. A shard keeps only runs of words in which every two neighbours follow each
other somewhere in the benchmark, and which are as long as the shortest window: no match can lie elsewhere. So a shard covers hundreds
of megabytes of text, and the searches of the whole benchmark are paid once for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.frames import Scratch, extend
from lumenframe.llm.words import ALNUM, Words, same_bytes, slices, split_words, trim

#: Benchmark text that one pass sends to every task; a larger benchmark takes several passes over the documents.
BLOCK_BYTES = 16 << 20
#: Text of one shard; a shard also ends with its task, or when what is kept of it reaches SHARD_WORDS, or its rows' columns HELD_BYTES.
SHARD_BYTES = 256 << 20
SHARD_WORDS = 4 << 20
HELD_BYTES = 16 << 20
#: Text that is split into words in one go.
PIECE_BYTES = 2 << 20
#: Keys of affected documents that are sent to every task; of more, both sides are shuffled by key.
MOST_SENT = 500_000


class TestSuffixes:
    """A block of benchmark items: word numbers, one item after the other, each closed by a 0."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        # Items that share an id are one owner; so are those without an id.
        number = {i: k for k, i in enumerate(dict.fromkeys(i for i, _ in items))}
        self.ids = list(number)
        words = split_words(pa.array([t for _, t in items], pa.string()), ALNUM, lower=True)
        self.window = window
        at = np.arange(len(words.start))
        hashes = words.hashes(at, at)
        self.vocab, first, code = np.unique(hashes, return_index=True, return_inverse=True)
        length = words.end - words.start
        lead = first[code] if len(first) else at
        same = (length == length[lead]) & same_bytes(words.buf, words.start, words.start[lead], np.minimum(length, length[lead]))
        buf = words.buf.tobytes()
        self.spelled = [buf[a:b] for a, b in zip(words.start[first].tolist(), words.end[first].tolist(), strict=True)]
        #: Numbers of the words that share another word's hash, by hash and spelling.
        self.clashes: dict[int, dict[bytes, int]] = {}
        for i in np.flatnonzero(~same).tolist():
            h = int(hashes[i])
            of = self.clashes.setdefault(h, {self.spelled[code[i]]: int(code[i])})
            word = buf[words.start[i] : words.end[i]]
            if word not in of:
                of[word] = len(self.spelled)
                self.spelled.append(word)
            code[i] = of[word]
        self.letters = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.size = np.array([len(w) for w in self.spelled], np.int64)
        self.codes = np.zeros(len(at) + len(items) + window, np.int64)
        self.codes[at + words.doc_of()] = code + 1
        counts = words.counts
        begin = words.docs[:-1] + np.arange(len(items))
        starts, lengths, owners = [], [], []
        for (i, _), b, n in zip(items, begin.tolist(), counts.tolist(), strict=True):
            if n:
                size = min(window, n)
                s = np.arange(b, b + n - size + 1)
                starts.append(s)
                lengths.append(np.full(len(s), size))
                owners.append(np.full(len(s), number[i]))
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        self.starts, self.lengths, self.owners = cat(starts), cat(lengths), cat(owners)
        self.shortest = int(self.lengths.min(initial=window))
        self.base = len(self.spelled) + 1
        pair = self.codes[:-1] * self.base + self.codes[1:]
        self.pairs = np.unique(pair[(self.codes[:-1] > 0) & (self.codes[1:] > 0)])
        self.singles = np.unique(self.codes[self.starts[self.lengths == 1]]) if len(self.starts) else np.zeros(0, np.int64)

    def number(self, words: Words) -> np.ndarray:
        """The benchmark's number of each word by its hash, or 0. Words of a hash that several benchmark words have are told apart by
        spelling. A word that only shares a benchmark word's hash has that one's number; right() tells."""
        if not len(self.vocab) or not len(words.start):
            return np.zeros(len(words.start), np.int64)
        at = np.arange(len(words.start))
        hashes = words.hashes(at, at)
        code = np.searchsorted(self.vocab, hashes)
        code[code == len(self.vocab)] = 0
        out = np.where(self.vocab[code] == hashes, code + 1, 0)
        for h, of in self.clashes.items():
            for i in np.flatnonzero(hashes == np.uint64(h)).tolist():
                out[i] = of.get(words.buf[words.start[i] : words.end[i]].tobytes(), -1) + 1
        return out

    def right(self, words: Words, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Whether some words (not the hash alone) are the benchmark's words of these numbers."""
        begin = np.cumsum(self.size) - self.size
        length, own = words.end[at] - words.start[at], self.size[codes - 1]
        buf = np.concatenate([words.buf, self.letters])
        return (length == own) & same_bytes(buf, words.start[at], len(words.buf) + begin[codes - 1], np.minimum(length, own))


class SuffixArray:
    """Word suffixes of a shard in lexicographic order of their word numbers; 0 ends a suffix."""

    def __init__(self, codes: np.ndarray, at: np.ndarray, width: int, depth: int | None = None):
        """codes ends with zeros; at: the positions to index; width: bits of a word number. depth: words that the order looks at; a
        text of one word, again and again, then costs no more than any other."""
        self.codes, self.per = codes, max(1, 62 // width)
        self.width, self.depth = width, depth
        self.at = self._sorted(at)

    def _key(self, at: np.ndarray, depth: int) -> np.ndarray:
        """The words at + depth ... of each suffix as one number, zeros from the first 0 on."""
        key = np.zeros(len(at), np.int64)
        live = np.ones(len(at), bool)
        for i in range(self.per):
            word = self.codes[np.minimum(at + depth + i, len(self.codes) - 1)]
            live &= word > 0
            key = (key << self.width) | np.where(live, word, 0)
        return key

    def _sorted(self, at: np.ndarray) -> np.ndarray:
        """Sort by the first words, then the runs of equals by the next, until none is left or all have ended."""
        group = np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        out = at.copy()
        depth = 0
        while len(todo) > 1 and (self.depth is None or depth < self.depth):
            part = out[todo]
            key = self._key(part, depth)
            order = np.lexsort((part, key, group))
            out[todo] = part[order]
            key, group = key[order], group[order]
            new = np.ones(len(todo), bool)
            new[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
            run = np.cumsum(new) - 1
            alone = np.bincount(run) == 1
            ended = (key & ((1 << self.width) - 1)) == 0
            go = ~alone[run] & ~ended
            todo, group = todo[go], run[go]
            depth += self.per
        return out

    def _compare(self, other: np.ndarray, theirs: np.ndarray, entry: np.ndarray, most: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign of other[theirs:] minus the entry's suffix over at most `most` words, and the length of their common start."""
        sign = np.zeros(len(theirs), np.int64)
        same = np.zeros(len(theirs), np.int64)
        limit = np.broadcast_to(np.asarray(most), theirs.shape)
        live = np.flatnonzero(limit > 0)
        k = 0
        while len(live):
            x = other[np.minimum(theirs[live] + k, len(other) - 1)]
            y = self.codes[np.minimum(self.at[entry[live]] + k, len(self.codes) - 1)]
            sign[live] = np.sign(x - y)
            go = (x == y) & (x > 0)
            same[live[go]] = k + 1
            live = live[go]
            k += 1
            live = live[limit[live] > k]
        return sign, same

    def _lower(self, other: np.ndarray, theirs: np.ndarray, most: np.ndarray, above: bool) -> np.ndarray:
        """Binary search: the first entry not before the first `most` words of each suffix of other (above: after them)."""
        low, high = np.zeros(len(theirs), np.int64), np.full(len(theirs), len(self.at))
        while True:
            go = np.flatnonzero(low < high)
            if not len(go):
                return low
            mid = (low[go] + high[go]) // 2
            sign, _ = self._compare(other, theirs[go], mid, most[go])
            right = sign >= 0 if above else sign > 0
            low[go[right]] = mid[right] + 1
            high[go[~right]] = mid[~right]

    def bounds(self, other: np.ndarray, theirs: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of entries that share the first `most` words of each suffix of other."""
        return self._lower(other, theirs, most, False), self._lower(other, theirs, most, True)

    def longest(self, other: np.ndarray, theirs: np.ndarray, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each suffix of other the length of its longest verbatim match, looking at its first `most` words, and one place of it
        (-1: none)."""
        most = np.full(len(theirs), len(other)) if most is None else most
        low = self._lower(other, theirs, most, False)
        best, place = np.zeros(len(theirs), np.int64), np.full(len(theirs), -1)
        for side in (low - 1, low):
            ok = np.flatnonzero((side >= 0) & (side < len(self.at)))
            _, same = self._compare(other, theirs[ok], side[ok], most[ok])
            more = same > best[ok]
            best[ok[more]] = same[more]
            place[ok[more]] = self.at[side[ok[more]]]
        return best, place


def _linked(codes: np.ndarray, apart: np.ndarray, test: TestSuffixes) -> np.ndarray:
    """Whether each word and the next stand in one text (apart: the last words of texts) and follow each other in the benchmark."""
    link = np.zeros(len(codes), bool)
    at = np.flatnonzero((codes[:-1] > 0) & (codes[1:] > 0) & ~apart[:-1])
    if len(at) and len(test.pairs):
        pair = codes[at] * test.base + codes[at + 1]
        found = np.searchsorted(test.pairs, pair)
        found[found == len(test.pairs)] = 0
        link[at[test.pairs[found] == pair]] = True
    return link


def _runs(codes: np.ndarray, apart: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """First word and length of each run of linked words that is long enough for a window."""
    link = _linked(codes, apart, test)
    first = np.flatnonzero(~np.concatenate([[False], link[:-1]]))
    size = np.diff(np.append(first, len(codes)))
    keep = size >= max(2, test.shortest)
    if len(test.singles):
        keep |= (size == 1) & np.isin(codes[first], test.singles)
    return first[keep], size[keep]


class _Shard:
    """What is kept of some rows' words until the shard is searched."""

    def __init__(self, test: TestSuffixes):
        self.test = test
        self.codes: list[np.ndarray] = []
        self.rows: list[np.ndarray] = []
        self.places: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.n_rows = self.n_words = self.bytes = 0

    def add(self, texts: pa.Array) -> None:
        words = split_words(texts, ALNUM, lower=True)
        test, n = self.test, len(words.start)
        self.bytes += len(words.buf)
        self.counts.append(words.counts)
        if n and len(test.starts):
            codes = test.number(words)
            doc = words.doc_of()
            apart = np.ones(n, bool)
            apart[:-1] = doc[1:] != doc[:-1]
            first, size = _runs(codes, apart, test)
            at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            wrong = at[~test.right(words, at, codes[at])]
            if len(wrong):
                codes[wrong] = 0
                first, size = _runs(codes, apart, test)
            if len(first):
                # Each run is followed by a 0.
                ends = np.cumsum(size + 1)
                at = np.minimum(np.repeat(first - (ends - size - 1), size + 1) + np.arange(ends[-1]), n - 1)
                out = codes[at]
                out[ends - 1] = 0
                self.codes.append(out)
                self.rows.append((doc[at] + self.n_rows).astype(np.int32))
                self.places.append((at - words.docs[doc[at]]).astype(np.int32))
                self.n_words += len(out)
        self.n_rows += len(texts)

    def search(self, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_words of each row; row, begin and end of each run of hit words; and row * n_items + owner of each item found in a row, all
        ascending."""
        test, none = self.test, np.zeros(0, np.int64)
        counts = np.concatenate([none, *self.counts])
        if not self.codes:
            return counts, none, none, none, none
        codes = np.concatenate([*self.codes, np.zeros(test.window + 1, np.int64)])
        rows, places = np.concatenate(self.rows), np.concatenate(self.places)
        array = SuffixArray(codes, np.flatnonzero(codes), max(1, int(test.base).bit_length()), test.window)
        longest, _ = array.longest(test.codes, test.starts, test.lengths)
        found = np.flatnonzero(longest >= test.lengths)
        low, high = array.bounds(test.codes, test.starts[found], test.lengths[found])
        cover = np.zeros(len(codes) + 1, np.int64)
        spans: dict[tuple[int, int, int], set[int]] = {}
        for a, b, n, owner in zip(low.tolist(), high.tolist(), test.lengths[found].tolist(), test.owners[found].tolist(), strict=True):
            spans.setdefault((a, b, n), set()).add(owner)
        pairs = [none]
        for (a, b, n), owners in spans.items():
            entries = array.at[a:b]
            np.add.at(cover, entries, 1)
            np.add.at(cover, entries + n, -1)
            docs = np.unique(rows[entries]).astype(np.int64)
            pairs.append((docs[:, None] * n_items + np.array(sorted(owners))).ravel())
        hit = np.flatnonzero(np.cumsum(cover) > 0)
        row, place = rows[hit].astype(np.int64), places[hit].astype(np.int64)
        new = np.ones(len(hit), bool)
        new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
        last = np.append(new[1:], True)[: len(hit)]
        return counts, row[new], place[new], place[last] + 1, np.unique(np.concatenate(pairs))


def _hit_batches(block: list[tuple[str | None, str]], window: int, names: list[str], only_hits: bool = False):
    """The columns of names, __n_words, __spots and __items of every row, or of those with a hit."""

    def results(test: TestSuffixes, shard: _Shard, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, row, begin, end, pairs = shard.search(len(test.ids))
        spans = np.stack([begin, end], 1).ravel().astype(np.int32)
        bounds = np.searchsorted(row, np.arange(len(counts) + 1)) * 2
        item_row, owner = np.divmod(pairs, max(1, len(test.ids)))
        item_bounds = np.searchsorted(item_row, np.arange(len(counts) + 1))
        ids = pa.array(test.ids, pa.string()).take(pa.array(owner))
        a = 0
        for part in held:
            b = a + part.num_rows
            lists = pa.ListArray.from_arrays(pa.array((bounds[a : b + 1] - bounds[a]).astype(np.int32)), pa.array(spans[bounds[a] : bounds[b]]))
            items = pa.ListArray.from_arrays(pa.array((item_bounds[a : b + 1] - item_bounds[a]).astype(np.int32)), ids.slice(item_bounds[a], item_bounds[b] - item_bounds[a]))
            out = pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(counts[a:b], pa.int64()), lists, items], names=[*names, "__n_words", "__spots", "__items"])
            yield out.filter(pa.array(np.diff(bounds[a : b + 1]) > 0)) if only_hits else out
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TestSuffixes(block, window)
        shard, held, size = _Shard(test), [], 0
        for batch in batches:
            for part in slices(batch, "__text", PIECE_BYTES):
                shard.add(part.column("__text"))
                # The columns' own bytes are held, not the batch with the texts that they are a slice of.
                own = pa.RecordBatch.from_arrays([pa.concat_arrays([part.column(n), part.column(n).slice(0, 0)]) for n in names], names=names) if names else part.select([])
                held.append(own)
                size += own.nbytes
                if shard.bytes >= SHARD_BYTES or shard.n_words >= SHARD_WORDS or size >= HELD_BYTES:
                    yield from results(test, shard, held)
                    shard, held, size = _Shard(test), [], 0
        if held:
            yield from results(test, shard, held)
        del test, shard, held
        trim()

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of bounded bytes; the driver holds one block. An item longer than a block is a block. At least one block."""
    rows = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").alias("t")).where("t is not null")
    block, size = [], 0
    for r in rows.toLocalIterator():
        n = len(r.t.encode())
        if block and size + n > block_bytes:
            yield block
            block, size = [], 0
        block.append((r.i, r.t))
        size += n
    yield block


_FOUND = "__n_words long, __spots array<int>, __items array<string>"


def _text_key(text_col: str) -> list[Column]:
    """Two hashes of a text: what is found in it hangs on nothing else, so all its copies are one row in a shuffle."""
    text = F.col(f"`{text_col}`")
    return [F.xxhash64(text).alias("__h0"), F.xxhash64(F.lit("again"), text).alias("__h1")]


def _scan(docs: DataFrame, benchmark: DataFrame, keep: list[Column], text_col: str, item_col: str, item_text_col: str, window: int, block_bytes: int) -> DataFrame:
    """The columns of keep and those of _FOUND. A benchmark of one block needs no shuffle; of more, each block's hits are written before
    the next is read, keyed by text, and joined to the rows once."""
    source = docs.select(*keep, *_text_key(text_col), F.col(f"`{text_col}`").alias("__text"))
    keys = ["__h0", "__h1"]
    names = [c for c in source.columns if c not in (*keys, "__text")]
    scratch, written, block = Scratch(docs.sparkSession, "decontaminate"), [], None
    for following in _blocks(benchmark, item_col, item_text_col, block_bytes):
        if block is not None:
            written.append(_write_hits(source, block, window, scratch))
        block = following
    if not written:
        rows = source.drop(*keys)
        return rows.mapInArrow(_hit_batches(block, window, names), extend(rows.select(*names).schema, _FOUND))
    written.append(_write_hits(source, block, window, scratch))
    every = written[0]
    for more in written[1:]:
        every = every.union(more)
    merged = every.groupBy(*keys).agg(F.flatten(F.collect_list("__spots")).alias("__spots"), F.array_distinct(F.flatten(F.collect_list("__items"))).alias("__items"))
    merged = scratch.save(merged.mapInArrow(_merge_spots, merged.schema), "merged")
    counted = source.mapInArrow(_count_batches([*names, *keys]), extend(source.select(*names, *keys).schema, "__n_words long"))
    whole = counted.join(merged, keys, "left")
    none = [F.coalesce(n, F.array().cast(kind)).alias(n) for n, kind in (("__spots", "array<int>"), ("__items", "array<string>"))]
    return whole.select(*names, "__n_words", *none)


def _write_hits(source: DataFrame, block: list[tuple[str | None, str]], window: int, scratch: Scratch) -> DataFrame:
    keys = ["__h0", "__h1"]
    rows = source.select(*keys, "__text")
    found = rows.mapInArrow(_hit_batches(block, window, keys, only_hits=True), extend(rows.select(*keys).schema, _FOUND))
    return scratch.save(found.groupBy(*keys).agg(F.first("__spots").alias("__spots"), F.first("__items").alias("__items")), "hits", source.count())


def _count_batches(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text", PIECE_BYTES):
                counts = split_words(part.column("__text"), ALNUM, lower=True).counts
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(counts, pa.int64())], names=[*names, "__n_words"])
        trim()

    return run


def hits(
    docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = (), text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """The columns of keep, n_words, spots (start, end, start, end, ... of hit word runs) and items (ids with occurring windows, once
    each; null for those without an id).

    A word is hit inside any occurrence of `window` consecutive words of an item, or of a whole shorter item. Items that share an id
    are one item, as are all without an id; a null or empty item has no window. A null or empty text has no words. Texts are looked
    at whole, whatever their length; rows that repeat are each answered. Empty tables give no rows or no hits. Columns of the
    documents may have any names.
    """
    names = [f"__k{i}" for i in range(len(keep))]
    found = _scan(docs, benchmark, [F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], text_col, item_col, item_text_col, window, block_bytes)
    return found.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], F.col("__n_words").alias("n_words"), F.col("__spots").alias("spots"), F.col("__items").alias("items"))


def _merge_spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = batch.schema.get_field_index("__spots")
        out = []
        for flat in batch.column(at).to_pylist():
            spans: list[int] = []
            for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
                if spans and a <= spans[-1]:
                    spans[-1] = max(spans[-1], b)
                else:
                    spans += [a, b]
            out.append(spans)
        yield batch.set_column(at, "__spots", pa.array(out, pa.list_(pa.int32())))


def _spot_sum() -> Column:
    """Words in the spots: ends minus starts."""
    return F.aggregate(F.transform("__spots", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)


def report(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row: the id, n_words, n_hit, n_items (items without an id count as one), items_sha256 (the ids sorted as strings,
    comma-joined; an item without one is not in it) and contaminated. Null, empty, long, repeated and extra: as in hits()."""
    found = _scan(docs, benchmark, [F.col(f"`{id_col}`").alias("__k0")], text_col, item_col, item_text_col, window, block_bytes)
    listed = F.array_join(F.array_sort(F.filter("__items", lambda x: x.isNotNull())), ",")
    return found.select(
        F.col("__k0").alias(id_col),
        F.col("__n_words").alias("n_words"),
        _spot_sum().alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.size("__spots") > 0).alias("contaminated"),
    )


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    block_bytes: int = BLOCK_BYTES,
    most_sent: int = MOST_SENT,
) -> DataFrame:
    """The rows of docs whose text holds no window of the benchmark, all columns kept.

    The affected texts are found first and written as keys; the rows with such a text are left out by an anti-join, so whole rows
    never pass through Python. Null, empty, long, repeated and extra: as in hits(); a row with a null or empty text stays.
    """
    scratch, found = Scratch(docs.sparkSession, "decontaminate"), None
    source = docs.select(*_text_key(text_col), F.col(f"`{text_col}`").alias("__text"))
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        one = _write_hits(source, block, window, scratch).select("__h0", "__h1")
        found = one if found is None else found.union(one)
    found = found.select(F.col("__h0").alias("h0"), F.col("__h1").alias("h1"))
    found = F.broadcast(found) if found.limit(most_sent + 1).count() <= most_sent else found.distinct()
    h0, h1 = _text_key(text_col)
    names = {f"__c{i}": c for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for n, c in names.items()], h0, h1)
    kept = rows.join(found, (F.col("__h0") == F.col("h0")) & (F.col("__h1") == F.col("h1")), "left_anti")
    return kept.select(*[F.col(n).alias(c) for n, c in names.items()])


def longest_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 5) -> DataFrame:
    """Per benchmark suffix the longest verbatim match in the documents: item_id, item_word, n_words, id_col and doc_word (its place).

    Suffixes whose longest match has fewer than `least` words are left out, as are items without an id; of items that share an id, a
    suffix is named by its place in their texts one after the other. Ties go to the least id, then the least place in it.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    found = None
    for block in _blocks(benchmark.where(F.col(f"`{item_col}`").isNotNull()), item_col, item_text_col, BLOCK_BYTES):
        one = source.mapInArrow(_longest_batches(block, least), "item_id string, item_word int, n_words int, doc string, doc_word int")
        found = one if found is None else found.union(one)
    best = found.groupBy("item_id", "item_word").agg(F.max("n_words").alias("n_words"))
    kept = found.join(best, ["item_id", "item_word", "n_words"])
    kind = source.schema["__id"].dataType
    return kept.groupBy("item_id", "item_word", "n_words").agg(F.min(F.struct(F.col("doc").cast(kind).alias("id"), "doc_word")).alias("p")).select("item_id", "item_word", "n_words", F.col("p.id").alias(id_col), "p.doc_word")


def _longest_batches(block: list[tuple[str | None, str]], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = TestSuffixes(block, 1)
        at = np.flatnonzero(test.codes)
        item = np.cumsum(test.codes == 0)[at]
        first = np.searchsorted(item, item)
        for batch in batches:
            for part in slices(batch, "__text", PIECE_BYTES):
                words = split_words(part.column("__text"), ALNUM, lower=True)
                codes = np.zeros(len(words.start) + part.num_rows + 2, np.int64)
                number = test.number(words)
                some = np.flatnonzero(number)
                number[some[~test.right(words, some, number[some])]] = 0
                codes[np.arange(len(number)) + words.doc_of()] = number
                array = SuffixArray(codes, np.flatnonzero(codes), max(1, int(test.base).bit_length()))
                length, place = array.longest(test.codes, at)
                ok = np.flatnonzero(length >= least)
                doc = np.cumsum(np.bincount(words.docs[1:] + np.arange(part.num_rows), minlength=len(array.codes)))
                begin = words.docs[:-1] + np.arange(part.num_rows)
                ids = part.column("__id").cast(pa.string()).to_pylist()
                owner = doc[place[ok]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block[i][0] for i in item[ok]], pa.string()),
                        pa.array((ok - first[ok]).astype(np.int32)),
                        pa.array(length[ok].astype(np.int32)),
                        pa.array([ids[d] for d in owner], pa.string()),
                        pa.array((place[ok] - begin[owner]).astype(np.int32)),
                    ],
                    names=["item_id", "item_word", "n_words", "doc", "doc_word"],
                )

    return run
