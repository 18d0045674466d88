"""SimHash near-dedup at a similarity of shingle sets, exact: every pair of at least 4/5 is found, and no other.

Fingerprints of the sets link through their deletion-variant signatures (simhash.links), and each link is verified on the sets. That
settles masses of copies in linear time. But sets that similar differ in up to some twenty bits of 64, for which segments with one
differing bit would have to be so short that every one of them is in a large part of all documents. So the pairs that fingerprints
miss are found by another index, a prefix filter on the sets themselves, and verified in the same way.

Of two sets that similar, the first fifths in any common order of all shingles share one (prefix filter). The order puts shingles
that are common in the corpus last, so that few sets meet. Meetings that sizes, positions or parity sketches rule out are dropped; the
others are verified on the whole sets, first one for each set, then those that this leaves in different components. Masses of near
copies that meet under one shingle are linked to one of them first; of the pairs that this leaves in different components, those that
links connect already are passed over, so that links grow with the sets and not with the pairs.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import simhash
from lumenframe.llm.components import connected_components
from lumenframe.llm.frames import TEXT_ROWS, Scratch, extend, shuffle_partitions
from lumenframe.llm.words import SPACED, mix, slices, split_words, trim

#: A bucket of more sets than this is not compared pair by pair at once; its shingle is common.
MOST_PAIRED = 48
#: Sets of a crowded bucket, or of a cluster of near copies, that a task compares with as many others.
BLOCK_SETS = 2_048
#: Shingles of the whole sets of a block, about: 32 MB.
BLOCK_SHINGLES = 4_000_000
#: Common shingles that the order of shingles knows, the most common ones: they go to every task. Of more, the others count as rare,
#: which costs meetings and changes no result.
MOST_COMMON = 100_000
#: Texts to verify whose numbers are sent to every task, so that only they are shuffled; of more, all are.
MOST_SENT = 1_000_000
#: Least numbers of 64 bits in a set's parity sketch; a sketch has two to four bits for each shingle.
LEAST_SKETCH = 4


def _sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """The distinct shingles of each text, as ascending 64-bit hashes. A text of fewer words is one shingle."""
    words = split_words(texts, SPACED, lower=True)
    docs = words.docs
    size = np.minimum(shingle, words.counts)
    at = np.arange(len(words.start))
    long = np.repeat(size, words.counts)
    first = at[at + long <= words.doc_end()]
    hashes = words.hashes(first, first + long[first] - 1).view(np.int64)
    bounds = np.searchsorted(first, docs)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        yield np.unique(hashes[a:b])


def _name(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), 42)).view(np.int64)) if len(found) else 0


def _sketch(found: np.ndarray) -> np.ndarray:
    """A bit for each residue of the hashes: whether an odd number has it. Sets differ in at least as many elements as sketches in bits.
    Of a sketch of twice the size, the two halves differ where the smaller one has a 1."""
    size = max(LEAST_SKETCH, 1 << max(0, 2 * len(found) - 1).bit_length() >> 6)
    odd = np.bincount((found.view(np.uint64) & np.uint64(64 * size - 1)).astype(np.int64), minlength=64 * size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefix(found: np.ndarray, size: int, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The first elements of a set: rare ones by their hash, then common ones, the least common first."""
    seen = np.zeros(len(found), np.int64)
    if len(common) and len(found):
        at = np.minimum(np.searchsorted(common, found), len(common) - 1)
        seen = np.where(common[at] == found, often[at], 0)
    return found[np.lexsort((found, seen))[:size]]


def _tally_batches(shingle: int, parts: int):
    """To rows (part, hashes, counts): how often shingles stand among the first fourths of the sets, by hash alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = [np.zeros(0, np.int64)]
            for part in slices(batch, "__text"):
                first += [x[: len(x) // 4 + 1] for x in _sets(part.column("__text"), shingle)]
            values, counts = np.unique(np.concatenate(first), return_counts=True)
            if not len(values):
                continue
            part = (mix(values.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            values, counts, part = values[order], counts[order].astype(np.int32), part[order]
            cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(part))
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            columns = [pa.array(part[cuts[:-1]]), pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].tobytes() for a, b in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "hashes", "counts"])
        trim()

    return run


def _common_batches(most: int):
    """Of all tallies of a part: the shingles that stand there more than `most` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for part, h, n in zip(*(batch.column(c).to_pylist() for c in ("part", "hashes", "counts")), strict=True):
                held.setdefault(part, []).append((h, n))
        for packs in held.values():
            h = np.frombuffer(b"".join(x for x, _ in packs), np.int64)
            n = np.frombuffer(b"".join(x for _, x in packs), np.int32)
            order = np.argsort(h)
            h, n = h[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
            total = np.add.reduceat(n, first)
            yield pa.RecordBatch.from_arrays([pa.array(h[first][total > most]), pa.array(total[total > most])], names=["h", "n"])
        trim()

    return run


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The most common shingles of the corpus, ascending, and how often each was counted."""
    parts = shuffle_partitions(texts.sparkSession)
    dealt = texts.mapInArrow(_tally_batches(shingle, parts), "part int, hashes binary, counts binary").repartitionById(parts, "part")
    seen = dealt.mapInArrow(_common_batches(MOST_PAIRED), "h long, n long").orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow().sort_by("h")
    return seen.column("h").to_numpy(), seen.column("n").to_numpy()


def _set_batches(shingle: int, names: list[str], common: np.ndarray, often: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                every = list(_sets(part.column("__text"), shingle))
                columns = [pa.array([_name(x) for x in every], pa.int64()), pa.array([len(x) for x in every], pa.int32())]
                columns += [pa.array([_prefix(x, len(x) // 5 + 1, common, often) for x in every], pa.list_(pa.int64())), pa.array([_sketch(x) for x in every], pa.list_(pa.int64()))]
                sims = np.array([simhash.majority(simhash.ones(x), len(x)) for x in every], np.uint64)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *columns, pa.array(sims.view(np.int64))], names=[*names, "fp", "n", "prefix", "sketch", "sim"])
        trim()

    return run


def _whole_batches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                every = list(_sets(part.column("__text"), shingle))
                yield pa.RecordBatch.from_arrays([pa.array([_name(x) for x in every], pa.int64()), pa.array(every, pa.list_(pa.int64()))], names=["fp", "shingles"])
        trim()

    return run


def _meet_batches(most: int):
    """Takes rows (h, fp, n, pos) in the order of h. Candidates (a, b, null) of buckets of up to `most`; (fp, null, h) of larger ones' members."""

    def pairs(rows: np.ndarray, size: np.ndarray) -> Iterator[tuple]:
        crowd = size > most
        if crowd.any():
            yield rows[1, crowd], None, rows[0, crowd]
        h, fp, n, pos = rows[:, (size > 1) & ~crowd]
        for step in range(1, most):
            same = np.flatnonzero(h[step:] == h[:-step]) if len(h) > step else []
            if not len(same):
                break
            x, y = same, same + step
            least = np.minimum(n[x] - pos[x], n[y] - pos[y])  # elements that can be shared, if this is the first
            near = 9 * least >= 4 * (n[x] + n[y])
            a, b = fp[x][near], fp[y][near]
            if len(a):
                yield np.minimum(a, b), np.maximum(a, b), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, gone = np.zeros((4, 0), np.int64), None
        for batch in itertools.chain(batches, [None]):
            rows = held
            if batch is not None:
                rows = np.concatenate([held, np.array([batch.column(c).to_numpy() for c in ("h", "fp", "n", "pos")], np.int64)], axis=1)
            h = rows[0]
            if not len(h):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            size = np.repeat(np.diff(cuts), np.diff(cuts))
            # The last bucket may go on in the next batch. Of one that is too large already, what is here is given at once.
            ready = len(h) if batch is None else int(cuts[-2])
            if gone is not None:
                size[h == gone] = most + 1
            if ready < len(h) and (len(h) - ready > most or gone == h[-1]):
                gone, ready = h[-1], len(h)
                size[h == gone] = most + 1
            held = rows[:, ready:]
            for a, b, key in pairs(rows[:, :ready], size[:ready]):
                none = pa.nulls(len(a), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if key is None else pa.array(key)], names=["a", "b", "h"])

    return run


def _possible(x: str, y: str) -> Column:
    """Whether sizes and sketches of two sets leave room for a similarity of 4/5: they may differ in a ninth of their elements. Sizes
    that do have sketches of one size, or one of twice the other's."""
    n, m, p, q = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.sketch"), F.col(f"{y}.sketch")
    xor = lambda u, v: u.bitwiseXOR(v)
    half = lambda s: (F.size(s) / 2).cast("int")
    fold = lambda s: F.zip_with(F.slice(s, 1, half(s)), F.slice(s, half(s) + 1, half(s)), xor)
    p, q = F.when(F.size(p) > F.size(q), fold(p)).otherwise(p), F.when(F.size(q) > F.size(p), fold(q)).otherwise(q)
    differ = F.aggregate(F.zip_with(p, q, xor), F.lit(0), lambda total, v: total + F.bit_count(v))
    return F.when(~(5 * F.least(n, m) >= 4 * F.greatest(n, m)), False).otherwise(9 * differ <= n + m)


class _Block:
    """Sets of one block, by the size of their sketches and their own."""

    def __init__(self, rows: list[dict]):
        rows.sort(key=lambda r: (len(r["sketch"]), r["n"], r["fp"]))
        self.rows = rows
        self.fp, self.label, self.n = (np.array([r[c] for r in rows], np.int64) for c in ("fp", "label", "n"))
        size = np.array([len(r["sketch"]) for r in rows])
        self.sketches: dict[int, tuple[int, int, np.ndarray]] = {}  # by size: from, to, sketches
        for length in np.unique(size).tolist():
            a, b = np.searchsorted(size, [length, length + 1])
            self.sketches[length] = (int(a), int(b), np.array([r["sketch"] for r in rows[a:b]], np.int64).view(np.uint64))

    def near(self, other: "_Block", i: int) -> np.ndarray:
        """Sets of the other block in other components that may be similar to the i-th of this one; of this block itself, later ones."""
        n, out = int(self.n[i]), []
        own = np.array(self.rows[i]["sketch"], np.int64).view(np.uint64)
        for length, (a, b, sketches) in other.sketches.items():
            if not len(own) // 2 <= length <= 2 * len(own):
                continue
            # In this part sizes ascend: those within the similarity are a stretch.
            low, high = a + np.searchsorted(other.n[a:b], [-(-4 * n // 5), 5 * n // 4 + 1])
            low = max(low, i + 1) if other is self else low
            at = low + np.flatnonzero(other.label[low:high] != self.label[i])
            if not len(at):
                continue
            x, y = own, sketches[at - a]
            if length < len(own):
                x = own[:length] ^ own[length:]
            elif length > len(own):
                y = y[:, : len(own)] ^ y[:, len(own) :]
            out.append(at[9 * np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= n + other.n[at]])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def similar(self, other: "_Block", i: int, j: int) -> bool:
        """Whether the i-th set and the j-th of the other block have a similarity of 4/5, by their shingles."""
        shared = len(np.intersect1d(self.rows[i]["s"], other.rows[j]["s"], assume_unique=True))
        return bool(9 * shared >= 4 * (self.n[i] + other.n[j]))


class _Roots:
    """The components of two blocks (or one block twice), and which of them were brought together: each has the least of them as its root."""

    def __init__(self, first: _Block, last: _Block):
        self.labels, at = np.unique(np.concatenate([first.label, last.label]), return_inverse=True)
        self.first, self.last = at[: len(first.label)], at[len(first.label) :]
        self.root = np.arange(len(self.labels))

    def join(self, nodes: np.ndarray) -> None:
        roots = np.unique(self.root[nodes])
        if len(roots) > 1:
            self.root[np.isin(self.root, roots)] = roots[0]


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Block, _Block]]:
    """Takes rows (key, low, high, block, fp, label, n, sketch, perhaps s) in the order of the first three; gives the two blocks of each
    group. A pair of different blocks is met under both together only; one block alone is met with itself. Memory holds two blocks."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            columns = [[x.values.to_numpy() for x in c] if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
            for values in zip(*columns, strict=True):
                yield dict(zip(batch.schema.names, values, strict=True))

    for (_, low, high), group in itertools.groupby(rows(), key=lambda r: (r["key"], r["low"], r["high"])):
        parts: dict[int, list[dict]] = {}
        for r in group:
            parts.setdefault(r["block"], []).append(r)
        if len(parts) == (1 if low == high else 2):
            first = _Block(parts[low])
            yield first, first if low == high else _Block(parts[high])


def _maybe_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks: the sets that may be similar to one of another component, their components, and for each of these the
    least one that such pairs connect it with. A row for each set at most, however many pairs there are."""
    for first, last in _block_pairs(batches):
        roots = _Roots(first, last)
        hit, met = np.zeros(len(first.rows), bool), np.zeros(len(last.rows), bool)
        for i in range(len(first.rows)):
            at = first.near(last, i)
            if len(at):
                hit[i] = met[at] = True
                roots.join(np.append(roots.last[at], roots.first[i]))
        fp, nodes = np.concatenate([first.fp[hit], last.fp[met]]), np.concatenate([roots.first[hit], roots.last[met]])
        fp, once = np.unique(fp, return_index=True)
        nodes = nodes[once]
        yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array(roots.labels[nodes]), pa.array(roots.labels[roots.root[nodes]])], names=["fp", "label", "root"])
    trim()


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each pair of blocks: links, verified on the sets, that connect all components which links connect; fewer than components.
    A pair that may be similar is verified unless the links before it connect its components already."""
    for first, last in _block_pairs(batches):
        roots, found = _Roots(first, last), []
        for i in range(len(first.rows)):
            own, at = roots.first[i], first.near(last, i)
            while len(at := at[roots.root[roots.last[at]] != roots.root[own]]):
                j, at = int(at[0]), at[1:]
                if first.similar(last, i, j):
                    roots.join(np.array([own, roots.last[j]]))
                    found.append(sorted((int(first.fp[i]), int(last.fp[j]))))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=["a", "b"])
    trim()


def _in_blocks(rows: DataFrame, key: str, most: Column) -> DataFrame:
    """The rows as _block_pairs takes them. Groups of one key are cut into blocks, `most` of them being the aggregate that tells how
    many; every two blocks of a key are one group of bounded size, however large the key's is."""
    parts = shuffle_partitions(rows.sparkSession)
    # Few keys need several blocks, as each of these is full: they go to every task, and no key's rows are gathered before they are cut.
    large = rows.groupBy(key).agg(most.cast("int").alias("blocks")).where("blocks > 1")
    rows = rows.join(F.broadcast(large), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("blocks", "other").withColumnRenamed(key, "key")
    return rows.repartition(parts, "key", "low", "high").sortWithinPartitions("key", "low", "high")


def _crossed(open_: DataFrame, verifier: "_Verifier", n: int) -> DataFrame:
    """Links between sets of one crowded bucket and different components, enough of them to connect all that links connect; their
    number grows with the sets, not with the pairs. open_: h, fp, label, n, sketch.

    Sketches tell which sets may have a link, and which components these may connect; in a cluster of such components each set is
    once, with all its shingles, so tasks can verify pairs and pass over those that are connected already."""
    columns = ["fp", "label", "n", "sketch"]
    maybe = _in_blocks(open_.select("h", *columns), "h", F.ceil(F.count("*") / BLOCK_SETS)).mapInArrow(_maybe_batches, "fp long, label long, root long")
    maybe = verifier.scratch.save(maybe.distinct(), "maybe", n)
    clusters = connected_components(maybe.select("label", "root").distinct(), "label", "root").select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    sets = maybe.select("fp", "label").distinct().join(clusters, "label").join(verifier.distinct.select("fp", "n", "sketch"), "fp")
    whole = verifier.whole(maybe.select("fp").distinct())
    most = F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES))
    found = _in_blocks(sets.join(whole, "fp").select("cluster", *columns, "s"), "cluster", most).mapInArrow(_forest_batches, "a long, b long")
    found = verifier.scratch.save(found.distinct(), "forest", n)
    verifier.scratch.drop(whole)
    return found


class _Verifier:
    """Whole sets against each other."""

    def __init__(self, distinct: DataFrame, texts: DataFrame, shingle: int, scratch: Scratch, rows: int):
        self.distinct, self.texts, self.shingle, self.scratch, self.rows = distinct, texts, shingle, scratch, rows

    def close(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) that sizes and sketches do not rule out."""
        light = self.distinct.select("fp", "n", "sketch")
        met = pairs.join(light.alias("x"), F.col("a") == F.col("x.fp")).join(light.alias("y"), F.col("b") == F.col("y.fp"))
        return self.scratch.save(met.where(_possible("x", "y")).select("a", "b"), "close", self.rows, TEXT_ROWS)

    def whole(self, need: DataFrame) -> DataFrame:
        """The shingles s of the sets fp."""
        need = self.scratch.save(need.join(self.distinct, "fp").select("fp", "text_hash"), "need", self.rows)
        few = need.count() <= MOST_SENT
        send = F.broadcast if few else lambda df: df
        rows = self.texts.join(send(need.select("text_hash")), F.xxhash64("__text") == F.col("text_hash"), "left_semi")
        whole = rows.mapInArrow(_whole_batches(self.shingle), "fp long, shingles array<long>").join(send(need.select("fp")), "fp", "left_semi")
        return self.scratch.save(whole.groupBy("fp").agg(F.first("shingles").alias("s")), "whole", self.rows, TEXT_ROWS)

    def links(self, pairs: DataFrame) -> DataFrame:
        """Those of the pairs whose sets have a similarity of at least 4/5."""
        whole = self.whole(pairs.select(F.col("a").alias("fp")).union(pairs.select(F.col("b").alias("fp"))).distinct())
        both = pairs.join(whole.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a").join(whole.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
        shared = F.size(F.array_intersect("sa", "sb"))
        out = self.scratch.save(both.where(9 * shared >= 4 * (F.size("sa") + F.size("sb"))).select("a", "b"), "links", self.rows, TEXT_ROWS)
        self.scratch.drop(whole)
        return out


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose nodes are not known to be connected."""
    x, y = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    return pairs.join(x, "a", "left").join(y, "b", "left").where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def groups(docs: DataFrame, keep: list[Column], id_col: str = "id", text_col: str = "text", shingle: int = 5) -> tuple[DataFrame, DataFrame]:
    """The columns of keep with fp, a number for the row's shingle set; and for each fp its label (its component) and component_id,
    the least id in the component. Words are those of simhash.fingerprints; texts without words, and nulls, are one set. Rows that
    repeat share an fp. An empty table gives no rows."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near_copies")
    text = F.col(f"`{text_col}`")
    texts = docs.select(text.alias("__text"))
    common, often = _common(texts, shingle)
    rows = docs.select(*keep, F.xxhash64(text).alias("text_hash"), text.alias("__text"))
    names = [c for c in rows.columns if c != "__text"]
    made = rows.mapInArrow(_set_batches(shingle, names, common, often), extend(rows.drop("__text").schema, "fp long, n int, prefix array<long>, sketch array<long>, sim long"))
    rows = docs.count()
    made = scratch.save(made, "sets", rows, TEXT_ROWS)
    distinct = made.groupBy("fp").agg(F.min(id_col).alias("least"), *[F.first(c).alias(c) for c in ("n", "prefix", "sketch", "sim", "text_hash")])
    distinct = scratch.save(distinct, "distinct", rows, TEXT_ROWS)
    n = distinct.count()
    verifier = _Verifier(distinct, texts, shingle, scratch, rows)

    # Sets of one fingerprint hang on the first of them, and the first ones of linked fingerprints on each other.
    firsts = scratch.save(distinct.groupBy("sim").agg(F.min("fp").alias("a")), "firsts", n)
    same = distinct.join(firsts, "sim").where("a < fp").select("a", F.col("fp").alias("b"))
    other = firsts.select(F.col("sim").alias("other"), F.col("a").alias("o"))
    linked = scratch.save(simhash.links(firsts.select(F.col("sim").alias("fp"))), "linked", n).select(F.col("a").alias("sim"), F.col("b").alias("other"))
    linked = linked.join(firsts, "sim").join(other, "other").select(F.least("a", "o").alias("a"), F.greatest("a", "o").alias("b"))

    dealt = distinct.select("fp", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "fp", "n", "pos")
    dealt = dealt.repartition(shuffle_partitions(spark), "h").sortWithinPartitions("h", "fp")
    met = scratch.save(dealt.mapInArrow(_meet_batches(MOST_PAIRED), "a long, b long, h long"), "met", n, TEXT_ROWS)
    crowd = met.where("h IS NOT NULL").select("h", F.col("a").alias("fp"))
    hubs = crowd.groupBy("h").agg(F.min("fp").alias("a"))
    star = crowd.join(hubs, "h").where("a < fp").select("a", F.col("fp").alias("b"))
    close = verifier.close(met.where("h IS NULL").select("a", "b").union(star).union(same).union(linked).distinct())
    # One pair for each set first: of masses of copies, that leaves few of the other pairs to look at.
    links = verifier.links(close.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    labels = connected_components(links)
    rest = scratch.save(_apart(close, labels), "rest", n)
    if not rest.isEmpty():
        links = links.union(verifier.links(rest))
        labels = connected_components(links)
    if not crowd.isEmpty():  # of crowded buckets, what the stars did not bring together
        light = distinct.select("fp", "n", "sketch")
        placed = crowd.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
        split = placed.groupBy("h").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("h")
        open_ = scratch.save(placed.join(split, "h").join(light, "fp"), "open", n)
        cross = _crossed(open_, verifier, open_.count())
        if not cross.isEmpty():
            links = links.union(cross)
            labels = connected_components(links)

    of = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    roots = of.groupBy("label").agg(F.min("least").alias("component_id"))
    return made.select(*[n for n in names if n != "text_hash"], "fp"), scratch.save(of.join(roots, "label").select("fp", "label", "component_id"), "groups", n)
