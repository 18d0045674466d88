"""SimHash near-duplicates through deletion-variant signatures.

A 64-bit fingerprint is cut into so few segments that two linked fingerprints have one segment with at most one differing bit. Every
segment is indexed under its one-wildcard variants (the segment with one bit blanked), linked fingerprints meet in an equality
join on such a variant, and each meeting is verified by counting differing bits. Copies are one fingerprint throughout.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.components import connected_components
from lumenframe.llm.frames import TEXT_ROWS, Scratch, extend, shuffle_partitions
from lumenframe.llm.words import SPACED, slices, split_words, trim

BITS = 64
#: A bucket of more fingerprints than this is not compared pair by pair; see _crowded.
MOST_PAIRED = 48
_CHUNK = 1 << 18


def ones(hashes: np.ndarray) -> np.ndarray:
    """How many of some 64-bit hashes have each bit, from the highest."""
    return np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.int64)


def majority(count: np.ndarray, n: int) -> np.uint64:
    """The fingerprint of n hashes by their counts of ones: a bit is 1 if over half have it."""
    return np.packbits(count * 2 > n).view(">u8")[0]


def fingerprint_batches(shingle: int, seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for part in slices(batch, "__text"):
                words = split_words(part.column("__text"), SPACED, lower=True)
                buf = words.buf.tobytes()
                begin, stop, docs = words.start, words.end, words.docs
                out = np.zeros(part.num_rows, np.uint64)
                for d in range(part.num_rows):
                    a, b = int(docs[d]), int(docs[d + 1])
                    if a == b:
                        continue
                    size = min(shingle, b - a)
                    count, n = np.zeros(BITS, np.int64), b - a - size + 1
                    for i in range(a, a + n, _CHUNK):
                        j = min(i + _CHUNK, a + n)
                        s, e = begin[i:j].tolist(), stop[i + size - 1 : j + size - 1].tolist()
                        count += ones(np.array([xxh64_intdigest(buf[x:y], seed) for x, y in zip(s, e, strict=True)], np.uint64))
                    out[d] = majority(count, n)
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(out.view(np.int64))], names=[*names, "fp"])
        trim()

    return run


def fingerprints(docs: DataFrame, keep: list[Column], text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """The columns of keep and fp, a long with the 64 bits: a bit is 1 if set in over half the shingles' XXH64 hashes.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a text of fewer words than a shingle is one
    shingle; one without words, and a null, have fp 0.
    """
    rows = docs.select(*keep, F.col(f"`{text_col}`").alias("__text"))
    names = [c for c in rows.columns if c != "__text"]
    return rows.mapInArrow(fingerprint_batches(shingle, seed, names), extend(rows.drop("__text").schema, "fp long"))


def _segments(distance: int) -> list[tuple[int, int]]:
    """Lowest bit and width of each segment: so many that two fingerprints within the distance have one with at most one differing bit."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _bits(low: int, width: int) -> int:
    mask = ((1 << width) - 1) << low
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _variants(fps: DataFrame, distance: int) -> DataFrame:
    """fp and key, a row for each bit of each segment: the key is a hash of the segment with that bit blanked, and of the bit's place."""
    slots = [_bits(low, width) & ~_bits(low + bit, 1) for low, width in _segments(distance) for bit in range(width)]
    masks = F.array(*[F.lit(m).cast("long") for m in slots])
    return fps.select("fp", F.posexplode(masks).alias("slot", "mask")).select(F.xxhash64("slot", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp")


def _meet_batches(distance: int, most: int):
    """Takes variants in the order of key and fp. Verified pairs (a, b) of buckets of up to `most`; (fp, null) of larger ones' members."""

    def pairs(key: np.ndarray, fp: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        crowd = size > most
        if crowd.any():
            yield np.unique(fp[crowd]), None
        key, fp = key[(size > 1) & ~crowd], fp[(size > 1) & ~crowd]
        for step in range(1, most):
            same = np.flatnonzero(key[step:] == key[:-step]) if len(key) > step else []
            if not len(same):
                break
            a, b = fp[same], fp[same + step]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= distance
            if near.any():
                yield a[near], b[near]

    def sized(key: np.ndarray) -> np.ndarray:
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        return np.repeat(np.diff(cuts), np.diff(cuts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, held_fp, gone = np.zeros(0, np.int64), np.zeros(0, np.int64), None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                key, fp = np.concatenate([held_key, batch.column("key").to_numpy()]), np.concatenate([held_fp, batch.column("fp").to_numpy()])
                if not len(key):
                    continue
                # The last bucket may go on in the next batch. Of one that is too large already, what is here is given at once.
                ready = int(np.searchsorted(key, key[-1]))
            else:
                key, fp, ready = held_key, held_fp, len(held_key)
            size = sized(key) if len(key) else np.zeros(0, np.int64)
            if gone is not None and len(key):
                size = np.where(key == gone, most + 1, size)
            if batch is not None and len(key) - ready > most or ready < len(key) and gone == key[-1]:
                gone, ready = key[-1], len(key)
                size = np.where(key == gone, most + 1, size)
            held_key, held_fp = key[ready:], fp[ready:]
            for a, b in pairs(key[:ready], fp[:ready], size[:ready]):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b) if b is not None else pa.nulls(len(a), pa.int64())], names=["a", "b"])

    return run


def _crowded(crowd: DataFrame, distance: int) -> DataFrame:
    """Links between the members (rows fp) of crowded buckets, linear in their number: the whole fingerprint is the segment, and each
    member goes under its one-change variants, so that all who meet are within the distance and need no comparison.

    Two fingerprints differ in at most two bits exactly if changing at most one bit of each gives the same number, and in at most
    one exactly if blanking some one bit does. So each member goes under itself and its 64 changes (or its 64 blanked forms); all
    that meet under one number are within the distance of each other, and are linked to the least of them.
    """
    flips = F.array(*[F.lit(x).cast("long") for x in ([0] if distance == 2 else []) + [_bits(i, 1) for i in range(BITS)]])
    forms = crowd.select("fp").distinct().select("fp", F.posexplode(flips).alias("slot", "flip"))
    if distance == 2:
        at = forms.select("fp", F.lit(0).alias("slot"), F.col("fp").bitwiseXOR(F.col("flip")).alias("sig"))
    else:
        at = forms.select("fp", "slot", F.col("fp").bitwiseAND(F.bitwise_not("flip")).alias("sig"))
    least = at.groupBy("slot", "sig").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).where("a < top").select("slot", "sig", "a")
    return at.join(least, ["slot", "sig"]).where(F.col("a") < F.col("fp")).select("a", F.col("fp").alias("b"))


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Verified links a < b between distinct fingerprints, enough of them to reach all that are reachable.

    Variants are shuffled once, sorted by key, and met in a stream of buckets. Buckets of up to MOST_PAIRED are compared pair by
    pair; the members of larger ones, which only masses of near copies fill, go a way that is linear and as exact.
    """
    if distance not in (1, 2):
        raise ValueError("links() is exact for a distance of 1 or 2")
    scratch = Scratch(fps.sparkSession, "simhash")
    dealt = _variants(fps, distance).repartition(shuffle_partitions(fps.sparkSession), "key").sortWithinPartitions("key", "fp")
    met = scratch.save(dealt.mapInArrow(_meet_batches(distance, MOST_PAIRED), "a long, b long").distinct(), "met", fps.count())
    crowded = _crowded(met.where("b IS NULL").select(F.col("a").alias("fp")), distance)
    return met.where("b IS NOT NULL").union(crowded).distinct()


def groups(fps: DataFrame, id_col: str = "id", distance: int = 2) -> DataFrame:
    """For rows (id_col, fp): fp, label (its component) and component_id, the least id in the component, per distinct fp."""
    scratch = Scratch(fps.sparkSession, "simhash")
    distinct = scratch.save(fps.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct", fps.count())
    n = distinct.count()
    joined = scratch.save(links(distinct.select("fp"), distance), "links", n)
    labels = connected_components(joined, "a", "b")
    of = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    roots = of.groupBy("label").agg(F.min("least").alias("component_id"))
    return scratch.save(of.join(roots, "label").select("fp", "label", "component_id"), "groups", n)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """Per row: the id, fingerprint (16 hex digits) and component_id. Rows of one id keep their own fingerprints; a null id has a
    row and never names a component unless all its rows are null. An empty table gives no rows; extra columns are not carried."""
    spark = docs.sparkSession
    made = fingerprints(docs, [F.col(f"`{id_col}`").cast("long").alias("id")], text_col, shingle, seed)
    fps = Scratch(spark, "simhash").save(made, "fingerprints", docs.count(), TEXT_ROWS)
    found = groups(fps, "id", distance)
    return fps.join(found, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
