"""Token-ID output: Parquet with one list column of token ids per document, in ascending id order.

The store is a folder of Parquet files written by Spark. Ids are dictionary-encoded (the vocabulary is small and skewed), document
ids and counts delta-encoded; row groups and pages have set sizes and carry min/max indexes, so that a reader of a few documents
opens a few pages, and a reader of the metadata never touches the ids. Files are in document order: part-00000 holds the least ids.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenframe.llm.frames import extend, shuffle_partitions
from lumenframe.llm.words import SPACED, Words, lower_ascii, same_bytes, slices, split_words, trim

#: Layout of the files. A row group is what one task reads, a page what one lookup reads.
ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
#: Bytes of words and ids that a worker remembers; beyond that it starts anew, so the bound changes speed only. A word of over LONG_WORD
#: bytes is not remembered.
CACHE_BYTES = 24 << 20
LONG_WORD = 64
#: Text that is encoded in one go.
PIECE_BYTES = 1 << 20
#: Characters that the encoder cuts off the ends of words: none of them joins a token with a letter before it.
_TAIL = np.zeros(256, bool)
_TAIL[list(b".,;:!?*&%$#")] = True
_JOINED = 100


def _other_bytes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of some spans that are of no letter a to z, à to ö and ø to ÿ (the multiplication and division signs are no letters)."""
    lead = buf == 0xC3
    tail = np.zeros(len(buf), bool)
    tail[1:] = lead[:-1]
    tail &= (buf >= 0x80) & (buf != 0x97) & (buf != 0xB7)
    follows = np.append(tail[1:], False)
    other = ~((buf >= 0x61) & (buf <= 0x7A) | tail | lead & follows)
    upto = np.concatenate([[0], np.cumsum(other, dtype=np.int32)])
    return upto[end] - upto[begin]


class _Known:
    """Words and their ids in flat arrays, in the order of the words' hashes; spelling decides, not the hash."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)
        self.ids, self.letters = np.zeros(0, np.int32), np.zeros(0, np.uint8)
        self.at = np.zeros((4, 0), np.int32)  # first id and number of ids, first letter and number of letters

    @property
    def nbytes(self) -> int:
        return self.hashes.nbytes + self.ids.nbytes + self.letters.nbytes + self.at.nbytes

    def find(self, hashes: np.ndarray, buf: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The place of each word, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero((self.hashes[place] == hashes) & (self.at[3][place] == length))
            both = np.concatenate([self.letters, buf])
            hit = hit[same_bytes(both, self.at[2][place[hit]].astype(np.int64), len(self.letters) + begin[hit], length[hit])]
            out[hit] = place[hit]
        return out

    def add(self, hashes: np.ndarray, words: list[bytes], ids: list[bytes]) -> None:
        """Words of different hashes; one that shares its hash with a word that is there is left out, as is a long one."""
        order = np.argsort(hashes)
        place = np.searchsorted(self.hashes, hashes[order])
        size = np.fromiter(map(len, words), np.int64, len(words))
        new = size[order] <= LONG_WORD
        if len(self.hashes):
            new &= self.hashes[np.minimum(place, len(self.hashes) - 1)] != hashes[order]
        order, place = order[new], place[new]
        if not len(order):
            return
        words, ids = [words[i] for i in order.tolist()], [ids[i] for i in order.tolist()]
        n_ids, n_letters = np.fromiter(map(len, ids), np.int32, len(ids)) // 4, size[order].astype(np.int32)
        rows = np.stack([len(self.ids) + np.cumsum(n_ids) - n_ids, n_ids, len(self.letters) + np.cumsum(n_letters) - n_letters, n_letters]).astype(np.int32)
        self.hashes, self.at = np.insert(self.hashes, place, hashes[order]), np.insert(self.at, place, rows, axis=1)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(ids), np.int32)])
        self.letters = np.concatenate([self.letters, np.frombuffer(b"".join(words), np.uint8)])


class Encoder:
    """Token ids of whole texts, as the library's encode() gives them.

    A vocabulary that drops white space before it merges, and maps characters one by one, has for a text the ids of its runs of
    non-space characters, one after the other. Then each distinct run goes to the library once, without its case and its trailing
    punctuation, which are tokens of their own. Any other vocabulary gets the texts whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        first = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        kinds = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"] and kinds == ["NFC", "Replace", "Lowercase"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        if made["model"].get("end_of_word_suffix"):
            self.ends[[i for w, i in self.tokenizer.get_vocab().items() if w.endswith(made["model"]["end_of_word_suffix"])]] = True
        self.known = _Known()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of each text's ids, and the ids of all texts. A null is empty."""
        if self.by_word:
            return self._encode_words(texts)
        found = self.tokenizer.encode_batch_fast([t or "" for t in texts.to_pylist()], add_special_tokens=False)
        ids = [np.array(x.ids, np.int32) for x in found]
        return np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64), np.concatenate([np.zeros(0, np.int32), *ids])

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each text."""
        if not self.by_word:
            return np.diff(self.encode(texts)[0])
        found = self._distinct(texts)
        if found is None:
            return np.zeros(len(texts), np.int64)
        _, _, size, of, bounds = found
        return np.diff(np.concatenate([[0], np.cumsum(size[of])])[bounds])

    def _encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self._distinct(texts)
        if found is None:
            return np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int32)
        flat, at, size, of, bounds = found
        n = size[of]
        total = np.concatenate([[0], np.cumsum(n)])
        out = flat[np.repeat(at[of] - total[:-1], n) + np.arange(total[-1])]
        return total[bounds], out

    def _distinct(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Some ids; for each distinct piece of the texts the first of its own among them and their number; the number of each piece's
        own distinct piece; and where each text's pieces begin. None without any."""
        words = split_words(texts, SPACED)
        if not len(words.start):
            return None
        if b"<|" not in words.buf.tobytes():  # else a special token may be spelled out, in its case
            words = Words(lower_ascii(words.buf), words.start, words.end, words.docs)
        begin, end, word = self._pieces(words)
        bounds = np.searchsorted(word, words.docs)
        hashes = words.span_hashes(begin, end)
        of = pa.array(hashes).dictionary_encode().indices.to_numpy().astype(np.int64)
        first = np.zeros(int(of.max()) + 1, np.int64)
        first[of[::-1]] = np.arange(len(of) - 1, -1, -1)  # the last to be written is the first there is
        lead = first[of]
        length = end - begin
        buf = words.buf.tobytes()
        if not ((length == length[lead]) & same_bytes(words.buf, begin, begin[lead], np.minimum(length, length[lead]))).all():  # two words have one hash
            every = [buf[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            number = {w: i for i, w in enumerate(dict.fromkeys(every))}
            ids = self._ids(list(number), [False] * len(number))
            size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            return np.frombuffer(b"".join(ids), np.int32), np.cumsum(size) - size, size, np.array([number[w] for w in every]), bounds
        begin, end, length, hashes = begin[first], end[first], length[first], hashes[first]
        place = self.known.find(hashes, words.buf, begin, length)
        had, fresh = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
        spelled = [buf[a:b] for a, b in zip(begin[fresh].tolist(), end[fresh].tolist(), strict=True)]
        letters = (_other_bytes(words.buf, begin[fresh], end[fresh]) == 0) & (length[fresh] <= LONG_WORD)
        ids = self._ids(spelled, letters.tolist())
        at, size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        at[had], size[had] = self.known.at[0][place[had]], self.known.at[1][place[had]]
        size[fresh] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at[fresh] = len(self.known.ids) + np.cumsum(size[fresh]) - size[fresh]
        flat = np.concatenate([self.known.ids, np.frombuffer(b"".join(ids), np.int32)])
        self.known.add(hashes[fresh], spelled, ids)
        if self.known.nbytes > CACHE_BYTES:
            self.known = _Known()
        return flat, at, size, of, bounds

    @staticmethod
    def _pieces(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begins and ends of the words' stems and tails, in order, and the word of each."""
        buf, start, end = words.buf, words.start, words.end
        place = np.arange(len(buf), dtype=np.int32 if len(buf) < 2**31 else np.int64)
        place[_TAIL[buf]] = 0
        tail = np.maximum.accumulate(place)[end - 1] + 1
        tail = np.where((tail > start) & (tail < end), tail, end)
        last, before = buf[tail - 1], buf[np.maximum(tail - 2, 0)]
        letter = (last >= 0x61) & (last <= 0x7A) | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7) & (tail - 2 >= start)
        tail = np.where(letter, tail, end)
        two = tail < end
        word = np.repeat(np.arange(len(start)), 1 + two)
        second = np.zeros(len(word), bool)
        second[1:] = word[1:] == word[:-1]
        return np.where(second, tail[word], start[word]), np.where(second, end[word], tail[word]), word

    def _ids(self, spelled: list[bytes], letters: list[bool]) -> list[bytes]:
        """The library's ids of some words, as the bytes of 32-bit numbers. letters: whether a word is short and of plain letters only;
        such words go to the library many at a time."""
        out: list[bytes | None] = [None] * len(spelled)
        plain = [i for i, x in enumerate(letters) if x] if self.ends.any() else []
        for i in range(0, len(plain), _JOINED * 50):
            groups = [plain[j : j + _JOINED] for j in range(i, min(i + _JOINED * 50, len(plain)), _JOINED)]
            joined = [b" ".join([spelled[k] for k in g]).decode() for g in groups]
            for group, found in zip(groups, self.tokenizer.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, np.int32)
                cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
                if len(cuts) == len(group) and cuts[-1] == 4 * len(ids):
                    raw = ids.tobytes()
                    for k, a, b in zip(group, [0, *cuts[:-1]], cuts, strict=True):
                        out[k] = raw[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i in range(0, len(rest), 2_000):
            part = rest[i : i + 2_000]
            for k, found in zip(part, self.tokenizer.encode_batch_fast([spelled[k].decode() for k in part], add_special_tokens=False), strict=True):
                out[k] = np.array(found.ids, np.int32).tobytes()
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_count(tokenizer: str, text_col: str = "text") -> Column:
    """Number of ids of a whole text, without an end id; 0 for a null."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        tokens = encoder(tokenizer)
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        out = [tokens.count(part.column("text")) for part in slices(batch, "text", PIECE_BYTES)]
        trim()
        return pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int64())

    return count(F.col(f"`{text_col}`"))


def _encode_batches(path: str, end_id: int | None, names: list[str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in batches:
            for part in slices(batch, "__text", PIECE_BYTES):
                bounds, ids = tokens.encode(part.column("__text"))
                if end_id is not None:
                    ids = np.insert(ids, bounds[1:], np.int32(end_id))
                    bounds = bounds + np.arange(len(bounds))
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(np.diff(bounds)), lists], names=[*names, "n_tokens", "tokens"])
        trim()

    return encode


def write_tokens(
    docs: DataFrame,
    to: str,
    tokenizer: str,
    end_id: int | None = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    partitions: int | None = None,
) -> None:
    """Encode every whole text and write the store to the folder `to`, in ascending id order.

    A null id comes first, a null text is empty (its only id is end_id); rows of one id follow each other in the order of their
    texts' hashes. keep: further columns to store; one called like a column of the store gets the prefix meta_. An empty table
    gives an empty store. Only the text crosses the network, once; it is encoded after that, so a lost executor costs its tasks.
    """
    taken = {"doc_id", "n_tokens", "tokens"}
    meta = [F.col(f"`{c}`").alias(f"meta_{c}" if c in taken else c) for c in keep]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("__text"), *meta)
    names = [c for c in rows.columns if c != "__text"]
    schema = extend(rows.drop("__text").schema, "n_tokens long, tokens array<int>")
    n = partitions or shuffle_partitions(docs.sparkSession)
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("__text")]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged.mapInArrow(_encode_batches(tokenizer, end_id, names), schema).write.options(
        **{
            "compression": "zstd",
            "parquet.writer.version": "v2",
            "parquet.enable.dictionary": "true",
            "parquet.enable.dictionary#doc_id": "false",
            "parquet.enable.dictionary#n_tokens": "false",
            "parquet.block.size": str(ROW_GROUP_BYTES),
            "parquet.page.size": str(PAGE_BYTES),
            "parquet.page.row.count.limit": str(PAGE_ROWS),
        }
    ).parquet(to)


def _positions(store: DataFrame) -> DataFrame:
    return store.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))


def _with_starts(rows: DataFrame, store: DataFrame) -> DataFrame:
    """start: the number of ids in all documents before. One row per file is summed in one place; the rest file by file. Files stand in
    the order of their part numbers, which Spark pads to five digits only."""
    number = F.regexp_extract("__file", r"^part-(\d+)", 1).cast("long")
    files = _positions(store.select("n_tokens")).groupBy("__file").agg(F.sum("n_tokens").alias("__sum"))
    before = files.select("__file", (F.sum("__sum").over(W.orderBy(number, "__file")) - F.col("__sum")).alias("__before"))
    inside = F.sum("n_tokens").over(W.partitionBy("__file").orderBy("__row")) - F.col("n_tokens")
    return rows.withColumn("__inside", inside).join(before, "__file").withColumn("start", F.col("__before") + F.col("__inside"))


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the kept columns of each document, without reading any ids."""
    store = spark.read.parquet(path)
    rows = _positions(store.drop("tokens"))
    return _with_starts(rows, store).drop("__file", "__row", "__inside", "__before")


def read_tokens(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """Stored rows; where is pushed to the files' page indexes, so a lookup by doc_id reads the pages that hold it."""
    store = spark.read.parquet(path)
    return store if where is None else store.where(where)


def _crc_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("tokens")
        values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
        at = lists.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("n_tokens"), batch.column("__file"), batch.column("__row"), pa.array(crc, pa.int64()), pc.list_value_length(lists).cast(pa.int64())],
            names=["doc_id", "n_tokens", "__file", "__row", "ids_crc32", "n_stored"],
        )


def digest(spark: SparkSession, path: str) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens and the CRC-32 of its ids as little-endian 32-bit numbers, from the files' ids.
    A null id stays null, a document without ids has n_tokens 0; rows that repeat are each there; an empty store gives no rows."""
    store = spark.read.parquet(path)
    rows = _positions(store).select("doc_id", "n_tokens", "tokens", "__file", "__row")
    checked = rows.mapInArrow(_crc_batches, "doc_id long, n_tokens long, __file string, __row long, ids_crc32 long, n_stored long")
    return _with_starts(checked.withColumn("n_tokens", F.col("n_stored")), store).select("doc_id", "start", "n_tokens", "ids_crc32")
