"""Language identification with error-correcting output codes.

Each language has a codeword. For each of its bits a binary classifier weighs hashed byte n-grams: the log odds of a gram in the
languages whose bit is 1 against the others. A text's codeword bits are the signs of its mean weights, and the languages are ranked
by the loss of their codewords, each bit weighted by how sure it was on labelled texts that the counts have not seen. The nearest
codeword wins; a text whose second codeword is about as near is flagged as ambiguous.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.frames import extend
from lumenframe.llm.words import mix, slices, text_buffer, trim

#: Hashed grams, and the lengths of grams in bytes.
BUCKETS = 1 << 15
GRAMS = (2, 3, 4)
#: Labelled rows that training reads at most, about (rows are chosen by a hash of id and text). Prediction covers every row.
MOST_LABELLED = 60_000
#: On one in so many of these, chosen by their text, the bits' scale and certainty are measured, with the counts of the others.
CALIBRATION_SHARE = 5
#: Length of the codewords of over seven languages.
LONG_CODE = 31
_STEP = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n languages. Up to seven: all ways to divide them; more: the best of seeded random codes."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 7:
        ways = [w for w in itertools.product((1, -1), repeat=n) if w[0] == 1 and -1 in w]
        return np.array(ways, float).T
    best, far = None, -1
    for seed in range(200):
        code = np.random.default_rng(seed).choice([1.0, -1.0], (n, max(LONG_CODE, 3 * n.bit_length())))
        apart = min(int((code[i] != code[j]).sum()) for i in range(n) for j in range(i))
        if apart > far and all(len(set(column)) == 2 for column in code.T):
            best, far = code, apart
    return best


def gram_buckets(buf: np.ndarray, size: int) -> np.ndarray:
    """The bucket of the gram that starts at each byte."""
    x = np.zeros(max(0, len(buf) - size + 1), np.uint64)
    for i in range(size):
        x = x << np.uint64(8) | buf[i : len(buf) - size + 1 + i]
    return (mix(x + np.uint64(size << 56)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes of all texts with every ASCII character that is no letter as a space, and their bounds."""
    buf, bounds = text_buffer(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    letters = (buf >= 0x80) | (buf >= 0x61) & (buf <= 0x7A)
    return np.where(letters, buf, np.uint8(0x20)), bounds


def _useful(buf: np.ndarray, size: int, ends: np.ndarray) -> np.ndarray:
    """Grams with a letter that lie within one text (ends: where the texts end); a run of spaces counts once."""
    n = max(0, len(buf) - size + 1)
    space = buf == 0x20
    use = ~(space[:n] & space[1 : n + 1])
    over = (ends[:, None] - np.arange(1, size)).ravel()
    use[over[(over >= 0) & (over < n)]] = False
    return use


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # BUCKETS x bits
    scale: np.ndarray  # of each bit's mean weight
    trust: np.ndarray  # weight of each bit's loss

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Mean weight of the grams of each text, per bit; 0 without grams."""
        buf, bounds = prepared(texts)
        n, bits = len(texts), self.weights.shape[1]
        total, count = np.zeros((n, bits)), np.zeros(n)
        table = np.concatenate([self.weights, np.zeros((1, bits), np.float32)])  # the last row is for grams that do not count
        for low in range(0, len(buf), _STEP):
            part = buf[low : low + _STEP + max(GRAMS) - 1]
            first, last = np.searchsorted(bounds, low, "right") - 1, np.searchsorted(bounds, min(low + _STEP, len(buf)), "left")
            for size in GRAMS:
                bucket = gram_buckets(part, size)[:_STEP]
                use = _useful(part, size, bounds[first + 1 : last + 1] - low)[:_STEP]
                bucket[~use] = BUCKETS
                begin = np.clip(bounds[first:last] - low, 0, len(bucket))
                end = np.clip(bounds[first + 1 : last + 1] - low, 0, len(bucket))
                some = np.flatnonzero(end > begin)
                if len(some):
                    total[first + some] += np.add.reduceat(table[bucket[: end[some[-1]]]], begin[some], axis=0)
                    count[first + some] += np.add.reduceat(use[: end[some[-1]]].astype(np.int64), begin[some])
        return total / np.maximum(count, 1)[:, None]

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Loss of each language's codeword: the trusted sum of log(1 + exp(-bit * margin))."""
        z = margins / self.scale
        return (np.logaddexp(0, -z[:, None, :] * self.code[None]) * self.trust).sum(2)


def _count_batches():
    """To gram counts by language, apart for the rows that the calibration takes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, bool], np.ndarray] = {}
        for batch in batches:
            labels = list(zip(batch.column("lang").to_pylist(), batch.column("apart").to_pylist(), strict=True))
            for label in set(labels):
                chosen = batch.column("__text").filter(pa.array([x == label for x in labels]))
                for part in slices(pa.RecordBatch.from_arrays([chosen], names=["t"]), "t"):
                    buf, bounds = prepared(part.column("t"))
                    for size in GRAMS:
                        x = gram_buckets(buf, size)[_useful(buf, size, bounds[1:])]
                        totals[label] = totals.get(label, 0) + np.bincount(x, minlength=BUCKETS)
        for (lang, apart), n in totals.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array([apart] * len(at)), pa.array(at), pa.array(n[at])], names=["lang", "apart", "bucket", "n"])
        trim()

    return run


def _weights(grams: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Log odds of each gram bucket for each bit: its mean share in the languages whose bit is 1, against the others."""
    share = (grams + 0.5) / (grams + 0.5).sum(1, keepdims=True)
    out = np.zeros((BUCKETS, code.shape[1]), np.float32)
    for b in range(code.shape[1]):
        plus, minus = share[code[:, b] > 0], share[code[:, b] < 0]
        if len(plus) and len(minus):
            out[:, b] = np.log(plus.mean(0)) - np.log(minus.mean(0))
    return out


def _below(chance: Column, share: float) -> Column:
    """Whether a 64-bit hash is among that share of all, in steps of one hash."""
    return chance < F.lit(min(2**63 - 1, int(share * 2**64) - 2**63))


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str | None = "doc_id", most: int = MOST_LABELLED) -> Model:
    """Learn from rows with a label and a text. The driver gets one count per gram bucket and language, and two sums per bit.

    Nulls are left out; an empty table, or one without labels, gives a model without languages, under which every text is unknown. Of
    more than `most` labelled rows a share is drawn by a hash of id and text, so copies with ids of their own are drawn one by one.
    Copies of one text are all measured on, or none.
    """
    label, text = F.col(f"`{lang_col}`"), F.col(f"`{text_col}`")
    chance = F.xxhash64(F.lit("sample"), *([F.col(f"`{id_col}`")] if id_col else []), text)
    known = labelled.where(label.isNotNull())
    n = known.count()
    rows = known.where(_below(chance, most / n)) if n > most else known
    rows = rows.select(label.alias("lang"), text.alias("__text")).where("__text is not null")
    rows = rows.withColumn("apart", F.pmod(F.xxhash64(F.lit("calibration"), F.col("__text")), F.lit(CALIBRATION_SHARE)) == 0)
    counted = rows.mapInArrow(_count_batches(), "lang string, apart boolean, bucket long, n long").groupBy("lang", "apart", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counted.column("lang").combine_chunks().dictionary_encode()
    languages = tuple(sorted(names.dictionary.to_pylist()))
    own = np.array([languages.index(x) for x in names.dictionary.to_pylist()], np.int64)
    apart = counted.column("apart").to_numpy().astype(np.int64)
    grams = np.zeros((2, len(languages), BUCKETS))
    grams[apart, own[names.indices.to_numpy()], counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    code = codewords(len(languages))
    bits = code.shape[1]
    weights = _weights(grams.sum(0), code)
    if len(languages) < 2:
        return Model(languages, code, weights, np.ones(bits), np.ones(bits) / bits)
    blind = Model(languages, code, _weights(grams[0], code), np.ones(bits), np.ones(bits) / bits)
    sums = rows.where("apart").mapInArrow(_calibrate_batches(blind), "bit int, size double, hits double, n long").groupBy("bit").agg(*[F.sum(c).alias(c) for c in ("size", "hits", "n")]).collect()
    size, hits = np.ones(bits), np.full(bits, 0.5)
    for r in sums:
        size[r.bit] = r["size"] / max(r.n, 1)
        hits[r.bit] = (r.hits + 1) / (r.n + 2)
    trust = np.log(np.maximum(hits, 0.51) / (1 - np.maximum(hits, 0.51)))  # a bit that is right half the time says nothing
    return Model(languages, code, weights, np.maximum(size, 1e-6) / 4, trust / trust.sum())


def _calibrate_batches(model: Model):
    """Per bit the sums of the margins' sizes and of right signs, and the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = model.code.shape[1]
        size, hits, n = np.zeros(bits), np.zeros(bits), 0
        for batch in batches:
            for part in slices(batch, "__text"):
                m = model.margins(part.column("__text"))
                sign = model.code[[model.languages.index(x) for x in part.column("lang").to_pylist()]].reshape(len(m), bits)
                size += np.abs(m).sum(0)
                hits += (m * sign > 0).sum(0)
                n += len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(bits, dtype=np.int32)), pa.array(size), pa.array(hits), pa.array([n] * bits)], names=["bit", "size", "hits", "n"])

    return run


def _predict_batches(model: Model, names: list[str], sure: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                texts = part.column("__text")
                lang, score, ambiguous = [], [], []
                known = len(model.languages)
                losses = model.losses(model.margins(texts)) if known else np.zeros((part.num_rows, 0))
                for text, loss in zip(texts, losses, strict=True):
                    if not known or not text.is_valid or not _LETTER.search(text.as_py()):
                        lang.append(UNKNOWN)
                        score.append(0.0)
                        ambiguous.append(True)
                        continue
                    best = int(np.argmin(loss))
                    p = float(1 / np.exp(SHARPNESS * (loss[best] - loss)).sum())
                    gap = float(np.sort(loss)[1] - loss[best]) if known > 1 else np.inf
                    lang.append(model.languages[best])
                    score.append(p)
                    ambiguous.append(gap < sure)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ambiguous, pa.bool_())], names=[*names, "lang_pred", "score", "ambiguous"]
                )
        trim()

    return run


#: A text is ambiguous if its two least losses are nearer than this.
SURE = 0.02
#: How fast a score falls with the distance of the next codewords; it orders texts, and is no probability.
SHARPNESS = 8.0


def predict(docs: DataFrame, model: Model, keep: list[Column], text_col: str = "text", sure: float = SURE, with_text: bool = False) -> DataFrame:
    """The columns of keep, the text if asked for, lang_pred, score (0 to 1) and ambiguous, for every row, from its whole text only.

    A null text, one without a letter, and every text under a model that has learned no language, is `und` with score 0.
    """
    rows = docs.select(*keep, F.col(f"`{text_col}`").alias("__text"))
    names = [c for c in rows.columns if with_text or c != "__text"]
    out = rows.mapInArrow(_predict_batches(model, names, sure), extend(rows.select(*names).schema, "lang_pred string, score double, ambiguous boolean"))
    return out.withColumnRenamed("__text", text_col) if with_text else out


def fold(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as 0."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(f"`{id_col}`").cast("string"), "UTF-8")), F.lit(3)), F.lit(0))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: the id, held_out (its fold is 1; the model learns from the others), lang_pred, score and ambiguous. Nulls, empty and
    very long texts, empty tables: as in fit() and predict(); rows that repeat are each answered; other columns are not looked at."""
    model = fit(docs.where(fold(id_col) != 1), lang_col, text_col, id_col)
    keep = [F.col(f"`{id_col}`").alias("__k0"), (fold(id_col) == 1).alias("__k1")]
    out = predict(docs, model, keep, text_col)
    return out.withColumnsRenamed({"__k0": id_col, "__k1": "held_out"})
