"""Substring dedup, SimHash and decontamination against brute force, on small texts with every awkward case."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenframe.llm import decontaminate, simhash, substring_dedup
from lumenframe.llm.components import connected_components
from lumenframe.llm.frames import NO_ID
from lumenframe.llm.words import ALNUM, SPACED, split_words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, at int, fp string, items string"


def rows(spark, pairs):
    return spark.createDataFrame([(i, t, None, None, None, 1, "x", "y") for i, t in pairs], SCHEMA).repartition(3)


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def some_docs(seed, n=60):
    r = random.Random(seed)
    vocab = ["a", "bb", "Ccc", "é", "dd.", "e-f", "日本"]
    passages = [" ".join(r.choice(vocab) for _ in range(r.randint(20, 40))) for _ in range(4)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.randint(0, 4)):
            parts.append(r.choice(passages) if r.random() < 0.5 else " ".join(r.choice(vocab) for _ in range(r.randint(0, 25))))
        docs.append((i, r.choice([" ", "\n", "\t "]).join(parts)))
    docs += [(100, None), (101, ""), (102, " \n "), (103, "z " * 3000), (104, docs[5][1]), (104, docs[5][1]), (104, docs[6][1]), (None, docs[7][1]), (None, docs[8][1])]
    return docs


def brute_repeats(docs, window):
    key = lambda i: -(2**63) if i is None else i
    first = {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    for (i, _), words in zip(docs, split):
        for p in range(len(words) - window + 1):
            w = tuple(words[p : p + window])
            first[w] = min(first.get(w, (key(i), p)), (key(i), p))
    out = []
    for (i, _), words in zip(docs, split):
        gone = set()
        for p in range(len(words) - window + 1):
            if first[tuple(words[p : p + window])] < (key(i), p):
                gone |= set(range(p, p + window))
        kept = " ".join(w for p, w in enumerate(words) if p not in gone)
        out.append((i, len(words), len(gone), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,window,hot", [(1, 20, 1000), (2, 20, 1), (3, 7, 1)])
def test_repeats_match_brute_force(spark, monkeypatch, seed, window, hot):
    monkeypatch.setattr(substring_dedup, "HOT_LEAST", hot)
    docs = some_docs(seed)
    got = substring_dedup.remove_repeats(rows(spark, docs), window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == brute_repeats(docs, window)


def test_hot_minimisers_come_last():
    words = split_words(pa.array([t for _, t in some_docs(2)]), SPACED)
    at, mini, moved, runs = substring_dedup.minimisers(words, 20)
    assert not moved.any()
    values, counts = np.unique(mini, return_counts=True)
    hot = np.sort(values[counts > 5])
    at2, mini2, moved2, _ = substring_dedup.minimisers(words, 20, hot)
    assert (at2 == at).all() and (moved2 == np.isin(mini, hot)).all() and (mini2 == mini)[~moved2].all() and moved2.any()
    of = {}
    for a, m in zip(at2.tolist(), mini2.tolist()):
        text = words.buf[words.start[a] : words.end[a + 19]].tobytes()
        assert of.setdefault(text, m) == m and m not in set(hot.tolist())


def test_repeats_of_many_texts_without_an_id():
    """One first line under 4,000 texts of one (null) id: memory is linear in the text."""
    line = " ".join(f"l{i}" for i in range(200))
    texts = [f"{line} {i} x y z" for i in range(4000)]
    scope = substring_dedup._Scope(20, substring_dedup.Repeated(np.full((1, 64), 255, np.uint8), np.zeros(0, np.uint64)))
    scope.add([NO_ID] * 4000, list(range(4000)), split_words(pa.array(texts), SPACED))
    size = sum(len(k) for k in scope.kept) + sum(len(k) for k, _ in scope.more)
    assert size < 20 * sum(map(len, texts)) and len(scope.more) >= 3999


def test_repeats_tell_equal_hashes_apart(spark, monkeypatch):
    """Windows are told apart by their words: with a hash that is the same for all, the result is the same."""
    import numpy as np

    docs = some_docs(4, 12)[:12]
    rows_ = []
    for i, t in docs:
        words = (t or "").split()
        if len(words) >= 20:
            rows_.append((" ".join(words).encode(), i, 0, 0))
    want = sorted(substring_dedup._later_windows(rows_, 20))
    monkeypatch.setattr(substring_dedup.Words, "hashes", lambda self, a, b: np.zeros(len(a), np.uint64))
    assert sorted(substring_dedup._later_windows(rows_, 20)) == want


def test_repeats_of_empty_table(spark):
    assert substring_dedup.remove_repeats(rows(spark, []).where("false")).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(fps, distance=2):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def test_simhash_matches_brute_force(spark):
    docs = some_docs(7, 40)
    long = " ".join(f"w{i}" for i in range(2000))
    docs += [(200 + k, long.replace(f"w{k * 7} ", "x ")) for k in range(12)]
    got = simhash.near_duplicates(rows(spark, docs)).collect()
    fps = [brute_fingerprint(t) for _, t in docs]
    comp = brute_components(fps)
    least = {}
    for c, (i, _) in zip(comp, docs):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted(((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(docs, fps, comp)), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    assert any(c != f for c, f in zip(comp, range(len(comp))))


@pytest.mark.parametrize("distance,most", [(2, 48), (2, 3), (1, 48), (1, 3)])
def test_links_reach_all(spark, monkeypatch, distance, most):
    monkeypatch.setattr(simhash, "MOST_PAIRED", most)
    r = random.Random(distance * most)
    fps = {0, 2**64 - 1}
    for _ in range(6):
        f = r.getrandbits(64)
        for _ in range(40):
            g = f
            for _ in range(r.randint(0, 3)):
                g ^= 1 << r.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), distance)
    pairs = [(e.a, e.b) for e in edges.collect()]
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= distance for a, b in pairs)
    labels = {x.node: x.label for x in connected_components(edges).collect()}
    got = [labels.get(f, f) for f in signed]
    comp = brute_components(fps, distance)
    least = {}
    for c, f in zip(comp, signed):
        least[c] = min(least.get(c, f), f)
    assert got == [least[c] for c in comp]


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 100), (7, 3)], "a long, b long")
    assert {(r.node, r.label) for r in connected_components(edges).collect()} == {(i, 0) for i in range(61)}
    assert connected_components(edges.where("false")).count() == 0


BENCH = "item_id long, text string, lang string"


def brute_hits(docs, items, window):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    out = []
    split = [(None if i is None else str(i), re.findall(pattern, lower(t))) for i, t in items if t is not None]
    for i, t in docs:
        words = re.findall(pattern, lower(t or ""))
        hit, owners = set(), set()
        for item, iw in split:
            size = min(window, len(iw))
            if not size:
                continue
            grams = {tuple(iw[p : p + size]) for p in range(len(iw) - size + 1)}
            for p in range(len(words) - size + 1):
                if tuple(words[p : p + size]) in grams:
                    hit |= set(range(p, p + size))
                    owners.add(item)
        out.append((i, len(words), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners - {None})).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontamination_matches_brute_force(spark, block_bytes):
    docs = some_docs(11)
    r = random.Random(5)
    pool = [t for _, t in docs if t]
    items = []
    for k in range(14):
        words = r.choice(pool).split()
        a = r.randrange(max(1, len(words)))
        items.append((k, " , ".join(words[a : a + r.choice([1, 3, 10, 12, 25])]).upper() if k % 2 else " ".join(words[a : a + 15])))
    items += [(90, None), (91, ""), (92, "..."), (93, items[1][1]), (None, items[2][1]), (10, items[3][1])]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], BENCH)
    got = decontaminate.report(rows(spark, docs), bench, block_bytes=block_bytes).collect()
    # str.upper turns é into É, which A-Z lower-casing leaves alone: it is another word.
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == brute_hits(docs, items, 10)
    kept = decontaminate.clean(rows(spark, docs), bench, block_bytes=block_bytes, most_sent=0 if block_bytes == 60 else 1000)
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert kept.count() == sum(not x[-1] for x in brute_hits(docs, items, 10))


def thue_morse(n, invert):
    """Words of 2**n letters, equal under any polynomial hash modulo 2**64 for n of 10 or more, and their complements."""
    return "".join("ab"[(bin(i).count("1") + invert) % 2] for i in range(2**n))


def test_decontamination_tells_equal_hashes_apart(spark):
    x, y = thue_morse(11, 0), thue_morse(11, 1)
    words = split_words(pa.array([f"{x} {y}"]), ALNUM)
    assert len(set(words.hashes(np.arange(2), np.arange(2)).tolist())) == 1
    rest = "one two three four five six seven eight nine"
    docs = [(1, f"so {x} {rest} it is"), (2, f"so {y} {rest} it is"), (3, f"{rest} {y}"), (4, f"{rest} {x}"), (5, y), (6, x)]
    for items in ([(1, f"{x} {rest}")], [(1, f"{x} {rest}"), (2, f"{rest} {y}")], [(1, x)], [(7, y), (8, f"{x} {rest}")]):
        bench = spark.createDataFrame([(i, t, "x") for i, t in items], BENCH)
        got = decontaminate.report(rows(spark, docs), bench).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=repr) == brute_hits(docs, items, 10)


def test_decontamination_of_one_word_again_and_again():
    items = [("i", "la " * 30_000), ("j", "la " * 5)]
    batch = pa.RecordBatch.from_pydict({"__text": ["la " * 50_000, "no", "la la", None], "__k0": [1, 2, 3, 4]})
    began = time.time()
    (out,) = decontaminate._hit_batches(items, 10, ["__k0"])(iter([batch]))
    assert out.to_pydict() == {"__k0": [1, 2, 3, 4], "__n_words": [50_000, 1, 2, 0], "__spots": [[0, 50_000], [], [], []], "__items": [["i", "j"], [], [], []]}
    assert time.time() - began < 30


def test_decontamination_shards_over_many_pieces(monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice("abcde") for _ in range(r.randrange(40))) for _ in range(300)]
    items = [(str(k), " ".join(r.choice("abcde") for _ in range(12))) for k in range(200)] + [("1", "a b"), (None, "e e e e e")]
    monkeypatch.setattr(decontaminate, "PIECE_BYTES", 200)
    want = brute_hits(list(enumerate(texts)), items, 5)
    for words in (1, 1000, 10**9):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", words)
        batches = [pa.RecordBatch.from_pydict({"__text": texts[a : a + 70], "__k0": list(range(a, min(300, a + 70)))}) for a in range(0, 300, 70)]
        got = [x for b in decontaminate._hit_batches(items, 5, ["__k0"])(iter(batches)) for x in b.to_pylist()]
        assert sorted(((x["__k0"], x["__n_words"], sum(x["__spots"][1::2]) - sum(x["__spots"][::2]), len(x["__items"])) for x in got), key=repr) == [w[:4] for w in want]


def test_decontamination_without_items_or_documents(spark):
    docs, bench = rows(spark, [(1, "a b c")]), spark.createDataFrame([], BENCH)
    assert [r.contaminated for r in decontaminate.report(docs, bench).collect()] == [False]
    assert decontaminate.report(docs.where("false"), bench).count() == 0


def test_longest_matches(spark):
    docs = [(i, t) for i, t in some_docs(3, 20) if i is not None and i < 50]
    items = [(1, " ".join((docs[4][1] or "").split()[2:30]) + " unseen word"), (2, "nothing of this")]
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], BENCH)
    got = {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in decontaminate.longest_matches(rows(spark, docs), bench, least=1).collect()}
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    texts = {i: re.findall(pattern, lower(t)) for i, t in docs}
    grams = {tuple(w[p : p + 2]) for t in items for w in [re.findall(pattern, lower(t[1]))] for p in range(len(w) - 1)}
    for item, text in items:
        words = re.findall(pattern, lower(text))
        for p in range(len(words)):
            best = 0
            for t in texts.values():
                for q in range(len(t)):
                    k = 0
                    while p + k < len(words) and q + k < len(t) and words[p + k] == t[q + k]:
                        k += 1
                    best = max(best, k)
            if best >= 2:
                n, doc, at = got[str(item), p]
                assert n == best and texts[doc][at : at + n] == words[p : p + n]
            else:
                assert got.get((str(item), p), (0,))[0] <= best
    assert grams and F is not None
