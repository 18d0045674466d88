"""Near copies against brute force over all pairs, and the pipeline's stage that keeps one of each group."""

import random
import re

import pytest

import corpus_pipeline
from lumenframe.llm import near_copies
from tests.llm.test_text_windows import lower


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_labels(texts):
    sets = [brute_set(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 9 * len(a & b) >= 4 * (len(a) + len(b)):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def copies(seed):
    r = random.Random(seed)
    made = lambda n: [f"w{r.randrange(5000)}" for _ in range(n)]
    line = made(30)
    out = ["", None, "One", "one", "one two", "a b c d e", "a b c d e f", "A b  c d e f"]
    for n in (6, 12, 30, 120, 400):
        for _ in range(6):
            base = made(n)
            for _ in range(6):
                text = list(base)
                for _ in range(r.randint(0, max(1, n // 25))):
                    text[r.randrange(n)] = f"x{r.randrange(10**6)}"
                out.append(" ".join(text))
            out.append(" ".join(base[: n // 2] + line))
    return out


@pytest.mark.parametrize("most,common,block", [(48, 100_000, 2048), (2, 100_000, 2048), (1, 5, 3), (2, 0, 1)])
def test_groups_match_brute_force(spark, monkeypatch, most, common, block):
    monkeypatch.setattr(near_copies, "BLOCK_SETS", block)
    monkeypatch.setattr(near_copies, "MOST_PAIRED", most)
    monkeypatch.setattr(near_copies, "MOST_COMMON", common)
    texts = copies(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    fps, groups = near_copies.groups(docs, ["id"])
    got = {r.id: r.component_id for r in fps.join(groups, "fp").collect()}
    want = brute_labels(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert len(texts) // 5 < len(set(want)) < len(texts) - 20


def test_stage_removes_a_copy_of_several_bits(spark):
    """Two documents of a similarity over 0.8 whose fingerprints differ in more than two bits; and two below 0.8."""
    base = [f"v{i}" for i in range(125)]
    near, far = list(base), list(base)
    near[40] = near[90] = "other"
    for i in range(5, 125, 12):
        far[i] = "other"
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate((base, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2]


def test_stage_keeps_one_row_of_each_component(spark):
    """Whole rows that repeat, rows of one id with other contents, and rows without an id."""
    far = [" ".join(f"{c}{i}" for i in range(40)) for c in "abc"]
    rows = [(1, far[0], "en", "s", 1)] * 3 + [(1, far[1], "en", "s", 1), (2, far[0], "de", "t", 2), (1, far[0], "fr", "s", 1), (None, far[2], None, None, None), (None, far[2], None, None, None), (7, far[2], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for most in (corpus_pipeline.MOST_SENT, 0):
        got = corpus_pipeline.near_duplicates(spark, docs, "", most_sent=most).collect()
        assert sorted((r.doc_id, r.text) for r in got) == [(1, far[0]), (1, far[1]), (7, far[2])]


def test_links_of_near_copies_grow_with_the_texts(spark, monkeypatch):
    """One large group of texts around the similarity, so that a star leaves many and most pairs of what it leaves are links: what the
    components are made from has some links for each text, not one for each pair, and the components are those of all pairs."""
    r = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(240):
        text = list(base)
        for j in r.sample(range(300), r.choice((3, 5))):
            text[j] = f"x{i}y{j}"
        texts.append(" ".join(text))
    sizes, connect = [], near_copies.connected_components

    def counted(edges, *names):
        sizes.append(edges.count())
        return connect(edges, *names)

    monkeypatch.setattr(near_copies, "connected_components", counted)
    for block in (2048, 50):
        monkeypatch.setattr(near_copies, "BLOCK_SETS", block)
        docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
        fps, groups = near_copies.groups(docs, ["id"])
        got = {x.id: x.component_id for x in fps.join(groups, "fp").collect()}
        assert [got[i] for i in range(len(texts))] == brute_labels(texts)
    assert max(sizes) <= 2 * len(texts), sizes
