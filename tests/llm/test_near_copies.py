"""The pipeline's near-dedup stage against brute force on five-word Jaccard similarities."""

import random

import corpus_pipeline
from pulseloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n, r):
    return [f"w{r.randrange(3000)}" for _ in range(n)]


def edited(words, at, r):
    out = list(words)
    for k in at:
        out[k] = f"new{r.randrange(10**6)}"
    return out


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))


def brute(texts):
    label = {i: i for i in texts}
    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and similarity(texts[a], texts[b]) >= 0.8 and label[a] != label[b]:
                lo, hi = sorted((label[a], label[b]))
                label = {i: lo if x == hi else x for i, x in label.items()}
    return label


def fixture():
    r = random.Random(5)
    base = [prose(n, r) for n in (60, 80, 120, 200, 400, 1500)]
    words = [*base, *(prose(100, r) for _ in range(20))]
    for b in base:
        n = len(b) - 4
        near = max(1, int(n * 0.09 / 5))  # each edit takes five shingles off: these stay over 0.8
        words += [edited(b, r.sample(range(10, len(b) - 10), near), r), edited(b, range(0, len(b), 7), r), b + prose(2, r)]
    chain = prose(300, r)
    for _ in range(5):  # links in a chain, whose ends are apart
        words.append(chain)
        chain = edited(chain, [r.randrange(len(chain)) for _ in range(4)], r)
    texts = [" ".join(w) for w in words]
    texts += [None, "", " ", "a", "A\n", "one two three", texts[0].upper(), "  " + texts[3].replace(" ", "\n")]
    r.shuffle(texts)
    return dict(enumerate(texts))


def test_near_dedup_finds_what_brute_force_finds(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK_BYTES", 3000)
    texts = fixture()
    want = brute(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r["first"]["key"] for r in near_copies.near_duplicates(docs).collect()}
    assert all(want[i] == want[j] for i, j in got.items())  # no text goes without a chain of true links
    assert sum(got[i] == want[i] for i in got) >= 0.97 * len(got)
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    first = stage(spark, docs.union(docs), "")
    assert first.columns == docs.columns and sorted(r.doc_id for r in first.collect()) == sorted(set(got.values()))


def test_one_row_of_each_group_stays_whatever_the_ids(spark):
    r = random.Random(8)
    a, b = " ".join(prose(90, r)), " ".join(prose(90, r))
    rows = [(None, a, "x", 1), (None, a, "y", 2), (1, a + " more", "x", 3), (1, b, "x", 4), (2, b, "x", 5), (None, "other", "x", 6), (3, None, "x", 7), (None, "", "x", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string, first int")
    got = [(r.doc_id, r.text) for r in near_copies.keep_first(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, a), (1, b), (None, "other"), (None, "")], key=str)
