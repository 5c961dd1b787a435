import random
import re

import numpy as np

from purselight.llm import minhash_hamming as mh

WORD = re.compile("[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    n = min(5, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(rows):
    """(n_shingles, component, links) of rows, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)), d == least.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def corpus(rng, families, size, length=120):
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(400)]
    common = [rng.choice(vocabulary) for _ in range(60)]
    out = []
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, length))] + common * (rng.random() < 0.4)
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 6, 12])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            out.append(" ".join(w.upper() if rng.random() < 0.2 else w for w in copy))
    rng.shuffle(out)
    return out


def test_keys_find_all_pairs_within_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, (1, 48)).astype(np.uint16)
        b = a.copy()
        at = rng.choice(48, 23, replace=False)
        b[0, at] ^= np.uint16(1)
        assert set(mh.keys(a, 12, 4)[0]) & set(mh.keys(b, 12, 4)[0])


def test_against_brute_force(spark):
    rng = random.Random(11)
    texts = [*corpus(rng, 40, 12), None, "", " \n", "one", "ONE", "one two", "\x1cone", "a b c d e"]
    rows = list(enumerate(texts))
    rows += [rows[5], rows[5], (None, texts[7]), (None, "only null here now"), (None, "only null here now")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, block int, maybe string")
    got = sorted((tuple(r) for r in mh.near_duplicates(df).collect()), key=str)
    want = sorted(((d, n, c, k if d is not None else c is None) for d, n, c, k in brute(rows)), key=str)
    assert got == want
    left = mh.filter_documents(df)
    assert left.columns == df.columns
    kept = [d for d, *_, k in want if k or d is None]
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(map(str, kept))


def test_chain_through_a_large_family(spark):
    """Each copy is near its neighbours only; stars on the least class alone would lose links."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(60):
        for _ in range(2):
            words[rng.randrange(len(words))] = f"n{i}{rng.random()}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in mh.near_duplicates(df).collect()), key=str) == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert mh.near_duplicates(df).collect() == []
    assert mh.filter_documents(df).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in mh.near_duplicates(none).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
