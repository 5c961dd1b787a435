import random

import numpy as np

from purselight.llm import decontaminate as dc
from purselight.llm.common import grams, word_hashes


def slow_align(a, b):
    """Smith-Waterman by the textbook."""
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), h[i - 1][j] - dc.GAP, h[i][j - 1] - dc.GAP)
    return max(max(r) for r in h)


def test_align():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 5, rng.integers(1, 12)), rng.integers(0, 5, rng.integers(0, 20))
        assert dc.align(a, b)[0] == slow_align(a.tolist(), b.tolist())


def test_seeds_cover_every_run():
    rng = random.Random(1)
    for m in range(1, 20):
        f = [rng.randint(0, 3) for _ in range(m)]
        got = dc.seed_positions(f, 3)
        assert all(any(a <= p < a + 3 for p in got) for a in range(max(1, m - 2)))


def words(rng, n):
    return [rng.choice("abcdefgh") + rng.choice("aeiou") + rng.choice("klmnp") + rng.choice(["", "s", "t"]) for _ in range(n)]


def brute(docs, items, least, run):
    """All documents against all items, whole texts; of these, the pairs with an unchanged run of `run` words."""
    out = []
    for d, text in docs:
        h = word_hashes(dc.normalise((text or "").encode()))
        best = {}
        for i, item in items:
            w = word_hashes(dc.normalise((item or "").encode()))
            if not len(w) or not np.isin(grams(w, min(run, len(w))), grams(h, min(run, len(w)))).any():
                continue
            score = slow_align(w.tolist(), h.tolist()) / (dc.MATCH * len(w))
            if score >= least:
                best[i] = max(score, best.get(i, 0))
        out += [(d, i, s) for i, s in best.items()]
    return sorted(out, key=str)


def test_against_brute_force(spark):
    rng = random.Random(7)
    items = [(i, " ".join(words(rng, rng.randint(6, 30)))) for i in range(12)] + [(50, "two words"), (51, None), (52, ""), (3, "other text with the same id here")]
    docs = []
    for d in range(120):
        body = words(rng, rng.randint(0, 80))
        if d % 3 == 0:
            copy = rng.choice(items[:12])[1].upper().split()
            for _ in range(rng.randint(0, len(copy) // 4)):
                copy[rng.randrange(len(copy))] = rng.choice(["NEW", "new, words"])
            at = rng.randint(0, len(body))
            body[at:at] = copy
        docs.append((d, " ".join(body)))
    docs += [(200, None), (201, ""), (202, "Two\nWORDS!"), (None, items[0][1]), (0, docs[0][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (8 << 20, 150):
        got = dc.contaminated(df, bench, block_bytes=size).collect()
        scores = {}
        for r in got:
            scores.setdefault((r.doc_id, r.item_id), []).append(r.score)
        sure, all_ = ({(d, i): s for d, i, s in brute(docs, items, 0.6, run)} for run in (5, 1))
        assert set(sure) <= set(scores) <= set(all_) and len(sure) > 30
        for k, found in scores.items():
            assert abs(max(found) - all_[k]) < 1e-9
        left = dc.filter_documents(df, bench, block_bytes=size)
        assert left.columns == df.columns
        hit = {d for d, _ in scores}
        assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(d) for d, _ in docs if d not in hit)
    (row,) = [r for r in got if r.doc_id is None]
    assert (row.start_word, row.end_word, row.score) == (0, len(items[0][1].split()), 1.0)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(docs, bench).collect() == []
    assert dc.filter_documents(docs, bench).count() == 1
    full = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert dc.contaminated(docs.limit(0), full).collect() == []
    assert dc.filter_documents(docs, full).count() == 0


def test_edited_copies_without_long_runs(spark):
    """All that plain Smith-Waterman finds is found, also copies that keep no five, three or two words in a row."""
    rng = random.Random(11)
    items = [(m * 10 + k, " ".join(words(rng, m))) for m in (1, 2, 3, 4, 5, 6, 7, 9, 20, 30, 50) for k in range(2)]
    docs = [(0, items[-1][1]), (1, items[-4][1])]  # clean copies, so that unbroken n-grams have more documents than broken ones
    for _, text in items:
        for every in (1, 2, 3, 4, 5):
            for insert in (False, True):
                copy = []
                for k, w in enumerate(text.split()):
                    copy += ([w] if insert or k % every != every // 2 else []) + (words(rng, 1) if k % every == every // 2 else [])
                docs.append((len(docs), " ".join([*words(rng, rng.randint(0, 9)), *copy, *words(rng, rng.randint(0, 9))])))
        scattered = text.split()
        for _ in range(int(0.8 * len(scattered)) + 1):
            scattered.insert(rng.randint(0, len(scattered)), words(rng, 1)[0])
        docs.append((len(docs), " ".join(scattered)))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for least in (0.6, 0.9):
        got = {(r.doc_id, r.item_id): r.score for r in dc.contaminated(df, bench, least=least).collect()}
        want = {(d, i): s for d, i, s in brute(docs, items, least, 1)}
        assert got == want
    assert sum(s < 0.75 for _, _, s in brute(docs, items, 0.6, 1)) > 40


def test_shared_run():
    assert [dc.shared_run(m, 0.6) for m in (1, 2, 5, 6, 9, 59)] == [1, 1, 1, 2, 2, 2]
    assert dc.shared_run(30, 1.0) == 30 and dc.shared_run(30, 0.95) == 8
