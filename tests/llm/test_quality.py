import random
import re
from collections import Counter

import numpy as np

from purselight.llm import quality_forest as qf

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    three = Counter(zip(words, words[1:], words[2:], strict=False))
    inside = set()
    for j in range(len(words) - 2):
        if three[tuple(words[j : j + 3])] > 1:
            inside |= {j, j + 1, j + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside)]


def texts():
    rng = random.Random(5)
    out = [None, "", " \n\t", "a", "a a a a a a", "x\ny\nx\n\n \n x", "été\x1cß a\x85b c\xa0d", "w " * 3000]
    for _ in range(80):
        out.append("".join(rng.choice(["a", "bb", "é", "#", "|", "日本"]) + rng.choice([" ", " ", "\n", "\t", "  "]) for _ in range(rng.randint(0, 120))))
    return out


def test_statistics_against_brute_force():
    for t in texts():
        assert qf.statistics((t or "").encode())[0] == brute(t), t


def clean(rng, n=80):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho tau phi chi psi".split()) + rng.choice(["", "", ",", "s", "ed"]) + rng.choice(["", "x", "y", "z"]) for _ in range(n))


def junk(rng):
    return " ".join(w + rng.choice(["###", "$$$", "%%%"]) * (rng.random() < 0.7) for w in clean(rng).split())


def test_score_and_filter(spark):
    rng = random.Random(9)
    rows = [(i, junk(rng) if i % 10 == 0 else clean(rng), "shape") for i in range(400)]
    rows += [(1000 + i, t, None) for i, t in enumerate(texts())] + [rows[3], (None, clean(rng), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i % 10 != 0), 0) for i in range(300)] + [(301, None, 1), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    model = qf.fit(docs, labels)
    got = qf.score(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, t, _ in rows:
        r, want = by[i], brute(t)
        assert [r[c] for c in qf.STATS] == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
    held = [i for i in range(300, 400)]
    assert np.mean([by[i].kept == (i % 10 != 0) for i in held if not by[i].base_failed]) > 0.98
    left = qf.filter_documents(docs, model)
    assert left.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((r.doc_id is None, r.doc_id or 0) for r in got if r.kept)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, clean(random.Random(1)))], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = qf.fit(docs, none)
    assert [(r.kept, r.anomaly) for r in qf.score(docs, model).collect()] == [(True, None)]
    assert qf.score(docs.limit(0), model).collect() == []
    assert qf.filter_documents(docs.limit(0), qf.fit(docs.limit(0), none)).collect() == []
