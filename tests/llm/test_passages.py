import random

import numpy as np

from purselight.llm import compact_windows as cw


def test_compact_windows_group_all_subsequences():
    rng = np.random.default_rng(0)
    for n in (0, 5, 12, 30):
        v = rng.permutation(n)
        rows = cw.compact_windows(v, 4)
        for i in range(n):
            for j in range(i + 3, n):
                inside = [(a, c, b) for a, c, b in rows if a <= i <= c <= j <= b]
                assert len(inside) == 1 and inside[0][1] == i + v[i : j + 1].argmin()


def test_partners():
    key, doc = np.array([1, 1, 1, 1, 2, 2, 3]), np.array([5, 5, 6, 7, 7, 7, 9])
    first, previous = cw.partners(doc, key)
    assert first.tolist() == [0, 0, 0, 0, 4, 4, 6] and previous.tolist() == [-1, -1, 1, 2, -1, -1, -1]


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_planted_passages(spark):
    rng = random.Random(3)
    docs, planted = [], {}
    for p in range(30):
        passage = words(rng, rng.randint(51, 130))
        for _ in range(rng.randint(2, 6)):
            copy = list(passage)
            for _ in range(rng.choice([0, 0, 0, 1])):
                copy[rng.randrange(1, len(copy) - 1)] = words(rng, 1)[0]
            head = words(rng, rng.randint(0, 150))
            planted[len(docs)] = (p, len(head), len(copy))
            docs.append(" ".join(w.upper() if rng.random() < 0.2 else w for w in head + copy + words(rng, rng.randint(0, 150))))
    clean = range(len(docs), len(docs) + 60)
    docs += [" ".join(words(rng, rng.randint(0, 400)) + ["the same short ending of all of these"]) for _ in clean]
    rows = [(i, t, 1) for i, t in enumerate(docs)] + [(900, None, 1), (901, "", 1), (902, "x " * 3000, 1), (903, "x " * 2000, 1), (3, docs[3], 1), (None, docs[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_word int")
    got = cw.near_passages(df).collect()
    groups = {}
    for r in got:
        ids = {r.doc_id, r.other_id}
        assert len(ids) == 2 and r.similarity >= 0.75 and r.end_word - r.start_word >= 50 and r.other_end - r.other_start >= 50
        if None in ids or ids == {902, 903}:
            continue
        (pa, sa, na), (pb, *_) = planted[r.doc_id], planted[r.other_id]
        assert pa == pb and sa - 6 <= r.start_word and r.end_word <= sa + na + 6
        groups.setdefault(pa, set()).update(ids)
    for p in range(30):
        assert groups[p] == {d for d, x in planted.items() if x[0] == p}
    assert {902, 903} in [{r.doc_id, r.other_id} for r in got] and any(None in (r.doc_id, r.other_id) for r in got)
    assert len({(r.doc_id, r.start_word, r.other_id, r.other_start) for r in got}) == len(got)


def test_brute_force_on_small_texts(spark):
    """Equal passages of 12 words: all pairs of documents that share one lie in one class, and no others."""
    rng = random.Random(8)
    vocabulary = words(rng, 60)
    docs = []
    for _ in range(60):
        body = [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
        if docs and rng.random() < 0.5:
            other = rng.choice(docs)
            a = rng.randint(0, max(0, len(other) - 14))
            body[5:5] = other[a : a + rng.randint(9, 16)]
        docs.append(body)
    parent = list(range(len(docs)))
    runs = [{tuple(d[i : i + 12]) for i in range(len(d) - 11)} for d in docs]

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if runs[i] & runs[j]:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string")
    got = cw.near_passages(df, min_words=12, percent=100).collect()
    want = {i: root(i) for i in range(len(docs)) if sum(root(i) == root(j) for j in range(len(docs))) > 1}
    classes = {}
    for r in got:
        classes |= {r.doc_id: r.class_id, r.other_id: r.class_id}
        assert runs[r.doc_id] & runs[r.other_id]
    assert classes == want


def test_empty(spark):
    assert cw.near_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_copies_that_leave_out_a_paragraph():
    """Passages side by side in one text and apart in the other are found, whichever text comes first."""
    rng = random.Random(5)
    for size in (55, 60, 80, 100):
        for gap in (0, 10, 35, 50, 70, 88):
            p, q, r, lost, also = (words(rng, n) for n in (size, size, size, gap, gap))
            one, other = (cw.tokens(" ".join(x).encode()) for x in (p + q + r, words(rng, 20) + p + lost + q + also + r))
            for a, b, swap in ((one, other, False), (other, one, True)):
                got = cw.passages(a, b, 46, 75)
                covered = np.zeros(len(one), bool)
                for x0, x1, y0, y1, s in got:
                    u, v = np.unique(a[x0:x1]), np.unique(b[y0:y1])
                    assert s >= 0.75 and abs(s - len(np.intersect1d(u, v)) / len(np.union1d(u, v))) < 1e-9 and min(x1 - x0, y1 - y0) >= 46
                    covered[slice(y0, y1) if swap else slice(x0, x1)] = True
                for k in range(3):
                    assert covered[k * size : (k + 1) * size - 4].all(), (size, gap, swap, k)


def test_passages_around_a_frequent_line(spark):
    """Passages that share their only signatures with many strangers, which stand between them in key order, are found."""
    rng = random.Random(9)
    line = words(rng, 40)
    seeds = cw.mix(np.arange(1, 8, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    low = [int(cw.mix(cw.tokens(" ".join(line).encode()) ^ s).min()) for s in seeds]

    def around(n):
        """Text of n words on both sides of the line whose shingles all have greater hashes than the line's."""
        while True:
            x = words(rng, n) + line + words(rng, n)
            t = cw.tokens(" ".join(x).encode())
            if sum(int(cw.mix(t ^ s).min()) == v for s, v in zip(seeds, low, strict=True)) == 7:
                return x

    passages = [around(12) for _ in range(6)]
    docs, copies = [], {}
    for k in range(48):
        p = k // 2 % 6 if k % 2 else None
        docs.append(" ".join(words(rng, 30) + (around(12) if p is None else passages[p]) + words(rng, 30)))
        if p is not None:
            copies.setdefault(p, set()).add(k)
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    groups = {}
    for r in cw.near_passages(df).collect():
        groups.setdefault(r.class_id, set()).update((r.doc_id, r.other_id))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, copies.values()))


def test_every_link_among_competing_documents(spark):
    """Two documents hold a passage of 50 words; documents between and before them hold its halves only."""
    rng = random.Random(11)
    rows, pairs = [], []
    for n in (0, 1, 2, 4, 8):
        for _ in range(6):
            passage = words(rng, 50)

            def decoys():
                half = rng.choice([passage[:25], passage[25:], passage[10:40]])
                return words(rng, 60) + half + words(rng, 60)

            group = [decoys() for _ in range(n)] + [words(rng, 40) + passage + words(rng, 40)] + [decoys() for _ in range(n)] + [words(rng, 70) + passage + words(rng, 10)]
            pairs.append((len(rows) + n, len(rows) + 2 * n + 1))
            rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate(group)]
    got = cw.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = {r.doc_id: r.class_id for r in got} | {r.other_id: r.class_id for r in got}
    assert all(found.get(a) == found.get(b) == a for a, b in pairs)
    assert set(found) == {x for p in pairs for x in p}


def test_links_at_the_similarity_of_the_query(spark):
    """Edited copies among competing documents that share a line; brute force over all pairs of passages says which are links."""
    rng = random.Random(12)
    line = words(rng, 20)
    rows, want = [], set()
    for p in range(40):
        passage = words(rng, 60)
        copy = list(passage)
        at = rng.randrange(6, 50)
        copy[at : at + rng.randint(1, 2)] = words(rng, 1)
        a, b = len(rows), len(rows) + 1
        for w in (passage, copy):
            rows.append((len(rows), " ".join(words(rng, 60) + w + words(rng, 30) + line + words(rng, 40))))
        s, t = (set(cw.tokens(" ".join(w).encode()).tolist()) for w in (passage, copy))
        assert len(s & t) >= 0.75 * len(s | t)
        want.add((b, a))
    rows += [(len(rows) + i, " ".join(words(rng, 50) + line + words(rng, 50))) for i in range(60)]
    rng.shuffle(rows)
    got = {(r.doc_id, r.other_id) for r in cw.near_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got <= want and len(got) >= 39


def test_may_hold_lets_all_passages_through():
    rng = np.random.default_rng(0)
    for _ in range(3000):
        n = int(rng.integers(1, 25))
        at = int(rng.integers(0, n))
        hit = np.zeros((1, 25), bool)
        hit[0, :n] = rng.random(n) < rng.choice([0.5, 0.7, 0.9])
        ends = [(x, y) for x in range(max(0, at - 12), at + 1) for y in range(at, min(n, at + 13)) if y - x >= 5]
        if any(hit[0, x : y + 1].sum() >= max(6, 0.75 * (y - x + 1)) for x, y in ends):
            assert cw.may_hold(hit, np.array([n]), np.array([at]), 6, 75)[0]


def test_trees_of_many_texts():
    rng = np.random.default_rng(1)
    for _ in range(100):
        start = np.r_[0, np.cumsum(rng.integers(0, 50, rng.integers(1, 6)))]
        v, width = rng.integers(0, rng.choice([3, 10, 10**6]), start[-1]), int(rng.integers(1, 9))
        want, todo = [], list(zip(start[:-1].tolist(), (start[1:] - 1).tolist(), strict=True))
        while todo:
            a, b = todo.pop()
            if b - a + 1 >= width:
                c = a + int(v[a : b + 1].argmin())
                want.append((a, c, b))
                todo += [(a, c - 1), (c + 1, b)]
        assert sorted(map(tuple, cw.compact_windows(v, width, start).tolist())) == sorted(want)


def plain_cut(hit, misses, longest):
    """The first longest stretch with a sum of 0 or more, trimmed to hits, or the first of greatest sum; hits count 1, others -misses."""
    total = np.r_[0, np.cumsum(np.where(hit, 1, -misses))]
    best = (0, 0)
    for end in range(1, len(total)):
        if longest:
            begin = next(k for k in range(end + 1) if total[k] <= total[end])
            if end - begin > best[1] - best[0]:
                best = begin, end
        else:
            begin = int(total[: end + 1].argmin())
            if total[end] - total[begin] > total[best[1]] - total[best[0]]:
                best = begin, end
    at = [k for k in range(*best) if hit[k]]
    return (at[0], at[-1] + 1) if at else (0, 0)


def plain_search(a, b, width, percent, todo):
    out, known = [], set(b.tolist())
    hits = np.array([x in known for x in a.tolist()], bool)
    while todo:
        lo, hi = todo.pop()
        if hi - lo < width or hits[lo:hi].sum() < width * percent // 100:
            continue
        split = None
        for cut in ((3, True), (6, True), (3, False)):
            x0, x1 = (lo + v for v in plain_cut(hits[lo:hi], *cut))
            s = set(a[x0:x1].tolist())
            y0, y1 = plain_cut(np.array([x in s for x in b.tolist()], bool), *cut) if x1 - x0 >= width else (0, 0)
            if y1 - y0 < width:
                continue
            t = set(b[y0:y1].tolist())
            if 100 * len(s & t) >= percent * len(s | t):
                out.append((x0, x1, y0, y1, len(s & t) / len(s | t)))
                split = None
                break
            u0, u1 = (x0 + v for v in plain_cut(np.array([x in t for x in a[x0:x1].tolist()], bool), *cut))
            split = split or ((x0, u0, u1, x1) if 0 < u1 - u0 < x1 - x0 else None)
        if split:
            x0, u0, u1, x1 = split
            todo += [(x0, u0), (u0, u1), (u1, x1)]
        todo += [(lo, x0), (x1, hi)] if x1 > x0 else []
    return out


def test_pairs_searched_together_as_one_by_one():
    """Pairs of very different lengths in shared blocks, with edits, gaps, swapped parts and repeats, against a plain search of each."""
    rng, pairs = np.random.default_rng(4), [(np.arange(500, dtype=np.uint32), np.arange(490, dtype=np.uint32)), (np.arange(0, dtype=np.uint32),) * 2]
    for _ in range(400):
        most = int(rng.choice([3, 8, 30, 1000]))
        base = rng.integers(0, most, rng.integers(1, 90)).astype(np.uint32)

        def edited():
            x = base.copy()
            x[rng.random(len(x)) < rng.choice([0, 0.05, 0.2])] = rng.integers(0, most)
            k = rng.integers(0, len(x) + 1)
            x = np.r_[x[:k], rng.integers(0, most, rng.integers(0, 40)), x[k:]] if rng.random() < 0.5 else x
            return (np.r_[x[k:], x[:k]] if rng.random() < 0.3 else x).astype(np.uint32)

        pairs.append((edited(), edited()))
    found = 0
    for width, percent, block in ((6, 75, 300), (12, 100, 1 << 18), (10, 60, 5000), (1, 75, 1 << 12)):
        got = [set() for _ in pairs]
        for k, *x in zip(*(v.tolist() for v in cw.all_passages(pairs, width, percent, block)), strict=True):
            got[k].add(tuple(x))
        for (a, b), have in zip(pairs, got, strict=True):
            if min(len(a), len(b)) >= width:
                want = [(0, len(a), 0, len(b), 1.0)] if len(a) == len(b) and (a == b).all() else plain_search(a, b, width, percent, [(0, len(a))])
                free, at = [], 0
                for y0, y1 in sorted(x[2:4] for x in want):
                    free, at = [*free, (at, y0)], max(at, y1)
                want += [(x0, x1, y0, y1, s) for y0, y1, x0, x1, s in plain_search(b, a, width, percent, [*free, (at, len(b))])]
                assert have == set(want)
                found += len(want)
            else:
                assert not have
    assert found > 1000


def test_windows_are_compared_many_at_a_time(monkeypatch):
    """200 edited copies of one window in documents of two classes: all pairs across, by a few calls of the density test."""
    rng, calls, plain = np.random.default_rng(6), [], cw.may_hold
    base = rng.integers(0, 1 << 32, 100).astype(np.uint32)
    windows = [np.where(np.arange(100) == k % 100, np.uint32(k), base) for k in range(200)]
    monkeypatch.setattr(cw, "may_hold", lambda *x: calls.append(1) or plain(*x))
    got = {(int(min(i, j)), int(max(i, j))) for x in cw.alike(np.arange(200) % 2, np.full(200, 50), windows, 46, 75) for i, j in zip(*x, strict=True)}
    assert got == {(i, j) for j in range(200) for i in range(j) if (i + j) % 2}
    assert len(calls) < 150


def test_poorest():
    rng = np.random.default_rng(2)
    for _ in range(200):
        length, width = int(rng.integers(1, 30)), int(rng.integers(1, 12))
        size = rng.integers(1, length + 1, 5)
        size[0] = length
        t = np.where(np.arange(length) < size[:, None], rng.integers(0, 9, (5, length)), 99)
        at = rng.integers(0, size)
        want = [min((len(set(r[s : s + width].tolist())) for s in range(n - width + 1) if s <= c < s + width), default=1) for r, n, c in zip(t, size, at, strict=True)]
        assert cw.poorest(t, size, at, width).tolist() == want
