import random
import re

from purselight.llm import line_suffix as ls

WORD = re.compile("[^\x20\x09-\x0D]+")


def brute(rows, least=8):
    """doc -> lines that lie in a later copy of any run, of any length, of `least` words."""
    docs = sorted({(d, t) for d, t in rows if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0))
    seqs = [(d, t, [(k, x) for k, x in enumerate(t.split("\n")) if WORD.search(x)]) for d, t in docs]
    seen, gone = {}, {}
    for n in range(1, max((len(s) for *_, s in seqs), default=0) + 1):
        for a, (d, t, s) in enumerate(seqs):
            for i in range(len(s) - n + 1):
                run = tuple(x for _, x in s[i : i + n])
                if sum(len(WORD.findall(x)) for x in run) < least:
                    continue
                if seen.setdefault(run, (a, i)) != (a, i):
                    gone.setdefault((d, t), set()).update(k for k, _ in s[i : i + n])
    return gone


def corpus(rng):
    lines = [" ".join(rng.choice(["ab", "cd", "ef", "é"]) for _ in range(rng.choice([1, 2, 3, 4, 5, 9, 12]))) for _ in range(40)]
    out = []
    for _ in range(120):
        body = []
        for _ in range(rng.randint(0, 6)):
            if rng.random() < 0.5:
                a = rng.randrange(36)
                body += lines[a : a + rng.randint(1, 8)]
            else:
                body += [f"u{rng.random()} " * rng.randint(1, 9), rng.choice(["", " ", "\t"])]
        out.append("\n".join(body))
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    rows = list(enumerate(corpus(rng)))
    big = "\n".join(f"line number {i} of a long text that has a copy" for i in range(300))
    rows += [(500, big), (501, big + "\nmore"), (502, "x " * 9 + "\n" + ("x " * 9 + "\n") * 20), (600, None), (601, ""), (602, "\n\n"), (None, rows[3][1]), rows[7], rows[7]]
    df = spark.createDataFrame([(d, t, "s", -5) for d, t in rows], "doc_id long, text string, d string, n_chars int").withColumnsRenamed({"d": "gone"})
    gone = brute(rows)
    got = ls.rewrite(df).collect()
    want = []
    for d, t in rows:
        cut = gone.get((d, t), set())
        text = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
        want.append((d, text, "s", len(text) if cut else -5, len(cut)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(n for *_, n in want) > 300
    left = ls.filter_documents(df)
    assert left.columns == df.columns
    assert sorted(map(tuple, left.collect()), key=str) == sorted((w[:4] for w in want if not w[4] or WORD.search(w[1])), key=str)
    runs = {(r.doc_id, r.first_line, r.last_line, r.lines) for r in ls.maximal_runs(df).collect()}
    assert (501, 0, 299, 300) in runs


def test_ranks_sort_suffixes(spark):
    rng = random.Random(2)
    rows = list(enumerate(corpus(rng)[:40]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = ls.repeated_lines(ls.line_table(df))
    ids = {(r.d, r.i): (r.b1, r.b2) for r in lines.collect()}
    for k, level in enumerate(ls.ranks(lines, 8)):
        got = {(r.d, r.i): (r.b1, r.b2, r.r) for r in level.collect()}
        prefix = {}
        for d, i in ids:
            p = tuple(ids.get((d, i + j)) for j in range(1 << k))
            if None not in p:
                prefix[(d, i)] = p
        groups = {}
        for p in prefix.values():
            groups[p] = groups.get(p, 0) + 1
        assert set(got) == {x for x, p in prefix.items() if groups[p] > 1}
        by_rank = sorted(got, key=got.get)
        assert [prefix[x] for x in by_rank] == sorted(prefix[x] for x in got)
        assert len(set(got.values())) == sum(n > 1 for n in groups.values())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert ls.rewrite(df).collect() == []
    one = spark.createDataFrame([(1, "a b c d e f g h i")], "doc_id long, text string")
    assert [tuple(r) for r in ls.rewrite(one).collect()] == [(1, "a b c d e f g h i", 0)]
