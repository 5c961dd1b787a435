import random
import re
import time

from purselight.llm import license_fuzzy as lf

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def base(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    places = []
    for phrase, label in lf.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), places


def edited(rng, text, n):
    out = list(text)
    for at in rng.sample(range(len(out)), n):
        out[at] = rng.choice([out[at] + "q", "", "zw"[: rng.randint(1, 1)]])
    return "".join(out)


def test_base_against_brute_force(spark):
    rng = random.Random(2)
    bits = ["mit", "license", "MIT License", "cc", "by", "CC BY-NC", "apache", "gnu general public license", "é", "mité", "x1", "-", "\n", "MIT\tLICENSE", "\x00", "cc by cc by"]
    texts = [None, "", "...", "mit license", "mit license mit license", "İMIT License", "K cc by"] + [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "mit license", 2)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in lf.scan(docs).collect()}
    for i, t in enumerate(texts):
        n, places = base(t)
        r = got[i]
        starts = [a for a, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(places), min(starts, default=None), max(starts, default=None)), t
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""}
        assert 0 <= r.score <= 1 and (r.score == 1 or not places)
    assert lf.scan(docs).count() == len(texts) + 1
    assert lf.scan(docs.limit(0)).collect() == []


def distance(notice, line):
    """Least errors of the notice anywhere in line, by the plain table."""
    row = list(range(len(notice) + 1))
    least = row[-1]
    for c in line:
        new = [0]
        for i, x in enumerate(notice):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        least = min(least, row[-1])
    return least


def test_every_notice_within_its_errors_is_found():
    rng, scanner = random.Random(3), lf.Scanner()
    for notice in scanner.notices:
        for _ in range(60):
            n = rng.randint(0, notice.errors)
            pad = ["lorem", "ipsum", "été"] * rng.randint(0, 5)
            text = " ".join([*pad, "".join(edited(rng, notice.text, n)), *pad])
            spans = [s for s in scanner.scan(text.encode())[2] if s[0] == notice.label]
            n = distance(notice.text, f" {b' '.join(lf.normalise(text.encode())).decode()} ")
            assert n > notice.errors or any(s[3] == n and s[1] <= len(pad) + 1 and s[2] >= len(pad) for s in spans), (text, notice)


def plain(notice, line):
    """The regular expression over the whole of a text, without seeds."""
    return [(m.start(), m.end(), sum(m.fuzzy_counts)) for m in notice.patterns[-1].finditer(line)]


def test_against_the_regular_expression_without_seeds():
    rng, scanner = random.Random(4), lf.Scanner()
    found = 0
    for k in range(120):
        notice = scanner.notices[k % len(scanner.notices)]
        parts = []
        for _ in range(3):
            parts += [*["lorem", "ipsum", "été"] * rng.randint(1, 4), "".join(edited(rng, notice.text, rng.randint(0, notice.errors + 4)))]
        line = f" {b' '.join(lf.normalise(' '.join(parts).encode())).decode()} "
        want, got = plain(notice, line), notice.matches(line, 0, len(line))
        assert bool(want) == bool(got) == bool(notice.ends(line, 0, len(line)))
        for a, b, e in want:
            assert any(x < b and a < y and d <= e for x, y, d in got), (line, want, got)
        for a, b, e in got:
            assert e <= notice.errors and any(x < b and a < y for x, y, _ in want)
        spans, _ = scanner.windows(line)
        seeded = [m for w in spans.get(scanner.notices.index(notice), []) for m in notice.matches(line, w[0], min(w[1], len(line)))]
        assert [m[2] for m in seeded] == [m[2] for m in got]
        found += len(got)
    assert found > 100


def test_near_misses_cost_no_more_than_other_texts():
    start = time.perf_counter()
    n, places, spans = lf.Scanner().scan(b"this program is free software " * 34_000)  # 1 MB
    assert n == 170_000 and not places and not spans
    assert time.perf_counter() - start < 60


def test_other_texts_get_no_label():
    scanner = lf.Scanner()
    for text in ("released under the bsd license of none", "licensed under the python license version 2 0", "the license of the city", "word " * 500):
        assert scanner.scan(text.encode())[2] == []
    (span,) = scanner.scan(b"So: Permision is hereby granted, free of charge, to any person obtainin a copy of this software! End")[2]
    assert span[:4] == ("mit", 1, 16, 2)
