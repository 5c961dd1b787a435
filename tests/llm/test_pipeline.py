import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from purselight.llm import bin_completion as bc
from purselight.llm import decontaminate as dc
from purselight.llm import quality_forest as qf
from purselight.llm import queries
from tests.llm import test_decontaminate, test_lines, test_near
from tests.llm.test_quality import junk


def tables(spark, folder):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(600)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.randint(12, 25))) for i in range(8)]
    shared = [say(10) for _ in range(5)]
    docs = []
    for i in range(220):
        lines = [say(rng.randint(4, 14)) for _ in range(rng.randint(5, 14))]
        if i % 9 == 0:
            lines.insert(rng.randint(0, 3), rng.choice(shared))
        if i % 23 == 1:
            lines.append(rng.choice(items)[1].upper())
        text = "\n".join(lines)
        if i % 11 == 2:
            text = junk(rng)
        elif i % 7 == 3 and docs:
            words = rng.choice(docs)[1].split()
            words[rng.randrange(len(words))] = "edited"
            text = " ".join(words)
        elif i % 13 == 5:
            text = rng.choice(docs)[1]
        docs.append((i, text, "en", "s", len(text)))
    docs += [(900, "", "en", "s", 0), (901, None, "en", None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d[0], int("###" not in d[1]), 0) for d in docs[:220:2]], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_run_against_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    docs, items = tables(spark, folder)
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    model = qf.fit(read("documents"), read("labels"))
    left = [(d, t) for d, t, *_ in docs if qf.judge(model, [(t or "").encode()])[3][0]]
    assert not any("###" in t for _, t in left) and len(left) > 100
    gone = test_lines.brute(left)
    cut = []
    for d, t in left:
        out = gone.get((d, t), set())
        text = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out)
        if not out or text.split():
            cut.append((d, text))
    assert len(cut) < len(left) and gone
    near = [r for r, m in zip(sorted(cut), sorted(test_near.brute(cut), key=lambda x: x[0]), strict=True) if m[3]]
    assert len(near) < len(cut)
    hit = {d for d, _, _ in test_decontaminate.brute(near, items, 0.6, 5)}
    clean = [(d, t) for d, t in near if d not in hit]
    assert hit
    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    want = []
    for d, t in clean:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(d, p, s, n, zlib.crc32(ids[s : s + n].tobytes())) for p, (s, n) in enumerate(bc.cut_points(len(ids), 2048))]
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    counts = {}
    for r in got:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len({r.sequence_id for r in got}) == sum(n for n, _ in bc.plan(counts, 2048))
    assert dc.MATCH == 2


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    folder = str(tmp_path)
    docs, _ = tables(spark, folder)
    schema = spark.read.parquet(f"{folder}/documents.parquet").schema
    frame = spark.createDataFrame(docs[:30], schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, folder)
        assert out.dtypes == frame.dtypes
        assert stage(spark, frame.limit(0), folder).collect() == []
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "packing"]
