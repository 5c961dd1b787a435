import asyncio
import json
import os

import pytest
from pyspark.sql import functions as F

from purselight import schema
from purselight.functions import text
from purselight.operators import claims, hooks, metrics
from purselight.sources import files, sinks
from purselight.streaming import incremental


def test_csv_by_name(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_text("cid,when,amount,mcc,target\n1,2024-01-01 10:00:00,5.5,еда,1\n2,bad,x,,0\n", encoding="utf-8")
    # Another order, eight columns, one that is not known, quotes and a line end inside quotes.
    other = tmp_path / "val.csv"
    other.write_text('target,mcc_desc,mcc,note,currency_name,when,trx_cat_ru,amount,cid\n1.0,d,"a ""b"", c\nd",n,Рубль,2024-02-01 10:00:00,снятие,-2,7\n,,,,,,,,8\n', encoding="utf-8")
    settings = schema.Settings(columns={"customer_id": "cid", "datetime": "when", "category": "mcc", "label": "target"}, splits={"train": str(path), "val": str(other)})
    df = files.read_splits(spark, settings)
    rows = {(r.split, r.customer_id): r for r in df.collect()}
    assert len(rows) == 4 and rows[("train", 2)].tr_datetime is None and rows[("train", 2)].amount == 0.0 and rows[("train", 1)].mcc_code_desc == "еда"
    r = rows[("val", 7)]
    assert (r.label, r.amount, r.mcc_code_desc, r.currency_name, r.trx_cat_ru, r.mcc_desc, r.tr_datetime.month) == (1, -2.0, 'a "b", c\nd', "Рубль", "снятие", "d", 2)
    assert rows[("val", 8)].label == -1 and rows[("train", 1)].currency_name is None and "note" not in df.columns
    with pytest.raises(ValueError, match="missing columns"):
        files.read_transactions(spark, str(path))
    sinks.write_csv(df, str(tmp_path / "out"), ["customer_id", "tr_datetime"])
    again = files.read_csv(spark, str(tmp_path / "out"))
    assert sorted((r.customer_id, r.mcc_code_desc) for r in again.collect()) == sorted((str(r.customer_id), r.mcc_code_desc) for r in df.collect())
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert [r.customer_id for p in parts for r in files.read_csv(spark, str(p)).collect()] == ["1", "2", "7", "8"]


def test_csv_headers_must_agree(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.csv").write_text("a,b\n1,2\n")
    (tmp_path / "x/b.csv").write_text("b,a\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, str(tmp_path / "x")).collect()


def test_json_lines(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"customer_id": 1, "sample_id": 1, "explanation": "б"}\n\n{"customer_id": 1, "sample_id": 0, "explanation": "а"}\n', encoding="utf-8")
    row = files.read_jsonl_grouped(spark, str(path), schema.EXPLANATIONS).first()
    assert [r.explanation for r in row.rows] == ["а", "б"]
    sinks.write_jsonl(files.read_jsonl(spark, str(path), schema.EXPLANATIONS), str(tmp_path / "out"))
    text_out = "".join(p.read_text(encoding="utf-8") for p in (tmp_path / "out").glob("part-*"))
    assert '"explanation":"б"' in text_out and '"error":null' in text_out


def test_settings_and_documents(spark, tmp_path, monkeypatch):
    path = tmp_path / "c.yaml"
    path.write_text("dataset:\n  name: age\n  label_names: {0: a, 1: b}\nllm: {x: 1}\n", encoding="utf-8")
    settings = files.load_settings(str(path))
    assert settings.label_names == {"0": "a", "1": "b"} and settings.num_labels == 2 and settings.options == {"llm": {"x": 1}}
    monkeypatch.setenv("KEY_OF_TEST", "v")
    assert files.expand_env("${KEY_OF_TEST}") == "v"
    with pytest.raises(FileNotFoundError):
        files.load_template(str(tmp_path), "none.txt")
    out = str(tmp_path / "m.json")
    sinks.write_document({"val": 1}, out)
    assert sinks.merge_document({"test": 2}, out) == {"val": 1, "test": 2}
    with open(out, encoding="utf-8") as f:
        assert json.load(f) == {"val": 1, "test": 2}
    df = spark.createDataFrame([("a", 0.5), ("b", None)], "split string, accuracy double")
    assert sinks.markdown(df, ["split"]).splitlines()[2:] == ["| a | 0.5 |", "| b |  |"]
    assert sinks.markdown(df.limit(0), ["split"]) == "No metrics found.\n"
    assert files.split_path("a/b.jsonl", "val") == "a/b_val.jsonl" and files.split_path("a/b", None) == "a/b"


def test_feature_tables(spark, tmp_path):
    base = str(tmp_path)
    spark.range(3).selectExpr("id as customer_id").write.parquet(f"{base}/cot_features_train.parquet")
    sinks.write_parquet(spark.range(4).selectExpr("id", "if(id < 1, 'val', 'test') as split"), f"{base}/all.parquet")
    assert files.read_features(spark, base, "train").count() == 3
    assert files.read_features(spark, base, "val", f"{base}/all.parquet").count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_features(spark, base, "val")

    def broken():
        raise KeyError("first")

    assert files.read_with_fallback(broken, lambda: 5) == 5
    with pytest.raises(KeyError, match="first"):
        files.read_with_fallback(broken, broken)


def test_language_model_hook(spark):
    clients = spark.createDataFrame([(1, 0, "p"), (2, 1, "pq")], "customer_id long, label int, client_stats string")
    rows = claims.dialogues(claims.prompts(clients, "{CLIENT_STATS}", "s", "", ""), 2)
    got = hooks.complete(rows, hooks.stub_client, partitions=2).withColumn("predicted", text.label_of(text.boxed(F.col("explanation")))).withColumn("claims", text.claims_of(F.col("explanation")))
    out = {(r.customer_id, r.sample_id): r for r in got.collect()}
    assert len(out) == 4 and out[(1, 0)].predicted in (0, 1) and len(out[(1, 0)].claims) == 2 and out[(1, 0)].error is None


def test_classifier_hook(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "abc")], "id long, text string")
    got = {r.id: r for r in hooks.classify(rows, lambda: lambda texts: [[2.0, len(t)] for t in texts], 1).collect()}
    assert got[1].p == 0 and got[2].p == 1 and sum(got[2].scores) == pytest.approx(1)


def test_adapter_results(tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run/metrics.json").write_text('{"val_accuracy": 0.7, "test": {"eval_accuracy": 0.6, "n": 4}}', encoding="utf-8")
    rows = metrics.adapter_rows(str(tmp_path))
    assert [(r[:4], r[-2:]) for r in rows] == [(("adapter", "run", "val", 0.7), (None, 1.0)), (("adapter", "run", "test", 0.6), (4, 1.0))]
    (tmp_path / "other").mkdir()
    (tmp_path / "other/summary.json").write_text('[{"name": "r", "metrics": {"val_mcc": 0.1}}, {"name": "s", "metrics": null}]', encoding="utf-8")
    assert [r[1] for r in metrics.adapter_rows(str(tmp_path / "other"))] == ["r"]


def test_retries():
    calls = []

    async def flaky(messages):
        calls.append(1)
        if len(calls) < 3:
            raise hooks.Transient("busy")
        return "ok"

    async def broken(messages):
        raise RuntimeError("no")

    assert asyncio.run(hooks.ask_with_retry(flaky, [], 3, 0.001)) == ("ok", None)
    assert asyncio.run(hooks.ask_with_retry(broken, [], 3, 0.001)) == ("", "RuntimeError: no")
    runs = hooks.run_all([{"name": "a"}, {"name": "b"}], lambda r: {"x": 1} if r["name"] == "a" else 1 / 0)
    assert runs[0]["metrics"] == {"x": 1} and runs[1]["error"].startswith("ZeroDivisionError")


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.sql("select id % 3 as customer_id, timestamp'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) as tr_datetime, cast(id - 5 as double) as amount from range(12)")
    rows.repartition(3).write.parquet(source)
    stream = incremental.read_stream(spark, source, rows.schema)
    incremental.write_profiles(incremental.running_profiles(stream), out, str(tmp_path / "check")).awaitTermination(120)
    got = {r.customer_id: (r.n_txn, r.total_income, r.total_expense) for r in spark.read.parquet(out).collect()}
    want = {c: (4, float(sum(max(i - 5, 0) for i in range(c, 12, 3))), float(sum(min(i - 5, 0) for i in range(c, 12, 3)))) for c in range(3)}
    assert got == want
    assert incremental.daily_activity(rows).count() == 3 and os.path.isdir(out)
