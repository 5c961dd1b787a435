"""Calls of a language model from tasks: bounded concurrency, retries, errors kept as rows; runs of external trainers."""

from __future__ import annotations

import asyncio
import json
import time
from collections.abc import Awaitable, Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from purselight.functions import numbers

Ask = Callable[[list[dict]], Awaitable[str]]


class Transient(Exception):
    """An error after which a call is worth repeating (timeout, rate limit, lost connection)."""


async def ask_with_retry(ask: Ask, messages: list[dict], tries: int, pause: float) -> tuple[str, str | None]:
    """(answer, None) or ("", error). Pauses double after each transient error; other errors end the attempts."""
    for k in range(tries):
        try:
            return await ask(messages), None
        except Transient as error:
            if k + 1 == tries:
                return "", f"{type(error).__name__}: {error}"[:1200]
            await asyncio.sleep(pause * 2**k)
        except Exception as error:  # noqa: BLE001  a failed call must become a row, not a failed task
            return "", f"{type(error).__name__}: {error}"[:1200]
    return "", "no attempt was made"


def complete(rows: DataFrame, client: Callable[[], Ask], concurrent: int = 16, partitions: int = 4, tries: int = 3, pause: float = 2.0, raise_on_error: bool = False) -> DataFrame:
    """rows with explanation, execution_time and error of sending column messages to the client, made once in each task.

    At most `concurrent` calls are under way over all partitions, of which there are no more than that. A call that
    fails for good gives a row with its error; with raise_on_error it fails the job.
    """
    partitions = max(1, min(partitions, concurrent))
    each = max(1, concurrent // partitions)
    columns = rows.columns
    packed = rows.repartition(partitions).select(*columns, F.to_json("messages").alias("_messages"))
    extra = "explanation string, execution_time double, error string"
    passed = [c for c in columns if c != "messages"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in passed)

    def f(batches):
        ask = client()

        async def all_of(prompts: list[str]) -> list[tuple]:
            gate = asyncio.Semaphore(each)

            async def one(prompt: str) -> tuple:
                async with gate:
                    start = time.monotonic()
                    answer, error = await ask_with_retry(ask, json.loads(prompt), tries, pause)
                    if error is not None and raise_on_error:
                        raise RuntimeError(error)
                    return answer, time.monotonic() - start, error

            return await asyncio.gather(*(one(p) for p in prompts))

        for batch in batches:
            got = asyncio.run(all_of(batch["_messages"].tolist()))
            out = batch[passed].copy()
            out["explanation"], out["execution_time"], out["error"] = [g[0] for g in got], [g[1] for g in got], pd.Series([g[2] for g in got], index=out.index, dtype=object)
            yield out

    return packed.mapInPandas(f, f"{schema}, {extra}")


def stub_client() -> Ask:
    """A deterministic stand-in for a language model."""

    async def ask(messages: list[dict]) -> str:
        n = sum(len(m["content"]) for m in messages)
        return f'Много операций. ["Клиент часто платит картой", "клиент редко снимает наличные {n % 3}"] \\boxed{{{"отток" if n % 2 else "активный клиент"}}}'

    return ask


def classify(texts: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 16) -> DataFrame:
    """id, scores (softmax of the logits), p (the first largest), from a classifier made once in each task. texts: id, text."""

    def f(batches):
        logits = model()
        for rows in batches:
            for a in range(0, len(rows), batch):
                part = rows.iloc[a : a + batch]
                yield pd.DataFrame({"id": part.id, "logits": [x.tolist() for x in np.asarray(logits(part.text.tolist()), float)]})

    out = texts.select("id", "text").mapInPandas(f, "id long, logits array<double>")
    return out.select("id", numbers.softmax(F.col("logits")).alias("scores"), numbers.argmax(F.col("logits")).alias("p"))


def run_all(runs: list[dict], train: Callable[[dict], dict]) -> list[dict]:
    """Train each run in turn; a failure becomes the run's error and does not stop the others."""
    out = []
    for run in runs:
        start = time.monotonic()
        try:
            out.append({**run, "metrics": train(run), "error": None})
        except Exception as error:  # noqa: BLE001
            out.append({**run, "metrics": None, "error": f"{type(error).__name__}: {error}"})
        out[-1]["minutes"] = round((time.monotonic() - start) / 60, 2)
    return out
