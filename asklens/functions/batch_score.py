"""The one Python hook: a user function applied to a prompt table in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


def batch_score(prompts: DataFrame, make_fn: Callable[[], Callable[[list[str]], list[str]]],
                batch_size: int = 16, key: str = "question_id", col: str = "prompt",
                done: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """(key, response, error): one row per prompt.

    ``make_fn`` is called once per task and returns a function from a list of at most
    ``batch_size`` prompts to as many responses; that is where a model is loaded. When a batch
    fails, its prompts are tried one by one and only those that fail carry ``error``. Rows whose
    key is in ``done`` (an earlier, written result) are skipped, so a retry repeats no work.
    Prompts are small and scoring is slow, so ``partitions`` spreads them over that many tasks.
    """
    todo = prompts.select(key, col)
    if done is not None:
        todo = todo.join(done.select(key), key, "left_anti")
    if partitions:
        todo = todo.repartition(partitions)

    def score_one(fn, text: str) -> tuple[str | None, str | None]:
        try:
            return fn([text])[0], None
        except Exception as problem:
            return None, str(problem)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = make_fn()
        for batch in batches:
            for start in range(0, len(batch), batch_size):
                part = batch.iloc[start:start + batch_size]
                texts = part[col].tolist()
                try:
                    answers = list(fn(texts))
                    if len(answers) != len(texts):
                        raise ValueError(f"{len(answers)} responses for {len(texts)} prompts")
                    results = [(a, None) for a in answers]
                except Exception:
                    results = [score_one(fn, t) for t in texts]
                yield pd.DataFrame({
                    key: part[key].to_numpy(), "response": [r[0] for r in results], "error": [r[1] for r in results]})

    kind = prompts.schema[key].dataType.simpleString()
    return todo.mapInPandas(rows, f"{key} {kind}, response string, error string")
