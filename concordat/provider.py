"""Calls to outside models behind one injectable provider; the default one is a deterministic stand-in."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordat.runtime import cut_lineage

#: A provider takes a model and a prompt and gives (text, input tokens, output tokens).
Provider = Callable[[str, str], tuple[str, int, int]]


def stand_in(model: str, prompt: str) -> tuple[str, int, int]:
    """An answer that depends on model and prompt only."""
    digest = hashlib.sha256(f"{model}\0{prompt}".encode()).hexdigest()
    answer = json.dumps({"answer": "ABCD"[int(digest[0], 16) % 4], "confidence": int(digest[1:3], 16) / 255})
    return answer, len(prompt) // 4, len(answer) // 4


def with_retries(provider: Provider, tries: int = 3, delay: float = 1.0, factor: float = 2.0) -> Provider:
    """The provider tried again after growing pauses; its last error goes up."""

    def call(model: str, prompt: str) -> tuple[str, int, int]:
        pause = delay
        for left in range(tries - 1, -1, -1):
            try:
                return provider(model, prompt)
            except Exception:  # noqa: BLE001
                if not left:
                    raise
                time.sleep(pause)
                pause *= factor
        raise AssertionError

    return call


def ask(requests: DataFrame, provider: Provider = stand_in, tasks: int | None = None) -> DataFrame:
    """``requests`` (request_id, model, prompt) with text, input_tokens, output_tokens and error.

    One row per call; a call that fails has a null text and its error. Answers are
    written to the checkpoint folder before anything branches on them, so no later
    step or lost task makes a call again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                try:
                    out.append((row.request_id, row.model, *provider(row.model, row.prompt or ""), None))
                except Exception as failure:  # noqa: BLE001
                    out.append((row.request_id, row.model, None, 0, 0, str(failure)[:200]))
            yield pd.DataFrame(out, columns=["request_id", "model", "text", "input_tokens", "output_tokens", "error"])

    rows = requests.select(F.col("request_id").cast("string").alias("request_id"), "model", "prompt")
    rows = rows.repartition(tasks) if tasks else rows
    schema = "request_id string, model string, text string, input_tokens long, output_tokens long, error string"
    return cut_lineage(rows.mapInPandas(run, schema))


def fan_out(questions: DataFrame, models: list[str], question_id: str, prompt: str) -> DataFrame:
    """One request per question and model."""
    return questions.select(F.col(question_id).alias("question_id"), F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), F.col(prompt).alias("prompt")).select(
        F.concat_ws("|", "question_id", "model", F.md5("prompt")).alias("request_id"), "question_id", "model", "prompt"
    )
