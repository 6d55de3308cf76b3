"""Deterministic annotators, so that the jobs around the model can be compared with SQL."""

from __future__ import annotations

import json

import pandas as pd


def summary_rule(batch: pd.DataFrame) -> list[str | None]:
    """Length of the question as the summary; questions of a length divisible by 7 fail."""
    lengths = batch["user_prompt"].str.len()
    return [
        None if n % 7 == 0 else f"DATE: day {n % 5}\nsummary: asked: {n}" if n % 2 else f"{n}"
        for n in lengths
    ]


def insight_rule(batch: pd.DataFrame) -> list[str | None]:
    """By the length of the question: no relation, missing keys, no answer or a full object."""
    answers = []
    for prompt in batch["user_prompt"]:
        n = len(prompt)
        full = {
            "related_reason_simple": f"reason {n % 3}", "related_reason_short": prompt[:9],
            "polarity": "positive" if n % 2 else "negative", "actual_trend": "up",
            "quote_frag": f"\"{n}\"\n",
        }
        kind = n % 5
        if kind == 0:
            answers.append(json.dumps({"related_reason_simple": "no relation"}))
        elif kind == 1:
            answers.append(json.dumps({"related_reason_short": None}))
        elif kind == 2:
            answers.append(None)
        else:
            answers.append(json.dumps(full))
    return answers


def brittle_model(system_prompt: str, user_prompt: str) -> str:
    """Fails where the number that ends the question is divisible by 7."""
    number = int(user_prompt.split()[-1])
    if number % 7 == 0:
        raise RuntimeError("no answer")
    return f"{system_prompt} {user_prompt}"


def brittle_batches(batch: pd.DataFrame) -> list[str | None]:
    return [brittle_model(*row) for row in zip(batch["system_prompt"], batch["user_prompt"])]
