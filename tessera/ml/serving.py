"""Language models behind functions: a backend protocol, a deterministic stand-in, and batch inference."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import SparkSession, functions as F

#: Kinds of models and what can be done with each.
INFER = ("chatglm", "moss", "falcon", "llama", "dolly", "bark", "whisper", "m3e", "qa", "saas", "custom")
ACTIONS = {"infer": INFER, "finetune": ("chatglm", "sft", "sfft", "moss"), "merge": ("lora",), "convert": ("deepspeed",)}


class Backend(Protocol):
    def generate(self, instruction: str, params: dict) -> str: ...

    def embed(self, text: str) -> list[float]: ...

    def transcribe(self, data: str) -> str: ...


class EchoBackend:
    """Answers made from the question alone; for tests and dry runs."""

    def __init__(self, size: int = 8):
        self.size = size

    def generate(self, instruction: str, params: dict) -> str:
        return f"echo: {instruction}"

    def embed(self, text: str) -> list[float]:
        words = text.lower().split()
        out = [0.0] * self.size
        for w in words:
            out[int(hashlib.md5(w.encode()).hexdigest(), 16) % self.size] += 1.0
        return out

    def transcribe(self, data: str) -> str:
        return f"{len(data)} characters of sound"


BACKENDS: dict[str, Callable[[dict], Backend]] = {"mock": lambda options: EchoBackend()}


def check_action(action: str, kind: str) -> None:
    if action not in ACTIONS or kind.split("/")[0] not in ACTIONS[action]:
        raise ValueError(f"cannot {action} a model of kind {kind}")


def register_function(spark: SparkSession, name: str, kind: str, options: dict[str, str]) -> None:
    """SQL function: JSON in, an array with one JSON answer out; models load once a worker."""
    check_action("infer", kind)
    make = BACKENDS.get(options.get("backend", "mock"))
    if make is None:
        raise RuntimeError(f"no backend {options.get('backend')}")
    task = "embed" if kind.startswith("m3e") else "transcribe" if kind.startswith("whisper") else "generate"

    @F.pandas_udf("array<string>")
    def answer(requests: pd.Series) -> pd.Series:
        backend = make(options)
        out = []
        for text in requests:
            request = json.loads(text) if text else {}
            instruction = request.get("instruction", "")
            value = getattr(backend, task)(instruction, request) if task == "generate" else getattr(backend, task)(instruction)
            history = [*request.get("history", []), {"query": instruction, "response": value}] if task == "generate" else None
            out.append([json.dumps({"predict": value, "output": value, "input": request, **({"history": history} if history else {})}, ensure_ascii=False)])
        return pd.Series(out)

    spark.udf.register(name, answer)
