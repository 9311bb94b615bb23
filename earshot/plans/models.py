"""Recognition backends and their registry."""

from __future__ import annotations

import hashlib
import threading
import time
from importlib import import_module
from importlib.util import find_spec
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The registry of public models.
LANGUAGES = {"en": "English", "es": "Spanish", "ja": "Japanese"}
REGISTRY = [
    # name, family, parameters, languages, multilingual
    ("whisper-tiny", "whisper", "39M", ["en", "es", "ja"], True),
    ("whisper-base", "whisper", "74M", ["en", "es", "ja"], True),
    ("whisper-small", "whisper", "244M", ["en", "es", "ja"], True),
    ("wav2vec2-base", "wav2vec2", "95M", ["en"], False),
    ("wav2vec2-xlsr-es", "wav2vec2", "315M", ["es"], False),
    ("wav2vec2-xlsr-ja", "wav2vec2", "315M", ["ja"], False),
    ("pocketsphinx", "pocketsphinx", "~10M (GMM)", ["en"], False),
]
NEEDS = {"whisper": ("torch", "transformers"), "wav2vec2": ("torch", "transformers"), "pocketsphinx": ("pocketsphinx",), "stand-in": ()}
STAND_IN = ("stand-in", "stand-in", "0", ["en", "es", "ja"], True)


class Backend(Protocol):
    """Recognises waveforms; results must not depend on their order or company."""

    def transcribe(self, waves: list[np.ndarray], language: str | None, task: str) -> list[tuple[str, str | None]]: ...


class StandIn:
    """Not a recogniser: words drawn by a hash of the samples, the same on every run.
    It lets plans run where no model is installed."""

    WORDS = ("alpha", "bravo", "carol", "delta", "echo", "fox", "golf", "hotel")

    def transcribe(self, waves: list[np.ndarray], language: str | None, task: str) -> list[tuple[str, str | None]]:
        out = []
        for y in waves:
            digest = hashlib.sha256(np.round(np.asarray(y, float), 3).tobytes()).digest()
            n = max(1, min(len(digest), len(y) // 16_000))
            out.append((" ".join(self.WORDS[b % 8] for b in digest[:n]), "en" if task == "translate" else language or "en"))
        return out


FACTORIES = {"stand-in": lambda name: StandIn()}
_held: dict[str, Backend] = {}
_seconds: dict[str, float] = {}
_lock = threading.Lock()


def register(family: str, factory) -> None:
    """Plug in a backend family; ``factory(name)`` loads a model once a process.  Call it in a module that
    the plan names in ``plugins``, so that it runs in every worker."""
    FACTORIES[family] = factory


def backend(name: str) -> tuple[Backend, float]:
    """The model of this process and the seconds this call took to load it."""
    family = _entry(name)[1]
    with _lock:
        if name in _held:
            return _held[name], 0.0
        if family not in FACTORIES:
            raise RuntimeError(f"no backend for {family!r} is plugged in")
        start = time.perf_counter()
        _held[name] = FACTORIES[family](name)
        return _held[name], time.perf_counter() - start


def warm_up(name: str, plugins: tuple[str, ...] = ()) -> float:
    """Loads a model in this process ahead of its first use; the seconds that took."""
    for p in plugins:
        import_module(p)
    return backend(name)[1]


def available_count(models: DataFrame) -> DataFrame:
    """How many models of a registry can run."""
    return models.agg(F.count_if("available").alias("available"))


def registry(spark: SparkSession) -> DataFrame:
    """name, family, parameters, languages, multilingual, available."""
    rows = [(*r, all(find_spec(m) for m in NEEDS[r[1]])) for r in REGISTRY]
    return spark.createDataFrame(rows, "name string, family string, parameters string, languages array<string>, multilingual boolean, available boolean")


def _entry(name: str) -> tuple:
    for row in (*REGISTRY, STAND_IN):
        if row[0] == name:
            return row
    raise ValueError(f"unknown model {name!r}; choose from {[r[0] for r in REGISTRY]}")


def allowed(language: str | None, task: str, languages: list[str], multilingual: bool) -> bool:
    """The rule once: translation needs a multilingual model, a named language a model that has it."""
    return (multilingual or task != "translate") and (not language or language in languages)


def check_language(name: str, language: str | None, task: str = "transcribe") -> None:
    _, _, _, languages, multilingual = _entry(name)
    if not allowed(language, task, languages, multilingual):
        raise ValueError(f"{name} (languages {languages}, {'multilingual' if multilingual else 'one way'}) can't {task} {language or 'any language'}")


def can_run(language: Column, task: Column, languages: Column, multilingual: Column) -> Column:
    """``allowed`` over rows."""
    return (multilingual | (task != "translate")) & (language.isNull() | (language == "") | F.array_contains(languages, language))
