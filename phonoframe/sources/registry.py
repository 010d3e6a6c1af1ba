"""Pluggable corpora: a name and a function that builds the common utterance frame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phonoframe.operators.records import union_corpora

_CORPORA: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_corpus(name: str, build: Callable[[SparkSession, str], DataFrame]) -> None:
    _CORPORA[name] = build


def registered() -> list[str]:
    return sorted(_CORPORA)


def load_corpora(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """Utterances of every named corpus below its root, in one schema."""
    unknown = sorted(set(roots) - set(_CORPORA))
    if unknown:
        raise KeyError(f"unknown corpora: {unknown}")
    return union_corpora(*[_CORPORA[name](spark, root) for name, root in roots.items()])
