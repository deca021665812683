"""All queries of the core, by name, with their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import corpus, evaluation, training
from ..session import table
from ..spec import NormalizerSpec, TrainerSpec
from . import continuations, files, hierarchies, lattices, loading, models, texts

MODULES = (loading, texts, models, continuations, files, lattices, hierarchies)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
SQL = {name: q for m in MODULES for name, q in m.SQL.items()}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Merges learnt on documents, and how well their vocabulary compresses them."""
    lines = corpus.lines(table(spark, d, "documents"))
    model = training.train(lines, TrainerSpec("bpe", vocab_size=1200, character_coverage=0.99), NormalizerSpec())
    return evaluation.evaluate(table(spark, d, "documents"), model)
