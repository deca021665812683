"""Model functions for SQL: registered under names in a session."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udf, udtf

from ..kernels.model import Model
from ..operators.segment import encoder
from .text import kept


def register(spark: SparkSession, model: Model, prefix: str = "lm") -> list[str]:
    """Registers <prefix>_normalize, _encode, _encode_pieces, _decode, _count and the table function _tokenize.

    Nulls give nulls; _tokenize of a null or empty text gives no row.
    """

    def own() -> Model:
        return kept(("model", model.key), lambda: model)

    @arrow_udf("string")
    def normalize(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else own().normalize(t) for t in text.to_pylist()], pa.string())

    @arrow_udf("array<int>")
    def encode(text: pa.Array) -> pa.Array:
        return encoder(own())(text)

    @arrow_udf("array<string>")
    def encode_pieces(text: pa.Array) -> pa.Array:
        return pa.array([None if t is None else [p for p, *_ in own().pieces_of(t)] for t in text.to_pylist()], pa.list_(pa.string()))

    @arrow_udf("string")
    def decode(ids: pa.Array) -> pa.Array:
        return pa.array([None if x is None else own().decode(x) for x in ids.to_pylist()], pa.string())

    @arrow_udf("int")
    def count(text: pa.Array) -> pa.Array:
        return pc.list_value_length(encoder(own())(text))

    # A plain table function: Arrow ones can't stand on the right of a lateral join.
    @udtf(returnType="seq int, piece string, id int, begin int, end int")
    class Tokenize:
        def eval(self, text: str):
            for n, s in enumerate(own().spans(text) if text else []):
                yield n, s.piece, s.id, s.begin, s.end

    names = []
    for f in (normalize, encode, encode_pieces, decode, count):
        name = f"{prefix}_{f.__name__}"
        spark.udf.register(name, f)
        names.append(name)
    spark.udtf.register(f"{prefix}_tokenize", Tokenize)
    return [*names, f"{prefix}_tokenize"]
