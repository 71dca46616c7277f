"""Encoders of texts as unit vectors, by name. Any other encoder is a class with the same three members."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.vectors import cosine, unit

#: A sentence whose vector is kept with a model, and the least cosine that a loaded encoder must reach with it.
PROBE, LEAST_COSINE = "The probe sentence of an encoder.", 0.999


class EncoderError(ValueError):
    """An encoder that is not there or not the one a model was fitted with."""


class Encoder(Protocol):
    tag: str
    size: int

    def transform(self, rows: DataFrame, text: str = "text") -> DataFrame: ...


class HashedEncoder:
    """Counts of words in hashed slots, as unit vectors: built-ins only, without a model. Texts without words are zero."""

    def __init__(self, size: int = 256, prefix: str = ""):
        if size not in (16, 256, 4096):
            raise EncoderError(f"no size {size}")
        self.size, self.prefix, self.tag = size, prefix, f"hashed-{size}-{prefix.strip() or 'plain'}"

    def column(self, text: Column) -> Column:
        digits = {16: 1, 256: 2, 4096: 3}[self.size]
        words = F.regexp_extract_all(F.lower(F.concat(F.lit(self.prefix), F.coalesce(text, F.lit("")))), F.lit("([a-z]+)"), 1)
        slots = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), -digits, digits), 16, 10).cast("int"))
        counts = F.aggregate(slots, F.array_repeat(F.lit(0.0), self.size), lambda acc, s: F.transform(acc, lambda x, i: F.when(i == s, x + 1.0).otherwise(x)))
        return unit(counts)

    def transform(self, rows: DataFrame, text: str = "text") -> DataFrame:
        return rows.withColumn("features", self.column(F.col(text)))


ENCODERS = {"hashed-256": lambda: HashedEncoder(256), "hashed-4096": lambda: HashedEncoder(4096)}


def encoder(name: str) -> Encoder:
    """The encoder of that name; there is no fallback for one that is not there."""
    if name not in ENCODERS:
        raise EncoderError(f"no encoder {name}; there are {', '.join(sorted(ENCODERS))}")
    return ENCODERS[name]()


def concatenated(rows: DataFrame, columns: list[str], name: str = "features") -> DataFrame:
    """`rows` with the vectors of several encoders side by side; null if one is."""
    return rows.withColumn(name, F.concat(*(F.col(c).cast("array<double>") for c in columns)))


def probe(rows: DataFrame, own: Encoder) -> list[float]:
    """The vector of PROBE, to be kept with a model."""
    return own.transform(rows.sparkSession.createDataFrame([(PROBE,)], "text string")).first()["features"]


def verify_encoder(rows: DataFrame, own: Encoder, kept: list[float]) -> None:
    """Raises unless the encoder has the size of the kept probe and reaches LEAST_COSINE with it."""
    if len(kept) != own.size:
        raise EncoderError(f"{own.tag} has {own.size} numbers, not {len(kept)}")
    one = own.transform(rows.sparkSession.createDataFrame([(PROBE,)], "text string"))
    if (one.select(cosine(F.col("features"), F.array(*map(F.lit, kept)))).first()[0] or 0.0) < LEAST_COSINE:
        raise EncoderError(f"{own.tag} is not the encoder of this model")
