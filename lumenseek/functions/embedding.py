"""Embedding providers: a registry of functions from batches of texts to vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lumenseek.functions.numeric import mock_embedding


@dataclass(frozen=True)
class EmbeddingConfig:
    provider: str = "mock"
    dimensions: int = 128
    model: str | None = None


Provider = Callable[[list[str], EmbeddingConfig], list[list[float]]]
_providers: dict[str, Provider] = {}


def register_provider(name: str, provider: Provider) -> None:
    _providers[name] = provider


def registered_providers() -> list[str]:
    return sorted({"mock", *_providers})


def compose(primary: Provider, fallback: Provider) -> Provider:
    """fallback where primary raises; both must make vectors that may be compared, and of the same length. What primary
    raised is in the notes of an error of the fallback."""

    def run(texts: list[str], config: EmbeddingConfig) -> list[list[float]]:
        try:
            return primary(texts, config)
        except Exception as e:  # noqa: BLE001  any failure of the primary
            try:
                return fallback(texts, config)
            except Exception as f:
                f.add_note(f"the first provider: {e}")
                raise

    return run


def embed(text: Column, config: EmbeddingConfig = EmbeddingConfig()) -> Column:
    """Vectors of texts. mock stays in the engine; others run on Arrow batches, and their errors are raised, for vectors of
    another model would not be comparable."""
    if config.provider == "mock":
        return mock_embedding(text, config.dimensions).cast("array<float>")
    if config.provider not in _providers:
        raise ValueError(f"no provider {config.provider!r}; there are {registered_providers()}")
    provider = _providers[config.provider]

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(provider(texts.fillna("").tolist(), config))

    return run(text)


def embed_rows(rows: DataFrame, config: EmbeddingConfig = EmbeddingConfig(), *, text_col: str = "text", batch: int = 32) -> DataFrame:
    """rows with vector array<float> and error string, one of them null. A batch of texts whose provider fails is tried
    again in halves, down to single texts, so only texts that fail by themselves have no vector, and the others and the
    job go on. A null text counts as empty; vectors of a wrong length or with values that are not finite are failures."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if config.provider == "mock":
        return rows.withColumns({"vector": embed(text, config), "error": F.lit(None).cast("string")})
    if config.provider not in _providers:
        raise ValueError(f"no provider {config.provider!r}; there are {registered_providers()}")
    provider = _providers[config.provider]

    def checked(vector) -> list[float]:
        out = [float(x) for x in vector]
        if len(out) != config.dimensions or not all(x - x == 0 for x in out):
            raise ValueError(f"not a vector of {config.dimensions} finite numbers")
        return out

    def tried(texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            made = provider(texts, config)
            if len(made) != len(texts):
                raise ValueError(f"{len(made)} vectors for {len(texts)} texts")
            return [(checked(v), None) for v in made]
        except Exception as e:  # noqa: BLE001  whatever a provider raises
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            half = len(texts) // 2
            return tried(texts[:half]) + tried(texts[half:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for given in batches:
            texts = given.column(len(given.schema.names) - 1).to_pylist()
            made = [x for k in range(0, len(texts), batch) for x in tried(texts[k : k + batch])]
            vectors, errors = pa.array([v for v, _ in made], pa.list_(pa.float32())), pa.array([e for _, e in made], pa.string())
            yield pa.RecordBatch.from_arrays([*given.columns[:-1], vectors, errors], [*given.schema.names[:-1], "vector", "error"])

    out = rows.withColumn("_text", text)
    given = StructType([*rows.schema.fields, *StructType.fromDDL("vector array<float>, error string").fields])
    return out.mapInArrow(run, given)
