"""Dense vectors of texts, from any encoder, and their cosines inside a pack or a sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts to the rows of a matrix; a picklable callable, for instance around a model that each worker loads once.
Encoder = Callable[[list[str]], np.ndarray]
#: Dimensions of the stand-in encoder.
DIMENSIONS = 64


def character_encoder(texts: list[str]) -> np.ndarray:
    """A stand-in that needs no weights: counts of characters by code point modulo DIMENSIONS."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in zip(out, texts):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row += np.bincount(codes % DIMENSIONS, minlength=DIMENSIONS)
    return out


def encoded(df: DataFrame, text: str, encoder: Encoder, to: str = "vector") -> DataFrame:
    """``df`` with ``to``, the vector of ``text`` of length 1; null for null texts and for texts whose vector has no length.

    The encoder sees each Arrow batch's texts at once. Whole texts are handed over.
    """
    kept = df.drop(to)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields)}, `{to}` array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = b.column(b.num_columns - 1).to_pylist()
            some = [i for i, t in enumerate(said) if t is not None]
            vectors: list[list[float] | None] = [None] * len(said)
            if some:
                m = np.asarray(encoder([said[i] for i in some]), dtype=np.float64)
                length = np.linalg.norm(m, axis=1)
                for i, v, n in zip(some, m, length):
                    vectors[i] = (v / n).tolist() if n > 0 else None
            rows = b.select(range(b.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(vectors, pa.list_(pa.float64()))], names=[*rows.schema.names, to])

    return kept.select("*", F.col(text).alias("__text")).mapInArrow(run, schema)


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors of length 1; 0 where one is null."""
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x), F.lit(0.0))


def pack_cosines(questions: DataFrame, texts: DataFrame, encoder: Encoder) -> DataFrame:
    """``(sample_key, event_id, cosine)`` of each question and each text of its pack.

    ``questions(sample_key, pack, question)``, ``texts(pack, event_id, text)``. Every text is encoded once, whatever the number
    of questions; a pack is the unit in which questions and texts meet.
    """
    q = encoded(questions.select("sample_key", "pack", "question"), "question", encoder, "a").drop("question")
    t = encoded(texts.select("pack", "event_id", "text"), "text", encoder, "b").drop("text")
    return q.join(t, "pack").select("sample_key", "event_id", cosine("a", "b").alias("cosine"))
