"""A bounded sample of labelled documents, and a model fitted on it in one task."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dailycast.llm.common import batch_texts


#: Bytes of text that a fit holds at most.
TEXT_BYTES = 512 << 20


def fit_on_sample(
    docs: DataFrame,
    labels: DataFrame,
    fit: Callable[[list[bytes], list[int]], bytes],
    bound: int,
    text: str = "text",
    doc_id: str = "doc_id",
    text_bytes: int = TEXT_BYTES,
) -> bytes:
    """What ``fit`` makes of at most ``bound`` labelled texts.

    ``labels`` has doc_id and label (0 or 1). The sample is the ``bound`` labels whose ids
    hash lowest, so it is the same at each run and independent of sources; rows with null
    id or label are no labels. Its ids are broadcast (``bound`` longs); of the texts they meet,
    each taken once per id and label, the ``bound`` that hash lowest go to one task in that
    order, where ``fit`` runs. Texts from the one on that would pass ``text_bytes`` are left out.
    """
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(bound)
    met = (
        docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        .join(F.broadcast(chosen), "doc_id")
        .select(F.xxhash64("doc_id", "text").alias("at"), "text", F.col("label").cast("int").alias("label"))
    )
    once = met.groupBy("at", "label").agg(F.max("text").alias("text"))
    sample = once.orderBy("at", "label").limit(bound).select("at", "text", "label")

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for row in zip(
                batch.column("at").to_pylist(), batch_texts(batch.column("text")), batch.column("label").to_pylist()
            ):
                size += len(row[1])
                if size <= text_bytes:
                    rows.append(row)
        rows.sort()
        yield pa.RecordBatch.from_arrays(
            [pa.array([fit([r[1] for r in rows], [r[2] for r in rows])], pa.binary())], names=["model"]
        )

    fitted = sample.mapInArrow(run, "model binary").first()
    return bytes(fitted["model"]) if fitted else fit([], [])  # no task ran over no rows
