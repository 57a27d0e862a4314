"""Token counts: pieces counted once per distinct pre-token, joined to documents' frequencies."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.block_counts import bucket_count, count_blocks, sum_values, value_words
from flowlens.llm.common import Shipped
from flowlens.llm.sentence_pieces import SPACE, PieceModel, normalize


def _splitter(held: Shipped):
    model = held.get()

    def split(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        plain = not model.charmap and not model.trim
        ready = model.prefixed(texts) if plain else pc.fill_null(texts, "")
        parts, _, _, counts = model.parts(ready)
        return parts, counts

    return split


def _counter(held: Shipped):
    model = held.get()
    library = model.processor()

    def count(words: pa.Array, _: np.ndarray) -> np.ndarray:
        result = []
        for begin in range(0, len(words), 50_000):
            group = words[begin:begin + 50_000].to_pylist()
            if model.charmap or model.trim:
                ready = [normalize(model, w, True)[0].decode() for w in group]
            else:
                ready = [w.replace(" ", SPACE) for w in group]
            result += [len(x) for x in library.encode(ready, num_threads=1)]
        return np.array(result, np.int64)

    return count


def token_counts(docs: DataFrame, model_path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, n_pretokens) for every row, without ids of any document.

    A pre-token is a run that no merge of the model can leave, so that pieces of a text are the
    pieces of its pre-tokens. A null or empty text has no tokens; rows with equal or null ids
    count each for itself.
    """
    held = Shipped(docs.sparkSession, PieceModel(model_path))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
    columns = ["doc_id", "n_bytes"]
    blocks = count_blocks(rows, partial(_splitter, held), bucket_count(docs), columns)
    values = value_words(blocks, partial(_counter, held))
    summed = sum_values(blocks, values, columns, lambda value: {"n": value}, ["n"])
    return summed.select(
        "doc_id", "n_bytes", F.col("n").cast("long").alias("n_tokens"), F.col("n_words").alias("n_pretokens"))
