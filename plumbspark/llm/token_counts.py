"""Token counts of whole texts by merging ranks over arrays."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbspark.llm.blocks import blocks, ids_of, rows_of
from plumbspark.llm.bpe import counter


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's bytes and byte-level BPE tokens, and whether the tokens exceed ``limit``.

    Pre-tokens of a block of texts lie in ragged numpy arrays; each round merges the pair of lowest rank of
    every pre-token at once until none is left, and the surviving symbols are counted. Pieces that were seen
    before are looked up. One row for each row of ``docs``, repeated rows and NULL ids included; a NULL or
    empty text has 0 bytes and 0 tokens; an empty table gives no rows. Special strings count as one token.

    ``vocabulary``: path of a tokenizer file that every executor can read.
    """

    def count(batches):
        tokens = counter(vocabulary)
        for rows, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays(
                [ids_of(rows), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(tokens.counts(texts))],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    counted = rows_of(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
