"""Token counts per document (operator 4): the whole-token shortcut over :mod:`evidra.llm.bpe`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from evidra.llm.bpe import TOKEN_SLICE, encoder
from evidra.llm.common import batch
from evidra.llm.textcols import slices, texts_of

LIMIT = 1024
COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def token_counts(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; no shuffle.

    ``tokenizer`` is the path of a byte-level BPE file on every worker. A null text is an empty one with
    no tokens; repeated rows and null ids are counted like any other; an empty table gives no rows. Only
    doc_id and text are read, so further columns, whatever their names, play no part.
    """

    def count(batches):
        enc = encoder(tokenizer)
        for rows in batches:
            for part in slices(rows, "text", TOKEN_SLICE):
                text = part.column("text")
                _, n = enc.encode_column(text)
                yield batch(COUNTS, part.column("doc_id"), np.diff(texts_of(text).start), n, n > limit)

    return docs.select("doc_id", "text").mapInArrow(count, COUNTS)
