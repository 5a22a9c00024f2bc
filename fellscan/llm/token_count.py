"""Token counts with a whole-token shortcut.

Each worker first proves which vocabulary strings encode alone as one token. A text's words that are among them count one
each without any merging; only the rest goes to the library's merges, each different word once while it is remembered. Counting is a map
over the rows, without a shuffle, so no key can be hot; memory is one batch and a bounded table of words.

Null text counts as empty (0 bytes, 0 tokens). Special strings inside a text are handled as the library does by default.
Repeated rows give repeated results, an empty table an empty one; only doc_id and text are read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fellscan.llm import pretokens

MAX_TOKENS = 2048
_state: dict = {}


def count_texts(texts: list[str], path: str) -> list[int]:
    if path not in _state:
        whole = pretokens.whole_tokens(path)
        _state[path] = pretokens.WordTable(path, len, sum, lambda part: 1 if part in whole else None)
    return [_state[path].text(t) for t in texts]


def token_counts(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document."""

    def count(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": pd.Series(count_texts(pdf["text"].tolist(), path), dtype="int64")})

    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    out = rows.mapInPandas(count, f"doc_id {id_type}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > max_tokens)
