"""Token counts with a shortcut for whole tokens.

Which vocabulary strings encode alone as one token is proved once, before the job, by running the
merges on each of them. A task then splits texts into pre-tokens and counts those in the proven
set directly; only the rest is merged, each distinct one once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicebox.llm.common import narrow, text_slices
from sluicebox.llm.tokenizers import DEFAULT_PATH, PATTERN, encoding, load_ranks, whole_tokens

#: Distinct merged pre-tokens that a worker remembers; beyond it, it starts anew (memory, not results).
REMEMBERED = 200_000

_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_pretokens", pa.int64()), ("n_whole", pa.int64()), ("n_tokens", pa.int64())])


class _Memory(dict):
    """Token counts of pre-tokens that aren't whole tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.codec = encoding(ranks)

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        # The piece is one pre-token in its text but may be split on its own ('x's' rule), hence the call for single pieces.
        count = len(self.codec._encode_single_piece(piece))
        self[piece] = count
        return count


def _counter(sent):  # noqa: ANN001, ANN202
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, whole = sent.value
        memory, pattern = _Memory(ranks), regex.compile(PATTERN)
        for batch in text_slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                if text is None:
                    rows.append((None, None, None, None))
                    continue
                pieces = pattern.findall(text)
                rest = [x for x in pieces if x not in whole]
                rows.append((len(text.encode("utf-8", "surrogatepass")), len(pieces), len(pieces) - len(rest), len(pieces) - len(rest) + sum(map(memory.__getitem__, rest))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in zip(*rows))], schema=_OUT)

    return count


def token_counts(docs: DataFrame, path: str = DEFAULT_PATH) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_pretokens, n_whole, n_tokens``.

    ``n_tokens`` equals the length of the text's ordinary encoding (strings of special tokens
    are ordinary text); ``n_whole`` is how many pre-tokens the shortcut counted. Null texts have
    null counts, empty ones 0. Repeated rows have a row each. Extra columns are ignored.
    """
    ranks = load_ranks(path)
    sent = docs.sparkSession.sparkContext.broadcast((ranks, whole_tokens(ranks)))  # the vocabulary's size, whatever the corpus
    rows = narrow(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(_counter(sent), "doc_id bigint, n_bytes bigint, n_pretokens bigint, n_whole bigint, n_tokens bigint")
