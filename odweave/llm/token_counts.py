"""Token counts by the whole-token shortcut."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from odweave.llm.encoder import Encoder
from odweave.llm.tables import texts


def proven_tokens(encoder: Encoder) -> dict[str, int]:
    """The vocabulary strings proven to encode alone as one token: the model, asked for each, gives back just its id.

    The proof is made once per vocabulary, before any text is read; its size is that of the vocabulary.
    """
    vocabulary = encoder.tokenizer.get_vocab(with_added_tokens=False)
    return {entry: 1 for entry, token in vocabulary.items() if [t.id for t in encoder.model.tokenize(entry)] == [token]}


class Counter(Encoder):
    """Counts pre-tokens: one where the whole pre-token is a proven token, else what merging it leaves."""

    def __init__(self, path: str):
        self.proven: dict[str, int] = {}
        super().__init__(path, len, sum)
        self.proven = proven_tokens(self)

    def _merge(self, letters: str) -> int:
        return self.proven.get(letters) or super()._merge(letters)


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    ``tokenizer`` is the path of a tokenizer file on every machine. A missing text counts as empty (0, 0, false); a
    missing key stays missing; repeated rows are counted one by one; an empty table gives no rows; other columns are
    not read. No begin, end or added tokens; special strings inside a text count as the library's default does.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(tokenizer)
        for batch in batches:
            n = pa.array([tokens.encode(t) for t in texts(batch.column(1))], pa.int64())
            size = pc.fill_null(pc.cast(pc.binary_length(batch.column(1)), pa.int64()), 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), size, n, pc.greater(n, limit)], ["k", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(count, f"k {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return made.withColumnRenamed("k", key)
