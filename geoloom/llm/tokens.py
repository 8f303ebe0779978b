"""Token counts of whole texts; huge ones by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .encoding import TOGETHER, TOGETHER_BYTES, encoder, resynchronised
from .shared import pieces

ADDED = (("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType()), ("n_chunks", T.LongType()))


def token_counts(docs: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512, chunk_chars: int = 32_768, overlap_chars: int = 1_024, keep_text: bool = False) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit) and n_chunks.

    Counts equal those of the library for the whole text, without begin, end or
    added special tokens.  Texts over ``chunk_chars`` code points are encoded in
    overlapping chunks, so that a worker holds one chunk's offsets at a time.

    Null and empty texts have no bytes and no tokens, in no chunk.  Columns of
    these names that ``docs`` has already are replaced; its other columns, null
    or not, pass through, the text itself only with ``keep_text``.  Repeated
    rows count each on its own.  An empty table gives an empty result.
    """
    if chunk_chars < 2 or overlap_chars < 1:
        raise ValueError("chunk_chars must be over 1 and overlap_chars over 0")
    names = [x for x, _ in ADDED]
    rows = docs.drop(*(x for x in names if x != text))
    kept = [f for f in rows.schema.fields if keep_text or f.name != text]
    schema = T.StructType(kept + [T.StructField(n, t, True) for n, t in ADDED])
    passed, at = [f.name for f in kept], text

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(tokenizer_path)
        for batch in pieces(batches, at, rows=TOGETHER, n_bytes=TOGETHER_BYTES):
            docs = [x or "" for x in batch.column(at).to_pylist()]
            huge = [tool.stable and len(x) > chunk_chars for x in docs]
            n_tokens, n_chunks = [0] * len(docs), [int(bool(x)) for x in docs]
            bounds = tool.encode_many(["" if h else x for x, h in zip(docs, huge, strict=True)])[1]
            for k, (doc, is_huge) in enumerate(zip(docs, huge, strict=True)):
                n_tokens[k] = int(bounds[k + 1] - bounds[k])
                if is_huge:
                    n_tokens[k], n_chunks[k] = resynchronised(doc, tool.spans, chunk_chars, overlap_chars)
            n_bytes = [len(x.encode()) for x in docs]
            added = [pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array([x > limit for x in n_tokens], pa.bool_()), pa.array(n_chunks, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in passed] + added, names=passed + names)

    return rows.mapInArrow(count, schema)
