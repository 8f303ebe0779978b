"""Cross-entropy difference: two matched bigram models over the whole corpus.

Every word is of the vocabulary and a context of its own, and every pair of a
context and a word is counted, however many there are.  No model is gathered:

1. texts become blocks, tables of word numbers in the shared folder;
2. a block asks for the counts of its distinct words and pairs, by their 64-bit
   hashes, in as many ranges of hashes as the corpus has words for;
3. each range adds up what all blocks have and answers every block in its order;
4. a block with its answers is scored alone.

A block passes on each word or pair once, so a very common one has no more rows
than there are blocks, and tasks hold one block or range, whatever the corpus.
Words and pairs of equal hashes, one in 2 ** 64, would share their counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .decontaminate import words_of
from .probminhash import U64, hashed_words, mixed
from .shared import pieces, small, small_batches, written

#: Words of a block; the text that exceeds it is the block's last.
BLOCK_WORDS = 1 << 21
#: Words of a block's documents that are scored at a time, or one document's.
SCORED_WORDS = 1 << 18
#: Words of the corpus for each range of hashes.
RANGE_WORDS = 1 << 21
#: Distinct words that a task gathers before it passes their counts on.
GATHERED = 300_000
SMOOTHING = 4.0
#: Hashes of the start of a text and of the class of all other words.
START, OTHER = 0x8CB92BA72F3D8DD7, 0x5851F42D4C957F2D


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents; counted in each task first, within ``GATHERED`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in pieces(batches, "text"):
            for text in batch.column("text"):
                held.update(words_of(text.as_py()))
                if len(held) > GATHERED:
                    yield out()
                    held.clear()
        yield out()

    return docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def most_frequent(docs: DataFrame, words: int) -> np.ndarray:
    """The hashes of the most frequent words, ties by their bytes."""
    found = word_counts(docs).orderBy(F.desc("n"), "word").limit(words).collect()
    return hashed_words([" ".join(bytes(x.word).decode() for x in found)])[1]


def packed(values: np.ndarray) -> bytes:
    """Numbers as their count and compressed planes of bytes."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def _packed_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return packed(np.diff(keys, prepend=np.zeros(1, dtype=U64)))


def _unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, U64), dtype=U64)


BLOCK = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("target", pa.list_(pa.bool_())), ("hashes", pa.binary()), ("words", pa.binary())])
ASKED = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("words", pa.binary()), ("word_counts", pa.binary()), ("pairs", pa.binary()), ("pair_counts", pa.binary())])
ANSWER = pa.schema([("range", pa.int64()), ("block", pa.int64()), ("n_words", pa.int64()), ("word_counts", pa.binary()), ("pair_counts", pa.binary()), ("distinct", pa.int64()), ("n_target", pa.int64()), ("n_background", pa.int64())])
KINDS = {
    "block": "block long, doc_id array<long>, n_tokens array<long>, target array<boolean>, hashes binary, words binary",
    "asked": "range long, block long, words binary, word_counts binary, pairs binary, pair_counts binary",
    "answer": "range long, block long, n_words long, word_counts binary, pair_counts binary, distinct long, n_target long, n_background long",
}


def blocks(marked: DataFrame, vocabulary: np.ndarray | None = None, most: int = BLOCK_WORDS) -> DataFrame:
    """Texts as numbers of the block's own words, the frequent ones first; ``marked`` has doc_id, text and target."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        ids, sizes, sides, words, held = [], [], [], [], 0

        def out() -> pa.RecordBatch:
            tokens = np.concatenate(words)
            if vocabulary is not None:
                tokens[~np.isin(tokens, vocabulary)] = OTHER
            hashes, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), dtype=np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([(task << 32) + number, ids, sizes, sides, packed(hashes[order]), packed(rank[at])], BLOCK.types, strict=True)], schema=BLOCK)

        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            owner, hashes = hashed_words(texts)
            ids += batch.column("doc_id").to_pylist()
            sizes += np.bincount(owner, minlength=len(texts)).tolist()
            sides += batch.column("target").to_pylist()
            words.append(hashes)
            held += len(hashes)
            if held >= most:
                yield out()
                number, held = number + 1, 0
                ids, sizes, sides, words = [], [], [], []
        if ids:
            yield out()

    return marked.select("doc_id", "text", "target").mapInArrow(encode, KINDS["block"])


class Block:
    """A block's words, contexts and pairs, each distinct one by its ascending hash."""

    def __init__(self, row: dict, contexts: np.ndarray | None):
        self.ids, self.sizes = row["doc_id"], np.array(row["n_tokens"], dtype=np.int64)
        listed, tokens = unpacked(row["hashes"], U64), unpacked(row["words"], np.uint32)
        self.words = np.unique(np.concatenate([listed, np.array([START, OTHER], dtype=U64)]))
        start, other = np.searchsorted(self.words, np.array([START, OTHER], dtype=U64))
        self.word = np.searchsorted(self.words, listed).astype(np.int32)[tokens]
        as_context = np.arange(len(self.words), dtype=np.int32)
        if contexts is not None:
            as_context[~np.isin(self.words, contexts)] = other
        self.context = np.empty_like(self.word)
        self.context[1:] = as_context[self.word[:-1]]
        begins = np.cumsum(self.sizes) - self.sizes
        self.context[begins[self.sizes > 0]] = start
        keys = mixed(mixed(self.words[self.context] ^ U64(0x9E3779B97F4A7C15)) + self.words[self.word])
        self.pairs, pair = np.unique(keys, return_inverse=True)
        self.pair = pair.astype(np.int32)
        self.side = np.repeat(np.array(row["target"], dtype=bool), self.sizes)

    def runs(self, most: int) -> Iterator[tuple[int, int, int, int]]:
        """First and last document, and word, of runs of at most so many words, or of one document."""
        ends, a = np.cumsum(self.sizes), 0
        while a < len(ends):
            first = int(ends[a] - self.sizes[a])
            b = max(a + 1, int(np.searchsorted(ends, first + most, side="right")))
            yield a, b, first, int(ends[b - 1])
            a = b

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of words: as words in the target and the background, as contexts in both; of pairs: in both."""

        def both(at: np.ndarray, n: int) -> list[np.ndarray]:
            near = np.bincount(at[self.side], minlength=n)
            return [near, np.bincount(at, minlength=n) - near]

        return np.stack(both(self.word, len(self.words)) + both(self.context, len(self.words))), np.stack(both(self.pair, len(self.pairs)))


def asked(encoded: DataFrame, n_ranges: int, contexts: np.ndarray | None) -> DataFrame:
    """What each block has of each range of hashes."""
    edges = np.array([(k << 64) // n_ranges for k in range(1, n_ranges)], dtype=U64)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row, contexts)
                of_words, of_pairs = block.counts()
                w = [0, *np.searchsorted(block.words, edges).tolist(), len(block.words)]
                p = [0, *np.searchsorted(block.pairs, edges).tolist(), len(block.pairs)]
                for k in range(n_ranges):
                    a, b, c, d = w[k], w[k + 1], p[k], p[k + 1]
                    if a < b or c < d:
                        values = [k, row["block"], _packed_keys(block.words[a:b]), packed(of_words[:, a:b].ravel()), _packed_keys(block.pairs[c:d]), packed(of_pairs[:, c:d].ravel())]
                        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, ASKED.types, strict=True)], schema=ASKED)

    return encoded.mapInArrow(ask, KINDS["asked"])


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sums of each distinct key, and those of every list in its own order."""
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    whole = np.concatenate(counts, axis=1)
    sums = np.stack([np.bincount(at, weights=x, minlength=len(found)) for x in whole]).astype(np.int64)
    ends = np.cumsum([len(x) for x in keys])
    return sums, [sums[:, x] for x in np.split(at, ends[:-1])]


def _answers(table: pa.Table) -> pa.Table:
    """The counts of a range over all blocks; its totals stand in one of the rows."""
    rows = table.to_pylist()
    sums, words = _added([_unpacked_keys(x["words"]) for x in rows], [unpacked(x["word_counts"], np.int64).reshape(4, -1) for x in rows])
    _, pairs = _added([_unpacked_keys(x["pairs"]) for x in rows], [unpacked(x["pair_counts"], np.int64).reshape(2, -1) for x in rows])
    totals = [[int((sums[0] + sums[1] > 0).sum()), int(sums[0].sum()), int(sums[1].sum())]] + [[0, 0, 0]] * (len(rows) - 1)
    out = [[x["range"], x["block"], w.shape[1], packed(w.ravel()), packed(p.ravel()), *t] for x, w, p, t in zip(rows, words, pairs, totals, strict=True)]
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), ANSWER.types, strict=True)], schema=ANSWER)


def _own(owner: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each token, how often its own document has what it has."""
    _, at, n = np.unique(owner.astype(np.int64) * (int(of.max(initial=0)) + 1) + of, return_inverse=True, return_counts=True)
    return n[at]


def _loss(pair, word, total, unigrams, smoothing: float):
    return -np.log((pair + smoothing * ((word + 1.0) / unigrams)) / (total + smoothing))


def losses(counts: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """-log p(word | context): counts smoothed by the model's own unigrams, which add one."""
    word = counts.sum(axis=0)
    return _loss(counts, word, counts.sum(axis=1, keepdims=True), word.sum() + len(word), smoothing)


def scored(docs: DataFrame, target: DataFrame, words: int | None = None, contexts: int | None = None, smoothing: float = SMOOTHING) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference (nats per token).

    ``docs`` has doc_id and text; ``target`` has the doc_id of the documents that
    the target model learns from; all others teach the background model.  Each
    document is scored by models that haven't seen it: its own counts are taken out
    of its side's, so that a text which occurs nowhere else can't look familiar.  A
    low difference means that a document is like the target.  Texts without a word,
    null or not, have no tokens and null losses; very long ones are one document
    of their block.  Repeated rows count and are scored each.  Without target documents the target model is uniform.  Empty
    tables give empty results; other columns aren't read.

    All words are counted after all contexts, and one class stands for words that
    never occur.  Only a caller who asks for it gets a smaller model: the ``words``
    - 1 most frequent words, and ``contexts`` - 2 of them as contexts; all others
    are that class.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = written(target.select(F.col("doc_id").cast("long").alias("_target")).where("_target is not null").distinct(), "lm-target")
    marked = texts.join(small(chosen, 16), texts["doc_id"] == chosen["_target"], "left").select("doc_id", "text", F.col("_target").isNotNull().alias("target"))
    limit = max((x for x in (words and words - 1, contexts and contexts - 2) if x is not None), default=None)
    listed = None if limit is None else most_frequent(texts, limit)
    kept = None if words is None else listed[: words - 1]
    before = None if contexts is None else listed[: contexts - 2]
    with small_batches(spark):
        encoded = written(blocks(marked, kept), "lm-blocks")
    n_ranges = -(-int(encoded.select(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, x: s + x))).first()[0] or 1) // RANGE_WORDS)
    answers = written(asked(encoded, n_ranges, before).groupBy("range").applyInArrow(_answers, KINDS["answer"]), "lm-counts")
    distinct, *tokens = (int(x or 0) for x in answers.agg(F.sum("distinct"), F.sum("n_target"), F.sum("n_background")).first())
    classes = distinct + 1 if kept is None else len(kept) + 1
    at_once = SCORED_WORDS
    names = ["doc_id", "n_tokens", "target_loss", "background_loss", "difference"]

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        found = sorted(right.to_pylist(), key=lambda x: x["range"])
        for row in left.to_pylist():
            block = Block(row, before)
            of_words = np.concatenate([unpacked(x["word_counts"], np.int64).reshape(4, -1) for x in found], axis=1)
            of_pairs = np.concatenate([unpacked(x["pair_counts"], np.int64).reshape(2, -1) for x in found], axis=1)
            none, means = block.sizes == 0, np.zeros((2, len(block.sizes)))
            for a, b, first, last in block.runs(at_once):
                sizes = block.sizes[a:b]
                owner = np.repeat(np.arange(b - a), sizes)
                pair, word, context, side = (x[first:last] for x in (block.pair, block.word, block.context, block.side))
                own_pair, own_word, own_context = (_own(owner, x) for x in (pair, word, context))
                for k, taught in enumerate((side, ~side)):
                    every = tokens[k] - sizes[owner] * taught + classes
                    loss = _loss(of_pairs[k][pair] - own_pair * taught, of_words[k, word] - own_word * taught, of_words[k + 2, context] - own_context * taught, every, smoothing)
                    means[k, a:b] = np.bincount(owner, weights=loss, minlength=b - a) / np.maximum(sizes, 1)
            out.append(pa.Table.from_arrays([pa.array(block.ids, pa.int64()), pa.array(block.sizes), *(pa.array(x, mask=none) for x in (*means, means[0] - means[1]))], names=names))
        return pa.concat_tables(out)

    return encoded.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, "doc_id long, n_tokens long, target_loss double, background_loss double, difference double")
