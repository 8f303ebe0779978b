"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to runs of word bytes with one space between, which loses
no word boundary.  One pass of the automaton over a text finds the blocks of all
windows, which are extended to the windows that occur; words map, by their order,
to spans of the original.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import pieces, written

WINDOW_WORDS = 10
#: Words are runs of 0-9, a-z and everything from U+0080 on, after A-Z are lowered.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of benchmark text in one automaton, which takes some 25 times as many; a larger benchmark takes more passes.
AUTOMATON_BYTES = 16 << 20
FOUND_TYPE = "struct<n_words:long,n_hit:long,items:array<string>,hit_words:array<struct<start:long,end:long>>,hit_spans:array<struct<start:long,end:long>>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
FOUND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("hit_words", SPANS), ("hit_spans", SPANS)])


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; a null text has none."""
    return text.encode().translate(FOLD).split() if text else []


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where the words of :func:`words_of` stand in the original, in code points."""
    lowered = text.translate({c: c + 32 for c in range(65, 91)})
    return [m.span() for m in WORD.finditer(lowered)]


class Scanner:
    """The automaton of some items' blocks, and the items' words to extend its hits.

    A window of s words has, wherever it begins in its item, a whole block of half
    as many that starts at a multiple of the block's size.  So the automaton holds one
    such path for each block, about two nodes for each word of the items, and not one for
    each window; a hit is extended word by word in every item that has the block.
    Words are numbered, and a number is two signs, one of either alphabet, so
    that a node has few children and a hit stands at a word's end.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], size: int = WINDOW_WORDS):
        import ahocorasick

        self.size, self.block = size, (size + 1) // 2
        self.number: dict[bytes, int] = {}
        listed = [(item_id, words) for item_id, words in ((i, words_of(t)) for i, t in items) if words]
        self.ids = [item_id for item_id, _ in listed]
        reach = size - self.block
        sizes = np.array([len(words) for _, words in listed], dtype=np.int64)
        # The items' numbers one after the other; -1 between them matches no word.
        self.begins = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]]) + reach + 1 if listed else np.zeros(0, np.int64)
        self.stream = np.full(int(sizes.sum()) + len(listed) + 2 * reach + 2, -1, dtype=np.int32)
        for begin, (_, words) in zip(self.begins.tolist(), listed, strict=True):
            self.stream[begin : begin + len(words)] = [self.number.setdefault(w, len(self.number) + 1) for w in words]
        self.whole = np.minimum(sizes, size)
        base = math.isqrt(len(self.number)) + 1
        self.signs = [chr(k // base) + chr(base + k % base) for k in range(len(self.number) + 1)]
        self.signs[0] = chr(2 * base) * 2  # a word that no item has
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        lengths, paths, places, owners = array("q"), array("q"), array("q"), array("q")
        for n, (begin, length) in enumerate(zip(self.begins.tolist(), sizes.tolist(), strict=True)):
            step = min(self.block, length)
            for k in range(begin, begin + length - step + 1, step):
                path = "".join([self.signs[x] for x in self.stream[k : k + step].tolist()])
                known = self.automaton.get(path, -1)
                if known < 0:
                    known = len(lengths)
                    self.automaton.add_word(path, known)
                    lengths.append(step)
                paths.append(known)
                places.append(k)
                owners.append(n)
        # The places of path k, and their items, lie from bounds[k] to bounds[k + 1].
        self.lengths, of = np.array(lengths, dtype=np.int32), np.array(paths, dtype=np.int32)
        order = np.argsort(of, kind="stable")
        self.bounds = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(lengths)))])
        self.places, self.owners = np.array(places, dtype=np.int32)[order], np.array(owners, dtype=np.int32)[order]
        self.empty = not len(lengths)
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words any window covers, and the items that have such a window."""
        hit, found = np.zeros(len(words), dtype=bool), set()
        if self.empty or not words:
            return hit, found
        get, signs, reach, text = self.number.get, self.signs, self.size - self.block, None
        for end, path in self.automaton.iter("".join([signs[get(w, 0)] for w in words])):
            if text is None:
                text = np.full(len(words) + 2 * reach, -2, dtype=np.int32)
                text[reach : reach + len(words)] = [get(w, 0) for w in words]
            length, among = int(self.lengths[path]), slice(self.bounds[path], self.bounds[path + 1])
            at, items, last = self.places[among], self.owners[among], end // 2 + 1
            first, steps = last - length, np.arange(1, reach + 1)
            left = _matched(self.stream[at[:, None] - steps] == text[reach + first - steps])
            right = _matched(self.stream[at[:, None] + length - 1 + steps] == text[reach + last - 1 + steps])
            full = left + length + right >= self.whole[items]
            for a, b, n in zip(left[full].tolist(), right[full].tolist(), items[full].tolist(), strict=True):
                hit[first - a : last + b] = True
                if self.ids[n] is not None:
                    found.add(self.ids[n])
        return hit, found


def _matched(equal: np.ndarray) -> np.ndarray:
    """How many of each row hold before the first that doesn't."""
    return np.logical_and.accumulate(equal, axis=1).sum(axis=1)


def _runs(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _item_batches(items: DataFrame, most: int, without_id: bool) -> Iterator[list[tuple[str, str | None]]]:
    """Items in runs of at most ``most`` bytes, streamed to the driver partition by partition."""
    held, size = [], 0
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    rows = rows if without_id else rows.where("item_id is not null")
    for row in rows.toLocalIterator():
        held.append((row.item_id, row.text))
        size += len(row.text.encode())
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_contamination(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS, automaton_bytes: int = AUTOMATON_BYTES, into: str = "contamination", keep_text: bool = True, without_id: bool = False) -> DataFrame:
    """``docs`` and a struct ``into``: n_words, n_hit, items, hit_words, hit_spans.

    ``items`` up to ``automaton_bytes`` make one automaton, and texts are scanned
    once, without a shuffle.  More items make several automata of that size: each
    pass adds its hits to those of the passes before it, which are written to the
    shared folder.  So no broadcast exceeds the bound and no item is left out.
    hit_words are the covered runs of words, hit_spans the same stretches of the
    original text in code points; both ends exclusive.  items are ids as strings,
    sorted as such.

    A null text has no words; so has one of punctuation alone.  Very long texts are
    scanned whole.  Items without a
    word have no window; those without an id are scanned if ``without_id``, and then
    count in n_hit and the spans, but not in items.  Equal items count under each id.  Repeated rows
    each get their own struct.  Without items nothing is hit, and an empty table
    gives an empty result.  A column named ``into`` is replaced; others stay.
    """
    batches = _item_batches(items, automaton_bytes, without_id)
    state, run = docs.drop(into), next(batches, [])
    for following in batches:
        state, run = written(_scanned(state, run, window_words, into, True), "decontaminate"), following
    return _scanned(state, run, window_words, into, keep_text)


def _scanned(docs: DataFrame, run: list, window_words: int, into: str, keep_text: bool) -> DataFrame:
    passed = [x for x in docs.columns if x != into and (keep_text or x != "text")]
    fields = [docs.schema[x] for x in passed]
    items, key = docs.sparkSession.sparkContext.broadcast(run), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(key, items, window_words)
        for batch in pieces(batches, "text"):
            before = batch.column(into).to_pylist() if into in batch.schema.names else [None] * batch.num_rows
            found = pa.array([_judge(scanner, text.as_py(), x) for text, x in zip(batch.column("text"), before, strict=True)], FOUND)
            yield pa.RecordBatch.from_arrays([batch.column(x) for x in passed] + [found], names=[*passed, into])

    return docs.mapInArrow(scan, T.StructType([*fields, T.StructField(into, T._parse_datatype_string(FOUND_TYPE))]))


def _judge(scanner: Scanner, text: str | None, before: dict | None) -> dict:
    words = words_of(text)
    hit, found = scanner.scan(words)
    if before:
        found |= set(before["items"])
        for run in before["hit_words"]:
            hit[run["start"] : run["end"]] = True
    runs = _runs(hit) if hit.any() else []
    at = word_spans(text) if runs else []
    return {"n_words": len(words), "n_hit": int(hit.sum()), "items": sorted(found), "hit_words": [{"start": a, "end": b} for a, b in runs], "hit_spans": [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]}


_SCANNERS: dict[str, Scanner] = {}


def _scanner(key: str, items, window_words: int) -> Scanner:
    """One automaton per worker process; only the latest stays."""
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(items.value, window_words)
    return _SCANNERS[key]


def digest(found: DataFrame, of: str = "contamination") -> DataFrame:
    """The flat columns of a report, from :func:`find_contamination`."""
    x = F.col(of)
    return found.select("doc_id", x["n_words"].alias("n_words"), x["n_hit"].alias("n_hit"), F.size(x["items"]).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", x["items"]), 256).alias("items_sha256"), (x["n_hit"] > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, items: DataFrame, window_words: int = WINDOW_WORDS, without_id: bool = False) -> DataFrame:
    """``docs`` without the documents that any window occurs in."""
    into = "contamination"
    while into in docs.columns:
        into += "_"
    return find_contamination(docs, items, window_words, into=into, without_id=without_id).where(F.col(into)["n_hit"] == 0).select(docs.columns)
