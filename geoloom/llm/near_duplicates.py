"""Near-duplicate groups: ProbMinHash, banding, exact verification, components.

The flow, each step a table in the shared folder, so that a lost executor costs
a reread and no step repeats another:

1. signatures: one row a document, with a fingerprint of its words and band keys;
2. documents of equal words fold into the least doc_id (partial aggregation);
3. members of a bucket are compared with two leaders alone, those that share the
   most buckets: the pairs are a fixed multiple of the members, however large the bucket;
4. verified links give components, by alternating star contractions;
5. where a bucket's other members lie in several components, all their pairs of
   different components that can reach the similarity are found by rare shingles
   (see ``_undecided_pairs``), compared and linked.  So no link between two texts
   of a bucket is lost, and no group is expanded into all its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .decontaminate import words_of
from .probminhash import band_keys, probability_jaccard, shingles, signatures
from .shared import Scratch, drop_written, pieces, small, small_batches, written

#: 20 bands of 4 registers find a pair of similarity 0.8 but for 3 in 100,000.
BANDS, ROWS, SIMILARITY = 20, 4, 0.8
#: Leaders of a bucket: one for each of so many parts of it.
LEADERS = 2
#: Pairs of one document that a task compares; more are dealt over several.
HOT_PAIRS = 512
#: A similarity that falls short by no more than this, by the rounding of sums, counts as reached.
ROUNDING = 1e-9
#: Bytes that an id takes in a broadcast.
ID_BYTES = 16


def _documents(docs: DataFrame) -> DataFrame:
    """doc_id and text of each document: ids that several rows have get the least text of theirs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    several = _repeated(rows)
    if several is None:
        return rows
    once = rows.join(several, rows["doc_id"] == several["_id"], "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return rows.join(several, rows["doc_id"] == several["_id"], "left_anti").unionByName(once)


def _repeated(rows: DataFrame) -> DataFrame | None:
    """The ids of more than one row, if there are any."""
    several = written(rows.groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("n")).where("n > 1 and _id is not null").select("_id"), "repeated-ids")
    if several.isEmpty():
        drop_written(several)
        return None
    return small(several, ID_BYTES)


def signature_table(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, fp (of the words in order), n_shingles, keys (null without a word)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            texts = batch.column("text").to_pylist()
            owner, hashes, weights = shingles(texts)
            counts = np.bincount(owner, minlength=len(texts))
            keys = band_keys(signatures(owner, hashes, weights, len(texts), bands * rows), bands)
            listed = [k.tolist() if n else None for k, n in zip(keys, counts.tolist(), strict=True)]
            prints = [hashlib.blake2b(b" ".join(words_of(x)), digest_size=16).digest() for x in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.binary()), pa.array(counts, pa.int64()), pa.array(listed, pa.list_(pa.int64()))], names=["doc_id", "fp", "n_shingles", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(sign, "doc_id long, fp binary, n_shingles long, keys array<long>")


def _joined_texts(pairs: DataFrame, side: str, other: str, texts: DataFrame, keep: Scratch) -> DataFrame:
    """``pairs`` with the text of one side.

    A document of many pairs, a leader of a large group, would draw them all into
    one task: its pairs are dealt over parts of ``HOT_PAIRS``, each with a copy of its text.
    """
    hot = keep(pairs.groupBy(F.col(side).alias("_hot")).agg((F.count("*") / HOT_PAIRS).cast("int").alias("_parts")).where("_parts > 0"), "hot")
    texts = texts.select(F.col("id").alias("_id"), F.col("text").alias(f"{side}_text"))
    if hot.isEmpty():
        return pairs.join(texts, pairs[side] == texts["_id"]).drop("_id")
    hot = small(hot)
    dealt = pairs.join(hot, pairs[side] == hot["_hot"], "left").withColumn("_part", F.pmod(F.xxhash64(other), F.coalesce("_parts", F.lit(0)) + 1)).drop("_hot", "_parts")
    copies = texts.join(hot, texts["_id"] == hot["_hot"], "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(0))))).drop("_hot", "_parts")
    return dealt.join(copies, (dealt[side] == copies["_id"]) & (dealt["_part"] == copies["_copy"])).drop("_id", "_part", "_copy")


def _compared(pairs: DataFrame, texts: DataFrame, keep: Scratch) -> DataFrame:
    """Pairs (hi, lo) with their texts' exact probability Jaccard."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "hi_text", "lo_text"):
            sides = batch.column("hi_text").to_pylist(), batch.column("lo_text").to_pylist()
            place = {x: k for k, x in enumerate(dict.fromkeys(sides[0] + sides[1]))}
            owner, hashes, weights = shingles(list(place))
            cuts = np.searchsorted(owner, np.arange(len(place) + 1))
            sets = [(hashes[a:b], weights[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            found = [probability_jaccard(sets[place[x]], sets[place[y]]) for x, y in zip(*sides, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("hi"), batch.column("lo"), pa.array(found, pa.float64())], names=["hi", "lo", "j"])

    sided = _joined_texts(_joined_texts(pairs, "hi", "lo", texts, keep), "lo", "hi", texts, keep)
    return sided.select("hi", "lo", "hi_text", "lo_text").mapInArrow(check, "hi long, lo long, j double")


def components(edges: DataFrame) -> DataFrame:
    """node, label: each node of the links (hi, lo) with the least node it reaches.

    Alternates large and small star contractions until a round changes nothing;
    each round is a table in the shared folder.
    """
    state = written(edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi != lo").distinct(), "stars")
    seen = None
    while True:
        both = state.select(F.col("hi").alias("a"), F.col("lo").alias("b")).union(state.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
        # The hub of a star has many edges: they meet its least one as a broadcast, or in a join that splits skewed keys.
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "stars-least")
        large = both.join(small(least), "a").where("b > a").select(F.col("b").alias("hi"), F.col("m").alias("lo")).distinct()
        lows = large.groupBy("hi").agg(F.min("lo").alias("m"))
        after = large.join(lows, "hi").select(F.explode(F.array(F.struct("hi", F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo").where("hi != lo").distinct()
        after = written(after, "stars")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        drop_written(state)
        drop_written(least)
        state = after
        if now == seen or not now[0]:
            break
        seen = now
    return state.select(F.col("hi").alias("node"), F.col("lo").alias("label"))


def _bound(common_x: Column, common_y: Column) -> Column:
    """The most that the probability Jaccard of x and y can be, given the most weight each may have in common.

    With a and b as the shares of their weights in common it is at most 1 / (1 / a + 1 / b - 1).  A common shingle's
    weights differ by no more than the greater exceeds 1, so neither common weight exceeds the other's by more than the repeats.
    """
    a = F.least(common_x, common_y + F.col("x_repeats")) / F.col("x_weight")
    b = F.least(common_y, common_x + F.col("y_repeats")) / F.col("y_weight")
    return F.when((a > 0) & (b > 0), a * b / (a + b - a * b)).otherwise(0.0)


def _open_members(rest: DataFrame, labels: DataFrame, keep: Scratch) -> DataFrame:
    """id, label, size, asks: the members that a bucket leaves undecided.

    ``rest`` are bucket members (key, member) that lead no bucket of this key.  Two
    of them that have different labels may be linked, and no comparison has told yet.  Of each such
    pair, the one of the smaller component (by members here, then label) asks.
    """
    rest = rest.join(labels, rest["member"] == labels["node"], "left").select("key", "member", F.coalesce("label", "member").alias("label"))
    rest = keep(rest, "labelled")
    mixed = rest.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).where("a != b").select("key")
    rest = keep(rest.join(small(keep(mixed, "open-keys")), "key", "left_semi"), "open-buckets")
    sizes = keep(rest.select("member", "label").distinct().groupBy(F.col("label").alias("_label")).agg(F.count("*").alias("size")), "sizes")
    rest = rest.join(small(sizes), rest["label"] == sizes["_label"]).drop("_label")
    top = keep(rest.groupBy("key").agg(F.max(F.struct("size", "label")).alias("top")).select(F.col("key").alias("_key"), F.col("top.label").alias("top")), "tops")
    rest = rest.join(small(top), rest["key"] == top["_key"])
    return keep(rest.groupBy(F.col("member").alias("id")).agg(F.first("label").alias("label"), F.first("size").alias("size"), F.max(F.col("label") != F.col("top")).alias("asks")), "open")


def _shingle_rows(texts: DataFrame) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            owner, hashes, weights = shingles(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)), pa.array(hashes.view(np.int64)), pa.array(weights.astype(np.int64))], names=["id", "z", "w"])

    return texts.select("id", "text").mapInArrow(spread, "id long, z long, w long")


def _undecided_pairs(members: DataFrame, texts: DataFrame, similarity: float, keep: Scratch) -> DataFrame:
    """All pairs (hi, lo) of open members that may be similar, found by their rarest common shingles.

    Exact, whatever the group's size: a pair of the similarity t has at least the share t
    of either weight in common.  So of the asking one's shingles, from the rarest
    on, those up to 1 - t of its weight hold a common one; a shingle that no other
    open member has is in none.  In a group of edits of one text, the
    texts with many edits of their own drop out at once, and the others have few rare shingles that someone shares.
    """
    rows = keep(_shingle_rows(texts.join(small(members.select(F.col("id").alias("_id")), ID_BYTES), F.col("id") == F.col("_id"), "left_semi")), "shingles")
    often = keep(rows.groupBy("z").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    common = keep(rows.join(often, "z").select("id", "z", "w", "df"), "common")
    whole = rows.groupBy("id").agg(F.sum("w").alias("weight"), (F.sum("w") - F.count("*")).alias("repeats"))
    within = common.groupBy(F.col("id").alias("_id")).agg(F.sum("w").alias("shared"))
    stats = whole.join(within, F.col("id") == F.col("_id")).drop("_id").where(F.col("shared") >= similarity * F.col("weight") - ROUNDING)
    stats = keep(stats.join(members, "id"), "stats")
    rarest = Window.partitionBy("id").orderBy("df", "z").rowsBetween(Window.unboundedPreceding, -1)
    asking = common.join(small(stats.where("asks")), "id").withColumn("left", F.col("shared") - F.coalesce(F.sum("w").over(rarest), F.lit(0)))
    asking = asking.where(F.col("left") >= similarity * F.col("weight") - ROUNDING)
    asking = keep(asking.select("z", "left", *(F.col(x).alias(f"x_{x}") for x in ("id", "label", "size", "weight", "repeats"))), "asking")
    asked = common.join(small(keep(asking.select("z").distinct(), "asked")), "z", "left_semi").join(small(stats), "id")
    asked = asked.select("z", *(F.col(x).alias(f"y_{x}") for x in ("id", "label", "size", "weight", "repeats", "shared")))
    larger = (F.col("y_size") > F.col("x_size")) | ((F.col("y_size") == F.col("x_size")) & (F.col("y_label") > F.col("x_label")))
    met = asked.join(small(asking, 96), "z").where(larger & (_bound(F.col("left"), F.col("y_shared")) >= similarity - ROUNDING))
    return met.select(F.greatest("x_id", "y_id").alias("hi"), F.least("x_id", "y_id").alias("lo")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row a document: doc_id, rep_id (least id of equal words), class_id.

    ``docs`` has doc_id and text; other columns, whatever their names, aren't
    read.  class_id is the least doc_id of the documents that verified links
    join.  Texts without a word, null or not, are alone in their class.  Rows
    without a doc_id give no row, since no id can stand for them.  Rows that repeat
    a doc_id are one document, given once, whose text is the least of theirs.  Very
    long texts are compared whole.  An empty table gives an empty result.
    """
    documents = _documents(docs)
    with small_batches(docs.sparkSession), Scratch(docs.sparkSession, "near-duplicates") as keep:
        table = keep(signature_table(documents, bands, rows), "signatures")
        full = table.where("n_shingles > 0")
        reps = full.groupBy("fp").agg(F.min(F.struct("doc_id", "keys")).alias("r")).select("fp", F.col("r.doc_id").alias("rep_id"), F.col("r.keys").alias("keys"))
        reps = keep(reps, "representatives")

        members = reps.select(F.col("rep_id").alias("member"), F.explode("keys").alias("key"))
        shared = keep(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "bucket-sizes")
        led = keep(members.join(small(shared), "key"), "buckets")
        # What meets the most others leads: in a group of edits of one text that is what is nearest to it.
        meets = keep(led.groupBy("member").agg(F.sum("n").alias("meets")), "meetings")
        split = F.pmod(F.xxhash64("member"), F.lit(LEADERS)).alias("split")
        first = led.join(small(meets), "member").groupBy("key", split).agg(F.max(F.struct("meets", (-F.col("member")).alias("minus"))).alias("l"))
        leaders = keep(first.select("key", (-F.col("l.minus")).alias("leader")), "leaders")

        ids = small(meets.select(F.col("member").alias("_id")), ID_BYTES)
        texts = keep(documents.join(ids, documents["doc_id"] == ids["_id"], "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")
        pairs = led.select("key", "member").join(small(leaders), "key").where("member != leader")
        pairs = keep(pairs.select(F.greatest("member", "leader").alias("hi"), F.least("member", "leader").alias("lo")).distinct(), "pairs")
        labels = components(_compared(pairs, texts, keep).where(F.col("j") >= similarity - ROUNDING).select("hi", "lo"))

        lead = small(leaders.select(F.col("key").alias("_key"), "leader"))
        rest = led.select("key", "member").join(lead, (F.col("key") == F.col("_key")) & (F.col("member") == F.col("leader")), "left_anti")
        undecided = _open_members(rest, small(labels), keep)
        if not undecided.isEmpty():
            pairs = keep(_undecided_pairs(undecided, texts, similarity, keep), "undecided")
            more = keep(_compared(pairs, texts, keep).where(F.col("j") >= similarity - ROUNDING).select("hi", "lo"), "links")
            if not more.isEmpty():
                before, labels = labels, components(labels.select(F.col("node").alias("hi"), F.col("label").alias("lo")).unionByName(more))
                drop_written(before)

        named = full.select("doc_id", "fp").join(reps.select("fp", "rep_id"), "fp").join(small(labels), F.col("rep_id") == F.col("node"), "left")
        named = named.select("doc_id", "rep_id", F.coalesce("label", "rep_id").alias("class_id"))
        wordless = table.where("n_shingles = 0").select("doc_id", F.col("doc_id").alias("rep_id"), F.col("doc_id").alias("class_id"))
        result = written(named.unionByName(wordless), "near-duplicate-classes")
        drop_written(labels)
    return result


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the documents that aren't the first of their class.

    Rows without a doc_id stay, since they can't be told apart.  Of the rows that
    repeat a doc_id, one of the least text stays (nulls last).  Everything else as in :func:`near_duplicates`.
    """
    classes = near_duplicates(docs, similarity)
    gone = written(classes.where("doc_id != class_id").select(F.col("doc_id").alias("_gone")), "near-copies")
    drop_written(classes)
    left = docs.join(small(gone, ID_BYTES), docs["doc_id"] == gone["_gone"], "left_anti").select(docs.columns)
    several = _repeated(docs.select(F.col("doc_id").cast("long").alias("doc_id")))
    if several is None:
        return left
    # The least of an id's rows, by partial aggregation: an id may have any number of them.
    columns = [F.col(f"`{x}`") for x in docs.columns]
    tie = F.xxhash64(*(c for c, x in zip(columns, docs.schema.fields, strict=True) if not isinstance(x.dataType, T.MapType | T.VariantType)))
    least = F.min_by(F.struct(*columns), F.struct(F.col("text").isNull(), "text", tie)).alias("row")
    once = left.join(several, left["doc_id"] == several["_id"], "left_semi").groupBy("doc_id").agg(least).select("row.*")
    return left.join(several, left["doc_id"] == several["_id"], "left_anti").unionByName(once)
