"""Quality rules: a threshold table compiled into one projection.

Every measure comes from one pass over the words of a text.  Words, lines and
windows are bound once as lambda variables, so that no expression is evaluated
again for each element, and nothing is exploded or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "as", "with", "was", "on", "are", "be", "this", "from", "or", "an", "at", "by", "a",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "im", "des", "dem", "ein", "eine", "auf", "nicht", "auch", "als", "für", "ist",
    "le", "la", "les", "de", "et", "un", "une", "que", "qui", "dans", "est", "du", "pour", "par", "pas", "en",
    "el", "los", "las", "y", "se", "por", "para", "con", "no", "su", "lo", "al",
)

BLANKS = r"[\x20\x09-\x0D]+"
VISIBLE = r"[^\x20\x09-\x0D]"
BLANK_SIGNS, SYMBOLS, MARKS = " \t\n\x0b\f\r", "#*$%&|<>", ".,;:!?"


@dataclass(frozen=True)
class Rule:
    """Fails where numerator / denominator isn't within [low, high]; passes where the denominator is 0."""

    name: str
    numerator: str
    denominator: str
    low: float
    high: float

    def passes(self, measures: Column) -> Column:
        top, bottom = measures[self.numerator].cast("double"), measures[self.denominator].cast("double")
        return (bottom == 0) | ((top >= F.lit(self.low) * bottom) & (top <= F.lit(self.high) * bottom))


#: The production table.  Lengths and ratios of plain prose in the four languages lie well inside.
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 14.0),
    Rule("symbols", "n_symbols", "n_words", 0.0, 0.1),
    Rule("stop_words", "n_stop_words", "n_words", 0.05, 1.0),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 0.0, 0.5),
    Rule("shouting", "n_marked", "n_words", 0.0, 0.1),
)


def measures(text: Column | str = "text") -> Column:
    """A struct of counts of one text; all 0 for a null text."""
    text = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))

    def of(t: Column) -> Column:
        words = F.array_remove(F.split(t, BLANKS), "")
        lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(VISIBLE))
        return _bound(words, lambda w: _bound(lines, lambda x: _counts(t, w, x)))

    return _bound(text, of)


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once."""
    return F.transform(F.array(value), body)[0]


def _counts(t: Column, words: Column, lines: Column) -> Column:
    def removed(signs: str) -> Column:
        return F.length(F.translate(t, signs, "")).cast("long")

    return F.struct(
        F.size(words).cast("long").alias("n_words"),
        removed(BLANK_SIGNS).alias("word_chars"),
        (F.length(t) - removed(SYMBOLS)).alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(words, lambda w: F.lower(F.rtrim(w, F.lit(MARKS))).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.filter(words, lambda w: w.endswith("!!"))).cast("long").alias("n_marked"),
        _repeated(words).alias("n_repeat_words"),
    )


def _repeated(words: Column) -> Column:
    """Words in three-word windows that a text has twice or more.

    A text whose windows have as many hashes has none twice.  Else windows are sorted
    by their hash and then by their words, so equal ones stand side by side, and a
    collision of hashes can't join two that differ.
    """

    def at(i: Column) -> list[Column]:
        return [F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)]

    def window(i: Column) -> Column:
        return F.struct(F.xxhash64(*at(i)).alias("h"), *(x.alias(f"w{k}") for k, x in enumerate(at(i))), i.alias("i"))

    def twins(ordered: Column) -> Column:
        def equal(a: Column, b: Column) -> Column:
            return (a["h"] == b["h"]) & (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"])

        def beside(x: Column, k: Column) -> Column:
            same = F.coalesce(equal(x, F.get(ordered, k - 1)), F.lit(False)) | F.coalesce(equal(x, F.get(ordered, k + 1)), F.lit(False))
            return F.when(same, x["i"])

        return F.sort_array(F.array_compact(F.transform(ordered, beside)))

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, k: F.least(F.lit(3), F.coalesce(x - F.get(starts, k - 1), F.lit(3))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)

    none, places = F.lit(0).cast("long"), F.sequence(F.lit(0), F.size(words) - 3)
    several = _bound(F.sort_array(F.transform(places, window)), lambda o: _bound(twins(o), covered))
    hashes = F.transform(places, lambda i: F.xxhash64(*at(i)))
    return F.when(F.size(words) < 3, none).otherwise(_bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(several)))


def base_failed(m: Column) -> Column:
    """Under 50 words, or over half of them in repeated windows."""
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "quality") -> DataFrame:
    """``docs`` and a struct ``into``: the counts, base_failed, kept and failed (names of rules).

    A null or empty text has no words, so its base fails; so does any text of
    under 50 words.  Repeated rows are judged alike, each on its own; ties can't
    arise.  An empty table gives an empty result.  A column named ``into`` is
    replaced, every other column stays as it is.
    """
    m, q = F.col(into), F.col(into)
    others = [F.col(f"`{x}`") for x in docs.columns if x != into]
    # A generator, so that a filter on the verdict doesn't copy the measures into itself.
    found = docs.select(*others, F.explode(F.array(measures(text))).alias(into))
    failed = F.array_compact(F.array(*(F.when(~r.passes(m), F.lit(r.name)) for r in rules))) if rules else F.array().cast("array<string>")
    return found.withColumn(into, q.withField("base_failed", base_failed(m)).withField("failed", failed)).withColumn(into, q.withField("kept", ~q["base_failed"] & (F.size(q["failed"]) == 0)))


def kept_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` that pass the base and every rule, with their own columns."""
    into = "quality"
    while into in docs.columns:
        into += "_"
    return judged(docs, rules, into=into).where(F.col(into)["kept"]).select(docs.columns)


def digest(found: DataFrame, of: str = "quality") -> DataFrame:
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *(F.col(of)[x].alias(x) for x in names))


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same digest in DuckDB's SQL, from the same table of rules."""
    verdict = " and ".join(f"({r.denominator} = 0 or ({r.numerator}::double >= {r.low}::double * {r.denominator} and {r.numerator}::double <= {r.high}::double * {r.denominator}))" for r in rules)
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
    w as (select doc_id, t, list_filter(regexp_split_to_array(t, '{BLANKS}'), lambda x: x <> '') as ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{VISIBLE}')) as ls from d),
    win as (select doc_id, i, ws[i] as a, ws[i + 1] as b, ws[i + 2] as c from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) > 2)),
    twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from win) where n > 1),
    rep as (select doc_id, count(distinct i + k)::bigint as n_repeat_words from twice, range(3) as r(k) group by doc_id),
    m as (select w.doc_id, len(ws)::bigint as n_words, length(translate(t, {blanks}, ''))::bigint as word_chars,
                 (length(t) - length(translate(t, '{SYMBOLS}', '')))::bigint as n_symbols, len(ls)::bigint as n_lines,
                 (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
                 len(list_filter(ws, lambda x: lower(rtrim(x, '{MARKS}')) in ({stop})))::bigint as n_stop_words,
                 len(list_filter(ws, lambda x: ends_with(x, '!!')))::bigint as n_marked,
                 coalesce(n_repeat_words, 0)::bigint as n_repeat_words
          from w left join rep using (doc_id)),
    b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m)
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {verdict} as kept from b
    """
