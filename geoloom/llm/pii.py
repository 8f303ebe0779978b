"""Personal data: base patterns, and weakly supervised spans beside them.

Spark has no function that gives the places of matches.  But a split by a pattern
and the matches of the same pattern alternate, so their lengths add up to every
start, in code points.  Quantifiers are possessive where what follows can't begin
with the same sign: that changes no match and keeps long runs linear.

Candidates beyond the base get votes from a shape, a gazetteer and a context
labeler.  Expectation-maximisation over the counts of vote patterns, of which
there are at most 27, estimates how far each labeler can be trusted; the resulting
soft labels train a naive Bayes classifier of span features, which decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

KINDS = ("email", "ip", "card", "phone", "credential", "national_id", "local_phone", "hidden_email", "iban", "birth_date", "address", "person")
N_BASE = 4

#: The base patterns.  \G lets a match begin where the last one ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

#: Shapes of candidates.
CREDENTIAL = r"""\b(?i:password|passwd|pwd|passphrase|secret|token|(?:api|access|auth|private)[_-]?key)["']?+[\x20\t]*+[=:][\x20\t]*+["']?+[^\s"']{4,}+|\bAKIA[0-9A-Z]{16}\b|\beyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"""
NATIONAL_ID = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
LOCAL_PHONE = r"(?<![0-9+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
HIDDEN_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[(\[{]at[)\]}] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{]dot[)\]}]) ?[A-Za-z0-9-]++)++"
IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?\b"
BIRTH_DATE = r"(?i)\b(?:born(?: on)?|date of birth|dob|geboren(?: am)?|geburtsdatum|née? le|date de naissance|nacid[oa](?: el)?|fecha de nacimiento)[:\x20]\x20?(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4})(?![0-9])"
ADDRESS = r"\b[0-9]{1,5}\x20(?:[A-Z][a-z]+\x20){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Square|Court)\b|\b[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|weg|platz|allee)\x20[0-9]{1,4}\b|\b[0-9]{1,4},?\x20(?:rue|avenue|boulevard|place)\x20[^\n,;.]{3,40}|\b(?:[Cc]alle|[Aa]venida|[Pp]laza)\x20[^\n,;.0-9]{3,40},?\x20[0-9]{1,4}\b"
PERSON = r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.?\x20[A-ZÀ-Þ][a-zà-ÿ'-]+(?:\x20[A-ZÀ-Þ][a-zà-ÿ'-]+)?"

#: Gazetteers of what ends or begins true spans, and of placeholders.
LISTED = (
    r"(?i)^[\"']?(?:password|passwd|pwd|passphrase|secret|token|(?:api|access|auth|private)[_-]?key)\b|^(?:AKIA|eyJ)"
    r"|(?i)[a-z]\.?(?:com|net|org|edu|gov|io|info|biz|de|at|ch|fr|be|es|pt|it|nl|pl|se|no|dk|fi|uk|ie|eu|us|ca|mx|br|ar|au|nz|in|jp|cn|ru)$"
    r"|^(?:AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HU|IE|IT|LT|LU|LV|MT|NL|NO|PL|PT|RO|SE|SI|SK)[0-9]{2}"
    r"|\b(?:James|John|Robert|Michael|David|Mary|Patricia|Jennifer|Linda|Susan|Hans|Peter|Klaus|Thomas|Anna|Maria|Petra|Jean|Pierre|Michel|Marie|Claire|Sophie|José|Juan|Carlos|Carmen|Ana|Lucía)\b"
)
UNLISTED = r"(?i)[=:]\s*[\"']?(?:none|null|true|false|changeme|example|string|required|optional|\*+|x+|<.*)$|^(?:123|000)-|(?:000|1234)$"

#: Cues before a span, for and against.
FOR = r"(?i)\b(?:phone|tel|telefon|téléphone|teléfono|call|fax|mobile|contact|ssn|social|security|login|user|account|konto|compte|cuenta|iban|key|mail|write|reach|secret|access|address|adresse|dirección|lives|wohnt|patient|customer|dear)\b"
AGAINST = r"(?i)\b(?:version|section|page|isbn|part|serial|order|figure|table|chapter|example|sample|placeholder)\b"
CONTEXT = 40
#: Rounds of estimation between two looks at the change, and the change at which it has come to rest.
ROUNDS, AT_REST = 25, 1e-6

NO, ABSTAIN, YES = 0, 1, 2
SPAN = "array<struct<start:int,end:int,kind:int>>"
FOUND = "array<struct<start:int,end:int,kind:int,value:string,before:string>>"


def _bound(value: Column, body) -> Column:
    return F.transform(F.array(value), body)[0]


def _matches(text: Column, pattern: str, kind: int, present: Column) -> Column:
    """All matches with their places; where ``present`` is false none is looked for."""

    def span(begin: Column, pieces: Column, values: Column, k: Column) -> Column:
        start = begin + F.length(F.get(pieces, k))
        return F.struct(start.alias("start"), (start + F.length(F.get(values, k))).alias("end"), F.lit(kind).alias("kind"), F.get(values, k).alias("value"), F.right(F.get(pieces, k), F.lit(CONTEXT)).alias("before"))

    def located(pieces: Column, values: Column) -> Column:
        """Folds in blocks of the root of their number, since an array that grows by one is copied each time."""
        n = F.size(values)
        edge = F.greatest(F.lit(16), F.floor(F.sqrt(n.cast("double"))).cast("int"))

        def within(b: Column) -> Column:
            return F.sequence(b * edge, F.least(n, (b + 1) * edge) - 1)

        def begins(lengths: Column) -> Column:
            return F.aggregate(lengths, F.array(F.lit(0)), lambda done, x: F.array_append(done, F.element_at(done, -1) + x))

        def fold(b: Column, at: Column) -> Column:
            zero = F.struct(F.get(at, b).alias("at"), F.array().cast(FOUND).alias("out"))

            def step(state: Column, k: Column) -> Column:
                return _bound(span(state["at"], pieces, values, k), lambda one: F.struct(one["end"].alias("at"), F.array_append(state["out"], one).alias("out")))

            return F.aggregate(within(b), zero, step)["out"]

        def blocks(listed: Column) -> Column:
            lengths = F.transform(listed, lambda b: F.aggregate(within(b), F.lit(0), lambda total, k: total + F.length(F.get(pieces, k)) + F.length(F.get(values, k))))
            return _bound(begins(lengths), lambda at: F.flatten(F.transform(listed, lambda b: fold(b, at))))

        every = F.sequence(F.lit(0), F.floor((n - 1) / edge).cast("int"))
        return F.when(n == 0, F.array().cast(FOUND)).otherwise(_bound(every, blocks))

    found = _bound(F.split(text, pattern, -1), lambda p: _bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda v: located(p, v)))
    return F.when(present, found).otherwise(F.array().cast(FOUND))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether 14 to 19 digits pass Luhn's test."""
    signs = F.filter(F.split(F.reverse(_digits(value)), ""), lambda c: c != "")

    def weight(c: Column, k: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(k % 2 == 0, c.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    total = F.aggregate(F.transform(signs, weight), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(_digits(value)).between(14, 19), total % 10 == 0).otherwise(F.lit(False))


def base_spans(text: Column) -> Column:
    """The base matches of a text, each kind on its own, by start and kind."""
    email = _matches(text, EMAIL, 0, text.contains("@"))
    ip = F.filter(_matches(text, IP, 1, text.rlike(r"[0-9]\.[0-9]")), lambda x: x["value"].rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$"))
    card = F.filter(_matches(text, CARD, 2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")), lambda x: _luhn(x["value"]))
    phone = F.filter(_matches(text, PHONE, 3, text.contains("+")), lambda x: F.length(_digits(x["value"])).between(10, 15))
    plain = F.transform(F.concat(email, ip, card, phone), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return F.sort_array(plain)


def candidates(text: Column) -> Column:
    """Matches of the shapes that may hold personal data, with what stands before."""
    digits = text.rlike(r"[0-9]{3}\)?[ .-][0-9]{2}")
    hidden = text.contains("(at)") | text.contains("[at]") | text.contains("{at}")
    keyed = text.rlike(r"[=:]|AKIA|eyJ")
    titled = text.rlike(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora?|Sra?)\b")
    placed = text.rlike(r"[0-9]") & text.rlike(r"\b(?:St|Ave|Rd|Ln|Dr|Blvd|Street|Avenue|Road|Lane|Drive|Boulevard|Square|Court|rue|avenue|boulevard|place)\b|(?i)(?:stra(?:ß|ss)e|weg|platz|allee)\b|\b(?:calle|avenida|plaza)\b")
    born = text.rlike(r"(?i)\b(?:born|birth|dob|geb|né|naiss|nac)")
    shapes = [(CREDENTIAL, keyed), (NATIONAL_ID, digits), (LOCAL_PHONE, digits), (HIDDEN_EMAIL, hidden), (IBAN, text.rlike(r"\b[A-Z]{2}[0-9]{2}")), (BIRTH_DATE, born), (ADDRESS, placed), (PERSON, titled)]
    return F.concat(*(_matches(text, pattern, N_BASE + k, present) for k, (pattern, present) in enumerate(shapes)))


def _iban_holds(value: Column) -> Column:
    """Whether the number that the letters and digits stand for leaves 1 when divided by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))
    digits = F.transform(F.filter(F.split(turned, ""), lambda c: c != ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(digits, F.lit(0), lambda rest, d: (rest * F.when(d > 9, 100).otherwise(10) + d) % 97) == 1


def _votes(kind: Column, value: Column, before: Column) -> list[Column]:
    """What the shape, the gazetteer and the context labeler say of a span."""
    digits = _digits(value)
    credential = value.rlike(r"^(?:AKIA|eyJ)|[=:]\s*[\"']?(?=\S*[0-9])\S{8,}$")
    strict = (
        F.when(kind == 4, credential)
        .when(kind == 5, ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$"))
        .when(kind == 6, digits.rlike("^[2-9][0-9]{2}[2-9]"))
        .when(kind == 7, value.rlike(r"[A-Za-z]{2,}$"))
        .when(kind == 8, _iban_holds(value))
        .when(kind == 9, ~value.rlike("(?:^|[^0-9])(?:00|[4-9][0-9])[./-]"))
        .otherwise(value.rlike(r"^.{6,60}$"))
    )
    shape = F.when(strict, F.lit(YES)).otherwise(F.lit(NO))
    gazetteer = F.when(value.rlike(UNLISTED), F.lit(NO)).when(value.rlike(LISTED), F.lit(YES)).otherwise(F.lit(ABSTAIN))
    context = F.when(before.rlike(FOR), F.lit(YES)).when(before.rlike(AGAINST), F.lit(NO)).otherwise(F.lit(ABSTAIN))
    return [shape, gazetteer, context]


def _features(kind: Column, value: Column, before: Column) -> list[Column]:
    """Bounded features: each is a name and a value of a short list."""
    return [
        F.concat(F.lit("kind="), kind.cast("string")),
        F.concat(F.lit("length="), F.least(F.lit(9), F.floor(F.length(value) / 4)).cast("string")),
        F.concat(F.lit("digits="), F.floor(F.length(_digits(value)) * 4 / F.length(value)).cast("string")),
        F.concat(F.lit("separators="), F.least(F.lit(4), F.length(F.regexp_replace(value, "[A-Za-z0-9]", ""))).cast("string")),
        F.concat(F.lit("mixed="), (value.rlike("[A-Za-z]") & value.rlike("[0-9]")).cast("string")),
        F.concat(F.lit("after="), F.when(before == "", "edge").when(before.rlike(r"\s$"), "blank").when(before.rlike(r"[\"'(:=]$"), "opening").otherwise("sign")),
    ]


def reliabilities(patterns: DataFrame, labelers: int = 3, rounds: int = ROUNDS, begin: list[float] | None = None) -> DataFrame:
    """Some rounds of expectation-maximisation over vote patterns, from ``begin`` on: one row with r.

    ``patterns`` has votes (array) and n, one row for each pattern that occurs.  The
    result is an array: the share of true spans, then for true and after that for
    false spans the probability of each vote of each labeler.  Labelers start out
    better than chance, which settles which class is which.
    """
    start = [0.5] + [0.1, 0.3, 0.6] * labelers + [0.6, 0.3, 0.1] * labelers
    whole = F.sort_array(F.collect_list(F.struct("votes", "n")))

    def step(state: Column, found: Column) -> Column:
        def joint(p: Column, true: bool) -> Column:
            value = F.get(state, F.lit(0)) if true else 1 - F.get(state, F.lit(0))
            for k in range(labelers):
                value = value * F.get(state, p["votes"][k] + (1 + 3 * k + (0 if true else 3 * labelers)))
            return value

        weighed = F.transform(found, lambda p: F.struct(p["votes"].alias("votes"), (p["n"] * joint(p, True) / (joint(p, True) + joint(p, False))).alias("yes"), p["n"].cast("double").alias("n")))

        def estimates(w: Column) -> Column:
            def total(of) -> Column:
                return F.aggregate(w, F.lit(0.0), lambda a, p: a + of(p))

            yes, every = total(lambda p: p["yes"]), total(lambda p: p["n"])
            out = [(yes + 1) / (every + 2)]
            for true in (True, False):
                mass = yes if true else every - yes
                for k in range(labelers):
                    for v in (NO, ABSTAIN, YES):
                        own = total(lambda p, k=k, v=v, true=true: F.when(p["votes"][k] == v, p["yes"] if true else p["n"] - p["yes"]).otherwise(F.lit(0.0)))
                        out.append((own + start[1 + 3 * k + v + (0 if true else 3 * labelers)] * 3) / (mass + 3))
            return F.array(*out)

        return _bound(weighed, estimates)

    table = patterns.agg(whole.alias("found"))
    first = F.array(*(F.lit(float(x)) for x in begin or start))
    return table.select(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, lambda state, _: step(state, F.col("found"))).alias("r"))


def settled(patterns: DataFrame) -> list[float]:
    """The estimates at rest: some fifty numbers over at most 27 patterns, so they are read between the rounds."""
    last = list(reliabilities(patterns).first().r)
    while True:
        now = list(reliabilities(patterns, begin=last).first().r)
        if max(abs(a - b) for a, b in zip(now, last, strict=True)) <= AT_REST:
            return now
        last = now


def _trust(votes: Column, r: Column, labelers: int = 3) -> Column:
    """The probability that a span with these votes is true."""
    yes, no = r[0], 1 - r[0]
    for k in range(labelers):
        yes = yes * F.get(r, F.get(votes, F.lit(k)) + (1 + 3 * k))
        no = no * F.get(r, F.get(votes, F.lit(k)) + (1 + 3 * k + 3 * labelers))
    return yes / (yes + no)


def _classifier(spans: DataFrame) -> DataFrame:
    """feature, weight: log odds of naive Bayes from soft labels; "" has the prior's."""
    each = spans.select("trust", F.explode(F.concat(F.array(F.lit("")), F.col("features"))).alias("feature"))
    sums = each.groupBy("feature").agg(F.sum("trust").alias("yes"), F.sum(1 - F.col("trust")).alias("no"))
    prior = sums.where("feature = ''").select("yes", "no")
    yes, no = prior.select("yes").scalar(), prior.select("no").scalar()
    odds = F.when(F.col("feature") == "", F.log((F.col("yes") + 1) / (F.col("no") + 1))).otherwise(F.log((F.col("yes") + 1) / (yes + 10)) - F.log((F.col("no") + 1) / (no + 10)))
    return sums.select("feature", odds.alias("weight"))


def found(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, base (spans), added (spans): start, kind (place in ``KINDS``), end.

    Null and empty texts have no spans; very long ones are read in whole.  Rows
    that repeat key and text give equal rows.  Ties of start are ordered by kind.
    Added spans never overlap base spans, nor earlier added ones of their kind.
    Without candidates nothing is added; empty tables give empty results.  Columns
    but the two aren't read, whatever their names.
    """
    value = F.coalesce(F.col(text), F.lit(""))
    plain = docs.select(F.col(key).alias("key"), F.xxhash64(value).alias("print"), base_spans(value).alias("base"), candidates(value).alias("found"))
    free = F.filter("found", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    table = written(plain.withColumn("found", free), "pii-spans")
    spans = table.select("key", "print", F.explode("found").alias("x")).select("key", "print", "x.*")
    spans = spans.withColumn("votes", F.array(*_votes(F.col("kind"), F.col("value"), F.col("before")))).withColumn("features", F.array(*_features(F.col("kind"), F.col("value"), F.col("before"))))
    spans = written(spans.drop("value", "before"), "pii-candidates")
    r = settled(written(spans.groupBy("votes").agg(F.count("*").alias("n")), "pii-patterns"))
    trusted = spans.withColumn("trust", _trust(F.col("votes"), F.array(*(F.lit(x) for x in r))))
    weights = written(_classifier(trusted), "pii-classifier")
    model = weights.agg(F.map_from_entries(F.collect_list(F.struct("feature", "weight")))).scalar()
    parts = [F.lit("")] + [F.col("features")[k] for k in range(6)]
    score = sum((F.coalesce(F.try_element_at(F.col("_model"), p), F.lit(0.0)) for p in parts[1:]), F.coalesce(F.try_element_at(F.col("_model"), parts[0]), F.lit(0.0)))
    kept = spans.withColumn("_model", model).where(score > 0)
    added = kept.groupBy("key", "print").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("added"))
    same = table["key"].eqNullSafe(added["key"]) & (table["print"] == added["print"])
    return table.join(added, same, "left").select(table["key"].alias(key), "base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))


def _listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(x) for x in KINDS))
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def _is(kind: int):
    return lambda x: x == kind


def digest(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    kinds = F.transform("base", lambda x: x["kind"])
    counts = [F.size(F.filter(kinds, _is(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(N_BASE)]
    every = F.sort_array(F.concat("base", "added"))
    return spans.select(key, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(every).alias("spans"))
