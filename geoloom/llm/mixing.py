"""Mixing sources to target weights: iterative proportional fitting, then sampling."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop_written, small, written

ROUNDS_PER_STEP = 4
MISSING = "unknown"
TOLERANCE = 1e-4
#: Raking ends where no error within the tolerance can be reached: a step changes the error by less than this.
AT_REST = 1e-6
log = logging.getLogger(__name__)


#: Cue words of each topic in English, German, French and Spanish; ``|`` sets table cells apart.
TOPICS = {
    "table": ("|",),
    "legal": ("license", "licensed", "licence", "copyright", "warranty", "apache", "gnu", "mit", "law", "court", "lizenz", "gesetz", "gericht", "loi", "tribunal", "ley", "derechos"),
    "contact": ("phone", "email", "e-mail", "address", "contact", "fax", "telefon", "adresse", "kontakt", "téléphone", "teléfono", "correo", "dirección"),
    "secrets": ("password", "token", "secret", "login", "api_key", "passwort", "kennwort", "clave", "contraseña"),
    "trade": ("price", "order", "buy", "sale", "shop", "discount", "preis", "kaufen", "angebot", "prix", "acheter", "commande", "precio", "comprar", "oferta"),
    "science": ("theory", "experiment", "data", "method", "research", "theorie", "forschung", "daten", "théorie", "recherche", "données", "teoría", "investigación", "datos"),
    "code": ("def", "class", "return", "import", "function", "var", "const", "void", "public", "int", "{", "}", "};", "=>"),
}
#: A text is of the topic that has the most cues, one word in so many at least; else it is prose.
WORDS_A_CUE = 50
OTHERWISE, MARKS, BLANKS = "prose", ".,;:!?()\"'", r"[\x20\x09-\x0D]+"


def _words(text: Column | str) -> Column:
    return F.array_remove(F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS), "")


def _cue_of(topic: str) -> Callable[[Column], Column]:
    return lambda w: w.isin(*TOPICS[topic]) | w.contains("@") if topic == "contact" else w.isin(*TOPICS[topic])


def topic_of(text: Column | str = "text") -> Column:
    """The topic with the most cue words; ties go to the first in ``TOPICS``.

    Words are compared in lower case without the marks around them; one with an
    ``@`` is a cue of "contact".  One pass over the words keeps the cues, and only
    those few are counted by topic.
    """
    every = sorted({w for cues in TOPICS.values() for w in cues})

    def tidy(w: Column) -> Column:
        return F.lower(F.btrim(w, F.lit(MARKS)))

    def judged(words: Column) -> Column:
        found = F.transform(F.filter(words, lambda w: tidy(w).isin(*every) | w.contains("@")), tidy)

        def most(cues: Column) -> Column:
            counts = [F.struct(F.size(F.filter(cues, _cue_of(name))).alias("n"), F.lit(-place).alias("place"), F.lit(name).alias("name")) for place, name in enumerate(TOPICS)]
            return F.transform(F.array(F.array_max(F.array(*counts))), lambda top: F.when((top["n"] > 0) & (top["n"] * WORDS_A_CUE >= F.size(words)), top["name"]).otherwise(F.lit(OTHERWISE)))[0]

        return F.transform(F.array(found), most)[0]

    return F.transform(F.array(_words(text)), judged)[0]


def n_words(text: Column | str = "text") -> Column:
    """Tokens, counted as runs of visible signs; at least 1, so that every document has weight."""
    return F.greatest(F.size(_words(text)), F.lit(1)).cast("long")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares of one dimension: its tokens to a power; raking normalises them."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("tokens")).withColumn("raw", F.pow(F.col("tokens").cast("double"), F.lit(power)))
    return sums.select(dim, F.col("raw").alias("share"))


def raked(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = TOLERANCE, most_rounds: int = 400) -> tuple[DataFrame, int, float]:
    """``cells`` (dimensions, tokens) with ``weight``, whose shares meet the targets, and a goal in tokens for each dimension.

    ``targets`` maps a dimension to a table (dimension, share).  Shares are
    normalised over the values that have tokens, since no weight can be given to
    others; values without a target get weight 0.  Each round scales the weights
    to one marginal after the other.  Every few rounds the cells are written to
    the shared folder, which cuts the lineage, and the largest error is read; the
    rounds end when it is within the tolerance, or comes to rest above it: then no
    weights meet all targets.  Returns rounds and error, too, which callers check.
    """
    dims = list(targets)
    state = cells.withColumn("weight", F.col("tokens").cast("double"))
    amount = cells.agg(F.sum("tokens").cast("double")).scalar()
    for dim in dims:
        present = written(cells.select(dim).distinct().join(targets[dim], dim).groupBy(dim).agg(F.first("share").alias("share")), "rake-goal")
        goal = present.select(F.col(dim).alias("_value"), (F.col("share") / present.agg(F.sum("share")).scalar() * amount).alias(f"_goal_{dim}"))
        state = state.join(goal, state[dim] == goal["_value"], "left").drop("_value").fillna(0.0, [f"_goal_{dim}"])
    state = written(state, "rake-cells")
    rounds, error, last = 0, float("inf"), None
    while rounds < most_rounds and error > tolerance and (last is None or abs(last - error) > AT_REST):
        old, errors, last = state, [], error
        for _ in range(ROUNDS_PER_STEP):
            for dim in dims:
                state = state.withColumn("weight", _share(dim) * F.col("weight"))
            rounds += 1
        for dim in dims:
            state = state.withColumn(f"_off_{dim}", F.when((F.col(f"_goal_{dim}") > 0) & (F.col("weight") > 0), F.abs(1 / _share(dim) - 1)).otherwise(0.0))
            errors.append(F.max(f"_off_{dim}"))
        checked = written(state, "rake-cells")
        error = float(checked.agg(F.greatest(*errors, F.lit(0.0))).first()[0] or 0.0)
        state = checked.drop(*(f"_off_{x}" for x in dims))
        drop_written(old)
    return state, rounds, error


def _share(dim: str) -> Column:
    """What the weights of one value must be multiplied by to meet its goal."""
    have = F.sum("weight").over(Window.partitionBy(dim))
    return F.when(have > 0, F.col(f"_goal_{dim}") / have).otherwise(F.lit(0.0))


def mixed(docs: DataFrame, dims: Mapping[str, Column], tokens: Column, targets: Mapping[str, Mapping[str, float] | float], key: str = "doc_id", budget_tokens: float | None = None, seed: int = 17, into: str = "mix", budget_share: float | None = None) -> DataFrame:
    """``docs`` and a struct ``into``: the dimensions, tokens, weight, probability, sampled, unmet.

    ``targets`` gives for each dimension either shares by value, or a power to
    which its token shares are raised.  The weight of a cell is its raked tokens
    over its tokens.  Probabilities are weights scaled so that the expected
    tokens are ``budget_tokens``, or ``budget_share`` of all tokens.  A document
    can be sampled but once: cells whose probability would exceed 1 are kept whole,
    and the rest of the budget falls to the others by their weights.  Without a
    budget the largest probability is 1, so that no cell is cut.

    ``unmet`` is how far the expected sample's share of one of the document's values
    is from its target, relative to that, at most: because no weights meet all
    targets, or because cells are kept whole.  What exceeds the tolerance of the
    raking is logged as a warning, too.  A document
    is sampled if a hash of its key and the seed falls below its probability: the
    same document always falls alike, whatever the partitions or lost executors.

    Null dimensions count as the value "unknown"; null keys hash as such.  Equal
    rows are equal draws.  Null texts weigh one token, very long ones all of theirs.  Empty tables give empty
    results.  A column named ``into`` is replaced, all others stay.
    """
    names = list(dims)
    columns = {x: F.coalesce(dims[x].cast("string"), F.lit(MISSING)) for x in names}
    base = docs.drop(into)
    marked = base.withColumn(into, F.struct(*(columns[x].alias(x) for x in names), tokens.alias("tokens")))
    cells = written(marked.select(f"{into}.*").groupBy(*names).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    goals = {x: tempered(cells, x, float(t)) if isinstance(t, int | float) else docs.sparkSession.createDataFrame(list(t.items()), f"{x} string, share double") for x, t in targets.items()}
    weighted, rounds, error = raked(cells, goals)
    rate = F.col("weight") / F.col("tokens")
    if budget_share is not None:
        budget_tokens = budget_share * float(cells.agg(F.sum("tokens")).first()[0] or 0)
    scale = _scale(weighted, budget_tokens)
    ratio = weighted.withColumn("p", F.coalesce(F.least(F.lit(1.0), rate * scale), F.lit(0.0)))
    expected, goal = F.col("tokens") * F.col("p"), lambda x: F.col(f"_goal_{x}")
    whole, amount = ratio.agg(F.sum(expected), F.sum(F.col("tokens").cast("double"))).first()
    off = [F.when(goal(x) > 0, F.abs(F.sum(expected).over(Window.partitionBy(x)) / F.lit(whole or 1.0) / (goal(x) / F.lit(amount or 1.0)) - 1)).otherwise(0.0) for x in names]
    ratio = written(ratio.withColumn("unmet", F.greatest(*off, F.lit(0.0))), "mix-ratios")
    far = ratio.where(F.col("unmet") > TOLERANCE).orderBy(F.desc("unmet")).limit(10).collect()
    if far:
        log.warning("targets unmet after %d rounds (error %.3g); the furthest cells: %s", rounds, error, ", ".join(f"{tuple(r[x] for x in names)} by {r.unmet:.3g}" for r in far))
    ratio = ratio.select(*(F.col(x).alias(f"_{into}_{x}") for x in names), rate.alias(f"_{into}_w"), F.col("p").alias(f"_{into}_p"), F.col("unmet").alias(f"_{into}_unmet"))
    same = None
    for x in names:
        one = F.col(into)[x] == F.col(f"_{into}_{x}")
        same = one if same is None else same & one
    draw = (F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))).cast("double")
    out = marked.join(small(ratio, 160), same)
    p = F.col(f"_{into}_p")
    return out.withColumn(into, F.col(into).withField("weight", F.col(f"_{into}_w")).withField("probability", p).withField("sampled", draw < p).withField("unmet", F.col(f"_{into}_unmet"))).drop(*(f"_{into}_{x}" for x in (*names, "w", "p", "unmet")))


def _scale(weighted: DataFrame, budget: float | None) -> float:
    """What turns weights over tokens into probabilities; above 1 they count as 1.

    With a budget each round takes out the cells that reach 1; the scale grows, so
    the rounds end when no further cell does.
    """
    rate, tokens = F.col("weight") / F.col("tokens"), F.col("tokens").cast("double")
    least, top, most = weighted.where("weight > 0").agg(F.min(rate), F.max(rate), F.sum(tokens)).first()
    if top is None:
        return 0.0
    if budget is None:
        return 1 / top
    if budget >= most:
        return (1 + 1e-9) / least
    scale, whole = 0.0, None
    while True:
        full = rate * scale >= 1
        n, taken, left = weighted.where("weight > 0").agg(F.count_if(full), F.sum(F.when(full, tokens).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == whole or not left:
            return scale
        scale, whole = (budget - taken) / left, n


PRODUCTION_DIMS = ("source", "lang", "topic")
#: Powers below 1: large sources, languages and topics give way to small ones.
PRODUCTION_TARGETS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
#: The expected sample's part of all tokens.
PRODUCTION_BUDGET = 0.5


def production_mix(docs: DataFrame, into: str = "mix") -> DataFrame:
    return mixed(docs, {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of()}, n_words(), PRODUCTION_TARGETS, into=into, budget_share=PRODUCTION_BUDGET)


def sampled_documents(docs: DataFrame) -> DataFrame:
    """``docs`` that the production mix samples, with their own columns."""
    into = "mix"
    while into in docs.columns:
        into += "_"
    return production_mix(docs, into).where(F.col(into)["sampled"]).select(docs.columns)


def digest(found: DataFrame, of: str = "mix") -> DataFrame:
    x = F.col(of)
    return found.select("doc_id", *(x[n].alias(n) for n in (*PRODUCTION_DIMS, "tokens", "weight", "probability", "sampled", "unmet")))
