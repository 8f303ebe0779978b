"""URL verdicts: rules first, then the ratio of two character Markov models.

Accepted and rejected URLs, as the rules decide them, each train a smoothed
variable-order model over a reduced alphabet of 32 signs.  Contexts have up to
three signs, so a model has 32 ** 4 entries at most, whatever the corpus; the
difference of both logarithms is one array of that size.  URLs are scored in a
projection, without a join.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: Rule -> verdict.  A rule is a host and the start of a path.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}

SIGNS, ORDER = 32, 3
BLOCK = SIGNS * SIGNS
BINS = 100  # score bins per unit
EDGE = 1_000  # bins are clamped here
FOLDS = 5


def host_and_path(url: Column | str = "url") -> tuple[Column, Column]:
    """Host and path; both empty where the url is null or lacks ``://``."""
    url = F.col(url) if isinstance(url, str) else url
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, else null; of equally long ones the first by text."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), [-ord(c) for c in r])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def grams(url: Column) -> Column:
    """The four-sign windows of a url as numbers, with three edges before and one after.

    Letters count without case, all digits as one sign; slash, dot and hyphen have
    their own; everything else is one sign.
    """
    own = string.ascii_lowercase + string.digits + "/.-"
    to = string.ascii_uppercase + "[" * 10 + "\\]_"
    masked = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "^[a-z]*://", ""), "[^a-z0-9/.\\-]", "^")
    signs = F.concat(F.lit("@@@"), F.translate(masked, own, to), F.lit("@"))
    codes = F.transform(F.split(signs, ""), lambda c: F.ascii(c) - 64)

    def windows(c: Column) -> Column:
        return F.transform(F.sequence(F.lit(ORDER), F.size(c) - 1), lambda i: ((F.get(c, i - 3) * SIGNS + F.get(c, i - 2)) * SIGNS + F.get(c, i - 1)) * SIGNS + F.get(c, i))

    return F.transform(F.array(F.filter(codes, lambda c: c >= 0)), windows)[0]


def ratio_model(labelled: DataFrame) -> DataFrame:
    """block, ratios: log p(sign | context, accepted) - log p(..., rejected), 1,024 to a row.

    ``labelled`` has url and accepted (boolean).  Each order interpolates with the
    one below by Witten and Bell's weights: a context seen n times with t different
    signs gives t / (n + t) to the shorter context.  Unseen contexts give it all.
    """
    exploded = labelled.select(F.explode(grams(F.col("url"))).alias("gram"), "accepted")
    yes, no = F.sum(F.col("accepted").cast("long")), F.sum((~F.col("accepted")).cast("long"))
    seen = written(exploded.groupBy("gram").agg(yes.alias("n_yes"), no.alias("n_no")), "url-grams")
    below = labelled.sparkSession.range(1).select(F.lit(0).cast("long").alias("id"), F.lit(1.0 / SIGNS).alias("yes"), F.lit(1.0 / SIGNS).alias("no"))
    width = 1
    for order in range(ORDER + 1):
        size = SIGNS ** (order + 1)
        counted = seen.groupBy((F.col("gram") % size).cast("long").alias("id")).agg(F.sum("n_yes").alias("n_yes"), F.sum("n_no").alias("n_no"))
        sides = [x for side in ("yes", "no") for x in (F.sum(f"n_{side}").alias(f"all_{side}"), F.sum((F.col(f"n_{side}") > 0).cast("long")).alias(f"kinds_{side}"))]
        contexts = counted.groupBy(F.expr("id div 32").alias("context")).agg(*sides)
        entries = labelled.sparkSession.range(size).select("id", F.expr("id div 32").alias("context"), (F.col("id") % width).alias("shorter"))
        entries = entries.join(counted, "id", "left").join(contexts, "context", "left").join(below.withColumnsRenamed({"id": "shorter", "yes": "below_yes", "no": "below_no"}), "shorter")

        def smoothed(side: str) -> Column:
            n, total, kinds = (F.coalesce(F.col(f"{x}_{side}"), F.lit(0)) for x in ("n", "all", "kinds"))
            return F.when(total > 0, (n + kinds * F.col(f"below_{side}")) / (total + kinds)).otherwise(F.col(f"below_{side}"))

        below, width = entries.select("id", smoothed("yes").alias("yes"), smoothed("no").alias("no")), size
    pairs = below.select(F.expr(f"id div {BLOCK}").alias("block"), F.struct("id", (F.log("yes") - F.log("no")).cast("float").alias("r")).alias("e"))
    return pairs.groupBy("block").agg(F.sort_array(F.collect_list("e"))["r"].alias("ratios"))


def _scored(rows: DataFrame, url: str, model: DataFrame, into: str = "score") -> DataFrame:
    """``rows`` and the sum of ratios over a url's windows, divided by their number.

    The array is a scalar subquery.  The optimizer folds its projection into the
    next one, since that uses it once, so no row ever carries it.
    """
    whole = model.agg(F.flatten(F.sort_array(F.collect_list(F.struct("block", "ratios")))["ratios"])).scalar()
    with_model = rows.withColumn("_model", whole)
    bound = F.array(F.struct(grams(F.col(url)).alias("g"), F.col("_model").alias("m")))
    score = F.transform(bound, lambda x: F.aggregate(x["g"], F.lit(0.0), lambda total, g: total + F.get(x["m"], g)) / F.size(x["g"]))[0]
    return with_model.select(*(F.col(f"`{x}`") for x in rows.columns), score.alias(into))


def _bin(score: Column) -> Column:
    return F.least(F.greatest(F.floor(score * BINS), F.lit(-EDGE)), F.lit(EDGE)).cast("long")


def calibrated(scored: DataFrame) -> int:
    """The least bin to accept: it minimises the sum of both error rates.

    ``scored`` has score and accepted.  All bins between two that occur have equal
    errors.  Ties go to the bin nearest 0, where both models find a URL as likely, then
    to the lower one; without URLs of both kinds it is 0.  At most 2,001 rows of
    counts are compared.
    """
    yes, no = F.col("accepted").cast("long"), (~F.col("accepted")).cast("long")
    bins = scored.groupBy(_bin(F.col("score")).alias("bin")).agg(F.sum(yes).alias("yes"), F.sum(no).alias("no"))
    before, every = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lowest = F.coalesce(F.lag("bin").over(Window.orderBy("bin")) + 1, F.lit(-EDGE))
    errors = bins.select(F.least("bin", F.greatest(F.lit(0), lowest)).alias("bin"), F.coalesce(F.sum("yes").over(before), F.lit(0)).alias("missed"), F.coalesce(F.sum("no").over(before), F.lit(0)).alias("caught"), F.sum("yes").over(every).alias("all_yes"), F.sum("no").over(every).alias("all_no"))
    rate = F.col("missed") / F.col("all_yes") + (F.col("all_no") - F.col("caught")) / F.col("all_no")
    best = errors.where("all_yes > 0 and all_no > 0").orderBy(rate, F.abs("bin"), "bin").select("bin").first()
    return int(best[0]) if best else 0


def judged(pages: DataFrame, rules: dict[str, str] = RULES, key: str = "page_id", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score and verdict.

    All URLs that a rule decides train the models, but for one in five (by a hash
    of the key), on which the threshold is calibrated.  Every other URL is allowed
    if its score reaches the threshold.  Null and empty URLs have no host, path or
    rule, and the score of an empty text; very long ones are scored in whole.
    Repeated rows are judged alike.  Without URLs of one kind that model is
    uniform, and an empty table gives an empty result.  Columns of these five names are replaced; others stay.
    """
    host, path = host_and_path(url)
    out = pages.drop(*(x for x in ("host", "path", "rule", "score", "verdict") if x not in (key, url)))
    ruled = out.withColumn("host", host).withColumn("path", path).withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    allowed = F.col("rule").isin([r for r, v in rules.items() if v == "allow"])
    held = F.coalesce(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % FOLDS == 0, F.lit(False))
    labelled = ruled.where("rule is not null").select(F.col(url).alias("url"), allowed.alias("accepted"), held.alias("held"))
    model = written(ratio_model(labelled.where("not held")), "url-model")
    least = calibrated(_scored(labelled.where("held"), "url", model))
    scored = _scored(ruled, url, model)
    verdict = F.when(F.col("rule").isNotNull(), F.when(allowed, "allow").otherwise("block")).otherwise(F.when(_bin(F.col("score")) >= least, "allow").otherwise("block"))
    return scored.withColumn("verdict", verdict)
