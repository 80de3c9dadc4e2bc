"""URL filters: rules first, then the ratio of two character language models.

Models: variable-order Markov models with Witten-Bell smoothing (order `order` down to single characters), one for URLs
the rules accept and one for those they reject. Their counts are exact grouped aggregates over all different URLs that
have a rule, but for a fifth (by hash) that is held out; they stay tables, however many contexts there are. Every
different gram (a character after its `order` predecessors) of the URLs to be judged gets its probabilities by joins with
the counts, one context length after the other, and a URL's score is the mean of its grams' log-probability differences.
The threshold on it is the one with the best balanced accuracy on all held-out URLs, whose scores are counted in steps of
1/1024. URLs without a rule are blocked below the threshold. All of it is DataFrame code.

Defined results: null URLs and URLs without `://` have empty host and path and fit no rule; they are allowed, and so are
all URLs without a rule where the held-out URLs of a class or those the models count are none, as then there is no
threshold; equal URLs count once in the models and have one verdict; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

CLASSES = ("allow", "block")
STEPS, MOST = 1024, 64  # steps of a score in the calibration, and the largest score told apart
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE = 512
UNSEEN = 1 / 256  # what the shortest context backs off to


def calibrate(good: dict[int, int], bad: dict[int, int]) -> float:
    """Held-out URLs by step of their score: the threshold (start of a step) with the best balanced accuracy; ties to the one nearest 0."""
    if not good or not bad:
        return 0.0
    low, high = min(*good, *bad), max(*good, *bad) + 1
    kept, dropped, best = sum(good.values()), 0, None
    for step in range(low, high + 1):
        quality = round(kept / sum(good.values()) + dropped / sum(bad.values()), 12)
        if best is None or (quality, -abs(step)) > best[:2]:
            best = quality, -abs(step), step
        kept, dropped = kept - good.get(step, 0), dropped + bad.get(step, 0)
    return best[2] / STEPS


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lowered) and path of a URL; both empty without `://`."""
    safe = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(safe, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(safe, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, both null if none fits."""
    rule = verdict = None
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule_host, _, rest = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith("/" + rest)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return rule if rule is not None else F.lit(None).cast("string"), verdict if verdict is not None else F.lit(None).cast("string")


def explode_grams(bodies: DataFrame, name: str, order: int) -> DataFrame:
    """(name, gram) for each character of a body, and its end, with the up to `order` characters before it; a mark stands
    at the beginning. Long bodies are cut into pieces of PIECE characters first: a place in a string is found by counting."""
    line = F.concat(F.lit("\x02"), F.col("body"), F.lit("\x03"))

    def piece(start: Column) -> Column:
        begin = F.greatest(F.lit(1), start - order)
        return F.struct(F.substring(line, begin, start - begin + PIECE).alias("text"), (start - begin + 1).alias("first"))

    pieces = bodies.select(name, F.explode(F.transform(F.sequence(F.lit(2), F.length(line), F.lit(PIECE)), piece)).alias("piece"))
    grams = F.transform(F.sequence(F.col("piece.first"), F.length("piece.text")), lambda i: F.substring(F.col("piece.text"), F.greatest(F.lit(1), i - order), F.least(i, F.lit(order + 1))))
    return pieces.select(name, F.explode(grams).alias("gram"))


def tails(gram: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(gram)), lambda i: F.substring(gram, -i, i))


def count_grams(bodies: DataFrame, order: int) -> DataFrame:
    """bodies (says, body): (says, gram, n) for each character and its contexts of 0 to `order` characters.

    Only the longest context of a character is read off the texts; the shorter ones follow from those counts.
    """
    full = explode_grams(bodies, "says", order).groupBy("says", "gram").agg(F.count(F.lit(1)).alias("n"))
    return full.select("says", F.explode(tails(F.col("gram"))).alias("gram"), "n").groupBy("says", "gram").agg(F.sum("n").alias("n"))


def train(bodies: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """Written tables of both models of bodies (says, body): grams (gram, allow, block: how often seen) and contexts
    (context, and for each class t: how often seen, and k: how many different characters follow)."""
    seen = [F.coalesce(F.sum(F.when(F.col("says") == says, F.col("n"))), F.lit(0)).alias(says) for says in CLASSES]
    grams = materialise(count_grams(bodies, order).groupBy("gram").agg(*seen), "grams")
    context = F.substring(F.col("gram"), F.lit(1), F.length("gram") - 1)
    sums = [x for says in CLASSES for x in (F.sum(says).alias(f"t_{says}"), F.count_if(F.col(says) > 0).alias(f"k_{says}"))]
    return grams, materialise(grams.groupBy(context.alias("context")).agg(*sums), "contexts")


def _smoothed(says: str, shorter: Column) -> Column:
    """Witten-Bell: the share of a character after its context, and for what is unseen there the shorter context's probability."""
    n, t, k = F.coalesce(F.col(says), F.lit(0)), F.col(f"t_{says}"), F.col(f"k_{says}")
    return F.when(F.coalesce(t, F.lit(0)) > 0, (n + k * shorter) / (t + k)).otherwise(shorter)


def gram_steps(wanted: DataFrame, grams: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """Written (gram, step) for the different grams of wanted (gram): log-probability difference, accepted minus rejected."""
    every = materialise(wanted.distinct().withColumn("tail", F.explode(tails(F.col("gram")))).groupBy("tail").agg(F.max(F.col("gram") == F.col("tail")).alias("asked")), "tails")
    written, below = [every], None
    for size in range(1, order + 2):
        here = every.filter(F.length("tail") == size).join(grams.withColumnRenamed("gram", "tail"), "tail", "left")
        here = here.withColumn("context", F.substring("tail", 1, size - 1)).join(contexts, "context", "left")
        if below is None:
            shorter = {says: F.lit(UNSEEN) for says in CLASSES}
        else:
            before = below.select(F.col("tail").alias("rest"), *[F.col(f"p_{says}").alias(f"s_{says}") for says in CLASSES])
            here = here.withColumn("rest", F.expr("substring(tail, 2)")).join(before, "rest")
            shorter = {says: F.col(f"s_{says}") for says in CLASSES}
        below = materialise(here.select("tail", "asked", *[_smoothed(says, shorter[says]).alias(f"p_{says}") for says in CLASSES]), "smoothed")
        written.append(below)
    asked = [x.filter("asked").select(F.col("tail").alias("gram"), (F.log("p_allow") - F.log("p_block")).alias("step")) for x in written[1:]]
    out = asked[0]
    for x in asked[1:]:
        out = out.unionByName(x)
    out = materialise(out, "steps")
    for x in written:
        discard(x)
    return out


def score_bodies(bodies: DataFrame, grams: DataFrame, contexts: DataFrame, order: int) -> DataFrame:
    """bodies (id, body) as (id, score): the mean difference of a body's grams. A body's rows are summed before they are shuffled."""
    at = explode_grams(bodies, "id", order)
    steps = gram_steps(at.select("gram"), grams, contexts, order)
    return at.join(steps, "gram").groupBy("id").agg(F.avg("step").alias("score"))


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, order: int = 4) -> DataFrame:
    """Per row: key, host, path, rule, verdict, and score (log-likelihood difference per character, null where a rule decides)."""
    picked = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{url}`").cast("string").alias("url"))
    host, path = split_url(F.col("url"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    judged = picked.withColumn("host", host).withColumn("path", path).withColumn("rule", rule).withColumn("says", says)
    body = F.expr("substring(url, locate('://', url) + 3)")
    kinds = judged.filter("locate('://', url) > 0").select("url", "says").distinct()  # a URL has one rule, so it has one class
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    urls = materialise(kinds.select(F.monotonically_increasing_id().alias("id"), "url", body.alias("body"), "says", (F.col("says").isNotNull() & held).alias("held")), "urls")
    sizes = {(r.says, r.held): r.n for r in urls.filter("says is not null").groupBy("says", "held").agg(F.count(F.lit(1)).alias("n")).collect()}
    plain = judged.withColumn("score", F.when(F.col("says").isNull(), F.lit(0.0)))
    if all(sizes.get((x, h)) for x in CLASSES for h in (True, False)):
        grams, contexts = train(urls.filter("says is not null and not held").select("says", "body"), order)
        scores = score_bodies(urls.filter("says is null or held").select("id", "body"), grams, contexts, order)
        scores = materialise(scores.join(urls.select("id", "url", "says"), "id").select("url", "says", "score"), "scores")
        step = F.floor(F.least(F.greatest(F.col("score"), F.lit(-float(MOST))), F.lit(float(MOST))) * STEPS).cast("int")
        bins = scores.filter("says is not null").groupBy("says", step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect()
        threshold = calibrate(*({r.step: r.n for r in bins if r.says == x} for x in CLASSES))
        found = scores.filter("says is null").select("url", F.col("score").alias("_score"))
        plain = judged.join(found, "url", "left").withColumn("score", F.when(F.col("says").isNull(), F.coalesce("_score", F.lit(0.0))))
        verdict = F.when((F.col("_score") >= threshold) | F.col("_score").isNull(), "allow").otherwise("block")
        for x in (grams, contexts):
            discard(x)
    else:
        verdict = F.lit("allow")
    discard(urls)
    return plain.select(F.col("_key").alias(key), "host", "path", "rule", F.coalesce("says", verdict).alias("verdict"), "score")
