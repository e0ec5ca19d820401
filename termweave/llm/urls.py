"""URL filters: rules by host and path, and a ratio of character language models for the rest.

URLs that a rule decides train two smoothed variable-order Markov models, one of accepted and one of
rejected URLs. A character's probability given its context of up to ORDER characters is interpolated
(Witten-Bell) with that of the next shorter context; a context that a model has not seen leaves the shorter
one's. A URL's score is the mean over its characters of the difference of log likelihoods; the threshold is
calibrated on held-out URLs that rules decide (a fifth, by hash), to the least balanced error.

Counts come from all URLs that rules decide. Every URL is cut into grams of ORDER + 1 characters; grams are
counted with pre-aggregation, so a host with a third of all rows costs one row for each task and gram. The
models are tables by gram, built level by level with joins; only the tables of the two shortest contexts,
which the fixed alphabet bounds, are broadcast. Scores are joined to URLs by gram, a join that Spark can
split at frequent grams.

Defined results: a null URL has no host, no path and is blocked; an empty one likewise; a URL without
"://" has empty host and path and is judged by the models; if rules accept none or reject none, there is
nothing to compare and all other URLs are allowed; of two rules of one length, block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, materialise, table

#: Characters of context at most.
ORDER = 4
#: Printable ASCII but upper-case letters, one sign for anything else, one for the begin.
ALPHABET = 71
BEGIN, OTHER = "\x02", "\x03"
#: One in so many URLs is held out, by hash of the URL.
HOLD_OUT = 5
#: URLs that a task cuts into grams, about.
TASK = 20_000
#: Scores are compared with thresholds on this grid.
GRID = 0.02
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(verdict, rule) of the longest rule that fits, else null. Rules are a list of the caller's, thus short."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda x: (len(x[1]), x[0] == "block")):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def _grams(url: Column) -> Column:
    """An array with, for each character of the URL, it and the ORDER characters before it."""
    plain = F.concat(F.lit(BEGIN * ORDER), F.regexp_replace(lower_ascii(url), r"[^\x20-\x7E]", OTHER))
    return F.get(F.transform(F.array(plain), lambda p: F.transform(F.sequence(F.lit(1), F.char_length(p) - ORDER), lambda i: F.substring(p, i, ORDER + 1))), F.lit(0))


def _level(grams: DataFrame, k: int, lower: DataFrame | None) -> DataFrame:
    """gram (k + 1 characters), p_a, p_r: interpolated probabilities of its last character after the k before it."""
    counts = grams.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    shorter = F.substring("gram", 1, k)
    seen = counts.groupBy(shorter.alias("context")).agg(F.sum("a").alias("n_a"), F.sum("r").alias("n_r"), F.count_if(F.col("a") > 0).alias("t_a"), F.count_if(F.col("r") > 0).alias("t_r"))
    # contexts of no or one character are at most ALPHABET + 1
    joined = counts.withColumn("context", shorter).join(F.broadcast(seen) if k <= 1 else seen, "context")
    if lower is None:
        joined = joined.withColumns({"q_a": F.lit(1.0 / ALPHABET), "q_r": F.lit(1.0 / ALPHABET)})
    else:
        lower = lower.select(F.col("gram").alias("suffix"), F.col("p_a").alias("q_a"), F.col("p_r").alias("q_r"))
        # grams of one character are at most ALPHABET, of two its square
        joined = joined.withColumn("suffix", F.substring("gram", 2, k)).join(F.broadcast(lower) if k <= 2 else lower, "suffix")
    p = lambda c: F.when(F.col(f"n_{c}") > 0, (F.col(c) + F.col(f"t_{c}") * F.col(f"q_{c}")) / (F.col(f"n_{c}") + F.col(f"t_{c}"))).otherwise(F.col(f"q_{c}"))
    return joined.select("gram", p("a").alias("p_a"), p("r").alias("p_r"))


def gram_scores(grams: DataFrame) -> DataFrame:
    """gram, score (log ratio of accepted to rejected) from gram, a, r (counts in accepted and rejected URLs)."""
    level = None
    for k in range(ORDER + 1):
        level = materialise(_level(grams, k, level))
    return level.select("gram", F.round(F.ln(F.col("p_a") / F.col("p_r")), 9).alias("score"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """For each row of pages: key, url, host, path, rule, verdict, score, threshold."""
    spark, u = pages.sparkSession, F.col("url")
    read = pages.select(F.col(key).alias("id"), F.col(url).alias("url"))
    # a URL that occurs often is judged once
    urls = read.filter(u.isNotNull() & (u != "")).groupBy("url").agg(F.count(F.lit(1)).alias("n"))
    urls = urls.withColumn("by", rule_of(host_of(u), path_of(u), rules)["verdict"])
    fold = F.pmod(F.xxhash64("url"), F.lit(HOLD_OUT)) == 0
    train = lambda verdict: F.sum(F.when((F.col("by") == verdict) & ~F.col("held"), F.col("n")).otherwise(0))
    urls = materialise(urls.select("url", "n", "by", fold.alias("held"), F.xxhash64("url").alias("u"), F.xxhash64("url", F.lit(1)).alias("v")))
    # URLs are small and their grams many: dealt out by their number, not by their bytes
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), urls.count() // TASK + 1)
    cut = urls.repartition(parts, "u").select("u", "v", "n", "by", "held", F.explode(_grams(u)).alias("gram"))
    grams = materialise(cut.groupBy("gram").agg(train("allow").alias("a"), train("block").alias("r")))
    scores = gram_scores(grams)
    scored = cut.join(scores, "gram").groupBy("u", "v").agg(F.avg(F.col("score").cast("decimal(20,9)")).cast("double").alias("score"), F.first("n").alias("n"), F.first("by").alias("by"), F.first("held").alias("held"))
    scored = materialise(scored.withColumn("score", F.round("score", 6)))
    threshold = calibrated(scored.filter("held and by is not null"))
    judged = urls.select("url", "u", "v").join(scored.select("u", "v", "score"), ["u", "v"]).select("url", "score")
    rule = rule_of(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("hit")["verdict"], F.when(F.coalesce(u, F.lit("")) == "", "block").when(F.lit(threshold is None) | (F.col("score") >= F.lit(threshold)), "allow").otherwise("block"))
    out = read.join(judged, "url", "left").withColumns({"host": host_of(u), "path": path_of(u)}).withColumn("hit", rule)
    return out.select(F.col("id").alias(key), F.col("url"), "host", "path", F.col("hit")["rule"].alias("rule"), verdict.alias("verdict"), "score", F.lit(threshold).cast(T.DoubleType()).alias("threshold"))


def calibrated(held: DataFrame) -> float | None:
    """The threshold on the grid with the least sum of error rates on held-out URLs, the middle one of equals; None without both kinds.

    The driver gets a count for each step of the grid that occurs; scores lie within some tens of nats.
    """
    steps = held.groupBy(F.floor(F.col("score") / GRID).cast("long").alias("at")).agg(F.sum(F.when(F.col("by") == "allow", F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("by") == "block", F.col("n")).otherwise(0)).alias("r"))
    counts = sorted((r["at"], r["a"], r["r"]) for r in steps.collect())
    all_a, all_r = sum(x[1] for x in counts), sum(x[2] for x in counts)
    if not all_a or not all_r:
        return None
    # a threshold at the lower edge of a step rejects all below it
    best, found, lost, kept = 3.0, [], 0, all_r
    for at in range(counts[0][0], counts[-1][0] + 2):
        error = lost / all_a + kept / all_r
        if error < best - 1e-12:
            best, found = error, []
        if error <= best + 1e-12:
            found.append(at)
        for _, a, r in (x for x in counts if x[0] == at):
            lost, kept = lost + a, kept - r
    return round(found[len(found) // 2] * GRID, 6)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict", "score")
