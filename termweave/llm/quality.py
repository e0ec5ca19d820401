"""Host-level quality rules, in DataFrame functions only.

Each document is measured; documents that fail a base rule are rejected. The failures are then summed by
host (any column that names where a document comes from), each host's failure rate is shrunk towards an
empirical beta prior fitted to the hosts' rates by moments, and hosts above a limit lose all their
documents.

Measures stay inside one row, so no text is shuffled: repeated words come from the hashes of the 8-word
windows of a document, of which only the repeated ones are sorted. Each text is measured once: what comes of
it is written to the shared folder, since the host totals and the verdicts both read it. Host totals are pre-aggregated,
so a host with a third of all rows costs one row for each task.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; repeated
rows count as often as they occur; with no hosts at all, or hosts that all have one rate, the prior is
flat (one failure and one success). Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, materialise, sized, table

#: A symbol.
SYMBOLS = "[#*$%&|<>]"
#: Words in a window for repeated words.
WINDOW = 8
#: A document fails with fewer words than this.
MIN_WORDS = 20
#: A document fails when over this percentage of its words stand in repeated windows.
MAX_REPEAT_PERCENT = 30
#: A host is rejected when its shrunk failure rate exceeds this.
MAX_HOST_RATE = 0.6
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value made only once: a lambda's variable is a value, a repeated column is made anew each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in windows found twice or more in the array."""
    n = F.size(words)
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    windows = _let(hashed, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window))))
    covered = _let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_length(_starts(h), window)))
    return F.when(n <= window, F.lit(0)).otherwise(covered)


def _starts(hashes: Column) -> Column:
    """Places of the hashes that occur twice or more, in order."""

    def twice(placed: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(placed, k)["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(placed, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

    return _let(F.array_sort(F.transform(hashes, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), twice)


def _length(starts: Column, window: int) -> Column:
    """Words that the windows at these places cover together."""
    nothing = F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last"))
    return F.aggregate(starts, nothing, lambda a, x: F.struct((a["n"] + F.least(F.lit(window), x - a["last"])).alias("n"), x.alias("last")))["n"]


def measures(docs: DataFrame, text: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """The columns named in keep (default: doc_id), and for each row the measures and base_failed."""
    t = F.coalesce(F.col(text), F.lit(""))
    word = f"[^{SEPARATORS}]"
    words = F.array_remove(F.split(t, f"[{SEPARATORS}]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(word))
    n = F.col("n_words")
    named = docs.select(*(keep or [F.col("doc_id")]), t.alias("__text"), words.alias("__words"), lines.alias("__lines"))
    kept = [named[c] for c in named.columns if c not in ("__text", "__words", "__lines")]
    measured = named.select(
        *kept,
        F.size("__words").cast("long").alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
    )
    return measured.withColumn("base_failed", (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n))


def host_totals(measured: DataFrame, host: str = "host") -> DataFrame:
    return measured.groupBy(host).agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))


def host_verdicts(hosts: DataFrame, host: str = "host", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Adds host_rate (shrunk) and host_ok to hosts with n_docs and n_failed.

    Prior: mean m and variance v of the hosts' rates, unweighted; a + b = m (1 - m) / v - 1 and
    a = m (a + b); a = b = 1 where the rates have no spread or more than a beta distribution can have.
    """
    own = F.col("n_failed") / F.col("n_docs")
    moments = hosts.agg(F.avg(own).alias("m"), F.var_pop(own).alias("v"))
    m, v = F.col("m"), F.col("v")
    fits = (v > 1e-12) & (m * (1 - m) > v)
    strength = m * (1 - m) / v - 1
    prior = moments.select(F.when(fits, strength).otherwise(2.0).alias("strength"), F.when(fits, m * strength).otherwise(1.0).alias("a"))
    rate = (F.col("n_failed") + F.col("a")) / (F.col("n_docs") + F.col("strength"))
    # the prior is one row, so this joins two numbers to each host
    return hosts.join(F.broadcast(prior)).select(host, "n_docs", "n_failed", rate.alias("host_rate"), (rate <= max_rate).alias("host_ok"))


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """For each row of docs: key, host, the measures, base_failed, host_rate, kept."""
    measured = materialise(measures(docs, text, [F.col(key).alias(key), F.col(host).alias("host")]))
    verdicts = host_verdicts(host_totals(measured), "host", max_rate).select(F.col("host").alias("__host"), "host_rate", "host_ok")
    joined = measured.join(verdicts, F.col("host").eqNullSafe(F.col("__host")), "left")
    return joined.select(key, "host", *MEASURES, "base_failed", "host_rate", (~F.col("base_failed") & F.col("host_ok")).alias("kept"))


def keep_good(docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns. Texts aren't shuffled: only the hosts' verdicts are joined.

    The rows that pass the base rules are written once with their host; of the others the host alone.
    """
    row = F.struct(*[docs[c] for c in docs.columns]).alias("__row")
    measured = measures(docs, text, [row, F.col(host).alias("__of")])
    measured = materialise(measured.select("__of", "base_failed", F.when(~F.col("base_failed"), F.col("__row")).alias("__row")))
    good = materialise(host_verdicts(host_totals(measured, "__of"), "__of", max_rate).filter("host_ok").select(F.col("__of").alias("__host")))
    return measured.filter(~F.col("base_failed")).join(sized(good), F.col("__of").eqNullSafe(F.col("__host")), "left_semi").select("__row.*")


def op7_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("host", "host_rate")


ORACLE_SQL = f"""
with t as (select doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
windows as (select doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') as win from (select doc_id, w, unnest(range(1, greatest(len(w) - {WINDOW - 2}, 1))) as i from t)),
twice as (select doc_id, i from windows qualify count(*) over (partition by doc_id, win) > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {WINDOW})) as p from twice) group by doc_id),
m as (select t.doc_id, source, len(w) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l, coalesce(n, 0) as n_repeat_words from t left join covered using (doc_id)),
b as (select *, len(l) - len(list_distinct(l)) as n_dup_lines, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed from m),
hosts as (select source, count(*) as n, count(*) filter (where base_failed) as f from b group by source),
mo as (select avg(f / n) as mean, var_pop(f / n) as v from hosts),
prior as (select case when fits then strength else 2 end as strength, case when fits then mean * strength else 1 end as a
  from (select *, v > 1e-12 and mean * (1 - mean) > v as fits, mean * (1 - mean) / nullif(v, 0) - 1 as strength from mo)),
ok as (select source, (f + a) / (n + strength) <= {MAX_HOST_RATE} as host_ok from hosts, prior)
select doc_id, cast(n_words as bigint) as n_words, word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  base_failed, not base_failed and host_ok as kept from b join ok on b.source is not distinct from ok.source"""
