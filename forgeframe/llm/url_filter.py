"""URL filter: host and path rules first, then a character language-model ratio (operator 1).

Two variable-order Markov models over characters, one of accepted and one of rejected URLs,
are trained on URLs that the rules decide. Contexts are suffixes of up to ``order - 1``
characters; a string is kept only if it makes up ``rare`` of all strings of its length, so a
model never has more than ``order / rare`` rows, whatever the input; what is pruned goes to
the next shorter context. Smoothing is interpolated Witten-Bell::

    P(x | c) = n(c x) / (N(c) + T(c)) + bow(c) P(x | c without its first character)

Kept strings are closed under prefixes and suffixes, so the log-likelihood difference of a URL
telescopes into a sum of one value for each kept substring. Scoring is therefore one explode,
one join with the bounded model and one sum. The sum is divided by the length and compared
with a threshold that makes the balanced error on held-out labelled URLs least.

DataFrame functions only. Null URL: empty host and path, no rule, verdict ``block``. Empty or
odd URLs are scored like others, and very long ones whole, in pieces. Equal URLs get equal verdicts,
and are scored once; the scores of URLs that very many rows have are sent to those rows. An empty
table gives an empty result. If the rules decide no URL of
one of the two kinds there is no model and the verdict is ``allow``. Input columns named like
an output column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forgeframe.llm._common import Scratch, fresh

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters of a piece of a URL; of URLs that many rows have, at most so many are sent to all tasks.
PIECE, SENT = 1000, 10_000
START, END, FOREIGN = "\x02", "\x03", "\x1a"


def host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    found = F.when(url.contains("://"), F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1))
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    found = F.when(url.contains("://"), F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1))
    return F.coalesce(found, F.lit(""))


def rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of ``(verdict, "host/path")`` that fits, and its verdict; null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        at, _, rest = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, text).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def substrings(rows: DataFrame, order: int) -> DataFrame:
    """``rows`` with s in place of url, a row for each substring of up to ``order`` characters of the marked URL.

    Characters outside printable ASCII count as one. A URL is cut into pieces of ``PIECE`` characters first,
    each with the characters before it that its first substrings need, so no row ever holds those of a long URL.
    """
    text, lead = F.concat(F.lit(START), F.regexp_replace("url", r"[^\x20-\x7e]", FOREIGN), F.lit(END)), F.lit(order - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(text) - 1) / PIECE).cast("int")), lambda i: F.struct(F.least(i, F.lit(1)).alias("later"), F.substring(text, F.greatest(F.lit(1), i * PIECE + 1 - lead), F.when(i == 0, PIECE).otherwise(PIECE + lead)).alias("t")))
    piece, later = F.col("piece.t"), F.col("piece.later")
    ends = F.sequence(later * lead + 1, F.length(piece))
    every = F.flatten(F.transform(ends, lambda e: F.transform(F.sequence(F.lit(1), F.least(e, F.lit(order))), lambda n: F.substring(piece, e - n + 1, n))))
    kept = [c for c in rows.columns if c != "url"]
    return rows.select("url", *kept, F.explode(pieces).alias("piece")).select("url", *kept, F.explode(every).alias("s"))


def train(labelled: DataFrame, order: int, rare: float, scratch: Scratch) -> DataFrame:
    """(s, v): the value of each kept string, from distinct (url, accepted boolean)."""
    parts = int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = (
        substrings(labelled.repartition(parts), order)
        .groupBy("s")
        .agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r"))
    )
    counts = scratch.table(counts.withColumn("n", F.length("s")), "counts")
    every = counts.filter("n = 1").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.count("*").alias("v")).first()
    total, least = (every.a or 0) + (every.r or 0), 2
    kept = counts.filter((F.col("n") == 1) | (F.col("a") + F.col("r") >= F.lit(max(least, rare * total))))
    # of each context: how often it goes on, with how many characters, and how much of that is kept
    head = F.expr("substring(s, 1, n - 1)")
    after = counts.filter("n > 1").groupBy(head.alias("c")).agg(*[f for m in "ar" for f in (F.sum(m).alias(f"{m}_all"), F.count_if(F.col(m) > 0).alias(f"{m}_types"))])
    used = kept.filter("n > 1").groupBy(head.alias("c")).agg(*[F.sum(m).alias(f"{m}_kept") for m in "ar"])
    whole = {m: F.col(f"{m}_all") + F.col(f"{m}_types") for m in "ar"}
    contexts = after.join(used, "c").select("c", *[x for m in "ar" for x in (whole[m].alias(f"{m}_whole"), F.when(whole[m] > 0, (whole[m] - F.col(f"{m}_kept")) / whole[m]).otherwise(1.0).alias(f"{m}_bow"))])
    contexts = scratch.table(contexts, "contexts")
    level = kept.filter("n = 1").select("s", *[((F.col(m) + 1) / ((every[m] or 0) + every.v + 1)).alias(f"{m}_p") for m in "ar"])
    value = level.select("s", (F.log("a_p") - F.log("r_p")).alias("w"))
    for n in range(2, order + 1):
        own = kept.filter(F.col("n") == n).select("s", "a", "r", head.alias("c"), F.expr("substring(s, 2)").alias("tail"))
        lower = level.select(F.col("s").alias("tail"), *[F.col(f"{m}_p").alias(f"{m}_low") for m in "ar"])
        own = own.join(contexts, "c").join(lower, "tail")
        p = {m: F.when(F.col(f"{m}_whole") > 0, F.col(m) / F.col(f"{m}_whole")).otherwise(0.0) + F.col(f"{m}_bow") * F.col(f"{m}_low") for m in "ar"}
        ratio = lambda x, y: F.log(x) - F.log(y)
        level = scratch.table(own.select("s", "a_bow", "r_bow", *[p[m].alias(f"{m}_p") for m in "ar"], *[f"{m}_low" for m in "ar"]), f"level{n}")
        value = value.unionByName(level.select("s", (ratio(F.col("a_p"), F.col("r_p")) - ratio(F.col("a_low"), F.col("r_low")) - ratio(F.col("a_bow"), F.col("r_bow"))).alias("w")))
    onward = contexts.select(F.col("c").alias("s"), (F.log("a_bow") - F.log("r_bow")).alias("b"))
    return scratch.table(value.join(onward, "s", "left").select("s", (F.col("w") + F.coalesce("b", F.lit(0.0))).alias("v")), "model")


def score(urls: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """Distinct (url) with the length-normalised log-likelihood difference. The model is bounded, so it is broadcast."""
    parts = int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = substrings(urls.repartition(parts, "url"), order)
    return rows.join(F.broadcast(model), "s", "left").groupBy("url").agg((F.coalesce(F.sum("v"), F.lit(0.0)) / (F.length("url") + 1)).alias("score"))


def threshold(scores: DataFrame, step: float = 0.005, bins: int = 2000) -> float:
    """Of (score, accepted): the score at which the balanced error is least; among equals, the middle one."""
    at = F.greatest(F.lit(-bins), F.least(F.lit(bins), F.floor(F.col("score") / step).cast("int")))
    found = scores.groupBy(at.alias("at")).agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")).orderBy("at").collect()
    a_all, r_all = sum(x.a for x in found) or 1, sum(x.r for x in found) or 1
    best, a, r = [(r_all / r_all, (found[0].at if found else 0) * step)], 0, 0
    for x in found:
        a, r = a + x.a, r + x.r
        best.append((a / a_all + (r_all - r) / r_all, (x.at + 1) * step))
    least = min(b for b, _ in best)
    equal = [t for b, t in best if b == least]
    return equal[len(equal) // 2]


def judge(pages: DataFrame, rules: list[tuple[str, str]], url: str = "url", order: int = 5, rare: float = 5e-5) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (null where a rule decides).

    The models count all distinct labelled URLs, and the threshold is that of all of them: each half of
    them, by hash, is scored for it by models of the other half.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "urlfilter")
    own = ["host", "path", "rule", "verdict", "score"]
    rows = pages.select(*[c for c in pages.columns if c not in own or c == url])
    u, said, of, at = F.col(url), *map(fresh, ("said", "url", "score"))
    name, says = rule(host(u), path(u), rules)
    judged = {"host": host(u), "path": path(u), "rule": name}
    rows = rows.withColumns({said: says})
    known = scratch.table(rows.filter(u.isNotNull()).groupBy(u.alias("url"), F.col(said).alias("said")).agg(F.count("*").alias("n")), "urls")
    labelled = known.filter("said is not null").select("url", (F.col("said") == "allow").alias("accepted"), F.pmod(F.xxhash64("url"), F.lit(2)).alias("half"))
    if labelled.select("accepted").distinct().count() < 2:
        return rows.withColumns(judged | {"score": F.lit(None).cast("double"), "verdict": F.coalesce(said, F.when(u.isNull(), "block").otherwise("allow"))}).drop(said)
    model = train(labelled.select("url", "accepted"), order, rare, scratch)
    held = []
    for half in (0, 1):
        other, part = labelled.filter(F.col("half") != half), labelled.filter(F.col("half") == half)
        tried = train(other.select("url", "accepted"), order, rare, Scratch(spark, f"urlfilter{half}"))
        held.append(score(part.select("url"), tried, order).join(part, "url").select("score", "accepted"))
    limit = threshold(held[0].unionByName(held[1]))
    scored = scratch.table(score(known.filter("said is null").select("url"), model, order), "scored")
    # a URL that many rows have must not be one join key: there are fewer than SENT of those
    many = F.greatest(F.lit(1000), known.agg(F.sum("n")).scalar() / SENT)
    often = scored.join(known.filter(F.col("said").isNull() & (F.col("n") > many)).select("url"), "url", "left_semi")
    often = scratch.table(often, "often").withColumnsRenamed({"url": of, "score": at})
    near = rows.join(F.broadcast(often), F.col(said).isNull() & (u == F.col(of)), "left").drop(of)
    open_ = F.col(said).isNull() & u.isNotNull() & F.col(at).isNull()
    rest = near.filter(open_).drop(at).join(scored.withColumnsRenamed({"url": of, "score": at}), u == F.col(of)).drop(of)
    rows = near.filter(~open_).unionByName(rest)
    verdict = F.coalesce(said, F.when(F.col(at) >= limit, "allow").otherwise("block"))
    return rows.withColumns(judged | {"verdict": verdict, "score": F.col(at)}).drop(said, at)
