"""URL filters: allow and block rules, and for the rest the ratio of two character models.

Two Markov models of variable order, of accepted and of rejected URLs, are trained on the URLs that
rules decide. Each order's estimate leans on the next shorter context where its own has been seen
little (Witten-Bell smoothing). A URL's score is the difference of its log-likelihoods per character;
the line between the verdicts is the one that parts held-out ruled URLs best.

URLs are written in an alphabet of 32 signs, so a model of order 3 has at most 32**4 entries whatever
the input: that bounds what is broadcast.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lower_az

ORDER = 3
#: a-z stand for themselves, digits are 0, and these keep their place; all else is "~". "^" pads the start.
_KEPT = "./-?"

#: Of scores, for the line between verdicts: bins of 0.02 from -4 to 4.
BIN, REACH = 0.02, 200


def host_and_path(url: Column) -> tuple[Column, Column]:
    # The first "://" counts, later ones belong to the path or the query.
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return lower_az(F.coalesce(host, F.lit(""))), F.coalesce(path, F.lit(""))


def signs(url: Column) -> Column:
    text = F.regexp_replace(lower_az(url), r"^[^:]*://", "")
    text = F.regexp_replace(F.regexp_replace(text, "[0-9]", "0"), "[^a-z0" + re.escape(_KEPT) + "]", "~")
    return F.concat(F.lit("^" * ORDER), text)


def grams(s: Column) -> Column:
    """Every sign with the ORDER signs before it."""
    n = F.length(s) - ORDER
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, F.lit(ORDER + 1)))).otherwise(F.array().cast("array<string>"))


def models(counted: DataFrame) -> DataFrame:
    """(gram, ratio) from (gram, n_a, n_r): log of P(sign | context) for accepted less that for rejected URLs."""
    table = counted
    for side in ("a", "r"):
        table = table.withColumn(f"p_{side}", F.lit(1 / 32))
    for k in range(ORDER + 1):
        gram, ctx = F.substring("gram", ORDER + 1 - k, k + 1), F.substring("gram", ORDER + 1 - k, k)
        table = table.withColumn("_g", gram).withColumn("_c", ctx)
        by = table.groupBy("_c", "_g").agg(F.sum("n_a").alias("g_a"), F.sum("n_r").alias("g_r"))
        of = by.groupBy("_c").agg(*(f for s in ("a", "r") for f in (F.sum(f"g_{s}").alias(f"c_{s}"), F.sum((F.col(f"g_{s}") > 0).cast("long")).alias(f"t_{s}"))))
        table = table.join(by.join(of, "_c"), ["_c", "_g"])
        for s in ("a", "r"):
            p = (F.col(f"g_{s}") + F.col(f"t_{s}") * F.col(f"p_{s}")) / (F.col(f"c_{s}") + F.col(f"t_{s}"))
            table = table.withColumn(f"p_{s}", F.when(F.col(f"c_{s}") > 0, p).otherwise(F.col(f"p_{s}")))
        table = cut(table.select("gram", "n_a", "n_r", "p_a", "p_r"))  # each order's plan holds the one before it twice
    return table.select("gram", (F.log("p_a") - F.log("p_r")).alias("ratio"))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; rules are (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda x: (len(x[1] + x[2]), x)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row.

    ``rules`` are (allow or block, host, path prefix). A null url, or one without "://", has an empty
    host and path and the score 0. Without ruled URLs of both kinds all scores are 0, and a score on the
    line is allowed. Repeated rows are each judged; an empty table gives no rows; other columns are not
    looked at. Every fifth ruled URL by checksum is held out of the models and sets the line."""
    base = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"))
    host, path = host_and_path(F.col("_url"))
    parts = base.select("_id", "_url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("given"))
    # Equal URLs are scored once, and counted as often as they occur.
    urls = (
        ruled.filter(F.col("_url").isNotNull())
        .groupBy("_url").agg(F.count("*").alias("n"), F.first("given").alias("given"))
        .select("_url", "n", "given", (F.crc32(F.encode("_url", "UTF-8")) % 5 == 0).alias("held"), signs(F.col("_url")).alias("_s"))
    )
    urls = cut(urls)
    split = urls.select("n", "given", "held", F.explode(grams(F.col("_s"))).alias("gram"))
    learns = lambda v: F.sum(F.when((F.col("given") == v) & ~F.col("held"), F.col("n")).otherwise(0))
    counted = split.groupBy("gram").agg(learns("allow").alias("n_a"), learns("block").alias("n_r"))
    both = counted.agg((F.sum("n_a") > 0).alias("a"), (F.sum("n_r") > 0).alias("r"))
    model = cut(models(cut(counted)).crossJoin(F.broadcast(both)).select("gram", F.when(F.col("a") & F.col("r"), F.col("ratio")).otherwise(0.0).alias("ratio")))
    # 32 ** (ORDER + 1) entries at most.
    scored = (
        urls.select("_url", "n", "given", "held", F.explode(grams(F.col("_s"))).alias("gram"))
        .join(F.broadcast(model), "gram")
        .groupBy("_url").agg(F.first("n").alias("n"), F.first("given").alias("given"), F.first("held").alias("held"), F.round(F.avg("ratio"), 6).alias("score"))
    )
    scored = cut(scored)
    bins = (
        scored.filter(F.col("held") & F.col("given").isNotNull())
        .groupBy(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.floor(F.col("score") / BIN))).cast("int").alias("b"))
        .agg(F.sum(F.when(F.col("given") == "allow", F.col("n")).otherwise(0)).alias("na"), F.sum(F.when(F.col("given") == "block", F.col("n")).otherwise(0)).alias("nr"))
    )
    below, whole = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()  # over 2 * REACH + 1 rows at most
    loss = F.coalesce(F.sum("na").over(below), F.lit(0)) / F.sum("na").over(whole) + 1 - F.coalesce(F.sum("nr").over(below), F.lit(0)) / F.sum("nr").over(whole)
    line = bins.select("b", F.round(loss, 9).alias("loss")).filter(F.col("loss").isNotNull()).agg(F.min(F.struct("loss", F.abs(F.col("b")).alias("a"), "b")).alias("best")).select(F.coalesce(F.round(F.col("best.b") * BIN, 2), F.lit(0.0)).alias("line"))
    judged = ruled.join(scored.select("_url", "score"), "_url", "left").crossJoin(F.broadcast(line))  # one row
    score = F.coalesce("score", F.lit(0.0))
    return judged.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("given", F.when(score >= F.col("line"), "allow").otherwise("block")).alias("verdict"), score.alias("score"))
