"""URL filters: allow and block rules by host suffix and path prefix, and a character language-model ratio for the rest.

Method: two smoothed variable-order Markov models, one of accepted and one of rejected urls, learned from all urls that a rule
judges. A model holds the counts of every context of up to ``ORDER`` characters and of what follows it, by the exact characters,
in a table that grows with the urls; orders are blended by Witten-Bell smoothing with the counted number of different followers.
The logarithm of the ratio of both models follows from a character and the ``ORDER`` before it, a gram. Urls are dealt into
buckets, each of which asks the table for its distinct grams, so that a gram of all urls is joined once a bucket. The score of a
url is its log-likelihood difference (accepted less rejected) by character. One judged url in ``HOLD``, by a hash of the url, is kept from
learning; the cut is calibrated on a histogram of the scores of these, as the one with the best balanced accuracy (on all judged urls
where those kept lack a class).

Defined cases: a null url, or one without ``://``, has an empty host and path; an empty host fits no rule; the longest rule wins
and of equally long ones the one with the longer host; with no urls of one of the classes to learn from, urls without a rule are
allowed; a url of any length is read whole; every input row gives one output row, repeated rows and null ids too; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import cut

ORDER = 5
#: Urls of a bucket, on average.
BUCKET_ROWS = 500
#: One judged url in so many is kept from learning, for the cut.
HOLD = 5
#: Histogram of scores: range and cells.
REACH, CELLS = 4.0, 800
_A, _B = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({u}, instr({u}, '://') + 3)".format(u="_url"))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _A, _B), path


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The winning rule and its verdict; null where none fits."""
    parts = [(a, r, *r.partition("/")[::2]) for a, r in rules]
    parts.sort(key=lambda x: (-len(x[1]), -len(x[2]), x[0] != "block"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, name, h, p in reversed(parts):
        fits = (host != "") & ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(action)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, url, host, path, rule and verdict (null where no rule fits)."""
    slim = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("_url"))
    host, path = split_url(F.col("_url"))
    slim = slim.select("id", F.col("_url").alias("url"), host.alias("host"), path.alias("path"))
    rule, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    return slim.select("*", rule.alias("rule"), verdict.alias("verdict"))


def held(url: Column) -> Column:
    """Whether a judged url is kept from learning; equal urls are kept alike."""
    return F.pmod(F.xxhash64(url, F.lit("held")), F.lit(HOLD)) == 0


def _grams(url: str) -> Iterator[str]:
    """For each character of the url and its end: the ORDER characters before it and itself. A line feed is the start and the end."""
    text = "\n" * ORDER + url.replace("\n", " ") + "\n"
    return (text[i : i + ORDER + 1] for i in range(len(text) - ORDER))


def _count(table: pa.Table) -> pa.Table:
    """Distinct grams of a bucket, and how often they are in rejected and in accepted urls (0 where no rule judged)."""
    counts = Counter(), Counter(), Counter()
    for url, good in zip(table["url"].to_pylist(), table["good"].to_pylist()):
        counts[2 if good is None else good].update(_grams(url))
    grams = list(set().union(*counts))
    n0, n1 = (pa.array([counts[y][g] for g in grams], pa.int64()) for y in (0, 1))
    return pa.table({"bucket": pa.array([table["bucket"][0].as_py()] * len(grams), pa.int64()), "gram": pa.array(grams, pa.string()), "n0": n0, "n1": n1})


def ratios(counts: DataFrame) -> DataFrame:
    """gram and diff, the log of the ratio of both models, from gram, n0 and n1: one row for each gram, counted or not.

    Order k is a table of the distinct last k + 1 characters of the grams; a key of a join or window has at most one row for each character.
    """
    counts = cut(counts)
    lower = None
    for k in range(ORDER + 1):
        own = counts.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("gram")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        context = Window.partitionBy(F.substring("gram", 1, k))
        own = own.withColumns({f"{name}{y}": value.over(context) for y in (0, 1) for name, value in (("seen", F.sum(f"n{y}")), ("kinds", F.count_if(F.col(f"n{y}") > 0)))})
        if lower is None:
            own = own.withColumns({"q0": F.lit(1 / 256), "q1": F.lit(1 / 256)})
        else:
            own = own.join(lower, F.substring("gram", 2, k) == F.col("suffix"))
        blend = lambda y: F.when(F.col(f"seen{y}") > 0, (F.col(f"n{y}") + F.col(f"kinds{y}") * F.col(f"q{y}")) / (F.col(f"seen{y}") + F.col(f"kinds{y}"))).otherwise(F.col(f"q{y}"))
        lower = own.select(F.col("gram").alias("suffix"), blend(0).alias("q0"), blend(1).alias("q1"))
    return lower.select(F.col("suffix").alias("gram"), (F.log("q1") - F.log("q0")).alias("diff"))


def _score(table: pa.Table, answers: pa.Table) -> pa.Table:
    diff = dict(zip(answers["gram"].to_pylist(), answers["diff"].to_pylist()))
    llr = [float(np.mean([diff[g] for g in _grams(url)])) for url in table["url"].to_pylist()]
    return table.drop_columns(["bucket", "good"]).append_column("llr", pa.array(llr, pa.float64()))


def scored(rows: DataFrame, n: int) -> DataFrame:
    """rows (``judged``, about n of them) with llr, by models of those that a rule judges."""
    buckets = max(1, -(-n // BUCKET_ROWS))
    good = F.when(F.col("rule").isNotNull() & ~held(F.col("url")), (F.col("verdict") == "allow").cast("int"))
    dealt = rows.withColumns({"good": good, "bucket": F.pmod(F.xxhash64("url", "id"), F.lit(buckets)).cast("long")})
    asked = cut(dealt.select("bucket", "url", "good").groupBy("bucket").applyInArrow(_count, "bucket long, gram string, n0 long, n1 long"))
    table = ratios(asked.groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")))
    answers = asked.select("bucket", "gram").join(table, "gram")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, url string, host string, path string, rule string, verdict string, llr double"
    return cut(dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(_score, schema))


def calibrate(labelled: DataFrame) -> float:
    """The cut with the best balanced accuracy on the histogram of labelled rows' scores (good 0/1, kept, llr): of those kept from learning, if they have both classes."""
    bucket = F.floor((F.least(F.greatest("llr", F.lit(-REACH)), F.lit(REACH - 1e-9)) + REACH) * (CELLS / (2 * REACH))).cast("int")
    hist = np.zeros((2, 2, CELLS))
    for r in labelled.groupBy("kept", "good", bucket.alias("b")).count().collect():  # at most 4 * CELLS rows
        hist[int(r["kept"]), r["good"], r["b"]] += r["count"]
    hist = hist[1] if hist[1].sum(axis=1).all() else hist.sum(axis=0)
    below = np.concatenate((np.zeros((2, 1)), np.cumsum(hist, axis=1)), axis=1)
    gain = below[0] / max(hist[0].sum(), 1) + 1 - below[1] / max(hist[1].sum(), 1)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float(best[len(best) // 2] * 2 * REACH / CELLS - REACH)


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: id, host, path, rule, verdict, and llr (null where a rule decided)."""
    rows = judged(pages, rules, id_col, url_col)
    n, allowed, blocked = rows.agg(F.count(F.lit(1)), *[F.count_if((F.col("verdict") == v) & ~held(F.col("url"))) for v in ("allow", "block")]).first()
    if not allowed or not blocked:
        out = rows.select("id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("llr"))
        return out.withColumnRenamed("id", id_col)
    rows = scored(rows, n)
    least = calibrate(rows.where("rule IS NOT NULL").select((F.col("verdict") == "allow").cast("int").alias("good"), held(F.col("url")).alias("kept"), "llr"))
    verdict = F.coalesce("verdict", F.when(F.col("llr") >= least, "allow").otherwise("block"))
    return rows.select("id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("llr")).alias("llr")).withColumnRenamed("id", id_col)
