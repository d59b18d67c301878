"""URL filter by the ratio of two character language models, in DataFrame functions alone.

Rules label some URLs. Two smoothed Markov models of variable order, one of
accepted and one of rejected URLs, are counted from most of these; a URL without a
rule is judged by the difference of its log-likelihoods per character, against
a threshold calibrated on labelled ones that were not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

# Rules as (host, path) and verdict.
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: Characters that the models tell apart; digits are one, all others together another.
ALPHABET = "^abcdefghijklmnopqrstuvwxyz0./-_?=&%:#~+@*"
_SIZE = len(ALPHABET)
#: Longest run that is counted: a character after two others.
ORDER = 3
#: Weight of the next shorter context in a context's smoothed distribution.
SMOOTHING = 4.0
#: First hexadecimal digits of the MD5 of labelled URLs that set the threshold and are not counted.
HELD_OUT = "012"
_BINS = 400
_REACH = 4.0


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    before = F.regexp_extract(rest, r"^([^?#]*)", 1)
    slash = F.instr(before, "/")
    host = F.when(slash > 0, F.substring(before, F.lit(1), slash - 1)).otherwise(before)
    path = F.when(slash > 0, F.substring(before, slash, F.length(before))).otherwise(F.lit(""))
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as ``host/path``, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # Later ones win, so the longest comes last.
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _padded(url: Column) -> Column:
    """The URL in the models' alphabet, led by two starts."""
    plain = F.regexp_replace(F.regexp_replace(lower_ascii(url), "[0-9]", "0"), r"[^a-z0./\-_?=&%:#~+@]", "*")
    return F.concat(F.lit("^^"), plain)


def _grams(padded: Column) -> Column:
    """Every character of a padded URL with the two before it."""
    return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(ORDER)))


def ratio_table(count: DataFrame) -> DataFrame:
    """(gram, ratio): log of accepted over rejected probability for every gram.

    ``count`` has gram, yes and no. The table's size is that of the alphabet
    cubed, whatever the input: unseen contexts fall back to the longest one
    seen, in the end to even odds.
    """
    letter = lambda n: F.substr(F.lit(ALPHABET), n + 1, F.lit(1))
    number = F.col("id").cast("int")
    gram = F.concat(letter((number / _SIZE**2).cast("int")), letter((number / _SIZE).cast("int") % _SIZE), letter(number % _SIZE))
    table = count.sparkSession.range(_SIZE**ORDER, numPartitions=1).select(gram.alias("gram"))
    table = table.join(count.select("gram", F.col("yes").cast("double"), F.col("no").cast("double")), "gram", "left").na.fill(0.0, ["yes", "no"])
    parts = {"c": F.substring("gram", 3, 1), "b": F.substring("gram", 2, 1), "ab": F.substring("gram", 1, 2)}
    table, counted = table.withColumns(parts), count.withColumns(parts)
    for by, name in ((["c"], "c"), (["b", "c"], "bc"), (["b"], "b"), (["ab"], "ab")):
        totals = counted.groupBy(*by).agg(F.sum("yes").cast("double").alias(f"yes_{name}"), F.sum("no").cast("double").alias(f"no_{name}"))
        # Sizes are powers of the alphabet's.
        table = table.join(F.broadcast(totals), by, "left").na.fill(0.0, [f"yes_{name}", f"no_{name}"])
    whole = count.agg(F.coalesce(F.sum("yes").cast("double"), F.lit(0.0)).alias("yes_all"), F.coalesce(F.sum("no").cast("double"), F.lit(0.0)).alias("no_all"))

    def probability(side: str, total: Column) -> Column:
        p = (F.col(f"{side}_c") + SMOOTHING / _SIZE) / (total + SMOOTHING)
        p = (F.col(f"{side}_bc") + SMOOTHING * p) / (F.col(f"{side}_b") + SMOOTHING)
        return (F.col(side) + SMOOTHING * p) / (F.col(f"{side}_ab") + SMOOTHING)

    sums = whole.first()  # two numbers
    ratio = F.log(probability("yes", F.lit(sums.yes_all))) - F.log(probability("no", F.lit(sums.no_all)))
    return table.select("gram", ratio.alias("ratio"))


def held_out(url: Column) -> Column:
    return F.substring(F.md5(url.cast("binary")), 1, 1).isin(*HELD_OUT)


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score.

    The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the
    end, A-Z lower-cased; the path what follows up to ``?``, ``#`` or the end.
    Of the rules that fit the longest wins and gives the verdict. Otherwise the
    models do: score is the log-likelihood difference per character, allow at
    or above the threshold. The models come from all URLs with a rule but a
    part held out by hash (``HELD_OUT``), and the threshold from that part. Null URLs have score 0. If the rules accept or reject no URL at all,
    every other URL is allowed. Input columns of these names are replaced;
    repeated rows stay one for one; an empty table gives an empty result.
    """
    made = ("host", "path", "rule", "verdict", "score")
    rest = [c for c in pages.columns if c not in made]
    url = F.col(f"`{url_col}`")
    host, path = host_and_path(url)
    seen = pages.select(*[F.col(f"`{c}`") for c in rest]).withColumns({"host": host, "path": path})
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": rule, "__given": verdict, "__url": url})
    padded = (
        seen.where(F.length("__url") > 0).groupBy("__url", "__given").agg(F.count(F.lit(1)).alias("__n")).withColumn("__padded", _padded(F.col("__url")))
    )
    grams = padded.select("__url", "__given", "__n", F.explode(_grams(F.col("__padded"))).alias("gram"))
    counted = (
        grams.where(F.col("__given").isNotNull() & ~held_out(F.col("__url")))
        .groupBy("gram")
        .agg(F.sum(F.when(F.col("__given") == "allow", F.col("__n"))).alias("yes"), F.sum(F.when(F.col("__given") == "block", F.col("__n"))).alias("no"))
    )
    model = shared.written(ratio_table(shared.written(counted.na.fill(0), "url-grams")), "url-ratios")
    of_url = grams.join(F.broadcast(model), "gram").groupBy("__url", "__given", "__n").agg(F.avg("ratio").alias("score"))
    of_url = shared.written(of_url, "url-scores")
    place = F.floor((F.greatest(F.lit(-_REACH), F.least(F.lit(_REACH), "score")) + _REACH) * (_BINS / (2 * _REACH)))
    bins = of_url.where(F.col("__given").isNotNull() & held_out(F.col("__url"))).groupBy(place.alias("bin")).agg(
        F.sum(F.when(F.col("__given") == "allow", F.col("__n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("__given") == "block", F.col("__n")).otherwise(0)).alias("no")
    )
    threshold = _threshold([(r.bin, r.yes, r.no) for r in bins.collect()])  # a bounded histogram
    scored = seen.join(of_url.select("__url", F.col("score").alias("__score")), "__url", "left").withColumn("score", F.coalesce("__score", F.lit(0.0)))
    final = F.coalesce("__given", F.when(F.col("score") >= threshold, F.lit("allow")).otherwise(F.lit("block")))
    return scored.withColumn("verdict", final).select(*[F.col(f"`{c}`") for c in rest], "host", "path", "rule", "verdict", "score")


def _threshold(bins: list[tuple[int, int, int]]) -> float:
    """Where the shares of accepted URLs below and rejected ones above are smallest together."""
    yes, no = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not yes or not no:
        return float("-inf")
    best, at, below_yes, below_no = (2.0, 0.0), 0.0, 0, 0
    last = None
    for b, y, n in sorted(bins):
        cost = below_yes / yes + 1 - below_no / no
        edge = b / (_BINS / (2 * _REACH)) - _REACH
        # In a gap between the classes, its middle.
        place = edge if last is None else (edge + last) / 2
        if cost < best[0]:
            best, at = (cost, place), place
        below_yes, below_no = below_yes + y, below_no + n
        last = (b + 1) / (_BINS / (2 * _REACH)) - _REACH
    return at
