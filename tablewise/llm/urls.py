"""Verdicts on URLs by rules and, where none fits, by two character models.

The method: variable-order Markov models (contexts of two, one and no symbols, mixed by
Witten-Bell weights) of accepted and of rejected URLs, trained on all rows. The mean over a URL's symbols of
the difference of the log likelihoods, rejected less accepted, is compared with a threshold that
separates held-out labelled URLs best. A URL counts as rejected in training if a rule blocks
it or a part of its host, between dots and dashes, is a word of ``REJECTED_WORDS``, else as accepted.

Symbols are 32 classes, so a model has at most 32,768 counts whatever the table's size; they are
turned into one table of log ratios, and every URL is scored where it is read.

A null or empty URL has score 0. Repeated rows get equal results; other columns aren't read.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewise.llm.common import ascii_lower, bound

#: (verdict, host and path that a URL's host ends with and its path begins with)
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: Parts of hosts that make a URL rejected in training; "downloads" is no "ads".
REJECTED_WORDS = ("spam", "pills", "casino", "bets", "adult", "ads", "porn", "viagra", "poker", "lottery")
#: The 32nd class stands before a URL; "~" is any other character, "0" any digit.
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0./-~^"
SIZE = len(SYMBOLS)
HELD_FOLDS = 5
BINS = 400


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return ascii_lower(part(1)), part(2)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        at = rule.index("/")
        fits = ((host == rule[:at]) | host.endswith("." + rule[:at])) & path.startswith(rule[at:])
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def symbols(url: Column) -> Column:
    """The classes of a URL's characters, after two that stand for its beginning, as numbers from 0."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), "[0-9]", "0"), "[^a-z0./-]", "~")
    letters = F.filter(F.split(F.concat(F.lit("^^"), plain), ""), lambda c: c != "")
    return F.transform(letters, lambda c: F.instr(F.lit(SYMBOLS), c) - 1)


def grams(codes: Column) -> Column:
    """Every symbol with the two before it, as a number below ``SIZE`` ** 3."""
    return bound(codes, lambda c: F.transform(
        F.when(F.size(c) > 2, F.sequence(F.lit(2), F.size(c) - 1)).otherwise(F.array().cast("array<int>")),
        lambda i: c[i - 2] * (SIZE * SIZE) + c[i - 1] * SIZE + c[i]))


def markov_logs(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of symbols after two others, from counts [before, before, symbol]."""
    chance = np.full((1, 1, SIZE), 1 / SIZE)
    for seen in (counts.sum((0, 1), keepdims=True), counts.sum(0, keepdims=True), counts):
        kinds, total = (seen > 0).sum(2, keepdims=True), seen.sum(2, keepdims=True)
        chance = np.where(total > 0, (seen + kinds * chance) / np.maximum(total + kinds, 1), chance)
    return np.log(np.broadcast_to(chance, counts.shape))


def log_ratios(counted: list[tuple[int, int, int]]) -> np.ndarray:
    """Log ratio of rejected to accepted of every gram, from (gram, accepted, rejected)."""
    accepted, rejected = np.zeros(SIZE**3), np.zeros(SIZE**3)
    for gram, a, r in counted:
        accepted[gram], rejected[gram] = a, r
    shape = (SIZE, SIZE, SIZE)
    return (markov_logs(rejected.reshape(shape)) - markov_logs(accepted.reshape(shape))).ravel().round(6)


def best_threshold(histogram: list[tuple[int, int, int]]) -> float:
    """The threshold with the best mean of both classes' shares on the right side, from (bin, accepted, rejected)."""
    accepted, rejected = np.zeros(BINS), np.zeros(BINS)
    for place, a, r in histogram:
        accepted[place], rejected[place] = a, r
    if not accepted.sum() or not rejected.sum():
        return 0.0
    right = np.append(0, accepted.cumsum()) / accepted.sum() + 1 - np.append(0, rejected.cumsum()) / rejected.sum()
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float((best[0] + best[-1]) / 2 * 8 / BINS - 4)


def labelled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule, ruled (the rule's verdict) and whether the URL counts as rejected in training."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, ruled = fitting_rule(F.col("host"), F.col("path"), rules)
    rejected = F.coalesce(ruled == "block", F.lit(False)) | F.col("host").rlike(f"(^|[.-])({'|'.join(REJECTED_WORDS)})([.:-]|$)")
    return base.select("*", rule.alias("rule"), ruled.alias("ruled"), rejected.alias("rejected"))


def train(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Log ratios and threshold from ``labelled`` rows; both queries give bounded counts."""
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_FOLDS)) == 0
    split = lambda flag: (F.sum((~flag).cast("long")).alias("accepted"), F.sum(flag.cast("long")).alias("rejected"))
    counted = rows.where(~held).select("rejected", F.explode(grams(symbols(F.col("url")))).alias("gram")).groupBy("gram").agg(*split(F.col("rejected")))
    ratios = log_ratios([tuple(r) for r in counted.collect()])
    place = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((score(F.col("url"), ratios) + 4) * BINS / 8)))
    open_ = rows.where(held & F.col("ruled").isNull()).select("rejected", place.cast("int").alias("bin"))
    return ratios, best_threshold([tuple(r) for r in open_.groupBy("bin").agg(*split(F.col("rejected"))).collect()])


def score(url: Column, ratios: np.ndarray) -> Column:
    """Mean log ratio of the URL's symbols; above 0: likelier rejected."""
    table = F.from_json(F.lit(json.dumps(ratios.tolist())), "array<double>")
    total = lambda codes: F.aggregate(codes, F.lit(0.0), lambda sum_, gram: sum_ + F.get(table, gram))
    return bound(grams(symbols(url)), lambda codes: F.when(F.size(codes) > 0, total(codes) / F.size(codes)).otherwise(0.0))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score and threshold of every page."""
    rows = labelled(pages, rules)
    ratios, threshold = train(rows)
    scored = rows.withColumn("score", score(F.col("url"), ratios))
    verdict = F.coalesce("ruled", F.when(F.col("score") > threshold, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))
