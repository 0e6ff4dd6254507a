"""Quality by weak supervision.

Each rule votes to keep (1), votes to reject (0) or abstains on a document. Expectation-maximisation estimates, without
labels, how often each rule is right about good and about bad documents, and the posterior probability of good quality
decides, instead of every rule having to pass. Some hard conditions (``base_failed``) stay outside the vote.

What a document's votes are is one of at most ``3 ** rules`` patterns (177,147 with eleven), so the model is fitted exactly,
over all documents, on the counts of patterns, and applied by a join on the pattern; that many rows are collected and
broadcast at most, however large the corpus.

DataFrame expressions only (the model is fitted on the driver from the counts). Features are array functions over one document: no shuffle carries texts or words, and a very
long document is one row of linear work (sorting its windows only where some repeat). Windows are compared by 64-bit hashes within one text.

Defined results: a null or empty text has no words, fails the base conditions and isn't kept; a null key passes through; repeated
rows get equal results; columns with the features' names in ``docs`` don't disturb ``keep_good``; an empty table gives no rows.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import cut

SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: A word of letters alone, with the marks that may follow it.
PLAIN = r"(?<![^\x20\x09-\x0D])[\p{L}'’-]++[.,;:!?]*+(?![^\x20\x09-\x0D])"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in is that it for was with on are as be this by at from or an not have "
    "le la les de des et un une que en est dans pour qui du au pas sur "
    "der die das und den von mit ist des ein eine nicht zu im auf dem sich "
    "el los las y en un una que no se por con para del"
).split()

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_distinct_words", "n_stop_words", "n_plain_words", "n_upper", "n_marks")


def features(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and FEATURES of its text. Each step names what later steps use more than once, so that Catalyst evaluates it once."""
    without = lambda chars: F.length("t") - F.length(F.translate("t", chars, ""))
    df = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("t"))
    df = df.select(
        *keep,
        F.filter(F.split("t", SPACE_RE), lambda w: w != "").alias("words"),
        F.filter(F.split("t", "\n"), lambda line: F.translate(line, SPACES, "") != "").alias("lines"),
        F.length(F.translate("t", SPACES, "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(PLAIN)).cast("long").alias("n_plain_words"),
        without(SYMBOLS).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        without("!").cast("long").alias("n_marks"),
    )
    small = ["word_chars", "n_plain_words", "n_symbols", "n_upper", "n_marks"]
    df = df.select(
        *keep, *small,
        F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h1"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda line: F.regexp_like(line, F.lit("[.!?][\"”»)]?[\\x20\\x09-\\x0D]*$")))).cast("long").alias("n_ended_lines"),
    )
    stops = F.transform(F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)]), lambda w: F.xxhash64(w))
    small += ["n_words", "n_lines", "n_dup_lines", "n_ended_lines"]
    pair = lambda name, by: F.zip_with(name, F.slice(name, by + 1, F.greatest(F.lit(1), F.col("n_words").cast("int"))), lambda a, b: F.xxhash64(a, b))
    df = df.select(
        *keep, *small, pair("h1", 1).alias("h2"),
        F.size(F.array_distinct("h1")).cast("long").alias("n_distinct_words"),
        F.size(F.array_intersect("h1", stops)).cast("long").alias("n_stop_words"),
    )
    small += ["n_distinct_words", "n_stop_words"]
    df = df.select(*keep, *small, pair("h2", 2).alias("h4"))
    windows = F.slice(pair("h4", 4), 1, F.greatest(F.lit(0), F.col("n_words").cast("int") - (WINDOW - 1)))
    df = df.select(*keep, *small, windows.alias("h8"))
    repeats = F.size(F.array_distinct("h8")) < F.size("h8")
    df = df.select(*keep, *small, F.when(repeats, F.array_sort(F.transform("h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("s"))
    equal = F.zip_with("s", F.slice("s", 2, F.size("s")), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    starts = F.array_sort(F.array_distinct(F.flatten(equal)))
    zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"))
    covered = F.aggregate(starts, zero, step, lambda acc: acc["n"])
    return df.select(*keep, *small, F.when(F.col("s").isNull(), F.lit(0)).otherwise(covered).cast("long").alias("n_repeat_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit("0")).when(good, F.lit("1")).otherwise(F.lit("-"))


def rules() -> dict[str, Column]:
    """Votes by rule: '1' keep, '0' reject, '-' abstain. Shares over no words or lines are null and abstain."""
    n, lines = F.col("n_words"), F.col("n_lines")
    share = lambda name, of: F.try_divide(F.col(name), of)
    symbols, dups, repeats = share("n_symbols", n), share("n_dup_lines", lines), share("n_repeat_words", n)
    length, ended, marks = share("word_chars", n), share("n_ended_lines", lines), share("n_marks", n)
    upper = share("n_upper", F.col("word_chars"))
    plain = share("n_plain_words", n)
    variety = F.try_divide(F.log(F.col("n_distinct_words") + 1), F.log(F.col("n_words") + 1))
    return {
        "length": _vote(F.col("n_words") >= 40, F.col("n_words") < 20),
        "word_length": _vote(length.between(3, 10), (length < 2.5) | (length > 12)),
        "symbols": _vote(symbols <= 0.02, symbols >= 0.1),
        "dup_lines": _vote(dups == 0, dups >= 0.3),
        "repeats": _vote(repeats == 0, repeats >= 0.25),
        "ended_lines": _vote(ended >= 0.5, ended < 0.2),
        "stop_words": _vote(F.col("n_stop_words") >= 3, F.col("n_stop_words") == 0),
        "upper": _vote(upper <= 0.1, upper >= 0.3),
        "variety": _vote(variety >= 0.75, variety < 0.6),
        "plain_words": _vote(plain >= 0.9, plain < 0.7),
        "marks": _vote(marks <= 0.05, marks >= 0.2),
    }


def fit(patterns: dict[str, int], change: float = 1e-9, warn_after: int = 10_000) -> tuple[float, list[float], list[float]]:
    """(share of good documents, each rule's accuracy on good ones, and on bad ones) by expectation-maximisation over counts of vote patterns.

    Abstaining says nothing. It starts from rules that seldom reject good documents and that each find a part of the bad ones;
    a rule stays no worse than chance (both accuracies sum to one at least), which keeps the two classes from trading places. Rounds go on
    until no number changes by more than ``change``; should they not settle within ``warn_after`` rounds, a warning says so and the last numbers stand.
    """
    m = len(next(iter(patterns), ""))
    prior, good, bad = 0.8, [0.99] * m, [0.3] * m
    votes = np.asarray([[{"0": 0, "1": 1}.get(v, -1) for v in p] for p in patterns], np.int8).reshape(len(patterns), m)
    n = np.asarray(list(patterns.values()), float)
    keep, drop = (votes == 1).astype(float), (votes == 0).astype(float)
    for _ in range(warn_after):
        was = np.asarray([prior, *good, *bad])
        g, b = np.asarray(good), np.asarray(bad)
        odds = math.log(prior) - math.log1p(-prior) + keep @ (np.log(g) - np.log1p(-b)) + drop @ (np.log1p(-g) - np.log(b))
        post = 1 / (1 + np.exp(-np.clip(odds, -700, 700)))
        prior = float(((n * post).sum() + 1) / (n.sum() + 2))
        of_good, of_bad = n * post, n * (1 - post)
        kept, gone = (of_good @ keep, of_good @ drop), (of_bad @ keep, of_bad @ drop)
        g = (kept[0] + 19) / (kept[0] + kept[1] + 20)
        b = np.maximum((gone[1] + 8) / (gone[0] + gone[1] + 20), 1 - g)
        good, bad = g.tolist(), b.tolist()
        if not m or np.abs(was - [prior, *good, *bad]).max() <= change:
            return prior, good, bad
    warnings.warn(f"accuracies still change after {warn_after} rounds", stacklevel=2)
    return prior, good, bad


def posterior(pattern: str, prior: float, good: list[float], bad: list[float]) -> float:
    """The probability of good quality, given the votes."""
    odds = math.log(prior) - math.log1p(-prior)
    for v, g, b in zip(pattern, good, bad, strict=True):
        if v == "1":
            odds += math.log(g) - math.log1p(-b)
        elif v == "0":
            odds += math.log1p(-g) - math.log(b)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _judged(found: DataFrame, threshold: float, name: str) -> DataFrame:
    """``found`` (with votes) as a written table, with base_failed, p_good and kept."""
    written = cut(found, name)
    counts = {r["votes"]: r["n"] for r in written.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    prior, good, bad = fit(counts)
    table = [(p, posterior(p, prior, good, bad)) for p in counts]
    told = found.sparkSession.createDataFrame(table, "votes string, p_good double")
    failed = F.coalesce(F.expr(BASE_FAILED), F.lit(True))
    out = written.join(F.broadcast(told), "votes", "left")
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))


def judge(docs: DataFrame, threshold: float = 0.5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, the base features, base_failed, kept, votes and the posterior p_good of every document."""
    found = features(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), "text", ["doc_id"])
    found = found.withColumn("votes", F.concat(*rules().values()))
    out = _judged(found, threshold, "quality")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", "p_good")


def keep_good(docs: DataFrame, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns alone. The rows are written once with their votes, so texts are neither judged twice nor shuffled."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    found = features(whole, "text", ["row"]).withColumn("votes", F.concat(*rules().values()))
    return _judged(found.select("row", "votes", "n_words", "n_repeat_words"), threshold, "quality").where("kept").select("row.*")
