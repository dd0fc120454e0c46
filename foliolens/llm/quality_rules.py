"""Quality by weak supervision: rules vote good, vote bad or abstain; EM weighs them.

Each text gets base counts and the votes of RULES. The distinct vote patterns (at most 3 to the
number of rules, whatever the input) are counted over all rows; expectation-maximisation over those
counts estimates every rule's accuracy on good and on bad texts and the share of good ones. A text
is kept if the posterior probability that it is good is at least 0.5 and the base rule passes. Only
DataFrame functions are used; EM's steps are aggregations of the pattern table.

Rows: a null text has no words, as the empty text; both fail the base rule. Texts are judged one by
one, so repeated rows, null keys and further columns need no rule. An empty table gives an empty
result. Word windows are compared by 64-bit hashes within one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import stored

_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]"
_PLAIN = r"^[(\"'«„“]?[\p{L}\p{M}\p{N}'’.-]+[.,;:!?)\"'»“”…]?$"
#: EM steps; the estimates move by less than 0.001 long before.
STEPS = 15
#: Accuracies on good and on bad texts before any is seen, and as how many rows that counts: rules are precise and narrow. A vote for
#: bad is rarely wrong, but each rule misses most kinds of bad text.
PRIOR, PRIOR_ROWS = (0.998, 0.2), 50
#: Bounds of the estimates, on good and on bad texts, so that no single vote decides alone.
BOUNDS = ((0.5, 0.999), (0.01, 0.99))


def counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the base counts and the further measures that rules look at."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    words = F.filter(F.split(whole, _SPACE), lambda w: w != "")
    df = df.withColumn("_text", whole).withColumn("_words", words).withColumn("n_words", F.size("_words").cast("long"))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(_WORD))
    df = df.withColumn("_lines", lines).withColumn("_n_lines", F.size("_lines"))
    # Hashes of the 3-word windows with their places, sorted so that equal ones meet.
    windows = F.transform("_words", lambda w, i: F.struct(F.xxhash64(w, F.get("_words", i + 1), F.get("_words", i + 2)).alias("h"), i.alias("i")))
    df = df.withColumn("_windows", F.sort_array(F.slice(windows, 1, F.greatest(F.lit(0), F.col("n_words").cast("int") - 2))))
    again = F.filter("_windows", lambda x, k: F.coalesce(x.h == F.get("_windows", k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get("_windows", k + 1).h, F.lit(False)))
    places = F.array_distinct(F.flatten(F.transform(again, lambda x: F.array(x.i, x.i + 1, x.i + 2))))
    length = F.length("_text")
    without = lambda chars: length - F.length(F.translate("_text", chars, ""))
    return df.select(
        *[c for c in df.columns if c == "_body" or not c.startswith("_")],
        F.length(F.translate("_text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        without("#*$%&|<>").cast("long").alias("n_symbols"),
        (F.col("_n_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(places).cast("long").alias("n_repeat_words"),
        F.col("_n_lines").cast("long").alias("n_lines"),
        F.size(F.filter("_words", lambda w: w.rlike(_PLAIN))).cast("long").alias("n_plain"),
        (F.size(F.split("_text", "!!")) - 1).cast("long").alias("n_shouts"),
        (length - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (length - F.length(F.regexp_replace("_text", r"\p{L}+", ""))).cast("long").alias("n_letters"),
    )


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, F.lit(1)).when(bad, F.lit(0))


def rules() -> dict[str, Column]:
    """The rules by name: 1 votes good, 0 votes bad, null abstains."""
    some = F.col("n_words") > 0
    share = lambda a, b: F.col(a) / F.when(F.col(b) > 0, F.col(b))
    return {
        "long_enough": _vote(F.col("n_words") >= 50, F.col("n_words") < 20),
        "word_length": _vote(share("word_chars", "n_words").between(3, 10), ~share("word_chars", "n_words").between(2, 14) | ~some),
        "few_symbols": _vote(share("n_symbols", "n_words") <= 0.02, share("n_symbols", "n_words") > 0.1),
        "few_repeats": _vote(share("n_repeat_words", "n_words") <= 0.15, share("n_repeat_words", "n_words") > 0.4),
        "new_lines": _vote((F.col("n_lines") > 1) & (share("n_dup_lines", "n_lines") <= 0.1), share("n_dup_lines", "n_lines") > 0.5),
        "few_shouts": _vote(share("n_shouts", "n_words") <= 0.01, share("n_shouts", "n_words") > 0.1),
        "lower_case": _vote(share("n_upper", "n_letters") <= 0.2, share("n_upper", "n_letters") > 0.5),
        "letters": _vote(share("n_letters", "word_chars") >= 0.93, share("n_letters", "word_chars") < 0.8),
        "plain_words": _vote(share("n_plain", "n_words") >= 0.8, share("n_plain", "n_words") < 0.6),
    }


def _odds(accuracies: dict[str, tuple[float, float]], good: float) -> Column:
    """Log-odds that a row is good; accuracies: by rule, the chance of a right vote on good and on bad rows."""
    import math

    total = F.lit(math.log(good / (1 - good)))
    for name, (on_good, on_bad) in accuracies.items():
        for vote, ratio in ((1, on_good / (1 - on_bad)), (0, (1 - on_good) / on_bad)):
            total = total + F.when(F.col(name) == vote, F.lit(math.log(ratio))).otherwise(0.0)
    return total


def posterior(accuracies: dict[str, tuple[float, float]], good: float) -> Column:
    return 1 / (1 + F.exp(-_odds(accuracies, good)))


def estimate(votes: DataFrame, names: list[str], steps: int = STEPS) -> tuple[dict[str, tuple[float, float]], float]:
    """Accuracies and the share of good rows, by EM over counted vote patterns."""
    patterns = stored(votes.groupBy(*names).count().coalesce(1), "vote-patterns")
    accuracies, good = {n: PRIOR for n in names}, 0.8

    def held(*counts: tuple[float, float]) -> tuple[float, ...]:
        """Accuracies from (right votes, votes) on good and on bad rows."""
        return tuple(min(most, max(least, (right + prior * PRIOR_ROWS) / (votes + PRIOR_ROWS))) for (right, votes), prior, (least, most) in zip(counts, PRIOR, BOUNDS, strict=True))

    for _ in range(steps):
        p, n = posterior(accuracies, good), F.col("count")
        sums = [F.sum(n).alias("rows"), F.sum(n * F.col("_p")).alias("good")]
        for name in names:
            for vote in (0, 1):
                on = F.when(F.col(name) == vote, n)
                sums += [F.sum(on * F.col("_p")).alias(f"{name}_good_{vote}"), F.sum(on * (1 - F.col("_p"))).alias(f"{name}_bad_{vote}")]
        s = {k: v or 0 for k, v in patterns.withColumn("_p", p).agg(*sums).first().asDict().items()}
        if not s["rows"]:
            break
        good = min(0.99, max(0.01, s["good"] / s["rows"]))
        accuracies = {
            name: held((s[f"{name}_good_1"], s[f"{name}_good_1"] + s[f"{name}_good_0"]), (s[f"{name}_bad_0"], s[f"{name}_bad_0"] + s[f"{name}_bad_1"]))
            for name in names
        }
    return accuracies, good


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of df: the key, base counts, the base verdict, the posterior and the verdict."""
    named = rules()
    measured = counts(df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text}`").alias("_body")), "_body")
    kept = stored(measured.select(key, *BASE, *[v.alias(n) for n, v in named.items()]), "votes")
    failed = base_failed()
    # Rows that fail the base rule are decided; those that pass teach what bad texts among them look like.
    accuracies, good = estimate(kept.filter(~failed), list(named))
    out = kept.select(key, *BASE, failed.alias("base_failed"), posterior(accuracies, good).alias("p_good"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def keep_good(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows of df that judge() keeps, with their columns."""
    fields = df.columns
    named = rules()
    votes = [F.col(f"_m.{n}") for n in named]
    body = df.select(F.struct(*[F.col(f"`{c}`") for c in fields]).alias("row"), F.col(f"`{text}`").alias("_body"))
    measured = counts(body, "_body")
    voted = measured.select("row", base_failed().alias("_failed"), F.struct(*[v.alias(n) for n, v in named.items()]).alias("_m"))
    # Filtered once written: a filter above would be pushed below the arrays and compute them anew for each of their uses.
    kept = stored(voted, "voted", compression="zstd").filter(~F.col("_failed"))
    accuracies, good = estimate(kept.select(*votes), list(named))
    return kept.select("row", *votes).filter(posterior(accuracies, good) >= 0.5).select("row.*")
