"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Built-in expressions only. Each rule votes good (1), bad (0) or abstains (-1) on a document. The
votes' patterns are counted over the whole corpus (at most 3 to the number of rules, whatever its
size), and expectation-maximisation over that table estimates the share of good documents and, per
rule, how it votes on either class. The posterior of a document's own pattern is its quality.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored

SPACE = r"[\x20\x09-\x0D]+"
ROUNDS = 25
# A rule: its value, good at or under the first bound, bad over the second, else it abstains.
RULES = {
    "repeated": ("n_repeat_words / n_words", 0.05, 0.2),
    "symbols": ("n_symbols / n_words", 0.02, 0.1),
    "lines": ("n_dup_lines / n_lines", 0.1, 0.3),
    "capitals": ("n_upper / greatest(n_letters, 1)", 0.15, 0.4),
    "letters": ("1 - n_letters / word_chars", 0.2, 0.4),
    "shouts": ("n_shouts / n_words", 0.05, 0.3),
    "short": ("20 / n_words", 0.8, 1.5),
    "width": ("abs(word_chars / n_words - 6)", 3.0, 5.0),
}


def _repeats(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more in the text.

    Windows are compared by 64-bit hash. Nearly all texts repeat nothing, which a hash set of their
    windows shows; else windows are sorted, equal neighbours marked, and the marked ones' extents added up.
    """

    def windows(w: Column) -> Column:
        n = F.size(w) - (width - 1)
        places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))

    def starts(a: Column) -> Column:
        size = F.size(a)
        before = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(a, F.lit(1), size - 1))
        after = F.slice(a, F.lit(2), size)
        near = F.arrays_zip(a.alias("x"), before.alias("b"), after.alias("n"))
        hit = F.filter(near, lambda z: z["x"]["h"].eqNullSafe(z["b"]["h"]) | z["x"]["h"].eqNullSafe(z["n"]["h"]))
        return F.sort_array(F.transform(hit, lambda z: z["x"]["i"]))

    def covered(s: Column) -> Column:
        gaps = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.coalesce(F.least(F.lit(width), b - a), F.lit(width)))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    def once(value: Column, f) -> Column:
        """f(value) with the value computed once: as a lambda's variable, and not again wherever it is used."""
        return F.transform(F.array(value), f)[0]

    def count(h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(once(once(pairs, starts), covered))

    return once(once(words, windows), count)


def measure(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and the counts that rules look at. A null or empty text has zero of everything."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*keep, t.alias("_t"), F.filter(F.split(t, SPACE), lambda w: w != "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace("_t", pattern, ""))

    rows = rows.withColumns({"_l": lines, "_r": _repeats(F.col("_w"))})
    return rows.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        left(SPACE).cast("long").alias("word_chars"),
        (F.length("_t") - left(r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.col("_r").cast("long").alias("n_repeat_words"),
        F.size("_l").cast("long").alias("n_lines"),
        (F.length("_t") - left(r"\p{Lu}+")).cast("long").alias("n_upper"),
        (F.length("_t") - left(r"\p{L}+")).cast("long").alias("n_letters"),
        (F.length("_t") - left(r"!+")).cast("long").alias("n_shouts"),
    )


def _vote(name: str) -> Column:
    value, good, bad = F.expr(RULES[name][0]), *RULES[name][1:]
    return F.when(F.col("n_words") == 0, -1).when(value <= good, 1).when(value > bad, 0).otherwise(-1)


def weigh(votes: DataFrame, rules: list[str], rounds: int = ROUNDS) -> tuple[float, dict]:
    """Share of good documents, and per rule its chances to vote (good, bad, abstain) on either class.

    ``votes`` has a column per rule. Spark counts the patterns over all rows; the driver gets the table of
    them, at most 3 to the number of rules (6,561 here) rows whatever the input. Rules start as right four
    times in five when they vote. One starting document is added to every sum: an empty table leaves the start.
    """
    start = {1: (0.4, 0.1, 0.5), 0: (0.1, 0.4, 0.5)}
    table = [(tuple(r[n] for n in rules), r["count"]) for r in votes.groupBy(*rules).count().collect()]
    share, chances = 0.5, {r: start for r in rules}
    place = {1: 0, 0: 1, -1: 2}
    for _ in range(rounds):
        sums = {r: {1: list(start[1]), 0: list(start[0])} for r in rules}
        good_total, total = 1.0, 2.0
        for pattern, n in table:
            odds = math.log(share / (1 - share)) + sum(_evidence(chances[r])[place[v]] for r, v in zip(rules, pattern, strict=True))
            good = 1 / (1 + math.exp(-odds))
            good_total, total = good_total + n * good, total + n
            for r, v in zip(rules, pattern, strict=True):
                sums[r][1][place[v]] += n * good
                sums[r][0][place[v]] += n * (1 - good)
        share = good_total / total
        chances = {r: {c: tuple(x / sum(own) for x in own) for c, own in by.items()} for r, by in sums.items()}
    return share, chances


def _evidence(by: dict) -> tuple[float, float, float]:
    """Log likelihood ratio of a vote for good, for bad, and of abstaining, which says nothing."""
    return math.log(by[1][0] / by[0][0]), math.log(by[1][1] / by[0][1]), 0.0


def posterior(share: float, chances: dict) -> Column:
    """Chance that a row with these votes is good."""
    odds = F.lit(math.log(share / (1 - share)))
    for r, by in chances.items():
        for_good, for_bad, _ = _evidence(by)
        odds = odds + F.when(F.col(r) == 1, for_good).when(F.col(r) == 0, for_bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), rounds: int = ROUNDS) -> DataFrame:
    """The columns ``keep``, the counts, ``base_failed``, ``quality`` (posterior) and ``kept``; one row per row.

    Abstaining says nothing about a document. Texts are read once and only counts are stored. Null and empty
    texts have no words, fail the base rule and are not kept; repeated rows stay; an empty table gives none.
    """
    rules = list(RULES)
    counts = stored(measure(docs, text, keep).withColumns({f"vote_{r}": _vote(r) for r in rules}), "quality")
    names = [f"vote_{r}" for r in rules]
    quality = posterior(*weigh(counts, names, rounds))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counts.withColumns({"base_failed": failed, "quality": quality}).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)
    )


def digest(judged: DataFrame) -> DataFrame:
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *counts, "base_failed", "kept", F.round("quality", 6).alias("quality"))
