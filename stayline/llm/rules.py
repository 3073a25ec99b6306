"""Quality rules as weak supervision, in DataFrame operations only.

Each rule votes good (1), bad (0), or abstains (null) on a text. How far a rule can be trusted is not set by hand:
expectation-maximisation over the counts of vote patterns estimates the share of good texts and each rule's two accuracies,
and a text is kept if its posterior probability of being good reaches a threshold. There are at most 3^rules patterns, so
the counts that come to the driver have a fixed bound. The fit starts from the number of a text's bad votes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayline.llm.common import let
from stayline.sources.tables import materialize

BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
PLAIN = r"^\p{L}[\p{L}'-]*[.,;:!?]?$"
GRAM = 5
MIN_WORDS = 10
MOST_REPEATED = 20
KEEP_AT = 0.5
ROUNDS = 100
#: What the fit starts from: a text's probability of being good by its number of bad votes (the last holds for more), and the
#: Beta counts that pull the share of good texts and the accuracies, where few texts are seen, to these values.
START = (0.95, 0.4, 0.1)
PRIOR, RIGHT, STRENGTH = 0.8, 0.8, 10.0

#: name: (good if, bad if), over the measures of `measured`; neither is an abstention.
RULES = {
    "length": ("n_words >= 50", "false"),
    "word_length": ("word_chars between 3 * n_words and 10 * n_words", "word_chars > 20 * n_words or word_chars < 2 * n_words"),
    "symbols": ("20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    "letters": ("20 * n_letters >= 17 * word_chars", "4 * n_letters < 3 * word_chars"),
    "plain_words": ("10 * n_plain >= 9 * n_words", "10 * n_plain < 6 * n_words"),
    "lines": ("n_dup_lines = 0", "2 * n_dup_lines > n_lines"),
    "repeats": ("50 * n_repeat_words <= n_words", "100 * n_repeat_words > 20 * n_words"),
    "capitals": ("10 * n_capitals <= 3 * n_letters", "2 * n_capitals > n_letters"),
    "shouting": ("20 * n_marks <= n_words", "5 * n_marks > n_words"),
    "variety": ("3 * n_distinct >= n_words", "10 * n_distinct < n_words"),
}


def _gram_hashes(words: Column) -> Column:
    """A hash of each run of GRAM words."""
    count = F.size(words) - GRAM + 1

    def gram(i: Column) -> Column:
        return F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)])

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), gram)).otherwise(F.array().cast("array<bigint>"))


def _covered(grams: Column) -> Column:
    """How many words lie in runs whose hash occurs twice or more: the runs' starts in order, each up to the next one."""
    numbered = F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i")))

    def repeated(by_gram: Column) -> Column:
        def same(i: Column, other: Column) -> Column:
            return F.coalesce(F.get(by_gram, i)["g"] == F.get(by_gram, other)["g"], F.lit(False))

        marked = F.transform(by_gram, lambda s, i: F.when(same(i, i - 1) | same(i, i + 1), s["i"]))
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def width(starts: Column) -> Column:
        steps = F.transform(starts, lambda s, i: F.least(F.lit(GRAM), F.coalesce(F.get(starts, i + 1) - s, F.lit(GRAM))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    covered = let(F.array_sort(numbered), lambda by_gram: let(repeated(by_gram), width))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), covered).otherwise(F.lit(0).cast("long"))


def _removed(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def measures(text: Column) -> dict[str, Column]:
    """The measures of one text; null counts as empty. Words are runs of anything but blanks."""
    text = F.coalesce(text, F.lit(""))
    words = let(F.split(text, BLANK), lambda w: F.filter(w, lambda x: x != ""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    from_words = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
            F.size(F.filter(w, lambda x: x.rlike(PLAIN))).cast("long").alias("n_plain"),
            let(_gram_hashes(w), _covered).alias("n_repeat_words"),
        ),
    )
    from_lines = let(
        lines,
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    length = F.char_length(text)
    return {
        "from_words": from_words,
        "from_lines": from_lines,
        "word_chars": _removed(text, BLANK).cast("long"),
        "n_symbols": (length - _removed(text, r"[#*$%&|<>]")).cast("long"),
        "n_marks": (length - _removed(text, r"[!?]")).cast("long"),
        "n_capitals": (length - _removed(text, r"\p{Lu}")).cast("long"),
        "n_letters": (length - _removed(text, r"\p{L}")).cast("long"),
    }


def measured(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, measures, base_failed, votes) of every row, written once; votes is one number with a digit to the base of 3 per rule."""
    rows = docs.select(F.col(id_column).alias("id"), *[c.alias(n) for n, c in measures(F.col(text_column)).items()])
    rows = rows.select("id", "from_words.*", "from_lines.*", "word_chars", "n_symbols", "n_marks", "n_capitals", "n_letters")
    votes = F.lit(0)
    for place, (good, bad) in enumerate(RULES.values()):
        votes = votes + F.when(F.expr(good), 1).when(F.expr(bad), 2).otherwise(0) * 3**place
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return materialize(rows.select("*", failed.alias("base_failed"), votes.alias("votes")))


def estimate(patterns: dict[int, int], rounds: int = ROUNDS) -> dict[int, float]:
    """Posterior probability of being good for each pattern of votes, from the number of texts of each.

    A rule has two accuracies, on good and on bad texts; votes are independent given the text's kind, and an abstention says
    nothing. No texts give no posteriors.
    """
    names = list(RULES)
    digits = {code: [code // 3**p % 3 for p in range(len(names))] for code in patterns}
    posterior = {code: START[min(votes.count(2), len(START) - 1)] for code, votes in digits.items()}
    good, bad = [RIGHT] * len(names), [RIGHT] * len(names)
    for _ in range(rounds):
        total = sum(patterns.values())
        mass = sum(n * posterior[code] for code, n in patterns.items())
        prior = (mass + STRENGTH * PRIOR) / (total + STRENGTH)
        for p in range(len(names)):
            right_good = sum(n * posterior[c] for c, n in patterns.items() if digits[c][p] == 1)
            all_good = sum(n * posterior[c] for c, n in patterns.items() if digits[c][p])
            right_bad = sum(n * (1 - posterior[c]) for c, n in patterns.items() if digits[c][p] == 2)
            all_bad = sum(n * (1 - posterior[c]) for c, n in patterns.items() if digits[c][p])
            good[p] = (right_good + STRENGTH * RIGHT) / (all_good + STRENGTH)
            bad[p] = (right_bad + STRENGTH * RIGHT) / (all_bad + STRENGTH)
        for code, votes in digits.items():
            odds = math.log(prior / (1 - prior))
            for p, vote in enumerate(votes):
                if vote == 1:
                    odds += math.log(good[p] / (1 - bad[p]))
                elif vote == 2:
                    odds += math.log((1 - good[p]) / bad[p])
            posterior[code] = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
    return posterior


def judged(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", keep_at: float = KEEP_AT) -> DataFrame:
    """Every row with its measures, base_failed, posterior and kept: not failed, and a posterior of `keep_at` or more.

    Null and empty texts have no words and fail. Repeated rows count as often as they are there; an empty table gives no rows.
    """
    rows = measured(docs, id_column, text_column)
    passed = rows.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()
    posterior = estimate({r["votes"]: r["n"] for r in passed})
    found = [F.lit(x) for code, p in sorted(posterior.items()) for x in (code, p)]
    value = F.element_at(F.create_map(*found), F.col("votes")) if found else F.lit(0.0)
    out = rows.withColumn("posterior", value)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep_at)).withColumnRenamed("id", id_column)
