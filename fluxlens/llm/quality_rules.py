"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them, a posterior decides.

Everything is column expressions. What the fit needs is only how often each combination of votes occurs, a table whose
size depends on the number of rules and not on the corpus, so the iterations run on that table.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxlens.llm.tasks import settled

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the languages at hand; a text with hardly any of them is not running text.
FUNCTION_WORDS = (
    "the of and to in is that for with was on are this by as be from or an at it der die das und ist von mit den im ein nicht zu auf für des sich dem als "
    "auch le la les de et des en un une du que dans pour est qui sur pas par au avec el los las y que por para con una del se su al lo como no es"
).split()
ROUNDS = 100

#: Rule name, when it votes bad, when it votes good (else it abstains); conditions on the measures below.
RULES: tuple[tuple[str, str, str], ...] = (
    ("symbols", "n_symbols > 0.03 * n_words", "n_symbols = 0"),
    ("capitals", "n_capitals > 0.15 * word_chars", "n_capitals < 0.07 * word_chars"),
    ("exclamations", "n_exclamations > 0.03 * n_words", "n_exclamations = 0"),
    ("repeated_words", "n_repeat_words > 0.15 * n_words", "n_repeat_words < 0.05 * n_words"),
    ("repeated_lines", "n_dup_lines > 0.3 * n_lines", "n_dup_lines = 0"),
    ("word_length", "word_chars > 9 * n_words OR word_chars < 2.5 * n_words", "word_chars BETWEEN 3.5 * n_words AND 8 * n_words"),
    ("sentences", "n_stops < 0.02 * n_words", "n_stops BETWEEN 0.04 * n_words AND 0.4 * n_words"),
    ("distinct_words", "n_distinct < 2 * sqrt(n_words)", "n_distinct > 4 * sqrt(n_words) OR n_distinct > 0.5 * n_words"),
    ("function_words", "n_function_words < 3 AND n_words >= 30", "n_function_words >= 6"),
)


def _without(text: str, signs: str) -> Column:
    return F.char_length(F.translate(text, signs, ""))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more, the first occurrence included; n log n in the words.

    Windows are compared as 64-bit hashes. Sorted with their positions, repeated windows stand together; each covers
    three words, or fewer where the next one begins.
    """

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    def places(ordered: Column) -> Column:
        same = lambda x, i: F.coalesce(x["h"] == F.get(ordered, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(ordered, i + 1)["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(ordered, same), lambda x: x["p"]))

    def repeated(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        found = _let(ordered, lambda o: _let(places(o), covered))
        return F.when(F.size(F.array_distinct(windows)) < F.size(windows), found).otherwise(0)

    def windows(all_words: Column) -> Column:
        firsts = F.slice(all_words, F.lit(1), F.greatest(F.size(all_words) - 2, F.lit(0)))
        return F.transform(firsts, lambda w, i: F.xxhash64(w, F.get(all_words, i + 1), F.get(all_words, i + 2)))

    return _let(words, lambda w: _let(windows(w), repeated))


def measures(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What the rules look at, for every whole text; a null text is empty."""
    texts = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    words = F.array_remove(F.split("text", "[\\x20\\x09-\\x0D]+"), "")
    split = texts.select("doc_id", "text", words.alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    size = F.char_length("text")
    return split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        _without("text", SPACE).cast("long").alias("word_chars"),
        (size - _without("text", SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).cast("long").alias("n_repeat_words"),
        F.size("lines").alias("n_lines"),
        (size - _without("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ")).alias("n_capitals"),
        (size - _without("text", "!")).alias("n_exclamations"),
        (size - _without("text", ".!?…。！？")).alias("n_stops"),
        F.size(F.array_distinct("words")).alias("n_distinct"),
        F.size(F.array_intersect("words", F.array(*map(F.lit, sorted(set(FUNCTION_WORDS)))))).alias("n_function_words"),
    )


def fit_votes(patterns: Sequence[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, float]]]:
    """Prior log-odds of good quality, and for each rule the log-odds of its vote (-1 bad, 0 abstains, 1 good).

    `patterns` are combinations of votes and their counts. Each rule has its own chance of every vote for good and for
    bad texts; they start from the number of bad votes and follow expectation and maximisation until they stand still.
    Rules are taken to be better than chance: a bad vote never speaks for good quality, nor a good vote against it.
    """
    total = sum(n for _, n in patterns)
    if not total:
        return 0.0, []
    rules = len(patterns[0][0])
    good = [(0.95, 0.4, 0.1)[min(2, votes.count(-1))] for votes, _ in patterns]
    odds: list[dict[int, float]] = []
    prior = 0.0
    for _ in range(rounds):
        weight = sum(g * n for g, (_, n) in zip(good, patterns, strict=True))
        prior = math.log((weight + 1) / (total - weight + 1))
        odds = []
        for rule in range(rules):
            counts = {v: [0.5, 0.5] for v in (-1, 0, 1)}
            for g, (votes, n) in zip(good, patterns, strict=True):
                counts[votes[rule]][0] += g * n
                counts[votes[rule]][1] += (1 - g) * n
            own = {v: math.log(c[0] / (weight + 1.5)) - math.log(c[1] / (total - weight + 1.5)) for v, c in counts.items()}
            odds.append({-1: min(own[-1], 0.0), 0: own[0], 1: max(own[1], 0.0)})
        scores = [prior + sum(o[v] for o, v in zip(odds, votes, strict=True)) for votes, _ in patterns]
        renewed = [1 / (1 + math.exp(-max(-30.0, min(30.0, s)))) for s in scores]
        moved = max(abs(a - b) for a, b in zip(good, renewed, strict=True))
        good = renewed
        if moved < 1e-9:
            break
    return prior, odds


def judge(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, quality, kept.

    `quality` is the posterior probability of good quality. A text fails at the base with fewer than 50 words or more
    than half of them in repeated windows; others are kept from a quality of one half on. Null and empty texts have no
    words and fail. Null identifiers and repeated rows stay; other columns are not read; an empty table gives no rows.
    """
    voted = measures(documents, id_column, text_column)
    names = [f"vote_{name}" for name, _, _ in RULES]
    for name, bad, fine in RULES:
        voted = voted.withColumn(f"vote_{name}", F.when(F.expr(bad), -1).when(F.expr(fine), 1).otherwise(0))
    kept_columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    voted = settled(voted.select(*kept_columns, failed.alias("base_failed"), *names))
    # at most 3 to the power of the rules; texts that fail anyway do not shape the accuracies
    patterns = sorted((tuple(r[n] for n in names), r["n"]) for r in voted.where("not base_failed").groupBy(*names).agg(F.count("*").alias("n")).collect())
    prior, odds = fit_votes(patterns)
    score = F.lit(prior)
    for name, own in zip(names, odds, strict=False):
        score = score + F.when(F.col(name) == 1, own[1]).when(F.col(name) == -1, own[-1]).otherwise(own[0])
    quality = F.when(F.col("n_words") > 0, 1 / (1 + F.exp(-score))).otherwise(0.0)
    return voted.select(*kept_columns, "base_failed", quality.alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
