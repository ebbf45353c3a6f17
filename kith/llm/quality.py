"""Quality rules by weak supervision.

Rules vote 1 (good), -1 (bad) or 0 (abstain) on statistics of a text. Expectation-maximisation over the
counts of vote patterns estimates how each rule votes on good documents and on those of each kind of fault; a document is kept when
the posterior probability that it is good reaches ``threshold``. Spark counts the patterns, which are at most 3 ** len(RULES) whatever
the size of the corpus; only these counts pass through the driver.

Defined cases: a null text counts as empty; empty texts have zero counts and fail the base rules; rows with
equal or null ids are judged row by row; an empty table gives an empty result; columns of the input other
than the text are carried along, unless they have the name of a result.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kith.llm.common import SPACE_CHARS, free, word_list
from kith.sources.workspace import materialize

WINDOW = 5

STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct",
              "n_upper", "n_exclaim", "n_ends", "base_failed"]


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` does, and abstains where neither or both do."""

    name: str
    good: Callable[[], Column]
    bad: Callable[[], Column]


def _share(part: str, whole: str = "n_words") -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


_NEVER = lambda: F.lit(False)

#: Faults are of different kinds, so a bad document has the good marks of all other kinds. Rules on faults therefore abstain where
#: theirs is missing, and only one rule votes for good prose: correlated good votes would outvote a single certain fault.
RULES = [
    Rule("symbols", _NEVER, lambda: _share("n_symbols") > 0.1),
    Rule("capitals", _NEVER, lambda: _share("n_upper", "word_chars") > 0.4),
    Rule("exclamations", _NEVER, lambda: _share("n_exclaim") > 0.25),
    Rule("repeated_words", _NEVER, lambda: _share("n_repeat_words") > 0.2),
    Rule("variety", _NEVER, lambda: (F.col("n_words") >= 20) & (F.col("n_distinct") < F.sqrt(F.col("n_words")))),
    Rule("word_length", _NEVER, lambda: (_share("word_chars") < 2) | (_share("word_chars") > 20)),
    Rule("repeated_lines", _NEVER, lambda: (F.col("n_lines") >= 4) & (_share("n_dup_lines", "n_lines") > 0.3)),
    Rule("length", _NEVER, lambda: F.col("n_words") < 10),
    Rule("sentences", lambda: _share("n_ends").between(0.01, 0.34), _NEVER),
]

#: Classes: good documents, and bad ones by the rule whose fault they have.
FAULTS = [j for j, rule in enumerate(RULES) if rule.name != "sentences"]
CLASSES = [-1, *FAULTS]


def start(cls: int, j: int) -> tuple[float, float, float]:
    """How rule ``j`` is first taken to vote (good, bad, abstain) on a document of a class."""
    if cls == j:
        return 0.05, 0.9, 0.05
    return (0.6, 0.005, 0.395) if cls < 0 else (0.5, 0.05, 0.45)


PRIOR, WEIGHT = 0.8, 10.0  # share of good documents at the start; documents each start counts for


def measure(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the statistics and drop nothing; the text stays as it is."""
    t = F.coalesce(F.col(text), F.lit(""))
    words, kept_lines, hashes, ranked, starts = free(df, "__words", "__lines", "__hashes", "__ranked", "__starts")
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE_CHARS))) > 0)
    at = lambda i: F.get(F.col(ranked), i)["h"]
    return (
        df.drop(*STATISTICS)
        .withColumns({words: word_list(F.col(text)), kept_lines: lines})
        .withColumn("n_words", F.size(words).cast("long"))
        .withColumns({
            hashes: F.when(F.col("n_words") > WINDOW, F.transform(
                F.sequence(F.lit(0), (F.col("n_words") - WINDOW).cast("int")),
                lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(WINDOW)]))),
            "n_lines": F.size(kept_lines).cast("long"),
            "n_dup_lines": (F.size(kept_lines) - F.size(F.array_distinct(kept_lines))).cast("long"),
            "n_distinct": F.size(F.array_distinct(words)).cast("long"),
            "n_ends": F.size(F.filter(F.col(words), lambda w: F.right(w, F.lit(1)).isin(".", "!", "?"))).cast("long"),
            "word_chars": F.length(F.array_join(words, "")).cast("long"),
            "n_symbols": F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"),
            "n_exclaim": (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long"),
            "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long")})
        # Windows are sorted with their places only where some window occurs twice.
        .withColumn(ranked, F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes),
            F.array_sort(F.transform(F.col(hashes), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn(starts, F.array_sort(F.filter(F.transform(
            F.col(ranked), lambda x, k: F.when((x["h"] == at(k - 1)) | (x["h"] == at(k + 1)), x["i"])), F.isnotnull)))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(F.transform(
            F.col(starts), lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col(starts), k + 1) - p, F.lit(WINDOW)))),
            F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop(words, kept_lines, hashes, ranked, starts))


def with_votes(measured: DataFrame) -> DataFrame:
    """Add ``votes``, one letter a rule: g, b or a."""
    letters = [F.when(r.good() & ~r.bad(), "g").when(r.bad() & ~r.good(), "b").otherwise("a") for r in RULES]
    return measured.withColumn("votes", F.concat(*letters))


def estimate(counts: dict[str, int], rounds: int = 10) -> dict[str, float]:
    """Expectation-maximisation on the counts of vote patterns: the posterior of being good for each.

    Bad documents are a mixture, a class for each kind of fault: rules are independent within a class, and a certain fault isn't
    outvoted by the other kinds being absent.
    """
    patterns, total = sorted(counts), sum(counts.values())
    prior = {c: PRIOR if c < 0 else (1 - PRIOR) / len(FAULTS) for c in CLASSES}
    table = {(c, j, m): start(c, j)[k] for c in CLASSES for j in range(len(RULES)) for k, m in enumerate("gba")}
    for round_ in range(rounds + 1):
        posterior = {}
        for v in patterns:
            logs = {c: math.log(prior[c]) + sum(math.log(table[c, j, m]) for j, m in enumerate(v)) for c in CLASSES}
            top = max(logs.values())
            shares = {c: math.exp(x - top) for c, x in logs.items()}
            whole = sum(shares.values())
            posterior[v] = {c: x / whole for c, x in shares.items()}
        if round_ == rounds:
            break
        for c in CLASSES:
            mass = sum(counts[v] * posterior[v][c] for v in patterns)
            prior[c] = (mass + 1) / (total + len(CLASSES))
            for j in range(len(RULES)):
                for k, m in enumerate("gba"):
                    seen = sum(counts[v] * posterior[v][c] for v in patterns if v[j] == m)
                    table[c, j, m] = (seen + WEIGHT * start(c, j)[k]) / (mass + WEIGHT)
    return {v: p[-1] for v, p in posterior.items()}


def posteriors(voted: DataFrame, rounds: int = 10) -> DataFrame:
    """``(votes, posterior)`` of every vote pattern that occurs, at most 3 ** len(RULES) rows; Spark counts them."""
    counts = {r[0]: r[1] for r in voted.groupBy("votes").agg(F.count("*")).collect()}
    found = estimate(counts, rounds) if counts else {"": 0.0}
    rows = ", ".join(f"('{v}', {p!r}D)" for v, p in sorted(found.items()))
    return voted.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(votes, posterior)")


def judge(voted: DataFrame, table: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Add ``posterior`` and ``kept``. The table is bounded by the number of rules, so it is broadcast.

    Both come from the table: a filter on ``kept`` that named the statistics would be pushed below them and compute them anew in each lambda.
    """
    (key,) = free(voted, "key")
    both = table.select(
        F.explode(F.array(*[F.struct(F.concat("votes", F.lit(mark)).alias(key), F.col("posterior"),
                                     (F.lit(mark == "0") & (F.col("posterior") >= threshold)).alias("kept")) for mark in "01"])).alias("t")).select("t.*")
    known = F.concat("votes", F.when(F.col("base_failed"), "1").otherwise("0"))
    return voted.withColumn(key, known).join(F.broadcast(both), key).drop(key)


def quality_rules(df: DataFrame, text: str = "text", rounds: int = 10, threshold: float = 0.5) -> DataFrame:
    """All columns of ``df`` with statistics, ``votes``, ``posterior`` and ``kept``.

    Texts are measured twice, for the patterns and for the verdict, so that no copy of them is stored.
    """
    voted = with_votes(measure(df.drop("votes", "posterior", "kept"), text))
    return judge(voted, posteriors(voted, rounds), threshold)


def verdicts(df: DataFrame, keys: list[str], text: str = "text", rounds: int = 10, threshold: float = 0.5) -> DataFrame:
    """As ``quality_rules`` without the texts: ``keys`` and results, measured once and stored in between."""
    voted = materialize(with_votes(measure(df.select(*keys, text), text).drop(text)), "quality")
    return judge(voted, posteriors(voted, rounds), threshold)
