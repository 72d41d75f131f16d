"""Quality rules under weak supervision.

Each rule looks at a document's measures and votes good (1), bad (-1) or abstains (0). How far each
rule can be trusted is not known, so expectation-maximisation estimates it from how the rules agree:
a document is good or bad with some prior, and a rule votes with a probability that depends on that
hidden class. The posterior probability of being good replaces the demand that all rules pass.

Everything is built from SQL functions. Measures come from arrays inside the row, so texts are not
shuffled. Documents with equal votes are alike for the model, and there are at most 3^rules vote
patterns however many documents there are: their counts are one grouped sum (combined before the
shuffle, so no source or copy group is hot), the iterations run over that one short list, and the
posteriors, again one row per pattern, are joined back by pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltarc.llm.common import others, settle, shielded

SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
            "n_upper", "n_letters", "n_ended_lines"]
RESULTS = [*MEASURES, "votes", "p_good", "base_failed", "kept"]
ITERATIONS = 25
SMOOTHING = 1.0  # added votes of each sort, so that no probability is 0 or 1
PRIOR_GOOD = 0.9  # where the iterations start
TRUST = 0.8  # at the start, the probability that a vote that is given is right
KEEP_AT = 0.5


@shielded
def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measures. Words are runs of anything but ASCII white space; a NULL text has none.
    Letters are those with case."""
    keep = others(docs, MEASURES)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    a = docs.select(*keep, body.alias("_text"))
    a = a.withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != ""))
    a = a.withColumn("_lines", F.filter(F.split("_text", "\n"),
                                        lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_words")
    words = F.col("_words")
    window = lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1),
                                   F.get(words, i + 2))
    a = a.withColumn("_grams", F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), window))
                     .otherwise(F.array().cast("array<string>")))
    repeats = F.size(F.array_distinct("_grams")) < F.size("_grams")
    a = a.withColumn("_order", F.when(repeats, F.array_sort(F.transform(
        "_grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    # A window repeats if a neighbour in sorted order is equal to it.
    same = lambda x, k: (F.get("_order", k)["g"] == x["g"]).eqNullSafe(True)
    again = F.transform(F.filter("_order", lambda x, k: same(x, k - 1) | same(x, k + 1)),
                        lambda x: x["i"])
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        again, lambda i: F.array(i, i + 1, i + 2)))))
    size = lambda c: F.length(c).cast("long")
    return a.select(
        *keep, n.cast("long").alias("n_words"),
        size(F.array_join("_words", "")).alias("word_chars"),
        size(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(repeats, covered).otherwise(0).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        size(F.regexp_replace("_text", r"[^\p{Lu}]+", "")).alias("n_upper"),
        size(F.regexp_replace("_text", r"[^\p{Lu}\p{Ll}]+", "")).alias("n_letters"),
        F.size(F.filter("_lines", lambda x: x.rlike(r"[.!?:;\"'»”。！？][\x20\x09-\x0D]*$")))
        .cast("long").alias("n_ended_lines"))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")


def default_rules() -> dict[str, Column]:
    """Rule name -> vote over the measures."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    letters, chars = F.greatest("n_letters", F.lit(1)), F.greatest("word_chars", F.lit(1))
    mean = F.col("word_chars") / words
    c = F.col
    return {
        "length": _vote(c("n_words") < 20, c("n_words") >= 50),
        "word_length": _vote((mean < 2.5) | (mean > 15), (mean >= 3) & (mean <= 11)),
        "symbols": _vote(c("n_symbols") > 0.1 * words, c("n_symbols") <= 0.02 * words),
        "dup_lines": _vote(c("n_dup_lines") > 0.3 * lines, c("n_dup_lines") == 0),
        "repeats": _vote(c("n_repeat_words") > 0.3 * words, c("n_repeat_words") <= 0.05 * words),
        "upper": _vote(c("n_upper") > 0.4 * letters, c("n_upper") <= 0.2 * letters),
        "letters": _vote(c("n_letters") < 0.6 * chars, c("n_letters") >= 0.8 * chars),
        "endings": _vote((c("n_ended_lines") == 0) & (c("n_words") >= 50),
                         c("n_ended_lines") >= 0.5 * lines),
    }


def _posteriors(patterns: DataFrame, rules: list[str], iterations: int) -> DataFrame:
    """One row per vote pattern with p_good, after the iterations. The list of patterns (at most
    3^rules) is one array in one row; each iteration folds it once per rule and class."""
    m = len(rules)
    listed = patterns.agg(F.collect_list(F.struct("votes", "n")).alias("p"))

    # State: prior of good, and per rule the probabilities of vote -1, 0, 1 given bad and good.
    wrong = (1 - TRUST) / 2
    start = {"bad": [TRUST - wrong, 2 * wrong, wrong], "good": [wrong, 2 * wrong, TRUST - wrong]}
    flat = lambda v: "array(" + ", ".join(f"{x:.6f}D" for x in v) + ")"
    rows = lambda k: "array(" + ", ".join([flat(start[k])] * m) + ")"
    initial = f"named_struct('prior', {PRIOR_GOOD}D, 'bad', {rows('bad')}, 'good', {rows('good')})"

    def likelihood(side: str) -> str:
        """log of the probability of pattern x's votes under state s"""
        return (f"aggregate(sequence(0, {m - 1}), 0D, (a, j) -> "
                f"a + ln(s.{side}[j][x.votes[j] + 1]))")

    def p_good() -> str:
        return (f"1D / (1D + exp(least(700D, ln(1D - s.prior) + {likelihood('bad')} "
                f"- ln(s.prior) - {likelihood('good')})))")

    weighed = f"transform(p, x -> named_struct('votes', x.votes, 'n', x.n, 'g', {p_good()}))"
    total = lambda what: f"aggregate(w, 0D, (a, x) -> a + {what})"

    def shares(weight: str) -> str:
        mass = total(f"x.n * {weight}")
        return (f"transform(sequence(0, {m - 1}), j -> transform(sequence(-1, 1), v -> "
                f"({total(f'IF(x.votes[j] = v, x.n * {weight}, 0D)')} + {SMOOTHING}D) "
                f"/ ({mass} + {3 * SMOOTHING}D)))")

    step = (f"transform(array({weighed}), w -> named_struct("
            f"'prior', ({total('x.n * x.g')} + {SMOOTHING}D) "
            f"/ ({total('x.n')} + {2 * SMOOTHING}D), "
            f"'bad', {shares('(1D - x.g)')}, 'good', {shares('x.g')}))[0]")
    fitted = F.expr(f"aggregate(sequence(1, {iterations}), {initial}, (s, k) -> {step})")
    return (listed.withColumn("s", fitted)
            .select(F.explode(F.expr(weighed)).alias("w"), F.col("s").alias("model"))
            .select(F.col("w.votes").alias("votes"), F.col("w.g").alias("p_good"), "model"))


@shielded
def judge(docs: DataFrame, text: str = "text", rules: dict[str, Column] | None = None,
          iterations: int = ITERATIONS, with_text: bool = True) -> DataFrame:
    """Add the measures, votes, p_good, base_failed and kept.

    base_failed: fewer than 50 words, or more than half of the words in repeated windows. kept: not
    base_failed and p_good of at least ``KEEP_AT``. A NULL or empty text has no words and fails.
    Equal rows get equal results and stay repeated; ids are not read; an empty table stays empty;
    input columns with result names are replaced. Whole texts are measured: a row's arrays grow
    with its text. The measures are written once with the columns that the result returns, so
    texts are written only if they are wanted: ``with_text=False`` leaves them out of both.
    """
    rules = rules or default_rules()
    measured = measures(docs.select(*others(docs, RESULTS)), text).withColumn(
        "votes", F.array(*rules.values()))
    keep = others(docs, RESULTS if with_text else [*RESULTS, text])
    table = settle(measured.select(*keep, *MEASURES, "votes"), "quality-measures")
    patterns = table.groupBy("votes").agg(F.count("*").cast("double").alias("n"))
    posterior = (_posteriors(patterns, list(rules), iterations)
                 .select(F.concat_ws(",", "votes").alias("_pattern"), "p_good"))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (table.withColumn("_pattern", F.concat_ws(",", "votes"))
            .join(F.broadcast(posterior), "_pattern", "left")  # at most 3^rules rows
            .withColumn("base_failed", base)
            .withColumn("kept", ~base & (F.col("p_good") >= KEEP_AT))
            .select(*keep, *RESULTS))


def model(docs: DataFrame, text: str = "text", rules: dict[str, Column] | None = None,
          iterations: int = ITERATIONS) -> DataFrame:
    """The fitted model: rule, and the probability of each vote given a bad and a good document."""
    rules = rules or default_rules()
    patterns = (measures(docs, text).withColumn("votes", F.array(*rules.values()))
                .groupBy("votes").agg(F.count("*").cast("double").alias("n")))
    names = F.array(*map(F.lit, rules))
    return (_posteriors(patterns, list(rules), iterations).select("model").distinct()
            .select("model.prior", F.posexplode("model.bad").alias("j", "given_bad"), "model.good")
            .select(F.get(names, F.col("j")).alias("rule"), "prior", "given_bad",
                    F.get("good", F.col("j")).alias("given_good")))
