"""Document quality by weak supervision, in DataFrame functions alone.

Rules vote good or bad on a document or abstain. Expectation-maximisation estimates each rule's accuracy on good and on bad
documents, and how many are good, from how votes agree over all documents; a document's posterior probability of being good
then replaces the demand that it pass every rule. The votes' patterns are counted once (at most 3 to the number of rules, whatever
the corpus), and each step of the estimation is one aggregate over those counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import stored

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEW = 32
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_distinct_words", "n_symbol_words", "n_upper", "n_marks")


def _shifted(array: Column, by: int, size: Column) -> Column:
    return F.slice(array, F.lit(by + 1), F.greatest(size, F.lit(0)))


def _covered(starts: Column, width: int) -> Column:
    """How many places windows of width at ascending starts cover."""
    gaps = F.zip_with(starts, _shifted(starts, 1, F.size(starts)), lambda a, b: F.coalesce(F.least(b - a, F.lit(width)), F.lit(width)))
    return F.aggregate(gaps, F.lit(0), lambda s, g: s + g)


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without its text, with the counts of BASE and MORE as longs. Null text has no words.

    Windows of three words are compared by 64-bit hashes of their words' hashes, within one document only. A text's windows are sorted as
    plain integers; only where some repeat are their places looked up, among few values directly, else in sorted pairs.
    """
    taken = {x.lower() for x in (*BASE, *MORE, text_col)}
    keep = [c for c in docs.columns if c.lower() not in taken]
    text = F.coalesce(F.col(text_col), F.lit(""))
    a = docs.select(*keep, text.alias("__t"), F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "").alias("__w"), F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "").alias("__l"))
    n = F.size("__w")
    a = a.select(
        *keep,
        n.alias("__n"),
        F.length(F.translate("__t", WHITE, "")).cast("long").alias("word_chars"),
        (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.size("__l").cast("long").alias("n_lines"),
        F.size(F.array_distinct("__w")).cast("long").alias("n_distinct_words"),
        F.size(F.filter("__w", lambda w: F.translate(w, SYMBOLS, "") != w)).cast("long").alias("n_symbol_words"),
        (F.length("__t") - F.length(F.translate("__t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("__t") - F.length(F.translate("__t", "!?", ""))).cast("long").alias("n_marks"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    done = [*keep, "__n", *(c for c in (*BASE, *MORE) if c not in ("n_words", "n_repeat_words"))]
    two = F.zip_with("__h", _shifted(F.col("__h"), 1, F.size("__h")), lambda x, y: F.xxhash64(x, y))
    three = F.zip_with(two, _shifted(F.col("__h"), 2, F.size("__h")), lambda x, y: F.xxhash64(x, y))
    a = a.select(*done, F.slice(three, F.lit(1), F.greatest(F.col("__n") - 2, F.lit(0))).alias("__g"))
    a = a.select(*done, "__g", F.sort_array("__g").alias("__s"), F.size("__g").alias("__m"))
    again = F.zip_with("__s", _shifted(F.col("__s"), 1, F.col("__m")), lambda x, y: F.when(x == y, x))
    a = a.select(*done, "__g", F.array_distinct(F.filter(again, lambda x: x.isNotNull())).alias("__d"))
    few = F.filter(F.transform("__g", lambda x, i: F.when(F.array_contains("__d", x), i)), lambda i: i.isNotNull())
    pairs = F.sort_array(F.transform("__g", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    a = a.select(*done, "__d", F.when(F.size("__d") == 0, F.array().cast("array<int>")).when(F.size("__d") <= FEW, few).alias("__p"), F.when(F.size("__d") > FEW, pairs).alias("__q"))
    same = F.zip_with("__q", _shifted(F.col("__q"), 1, F.size("__q")), lambda x, y: F.when(x["x"] == y["x"], F.array(x["i"], y["i"])).otherwise(F.array().cast("array<int>")))
    a = a.select(*done, F.coalesce("__p", F.sort_array(F.array_distinct(F.flatten(same)))).alias("__p"))
    return a.select(*keep, F.col("__n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", _covered(F.col("__p"), 3).cast("long").alias("n_repeat_words"), *MORE)


@dataclass(frozen=True)
class Rule:
    """Votes good where good holds, bad where bad holds (and good doesn't), else abstains; both are SQL over the features."""

    name: str
    good: str
    bad: str

    def vote(self) -> Column:
        return F.when(F.expr(self.good), 1).when(F.expr(self.bad), 0).otherwise(-1)


RULES = (
    Rule("length", "n_words >= 100", "n_words < 60"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("symbol_share", "200 * n_symbols <= word_chars", "20 * n_symbols > word_chars"),
    Rule("symbol_words", "50 * n_symbol_words <= n_words", "5 * n_symbol_words > n_words"),
    Rule("lines", "n_lines >= 3 and 20 * n_dup_lines <= n_lines", "4 * n_dup_lines > n_lines"),
    Rule("repeats", "10 * n_repeat_words <= n_words", "3 * n_repeat_words > n_words"),
    Rule("variety", "10 * n_distinct_words >= 3 * n_words", "6 * n_distinct_words < n_words"),
    Rule("capitals", "20 * n_upper <= word_chars", "4 * n_upper > word_chars"),
    Rule("exclamations", "50 * n_marks <= n_words", "5 * n_marks > n_words"),
)


def _weight(rules: tuple[Rule, ...], right: dict) -> Column:
    """The logarithm of the votes' likelihood on good documents over that on bad ones."""
    total = F.lit(0.0)
    for r in rules:
        g, b = right[r.name]
        total = total + F.when(F.col(r.name) == 1, F.log(F.lit(g / (1 - b)))).when(F.col(r.name) == 0, F.log(F.lit((1 - g) / b))).otherwise(F.lit(0.0))
    return total


def _posterior(rules: tuple[Rule, ...], prior: float, right: dict) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.log(F.lit(prior / (1 - prior))) + _weight(rules, right))))


def accuracies(patterns: DataFrame, rules: tuple[Rule, ...] = RULES, steps: int = 15, prior: float = 0.7, right: tuple[float, float] = (0.95, 0.3)) -> tuple[float, dict]:
    """(share of good documents, {rule: (accuracy on good ones, on bad ones)}) from counts n of vote patterns.

    A rule is right on good documents at least half the time, so that good keeps its meaning, and no worse than a blind one on bad
    documents: most rules know one kind of badness and pass the others (the first guess, right, says so too). Without documents the first guesses stand.
    """
    known = {r.name: right for r in rules}
    for _ in range(steps):
        p = patterns.withColumn("p", _posterior(rules, prior, known))
        sums = [F.sum(F.col("n")).alias("n"), F.sum(F.col("n") * F.col("p")).alias("good")]
        for r in rules:
            v = F.col(r.name)
            sums += [F.sum(F.when(v == k, F.col("n") * w)).alias(f"{r.name}_{k}_{side}") for k in (0, 1) for side, w in (("g", F.col("p")), ("b", 1.0 - F.col("p")))]
        s = p.agg(*sums).first()
        if not s["n"]:
            return prior, known
        before, prior = prior, min(max(s["good"] / s["n"], 0.02), 0.98)

        def share(hit: float | None, miss: float | None, least: float) -> float:
            hit, miss = hit or 0.0, miss or 0.0
            return min(max((hit + 8.0) / (hit + miss + 10.0), least), 0.99)

        new = {}
        for r in rules:
            good = share(s[f"{r.name}_1_g"], s[f"{r.name}_0_g"], 0.5)
            new[r.name] = good, share(s[f"{r.name}_0_b"], s[f"{r.name}_1_b"], 1.005 - good)
        moved = max(abs(prior - before), *(abs(x - y) for r in rules for x, y in zip(new[r.name], known[r.name], strict=True)))
        known = new
        if moved < 1e-4:
            break
    return prior, known


def judged(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5, steps: int = 15) -> DataFrame:
    """docs without its text, with the features, each rule's vote (1, 0, -1 to abstain), quality (the posterior), base_failed and kept.

    base_failed: fewer than 50 words, or over half of them in repeated three-word windows. kept: base didn't fail and quality is
    least or more. Null and empty texts have no words and fail. Rows are judged each, repeated ones alike; an empty table gives an
    empty result. Input columns named like a new one give way.
    """
    names = {x.lower() for x in (*(r.name for r in rules), "quality", "base_failed", "kept")}
    docs = docs.select(*(c for c in docs.columns if c.lower() not in names))
    counted = features(docs, text_col)
    table = stored(counted.select(*counted.columns, *(r.vote().alias(r.name) for r in rules)), "quality-features")
    patterns = stored(table.groupBy(*(r.name for r in rules)).agg(F.count("*").alias("n")), "quality-patterns")
    prior, known = accuracies(patterns, rules, steps)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = table.withColumn("quality", _posterior(rules, prior, known)).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
