"""Quality rules: base measures of a text, and a decision list learned from labelled documents.

Sequential covering: a rule grows by the threshold condition with the most FOIL gain, is pruned
on rows that it didn't see, and is kept if it is precise there; then the rows it covers go and
the next rule is grown. The list is emitted as one Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import let

#: Labelled rows that the list is learned from at most, by the order of a hash of their id.
FIT_ROWS = 4_000
#: A rule must be so precise on the rows kept for pruning, cover so many there, and have at most so many conditions.
PRECISION, COVER, CONDITIONS, RULES = 0.95, 3, 4, 12
SPACE = r"\x20\x09-\x0D"


def _repeated(words: Column) -> Column:
    """Words in 3-word windows that are found twice or more: windows sorted by hash, equal neighbours taken."""

    def covered(at: Column) -> Column:
        step = lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1), p + 3) - p)
        return F.aggregate(F.transform(at, step), F.lit(0).cast("long"), lambda a, x: a + x)

    def twice(s: Column) -> Column:
        like = lambda x, i: F.coalesce(F.get(s, i)["h"] == x["h"], F.lit(False))
        again = F.filter(s, lambda x, i: like(x, i - 1) | like(x, i + 1))
        return let(F.sort_array(F.transform(again, lambda x: x["at"])), covered)

    def placed(hs: Column) -> Column:
        alone = F.size(F.array_distinct(hs)) == F.size(hs)  # most texts: nothing to sort
        with_place = F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("at")))
        return F.when(alone, F.lit(0).cast("long")).otherwise(let(F.sort_array(with_place), twice))

    def windows(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return let(hashed, placed)

    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(let(words, windows))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, base measures, further measures) for each row; null text has no words."""
    t = F.col("t")
    only = lambda inverse: F.length(F.regexp_replace(t, inverse, "")).cast("long")
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.struct(F.lit(0).alias("_"), *keep).alias("kept_columns"))
    split = texts.select(
        "id",
        "kept_columns",
        let(
            F.regexp_extract_all(t, F.lit(f"[^{SPACE}]++"), F.lit(0)),
            lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")),
        ).alias("w"),
        only(f"[{SPACE}]++").alias("word_chars"),
        only(r"[^#*$%&|<>]++").alias("n_symbols"),
        only(r"[^A-Z]++").alias("n_upper"),
        let(
            F.filter(F.split(t, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]")),
            lambda ls: F.struct(F.size(ls).cast("long").alias("n_lines"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines")),
        ).alias("l"),
    )
    return split.select(
        "id", "kept_columns", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper"
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def _share(a: str, b: str) -> Column:
    return F.col(a).cast("double") / F.greatest(F.col(b), F.lit(1)).cast("double")


#: What the list's conditions look at.
FEATURES = ("n_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "line_words")


def features() -> dict[str, Column]:
    return {
        "n_words": F.col("n_words").cast("double"),
        "word_length": _share("word_chars", "n_words"),
        "symbol_share": _share("n_symbols", "n_words"),
        "dup_line_share": _share("n_dup_lines", "n_lines"),
        "repeat_share": _share("n_repeat_words", "n_words"),
        "upper_share": _share("n_upper", "word_chars"),
        "line_words": _share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value > threshold, else value <= threshold
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        v = x[:, FEATURES.index(self.feature)]
        return v > self.threshold if self.above else v <= self.threshold

    def expression(self) -> Column:
        c = features()[self.feature]
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def _hold(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray) -> Rule:
    rule: tuple[Condition, ...] = ()
    inside = np.ones(len(x), bool)
    while len(rule) < CONDITIONS and bad[inside].any() and not bad[inside].all():
        p, n = bad[inside].sum(), (~bad[inside]).sum()
        before, best = math.log2(p / (p + n)), (1e-9, None)
        for k, name in enumerate(FEATURES):
            values = x[inside, k]
            order = np.argsort(values, kind="stable")
            v, b = values[order], bad[inside][order]
            ends = np.flatnonzero(v[1:] > v[:-1])  # a threshold lies between different values
            if not len(ends):
                continue
            cum_p, cum_n = np.cumsum(b)[ends], np.cumsum(~b)[ends]
            for above, pp, nn in ((False, cum_p, cum_n), (True, p - cum_p, n - cum_n)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(pp > 0, pp * (np.log2(pp / (pp + nn)) - before), -1.0)
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), Condition(name, above, float((v[ends[i]] + v[ends[i] + 1]) / 2)))
        if best[1] is None:
            break
        rule += (best[1],)
        inside &= best[1].holds(x)
    return rule


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray) -> Rule:
    """The shortest beginning of the rule that does best on rows it didn't see."""

    def worth(r: Rule) -> float:
        got = _hold(r, x)
        p, n = (got & bad).sum(), (got & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth)


def learn(x: np.ndarray, bad: np.ndarray) -> list[Rule]:
    """An ordered list of conjunctions that reject; what none covers is kept. Few or one-sided labels give an empty list."""
    rules: list[Rule] = []
    fold = np.arange(len(x)) % 3 == 2
    while len(rules) < RULES and bad[~fold].any():
        rule = _grow(x[~fold], bad[~fold])
        if not rule:
            break
        rule = _prune(rule, x[fold], bad[fold])
        got = _hold(rule, x[fold])
        if got.sum() < COVER or (got & bad[fold]).sum() < PRECISION * got.sum():
            break
        rules.append(rule)
        left = ~_hold(rule, x)
        x, bad, fold = x[left], bad[left], fold[left]
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> list[Rule]:
    """Learn from at most fit_rows labelled documents (quality 1 keep, 0 reject; null labels are left out).

    Those that the base rules reject are no examples: the list never judges such texts. Of rows that share
    an id, the least text is the example.
    """
    some = (
        labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull())
        .groupBy(id_col)
        .agg(F.min("quality").alias("_quality"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(fit_rows)
    )
    texts = docs.select(id_col, F.col(text_col)).join(F.broadcast(some), id_col)
    one = texts.groupBy(id_col).agg(F.min(text_col).alias(text_col), F.first("_quality").alias("_quality"))
    rows = measure(one, id_col, text_col, keep=("_quality",))
    # No filter here: it would be moved below the join and measure every document.
    seen = rows.select("id", "base_failed", F.col("kept_columns._quality").alias("q"), *[c.alias(f"_{n}") for n, c in features().items()]).collect()
    got = sorted(tuple(r) for r in seen if not r["base_failed"])
    order = np.random.default_rng(0).permutation(len(got))
    x = np.array([r[3:] for r in got], float).reshape(len(got), len(FEATURES))[order]
    return learn(x, np.array([r[2] == 0 for r in got], bool)[order])


def verdict(rules: list[Rule]) -> Column:
    """True: keep. The ordered list as one conditional expression."""
    out = None
    for rule in rules:
        test = rule[0].expression()
        for c in rule[1:]:
            test = test & c.expression()
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, measures, base_failed, kept) for each input row.

    Null text has no words and fails; repeated rows get equal results; null ids are judged, too;
    an empty table gives an empty result; columns other than ``keep`` are ignored. Without labels
    the base rules alone decide.
    """
    rules = fit(docs, labels, id_col, text_col)
    measured = measure(docs, id_col, text_col, keep)
    return measured.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules))).withColumnRenamed("id", id_col)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's columns for each row of documents."""
    return judge(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
