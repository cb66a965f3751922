"""Quality rules: an ordered list of threshold conjunctions, learned by sequential covering.

``text_statistics`` measures every text; ``fit_rules`` grows conjunctions of thresholds on labelled
statistics, prunes each on held-back rows and goes on with what is not covered yet; ``rule_number`` turns
the list into one Spark ``when`` chain. Labelled rows reach the driver only as a sample whose size is the
parameter ``max_rows``; every document is judged.

Edge cases: a null text counts as empty; an empty text has zero counts and fails the base rules; without
labels the list is empty, so the base rules alone decide; repeated rows are judged each on its own; other
columns stay untouched, and the names ``_statistics`` and ``_rule`` must be free.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scan import (
    LEAD, LINE, NONSPACE, byte_table, letter_values, per_text, run_hashes, runs, same_in_owner, slices, text_bytes,
    window_hashes,
)

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique_words",
    "n_upper", "n_digits", "n_stops", "n_bytes",
)
STATISTICS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])

#: What the rules may test: ratios of counts, so that they mean the same in short and long texts.
RATIOS = {
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "repeated_words": ("n_repeat_words", "n_words"),
    "repeated_lines": ("n_dup_lines", "n_lines"),
    "unique_words": ("n_unique_words", "n_words"),
    "upper_share": ("n_upper", "n_bytes"),
    "digit_share": ("n_digits", "n_bytes"),
    "stops_per_word": ("n_stops", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}
#: At most so many labelled rows are taken to the driver to learn from.
MAX_ROWS = 6000


def count_texts(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of ``COUNTS`` for every text of an Arrow array."""
    data, offsets = text_bytes(texts)
    out = {c: np.zeros(len(texts), np.int64) for c in COUNTS}
    symbols = byte_table(lambda b: chr(b) in "#*$%&|<>")
    upper, digit = byte_table(lambda b: 65 <= b <= 90), byte_table(lambda b: 48 <= b <= 57)
    stop = byte_table(lambda b: chr(b) in ".!?")
    values = letter_values(fold_case=False)
    for first, last in slices(offsets):
        at = offsets[first: last + 1] - offsets[first]
        part = data[offsets[first]: offsets[last]]
        n = last - first

        def put(name, numbers, first=first, last=last):
            out[name][first:last] = numbers

        word = NONSPACE[part]
        put("n_bytes", np.diff(at))
        put("word_chars", per_text(word & LEAD[part], at))
        for name, table in (("n_symbols", symbols), ("n_upper", upper), ("n_digits", digit), ("n_stops", stop)):
            put(name, per_text(table[part], at))

        starts, ends, text = runs(part, at, NONSPACE)
        hashes = run_hashes(part, starts, ends, values)
        put("n_words", np.bincount(text, minlength=n))
        put("n_unique_words", np.bincount(text[same_in_owner(hashes, text)[1]], minlength=n))
        windows, begin = window_hashes(hashes, text, 3)
        covered = np.zeros(len(starts) + 2, bool)
        twice = begin[same_in_owner(windows, text[begin])[0]]
        for k in range(3):
            covered[twice + k] = True
        put("n_repeat_words", np.bincount(text[covered[: len(text)]], minlength=n))

        starts, ends, text = runs(part, at, LINE)
        with_word = np.zeros(len(part) + 1, np.int64)
        np.cumsum(word, out=with_word[1:])
        full = with_word[ends] > with_word[starts]
        starts, ends, text = starts[full], ends[full], text[full]
        put("n_lines", np.bincount(text, minlength=n))
        later = ~same_in_owner(run_hashes(part, starts, ends, values), text)[1]
        put("n_dup_lines", np.bincount(text[later], minlength=n))
    return out


@F.arrow_udf(STATISTICS)
def text_statistics(texts: pa.Array) -> pa.Array:
    counts = count_texts(texts)
    return pa.StructArray.from_arrays([pa.array(counts[c]) for c in COUNTS], names=list(COUNTS))


@dataclass(frozen=True)
class Condition:
    ratio: str
    above: bool  # value >= threshold, else value <= threshold
    threshold: float

    def __str__(self) -> str:
        return f"{self.ratio} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def ratio_values(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {
        name: np.asarray(counts[a], float) / np.maximum(np.asarray(counts[b], float), 1.0)
        for name, (a, b) in RATIOS.items()
    }


def holds(condition: Condition, values: dict[str, np.ndarray]) -> np.ndarray:
    x = values[condition.ratio]
    return x >= condition.threshold if condition.above else x <= condition.threshold


def covers(rule: Rule, values: dict[str, np.ndarray]) -> np.ndarray:
    n = len(next(iter(values.values())))
    return reduce(np.logical_and, (holds(c, values) for c in rule), np.ones(n, bool))


def _grow(values, target, grid: int) -> Rule:
    """Add the condition of the highest information gain until no other class is covered."""
    rule: Rule = ()
    covered = np.ones(len(target), bool)
    while len(rule) < len(values):
        p, n = int(target[covered].sum()), int((~target[covered]).sum())
        if not p or not n:
            break
        base, best, gain = np.log2(p / (p + n)), None, 0.0
        for name in values:
            x, good = values[name][covered], target[covered]
            for cut in np.unique(np.quantile(x[good], np.linspace(0, 1, grid))):
                for above in (True, False):
                    hit = x >= cut if above else x <= cut
                    p1, n1 = int(good[hit].sum()), int((~good[hit]).sum())
                    if p1 and (g := p1 * (np.log2(p1 / (p1 + n1)) - base)) > gain + 1e-9:
                        best, gain = Condition(name, above, float(cut)), g
        if best is None:
            break
        rule += (best,)
        covered &= holds(best, values)
    return rule


def _worth(rule: Rule, values, target) -> float:
    hit = covers(rule, values)
    p, n = int(target[hit].sum()), int((~target[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0


def fit_rules(
    counts: dict[str, np.ndarray], rejected: np.ndarray, held_back: np.ndarray,
    min_precision: float = 0.95, max_rules: int = 32, grid: int = 24,
) -> list[Rule]:
    """Sequential covering. ``rejected``: the class the rules describe; ``held_back``: rows to prune on.

    A rule that is right on less than ``min_precision`` of the held-back rows it covers ends the list.
    """
    values, target = ratio_values(counts), np.asarray(rejected, bool)
    open_rows, rules = np.ones(len(target), bool), []
    take = lambda rows: {k: v[rows] for k, v in values.items()}
    while len(rules) < max_rules:
        grow, prune = open_rows & ~held_back, open_rows & held_back
        if not target[grow].any():
            break
        rule = _grow(take(grow), target[grow], grid)
        if not rule:
            break
        if prune.any():
            held, goal = take(prune), target[prune]
            shorter = [rule[:k] for k in range(1, len(rule) + 1)]
            rule = max(shorter, key=lambda r: (_worth(r, held, goal), -len(r)))
            if (_worth(rule, held, goal) + 1) / 2 < min_precision:
                break
        tightest = {(c.ratio, c.above): c for c in rule}  # a later condition on the same side is the tighter one
        rules.append(tuple(tightest.values()))
        open_rows &= ~covers(rule, values)
    return rules


def rule_number(rules: list[Rule], statistics: str = "_statistics") -> Column:
    """The number of the first rule that holds, 0 if none: one ordered conditional expression."""
    def ratio(name: str) -> Column:
        a, b = RATIOS[name]
        return F.col(f"{statistics}.{a}").cast("double") / F.greatest(F.col(f"{statistics}.{b}"), F.lit(1)).cast("double")

    def test(c: Condition) -> Column:
        return ratio(c.ratio) >= F.lit(c.threshold) if c.above else ratio(c.ratio) <= F.lit(c.threshold)

    chain = None
    for number, rule in enumerate(rules, 1):
        condition = reduce(lambda a, b: a & b, (test(c) for c in rule))
        chain = F.when(condition, number) if chain is None else chain.when(condition, number)
    return F.lit(0) if chain is None else chain.otherwise(0)


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    max_rows: int = MAX_ROWS,
) -> list[Rule]:
    """Learn the list from at most ``max_rows`` labelled documents, chosen by a hash of the id."""
    chosen = (
        labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
        .withColumn("_order", F.xxhash64("_id")).orderBy("_order", "_id").limit(max_rows)
    )
    # at most max_rows narrow rows: safe to broadcast, so that the texts are not shuffled
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
        .join(F.broadcast(chosen), "_id")
        .select("_order", "_id", "_label", text_statistics("_text").alias("_s"))
        .select("_order", "_id", "_label", *[F.col(f"_s.{c}").alias(c) for c in COUNTS])
        .orderBy("_order", "_id", *COUNTS).limit(max_rows).toPandas()
    )
    if rows.empty:
        return []
    counts = {c: rows[c].to_numpy() for c in COUNTS}
    return fit_rules(counts, rows["_label"].to_numpy() == 0, rows["_order"].to_numpy() % 3 == 0)


def judge(
    docs: DataFrame, rules: list[Rule], text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50,
) -> DataFrame:
    """All columns of ``docs`` plus ``_statistics``, ``base_failed``, ``rule`` (0: none) and ``kept``."""
    n, repeated = F.col("_statistics.n_words"), F.col("_statistics.n_repeat_words")
    failed = (n < min_words) | (repeated * 100 > n * max_repeat_percent)
    return (
        docs.withColumn("_statistics", text_statistics(F.col(text_col)))
        .withColumn("base_failed", failed).withColumn("rule", rule_number(rules).cast("int"))
        .withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    )


def filter_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that pass base rules and learned list, with their own columns only."""
    rules = learn(docs, labels, **options)
    plain = docs.select(F.struct(*docs.columns).alias("_row"), F.col(options.get("text_col", "text")).alias("_text"))
    return judge(plain, rules, "_text").filter("kept").select("_row.*")
