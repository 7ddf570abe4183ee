"""Quality rules with risk-controlled thresholds.

Rules compare a document's ratio (symbols, repeated lines, repeated words, word length) with a cutoff. The cutoffs are
not guessed: for each stratum a labelled holdout says how many good documents a set of cutoffs would reject together,
and a set is allowed only if the exact (Clopper-Pearson) upper bound of that rate is at most `alpha`. Sets are nested and
tested in an order that is fixed before any label is seen, the first refusal ends it (fixed-sequence testing), so the sets of
a stratum need no share of `delta` each; strata share it (Bonferroni). With probability 1 - delta the chosen sets keep their
promise in every stratum.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .shared import drop_written, freed, written

STAT_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True

#: name -> (numerator, denominator, grid of cutoffs in thousandths); a document fails if 1000 * numerator > cutoff * denominator.
RULES = {
    "symbols": ("n_symbols", "word_chars", (10, 20, 50, 100, 150, 200, 300, 500)),
    "dup_lines": ("n_dup_lines", "n_lines", (50, 100, 200, 300, 500, 700)),
    "repeat_words": ("n_repeat_words", "n_words", (20, 50, 100, 150, 200)),
    "word_length": ("word_chars", "n_words", (9000, 10000, 12000, 15000, 20000)),
}


def measure(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The STAT_COLUMNS of every document of a block."""
    words = scan.Words(raw, offsets)
    n_words = np.diff(words.first)
    lead = (raw & 0xC0) != 0x80
    chars = scan.per_document(lead & words.inside, offsets)
    symbols = scan.per_document(SYMBOL[raw], offsets)
    cut = np.union1d(np.flatnonzero(raw == 10) + 1, offsets)  # starts of lines, and the end
    start, end = cut[:-1], cut[1:].copy()
    end[raw[end - 1] == 10] -= 1
    with_word = np.searchsorted(words.start, start) < np.searchsorted(words.start, end)
    start, end = start[with_word], end[with_word]
    line_doc = np.searchsorted(offsets, start, "right") - 1
    n_lines = np.bincount(line_doc, minlength=len(n_words))
    key = scan.salted(scan.span_hash(raw, start, end), line_doc)
    _, at = np.unique(key, return_index=True)
    later = np.ones(len(key), bool)
    later[at] = False
    dup = np.bincount(line_doc[later], minlength=len(n_words))
    at = scan.window_starts(words.first, 5)
    again = np.zeros(0, np.int64)
    if len(at):
        h = scan.window_hash(scan.span_hash(raw, words.start, words.end), 5)[at]
        again = at[scan.repeated(scan.salted(h, words.doc[at]))]
    rep = scan.per_document(scan.covered(again, 5, len(words)), words.first)
    return [n_words, chars, symbols, dup, rep, n_lines]


def document_stats(docs: DataFrame, *carry: str) -> DataFrame:
    """One row per document: the columns to carry and STAT_COLUMNS over the whole text (null: no words).

    Empty and blank texts give zeros, a text of any length is one row, and no row meets another.
    """
    text = "text" if "text" in carry else "stat_text"  # a text that is carried crosses once
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*carry).schema) + "".join(f", {c} long" for c in STAT_COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, offsets in scan.blocks(batch, text):
                columns = [rows.column(i) for i in range(len(carry))] + [pa.array(v.astype(np.int64)) for v in measure(raw, offsets)]
                yield pa.RecordBatch.from_arrays(columns, [*carry, *STAT_COLUMNS])

    return docs.select(*carry, *([F.col("text").alias(text)] if text not in carry else [])).mapInArrow(freed(run), schema)


def base_failed(n_words: str = "n_words", n_repeat: str = "n_repeat_words"):
    return (F.col(n_words) < 10) | (100 * F.col(n_repeat) > 20 * F.col(n_words))


def upper_bound(bad: int, n: int, delta: float) -> float:
    """The exact binomial upper confidence bound: the rate p at which seeing <= bad of n has probability delta."""
    if bad >= n:
        return 1.0
    log_choose = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(bad + 1)]
    lo, hi = bad / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        terms = [c + i * math.log(p) + (n - i) * math.log1p(-p) for i, c in enumerate(log_choose)] if 0 < p < 1 else [-math.inf]
        top = max(terms)
        tail = math.exp(top) * sum(math.exp(t - top) for t in terms) if top > -700 else 0.0
        lo, hi = (p, hi) if tail > delta else (lo, p)
    return hi


def most_allowed(n: int, alpha: float, delta: float) -> int:
    """The largest count of failures among n whose upper bound is at most alpha, -1 if there is none."""
    lo, hi = -1, int(alpha * n) + 1
    while hi - lo > 1:
        bad = (lo + hi) // 2
        lo, hi = (bad, hi) if upper_bound(bad, n, delta) <= alpha else (lo, bad)
    return lo


def sequence() -> list[tuple[int, ...]]:
    """The sets of cutoffs in the order of their tests: how many of the loosest cutoffs of each rule are passed over to reach the one in force.

    Rules take turns, from no rule at all, at their next smaller cutoff; a rule at its smallest is left out. Each set rejects
    all that the one before rejects.
    """
    left = [len(grid) for _, _, grid in RULES.values()]
    out = []
    while any(left):
        for i in range(len(left)):
            if left[i]:
                left[i] -= 1
                out.append(tuple(left))
    return out


def calibrate(stats: DataFrame, good: str, stratum: str, alpha: float = 0.01, delta: float = 0.05) -> dict[str, dict[str, int]]:
    """stratum -> rule -> cutoff, from labelled rows: all rules of a stratum together reject at most alpha of good documents.

    The last set of sequence() before the first one that is not allowed. Only counts come to the driver: per stratum, one row
    for each way to fail. A stratum without enough labels for any cutoff gets none, so nothing of it is rejected; a null
    stratum is one of its own.
    """
    levels = [sum((1000 * F.col(top) > cut * F.col(bottom)).cast("int") for cut in grid).alias(f"level_{rule}") for rule, (top, bottom, grid) in RULES.items()]
    rows = stats.where(F.col(good).isNotNull()).groupBy(stratum, *levels).agg(F.count_if(F.col(good) == 1).alias("n")).collect()
    strata: dict[str, list] = {}
    for row in rows:
        strata.setdefault(row[0], []).append(row)
    chosen: dict[str, dict[str, int]] = {}
    for value, ways in strata.items():
        n = np.array([row["n"] for row in ways])
        level = np.array([[row[f"level_{rule}"] for rule in RULES] for row in ways])  # fails the so many smallest cutoffs
        most = most_allowed(int(n.sum()), alpha, delta / len(strata))
        at = tuple(len(grid) for _, _, grid in RULES.values())  # its place in the grid; behind the end: no cutoff
        for tighter in sequence():
            if n[(level > np.array(tighter)).any(1)].sum() > most:
                break
            at = tighter
        chosen[value] = {rule: grid[k] for (rule, (_, _, grid)), k in zip(RULES.items(), at, strict=True) if k < len(grid)}
    return chosen


def verdict(chosen: dict[str, dict[str, int]], stratum: str):
    """True where no allowed cutoff rejects the document."""
    reject = F.lit(False)
    for value, cuts in chosen.items():
        broken = F.lit(False)
        for rule, cut in cuts.items():
            top, bottom, _ = RULES[rule]
            broken |= 1000 * F.col(top) > cut * F.col(bottom)
        reject |= F.col(stratum).eqNullSafe(F.lit(value)) & broken
    return ~reject


def learn_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """The statistics of every document (written), with rule_stratum and base_failed, and the allowed cutoffs.

    `labels` has doc_id and quality; repeated labels of a document count once (the smallest), null ones not at all.
    Labels join documents on doc_id; the bounds take a row as one draw, so copies of one document weigh as rows do.
    """
    stats = written(document_stats(docs.withColumn("rule_stratum", F.col(stratum).cast("string")), "doc_id", "rule_stratum").withColumn("base_failed", base_failed()), "stats")
    good = labels.select("doc_id", F.col("quality").alias("rule_good")).where("doc_id is not null and rule_good is not null").groupBy("doc_id").agg(F.min("rule_good").alias("rule_good"))
    return stats, calibrate(stats.where(~F.col("base_failed")).join(good, "doc_id"), "rule_good", "rule_stratum", alpha, delta)


def apply_rules(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """doc_id, STAT_COLUMNS, base_failed and kept per row of `docs`: the base rule and the calibrated rules both pass."""
    stats, chosen = learn_rules(docs, labels, stratum, alpha, delta)
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(chosen, "rule_stratum")).drop("rule_stratum")


def kept_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.01, delta: float = 0.05) -> DataFrame:
    """The rows of `docs` that apply_rules() keeps, with all their columns."""
    stats, chosen = learn_rules(docs, labels, stratum, alpha, delta)
    drop_written(stats)
    names = docs.columns
    plain = ["text" if c == "text" else f"doc_{i}" for i, c in enumerate(names)]
    rows = docs.select(*(F.col(c).alias(p) for c, p in zip(names, plain, strict=True)), F.col(stratum).cast("string").alias("rule_stratum"))
    rows = document_stats(rows, *plain, "rule_stratum").where(~base_failed() & verdict(chosen, "rule_stratum"))
    return rows.select(*(F.col(p).alias(c) for c, p in zip(names, plain, strict=True)))
