"""Quality rules as weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

Each labelling rule looks at a document's measures and votes good, bad or not
at all. Rules are taken to be independent given the true class. Expectation-
maximisation over the counts of vote patterns estimates, without labels, the
share of good documents and each rule's chance of every vote in either class;
the posterior probability that a document is good then replaces the test that
all rules pass. A rule that abstains says nothing about the class. Documents
that fail the base are out whatever the rules say, so EM doesn't learn from them. The patterns are few (3 to the number of rules at the most,
so with ten rules under 60,000), and only their counts reach the driver.

Two things keep EM from the mirror solution or a split along something other
than quality: it starts from rules that are right more often than wrong, and
the expected votes carry pseudo-counts of that prior.

Defined results: a null or empty text has no words, fails the base and is not
kept; repeated rows are judged alike; an empty table gives an empty table.
Other columns of the input are ignored by judge() and kept by keep_good().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, map_batches, mix, plain_names, rolling, saved, slices, small_batches, sums

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Posterior from which a document is kept.
THRESHOLD = 0.5
ROUNDS = 100
#: The prior, and its pseudo-counts as a share of the documents. A rule seldom objects to a good document;
#: to a bad one it objects now and then, as each kind of junk offends a few rules only.
PRIOR_SHARE = 0.05
PRIOR_GOOD, BAD_IF_GOOD, BAD_IF_BAD = 0.9, 0.02, 0.3

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_alpha_chars", "n_upper_chars", "n_digit_chars", "top_word")


def _per_text(values: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(values, 0)).astype(np.int64)


def _matches(texts: pa.Array, pattern: str) -> np.ndarray:
    return _per_text(pc.count_substring_regex(texts, pattern=pattern))


def _duplicate_lines(text: str) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    return len(lines), len(lines) - len(set(lines))


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Per text, the words that lie in a window of so many words found twice or more in that text."""
    n = len(words.codes)
    covered = np.zeros(n + 1, np.int64)
    docs = words.doc_of_word()
    if n >= window:
        inside = docs[: n - window + 1] == docs[window - 1 :]
        at = np.flatnonzero(inside)
        keys = rolling(mix(words.codes.astype(np.uint64) + np.uint64(1)), window)[at] + mix(docs[at].astype(np.uint64)) * np.uint64(3)
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + window, -1)
    return sums((np.cumsum(covered)[:n] > 0).astype(np.int64), words.starts)


def measure(batch: pa.RecordBatch, text_at: int) -> dict[str, np.ndarray]:
    texts = pc.fill_null(batch.column(text_at).cast(pa.large_string()), "")
    words = Words(texts)
    lines = np.array([_duplicate_lines(x) for x in texts.to_pylist()], np.int64).reshape(-1, 2)
    lengths = _per_text(pc.utf8_length(words.distinct))[words.codes] if len(words.codes) else np.empty(0, np.int64)
    kinds = [sums(_matches(words.distinct, p)[words.codes] if len(words.codes) else np.empty(0, np.int64), words.starts) for p in (SYMBOLS, r"\p{L}", r"\p{Lu}", r"[0-9]")]
    docs = words.doc_of_word()
    key, count = np.unique(docs * max(1, len(words.distinct)) + words.codes, return_counts=True)
    of = key // max(1, len(words.distinct))
    top = np.zeros(len(words.counts), np.int64)
    np.maximum.at(top, of, count)
    return dict(zip(MEASURES, (words.counts, sums(lengths, words.starts), kinds[0], lines[:, 1], repeated_words(words), lines[:, 0], np.bincount(of, minlength=len(words.counts)), kinds[1], kinds[2], kinds[3], top), strict=True))


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """int8[texts, rules]: 1 good, -1 bad, 0 no vote."""
    words = np.maximum(m["n_words"], 1)
    chars = np.maximum(m["word_chars"], 1)
    many = m["n_words"] >= 20

    def rule(value, good, bad, speaks=True):
        """good and bad: bounds; good < bad says that small values are good."""
        up = value <= good if good < bad else value >= good
        down = value >= bad if good < bad else value <= bad
        return np.where(speaks & down, -1, np.where(speaks & up, 1, 0))

    return np.stack(
        [
            rule(m["n_words"], 30, 10),
            rule(m["n_repeat_words"] / words, 0.05, 0.2),
            rule(m["n_symbols"] / words, 0.02, 0.1),
            rule(m["n_dup_lines"] / np.maximum(m["n_lines"], 1), 0.05, 0.3, m["n_lines"] >= 3),
            rule(m["n_alpha_chars"] / chars, 0.85, 0.7),
            rule(m["n_upper_chars"] / chars, 0.15, 0.4),
            rule(m["n_digit_chars"] / chars, 0.05, 0.2),
            rule(np.abs(m["word_chars"] / words - 6.5), 3.0, 5.0),
            rule(m["top_word"] / words, 0.15, 0.3, many),
            rule(m["n_distinct"] / words, 0.3, 0.1, many & (m["n_words"] <= 2000)),
        ],
        axis=1,
    ).astype(np.int8)


RULES = 10


def _pattern(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def _votes_of(patterns: np.ndarray, rules: int) -> np.ndarray:
    return (patterns[:, None] // 3 ** np.arange(rules)) % 3 - 1


def posteriors(patterns: np.ndarray, counts: np.ndarray, rules: int = RULES, rounds: int = ROUNDS) -> tuple[np.ndarray, dict]:
    """P(good) of each vote pattern by EM, and the model: good's prior, and bad[rule, class], the chance that a vote is "bad"."""
    v = _votes_of(patterns, rules)
    total = max(1.0, counts.sum())
    says = [(v == x).astype(float) for x in (-1, 1)]
    believed = np.tile(np.array([BAD_IF_GOOD, BAD_IF_BAD]), (rules, 1))
    bad, good = believed.copy(), PRIOR_GOOD
    for last in range(rounds + 1):
        each = says[0] @ np.log(bad) + says[1] @ np.log(1 - bad) + np.log([good, 1 - good])
        p = 1 / (1 + np.exp(np.clip(each[:, 1] - each[:, 0], -500, 500)))
        if last == rounds:
            break
        weight = np.stack([p, 1 - p], 1) * counts[:, None]
        held = PRIOR_SHARE * total * np.array([PRIOR_GOOD, 1 - PRIOR_GOOD])
        no, yes = says[0].T @ weight + held * believed, says[1].T @ weight + held * (1 - believed)
        bad = no / (no + yes)
        good = (weight[:, 0].sum() + held[0]) / (total + held.sum())
    return p, {"good": good, "bad": bad}


def _base_failed():
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _fit(patterned: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns in order and their posteriors, from the patterns of documents that pass the base (null: fails)."""
    seen = patterned.groupBy("pattern").count().toPandas().dropna()  # one row per vote pattern
    patterns, counts = seen["pattern"].to_numpy(np.int64), seen["count"].to_numpy(float)
    order = np.argsort(patterns)
    return patterns[order], posteriors(patterns[order], counts[order])[0] if len(seen) else np.empty(0)


def _verdicts(m: dict[str, np.ndarray], pattern: np.ndarray, model: tuple[np.ndarray, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, posterior (0 where the base failed and no other document has the pattern) and kept."""
    failed = (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])
    ranked, chances = model
    at = np.minimum(np.searchsorted(ranked, pattern), max(0, len(ranked) - 1))
    chance = np.where(ranked[at] == pattern, chances[at], 0.0) if len(ranked) else np.zeros(len(pattern))
    return failed, chance, ~failed & (chance >= threshold)


def _measured(documents: DataFrame) -> DataFrame:
    small_batches(documents.sparkSession)
    names = ["doc_id", *MEASURES[:5], "pattern"]
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                m = measure(part, 1)
                yield pa.record_batch([part.column(0), *(pa.array(m[n]) for n in MEASURES[:5]), pa.array(_pattern(votes(m)))], names)

    return documents.select("doc_id", F.col("text").alias("whole_text")).mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in names[1:]))


def judge(documents: DataFrame, threshold: float = THRESHOLD, scope: str = "session") -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, posterior and kept.

    The texts are read once; a few numbers for each document are written before the votes are weighed.
    """
    measured = saved(_measured(documents), scope)
    model = _fit(measured.select(F.when(~_base_failed(), F.col("pattern")).alias("pattern")))
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def decide(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = {n: batch.column(i + 1).to_numpy() for i, n in enumerate(MEASURES[:5])}
        columns = [pa.array(x) for x in _verdicts(m, batch.column(6).to_numpy(), model, threshold)]
        return pa.record_batch([*batch.columns[:6], *columns], ["doc_id", *MEASURES[:5], "base_failed", "posterior", "kept"])

    return map_batches(measured, decide, f"doc_id {id_type}, " + ", ".join(f"{n} long" for n in MEASURES[:5]) + ", base_failed boolean, posterior double, kept boolean")


def keep_good(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents that judge() keeps, all columns. The texts are read twice and never shuffled or written."""
    model = _fit(_measured(documents).select(F.when(~_base_failed(), F.col("pattern")).alias("pattern")))
    slot = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, slot):
                m = measure(part, slot)
                yield part.filter(pa.array(_verdicts(m, _pattern(votes(m)), model, threshold)[2]))

    plain = plain_names(documents)
    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)
