"""Toxicity: Levenshtein automata on a lexicon trie find terms and their misspellings; contexts weigh them.

The lexicon is learned: words, and beginnings of words, that toxic documents of
the training sample hold far more often than others. Its terms form a trie, and
the automaton of all strings within one edit of a term is that trie with a
count of edits: its states are sets of (node, edits). States are made when
some word first needs them, so the product of automaton and trie is never built
whole, and all distinct words of a batch step through it together. Terms under
FUZZY_FROM characters allow no edit, nor do beginnings by themselves; the whole
forms behind a beginning are terms beside it, so misspelt inflected forms are
found too. Forms within an edit that documents which aren't toxic use as well
count as words of their own.

Each hit is seen in its context, the WINDOW words before and behind it: quoted
or reported speech counts as quotation, an address to someone as abuse. A
logistic regression over the counted kinds of hits, fitted on the sample, gives
the score. Texts are whole; labels, language, source and id are no inputs.

The sample is at most SAMPLE labelled rows of the training folds, those with the
least hashes of their ids, so that what is broadcast to pick them has a bound. Of
copies and near copies in it one counts: else every word of a toxic text that
was copied often would pass for a toxic word.

Defined results: null and empty texts have no hits and get the score of such
documents; of several labels for an id the largest counts, null ones don't;
rows that share an id are scored one by one and the least of their texts trains, null ids are in the training folds
but have no label; without labels, or with labels of one kind only, the score
is 0 (nothing or no toxic document known) or that kind. An empty table gives an
empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, crc32_mod, hash_share, saved, slices, small_batches
from .simhash import fingerprint

SAMPLE, LIFT, FUZZY_FROM, WINDOW = 20_000, 25.0, 5, 6
#: Bits in which fingerprints of one family of copies may differ; unrelated texts differ in about 32.
FAMILY = 12
BEGINNINGS = (4, 5, 6)
EXACT, BEGINS, EDITED = 1, 2, 3

#: Fixed lists: marks trimmed from words; quotation marks; words of reported speech and of address in four languages.
MARKS = "\"'“”„«»‘’`´.,;:!?()[]{}<>|*#_~…-"
QUOTES = "\"“”„«»"
REPORTING = frozenset("said says say quoted quote quotes called calling wrote writes word term dit disait appelé mot dijo dice llamó palabra sagte sagt nannte wort zitat".split())
ADDRESS = frozenset("you your you're u ur tu te toi vous votre usted tú du dich dir euch ihr".split())


class FuzzyTrie:
    """The lexicon's trie and the lazily built states of its automaton; terms are (text, begins)."""

    DEAD = 0

    def __init__(self, terms: list[tuple[str, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[int, bool, bool]] = {}  # node: the term's length, whether a beginning is enough, and whether it is a whole form
        for text, begins in terms:
            node = 0
            for char in text:
                if char not in self.children[node]:
                    self.children[node][char] = len(self.children)
                    self.children.append({})
                node = self.children[node][char]
            _, before, whole = self.ends.get(node, (0, False, False))
            self.ends[node] = (len(text), begins or before, whole or not begins)
        self.alphabet = np.array(sorted({ord(c) for text, _ in terms for c in text}), np.uint32)
        self.states: list[frozenset[tuple[int, int]]] = [frozenset()]
        self.number: dict[frozenset[tuple[int, int]], int] = {frozenset(): 0}
        self.table = np.full((256, len(self.alphabet) + 1), -1, np.int32)
        self.table[0] = 0
        self.kind_at_end, self.kind_now = [0], [0]
        self.start = self._state({(0, 0)})

    def _state(self, members: set[tuple[int, int]]) -> int:
        members = members | {(child, 1) for node, edits in members if edits == 0 for child in self.children[node].values()}  # a character left out
        found = frozenset((n, e) for n, e in members if e == 0 or (n, 0) not in members)
        if found not in self.number:
            self.number[found] = len(self.states)
            self.states.append(found)
            ends = [(self.ends[n], e) for n, e in found if n in self.ends]
            self.kind_now.append(BEGINS if any(begins and e == 0 for (_, begins, _), e in ends) else 0)
            exact = any(e == 0 for _, e in ends)
            edited = any(e == 1 and length >= FUZZY_FROM and whole for (length, _, whole), e in ends)
            self.kind_at_end.append(EXACT if exact else EDITED if edited else 0)
            if len(self.states) > len(self.table):
                self.table = np.concatenate([self.table, np.full_like(self.table, -1)])
        return self.number[found]

    def _move(self, state: int, char: int) -> int:
        letter = chr(self.alphabet[char]) if char < len(self.alphabet) else None
        to: set[tuple[int, int]] = set()
        for node, edits in self.states[state]:
            if letter in self.children[node]:
                to.add((self.children[node][letter], edits))
            if edits == 0:
                to.add((node, 1))  # a character too many
                to |= {(child, 1) for child in self.children[node].values()}  # another character
        return self._state(to)

    def match(self, words: list[str]) -> np.ndarray:
        """The kind of hit that each word is, or 0."""
        kinds = np.zeros(len(words), np.int8)
        if not words or not len(self.alphabet):
            return kinds
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        place = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        chars = np.where(self.alphabet[place] == points, place, len(self.alphabet))
        starts = np.cumsum(sizes) - sizes
        live, state = np.arange(len(words)), np.full(len(words), self.start, np.int32)
        for at in range(int(sizes.max()) + 1):
            over = sizes[live] == at
            if over.any():
                kinds[live[over]] = np.array(self.kind_at_end, np.int8)[state[over]]
                live, state = live[~over], state[~over]
            if not len(live):
                break
            char = chars[starts[live] + at]
            to = self.table[state, char]
            for s, c in np.unique(np.stack([state[to < 0], char[to < 0]], 1), axis=0).tolist():
                moved = self._move(s, c)  # may replace the table by a larger one
                self.table[s, c] = moved
            state = self.table[state, char]
            begun = np.array(self.kind_now, np.int8)[state]
            kinds[live[begun > 0]] = begun[begun > 0]
            going = (state != self.DEAD) & (begun == 0)
            live, state = live[going], state[going]
        return kinds


FEATURES = ("exact", "begins", "edited", "quoted", "addressed", "density")


def trimmed(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(words, characters=MARKS)


class Lexicon:
    """What a document's hits are judged by: the automaton, and the edited forms that innocent documents use."""

    def __init__(self, terms: list[tuple[str, bool]], innocent: frozenset[str] = frozenset()):
        self.trie, self.innocent = FuzzyTrie(terms), innocent

    def hits(self, texts: pa.Array) -> tuple[Words, list[str], np.ndarray]:
        """The words of the texts, their trimmed distinct forms, and the kind of hit of each distinct word."""
        words = Words(texts, lower=True)
        forms = trimmed(words.distinct).to_pylist()
        kinds = self.trie.match(forms)
        for at in np.flatnonzero(kinds == EDITED):
            if forms[at] in self.innocent:
                kinds[at] = 0
        return words, forms, kinds

    def features(self, texts: pa.Array) -> np.ndarray:
        """float[texts, FEATURES]"""
        words, forms, kinds = self.hits(texts)
        out = np.zeros((len(words.counts), len(FEATURES)))
        if not len(words.codes):
            return out
        raw = words.distinct.to_pylist()
        of_word = kinds[words.codes]
        docs = words.doc_of_word()
        for at in np.flatnonzero(of_word):
            doc = docs[at]
            lo, hi = words.starts[doc], words.starts[doc + 1]
            before, behind = words.codes[max(lo, at - WINDOW) : at].tolist(), words.codes[at + 1 : min(hi, at + 1 + WINDOW)].tolist()
            near = {forms[c] for c in before + behind}
            here = raw[words.codes[at]]
            opened = here[:1] in QUOTES or any(raw[c][:1] in QUOTES and raw[c][-1:] not in QUOTES for c in before)
            closed = here.rstrip(".,;:!?")[-1:] in QUOTES or any(raw[c].rstrip(".,;:!?")[-1:] in QUOTES for c in behind)
            quotes = (opened and closed) or not near.isdisjoint(REPORTING)
            out[doc, FEATURES.index("quoted") if quotes else of_word[at] - 1] += 1
            out[doc, FEATURES.index("addressed")] += (not quotes) and not near.isdisjoint(ADDRESS)
        out[:, -1] = 100 * out[:, :4].sum(axis=1) / np.maximum(words.counts, 1)
        return np.log1p(out)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 40) -> np.ndarray:
    """Weights of the features and, last, of the constant, by Newton's method with a ridge."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


def choose_terms(seen: list[tuple[str, bool, int, int]], n_pos: int, n_neg: int, lift: float = LIFT) -> list[tuple[str, bool]]:
    """(text, begins) from counts of documents (text, is a beginning, toxic ones, other ones)."""
    words = {t: p for t, begins, p, _ in seen if not begins}
    fit = [(p, len(t), t, begins) for t, begins, p, n in seen if (p / n_pos) >= lift * (n + 0.5) / max(1, n_neg)]
    good = [(p, size, t) for p, size, t, begins in fit if begins or size < BEGINNINGS[0]]
    whole = [(p, size, t) for p, size, t, begins in fit if not begins and size >= BEGINNINGS[0]]
    beginnings = {t: p for p, _, t in good}
    chosen: dict[str, bool] = {}
    reach: dict[str, int] = {}  # of each beginning of a term chosen, the documents that such a term covers at the most

    def choose(text: str, begins: bool) -> None:
        chosen[text] = begins
        covers = (beginnings if begins else words).get(text, 0)
        for k in range(1, len(text) + 1):
            reach[text[:k]] = max(covers, reach.get(text[:k], 0))

    # whole words that beginnings of theirs hardly add to, then what covers most
    for p, _, t in sorted(whole, reverse=True):
        if p >= 0.9 * max((beginnings.get(t[:k], 0) for k in BEGINNINGS if k <= len(t)), default=0):
            choose(t, False)
    for p, _, t in sorted(good, reverse=True):
        covered = any(chosen.get(t[:k], False) for k in range(1, len(t) + 1)) or (t in reach and p <= 1.1 * reach[t])
        if not covered:
            choose(t, len(t) >= BEGINNINGS[0] and words.get(t, 0) < 0.9 * p)
    # the forms behind a beginning, and it as a form, for their misspellings
    forms = {(t, False) for _, size, t in whole if size >= FUZZY_FROM and any(chosen.get(t[:k], False) for k in BEGINNINGS)}
    return sorted({*chosen.items(), *forms})


def leaders(prints: np.ndarray, kinds: np.ndarray, near: int = FAMILY) -> np.ndarray:
    """Rows that aren't near an earlier leader of their kind: SimHash fingerprints that differ in at most near bits."""
    out = []
    for kind in np.unique(kinds):
        rows = np.flatnonzero(kinds == kind)
        known, n = np.empty(len(rows), np.uint64), 0
        for row in rows.tolist():
            if not n or np.bitwise_count(known[:n] ^ prints[row]).min() > near:
                known[n] = prints[row]
                n += 1
                out.append(row)
    return np.array(sorted(out), np.int64)


def _sample(documents: DataFrame, labels: DataFrame, folds: int, size: int, scope: str) -> DataFrame:
    """(text, toxic) of at most size labelled documents of the training folds, one of each family of near copies and label."""
    # an id without a remainder (null) has no label, so it can't be chosen
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = saved(known.filter(crc32_mod("doc_id", folds) != 0), scope)
    # a threshold lets little more than the sample through to the task that puts it in order
    share = min(1.0, (1.2 * size + 1000) / max(1, known.count()))
    chosen = known.filter(F.xxhash64("doc_id") <= F.lit(hash_share(share))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    rows = saved(chosen, scope)  # at most size rows
    # one text of each id: at most size rows, in as many tasks as the shuffle has
    found = documents.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    numbered = saved(found.select("text", "toxic", F.monotonically_increasing_id().alias("n")), scope)

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t) for t in batch.column(0).to_pylist()), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(2), batch.column(1), pa.array(fps.view(np.int64))], ["n", "toxic", "fp"])

    table = numbered.mapInArrow(prints, "n long, toxic int, fp long").toArrow().sort_by("n")  # as many rows as the sample
    n, toxic, fps = (table.column(c).to_numpy() for c in ("n", "toxic", "fp"))
    kept = n[leaders(fps.view(np.uint64), toxic > 0)]
    one = documents.sparkSession.createDataFrame(pa.table({"n": pa.array(kept, pa.int64())})) if len(kept) else documents.sparkSession.createDataFrame([], "n long")
    return saved(numbered.join(F.broadcast(one), "n").select("text", "toxic"), scope)


def _counts(sample: DataFrame) -> DataFrame:
    """(term, begins, toxic, other): in how many documents of the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                words = Words(part.column(0), lower=True)
                toxic = part.column(1).to_numpy() > 0
                docs = words.doc_of_word()
                forms = trimmed(words.distinct)
                for length in (0, *BEGINNINGS):
                    if length:
                        terms = pc.if_else(pc.greater_equal(pc.utf8_length(forms), length), pc.utf8_slice_codeunits(forms, 0, length), None)
                    else:
                        terms = pc.if_else(pc.and_(pc.greater_equal(pc.utf8_length(forms), 3), pc.less_equal(pc.utf8_length(forms), 24)), forms, None)
                    coded = terms.dictionary_encode()
                    code = np.asarray(pc.fill_null(coded.indices, -1)).astype(np.int64)[words.codes]
                    n = max(1, len(coded.dictionary))
                    pairs = np.unique(docs[code >= 0] * n + code[code >= 0])
                    if not len(pairs):
                        continue
                    hit = np.bincount(pairs % n, toxic[pairs // n], n).astype(np.int64)
                    every = np.bincount(pairs % n, minlength=n)
                    yield pa.record_batch([coded.dictionary.cast(pa.string()), pa.array(np.full(n, length > 0)), pa.array(hit), pa.array(every - hit)], ["term", "begins", "toxic", "other"])

    return sample.mapInArrow(run, "term string, begins boolean, toxic long, other long").groupBy("term", "begins").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def train(documents: DataFrame, labels: DataFrame, folds: int = 5, size: int = SAMPLE, scope: str = "session") -> tuple[Lexicon, np.ndarray]:
    """The lexicon, and the weights of FEATURES with a constant."""
    sample = _sample(documents, labels, folds, size, scope)
    n = {r["toxic"]: r["count"] for r in sample.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    constant = np.zeros(len(FEATURES) + 1)
    if not n_pos or not n_neg:
        constant[-1] = 30.0 if n_pos else -30.0
        return Lexicon([]), constant
    least = max(3, n_pos // 200)
    frequent = _counts(sample).filter((F.col("toxic") >= least) & (F.col("toxic") * n_neg >= LIFT * n_pos * (F.col("other") + 0.5)))
    # no more than the sample's toxic documents have words, by least
    seen = [tuple(r) for r in frequent.orderBy(F.col("toxic").desc(), "term", "begins").collect()]
    terms = choose_terms(seen, n_pos, n_neg)
    lexicon = Lexicon(terms)

    def edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                _, forms, kinds = lexicon.hits(part.column(0))
                yield pa.record_batch([pa.array(sorted({forms[i] for i in np.flatnonzero(kinds == EDITED)}), pa.string())], ["form"])

    found = sample.filter("toxic = 0").select("text").mapInArrow(edited, "form string").distinct().collect()  # strings within an edit of a term
    lexicon = Lexicon(terms, frozenset(r["form"] for r in found))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                x = lexicon.features(part.column(0))
                yield pa.record_batch([pa.array(x.tolist(), pa.list_(pa.float64())), part.column(1)], ["x", "toxic"])

    table = sample.mapInArrow(measured, "x array<double>, toxic int").toArrow()
    x = np.array(table.column("x").to_pylist()).reshape(-1, len(FEATURES))
    return lexicon, fit_logistic(x, (table.column("toxic").to_numpy() > 0).astype(float))


def score(documents: DataFrame, labels: DataFrame, folds: int = 5, size: int = SAMPLE, scope: str = "session") -> DataFrame:
    """One row per document: doc_id, held_out (fold 0), score and predicted. Texts are read twice and never shuffled."""
    small_batches(documents.sparkSession)
    lexicon, weights = train(documents, labels, folds, size, scope)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2):
                z = lexicon.features(part.column(2)) @ weights[:-1] + weights[-1]
                p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                p = np.where(z <= -30, 0.0, np.where(z >= 30, 1.0, p))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    held_out = F.coalesce(crc32_mod("doc_id", folds) == 0, F.lit(False))
    return documents.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), F.col("text").alias("whole_text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
