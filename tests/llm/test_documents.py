"""The operators on documents, against brute force on the smallest tables and on a table of odd rows."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from quarrywork.llm import common, debruijn, jaccard, mixing, packing, ppm, queries, simhash, toxicity, weak

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"p{i}" for i in range(70))
ODD = [
    (1, "The quick brown fox jumps over the lazy dog again and again today.", "en", "a", 1),
    (1, "The quick brown fox jumps over the lazy dog again and again today.", "en", "a", 1),
    (1, "same id, another text " * 8, "en", None, 2),
    (2, "the QUICK brown fox jumps over the lazy dog again and again today.", "en", "a", 3),
    (3, None, None, None, None),
    (4, "", "", "", 0),
    (5, " \n\t ", "de", "b", 3),
    (None, "no id here, but some words to read", "en", "b", 4),
    (6, LONG, "en", "b", 5),
    (7, "ÀÉ ünï\u00a0code ſtrange \u2003 İstanbul 日本語 <|endoftext|> don't I'm\x0bvt", "fr", "c", 6),
    (8, f"start one {PASSAGE} end one", "en", "c", 7),
    (9, f"other {PASSAGE} {PASSAGE} tail " + "x " * 60, "en", "c", 8),
    (10, "y " * 60 + PASSAGE, "en", "z", 9),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHES = "fp row owner body place spans pattern kept size origin target taken part length piece start score held_out base word whole_text component_id".split()


@pytest.fixture(scope="module")
def odd(spark):
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def tables(docs, odd):
    return {"real": docs, "odd": odd, "empty": docs.limit(0)}


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


TABLES = pytest.mark.parametrize("name", ["real", "odd", "empty"])


# ---- words


def test_words_of_slices():
    texts = pa.array(["Éa  b\x0b", None, "", " C\u00a0d ", "e" * 50] * 40)
    batch = pa.record_batch([texts], ["t"])
    for piece in common.slices(batch, 0, 120):
        w = common.Words(piece.column(0), lower=True)
        got = w.distinct.take(pa.array(w.codes)).to_pylist()
        assert got == [x for t in piece.column(0).to_pylist() for x in words(ascii_lower(t))]


def test_prefix_hashes_are_of_content():
    values = common.mix(np.array([1, 2, 3, 1, 2, 3, 9], np.uint64))
    p = common.PrefixHash(values)
    a = p.of(np.array([0, 3, 4]), np.array([3, 6, 7]))
    assert a[0] == a[1] != a[2]


# ---- 2: SimHash


def fingerprint(text):
    w = words(ascii_lower(text))
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < 4 else [" ".join(w[i : i + 4]) for i in range(len(w) - 3)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(prints, radius=4):
    """Least root of each print by comparing all pairs."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


@TABLES
def test_simhash(tables, name):
    got = simhash.near_duplicates(tables[name]).collect()
    source = rows(tables[name])
    prints = {t: fingerprint(t) for _, t in set(source)}
    roots = grouped(set(prints.values()))
    least = {}
    for i, t in source:
        r = roots[prints[t]]
        if i is not None:
            least[r] = min(i, least.get(r, i))
    expected = collections.Counter((i, f"{prints[t]:016x}", least.get(roots[prints[t]])) for i, t in source)
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == expected


def test_links_within_the_radius_lose_no_component():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)
    near = np.array([b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, int(rng.integers(0, 5)), replace=False))) for b in np.repeat(base, 12)], np.uint64)
    values = np.unique(np.concatenate([base, near]))
    for size in (len(values), 9):
        part = values[:size]
        a, b = simhash.bucket_links(part, np.array([0, len(part)]))
        assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b))
        want = grouped(set(part.tolist()))
        joined = {p: p for p in part.tolist()}

        def find(x):
            while joined[x] != x:
                x = joined[x]
            return x

        for x, y in zip(a.tolist(), b.tolist()):
            joined[find(x)] = find(y)
        assert len({find(p) for p in joined}) == len(set(want.values()))


def test_split_buckets_join_again(spark):
    rng = np.random.default_rng(2)
    centre = int(rng.integers(0, 2**62))
    prints = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))})
    df = spark.createDataFrame([(p - (1 << 64) if p >= 1 << 63 else p,) for p in prints], "fp long")
    from quarrywork.llm.components import components

    for mask in simhash.tables():
        assert sum(simhash.further(mask)) == (1 << 64) - 1 - mask and len(simhash.further(mask)) == 5
    roots = components(simhash.links(df, chunk=3))
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(prints)
    roots = components(simhash.links(df, chunk=7))
    assert roots.select("root").distinct().count() == 1 and roots.count() == len(prints)


def test_one_of_each_group_stays(odd, docs):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 1, 3, 6, 7, 8, 9, 10] and ids.count(None) == 1
    labelled = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in simhash.keep_first(docs).select("doc_id").collect()) == sorted(set(labelled.values()))


def test_planes_round_trip():
    values = np.random.default_rng(3).integers(0, 2**63, 130).astype(np.uint64)
    bits = np.stack([simhash.lanes(p, 130) for p in simhash.planes(values)])
    assert [sum(1 << (63 - j) for j in range(64) if bits[j, i]) for i in range(130)] == values.tolist()


# ---- 3: PPM


@TABLES
def test_unigram_base(tables, name):
    got = ppm.score(tables[name], head_words=50, head_runs=500).collect()
    source = rows(tables[name])
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = collections.Counter(w for i, t in source if not held(i) for w in [*words(ascii_lower(t)), None])
    n, v = sum(count.values()), len(count)
    expected = []
    for i, t in source:
        own = [*words(ascii_lower(t)), None]
        base = sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        expected.append((str(i), held(i), len(own), sum(count[w] > 0 for w in own), n, round(base, 4)))
    assert sorted(expected) == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    assert all(r.score < 0 for r in got)


def stream(text):
    """The symbols of a text, behind as many ends as a context has bytes."""
    own = b"".join(w.encode() + b" " for w in words(ascii_lower(text)))
    return b"\xff" * ppm.ORDER + own + b"\xff"


def brute_ppm(training, symbols):
    """log10 of the probability of the last of these symbols after the others, by PPM with method D and symbol exclusion over dictionaries."""
    follows = collections.defaultdict(collections.Counter)
    for s in training:
        for i in range(ppm.ORDER, len(s)):
            for order in range(ppm.ORDER + 1):
                follows[s[i - order : i]][s[i]] += 1

    def one(before, symbol):
        value, excluded = 0.0, set()
        for order in range(ppm.ORDER, -1, -1):
            seen = follows.get(before[len(before) - order :])
            if seen is None:
                continue
            left = {x: n for x, n in seen.items() if x not in excluded}
            total = sum(left.values())
            if symbol in left:
                return value + math.log10((left[symbol] - 0.5) / total)
            if left:
                value += math.log10(0.5 * len(left) / total)
            excluded |= set(seen)
        return value - math.log10(ppm.ALPHABET - len(excluded))

    return [one(before, symbol) for before, symbol in symbols]


@pytest.mark.parametrize("head", [0, 40, 1 << 20])
def test_ppm_is_brute_force(spark, docs, odd, head):
    short = docs.filter("length(text) < 900").orderBy("doc_id").limit(25).select("doc_id", "text")
    texts = [(r.doc_id, r.text) for r in short.collect()] + [(i, t) for i, t, *_ in ODD if t != LONG]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    training = [stream(t) for i, t in texts if not held(i)]
    expected = []
    for i, t in texts:
        s = stream(t)
        expected.append((str(i), round(sum(brute_ppm(training, [(s[:at], s[at]) for at in range(ppm.ORDER, len(s))])), 6)))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = ppm.score(frame, head_words=head, head_runs=head, group=50).collect()
    assert sorted((str(r.doc_id), round(r.score, 6)) for r in got) == sorted(expected)


def test_probabilities_sum_to_one():
    text, starts = ppm.symbols(pa.array(["the other thing then", "\u00e9t\u00e9 the", None]))
    model = ppm.levels(*ppm.tally(ppm.runs(text, starts, 0, len(text))), ppm.ORDER)
    alphabet = np.array([b for b in range(256) if not 0x41 <= b <= 0x5A and b not in (9, 10, 11, 12, 13)], np.uint64)
    assert len(alphabet) == ppm.ALPHABET
    for before in (b" the ", b"other", b"xx th", b"zzzzz", b"\xff" * 5):
        context = np.uint64(sum(c << 8 * (i + 1) for i, c in enumerate(reversed(before))))
        assert (10 ** ppm.code(alphabet | context, model)).sum() == pytest.approx(1)


def test_order_of_words_counts_and_pieces_join(docs, spark, monkeypatch):
    texts = [r.text for r in docs.filter("length(text) > 1000").orderBy("doc_id").limit(20).collect()]
    frame = spark.createDataFrame(list(enumerate(texts + [" ".join(sorted(t.split())) for t in texts])), "doc_id long, text string")
    score = {r.doc_id: r.score for r in ppm.score(frame).collect()}
    held = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5 == 1]
    assert held and all(abs(score[i] - score[i + 20]) > 1 for i in held)
    text, starts = ppm.symbols(pa.array(texts))
    whole = ppm.runs(text, starts, 0, len(text))
    assert np.concatenate([ppm.runs(text, starts, lo, min(len(text), lo + 97)) for lo in range(0, len(text), 97)]).tolist() == whole.tolist()
    tallies = [ppm.tally(np.repeat(whole[:50], 70_000)), ppm.tally(whole), ppm.tally(whole[::2])]
    keys, counts = np.unique(np.concatenate([np.repeat(whole[:50], 70_000), whole, whole[::2]]), return_counts=True)
    assert [x.tolist() for x in ppm.merged(tallies)] == [keys.tolist(), counts.tolist()]


def test_without_training_texts_all_symbols_are_alike(spark):
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    assert ppm.score(spark.createDataFrame([(held, "ab")], "doc_id long, text string")).head().score == pytest.approx(-4 * math.log10(ppm.ALPHABET))


def test_held_out_score_is_above_the_base(spark):
    d = "/root/testdata/sf0.1"
    if not os.path.exists(d):
        pytest.skip("no larger tables")
    r = queries.QUERIES["op3_ppm_scores"](spark, d).filter("held_out").agg(F.sum("score"), F.sum("base_score")).head()
    assert r[0] > r[1]


# ---- 5: toxicity


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_is_edit_distance():
    terms = ["idiot", "moron", "scum", "café"]
    trie = toxicity.FuzzyTrie([(t, False) for t in terms] + [("lowei", True)])
    rng = np.random.default_rng(4)
    forms = ["", "lowei", "loweischaft", "lowe", *terms]
    for _ in range(600):
        t = list(terms[rng.integers(4)])
        for _ in range(rng.integers(1, 3)):
            at = int(rng.integers(0, len(t) + 1))
            t[at : at + int(rng.integers(0, 2))] = list("aiomé"[: rng.integers(0, 2)])
        forms.append("".join(t))
    for form, kind in zip(forms, trie.match(forms)):
        exact = form in terms
        near = any(edits(form, t) <= 1 for t in terms if len(t) >= toxicity.FUZZY_FROM)
        assert kind == (toxicity.BEGINS if form.startswith("lowei") else toxicity.EXACT if exact else toxicity.EDITED if near else 0), form


def test_misspelt_forms_of_a_beginning():
    seen = [("stupi", True, 40, 0), ("stup", True, 40, 0), ("stupid", True, 40, 0), ("stupid", False, 14, 0), ("stupidity", False, 13, 0), ("stupidly", False, 13, 0), ("the", False, 40, 4000)]
    terms = toxicity.choose_terms(seen, 50, 5000)
    assert any(begins for _, begins in terms) and ("stupidity", False) in terms
    trie = toxicity.FuzzyTrie(terms)
    assert trie.match(["stupidness", "stpidity", "stupadly", "stopped", "xstupid"]).tolist() == [toxicity.BEGINS, toxicity.EDITED, toxicity.EDITED, 0, toxicity.EDITED]
    many = [(f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}word", False, 40, 0) for i in range(3000)]
    assert len(toxicity.choose_terms(many, 50, 5000)) == 3000


def test_logistic_scores_are_plain_python(spark, docs):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    lexicon, weights = toxicity.train(docs, labels)
    got = {(r.doc_id): r for r in toxicity.score(docs, labels).collect()}
    for i, t in rows(docs):
        own = words(ascii_lower(t))
        form = [w.strip(toxicity.MARKS) for w in own]
        x = dict.fromkeys(toxicity.FEATURES, 0.0)
        kinds = {f: int(k) for f, k in zip(form, lexicon.trie.match(form))}
        hits = [j for j, f in enumerate(form) if kinds[f] and not (kinds[f] == toxicity.EDITED and f in lexicon.innocent)]
        for j in hits:
            near = list(range(max(0, j - toxicity.WINDOW), j)), list(range(j + 1, min(len(own), j + 1 + toxicity.WINDOW)))
            names = {form[k] for k in near[0] + near[1]}
            opened = own[j][:1] in toxicity.QUOTES or any(own[k][:1] in toxicity.QUOTES and own[k][-1:] not in toxicity.QUOTES for k in near[0])
            closed = own[j].rstrip(".,;:!?")[-1:] in toxicity.QUOTES or any(own[k].rstrip(".,;:!?")[-1:] in toxicity.QUOTES for k in near[1])
            quoted = (opened and closed) or bool(names & toxicity.REPORTING)
            x["quoted" if quoted else toxicity.FEATURES[kinds[form[j]] - 1]] += 1
            x["addressed"] += (not quoted) and bool(names & toxicity.ADDRESS)
        x["density"] = 100 * (x["exact"] + x["begins"] + x["edited"] + x["quoted"]) / max(1, len(own))
        z = sum(w * math.log1p(x[f]) for w, f in zip(weights, toxicity.FEATURES)) + weights[-1]
        expected = 0.0 if z <= -30 else 1.0 if z >= 30 else 1 / (1 + math.exp(-z))
        assert got[i].score == pytest.approx(expected) and got[i].predicted == (expected >= 0.5)


def test_quotation_is_not_abuse():
    lexicon = toxicity.Lexicon([("idiot", False)])
    x = lexicon.features(pa.array(["you are an Idiot!", 'he wrote "idiot" on it', None, ""]))
    f = toxicity.FEATURES.index
    assert x[0, f("exact")] > 0 and x[0, f("addressed")] > 0 and x[1, f("quoted")] > 0 and x[1, f("exact")] == 0 and not x[2:].any()


def test_held_out_toxic_documents_are_found(spark):
    d = "/root/testdata/sf0.1"
    if not os.path.exists(d):
        pytest.skip("no larger tables")
    got = {r.doc_id: r for r in queries.QUERIES["op5_toxicity"](spark, d).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert sum(y and p for y, p in held) >= 0.85 * sum(y for y, _ in held) and sum(p and not y for y, p in held) <= 0.01 * len(held)


@TABLES
def test_toxicity_of_odd_tables(spark, tables, name):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd_labels = spark.createDataFrame([(1, 0, 1), (1, 0, None), (2, 0, 0), (None, 1, 1), (99, 1, 1)], "doc_id bigint, quality int, toxic int")
    for labels in (none, odd_labels):
        got = toxicity.score(tables[name], labels).collect()
        assert len(got) == tables[name].count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)


# ---- 6: substrings


@TABLES
@pytest.mark.parametrize("bits", [27, 7])
def test_substrings(tables, name, bits):
    source = rows(tables[name])
    least = {}
    for i, t in source:
        w = words(t)
        if i is not None:
            for j in range(len(w) - 49):
                k = tuple(w[j : j + 50])
                least[k] = min(i, least.get(k, i))
    expected = []
    for i, t in source:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if i is not None and least[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        left = " ".join(x for x, g in zip(w, gone) if not g)
        expected.append((str(i), len(w), sum(gone), hashlib.sha256(left.encode()).hexdigest(), t if not sum(gone) else left))
    got = debruijn.deduplicate(tables[name], keep=("lang",), bloom_bits=bits).collect()
    assert sorted(expected, key=str) == sorted(((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in got), key=str)


def test_covered_words():
    assert debruijn.covered(10, [(0, 1), (2, 1)], 4).tolist() == [True] * 6 + [False] * 4


# ---- 7: quality


def measures(text):
    w = words(text)
    places = collections.defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {j for at in places.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), again, len(covered)


@TABLES
def test_quality_measures(tables, name):
    got = weak.judge(tables[name]).collect()
    expected = sorted((str(i), *measures(t)) for i, t in rows(tables[name]))
    assert expected == sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    kept = weak.keep_good(tables[name])
    assert kept.columns == tables[name].columns and kept.count() == sum(r.kept for r in got)


def test_posteriors_are_plain_python(docs):
    """EM over the rules' votes, row by row and rule by rule."""
    got = {r.doc_id: r for r in weak.judge(docs).collect()}
    v = {}
    for i, t in rows(docs):
        batch = pa.record_batch([pa.array([t], pa.string())], ["t"])
        v[i] = weak.votes(weak.measure(batch, 0))[0].tolist()
    learnt = [v[i] for i in v if not got[i].base_failed]
    good, bad = weak.PRIOR_GOOD, [[weak.BAD_IF_GOOD, weak.BAD_IF_BAD] for _ in range(weak.RULES)]

    def chance(row):
        like = [good, 1 - good]
        for c in (0, 1):
            for rule, vote in enumerate(row):
                like[c] *= bad[rule][c] if vote < 0 else 1 - bad[rule][c] if vote > 0 else 1
        return like[0] / (like[0] + like[1])

    patterns = collections.Counter(map(tuple, learnt))
    n = len(learnt)
    for _ in range(weak.ROUNDS):
        p = {row: chance(row) for row in patterns}
        held = [weak.PRIOR_SHARE * n * weak.PRIOR_GOOD, weak.PRIOR_SHARE * n * (1 - weak.PRIOR_GOOD)]
        following = []
        for rule in range(weak.RULES):
            pair = []
            for c, believed in enumerate((weak.BAD_IF_GOOD, weak.BAD_IF_BAD)):
                mine = [(row[rule], k * (p[row] if c == 0 else 1 - p[row])) for row, k in patterns.items()]
                no = sum(x for vote, x in mine if vote < 0) + held[c] * believed
                yes = sum(x for vote, x in mine if vote > 0) + held[c] * (1 - believed)
                pair.append(no / (no + yes))
            following.append(pair)
        good = (sum(k * p[row] for row, k in patterns.items()) + held[0]) / (n + sum(held))
        bad = following
    for i, row in v.items():
        if tuple(row) in patterns:
            assert got[i].posterior == pytest.approx(chance(row), abs=1e-6)
        assert got[i].kept == (not got[i].base_failed and got[i].posterior >= weak.THRESHOLD)


def test_em_finds_planted_classes():
    rng = np.random.default_rng(5)
    good = rng.random(20_000) < 0.8
    v = np.where(rng.random((len(good), 6)) < np.where(good, 0.03, 0.4)[:, None], -1, 1) * (rng.random((len(good), 6)) < 0.9)
    patterns, at, counts = np.unique(weak._pattern(v), return_inverse=True, return_counts=True)
    p, model = weak.posteriors(patterns, counts.astype(float), 6)
    assert abs(model["good"] - 0.8) < 0.06 and ((p[at] >= 0.5) == good).mean() > 0.93


# ---- 8: mixing


@TABLES
def test_mix_is_the_sql_and_meets_its_targets(tables, name):
    frame = tables[name].select("doc_id", "text", "lang", "source", "n_chars").toPandas()
    con = duckdb.connect()
    con.register("frame", frame.astype({"doc_id": "Int64", "n_chars": "Int64"}))
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text::VARCHAR AS text, source::VARCHAR AS source FROM frame")
    got = mixing.mix(tables[name]).collect()
    columns = ("doc_id", "size", "source_size", "target", "taken")
    by_value = lambda rows: sorted(rows, key=str)
    assert by_value(tuple(r[c] for c in columns) for r in got) == by_value(con.execute(f"SELECT {', '.join(columns)} FROM ({mixing.ORACLE})").fetchall())
    assert len(got) == len(frame) and all(0 <= r.taken <= 2 * r.size for r in got)
    if got:
        by_source = collections.defaultdict(list)
        for r in got:
            by_source[(r.source_size, r.target)].append(r)
        assert all(abs(sum(r.taken for r in rs) - target) <= 1 for (_, target), rs in by_source.items())
        assert sum(t for _, t in by_source) == pytest.approx(1.5 * sum(s for s, _ in by_source))


def test_sample_gives_what_the_mix_says(docs):
    taken = sum(r.taken for r in mixing.mix(docs).collect())
    rows_ = mixing.sample(docs)
    assert rows_.columns == docs.columns and rows_.select(F.sum(mixing.word_count(F.col("text")))).head()[0] == taken


def test_rows_of_one_id_share_the_cut(spark):
    rows_ = [(7, "w " * 100, "a")] * 600 + [(8, "w " * 100, "b")] * 3 + [(None, "v " * 10, "c")] * 400
    frame = spark.createDataFrame(rows_, "doc_id long, text string, source string").repartition(5)
    got = mixing.mix(common.saved(frame)).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= 1 and all(r.taken <= 2 * r.size for r in rs)
        assert sum(r.taken % r.size > 0 for r in rs) <= 1
    taken = mixing.sample(common.saved(frame)).select(F.sum(mixing.word_count(F.col("text")))).head()[0]
    assert taken == sum(r.taken for r in got)


def test_water_stands_level(spark):
    sizes = spark.createDataFrame([("sa", 10), ("sb", 1000), ("sc", 10), ("t", 0)], "origin string, source_size long")
    got = {r.origin: r.target for r in mixing.targets(sizes).collect()}
    assert got == {"sa": 20.0, "sb": 1490.0, "sc": 20.0, "t": 0.0}


# ---- 9: packing


@TABLES
def test_packing(tables, name):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    known = Tokenizer.from_file(path)
    expected = collections.Counter()
    for i, t in rows(tables[name]):
        ids = known.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            piece = np.array(ids[at : at + 2048], "<u4")
            expected[(i, k, at, len(piece), zlib.crc32(piece.tobytes()))] += 1
    got = packing.pack_documents(tables[name], path).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    check_sequences(got)


def check_sequences(got):
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [n for _, n in parts])[:-1]) and sum(n for _, n in parts) <= 2048
    return len(by)


@pytest.mark.parametrize("low, high, partition", [(600, 1500, 300), (1, 2000, 150), (1025, 2047, 100)])
def test_rounds_of_exchange_and_certificate(spark, low, high, partition):
    lengths = np.random.default_rng(6).integers(low, high, 3000)
    cut = spark.createDataFrame([(i, i, 0, 0, int(n), 7) for i, n in enumerate(lengths)] + [(9, 3000, 0, 0, 2048, 7), (9, 3000, 1, 2048, 2048, 7)], "doc_id long, row long, piece int, start long, length long, ids_crc32 long")
    packed = common.saved(packing.pack(common.saved(cut), partition=partition))
    got = packed.collect()
    assert sorted((r.doc_id, r.piece, r.length) for r in got) == sorted([(i, 0, int(n)) for i, n in enumerate(lengths)] + [(9, 0, 2048), (9, 1, 2048)])
    used, alone = check_sequences(got), len(packing.best_fit(lengths)[2]) + 2
    assert packing.lower_bound(lengths) + 2 == packing.total_bound(packed) <= used <= 1.03 * alone
    # each lot's certificate is of the pieces packed there
    lots = collections.defaultdict(list)
    for r in got:
        lots[r.lot].append(r)
    for c in packing.certificate(packed).collect():
        own = lots.pop(c.lot)
        assert (c.pieces, c.sequences, c.bound) == (len(own), len({r.sequence_id for r in own}), packing.lower_bound(np.array([r.length for r in own])))
        assert c.sequences >= c.bound
    assert not lots


@pytest.mark.parametrize("seed", range(4))
def test_bounds_hold(seed):
    lengths = np.random.default_rng(seed).integers(1, [2048, 900, 700, 1100][seed], 400)
    assert packing.lower_bound(lengths) <= len(packing.best_fit(lengths)[2])
    assert packing.lower_bound(np.full(9, 1025)) == 9 and packing.lower_bound(np.full(9, 683)) == 5


# ---- the pipeline


def least_of_near_copies(rows):
    """Ids of the documents that stay: of each component of texts whose sets of five words have a Jaccard similarity of 0.8 the least."""
    sets = {}
    for i, t in rows:
        w = words(ascii_lower(t))
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for i, own in sorted(sets.items()):
        both = collections.Counter(j for s in own for j in holders[s])
        for j, n in both.items():
            if n >= 0.8 * (len(own) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in own:
            holders[s].append(i)
    empty = [i for i in sets if not sets[i]]
    for i in empty:
        root[i] = min(empty)
    return sorted({find(i) for i in sets})


def brute_cut(rows):
    """Texts without the words of windows of fifty words that a smaller id has."""
    least = {}
    for i, t in rows:
        w = words(t)
        for j in range(len(w) - 49):
            k = tuple(w[j : j + 50])
            least[k] = min(i, least.get(k, i))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for j in range(len(w) - 49):
            if least[tuple(w[j : j + 50])] < i:
                gone[j : j + 50] = [True] * 50
        out[i] = " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t
    return out


def test_pipeline(spark, docs):
    """Each stage against a brute-force version of it, on what the stage before has kept."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(queries.tokenizer_path())
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in now.collect()} if name != "best-fit packing" else None
        listed = rows(now)
        after = common.saved(stage(spark, now, DATA), "test")
        got = after.collect()
        if name == "quality rules":
            kept = {r.doc_id for r in weak.judge(now).filter("kept").collect()}
            assert {r.doc_id: r for r in got} == {i: before[i] for i in kept} and len(got) == len(kept)
        elif name == "SimHash near-dedup":
            assert sorted(r.doc_id for r in got) == least_of_near_copies(listed) and all(before[r.doc_id] == r for r in got)
        elif name == "substring dedup":
            assert {r.doc_id: r.text for r in got} == brute_cut(listed) and all(r.n_chars == len(r.text) for r in got)
        elif name == "mixing to target weights":
            taken = {r.doc_id: r.taken for r in mixing.mix(now).collect()}
            found = collections.Counter()
            for r in got:
                found[r.doc_id] += len(words(r.text))
                assert words(before[r.doc_id].text)[: len(words(r.text))] == words(r.text)
            assert {i: n for i, n in taken.items() if n} == dict(found)
        else:
            ids = collections.Counter((i, len(known.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in listed)
            pieces = collections.defaultdict(list)
            for r in got:
                pieces[r.doc_id].append(r.length)
            total = collections.Counter()
            for (i, n), times in ids.items():
                total[i] += n * times
            assert {i: sum(p) for i, p in pieces.items()} == total
        if name != "best-fit packing":
            assert after.columns == docs.columns
        now = after
    assert check_sequences(now.collect()) >= packing.total_bound(now) > 0


#: All names that the stages use inside.
INSIDE = (
    "c0 c1 c2 c9 row_hash set_id keys place shingles root n a b node crowded_id crowded_row stays rank first none whole_text id_hash spans span_doc span_row n_words n_removed kept_sha256 kept_text origin size target part copy cut_at repeats"
    " source_size lot bucket left nth pattern posterior kept piece start length ids_crc32 local given sequence_id offset owner body asked wrapper"
).split()


def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    frame = spark.createDataFrame(ODD, SCHEMA).withColumns({c: F.concat(F.lit(f"{c} "), F.col("source")) for c in INSIDE} | {"place in filter": F.lit(1), "a.b": F.lit(2)})
    now, empty = frame, frame.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        now, empty = common.saved(stage(spark, now, DATA), "test"), common.saved(stage(spark, empty, DATA), "test")
        assert empty.count() == 0
        if name != "best-fit packing":
            assert now.columns == frame.columns and now.count() > 0
            assert all(r[c] == (None if r["source"] is None else f"{c} {r['source']}") for r in now.collect() for c in INSIDE)
    assert "sequence_id" in now.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:  # n_chars isn't needed
        assert stage(spark, spark.createDataFrame(ODD, SCHEMA).drop("n_chars"), DATA).count() > 0


def test_near_dedup_stage_is_exact_jaccard(spark, odd):
    import corpus_pipeline

    rng = np.random.default_rng(7)
    planted = []
    for _ in range(25):
        base = [f"w{x}" for x in rng.integers(0, 5000, int(rng.integers(200, 600)))]
        planted.append(base)
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            planted.append([f"v{rng.integers(9999)}" if rng.random() < share else w for w in base])
    texts = [(i, " ".join(w)) for i, w in enumerate(planted)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in planted]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["SimHash near-dedup"]
    assert sorted(r.doc_id for r in stage(spark, frame, DATA).collect()) == sorted(set(root))
    assert sorted(r.doc_id for r in jaccard.keep_first(frame, chunk=2).collect()) == sorted(set(root))
    ids = [r.doc_id for r in jaccard.keep_first(odd).collect()]
    assert sorted(i for i in ids if i is not None) == [1, 1, 3, 6, 7, 8] and ids.count(None) == 1  # 9 and 10 are mostly the passage of 8


def test_one_of_each_family_leads():
    prints = np.array([0, 1, 0xFFF, 0xFFFFFFFF, 0xFFFFFFFE, 0], np.uint64)
    assert toxicity.leaders(prints, np.array([0, 0, 0, 0, 0, 1])).tolist() == [0, 3, 5]


def test_near_dedup_stage_finds_candidates_by_simhash(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 5000, 400)) for _ in range(30)]
    texts += [t.replace(t.split()[200], "other", 1) for t in texts[:20]]
    sets = jaccard.shingle_sets(pa.array(texts))
    prints = [int(jaccard.fingerprint(s)) for s in sets]
    assert prints == [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in s) > len(s)) for s in sets]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)] + [(90, 5), (91, 5)]
    found = {frozenset((r.a, r.b)) for r in jaccard.fingerprint_links(spark.createDataFrame(rows, "set_id long, fp long")).collect()}
    near = {frozenset((i, j)) for i in range(50) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= simhash.RADIUS}
    assert found == near | {frozenset((90, 91))} and len(near) > 10
