"""Each operator against a brute-force version, and on the cases that must not break it."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import langid, licenses, lm, merkle, mixing, neardup, quality, sentencepiece, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, label string, n double, key string"
VOCAB = ["the", "of", "and", "ça", "Über", "tree", "river", "stone", "light", "wind", "north", "a", "to", "blue", "Fire"]


def make(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    full = [(i, t, lang, src, None, 99, "x", 1.5, None) for i, t, lang, src in rows]
    return spark.createDataFrame(full, SCHEMA)


def corpus(seed=5):
    rng = random.Random(seed)
    say = lambda n: " ".join(rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(n))
    base = [say(rng.randrange(3, 160)) for _ in range(30)]
    passage = say(90)
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 4}") for i, t in enumerate(base)]
    rows += [(40 + i, base[3], "en", "s0") for i in range(4)]  # exact copies
    rows += [(50 + i, t.replace("river", "lake", 1) + f" end{i}", "en", "s1") for i, t in enumerate(base[5:12])]  # near copies
    rows += [(60 + i, f"{say(20)}\n{passage}\n{say(15)}", "fr", "s2") for i in range(5)]  # a shared passage
    rows += [(70, None, None, None), (71, "", "en", "s0"), (72, " \n\t ", "en", "s0"), (73, "one", "en", None), (74, say(6000), "en", "s3"), (75, "日本語 \U0001f600 text ▁ x", "fr", "s1")]
    rows += [(3, base[3], "fr", "s3"), (None, "no id at all here", "en", "s1"), (76, "a b c a b c a b c a b c\na b c\na b c\n\n", "en", "s0")]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, corpus()).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return make(spark, [])


def words(t):
    return (t or "").encode().split()


# 1


def test_toxicity_finds_marked_documents(spark):
    rng = random.Random(1)
    say = lambda n: " ".join(rng.choice(VOCAB) + str(rng.randrange(200)) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        rows.append((i, say(60) + (" " + " ".join(rng.sample(["grimble", "snarkle", "vexing", "blightful"], 2)) if bad else ""), "en", "s"))
        if i < 300:
            labels.append((i, 1, int(bad)))
    rows += [(900, None, None, None), (901, "", "en", "s"), (902, say(30000), "en", "s")]
    d, lab = make(spark, rows), spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(d, toxicity.train(d, lab)).collect()}
    fresh = range(300, 400)
    assert sum(got[i]["toxic"] == (i % 5 == 0) for i in fresh) >= 98
    assert not got[900]["toxic"] and not got[901]["toxic"] and not got[902]["toxic"]
    assert all(0 <= r["expected_severity"] <= 3 and r["kept"] != r["toxic"] for r in got.values())


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).where("toxic").count() == 0
    assert toxicity.score(empty, toxicity.train(empty, none)).count() == 0


def test_cumulative_link_orders_its_thresholds():
    rng = np.random.default_rng(0)
    rows = [rng.choice(6, rng.integers(0, 4), replace=False) for _ in range(600)]
    true = np.array([1.5, 1.0, 0.5, 0, 0, -1])
    grades = np.array([int(min(3, max(0, true[r].sum() + rng.normal(0, 0.3)))) for r in rows])
    w, t = toxicity.fit_cumulative(rows, grades, 6)
    assert (np.diff(t) > 0).all() and w[0] > w[1] > w[3]


# 2


def test_quality_statistics(docs):
    got = {(r["doc_id"], r["n_words"]): r for r in quality.stats(docs).collect()}
    for i, t, *_ in corpus():
        w = words(t)
        win = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(win)
        covered = {k + j for k, x in enumerate(win) if n[x] > 1 for j in range(5)}
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = got[(i, len(w))]
        assert r["n_repeat_words"] == len(covered) and r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["word_chars"] == sum(len(x.decode()) for x in w) and r["n_symbols"] == sum((t or "").count(c) for c in "#*$%&|<>")


def test_quality_judges_every_row(docs, empty):
    rows = quality.judge(docs).collect()
    assert len(rows) == len(corpus())
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"]) and 0 <= r["quality"] <= 1
    assert quality.judge(empty).count() == 0


def em_by_hand(votes, counts):
    """The same estimate, a document pattern and a rule at a time."""
    post = [(sum(x == 1 for x in v) + 1) / (sum(x != 0 for x in v) + 2) for v in votes]
    for _ in range(1000):
        table = {}
        for c in (0, 1):
            for rule in range(len(votes[0])):
                n = {o: 1.0 for o in (-1, 0, 1)}
                for v, k, p in zip(votes, counts, post):
                    n[v[rule]] += k * (p if c else 1 - p)
                for o in n:
                    table[c, rule, o] = n[o] / sum(n.values())
        prior = (sum(k * p for k, p in zip(counts, post)) + 1) / (sum(counts) + 2)
        new = []
        for v in votes:
            good, bad = prior, 1 - prior
            for rule, o in enumerate(v):
                good, bad = good * table[1, rule, o], bad * table[0, rule, o]
            new.append(good / (good + bad))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-9
        post = new
        if done:
            break
    return prior, post


def planted_votes(n=4000):
    """Rules of different accuracies: three that see most bad documents, one that is wrong about many good ones."""
    rng = np.random.default_rng(2)
    good = rng.random(n) < 0.85
    sees = lambda hit, false: np.where(rng.random(n) < np.where(good, false, hit), -1, np.where(rng.random(n) < 0.8, 1, 0))
    return good, np.stack([sees(0.9, 0.02), sees(0.85, 0.03), sees(0.8, 0.02), sees(0.5, 0.3)], axis=1)


def test_em_is_the_one_by_hand():
    _, votes = planted_votes()
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    prior, _, post = quality.fit(patterns, counts.astype(float))
    want_prior, want = em_by_hand(patterns.tolist(), counts.tolist())
    assert abs(prior - want_prior) < 1e-6 and np.abs(post - want).max() < 1e-6


def test_em_beats_all_must_pass():
    good, votes = planted_votes()
    patterns, inverse, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, accuracy, post = quality.fit(patterns, counts.astype(float))
    right = ((post[inverse.ravel()] >= 0.5) == good).mean()
    assert abs(prior - 0.85) < 0.03 and right > 0.97 and right > ((votes != -1).all(axis=1) == good).mean() + 0.2
    # How often each rule calls a bad and a good document bad.
    assert np.abs(accuracy[0, :, 0] - [0.9, 0.85, 0.8, 0.5]).max() < 0.06 and np.abs(accuracy[1, :, 0] - [0.02, 0.03, 0.02, 0.3]).max() < 0.03


def test_kept_is_the_posterior_of_the_votes(docs):
    """Votes, posterior and verdict of every document, from the statistics and the rules written out."""
    rows = quality.judge(docs).collect()
    over = lambda part, whole, most: -1 if part > most * whole else 1 if part <= most / 2 * whole else 0
    within = lambda bad, fine: -1 if bad else 1 if fine else 0
    votes = []
    for r in rows:
        n, chars, lines = (max(1, r[k]) for k in ("n_words", "word_chars", "n_lines"))
        votes.append((within(r["n_words"] < 50, r["n_words"] >= 100), over(r["n_symbols"], n, 0.1), over(r["n_symbols"], chars, 0.05), over(r["n_symbol_words"], n, 0.2), over(r["n_plain_words"], n, 0.2), over(r["n_repeat_words"], n, 0.15), over(r["n_dup_lines"], lines, 0.3), within(not 3 * n <= chars <= 10 * n, 4 * n <= chars <= 8 * n), within(r["n_ended"] < 0.12 * lines, r["n_ended"] >= 0.5 * lines), over(r["n_upper"], chars, 0.3), over(r["n_digits"], chars, 0.2), within(r["n_distinct"] < 0.15 * n, r["n_distinct"] >= 0.3 * n)))
    seen = Counter(votes)
    _, post = em_by_hand(list(seen), list(seen.values()))
    of = dict(zip(seen, post))
    for r, v in zip(rows, votes):
        assert tuple(r[f"v_{k}"] for k in quality.rules()) == v
        assert abs(r["quality"] - of[v]) < 1e-6 and r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)


# 3


def test_language_by_words_then_grams(spark, docs, empty):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("le chat est sur la table", "fr"), ("the cat is on the table", "en"), ("der Hund ist auf dem Tisch", "de")] * 20)]
    model = langid.train(make(spark, rows))
    asked = make(spark, [(1, "LA TABLE EST", None, None), (2, "is the", None, None), (3, "Hunde", None, None), (4, None, None, None), (5, "12 34 !", None, None), (6, "", None, None), (7, "der Tisch " * 20000, None, None)])
    got = {r["doc_id"]: r for r in langid.predict(asked, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 7)] == ["fr", "en", "de", "und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(docs, langid.train(empty)).where("lang_pred != 'und'").count() == 0
    assert langid.predict(empty, model).count() == 0


def test_language_costs_by_hand(spark):
    """Predictions and scores from counts of words and n-grams, the longest known n-gram first."""
    say = {"fr": "le chat noir est sur la grande table rouge", "en": "the black cat is on the big red table", "de": "der kleine hund ist auf dem grossen tisch"}
    learn = [(i, " ".join(random.Random(i).sample(say[x].split(), 5)), x, "s") for i, x in enumerate(list(say) * 20)]
    asked = [(i, t, None, "s") for i, t in enumerate(["le chat", "Tables rouges", "hundert tischler", "catalog blackish", "zzz", "der the le", "x" * 50, "grand"])]
    mark = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    count, total = Counter(), Counter()
    for _, t, x, _ in learn:
        for w in t.split():
            for n, g in [(0, w), *((n, g) for n in range(1, 6) for g in mark(w, n))]:
                count[n, g, x] += 1
                total[n, x] += 1
    known = {k[:2] for k in count if sum(count[(*k[:2], x)] for x in say) >= langid.MIN_COUNT}
    cost = lambda n, g, x: min(langid.PENALTY, -math.log10(count[n, g, x] / total[n, x])) if count[n, g, x] else langid.PENALTY
    got = {r["doc_id"]: r for r in langid.predict(make(spark, asked), langid.train(make(spark, learn))).collect()}
    for i, t, *_ in asked:
        sums = []
        for w in t.lower().split():
            units = [(0, w)] if (0, w) in known else next(([(n, g) for g in mark(w, n) if (n, g) in known] for n in (5, 4, 3, 2, 1) if any((n, g) in known for g in mark(w, n))), [])
            if units:
                sums.append({x: sum(cost(n, g, x) for n, g in units) / len(units) for x in say})
        mean = {x: sum(s[x] for s in sums) / max(1, len(sums)) for x in sorted(say)}
        best = min(mean, key=mean.get)
        assert got[i]["lang_pred"] == best
        assert abs(got[i]["score"] - 1 / sum(10 ** (-(m - mean[best]) / langid.DECADE) for m in mean.values())) < 1e-9


# 4


@pytest.mark.parametrize("max_bytes, probe_bytes, segment_tokens", [(1 << 30, 64 << 20, 1 << 20), (1 << 30, 64 << 20, 500), (0, 64 << 20, 2000), (0, 100, 500)])
def test_lm_scores_by_hand(docs, max_bytes, probe_bytes, segment_tokens, monkeypatch):
    """Bigrams with counts as powers of two, smoothed by the number of followers; a filter this empty answers exactly, sent or asked."""
    monkeypatch.setattr(lm, "PROBE_BYTES", probe_bytes)
    low = lambda t: [w.decode() for w in (t or "").encode().lower().split()]
    learn = [low(t) for i, t, *_ in corpus() if i is None or i % 7 != 2]
    one = Counter(w for t in learn for w in [*t, "\n"])
    two = Counter(x for t in learn for x in zip(["\n", *t], [*t, "\n"]))
    followers = Counter(a for a, _ in two)
    size = sum(one.values()) + len(one) + 1
    want = []
    for i, t, *_ in corpus():
        total = 0.0
        for a, b in zip(["\n", *low(t)], [*low(t), "\n"]):
            found = 2.0 ** int(math.log2(two[a, b])) if two[a, b] else 0.0
            after = followers[a] or 1
            total += math.log10((found + after * (one[b] + 1) / size) / (one[a] + after))
        want.append((str(i), round(total, 5)))
    model = lm.train(docs.where("doc_id % 7 != 2 OR doc_id IS NULL"), max_bytes=max_bytes, segment_tokens=segment_tokens, bits_per_item=3000)
    assert (model.segments.n > 1) == (segment_tokens < 1 << 20) and bool(model.hot) == (segment_tokens == 500) and (model.sent is None) == (max_bytes == 0)
    assert (model.total, model.distinct) == (sum(one.values()), len(one))
    assert sorted((str(r["doc_id"]), round(r["score"], 5)) for r in lm.score(docs, model).collect()) == sorted(want)


@pytest.mark.parametrize("max_bytes", [1 << 28, 0])
def test_lm_counts_are_exact(docs, max_bytes, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 100)
    learn = docs.where("doc_id % 7 != 2 OR doc_id IS NULL")
    got = lm.score(docs, lm.train(learn, max_bytes=max_bytes, segment_tokens=300), "source", "key").collect()
    low = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + ["\n"]
    seen = Counter(w for i, t, *_ in corpus() if i is None or i % 7 != 2 for w in low(t))
    n, v = sum(seen.values()), len(seen)
    want = sorted((i or -1, len(low(t)), sum(seen[w] > 0 for w in low(t)), round(sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in low(t)), 5), str(s)) for i, t, _, s in corpus())
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 5), str(r["source"])) for r in got) == want
    assert all(r["score"] < 0 and r["train_tokens"] == n and r["key"] is None for r in got)


def test_lm_probabilities_of_what_follows_a_word(spark):
    """Over all words and one unseen, what may follow a word has at most the probability 1, whatever the filter answers falsely."""
    learn = make(spark, [(i, t, None, None) for i, t in enumerate(["a b a c", "a b b", "c a b", "a a", ""])])
    model = lm.train(learn)
    asked = make(spark, [(i, f"a {w}", None, None) for i, w in enumerate("abcz")] + [(9, "a", None, None)])
    got = {r["doc_id"]: 10 ** r["score"] for r in lm.score(asked, model).collect()}
    ends = {r["doc_id"]: 10 ** r["score"] for r in lm.score(make(spark, [(i, w, None, None) for i, w in enumerate("abcz")]), model).collect()}
    assert all(0 < x < 1 for x in [*got.values(), *ends.values()])
    assert got[1] > got[2] > got[3]  # "a b" was met thrice, "a c" once, "a z" never


def test_lm_very_long_text_in_small_pieces(docs, spark, monkeypatch):
    long = make(spark, [(1, "some words to say again " * 60_000, None, None), (2, None, None, None), (2, None, None, None)])
    model = lm.train(long)
    whole = {(r["doc_id"], r["n_tokens"], round(r["score"], 4)) for r in lm.score(long, model).collect()}
    monkeypatch.setattr(lm, "PIECE", 1000)
    assert {(r["doc_id"], r["n_tokens"], round(r["score"], 4)) for r in lm.score(long, lm.train(long, max_bytes=0)).collect()} == whole
    assert {n for _, n, _ in whole} == {300_001, 1}


def test_lm_of_nothing(docs, empty):
    for max_bytes in (1 << 28, 0):
        model = lm.train(empty, max_bytes=max_bytes)
        assert model.total == 0
        assert lm.score(docs, model).where("n_known > 0 OR score <> 0").count() == 0
        assert lm.score(empty, model).count() == 0


def test_bloom_filter_has_no_false_negatives():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 32, 9000).astype(np.uint32))
    held, other = keys[::2], keys[1::2]
    q = np.arange(len(held)) % 6 + 1
    bits = lm.segment_bits(held, q)
    assert (lm.levels(bits, held) >= q).all() and (lm.levels(bits, held) == q).mean() > 0.98
    assert (lm.levels(bits, other) > 0).mean() < 0.02


# 5


def test_license_rules(spark, docs, empty):
    mit = "Permission granted. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\nThe software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement."
    asked = make(spark, [(1, f"Hello.\nMIT License\n\n{mit}", None, None), (2, "Licensed under the Apache License, Version 2.0. Released under the MIT license.", None, None), (3, "You may obtain a copy of the License at", None, None), (4, None, None, None)])
    got = {r["doc_id"]: r for r in licenses.scan(asked).collect()}
    assert [got[i]["licenses"] for i in (1, 2, 3, 4)] == ["MIT", "Apache-2.0,MIT", "", ""]
    assert got[1]["n_sentences"] == 3 and got[1]["unmatched"] == "" and got[3]["unmatched"] == "apache2_obtain"
    assert licenses.scan(docs).count() == len(corpus()) and licenses.scan(empty).count() == 0


def test_license_scan_is_native(docs):
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 6


@pytest.mark.parametrize("block_docs", [500, 3])
def test_fingerprints_of_neighbours(docs, empty, block_docs):
    rows = sorted(((i, t or "") for i, t, *_ in corpus()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = t[: len(t) - len(t) // 4] + following[: len(t) // 4]
        a, b, c = merkle.Tree.of(t), merkle.Tree.of(changed), merkle.Tree.of(following)
        want.append((str(i), len(t), hashlib.sha256(changed.encode()).hexdigest(), a.root, b.root, round(merkle.likeness(a, b), 9), round(merkle.likeness(a, c), 9), str(merkle.located(a, b) or (None, None))))
    found = merkle.fingerprints(docs, block_docs=block_docs).collect()
    got = [(str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9), str((r["edit_start"], r["edit_end"]))) for r in found]
    assert sorted(got) == sorted(want)
    assert merkle.fingerprints(empty).count() == 0


def test_tree_locates_edits():
    """The span holds every difference, and its ends are no further than a leaf from the first and the last."""
    rng = random.Random(6)
    say = lambda: rng.choice(["One two. ", "three four five six seven eight nine ten eleven ", "\n", "\n\n", "Ça va. ", "x"])
    for _ in range(500):
        old = "".join(say() for _ in range(rng.randrange(12)))
        new = list(old)
        for _ in range(rng.randrange(1, 3)):
            at = rng.randrange(len(new) + 1)
            new[at : at + rng.randrange(3)] = rng.choice(["", "8", "\n", "word "])
        new = "".join(new)
        span = merkle.located(merkle.Tree.of(old), merkle.Tree.of(new))
        assert (span is None) == (old == new)
        if span:
            a, b = span
            assert 0 <= a <= b <= len(new) and old[:a] == new[:a] and old[len(old) - (len(new) - b) :] == new[b:]
            longest = max(map(len, merkle.leaves(old.replace("\n", " ")) + merkle.leaves(new.replace("\n", " "))), default=0)
            first = next((i for i, (x, y) in enumerate(zip(old, new)) if x != y), min(len(old), len(new)))
            assert first - a <= longest + 60
    assert "".join(merkle.leaves("a b. c d e! f")) == "a b. c d e! f"


# 7


def test_mix_meets_targets(spark, docs, empty):
    rows = mixing.mix_report(docs, block_words=8).collect()
    sizes = {}
    for _, t, _, s in corpus():
        sizes[s] = sizes.get(s, 0) + len(words(t))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(order, mixing.water_fill([sizes[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(sizes.values()), 2)))
    taken = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[r["source"]] and abs(r["target"] - targets[r["source"]]) < 1e-6
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert len(rows) == len(corpus())
    assert all(abs(taken[s] - targets[s]) <= 16 + 0.02 * targets[s] for s in order)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_report(docs.repartition(3), block_words=8).collect()))
    assert mixing.mix_report(empty).count() == 0


def test_mixed_documents_hold_what_was_taken(docs):
    want = Counter()
    for r in mixing.mix_report(docs, block_words=8).collect():
        want[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in mixing.mixed_documents(docs, block_words=8).collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert got == +want


def test_bucket_starts_are_running_sums(spark):
    rng = random.Random(9)
    rows = [(s, b, rng.randrange(100)) for s in range(3) for b in rng.sample(range(500), 200)]
    want = {(s, b): sum(n for x, y, n in rows if x == s and y < b) for s, b, _ in rows}
    got = mixing.bucket_starts(spark.createDataFrame(rows, "source_ix int, bucket long, in_bucket long"), 16)
    assert {(r["source_ix"], r["bucket"]): r["base"] for r in got.collect()} == want


def test_permutations_and_water():
    for n in (1, 2, 7, 100, 1000):
        for key in (1, 99):
            assert sorted(mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))) == list(range(n))
    assert mixing.water_fill([10, 100, 0], [3, 1, 2], 165, 2) == pytest.approx([20, 145, 0])
    assert (mixing.draw_shards(np.array([50, 7, 0]), 1, 8).sum(axis=0) == [50, 7, 0]).all()


# 8


def test_sentencepiece_is_the_librarys(docs, empty):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=sentencepiece.DEFAULT_MODEL)
    encoded = sentencepiece.encode(docs).persist()
    texts = Counter((i, t or "") for i, t, *_ in corpus())
    decoded = Counter((r["doc_id"], r["text"]) for r in sentencepiece.decode(encoded).collect())
    assert decoded == texts and encoded.where("NOT round_trip").count() == 0
    by_id = {r["doc_id"]: r["ids"] for r in encoded.collect()}
    assert all(by_id[i] == sp.encode(t) for i, t in texts if "▁" not in t)
    assert sentencepiece.encode(empty).count() == 0


def test_sentencepiece_on_odd_texts():
    from sentencepiece import SentencePieceProcessor

    pieces = sentencepiece.Pieces.load(sentencepiece.DEFAULT_MODEL)
    sp = SentencePieceProcessor(model_file=sentencepiece.DEFAULT_MODEL)
    texts = ["", " ", "  a  ", "a" + " " * 37 + "b", "<s> <0x0A>", "x" * 500, "\n\n a\tb", "Ærøskøbing naïve 北京", "the theorem thereby"]
    ids, offsets = sentencepiece.Cache(pieces).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])] == sp.encode(texts)
    assert sentencepiece.decode_ids(pieces, ids, offsets) == texts


# 9


def brute_components(rows, k, percent):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            sets.setdefault(i, shingles(t))
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("per_member", [2, 0])
def test_links_and_components(docs, empty, per_member):
    want = brute_components(corpus(), 4, 80)
    for r in neardup.link(docs, pairs_per_member=per_member).collect():
        if r["doc_id"] is None:
            assert r["kept"] and r["component_id"] is None
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.link(empty).count() == 0


def test_chains_of_near_copies(spark):
    """Texts that drift: neighbours are linked, ends are not; crowded buckets take the exact join."""
    rng = random.Random(4)
    text, rows = [f"w{i}" for i in range(120)], []
    for i in range(40):
        text[rng.randrange(120)] = f"n{i}"
        rows.append((i, " ".join(text), "en", "s"))
    want = {i: c for i, (_, c) in brute_components(rows, 4, 80).items()}
    for n in (2, 0):
        assert {r["doc_id"]: r["component_id"] for r in neardup.link(make(spark, rows), pairs_per_member=n).collect()} == want


def test_deduplicated_keeps_one_of_each(docs):
    kept = [r["doc_id"] for r in neardup.deduplicated(docs).collect()]
    want = brute_components(corpus(), 4, 80)
    assert sorted(x for x in kept if x is not None) == sorted({c for _, c in want.values()}) and None in kept


# 10


def brute_spans(texts, length):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        spans = []
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                if spans and spans[-1][1] >= i:
                    spans[-1][1] = i + length
                else:
                    spans.append([i, i + length])
        out.append([tuple(s) for s in spans])
    return out


@pytest.mark.parametrize(("length", "gram", "bucket_runs"), [(400, 128, 1000), (40, 12, 1000), (40, 12, 1), (64, 20, 2)])
def test_repeats_are_removed_exactly(docs, length, gram, bucket_runs):
    texts = [(i, (t or "").encode()) for i, t, *_ in corpus()]
    want = []
    for (i, t), spans in zip(texts, brute_spans([t for _, t in texts], length)):
        kept = suffixes.kept_bytes(t, spans)
        want.append((str(i), len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
    got = suffixes.without_repeats(docs, length=length, gram=gram, bucket_runs=bucket_runs).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == sorted(want)


def test_repeats_of_periodic_and_long_texts(spark, empty, monkeypatch):
    rng = random.Random(8)
    long_ = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, "ab" * 300, None, None), (2, long_ + long_[:500], None, None), (3, "x" * 399, None, None), (4, "y" * 401, None, None), (5, long_[1000:1401], None, None)]
    monkeypatch.setattr(suffixes, "PIECE", 700)
    texts = [t.encode() for _, t, *_ in rows]
    want = {i: s for (i, *_), s in zip(rows, brute_spans(texts, 400))}
    for r in suffixes.without_repeats(make(spark, rows)).collect():
        assert [(s["start"], s["stop"]) for s in r["spans"]] == want[r["doc_id"]]
    assert suffixes.without_repeats(empty).count() == 0


# folds


def test_folds_are_those_of_zlib(docs):
    from lodestar.llm.queries import held_out

    for r in docs.where("doc_id IS NOT NULL").select("doc_id", held_out(7, 2).alias("h")).collect():
        assert r["h"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2)
    assert docs.where("doc_id IS NULL").select(held_out(7, 2).alias("h")).collect()[0]["h"] is False
    assert docs.select(F.col("doc_id")).count() == len(corpus())
