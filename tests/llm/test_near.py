"""MinHash, perplexity rules and components against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from equipoise.llm import minhash, perplexity, stars

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def classes(keys, links):
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in keys}


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(60)]
    base = [[rng.choice(words) for _ in range(rng.randint(3, 120))] for _ in range(12)]
    texts = [None, "", "  \n\t", "one", "One", "a b c d", "a b c d e", "long " * 5000]
    for _ in range(n):
        t = list(rng.choice(base))
        if rng.random() < 0.7:
            for _ in range(rng.randint(0, max(1, len(t) // 12))):
                t[rng.randrange(len(t))] = rng.choice(words)
        if rng.random() < 0.2:
            t += passage
        if rng.random() < 0.3:
            t[0] = t[0].upper()
        texts.append((" " if rng.random() < 0.5 else "\n").join(t))
    return texts


def brute(rows):
    s = {k: sets(t) for k, t in rows}
    keys = sorted(s)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    return s, classes(keys, links)


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(50)] + [(100, 200 + i) for i in range(40)] + [(rng.randint(300, 420), rng.randint(300, 420)) for _ in range(80)] + [(7, 7)]
    rng.shuffle(links)
    keys = {x for e in links for x in e}
    got = {r.node: r.root for r in stars.components(spark.createDataFrame([*links, (None, 3), (3, None)], "a long, b long")).collect()}
    assert {k: got.get(k, k) for k in keys} == classes(keys, links)
    assert stars.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rows = list(enumerate(corpus()))
    want, comp = brute(rows)
    table = spark.createDataFrame([(k, t, "x", "y", 1, 2) for k, t in rows], "doc_id long, text string, node string, bucket string, n int, root int")
    got = minhash.near_duplicates(table.union(table.where("doc_id in (3, 12)"))).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(want[r.doc_id]), comp[r.doc_id], comp[r.doc_id] == r.doc_id)
    assert minhash.near_duplicates(table.limit(0)).count() == 0
    odd = minhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (2, "a b c")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in odd} == {(None, None, True), (4, 2, False), (2, 2, True)}


def test_buckets_without_one_hub(spark):
    """Few short bands put unlike texts into the same buckets; later hubs and pairs must find what the first hub misses."""
    rows = list(enumerate(corpus(50, seed=8)))
    _, comp = brute(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string")
    for hubs, block in ((0, 7), (1, 256), (3, 7)):
        got = minhash.near_duplicates(table, bands=40, rows=1, margin=0.75, hub_rounds=hubs, block_rows=block).collect()
        assert {r.doc_id: r.component_id for r in got} == comp


def test_shared_counts():
    rng = np.random.default_rng(5)
    x, y = ([np.unique(rng.integers(0, 900, rng.integers(0, 400), dtype=np.uint64)) for _ in range(n)] for n in (30, 20))
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in y] for a in x]
    assert minhash.shared_counts(x, y, columns=64).tolist() == want


def test_clusters_hold_all_pairs_of_a_bucket(spark):
    rng = random.Random(7)
    rows = {(rng.randrange(40) if rng.random() < 0.7 else 100 + b, rng.randrange(90)) for b in range(400)}
    members = spark.createDataFrame([(b, n, n) for b, n in rows], "bucket long, node long, root long")
    for spreads in (0, 2):
        parts = defaultdict(set)
        for r in minhash.clusters(members, spreads).collect():
            parts[r.kind, r.part].add(r.node)
        together = {(a, b) for p in parts.values() for a in p for b in p}
        by = defaultdict(set)
        for b, n in rows:
            by[b].add(n)
        assert all((a, b) in together for p in by.values() for a in p for b in p)


def counts(text):
    words = WORD.findall(text or "")
    three = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = {i + k for i, w in enumerate(zip(words, words[1:], words[2:], strict=False)) if three[w] >= 2 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_base_counts():
    for t in [*corpus(), "a\na\n \n \nb c\nb c\n", "é 漢字 👍 x|y <b> #1 $%&*", "a b c a b c a b", "a\x0bb\x0cc\rd\x1ce\x85f"]:
        assert perplexity.base_counts(t) == counts(t), t


def kneser_ney(texts):
    """The same model from plain dictionaries; (context, character) probabilities of order 4."""
    def codes(t):
        return [0, 0, 0] + [48 if 48 <= ord(c) <= 57 else 32 if ord(c) <= 32 else ord(c) & 0xFFFF for c in t]

    level = {4: Counter()}
    for t, ref in texts:
        c = codes(t)
        for i in range(len(c) - 3):
            level[4][tuple(c[i : i + 4])] += ref
    for k in (3, 2, 1):
        level[k] = Counter()
        for g, n in level[k + 1].items():
            level[k][g[1:]] += n > 0
    prob = {}
    for k in (1, 2, 3, 4):
        n = [sum(v == j for v in level[k].values()) for j in range(5)]
        d = [0.5, 0.75, 0.9]
        if min(n[1:]) > 0:
            y = n[1] / (n[1] + 2 * n[2])
            d = [x if 0 < (x := j - (j + 1) * y * n[j + 1] / n[j]) < j else rest for j, rest in zip((1, 2, 3), d, strict=True)]
        total, mass, kinds = Counter(), Counter(), Counter()
        for g, v in level[k].items():
            total[g[:-1]] += v
            mass[g[:-1]] += d[min(v, 3) - 1] if v else 0
            kinds[g[:-1]] += 1
        for g, v in level[k].items():
            c = g[:-1]
            own = (v - (d[min(v, 3) - 1] if v else 0)) / total[c] if total[c] else 0
            back = mass[c] / total[c] if total[c] else 1
            prob[g] = own + back * (prob[g[1:]] if k > 1 else 1 / kinds[c])
    return {t: -np.mean([np.log(prob[tuple(codes(t)[i : i + 4])]) for i in range(len(t))]) for t, _ in texts if t}


@pytest.mark.parametrize("most_rows", [2_000_000, 500])
def test_surprise(spark, most_rows):
    rng = random.Random(2)
    say = lambda n, alphabet: " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n))
    texts = [(say(80, "abcde"), 1) for _ in range(20)] + [("x " + say(70, "vwxyz#$%"), 0), ("short one 12", 0), ("a b c " * 40, 0)]
    rows = [(i, None if i == 0 else "en", t, 5) for i, (t, _) in enumerate([(None, 0), ("", 0), *texts])]
    texts = [(t, int(perplexity.is_reference(t))) for t, _ in texts]
    want = kneser_ney(texts)
    got = perplexity.measure(spark.createDataFrame(rows, "doc_id long, lang string, text string, surprise int"), most_rows).collect()
    assert len(got) == len(rows)
    for r in got:
        t = rows[r.doc_id][2]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t)
        assert r.surprise is None if not t else r.surprise == pytest.approx(want[t], rel=1e-4)


def test_judge(spark):
    rng = random.Random(4)
    say = lambda: " ".join(rng.choice(["the", "cat", "and", "dog", "ran", "home", "then", "sat", "down", "again"]) for _ in range(70))
    rows = [(i, "en", say()) for i in range(40)] + [(90, "en", " ".join(w + "%%%" for w in say().split())), (91, None, None), (92, "en", "few words")]
    got = {r.doc_id: r.kept for r in perplexity.judge(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert all(got[i] for i in range(40)) and not got[90] and not got[91] and not got[92]
    assert perplexity.judge(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
    assert defaultdict(int, got)[5]
