"""Line templates, grid order join and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from equipoise.llm import grid_order, line_templates
from equipoise.llm.shared import word_hashes

from .test_near import classes, sets


def plain_dedup(rows, least=3, depth=3, least_tokens=3, constant=0.7):
    """The same rules with dictionaries of strings."""
    def toks(line):
        out = tuple("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
        return out if len(out) >= least_tokens and sum(w != "<*>" for w in out) >= constant * len(out) else None

    docs, first = Counter(), {}
    for k, t in rows:
        for x in {y for line in (t or "").split("\n") if (y := toks(line))}:
            docs[x] += 1
    leaf = lambda x: (len(x), x[:depth])
    group = defaultdict(list)
    for x in docs:
        group[leaf(x)].append(x)
    template = {}
    for xs in group.values():
        support = Counter()
        for x in xs:
            for i, w in enumerate(x):
                support[i, w] += docs[x]
        for x in xs:
            y = tuple(w if w != "<*>" and support[i, w] >= least else "<*>" for i, w in enumerate(x))
            template[x] = y if len(xs) > 1 and sum(w != "<*>" for w in y) >= constant * len(y) else ("line", x)
    recurs, passage = Counter(), set()
    for k, t in rows:
        for x in {y for line in (t or "").split("\n") if (y := toks(line))}:
            recurs[leaf(x), template[x]] += 1
            if len(x) > 50 and docs[x] >= 2:
                passage.add((leaf(x), template[x]))
            f = (leaf(x), template[x])
            first[f] = min(first.get(f, k), k)
    out = {}
    for k, t in rows:
        keep = [line for line in t.split("\n") if not ((x := toks(line)) and (recurs[leaf(x), template[x]] >= least or (leaf(x), template[x]) in passage) and first[leaf(x), template[x]] != k)] if t else None
        out[k] = t if keep is None else "\n".join(keep)
    return out


def line_rows():
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(n))
    rows = [(0, None), (1, ""), (2, "\n\n"), (3, "too few"), (4, "12 34 56 x"), (5, "word " * 4000)]
    for k in range(6, 60):
        lines = [say(rng.randint(2, 9)) for _ in range(rng.randint(1, 6))]
        if k % 2:
            lines.insert(rng.randint(0, len(lines)), f"Order {k} was sent to the house of {rng.choice(['ann', 'bob', f'n{k}x', 'zoe' + 'q' * k])} today")
        if k % 3 == 0:
            lines.append("All rights are reserved here.")
        rows.append((k, "\n".join(lines)))
    return rows


def test_line_templates(spark):
    rows = line_rows()
    table = spark.createDataFrame([(k, t, "l", 1, None, 5) for k, t in rows], "doc_id long, text string, line string, n_lines int, leaf string, doc int")
    got = {r.doc_id: r for r in line_templates.dedup(table).collect()}
    want = plain_dedup(rows)
    assert {k: r.text for k, r in got.items()} == want
    assert got[6].line == "l" and got[6].doc == 5 and list(got[6].asDict()) == ["doc_id", "text", "line", "leaf", "doc", "n_lines", "n_dropped"]
    for k, t in rows:
        assert got[k].n_lines == (len(t.split("\n")) if t else 0)
        assert got[k].n_dropped == (got[k].n_lines - len(want[k].split("\n")) if t and want[k] != "" else got[k].n_lines if t and t != want[k] else 0)
    assert "All rights are reserved here." in got[6].text and "All rights are reserved here." not in got[9].text
    assert sum("was sent to the house" in r.text for r in got.values() if r.text) < 27
    assert line_templates.dedup(table.limit(0)).count() == 0


def test_passages_of_two_documents(spark):
    """A line of over 50 words goes where a second document has it, in a busy leaf too; one of 50 words, or with another word, stays."""
    say = lambda n, tail: " ".join(["Once more we say", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(n - 5)], tail])
    rows = [(k, f"{line}\nown line {chr(97 + k)} of this") for k, line in enumerate([say(51, "end"), say(51, "end"), say(50, "end"), say(50, "end"), say(60, "one"), say(60, "two"), say(3000, "end"), say(3000, "end")])]
    other = lambda tail: "Once more we say " + " ".join(tail + chr(97 + i % 26) + chr(97 + i // 26) for i in range(47))
    rows += [(20 + k, other(t)) for k, t in enumerate(["x", "x", "y", "z", "q"])]
    got = {r.doc_id: r.text for r in line_templates.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_dedup(rows)
    assert {k for k, t in rows if got[k] != t} == {1, 7, 21}


def test_line_templates_with_a_full_filter(spark, monkeypatch):
    """A bit filter that rules nothing out gives the same result as one that rules out nearly all."""
    texts = [f"posted by user{k % 7} in the main forum\nown line number of {chr(97 + k)} {chr(98 + k)} {chr(99 + k)}" for k in range(12)]
    rows = [(k, t) for k, t in enumerate([*texts, None, "", "one\n", texts[0]])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    sparse = sorted(map(tuple, line_templates.dedup(table).collect()))
    monkeypatch.setattr(line_templates, "FILTER_BITS", 6)
    assert sorted(map(tuple, line_templates.dedup(table).collect())) == sparse
    assert [r[2] for r in sparse] == [len(t.split("\n")) if t else 0 for _, t in rows]
    assert sum(r[3] for r in sparse) > 0


def test_busy_leaf_with_wordy_fields(spark):
    words = [f"{a}{b}{c}{d}" for a in "bcdfghklmn" for b in "aeiouyjqvx" for c in "aeioubcdfghklmnprstvwzxyjq" for d in "aeioubcdfghklmnprstvwzxyjq"]
    codes = defaultdict(list)
    for w, h in zip(words, word_hashes(" ".join(words).encode()).tolist(), strict=True):
        codes[h & 0xFFFF].append(w)
    names = [c[:3] for c in codes.values() if len(c) >= 3]  # one-off values of the same 16 bits
    say = lambda name, place: f"Posted by user {name} in {place} for all of the people"
    once = [say(names[i][j], names[5 + j][i]) for i in range(3) for j in range(3)]
    # values that recur in three documents each, in pairs that don't
    again = [say(words[k % 300], words[300 + (k + k // 300) % 300]) for k in range(900)]
    for lines in (once, again):
        assert len(set(lines)) == len(lines)
        got = line_templates.dedup(spark.createDataFrame([(k, t) for k, t in enumerate(lines)] * 2, "doc_id long, text string")).collect()
        assert sorted({r.doc_id for r in got if r.text}) == [0]


def vector_rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(25, 16))
    rows = [(None, [1.0] * 16), (1, None), (2, []), (3, [0.0] * 16), (4, [float("nan")] + [1.0] * 15), (5, [float("inf")] + [1.0] * 15), (6, [None] + [1.0] * 15), (7, [1.0, 2.0]), (8, [2.0, 4.0]), (9, [1e-200] * 16), (10, [5.0] * 16)]
    for k in range(11, 260):
        v = base[rng.integers(len(base))] * rng.uniform(0.5, 3) + rng.normal(size=16) * rng.choice([0, 0.1, 0.25, 0.4])
        rows.append((k, [float(x) for x in v]))
    return rows + [(300 + i, rows[20][1]) for i in range(60)]


def test_grid_order(spark):
    rows = vector_rows()
    table = spark.createDataFrame([(k, v, 1, "b", 2) for k, v in rows], "vec_id long, embedding array<double>, label int, block string, dim int")
    fine = [(k, np.asarray(v) / np.abs(v).max()) for k, v in rows if k is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for i, (a, x) in enumerate(fine) for b, y in fine[i + 1 :] if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95]
    comp, n = classes([k for k, _ in rows if k is not None], links), Counter(k for e in links for k in e)
    assert len(links) > 2000
    for size in (2048, 40):
        got = grid_order.near_duplicates(table, size=size).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_links, r.component_id, r.kept) == ((n[r.vec_id], comp[r.vec_id], comp[r.vec_id] == r.vec_id) if r.vec_id is not None else (0, None, True)), r
    assert grid_order.near_duplicates(table.limit(0)).count() == 0
    assert grid_order.near_duplicates(table.where("vec_id = 3")).collect()[0].n_links == 0


def test_distant_intervals_are_skipped():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(size=(300, 4)) * 0.05 + [1, 0, 0, 0], rng.normal(size=(300, 4)) * 0.05 + [0, 1, 0, 0]))
    x /= np.linalg.norm(x, axis=1)[:, None]
    eps = np.sqrt(2 - 2 * 0.95)
    want = x @ x.T >= 0.95
    for same in (False, True):
        got = np.zeros((len(x), len(x)), dtype=bool)
        met = 0
        for a, b, linked in grid_order.join_intervals(x, x, x, x, eps, 0.95, same, leaf=16):
            got[a, b] |= linked
            met += linked.size
        assert (got == (np.triu(want, 1) if same else want)).all() and met < 0.6 * want.size


def test_pipeline_stages(spark):
    rng = random.Random(9)
    words = "the river ran down to the old town where people met and talked about work food and weather all day long until night".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = []
    for k in range(60):
        body = "\n".join(say(30) for _ in range(4))
        docs.append((k, body + ("\nThis notice is on every page of the site." if k % 2 else ""), "en", f"s{k % 3}", 0))
    docs += [(100, docs[0][1], "en", "s0", 0), (101, docs[2][1] + " end", "en", "s1", 0), (102, "junk%%% " * 80, "en", "s0", 0), (103, None, None, None, None), (104, " ".join(w + "###" for w in say(90).split()), "en", "s2", 0)]
    now = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    stage = dict(corpus_pipeline.STAGES)
    kept = stage["quality rules"](spark, now, "")
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {d[0] for d in docs} - {102, 103, 104}
    assert kept.columns == corpus_pipeline.COLUMNS
    lean = stage["line dedup"](spark, kept, "").collect()
    assert sum("This notice" in r.text for r in lean) == 1 and {r.doc_id for r in lean} >= set(range(60))
    near = stage["MinHash near-dedup"](spark, kept, "").collect()
    left = {r.doc_id: sets(r.text) for r in near}
    assert 0 in left and 100 not in left and 2 in left and 101 not in left
    mixed = Counter(r.doc_id for r in stage["mixing sources to target weights"](spark, kept, "").collect())
    assert set(mixed.values()) <= {1, 2} and set(mixed) <= ids
    assert sum(mixed.values()) > len(ids)
    out = stage["best-fit packing"](spark, kept, "").collect()
    assert {r.doc_id for r in out} == ids and max(r.offset + r.length for r in out) <= 1024


def test_stages_on_odd_rows(spark):
    """Repeated rows, nulls in any column, clashing extra columns and empty tables, stage by stage."""
    long = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    a, b = long("a"), long("b")
    rows = [(3, a, "en", "s", 5), (5, a, "en", "s", 5), (5, b, "en", "s", 5), (5, b, "en", "s", 5), (None, a, None, None, None), (None, a, None, None, None), (9, None, None, None, None), (10, "", "en", "s", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    now = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], schema + ", kept int, text_key int, epochs string").repartition(3)
    stage = dict(corpus_pipeline.STAGES)
    near = Counter((r.doc_id, r.text) for r in stage["MinHash near-dedup"](spark, now, "").collect())
    assert near == {(3, a): 1, (5, b): 1, (None, a): 2, (9, None): 1, (10, ""): 1}
    mixed = Counter((r.doc_id, r.text) for r in stage["mixing sources to target weights"](spark, now, "").collect())
    assert set(mixed) <= {(r[0], r[1]) for r in rows} and sum(n for (_, t), n in mixed.items() if t) in range(8, 11)
    assert all(n <= 2 * sum(r[:2] == k for r in rows) for k, n in mixed.items())
    lines = Counter((r.doc_id, r.text) for r in stage["line dedup"](spark, now, "").collect())
    assert lines == Counter((r[0], r[1]) for r in rows)
    kept = stage["quality rules"](spark, now, "").collect()
    assert Counter(r.doc_id for r in kept) == {3: 1, 5: 3, None: 2}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, now.limit(0), "")
        assert out.count() == 0 and (out.columns == corpus_pipeline.COLUMNS or name == "best-fit packing")


def test_pipeline_run(spark):
    """run() from end to end over a small table, against the stages one by one and sums that must hold."""
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by) <= 1.05 * sum(r.length for r in out) / 1024 + 1  # a small table has few short pieces to fill up with
