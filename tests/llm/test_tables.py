"""Shards, mix, packing, token counts, licences and urls against plain Python over small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from equipoise.llm import encode, licences, mixing, packing, shards, token_counts, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, range int, bucket string, length int, key string"
TEXTS = [None, "", " ", "one", "a b c d", "same text here", "same text here", "same text here", "x " * 3000, "é ü 漢字\n\n  two  spaces ", "tail space "]
ROWS = [(i if i != 3 else None, t, None if i == 4 else "en", None if i % 5 == 0 else f"s{i % 3}", 1, 7, "b", 9, "k") for i, t in enumerate(TEXTS)] * 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def many(spark, n=3000):
    """A third of the rows one text of one source."""
    return spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot text " * 20)).otherwise(F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), (F.xxhash64("id") % 40 + 41).cast("int"))).alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("s"), (F.col("id") % 7).cast("string"))).alias("source"),
    )


def test_chunks_encode_as_the_tokenizer(tokenizer):
    def ids(enc, t):
        return [int.from_bytes(enc.encode(t)[i : i + 4], "little") for i in range(0, len(enc.encode(t)), 4)]

    enc = encode.ChunkEncoder(encode.read_tokenizer(None), most=3)
    assert not enc.whole
    marks = ["<|endoftext|> x", "foo <|endoftext|> bar", "a<|endoftext|>", "<|endoftext|><|endoftext|>  b\n", " <|endoftext|", "x<|endoftext|>y <|endoftext|>  z"]
    texts = [x for x in TEXTS if x] + marks + ["a\n b", "a \nb c", " lead", "x\t y z", "q\r\n\r\n w's don't", "a\u00a0 b \u00a0c", "n\0ul b", "a\u2003 b", "١٢ ab12 c!?", "👍 👍🏽 x"]
    rng = random.Random(2)
    texts += ["".join(rng.choice(["a", "the", " ", "  ", "\n", "\t", "é", "漢", "1", "23", "'s", "!", "\u00a0", "<|endoftext|>", "\0", "Ω"]) for _ in range(rng.randint(1, 40))) for _ in range(500)]
    for t in texts:
        assert ids(enc, t) == tokenizer.encode(t, add_special_tokens=False).ids, t
    ordinary = Tokenizer.from_str(tokenizer.to_str())
    ordinary.encode_special_tokens = True
    enc = encode.ChunkEncoder(encode.read_tokenizer(None), special_as_text=True)
    assert all(ids(enc, t) == ordinary.encode(t, add_special_tokens=False).ids for t in texts)
    other = public_tokenizers.path("word_bpe_49k.json")
    enc = encode.ChunkEncoder(encode.read_tokenizer(other))
    assert enc.whole and ids(enc, "A few Words. <|endoftext|>") == Tokenizer.from_file(other).encode("A few Words. <|endoftext|>", add_special_tokens=False).ids


def test_shards_equal_bytes_and_gapless_slots(spark, docs):
    for table in (docs, many(spark)):
        out = shards.shard(table).collect()
        source = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in table.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == source
        by = defaultdict(list)
        for r in out:
            by[r.shard].append(r)
        for rows in by.values():
            assert sorted(r.slot for r in rows) == list(range(len(rows)))
        share, largest = sum(r["size"] for r in out) / 40, max(r["size"] for r in out)
        assert all(abs(sum(r["size"] for r in by[k]) - share) <= largest for k in range(40))
    assert shards.shard(docs.limit(0)).count() == 0


def test_ranges_of_many_rows_are_cut(spark):
    """Ranges cut in steps of the key keep the order of keys: a text lies in one shard, or two that meet; only the hot one in more."""
    out = shards.shard(many(spark), shards=8, ranges_per_shard=1, range_rows=20).collect()
    by, where = defaultdict(list), defaultdict(set)
    for r in out:
        by[r.shard].append(r)
        where[r.text_crc32].add(r.shard)
    assert len(out) == 3000 and all(sorted(r.slot for r in rows) == list(range(len(rows))) for rows in by.values())
    share, largest = sum(r["size"] for r in out) / 8, max(r["size"] for r in out)
    assert all(abs(sum(r["size"] for r in by[k]) - share) <= largest for k in range(8))
    hot = zlib.crc32(("hot text " * 20).encode())
    assert all(max(s) - min(s) <= 1 for crc, s in where.items() if crc != hot)
    assert sorted(where[hot]) == list(range(min(where[hot]), max(where[hot]) + 1))


def fair(sizes, share=1.5, weights=(5, 2, 1), most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    got, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return got | {s: left * w[s] / total for s in open_}
        for s in over:
            got[s] = most * sizes[s]
        left -= sum(got[s] for s in over)
        open_ -= over
    return got


def test_mix_meets_targets(spark, docs):
    for table in (docs, many(spark)):
        out = mixing.mix(table).collect()
        rows = table.select("doc_id", "source", "text").collect()
        assert Counter((r.doc_id, r["size"]) for r in out) == Counter((r.doc_id, len(WORD.findall(r.text or ""))) for r in rows)
        sizes = Counter()
        for r in rows:
            sizes[r.source] += len(WORD.findall(r.text or ""))
        goal, taken, longest = fair(sizes), Counter(), Counter()
        for r in out:
            assert r.target == pytest.approx(goal[r.source]) and r.source_size == sizes[r.source]
            assert r.taken in (0, r["size"], 2 * r["size"])
            taken[r.source] += r.taken
            longest[r.source] = max(longest[r.source], r["size"])
        assert all(abs(taken[s] - goal[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(many(spark).repartition(7)).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in out}
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pieces_and_packing(spark, docs, tokenizer):
    for table in (docs, many(spark, 400)):
        out = packing.pack_documents(table, 64).collect()
        want = Counter()
        for r in table.collect():
            ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]
            first = len(ids) % 64 or 64
            cuts = [0, *range(first, len(ids), 64), len(ids)] if len(ids) > 64 else [0, len(ids)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                want[(r.doc_id, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b])))] += 1
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
        bins = defaultdict(list)
        for r in out:
            bins[r.sequence_id].append((r.offset, r.length))
        for parts in bins.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 64
        least = max(-(-sum(r.length for r in out) // 64), sum(r.length > 32 for r in out))
        assert len(bins) <= least * 1.05 + 2
    assert packing.pack_documents(docs.limit(0), 64).count() == 0


def test_fullest_is_the_best_subset():
    import itertools
    import random

    random.seed(5)
    for _ in range(60):
        items = [random.randint(1, 30) for _ in range(7)]
        room = random.randint(0, 70)
        best = max(sum(c) for k in range(8) for c in itertools.combinations(items, k) if sum(c) <= room)
        got = packing.fullest(dict(Counter(items)), room)
        assert sum(n * k for n, k in got.items()) == best and all(k <= Counter(items)[n] for n, k in got.items())


def test_length_histogram(docs, tokenizer):
    hist = token_counts.length_histogram(docs)
    lengths = [len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for r in docs.collect()]
    assert {r.length: r.n_docs for r in hist.collect()} == Counter(lengths)
    for r in token_counts.limits(hist, block=4).collect():
        assert r.truncated_tokens == sum(min(n, r.length) for n in lengths)
        assert (r.docs_ge, r.tokens_ge) == (sum(n >= r.length for n in lengths), sum(n for n in lengths if n >= r.length))
        assert r.quantile == pytest.approx(sum(n <= r.length for n in lengths) / len(lengths))
    assert token_counts.truncated_total(hist, 2) == sum(min(n, 2) for n in lengths)
    assert token_counts.quantile(hist, 0.5) == sorted(lengths)[(len(lengths) + 1) // 2 - 1]
    empty = token_counts.length_histogram(docs.limit(0))
    assert token_counts.limits(empty).count() == 0 and token_counts.truncated_total(empty, 9) == 0


def test_licences(spark):
    s = licences.SENTENCES
    wrapped = re.sub(r"(\S+ \S+ \S+) ", r"\1\n * ", " ".join(s[k] for k in ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")))
    cases = [
        (None, [], []), ("", [], []), ("Nothing of a licence here.", [], []),
        ("prose without an end\nLicensed under CC BY-NC 4.0.\nmore", ["CC-BY-NC-4.0"], []),
        ("Some words. Released under the MIT License. Released under the MIT License. All rights reserved.", ["MIT"], ["all-rights"]),
        ("/* " + wrapped + " */", ["MIT"], []),
        (" ".join(s[k] for k in ("apache-2-the", "apache-2-may-not", "apache-2-see")), ["Apache-2.0"], ["apache-2-see"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0-only"], []),
        ("lorem ipsum " * 20000 + "\nMIT License\n", ["MIT"], []),
    ]
    table = spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(cases)], "doc_id int, text string, licences string")
    got = {r.doc_id: r for r in licences.scan(table).collect()}
    for i, (_, want, rest) in enumerate(cases):
        assert (got[i].licences, got[i].unmatched_ids) == (want, rest), i
    assert licences.scan(table.limit(0)).count() == 0
    own = licences.scan(spark.createDataFrame([(1, "Well. You may share this freely. Ok."), (2, "share this")], "doc_id int, text string"), {"x": "You may share this freely."}, [("Share", ["x"])]).orderBy("doc_id").collect()
    assert [r.licences for r in own] == [["Share"], []]
    twice = licences.scan(table.where("doc_id = 3").union(table.where("doc_id = 3"))).collect()
    assert len(twice) == 2 and twice[0] == twice[1] == got[3]
    assert all(any(h in licences.normal_text(t) for h in licences.hints(map(licences.normal_text, s.values()))) for t in s.values())


def test_whole_notices(spark):
    """Notices as files carry them, with urls, names and comment marks around the known sentences."""
    notices = {
        "Apache-2.0": 'Copyright 2024 A. Writer\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\nSee the License for the specific language governing permissions and\nlimitations under the License.',
        "GPL-3.0-or-later": "a - does things\nCopyright (C) 2024 Some Body\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the\nGNU General Public License for more details.",
        "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Zlib": "(C) 2024 X\n\nThis software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:",
    }
    marks = [lambda t: t, lambda t: "/*\n" + "\n".join(" * " + x for x in t.split("\n")) + "\n */\nint x;", lambda t: "\n".join("# " + x for x in t.split("\n")) + "\nimport x", lambda t: t.replace("\n", "\r\n")]
    rows = [(name, mark(t)) for name, t in notices.items() for mark in marks]
    out = licences.scan(spark.createDataFrame(rows, "name string, text string").repartition(2)).collect()
    assert len(out) == len(rows) and all((r.licences, r.unmatched_ids) == ([r.name], []) for r in out), out


def test_every_known_sentence_and_rule_is_found(spark):
    s = licences.SENTENCES
    wrap = lambda t, n, by: re.sub(r"((?:\S+ ){%d})" % n, lambda m: m[0][:-1] + by, t)
    cases = [([k], None, t) for k, t in s.items()] + [(seq, name, "\n".join(s[k] for k in seq)) for name, seq in licences.RULES]
    forms = [lambda t: t, lambda t: wrap(t, 1, "\n"), lambda t: wrap(t, 4, "\r\n# "), lambda t: "Some Project\n\nCopyright (c) 2024 X\n\n" + wrap(t, 6, "\n") + "\n\nmore words here", lambda t: "What is this? " + t + " And more."]
    rows = [(i * 10 + j, form(t)) for i, (_, _, t) in enumerate(cases) for j, form in enumerate(forms) if j != 4 or t[-1] in ".;:"]
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, "doc_id int, text string").repartition(4)).collect()}
    for key, t in rows:
        ids, name, _ = cases[key // 10]
        assert got[key].sentence_ids == ids, (t, got[key])
        assert name is None or (got[key].licences, got[key].unmatched_ids) == ([name], []), (t, got[key])
    other = ["This program is free software you can redistribute it", "a " + s["mit-title-short"], "-" * 300_000 + "licence" + "\n \t" * 100_000 + "x"]
    assert all(r.sentence_ids == [] for r in licences.scan(spark.createDataFrame(list(enumerate(other)), "doc_id int, text string")).collect())


def judged(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fit, key=lambda x: len(x[0]), default=(None, None))


def test_urls(spark):
    urls = [None, "", "no-scheme.org/x", "http://", "http://A.Example.ORG/en/1", "https://example.org/en/2?q=/fr/", "http://b.com/fr/#x", "http://b.com/de/x", "http://org?x", "http://org/", "ftp://a://b/c", "http://x.net\n/a\nb", "http://Ü.com/fr/" + "y" * 5000]
    weights = url_filter.train(url_filter.default_labels(spark))
    table = spark.createDataFrame([(i, u, 3) for i, u in enumerate(urls)], "page_id long, url string, host int").repartition(2)
    for r in url_filter.judge(table, weights).collect():
        host, path, (rule, verdict) = judged(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.score >= 0.5 else "allow"))
    assert url_filter.judge(table.limit(0), weights).count() == 0
    assert url_filter.train(url_filter.default_labels(spark).limit(0), dims=8) == [0.0] * 9


def test_url_model_on_held_out_hosts(spark):
    rows = url_filter.labelled_urls()
    weights = url_filter.train(spark.createDataFrame([(u, b) for u, b, stem in rows if zlib.crc32(stem.encode()) % 4], "url string, block int"))
    held = spark.createDataFrame([(u, b) for u, b, stem in rows if not zlib.crc32(stem.encode()) % 4], "url string, block int")
    out = url_filter.judge(held, weights, rules=[]).collect()
    right = {b: [(r.verdict == "block") == b for r in out if r.block == b] for b in (0, 1)}
    assert all(len(x) > 100 for x in right.values())
    assert sum(right[0]) >= 0.95 * len(right[0]) and sum(right[1]) >= 0.6 * len(right[1]), {b: sum(x) / len(x) for b, x in right.items()}


def plain_features(url, dims):
    """The feature numbers from plain Python: the column hash is xxHash64 chained over marks and characters."""
    host, path, _ = judged(url)
    out = set()
    for mark, part in (("h", host), ("p", re.sub("[0-9]+", "0", path))):
        framed = "^" + part + "$"
        for n in (3, 4, 5):
            for i in range(len(framed) - n + 1 if len(framed) >= max(n, 3) else 0):
                h = 42
                for c in (mark, *framed[i : i + n]):
                    h = xxhash.xxh64_intdigest(c.encode(), seed=h)
                out.add((h - (1 << 64) if h >> 63 else h) % dims)
    return sorted(out)


def test_url_model_from_plain_descent(spark):
    dims, rounds, step, ridge = 64, 6, 2.0, 1e-4
    rows = [(u, b) for u, b, _ in url_filter.labelled_urls()][::23]
    table = spark.createDataFrame(rows, "url string, block int")
    host, path = url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))
    found = {r.url: sorted(r.f) for r in table.select("url", url_filter.features(host, path, dims).alias("f")).collect()}
    assert all(found[u] == plain_features(u, dims) for u, _ in rows)
    weights, ahead, momentum = [0.0] * (dims + 1), [0.0] * (dims + 1), 1.0
    for _ in range(rounds):
        slope = [0.0] * (dims + 1)
        for u, b in rows:
            root = math.sqrt(max(len(found[u]), 1))
            err = 1 / (1 + math.exp(-(sum(ahead[i] for i in found[u]) / root + ahead[-1]))) - b
            slope[-1] += err
            for i in found[u]:
                slope[i] += err / root
        after = [(1 - step * ridge) * a - step * g / len(rows) for a, g in zip(ahead, slope, strict=True)]
        momentum, last = (1 + math.sqrt(1 + 4 * momentum**2)) / 2, momentum
        ahead = [a + (last - 1) / momentum * (a - w) for a, w in zip(after, weights, strict=True)]
        weights = after
    assert url_filter.train(table, dims, rounds, step, step, ridge) == pytest.approx(weights, abs=1e-9)
    score = {r.url: r.score for r in url_filter.judge(table, weights, rules=[]).collect()}
    for u, _ in rows:
        assert score[u] == pytest.approx(1 / (1 + math.exp(-(sum(weights[i] for i in found[u]) / math.sqrt(len(found[u])) + weights[-1]))))
