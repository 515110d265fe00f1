"""Quality rules: counts of words and symbols, and bands of n-gram perplexity for each language.

The model is an interpolated modified Kneser-Ney model of characters, of order 4. Every gram
of every document has its place in it, but only reference text is counted: the documents that pass the base
rules and have at most one symbol in ten words. With all documents counted junk is as likely as clean text
(figures in the README). Words of a web corpus are too many for word n-grams within the disk that a scan may use; a
character model sees odd symbols, broken words and wrong scripts, and repetition is a rule of its own.
Counting and smoothing are Spark aggregates and joins. The finished log-probabilities lie in sorted hash
arrays; they go to the tasks in blocks of a bounded number of rows, so a model of any size is scored,
block after block, in bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import ship_package
from .shared import mix, store, word_hashes

ORDER = 4
LEAST_WORDS, MOST_REPEAT = 50, 50
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    data = text.encode("utf-8", "replace")
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = (raw != 32) & ((raw < 9) | (raw > 13)) & ((raw & 0xC0) != 0x80)
    words = word_hashes(data)
    lines = [line for line in data.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    repeated = 0
    if len(words) >= 4:
        with np.errstate(over="ignore"):
            three = mix(mix(words[:-2] * np.uint64(3) + words[1:-1]) * np.uint64(5) + words[2:])
        _, at, n = np.unique(three, return_inverse=True, return_counts=True)
        twice = n[at] >= 2
        covered = np.zeros(len(words), dtype=bool)
        for k in range(3):
            covered[k : k + len(twice)] |= twice
        repeated = int(covered.sum())
    return len(words), int(inside.sum()), int(_SYMBOL[raw].sum()), len(lines) - len(set(lines)), repeated


def is_reference(text: str) -> bool:
    words, _, symbols, _, repeated = base_counts(text)
    return words >= LEAST_WORDS and 100 * repeated <= MOST_REPEAT * words and 10 * symbols <= words


def grams(text: str) -> np.ndarray:
    """One packed ORDER-gram for each character, from a padded start; digits are one character, white space another."""
    code = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    code = np.where((code >= 48) & (code <= 57), 48, np.where(code <= 32, 32, code ^ (code >> 16))).astype(np.uint64) & np.uint64(0xFFFF)
    code = np.concatenate((np.zeros(ORDER - 1, dtype=np.uint64), code))
    n = len(code) - ORDER + 1
    out = code[:n].copy()
    for k in range(1, ORDER):
        out = out << np.uint64(16) | code[k : k + n]
    return out


def count_grams(docs: DataFrame, most_chars: int = 2_000_000) -> DataFrame:
    """Stored (lang, gram, n) over all texts, n being its count in reference text; lang '' for null. A task sends the distinct grams of every `most_chars` characters, not characters, and holds no more."""
    ship_package(docs.sparkSession)

    def counted(by: dict[tuple[str, bool], list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (lang, counts), found in by.items():
            key, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key), pa.string()), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64) * counts)], ["lang", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple[str, bool], list[np.ndarray]] = {}
        held = 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if t := text.as_py():
                    by.setdefault((lang, is_reference(t)), []).append(grams(t))
                    held += len(t)
                if held > most_chars:
                    yield from counted(by)
                    by, held = {}, 0
        yield from counted(by)

    each = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.col("text").cast("string")).mapInArrow(run, "lang string, gram long, n long")
    return store(each.groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def _discounts(level: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: modified Kneser-Ney discounts from the counts of counts; 0.5, 0.75, 0.9 where these don't give any."""
    n = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    y = F.try_divide("n1", F.col("n1") + 2 * F.col("n2"))
    given = level.groupBy("lang").agg(*n)
    raw = [k - (k + 1) * y * F.try_divide(f"n{k + 1}", f"n{k}") for k in (1, 2, 3)]
    fine = F.least(F.col("n1"), F.col("n2"), F.col("n3"), F.col("n4")) > 0
    return given.select("lang", *[F.when(fine & (d > 0) & (d < k), d).otherwise(F.lit(rest)).alias(f"d{k}") for k, d, rest in zip((1, 2, 3), raw, (0.5, 0.75, 0.9), strict=True)])


def _smooth(level: DataFrame, lower: DataFrame | None, order: int) -> DataFrame:
    """(lang, gram, p) of one order: discounted counts plus what was taken, spread by the order below."""
    taken = F.when(F.col("n") == 0, F.lit(0.0)).when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    given = store(_discounts(level))  # a row for each language: stored, so the planner sees its size and carries it to the rows
    rows = level.join(given, "lang").select("lang", "gram", "n", taken.alias("d"), F.shiftrightunsigned("gram", 16).alias("context"))
    sums = rows.groupBy("lang", "context").agg(F.sum("n").cast("double").alias("total"), F.sum("d").alias("mass"), F.count(F.lit(1)).alias("kinds"))
    p = rows.join(sums, ["lang", "context"])
    own, back = F.coalesce(F.try_divide(F.col("n") - F.col("d"), F.col("total")), F.lit(0.0)), F.coalesce(F.try_divide("mass", "total"), F.lit(1.0))
    if lower is None:
        return p.select("lang", "gram", (own + back / F.col("kinds")).alias("p"))
    below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
    p = p.withColumn("suffix", F.col("gram").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1)))
    return p.join(below, ["lang", "suffix"]).select("lang", "gram", (own + back * F.col("q")).alias("p"))


def model(counts: DataFrame) -> DataFrame:
    """Stored (lang, gram, logp) for every gram counted; orders below the highest use the number of distinct characters before a gram in reference text; a gram without any gets what the orders below give."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = store(levels[k + 1].groupBy("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1)).alias("gram")).agg(F.sum((F.col("n") > 0).cast("long")).alias("n")))
    p = None
    for k in range(1, ORDER + 1):
        p = store(_smooth(levels[k], p, k))
    return p.select("lang", "gram", F.log("p").cast("float").alias("logp"))


def _blocks(probs: DataFrame, most_rows: int) -> list:
    """Broadcasts of {lang: (sorted grams, logp)}, each of about `most_rows` rows at most, fetched one by one."""
    spark, rows = probs.sparkSession, probs.count()
    many = max(1, -(-rows // most_rows))
    out = []
    for i in range(many):
        part = probs.where(F.pmod(F.xxhash64("gram"), F.lit(many)) == i).toArrow()
        lang = np.asarray(part.column("lang").dictionary_encode().combine_chunks().indices) if part.num_rows else np.empty(0, int)
        names = part.column("lang").dictionary_encode().combine_chunks().dictionary.to_pylist() if part.num_rows else []
        gram, logp = part.column("gram").to_numpy().view(np.uint64), part.column("logp").to_numpy()
        del part
        held = {}
        for k, name in enumerate(names):
            own = np.flatnonzero(lang == k)
            own = own[np.argsort(gram[own])]
            held[name] = (gram[own], logp[own])
        out.append(spark.sparkContext.broadcast(held))
    return out


def measure(docs: DataFrame, most_rows: int = 2_000_000, carry: bool = False) -> DataFrame:
    """Stored doc_id, lang, the base counts and surprise (mean negative log-probability of a character; null without text) for all documents; the whole row as `row` if asked to carry it."""
    blocks = _blocks(model(count_grams(docs)), most_rows)
    names = ["doc_id", "lang", *BASE, "surprise"] + ["row"] * carry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = blocks[0].value if len(blocks) == 1 else None
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(2)
            sums = np.zeros(len(langs))
            for b in blocks:
                held = one if one is not None else b.value
                for i, lang in enumerate(langs):
                    t = texts[i].as_py()
                    if t and lang in held:
                        key, logp = held[lang]
                        want = grams(t)
                        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
                        sums[i] += np.where(key[at] == want, logp[at], np.float32(0)).sum(dtype=np.float64)
                if one is None:
                    del held
                    b.__dict__.pop("_value", None)  # the worker reads it from its disk again for the next batch
            base = [base_counts(t.as_py()) for t in texts]
            score = [-s / len(t.as_py()) if t.as_py() else None for s, t in zip(sums, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array([x[k] for x in base], pa.int64()) for k in range(5)], pa.array(score, pa.float64()), *batch.columns[3:]], names)

    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), lang.alias("lang"), F.col("text").cast("string"), *[F.struct("*").alias("row")] * carry)
    kind = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in BASE) + ", surprise double"
    return store(rows.mapInArrow(run, kind + (f", row {rows.schema['row'].dataType.simpleString()}" if carry else "")))


def _middle(bins: DataFrame) -> DataFrame:
    """(lang, middle): the median bin of each language, from (lang, bin, n)."""
    upto = Window.partitionBy("lang").orderBy("bin")
    every = Window.partitionBy("lang")
    return bins.select("lang", "bin", F.sum("n").over(upto).alias("c"), F.sum("n").over(every).alias("all")).where("2 * c >= all").groupBy("lang").agg(F.min("bin").alias("middle"))


def bands(scores: DataFrame, below: float, above: float, least: float, step: float = 0.001) -> DataFrame:
    """(lang, low, high): median less `below` and plus `above` times the median deviation (`least` at least) of the language's surprise.

    Medians are exact to `step`, from a histogram: as many rows as there are steps, not documents.
    """
    bins = scores.where("surprise is not null").groupBy("lang", F.round(F.col("surprise") / step).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = store(bins)
    middle = store(_middle(bins))
    off = bins.join(middle, "lang").groupBy("lang", F.abs(F.col("bin") - F.col("middle")).alias("bin")).agg(F.sum("n").alias("n"))
    spread = _middle(off).select("lang", F.greatest(F.col("middle") * step, F.lit(least)).alias("mad"))
    return middle.join(spread, "lang").select("lang", (F.col("middle") * step - below * F.col("mad")).alias("low"), (F.col("middle") * step + above * F.col("mad")).alias("high"))


def base_failed(least_words: int = LEAST_WORDS, most_repeat: int = MOST_REPEAT) -> Column:
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))


def judge(docs: DataFrame, below: float = 12.0, above: float = 35.0, least: float = 0.02, most_langs: int = 10_000, carry: bool = False) -> DataFrame:
    """doc_id, lang, the base counts, base_failed, surprise, low, high, kept for all documents (and `row`, if asked to carry it).

    A document is kept if it doesn't fail the base rules and its surprise lies within its language's
    band, which is taken over the documents that pass the base rules. A null or empty text has no words and
    fails; a null lang is a language of its own ('' in the result). Repeated rows and null ids are rows like
    others; an empty table gives no rows; other columns are not read.
    """
    seen = measure(docs, carry=carry).withColumn("base_failed", base_failed())
    limits = store(bands(seen.where("not base_failed"), below, above, least))
    limits = F.broadcast(limits) if limits.count() <= most_langs else limits
    kept = ~F.col("base_failed") & F.coalesce(F.col("surprise").between(F.col("low"), F.col("high")), F.lit(True))
    return seen.join(limits, "lang", "left").withColumn("kept", kept)
