"""Source divergence audit: how the words of a source differ from those of its language.

A text is made into terms in one pass: ``bytes.translate`` lowers A-Z and blanks every
other ASCII character that is no letter, ``bytes.split`` cuts, and a ``Counter`` per
document gives its terms and their counts.  A task adds them up by (language, source) and
hands on sparse rows (language, source, term, documents, times); nothing dense is made.

Every language keeps the terms in at least ``LEAST`` of its documents, V of them, seen N
times.  A term seen c times in a group has the smoothed share p = 1 + floor(10^9 (c + 2) /
(N + 2 V)), the language likewise q, and f = floor((p - q)^2 / (p + q)).  All of it is whole
numbers.

A pair of sources is compared on all V terms without a dense vector: terms that neither has
give one constant, terms of one alone depend on its count only (a histogram of counts per
group), and only terms of both are joined.

Nulls in text, language and source are ''.  A group without terms has N = 0; a language
without kept terms has pairs of value 0 and no terms.  Repeated rows count as often as they
stand.  Other columns are not read.  An empty table gives an empty result.  A text is split
in blocks of a megabyte; a task holds the different terms of one text and at most ``HELD`` sums.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ludomill.session import settle

LEAST = 10
TOP = 10
# Sums of a task before they are handed on.
HELD = 1 << 18
BLOCK = 1 << 20

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123))
#: Letters lowered, bytes of longer characters as they are, all else blank.
TABLE = bytes(b if b > 127 else ord(chr(b).lower()) if b in _LETTERS else 32 for b in range(256))


def terms_of(text: bytes) -> Counter:
    """Terms of one text and how often they stand in it."""
    clean, seen, at = text.translate(TABLE), Counter(), 0
    while at < len(clean):
        end = len(clean)
        if end - at > BLOCK:
            end = clean.rfind(b" ", at, at + BLOCK) + 1 or clean.find(b" ", at + BLOCK) + 1 or end
        seen.update(clean[at:end].split())
        at = end
    return seen


_SUMS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("docs", pa.int64()), ("times", pa.int64())])


def _rows(sums: dict) -> Iterator[pa.RecordBatch]:
    for (lang, source), (docs, times) in sums.items():
        # The row without a term tells that the group occurs.
        terms = pa.array([None, *docs], pa.binary()).cast(pa.string())
        n = len(terms)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([lang] * n, pa.string()),
                pa.array([source] * n, pa.string()),
                terms,
                pa.array([0, *docs.values()], pa.int64()),
                pa.array([0, *(times[t] for t in docs)], pa.int64()),
            ],
            schema=_SUMS,
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            docs, times = sums.setdefault((lang, source), (Counter(), Counter()))
            seen = terms_of(text.as_py())
            held -= len(docs)
            docs.update(seen.keys())
            for term, n in seen.items():
                times[term] += n
            held += len(docs)
            if held > HELD:
                yield from _rows(sums)
                sums, held = {}, 0
    yield from _rows(sums)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, docs, times; a row with a null term for every group."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = rows.mapInArrow(_count, "lang string, source string, term string, docs long, times long")
    return found.groupBy("lang", "source", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("times"))


def share(times: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 (times + 2) / (total + 2 kept)), three digits at a time so that nothing overflows."""
    top, below = f"({times} + 2)", f"({total} + 2 * {kept})"
    one = f"{top} * 1000"
    two = f"({one} % {below}) * 1000"
    three = f"({two} % {below}) * 1000"
    return F.expr(f"1 + ({one} div {below}) * 1000000 + ({two} div {below}) * 1000 + ({three} div {below})")


def _apart(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def shares(counts: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Groups (lang, source, kept, zero, own), and terms (lang, source, term, p, q, zero).

    ``kept`` is V, ``own`` the number of kept terms the group has, ``zero`` its share of a term it does not have.
    """
    found = counts.filter("term is not null")
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("times").alias("in_lang"))
    kept = settle(kept.filter(F.col("docs") >= least).drop("docs"))
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("in_lang").alias("lang_total"))
    present = settle(found.join(kept, ["lang", "term"]).select("lang", "source", "term", "times", "in_lang"))
    totals = present.groupBy("lang", "source").agg(F.sum("times").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.na.fill(0, ["total", "own", "kept", "lang_total"])
    groups = settle(groups.withColumn("zero", F.when(F.col("kept") > 0, share("0L", "total", "kept"))))
    terms = present.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", share("times", "total", "kept").alias("p"), share("in_lang", "lang_total", "kept").alias("q"), "zero"
    )
    return groups.select("lang", "source", "kept", "zero", "own"), settle(terms)


def pair_values(groups: DataFrame, terms: DataFrame) -> DataFrame:
    """lang, source, item, value for each two sources of a language."""
    a = groups.select("lang", *[F.col(c).alias(f"{c}_a") for c in ("source", "zero", "own")], "kept")
    b = groups.select("lang", *[F.col(c).alias(f"{c}_b") for c in ("source", "zero", "own")])
    pairs = a.join(b, "lang").filter("source_a < source_b")
    # What the terms of one source add as if the other had none of them, from its histogram of shares.
    marks = terms.groupBy("lang", F.col("source").alias("source_a"), "p").agg(F.count(F.lit(1)).alias("m"))
    other = groups.filter("kept > 0").select("lang", F.col("source").alias("source_b"), F.col("zero").alias("zero_b"))
    alone = marks.join(other, "lang").filter("source_a <> source_b")
    alone = alone.groupBy("lang", F.least("source_a", "source_b").alias("source_a"), F.greatest("source_a", "source_b").alias("source_b")).agg(
        F.sum(F.expr(f"m * {_apart('p', 'zero_b')}")).alias("alone")
    )
    # What terms of both add instead.
    x = terms.select("lang", "term", *[F.col(c).alias(f"{c}_a") for c in ("source", "p", "zero")])
    y = terms.select("lang", "term", *[F.col(c).alias(f"{c}_b") for c in ("source", "p", "zero")])
    instead = f"{_apart('p_a', 'p_b')} - {_apart('p_a', 'zero_b')} - {_apart('zero_a', 'p_b')} + {_apart('zero_a', 'zero_b')}"
    both = x.join(y, ["lang", "term"]).filter("source_a < source_b")
    both = both.groupBy("lang", "source_a", "source_b").agg(F.sum(F.expr(instead)).alias("both"))
    joined = pairs.join(alone, ["lang", "source_a", "source_b"], "left").join(both, ["lang", "source_a", "source_b"], "left")
    neither = F.coalesce(F.expr(f"(kept - own_a - own_b) * {_apart('zero_a', 'zero_b')}"), F.lit(0))
    value = F.coalesce("alone", F.lit(0)) + F.coalesce("both", F.lit(0)) + neither
    found = joined.select("lang", value.alias("value"), F.col("source_a").alias("source"), F.col("source_b").alias("item"))
    sides = [F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("source", "item"), ("item", "source"))]
    return found.select("lang", "value", F.inline(F.array(*sides)))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank (from 1 by falling value, then item)."""
    counts = settle(term_counts(docs))
    groups, terms = shares(counts, least)
    window = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = settle(pair_values(groups, terms)).withColumn("rank", F.row_number().over(window))
    more = terms.filter("p > q").select("lang", "source", F.col("term").alias("item"), F.expr(_apart("p", "q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= top)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("part", F.lit("pair")).select(columns).union(more.withColumn("part", F.lit("term")).select(columns))
