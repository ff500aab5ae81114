"""Exact histogram of encoded lengths, and what follows from it for every context limit.

Texts are encoded by a public byte-level vocabulary (a file of ranks whose path
is a parameter) and only their lengths leave the task; Spark adds the lengths
up to a histogram.  Prefix and suffix sums over it answer, for every limit L
that is a length of some document: documents and tokens up to L, documents
beyond it, and the tokens left if every document is cut at L.  Between two such
limits the truncated total grows by one token per longer document, so ``answers``
is exact for any limit.

Nulls and empty texts have length 0.  An empty table gives an empty histogram.
Repeated rows count each.  Special-token strings in a text are ordinary text.  Long texts
are encoded in parts, cut where the pattern ends a piece in any case; a run of more than ``RUN``
blanks or line breaks, on which the encoder's pattern would run out of stack, is one piece by the
pattern's own rule and goes to the encoder without it.  A part is longer only if a single word is.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ludomill.session import settle

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the split pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Texts are encoded in parts of about this many characters, cut where the pattern always splits.
PART = 1 << 16
RUN = 1 << 10
# White space as the pattern has it.
_BLANK = "\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_BLANK}]{{{RUN},}}")
# Ends of a piece whatever comes before: the end of a word, of letters before other signs, between ASCII letters and digits.
_END = re.compile(rf"(?<=[^{_BLANK}])(?=[{_BLANK}])|(?<=[^\W\d_])(?=[\W_])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
# Lengths are summed in blocks of this many.
BLOCK = 4096


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("documents", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _in_parts(text: str, at: int, end: int, encode) -> int:
    total = 0
    while at < end:
        cut = end
        if end - at > PART:
            found = _END.search(text, at + PART, end)
            cut = found.start() if found else end
        total += len(encode(text[at:cut]))
        at = cut
    return total


def encoded_length(text: str, encoder) -> int:
    """Tokens of a text; see the top of this module for long ones."""
    encode = encoder.encode_ordinary
    if len(text) <= RUN:
        return len(encode(text))
    total, at = 0, 0
    for run in _RUN.finditer(text):
        # The last blank of a run belongs to what follows.
        end = run.end() if run.end() == len(text) else run.end() - 1
        total += _in_parts(text, at, run.start(), encode)
        total += len(encoder._encode_single_piece(text[run.start() : end]))
        at = end
    return total + _in_parts(text, at, len(text), encode)


def with_lengths(docs: DataFrame, vocabulary: str = VOCABULARY, column: str = "n_tokens") -> DataFrame:
    """``docs`` with the encoded length of ``text``."""

    @F.pandas_udf("long")
    def lengths(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoding(vocabulary)
        for texts in batches:
            yield pd.Series([encoded_length(t, encoder) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(column, lengths("text"))


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens, n_docs."""
    return with_lengths(docs.select("text"), vocabulary).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limit_table(histogram: DataFrame) -> DataFrame:
    """For every length: docs and tokens up to it, docs beyond, the truncated total, and the share of docs up to it."""
    rows = settle(histogram).withColumn("_block", F.floor(F.col("n_tokens") / BLOCK))
    rows = rows.withColumn("_tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = rows.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum("_tokens").alias("_t"))
    ahead = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(ahead), F.lit(0)).alias("_d0"),
        F.coalesce(F.sum("_t").over(ahead), F.lit(0)).alias("_t0"),
        F.sum("_d").over(whole).alias("_docs"),
    )
    so_far = Window.partitionBy("_block").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(blocks, "_block")
        .withColumn("docs_within", F.col("_d0") + F.sum("n_docs").over(so_far))
        .withColumn("tokens_within", F.col("_t0") + F.sum("_tokens").over(so_far))
        .withColumn("docs_beyond", F.col("_docs") - F.col("docs_within"))
        .select(
            "n_tokens",
            "n_docs",
            "docs_within",
            "tokens_within",
            "docs_beyond",
            (F.col("tokens_within") + F.col("docs_beyond") * F.col("n_tokens")).alias("truncated_total"),
            (F.col("docs_within") / F.col("_docs")).alias("quantile"),
        )
    )


def answers(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each of the given context limits: documents that fit, and the tokens left if all are cut at it."""
    each = [
        F.struct(
            F.lit(limit).cast("long").alias("max_tokens"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_docs"))), F.lit(0)).alias("docs_within"),
            F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_total"),
        )
        for limit in limits
    ]
    return histogram.agg(F.array(*each).alias("a")).select(F.inline("a"))
