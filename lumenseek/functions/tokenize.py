"""Code tokenizers as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The least length and the patterns below say what a token is.
#: Tokens of fewer characters are dropped.
MIN_LENGTH = 2


def _text(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def _tokens(runs: Column) -> Column:
    """In lower case, which is quick for tokens, since they are ASCII; for whole texts it would go character by character."""
    return F.transform(F.filter(runs, lambda t: F.length(t) >= MIN_LENGTH), F.lower)


def plain_tokens(text: Column | str) -> Column:
    """Runs of ASCII letters, digits and underscores, then in lower case; case and snake humps stay together."""
    # texts are divided between runs: the built-in that extracts all matches copies the text for each of them; \\W is the
    # complement of ASCII letters, digits and underscores, and much faster than that class written out
    return _tokens(F.split(_text(text), r"\W+"))


def identifier_tokens(text: Column | str) -> Column:
    """Identifiers and numbers, divided at underscores and before a capital that follows a small letter or digit."""
    # digits at the start of a run are a number of their own
    apart = F.regexp_replace(_text(text), "(?<![A-Za-z0-9_])([0-9]+)(?=[A-Za-z_])", "$1 ")
    humps = F.regexp_replace(apart, "([a-z0-9])([A-Z])", "$1 $2")
    return _tokens(F.split(humps, r"[\W_]+"))


def bpe_tokens(text: Column | str, tokenizer_path: str) -> Column:
    """Tokens of a byte-pair tokenizer file, in lower case, without its marks for spaces and those that are too short: a
    backend that can stand in for identifier_tokens()."""

    @F.pandas_udf("array<string>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)  # once per task
        for texts in batches:
            found = tokenizer.encode_batch(texts.tolist(), add_special_tokens=False)
            plain = [[t.replace("Ġ", "").replace("▁", "").replace("</w>", "").strip().lower() for t in e.tokens] for e in found]
            yield pd.Series([[t for t in x if len(t) >= MIN_LENGTH] for x in plain])

    return encode(_text(text))


def query_terms(text: Column | str) -> Column:
    """Distinct identifier tokens in the order of their first occurrence."""
    return F.array_distinct(identifier_tokens(text))


def idf_smoothed(n: Column, df: Column) -> Column:
    return F.log((n.cast("double") + 1.0) / (df.cast("double") + 1.0)) + F.lit(1.0)


def idf_probabilistic(n: Column, df: Column) -> Column:
    """The BM25 inverse document frequency that is never negative."""
    n, df = n.cast("double"), df.cast("double")
    return F.log((n - df + 0.5) / (df + 0.5) + 1.0)
