"""Fill-in-middle documents by a streaming matcher that passes over a text twice.

A text's units are runs of Latin letters and single other characters. The first pass counts them; the second advances a
lazy iterator of matches to the unit where the prefix ends and on to the one where the middle ends. Only an iterator and a
number are held beside the text, whatever its length. Where to cut and which form to write are functions of a hash of the
document's id, so every run and every retry gives the same output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
#: Marks before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def count_units(text: str) -> int:
    return sum(1 for _ in UNIT.finditer(text))


def unit_ends(text: str, first: int, second: int) -> tuple[int, int]:
    """Where the first `first` units end and where the first `second` of them do (first <= second), in code points."""
    matches = UNIT.finditer(text)
    a = next(islice(matches, first - 1, None)).end() if first else 0
    b = next(islice(matches, second - first - 1, None)).end() if second > first else a
    return a, b


def _hashes(seed: str, key: Column) -> list[Column]:
    """Unsigned integers of the first four groups of 8 digits of a sha256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """id_col, n long (units), form string, prefix_chars long, middle_chars long, output string.

    Form `plain` is the text itself; `psm` is PREFIX prefix SUFFIX suffix MIDDLE middle; `spm` is SUFFIX suffix PREFIX
    prefix MIDDLE middle. Of 100 hash values, `percent` give another form than plain, and of those `spm_percent` in 100
    give spm. Texts that are empty or contain a mark are plain, so restored() is exact for all.

    A null text counts as empty; a null id hashes as an empty one and stays null; rows that share an id and a text give
    equal rows. Other columns of docs are not read. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h1, h2, h3, h4 = _hashes(seed, F.col("id"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (h3 % 100 >= percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("id", "text", form.alias("form"), h1.alias("h1"), h2.alias("h2"))

    def cut(text: str, form: str, h1: int, h2: int) -> tuple[int, int | None, int | None, str]:
        n = count_units(text)
        if form == "plain":
            return n, None, None, text
        a, b = unit_ends(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
        prefix, middle, suffix = text[:a], text[a:b], text[b:]
        head = (PREFIX, prefix, SUFFIX, suffix) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix)
        return n, a, b - a, "".join((*head, MIDDLE, middle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            size = begin = 0
            columns = [batch.column(k) for k in range(1, 5)]
            for k, values in enumerate(zip(*columns, strict=True)):
                held.append(cut(*(v.as_py() for v in values)))
                size += len(held[-1][3])
                if size > 1 << 22 or k == len(batch) - 1:
                    n, a, m, text = zip(*held, strict=True)
                    long = lambda x: pa.array(x, pa.int64())
                    part = slice(begin, k + 1)
                    yield pa.RecordBatch.from_arrays([batch.column(0)[part], long(n), batch.column(2)[part], long(a), long(m), pa.array(text, pa.string())], ["id", "n", "form", "prefix_chars", "middle_chars", "output"])
                    held, size, begin = [], 0, k + 1

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("id", id_col)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that an output of fill_in_middle was made from. No mark is in the text, and none can arise where a part
    of it meets a mark, because a mark has its `<` at its start only; so the first of each is the mark."""
    o = F.col(output)
    at = {mark: F.locate(mark, o) for mark in (PREFIX, SUFFIX, MIDDLE)}
    between = lambda a, b: F.substring(o, at[a] + len(a), at[b] - at[a] - len(a))
    after = F.substring(o, at[MIDDLE] + len(MIDDLE), F.length(o))
    psm = F.concat(between(PREFIX, SUFFIX), after, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after, between(SUFFIX, PREFIX))
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(o)
