"""Counts over whole texts, taken batch by batch in Arrow; used by the quality operators.

A null text counts as empty. Words are runs of bytes other than ASCII white space, which splitting UTF-8 at ASCII
white space gives exactly.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import in_arrow, text_bytes

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

FIELDS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_lower", "n_digits", "n_marks", "n_bars", "n_stops", "n_commas", "n_long_words", "n_one_char",
    "longest_line", "n_title",
)

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_HIGH_LEAD = re.compile(rb"[\xc3]([\x80-\xbf])")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    count = Counter(windows)
    covered = until = 0  # until: the first word not yet covered
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered += i + 3 - max(i, until)
            until = i + 3
    return covered


def counts(raw: bytes | None) -> tuple[int, ...]:
    """The values of FIELDS for one text."""
    raw = raw or b""
    words = raw.split()
    joined = b"".join(words)
    continuation = len(joined) - len(joined.decode("utf-8", "replace")) if not joined.isascii() else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    latin = _HIGH_LEAD.findall(joined) if continuation else ()
    upper = len(joined) - len(joined.translate(None, _UPPER)) + sum(x < b"\x9f" for x in latin)
    lower = len(joined) - len(joined.translate(None, _LOWER)) + sum(x >= b"\x9f" for x in latin)
    return (
        len(words), len(joined) - continuation, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)), upper, lower,
        len(joined) - len(joined.translate(None, b"0123456789")), joined.count(b"!"), joined.count(b"|"), joined.count(b"."), joined.count(b","), sum(len(w) > 24 for w in words), sum(len(w) == 1 for w in words),
        max(map(len, lines), default=0), sum(65 <= w[0] <= 90 for w in words),
    )


def with_counts(docs: DataFrame, prefix: str | None = None) -> DataFrame:
    """doc_id and FIELDS as longs, one row for each row of docs; with a prefix, all columns and FIELDS under it."""
    kept = docs.select("doc_id", "text") if prefix is None else docs
    out = [docs.schema["doc_id"]] if prefix is None else list(docs.schema)
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in out] + [T.StructField((prefix or "") + c, T.LongType()) for c in FIELDS])
    n = len(out)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = list(zip(*map(counts, text_bytes(b)))) or [()] * len(FIELDS)
            yield pa.RecordBatch.from_arrays(b.columns[:n] + [pa.array(x, pa.int64()) for x in found], names=schema.names)

    return in_arrow(kept, run, schema)
