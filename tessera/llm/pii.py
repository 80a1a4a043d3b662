"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns find emails, IP addresses, cards and phone numbers; what they find stays. The field then labels every word
with a digit or an @ in it. Its potentials are a word's shape, the labels of neighbouring words, and, on skip edges,
the labels of other words of the document that are the same or similar, however far apart: equal digits or lower-case
forms, digits that end in the same SUFFIX or are one digit's insertion, loss or change apart, addresses of one name. Loopy
belief propagation, with the words of pattern matches held at their label, makes mentions of one thing agree; words
that reach CONFIDENT outside of the patterns' matches become further spans.

Potentials are trained piecewise on the patterns' own labels: shapes, neighbours and skip pairs are counted over all
documents, in tables whose size the shapes bound. A word is chained to the latest one before it that is the same, or
else similar, so a document with n mentions has n - 1 skip edges.

Ties: of equally likely labels the first of LABELS counts, so a word in doubt stays out; spans of several kinds at one
place all stand, in the order of KINDS. All scans are linear in the text. Nulls and empty texts have no spans; a null id is kept; repeated rows get the same
spans each; very long texts are read whole; an empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import in_arrow

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", *KINDS)
CONFIDENT = 0.9
#: Digits at the end that make two numbers similar.
SUFFIX = 7
ROUNDS = 30

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# no match starts within a run of digits unless one starts at its beginning
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SIGN = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind's place in KINDS, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches of local@domain, found from the @ outwards, so that long runs without one cost nothing."""
    end = at = 0
    while (p := text.find("@", at)) >= 0:
        before = text[max(end, at) : p]
        start = p - (len(before) - len(before.rstrip(_LOCAL)))
        m = _DOMAIN.match(text, p + 1) if start < p else None
        if m:
            yield start, m.end()
            end = m.end()
        at = p + 1 if not m else m.end()


def pattern_spans(text: str) -> list[Span]:
    """Matches of the patterns that pass their check, by start and then kind."""
    found: list[Span] = []
    if not _SIGN.search(text):
        return found
    found += [(a, 0, b) for a, b in _emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


def words(text: str) -> list[tuple[int, int, int, str]]:
    """(place among the words, start, end, form) of the words with a digit or an @; form "" has no skip edges."""
    out = []
    for i, m in enumerate(_WORD.finditer(text)):
        w = m[0]
        if w.isalpha() or not _SIGN.search(w):
            continue
        digits = _NOT_DIGIT.sub("", w)
        out.append((i, m.start(), m.end(), w.lower().strip(".,;:!?()\"'") if "@" in w else digits if len(digits) >= 4 else ""))
    return out


def shape(w: str) -> int:
    """A word's looks as one of a fixed number of codes."""
    digits = _NOT_DIGIT.sub("", w)
    n = len(digits)
    size = 0 if n == 0 else 1 if n < 4 else 2 if n < 7 else 3 if n < 10 else 4 if n < 14 else 5 if n < 20 else 6
    parts = w.strip(".,;:!?()\"'").split(".")
    four = len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    code = size
    for flag in (size == 5 and luhn(digits), w.startswith("+"), w.startswith("("), "-" in w, four, bool(re.search("[A-Za-z]", w)), "@" in w, bool(re.search(r"@[A-Za-z0-9-]+\.", w))):
        code = code * 2 + flag
    return code


SHAPES = 7 << 8


def labels(found: list[tuple[int, int, int, str]], spans: list[Span]) -> list[int]:
    """Label of each word by the patterns' spans: the first in order that overlaps it."""
    out, at = [], 0
    for _, a, b, _ in found:
        while at < len(spans) and spans[at][2] <= a:
            at += 1
        # spans are in the order of their starts, so that no later one overlaps where this one begins behind the word
        out.append(spans[at][1] + 1 if at < len(spans) and spans[at][0] < b else 0)
    return out


def alike(form: str) -> list[str]:
    """Keys of a form: forms that share one are similar."""
    if "@" in form:
        return [form.partition("@")[0] + "@"]
    if len(form) < SUFFIX:
        return []
    # two strings are one insertion, loss or change apart where they share one of these
    near = [form, *(form[:i] + form[i + 1 :] for i in range(len(form)))] if SUFFIX < len(form) < 20 else [form]
    return [f"-{form[-SUFFIX:]}", *near]


def edges(found: list[tuple[int, int, int, str]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Pairs of neighbouring words, and pairs of a word and the latest before it of its form, or else of a similar one."""
    chain = [(i - 1, i) for i in range(1, len(found)) if found[i][0] == found[i - 1][0] + 1]
    last: dict[str, int] = {}
    near: dict[str, int] = {}
    skip = []
    for i, (_, _, _, form) in enumerate(found):
        if not form:
            continue
        if form in last:
            skip.append((last[form], i))
        else:
            keys = alike(form)
            before = max((near[k] for k in keys if k in near), default=-1)
            if before >= 0:
                skip.append((before, i))
        for k in alike(form) if form not in last else ():
            near[k] = i
        last[form] = i
    return chain, skip


class Field:
    """Log potentials: by shape and label, and by the labels of neighbours and of skip pairs."""

    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        share = unary.sum(axis=0) + 1.0
        share /= share.sum()
        # a shape that was seldom seen leans to the shares of all shapes
        self.unary = np.log((unary + share) / (unary.sum(axis=1, keepdims=True) + 1))
        self.chain = self._lift(chain + 0.5)
        # mentions of one form agree, unless the corpus says otherwise; the pseudo-counts say so where it is silent
        self.skip = self._lift(skip + skip.T + 0.5 + 10 * np.eye(len(LABELS)))

    @staticmethod
    def _lift(n: np.ndarray) -> np.ndarray:
        p = n / n.sum()
        return np.clip(np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True))), -4, 4)

    def marginals(self, shapes: list[int], fixed: list[int], chain: list[tuple[int, int]], skip: list[tuple[int, int]]) -> np.ndarray:
        """Loopy sum-product over the words of a document; fixed: a label to hold, or 0 for a free word."""
        n, k = len(shapes), len(LABELS)
        own = self.unary[shapes].copy()
        held = np.array(fixed)
        own[held > 0] = -30.0
        own[np.flatnonzero(held), held[held > 0]] = 0.0
        pairs = chain + skip
        if not pairs:
            m = own
        else:
            a, b = np.array(pairs).T
            power = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            power = np.concatenate([power, power.transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            sent = np.zeros((len(source), k))
            for _ in range(ROUNDS):
                m = own.copy()
                np.add.at(m, target, sent)
                s = (m[source] - sent[back])[:, :, None] + power
                top = s.max(axis=1)
                new = top + np.log(np.exp(s - top[:, None, :]).sum(axis=1))
                new -= new.max(axis=1, keepdims=True)
                change = np.abs(new - sent).max()
                sent = 0.5 * sent + 0.5 * new
                if change < 1e-4:
                    break
            m = own.copy()
            np.add.at(m, target, sent)
        p = np.exp(m - m.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def _trim(text: str, a: int, b: int, kind: int) -> tuple[int, int]:
    edge = re.compile(r"[A-Za-z0-9]") if kind == 0 else re.compile(r"[0-9+]")
    m = edge.search(text, a, b)
    if not m:
        return a, a
    a = m.start()
    while b > a and not (text[b - 1].isascii() and (text[b - 1].isdigit() or (kind == 0 and text[b - 1].isalpha()))):
        b -= 1
    return a, b


def _plausible(s: str, kind: int) -> bool:
    digits = len(_NOT_DIGIT.sub("", s))
    return (kind == 0 and "@" in s) or (kind == 1 and s.count(".") == 3 and digits >= 4) or (kind == 2 and 14 <= digits <= 19) or (kind == 3 and 7 <= digits <= 15)


def all_spans(text: str, field: Field, base: list[Span] | None = None) -> list[Span]:
    """The patterns' spans and those that the field adds, by start and then kind."""
    base = pattern_spans(text) if base is None else base
    if not _SIGN.search(text):
        return base
    found = words(text)
    shapes = [shape(text[a:b]) for _, a, b, _ in found]
    fixed = labels(found, base)
    chain, skip = edges(found)
    if not found or all(fixed):
        return base
    p = field.marginals(shapes, fixed, chain, skip)
    best = p.argmax(axis=1)
    added: list[list[int]] = []
    last = -2
    for i, (place, a, b, _) in enumerate(found):
        k = int(best[i])
        if fixed[i] or k == 0 or p[i, k] < CONFIDENT:
            continue
        a, b = _trim(text, a, b, k - 1)
        most = {2: 19, 3: 15}.get(k - 1, 0)
        if added and last == place - 1 and added[-1][1] == k - 1 and len(_NOT_DIGIT.sub("", text[added[-1][0] : b])) <= most:
            added[-1][2] = b
        else:
            added.append([a, k - 1, b])
        last = place
    taken = [tuple(s) for s in added if s[2] > s[0] and _plausible(text[s[0] : s[2]], s[1])]
    return sorted(base + taken)


def _counts(docs: DataFrame) -> DataFrame:
    """(table, code, n): how often shapes, neighbours and skip pairs have which labels."""
    k = len(LABELS)

    def run(batches):
        import pyarrow as pa

        count: Counter = Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                if not text or not _SIGN.search(text):
                    continue
                found = words(text)
                y = labels(found, pattern_spans(text))
                chain, skip = edges(found)
                count.update((0, shape(text[a:e]) * k + v) for (_, a, e, _), v in zip(found, y))
                count.update((1, y[i] * k + y[j]) for i, j in chain)
                count.update((2, y[i] * k + y[j]) for i, j in skip)
        cols = list(zip(*((t, c, n) for (t, c), n in count.items()))) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["part", "code", "n"])

    return in_arrow(docs.select("text"), run, "part int, code int, n bigint").groupBy("part", "code").agg(F.sum("n").alias("n"))


def trained(docs: DataFrame) -> Field:
    """Potentials from all documents; the driver sees (SHAPES + 2 * labels) * labels counts at most."""
    k = len(LABELS)
    tables = [np.zeros(SHAPES * k), np.zeros(k * k), np.zeros(k * k)]
    for r in _counts(docs).collect():
        tables[r["part"]][r["code"]] = r["n"]
    return Field(tables[0].reshape(SHAPES, k), tables[1].reshape(k, k), tables[2].reshape(k, k))


def _digest(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def found(docs: DataFrame) -> DataFrame:
    """doc_id, a count for each kind, base_sha256, spans and their number, for every document."""
    field = docs.sparkSession.sparkContext.broadcast(trained(docs))
    counts = [f"n_{k}" for k in KINDS]
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType)] + [T.StructField(c, T.LongType()) for c in counts] + [T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_spans", T.LongType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for text in b.column(1).to_pylist():
                base = pattern_spans(text or "")
                spans = all_spans(text or "", field.value, base)
                for c, v in zip(cols, [sum(s[1] == k for s in base) for k in range(4)] + [hashlib.sha256(_digest(base).encode()).hexdigest(), _digest(spans), len(spans)]):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()])], names=schema.names)

    return in_arrow(docs.select("doc_id", "text"), run, schema)


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; of overlapping spans the first covers."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with their columns, spans masked in text and n_chars following it where there is such a column."""
    field = docs.sparkSession.sparkContext.broadcast(trained(docs))
    names = docs.columns

    def run(batches):
        import pyarrow as pa

        for b in batches:
            cols = list(b.columns)
            at = names.index("text")
            texts = [t if t is None else masked(t, all_spans(t, field.value)) for t in cols[at].to_pylist()]
            cols[at] = pa.array(texts, cols[at].type)
            if "n_chars" in names:
                n = names.index("n_chars")
                cols[n] = pa.array([None if t is None else len(t) for t in texts], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return in_arrow(docs, run, docs.schema)
