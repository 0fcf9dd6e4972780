"""Secret scan by a trigram inverted index.

Each rule's regex is parsed into a Boolean query over the trigrams that any match must hold. A block of texts gets its
postings (trigram -> texts) in one pass over its bytes, for the trigrams that some rule asks for; intersecting and
uniting the postings gives each rule's candidates, and only these are searched with the regex. A rule without mandatory trigrams
scans every text. Blocks are as large as a batch, so the index of the table is the set of its blocks' indexes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, whole_text


@dataclass(frozen=True)
class Rule:
    """``accept`` decides on a match; a match that it drops is not tried again from within."""

    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = bool


def _long(group: int, least: int) -> Callable[[re.Match], bool]:
    return lambda m: len(m[group]) >= least


#: The base rules, in their order; ASCII letters of ``assign``'s words match in either case.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", _long(2, 8)),
    Rule("access", r"AKIA[A-Z0-9]+", _long(0, 16)),
    Rule("hex", r"[0-9a-f]+", _long(0, 32)),
)
#: Further well-known forms; their spans come on top.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# A query: True (any text), a trigram of bytes, ("and", ...) or ("or", ...)
Query = bool | bytes | tuple


def _both(parts: list[Query], word: str) -> Query:
    kept = list(dict.fromkeys(x for x in parts if x is not True))
    return True if not kept else kept[0] if len(kept) == 1 else (word, *kept)


def _any(parts: list[Query]) -> Query:
    return True if any(x is True for x in parts) else _both(parts, "or")


def trigram_query(pattern: str) -> Query:
    """What trigrams of UTF-8 bytes (ASCII letters folded to lower case) every match of ``pattern`` must hold."""
    fold = lambda c: chr(c).lower() if c < 128 else chr(c)  # noqa: E731  (patterns fold ASCII alone)

    def grams(strings: set[str]) -> Query:
        return _any([_both([b[i : i + 3] for i in range(len(b) - 2)], "and") for b in (s.encode() for s in sorted(strings))])

    def walk(items) -> tuple[set[str] | None, Query]:
        """The exact strings if they are few, and the query."""
        runs, query = {""}, []
        for op, arg in items:
            exact, inner = None, True
            if op is C.LITERAL:
                exact = {fold(arg)}
            elif op is C.SUBPATTERN:
                exact, inner = walk(arg[-1])
            elif op is C.BRANCH:
                found = [walk(x) for x in arg[1]]
                exact = set().union(*(e for e, _ in found)) if all(e is not None for e, _ in found) else None
                inner = _any([q if e is None else grams(e) for e, q in found])
            elif op is C.MAX_REPEAT:
                low, high, what = arg
                one, inner = walk(what)
                inner = inner if low else True
                if (low, high) == (0, 1) and one is not None:
                    exact = one | {""}
            elif op is C.IN and len(arg) <= 8 and all(o is C.LITERAL for o, _ in arg):
                exact = {fold(c) for _, c in arg}
            if exact is not None and len(exact) * len(runs) <= 64:
                runs = {a + b for a in runs for b in exact}
            else:
                query += [grams(runs), inner if exact is None else grams(exact)]
                runs = {""}
                exact = None
        if not query:
            return runs, True
        return None, _both([*query, grams(runs)], "and")

    exact, query = walk(parser.parse(pattern))
    return grams(exact) if exact is not None else query


def _grams(query: Query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set().union(*map(_grams, query[1:])) if isinstance(query, tuple) else set()


class Index:
    """Postings of a block of texts, for the given trigrams."""

    def __init__(self, grams: list[bytes]):
        self.number = {g: i for i, g in enumerate(grams)}
        self.lut = np.zeros(1 << 24, np.uint8)
        for g, i in self.number.items():
            a, b, c = g
            self.lut[a << 16 | b << 8 | c] = i + 1
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, texts: pa.StringArray) -> np.ndarray:
        """Boolean, trigrams x texts."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        found = np.zeros((len(self.number), len(texts)), bool)
        if not len(texts) or offsets[-1] - offsets[0] < 3:
            return found
        b = self.fold[np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]].astype(np.uint32)
        which = self.lut[b[:-2] << 16 | b[1:-1] << 8 | b[2:]]
        at = np.flatnonzero(which)
        own = offsets - offsets[0]
        doc = np.searchsorted(own, at, side="right") - 1
        whole = at + 3 <= own[doc + 1]  # not across two texts
        found[which[at[whole]] - 1, doc[whole]] = True
        return found

    def candidates(self, query: Query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if isinstance(query, bytes):
            return postings[self.number[query]]
        parts = [self.candidates(q, postings) for q in query[1:]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def scan_secrets(docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE) -> DataFrame:
    """Per document: doc_id, n_<kind> of each base rule, base_sha256, spans, n_spans.

    Spans are kind:start:end in code points, end exclusive, by start, then in the rules' order; a rule's matches are leftmost and
    don't overlap. Null text counts as empty and has none; rows that repeat are scanned each; other columns are ignored;
    an empty table gives no rows. No shuffle.
    """
    rules = (*base, *more)
    asked = [trigram_query(r.pattern) for r in rules]
    grams = sorted(set().union(*map(_grams, asked)))
    if len(grams) > 254:
        raise ValueError("more trigrams than the table numbers")
    names = ["doc_id", *(f"n_{r.kind}" for r in base), "base_sha256", "spans", "n_spans"]
    kinds = [pa.int64()] * (1 + len(base)) + [pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, patterns = Index(grams), [re.compile(r.pattern, re.ASCII) for r in rules]
        for part in (s for b in batches for s in slices(b, "text", 8_000_000)):
            texts = part.column("text")
            postings = index.postings(texts)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
            held = texts.to_pylist()
            for k, (rule, query, pattern) in enumerate(zip(rules, asked, patterns, strict=True)):
                for i in np.flatnonzero(index.candidates(query, postings)).tolist():
                    spans[i] += [(m.start(), k, m.end()) for m in pattern.finditer(held[i]) if rule.accept(m)]
            rows = []
            for doc_id, found in zip(part.column("doc_id").to_pylist(), spans, strict=True):
                found.sort()
                said = [f"{rules[k].kind}:{a}:{b}" for a, k, b in found]
                own = ",".join(s for s, (_, k, _) in zip(said, found, strict=True) if k < len(base))
                counts = [sum(k == j for _, k, _ in found) for j in range(len(base))]
                rows.append((doc_id, *counts, hashlib.sha256(own.encode()).hexdigest(), ",".join(said), len(found)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    ddl = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, kinds, strict=True))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, ddl)
