"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The field is trained on a small labelled table (sentences of ``pii_table.txt`` and those that ``labelled`` makes), and decoded by Viterbi in
numpy over batches of segments. It is trained on the segments of the table with the words around them, as decoding sees them. A word of letters alone is always outside (a constraint of the model), so the chain parts exactly at such words:
segments are the runs of other words that hold a digit, an @, or (at) or [at]. What tells a card, an address or a number of another
kind (check digit, parts up to 255, how many digits) is a feature; the field decides. Its spans are added where the patterns left room,
without the marks at their ends. Words and context are read whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, slices, whole_text

KINDS = ("email", "ip", "card", "phone")
LABELS = ("out", *KINDS)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a digit run is tried from its first digit only: later ones would fail alike
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@]|\(at\)|\[at\]")
_SPACE = re.compile(r"\s")


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    return (sum(odd) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ so that long words cost their length once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    return out


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, sorted."""
    found = [(a, 0, b) for a, b in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m[0].split("."))]
    found += [(m.start(), 2, m.end()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found)


#: The written sentences count as often beside the made ones.
TIMES = 4

_AT = re.compile(r"\(at\)|\[at\]")
_LEAD, _TAIL = re.compile(r"^[^\w+(]+"), re.compile(r"[^\w)]+$")


def bare(word: str) -> tuple[int, int]:
    """Where the word starts and ends without the marks around it."""
    lead = _LEAD.match(word)
    tail = _TAIL.search(word)
    a, b = lead.end() if lead else 0, tail.start() if tail else len(word)
    return (a, b) if a < b else (0, len(word))


def shape(word: str) -> str:
    """Letters to x or X (runs as one), digits to d with the run's length up to 5, (at) and [at] to @, other marks as they are."""
    s = re.sub(r"[^\W\d_]+", lambda m: "X" if m[0][0].isupper() else "x", _AT.sub("@", word))
    return re.sub(r"[0-9]+", lambda m: f"d{min(5, len(m[0]))}", s)


def octets(word: str) -> bool:
    """Four numbers of at most 255 in a row, a port after them or not."""
    m = re.fullmatch(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?::[0-9]+)?", word)
    return bool(m) and all(int(x) <= 255 for x in m.groups())


def checked(digits: list[str], pure: list[bool]) -> set[int]:
    """Places of words of digits, one or some in a row, whose 14 to 19 digits end with a right check digit."""
    found: set[int] = set()
    for i in range(len(digits)):
        joined = ""
        for j in range(i, len(digits)):
            joined += digits[j]
            if not pure[j] or len(joined) > 19:
                break
            if len(joined) >= 14 and luhn(joined):
                found |= set(range(i, j + 1))
    return found


#: Feature of a word that is always outside.
OUTSIDE = "outside"


def runs(dial: list[bool], plus: list[bool], count: list[int]) -> list[int]:
    """Digits of each word and of the words around it that could be dialled with it: a + begins a number. Each end is that of the
    neighbour or the word's own, so a text of numbers costs its length once."""
    n = len(dial)
    first, last, sums = list(range(n)), list(range(n)), [0]
    for t in range(n):
        sums.append(sums[-1] + count[t])
        if t and dial[t - 1] and not plus[t]:
            first[t] = first[t - 1]
    for t in range(n - 2, -1, -1):
        if dial[t + 1] and not plus[t + 1]:
            last[t] = last[t + 1]
    return [sums[b + 1] - sums[a] for a, b in zip(first, last, strict=True)]


def features(words: list[str], before: str, after: str) -> list[list[str]]:
    """Of each word: its shape and those around it, its ends, its digits and those of the run it is in, and the word before the segment."""
    cut = [w[slice(*bare(w))] for w in words]
    digits = [_digits(w) for w in cut]
    pure = [bool(d) and re.fullmatch(r"[0-9-]+", w) is not None for d, w in zip(digits, cut, strict=True)]
    good = checked(digits, pure)
    dial = [re.fullmatch(r"[+().0-9-]+", w) is not None for w in cut]
    run = runs([d and not octets(w) for d, w in zip(dial, cut, strict=True)], [w.startswith("+") for w in cut], list(map(len, digits)))
    cue = before.strip(".,:;!?()\"'").lower()
    shapes = [shape(before), *map(shape, cut), shape(after)]
    rows = []
    for t, (p, s, n) in enumerate(zip(shapes, shapes[1:], shapes[2:], strict=False)):
        if not _TRIGGER.search(words[t]):
            rows.append([OUTSIDE] * 10)
            continue
        facts = f"{t in good} {octets(cut[t])} {pure[t]}"
        rows.append([f"w{s}", f"b{p} {s[:2]}", f"a{n} {s[-2:]}", f"h{s[:2]}", f"t{s[-2:]}", f"c{p[:2]} {s[:3]}", f"f{facts}", f"r{min(20, run[t])} {s}", f"n{min(20, len(digits[t]))} {facts}", f"q{cue} {s[:1]}"])
    return rows


def written() -> list[tuple[list[str], list[int]]]:
    """The sentences of ``pii_table.txt``: words, each with the number of its label; [kind words] marks what is personal."""
    out = []
    for line in Path(__file__).with_name("pii_table.txt").read_text().splitlines():
        words, labels, now = [], [], 0
        for w in line.split(" "):
            if w[1:] in KINDS and w[0] == "[":
                now = LABELS.index(w[1:])
                continue
            ends = now and w.endswith("]")
            words.append(w[:-1] if ends else w)
            labels.append(now)
            now = 0 if ends else now
        out.append((words, labels))
    return out


def examples(table: list[tuple[list[str], list[int]]]) -> list[tuple[list[str], list[int], str, str]]:
    """The segments of labelled sentences, with the words around them: what decoding sees."""
    out = []
    for words, labels in table:
        at, number = 0, {}
        for i, w in enumerate(words):
            number[at] = i
            at += len(w) + 1
        for places, before, after in segments(" ".join(words)):
            own = [number[a] for a, _ in places]
            out.append(([words[i] for i in own], [labels[i] for i in own], before, after))
    return out


def labelled(seed: int = 5, rows: int = 900) -> list[tuple[list[str], list[int]]]:
    """The labelled table: sentences of words, each with the number of its label. Invented, from forms and a seed: what is personal, and
    what looks like it (dates, amounts, versions, digests, card numbers with a wrong check digit, addresses with parts over 255)."""
    rng = np.random.default_rng(seed)
    num = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda: "".join(rng.choice(list("abeilmnorst"), rng.integers(2, 8)))
    hexed = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    pick = lambda *x: x[int(rng.integers(len(x)))]

    def card(good: bool) -> str:
        head = num(15)
        last = next(c for c in "0123456789" if luhn(head + c))
        return head + (last if good else str((int(last) + int(rng.integers(1, 10))) % 10))

    def fours(c: str, sep: str) -> str:
        return sep.join(c[i : i + 4] for i in range(0, 16, 4))

    small = lambda: ".".join(str(x) for x in rng.integers(0, 256, 4))
    forms = {
        "email": [lambda: f"{word()}.{num(2)}@{word()}.com", lambda: f"{word()}@{word()}{num(1)}.example.org", lambda: f"{word()}(at){word()}.com", lambda: f"{word()}[at]{word()}.org", lambda: f"{word()}.{word()}(at){word()}.net", lambda: f"{word()}_{num(2)}[at]{word()}-{word()}.co.uk"],
        "ip": [small, small, lambda: f"{small()}:{num(4)}"],
        "card": [lambda: card(True), lambda: fours(card(True), " "), lambda: fours(card(True), "-")],
        "phone": [lambda: f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"+{num(2)} {num(3)} {num(4)} {num(3)}", lambda: f"+{num(2)} {num(2)} {num(4)} {num(4)}", lambda: f"+{num(11)}"],
        "out": [
            lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: num(2) + ".", lambda: f"{num(1)}.{num(1)}.", lambda: num(5), lambda: f"${num(3)},{num(3)}",
            lambda: f"{word()}-{num(3)}", lambda: f"{word()}={num(12)}", lambda: f"@{word()}", lambda: f"{num(1)}.{num(2)}", lambda: f"{num(3)}-{num(3)}", lambda: card(False), lambda: card(False),
            lambda: fours(card(False), " "), lambda: fours(card(False), "-"), lambda: f'"{hexed(40)}"', lambda: hexed(32), lambda: f"{rng.integers(256, 999)}.{num(2)}.{num(3)}.{num(1)}",
            lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: num(int(rng.integers(6, 14))), lambda: f"{num(3)}-{num(1)}-{num(3)}-{num(5)}-{num(1)}", lambda: "(at)", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"+{num(2)}%", lambda: f"({num(4)})", lambda: f"{num(2)} {num(3)} {num(3)}",
            lambda: f"[{num(2)}]", lambda: f"{num(4)}-{num(4)}", lambda: f"{word()}@{word()}", lambda: f"{num(2)}.{num(3)}.{num(3)},{num(2)}",
        ],
    }
    out = []
    for i in range(rows):
        words, labels = [], []
        # one thing, or two in a row: neighbours must not run into each other
        for kind in (LABELS[i % len(LABELS)], *((pick(*LABELS),) if rng.random() < 0.35 else ())):
            own = pick(*forms[kind])().split(" ")
            if rng.random() < 0.35:
                own[-1] += pick(".", ",", "!!", ";", "***", "###", '"')
            left, right = ([word() for _ in range(int(rng.integers(0, 3)))] for _ in range(2))
            words += [*left, *own, *right]
            labels += [0] * len(left) + [LABELS.index(kind)] * len(own) + [0] * len(right)
        out.append((words, labels))
    return out


class Field:
    """Weights of features x labels and of label pairs; label 0 stands at both ends."""

    def __init__(self, number: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.number, self.emit, self.step = number, emit, step

    def ids(self, words: list[str], before: str, after: str) -> np.ndarray:
        none = len(self.number)
        return np.array([[self.number.get(f, none) for f in row] for row in features(words, before, after)])

    def decode(self, segments: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi, over all segments of one length at once."""
        out: list = [None] * len(segments)
        by: dict[int, list[int]] = {}
        for i, s in enumerate(segments):
            by.setdefault(len(s), []).append(i)
        for length, rows in by.items():
            for cut in range(0, len(rows), max(1, 200_000 // length)):
                own = rows[cut : cut + max(1, 200_000 // length)]
                score = self.emit[np.stack([segments[i] for i in own])].sum(2)  # rows x words x labels
                best, back = score[:, 0] + self.step[0], []
                for t in range(1, length):
                    path = best[:, :, None] + self.step
                    back.append(path.argmax(1))
                    best = path.max(1) + score[:, t]
                labels = [(best + self.step[:, 0]).argmax(1)]
                for b in reversed(back):
                    labels.append(b[np.arange(len(own)), labels[-1]])
                for i, row in zip(own, np.stack(labels[::-1], 1), strict=True):
                    out[i] = row
        return out


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def fit_field(sentences: list[tuple[list[str], list[int]]], epochs: int = 100, rate: float = 0.1, l2: float = 0.02) -> Field:
    """Gradient of the log-likelihood by forward and backward sums over the padded segments of the table, steps by Adam."""
    table, number = examples(sentences), {}
    for words, _, before, after in table:
        for row in features(words, before, after):
            for f in row:
                number.setdefault(f, len(number))
    n, k, longest = len(table), len(LABELS), max(len(w) for w, *_ in table)
    field = Field(number, np.zeros((len(number) + 1, k)), np.zeros((k, k)))
    width = len(features(["a"], "", "")[0])
    ids, truth, on = np.full((n, longest, width), len(number)), np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (words, labels, before, after) in enumerate(table):
        ids[i, : len(words)], truth[i, : len(words)], on[i, : len(words)] = field.ids(words, before, after), labels, True
    flat = ids.reshape(-1)
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (field.emit, field.step)]
    for epoch in range(1, epochs + 1):
        score = field.emit[ids].sum(2)
        score[~on] = [0, *[-1e4] * (k - 1)]  # padding is outside
        forward, backward = [score[:, 0] + field.step[0]], [np.zeros((n, k)) + field.step[:, 0]]
        for t in range(1, longest):
            forward.append(_logsum(forward[-1][:, :, None] + field.step, 1) + score[:, t])
            backward.append(_logsum(field.step + (score[:, longest - t] + backward[-1])[:, None, :], 2))
        backward = backward[::-1]
        total = _logsum(forward[-1] + field.step[:, 0], 1)
        grad_emit, grad_step = -l2 * field.emit, -l2 * field.step
        p = np.exp(np.stack(forward, 1) + np.stack(backward, 1) - total[:, None, None])
        gap = np.repeat(((np.eye(k)[truth] - p) * on[:, :, None] / n).reshape(-1, k), width, axis=0)
        grad_emit += np.stack([np.bincount(flat, gap[:, c], len(grad_emit)) for c in range(k)], 1)
        for t in range(longest):
            if t:
                pair = np.exp(forward[t - 1][:, :, None] + field.step + (score[:, t] + backward[t])[:, None, :] - total[:, None, None])
                pair[np.arange(n), truth[:, t - 1], truth[:, t]] -= 1
                grad_step -= (pair * on[:, t, None, None]).sum(0) / n
        grad_emit[-1] = 0
        for w, g, (m, v) in zip((field.emit, field.step), (grad_emit, grad_step), moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-8)
    # the constraint: words of letters alone, which no segment holds
    number[OUTSIDE] = len(number)
    field.emit = np.vstack([field.emit[:-1], [0.0, *[-100.0] * (k - 1)], np.zeros(k)])
    return field


@cache
def trained() -> Field:
    return fit_field(labelled() + TIMES * written())


def segments(text: str) -> list[tuple[list[tuple[int, int]], str, str]]:
    """Runs of words that hold a digit, an @, or (at) or [at]: their places, and the words before and after."""
    out, end = [], 0
    m = _TRIGGER.search(text)
    while m:
        start = m.start()
        while start > end and not text[start - 1].isspace():
            start -= 1
        stop = _SPACE.search(text, m.end())
        stop = stop.start() if stop else len(text)
        if out and out[-1][-1][1] < start and text[out[-1][-1][1] : start].isspace():
            out[-1].append((start, stop))
        else:
            out.append([(start, stop)])
        end = stop
        m = _TRIGGER.search(text, end)
    found = []
    for places in out:
        a, b = places[0][0], places[-1][1]
        found.append((places, _before(text, a), _after(text, b)))
    return found


def _before(text: str, a: int) -> str:
    """The whole word before place ``a``."""
    while a and text[a - 1].isspace():
        a -= 1
    start = a
    while start and not text[start - 1].isspace():
        start -= 1
    return text[start:a]


_WORD = re.compile(r"\S+")


def _after(text: str, b: int) -> str:
    m = _WORD.search(text, b)
    return m[0] if m else ""


def pieces(words: list[str], labels: list[int]) -> Iterator[tuple[int, int, int]]:
    """(kind, first, last) of the runs of one label. Addresses are a word each, a card ends with 14 digits or more, a + begins a number."""
    at = 0
    while at < len(labels):
        kind, last, n = labels[at], at, len(_digits(words[at]))
        while last + 1 < len(labels) and labels[last + 1] == kind and ((kind == 3 and n < 14) or (kind == 4 and not words[last + 1].startswith("+"))):
            last += 1
            n += len(_digits(words[last]))
        if kind:
            yield kind - 1, at, last
        at = last + 1


def find(texts: list[str], field: Field, base: list[list[tuple[int, int, int]]] | None = None) -> list[list[tuple[int, int, int]]]:
    """Per text (start, kind, end): the patterns' spans, and the field's beside them."""
    found = [list(x) for x in base] if base is not None else [patterns(t) if _TRIGGER.search(t) else [] for t in texts]
    owners, rows = [], []
    for i, t in enumerate(texts):
        if _TRIGGER.search(t):
            for places, before, after in segments(t):
                words = [t[a:b] for a, b in places]
                owners.append((i, places, words))
                rows.append(field.ids(words, before, after))
    for (i, places, words), labels in zip(owners, field.decode(rows), strict=True):
        for kind, first, last in pieces(words, labels.tolist()):
            a, b = places[first][0] + bare(words[first])[0], places[last][0] + bare(words[last])[1]
            if not any(x < b and a < y for x, _, y in found[i]):
                found[i].append((a, kind, b))
    return [sorted(x) for x in found]


def scan_pii(docs: DataFrame, field: Field | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans.

    The counts and the digest are of the fixed patterns; spans (kind:start:end in code points, end exclusive, by start,
    then kind) are of all. With ``keep`` the columns kept and ``masked`` (the text with every span as <KIND>) come
    instead of the digests. Null text counts as empty (and stays null when masked); rows that repeat are scanned each;
    other columns are ignored; an empty table gives no rows. No shuffle.
    """
    field = field or trained()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c) for c in keep or () if c != "doc_id"), whole_text().alias("_text"))
    names = own.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (s for b in batches for s in slices(b, "_text")):
            texts = part.column("_text").to_pylist()
            base = [patterns(t) if _TRIGGER.search(t) else [] for t in texts]
            spans, kept = find(texts, field, base), [part.column(n) for n in names]
            if keep is not None:
                yield pa.RecordBatch.from_arrays([*kept, pa.array(map(mask, texts, spans), pa.string())], names=[*names, "masked"])
                continue
            say = lambda found: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
            counts = [pa.array([sum(k == j for _, k, _ in x) for x in base], pa.int64()) for j in range(len(KINDS))]
            digest = pa.array([hashlib.sha256(say(x).encode()).hexdigest() for x in base], pa.string())
            yield pa.RecordBatch.from_arrays([*kept, *counts, digest, pa.array(map(say, spans), pa.string()), pa.array(map(len, spans), pa.int64())], names=[*names, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])
        release()

    types = dict(own.dtypes)
    ddl = ", ".join(f"`{n}` {types[n]}" for n in names)
    ddl += ", masked string" if keep is not None else ", " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long"
    return own.mapInArrow(run, ddl)


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, last = [], 0
    for a, k, b in spans:
        if b > last:
            out += [text[last:a], f"<{KINDS[k].upper()}>"] if a >= last else []
            last = b
    return "".join([*out, text[last:]])
