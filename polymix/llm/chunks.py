"""Byte-pair tokenizers of the ``tokenizers`` library, applied to each distinct chunk of a batch once.

Both vocabularies cut a text before any merge, and never across the places where ``split`` cuts here, so the ids of
a text are the ids of its chunks in order. A table of chunks already seen, bounded in bytes, lasts as long as its task.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import release

#: Between two characters that are not white space, before a single space: no token crosses it.
_SAFE = re.compile(r"(?<=\S)(?= \S)")
#: Without the dotted capital I, whose lower case holds a mark.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
#: Latin letters, then ASCII marks but the apostrophe: no token crosses from the letters to the marks.
_WORD = f"^(?P<word>[{_LETTERS}]+)(?P<marks>[!-&(-/:-@\\[-`{{-~]*)$"
#: Bytes that an entry of a table takes besides its characters and ids, with the hash table made of it for each batch.
ENTRY = 50
#: Words or texts in one call of the library, which holds what it found for all of them at once.
AT_ONCE = 1024


def _taken(source: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries ``at`` of a table, in a row, and their sizes; entry k is the k-th run of ``source``, ``size[k]`` long."""
    n = size[at]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if max(total, len(source)) < 1 << 31 else np.int64
    where = np.repeat(((np.cumsum(size) - size)[at] - ends + n).astype(kind), n)
    where += np.arange(total, dtype=kind)
    return source[where], n


def _sums(n: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``n`` between cuts."""
    return np.diff(np.concatenate([[0], np.cumsum(n)])[cuts])


def _held(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Entries in a row, and their sizes."""
    return np.frombuffer(b"".join(parts), "<u2"), np.fromiter(map(len, parts), np.int64, len(parts)) // 2


class Seen:
    """Distinct strings and their ids, in columns: an entry takes some tens of bytes, and Arrow looks a batch's strings up."""

    def __init__(self):
        self.keys, self.source, self.size, self.odd = pa.array([], pa.string()), np.zeros(0, "<u2"), np.zeros(0, np.int64), np.zeros(0, bool)

    def codes(self, strings: list[pa.StringArray]) -> tuple[np.ndarray, pa.StringArray]:
        """Which entry each string is, in the order given, and the strings that are new: ``add`` must get their ids next."""
        n = len(self.keys)
        coded = pa.chunked_array([self.keys, *strings]).combine_chunks().dictionary_encode()
        self.keys = coded.dictionary
        return coded.indices.to_numpy()[n:].astype(np.int64), self.keys.slice(n)

    def add(self, source: np.ndarray, size: np.ndarray, odd: np.ndarray | None = None) -> None:
        self.source, self.size = np.concatenate([self.source, source]), np.concatenate([self.size, size])
        self.odd = np.concatenate([self.odd, np.zeros(len(size), bool) if odd is None else odd])

    @property
    def nbytes(self) -> int:
        return self.keys.nbytes + self.source.nbytes + ENTRY * len(self.keys)


class ChunkTokenizer:
    """Ids are unsigned 16-bit integers. ``spaced`` tells whether a space belongs to the word after it (byte-level vocabulary) or is dropped.

    A text is cut at its spaces, each new chunk at its line ends, a line into a word and the marks after it; each new
    word and run of marks goes to the library.
    """

    def __init__(self, path: str, spaced: bool, most: int = 48_000_000):
        # a task has one core; the library's own threads would each hold memory for good
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        if self.inner.get_vocab_size() > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        self.spaced, self.most = spaced, most
        self.plain = f"^{' ' if spaced else ''}[{_LETTERS}]+$"
        self.clear()
        # a plain word's ids start with the token of its space, or end with a token that closes a word
        self.edge = np.zeros(1 << 16, bool)
        for token, i in self.inner.get_vocab(with_added_tokens=False).items():
            self.edge[i] = token.startswith("Ġ") if spaced else token.endswith("</w>")

    def clear(self) -> None:
        self.chunks, self.words = Seen(), Seen()

    def _ids(self, chunks: list[str]) -> list[bytes]:
        # the fast variant gives the same ids without offsets
        parts = (chunks[i : i + AT_ONCE] for i in range(0, len(chunks), AT_ONCE))
        return [array("H", x.ids).tobytes() for p in parts for x in self.inner.encode_batch_fast(p, add_special_tokens=False)]

    def _words(self, words: list[str], at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words (each with its space, where it has one), and how many: many words a text, told apart by their edges."""
        out, sizes = [np.zeros(0, "<u2")], [np.zeros(0, np.int64)]
        between = "" if self.spaced else " "
        for k in range(0, len(words), AT_ONCE):
            parts = [words[i : i + at_once] for i in range(k, min(k + AT_ONCE, len(words)), at_once)]
            for part, x in zip(parts, self.inner.encode_batch_fast([between.join(p) for p in parts], add_special_tokens=False), strict=True):
                ids = np.array(x.ids, "<u2")
                at = np.flatnonzero(self.edge[ids]) + (not self.spaced)
                if len(at) == len(part):
                    size = np.diff(np.append(at, len(ids)) if self.spaced else np.insert(at, 0, 0))
                else:  # a letter that becomes several, for one
                    ids, size = _held(self._ids(part))
                out.append(ids)
                sizes.append(size)
        return np.concatenate(out), np.concatenate(sizes)

    def _look(self, strings: list[pa.StringArray]) -> np.ndarray:
        """Entries in the table of words of strings, each taken as a text of its own."""
        at, new = self.words.codes(strings)
        plain = pc.match_substring_regex(new, self.plain).to_numpy(zero_copy_only=False)
        source, size = self._words(new.filter(pa.array(plain)).to_pylist())
        others, n = _held(self._ids(new.filter(pa.array(~plain)).to_pylist()))
        order = np.argsort(np.argsort(~plain, kind="stable"), kind="stable")
        self.words.add(*_taken(np.concatenate([source, others]), np.concatenate([size, n]), order))
        return at

    def _table(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of new chunks in a row, how many each has, and which are odd: those by which a text is cut at the safe
        places only."""
        lines = pc.split_pattern(chunks, "\n")
        cuts = lines.offsets.to_numpy().astype(np.int64)
        line = lines.flatten()
        parted = pc.extract_regex(line, _WORD)
        fits = parted.is_valid().to_numpy(zero_copy_only=False)
        word, marks = pc.struct_field(parted, "word"), pc.fill_null(pc.struct_field(parted, "marks"), "")
        odd = np.zeros(len(chunks), bool)
        if self.spaced:
            whole = np.flatnonzero(_sums(~fits, cuts) > 0)
            texts = chunks.take(pa.array(whole)).to_pylist()
            odd[whole] = [not x or x[0].isspace() or x[-1].isspace() for x in texts]
            lead = np.zeros(len(line), bool)
            lead[cuts[:-1]] = True
            word = pc.if_else(pa.array(lead), pc.binary_join_element_wise(" ", word, ""), word)
            # a chunk with a line that is no word and marks is one entry
            inside = np.repeat(np.isin(np.arange(len(chunks)), whole), np.diff(cuts))
            keep = ~inside | lead
            of_lead = np.full(len(chunks), "", object)
            of_lead[whole] = ["" if o else " " + x for o, x in zip(odd[whole], texts, strict=True)]
            word = pc.if_else(pa.array(inside), pa.array(np.repeat(of_lead, np.diff(cuts)), pa.string()), word)
            marks = pc.if_else(pa.array(inside), "", marks)
            word, marks, lead = word.filter(pa.array(keep)), marks.filter(pa.array(keep)), lead[keep]
            cuts = np.concatenate([[0], np.cumsum(_sums(keep, cuts))])
        else:
            word = pc.if_else(pa.array(fits), pc.ascii_lower(word), line)
            lead = np.ones(len(line), bool)
        at = self._look([pa.array(["", "\n"]), word, marks])
        at = np.stack([np.where(lead, at[0], at[1]), at[2 : 2 + len(lead)], at[2 + len(lead) :]], 1).reshape(-1)
        source, n = _taken(self.words.source, self.words.size, at)
        return source, _sums(n, 3 * cuts), odd

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's ids begin (and the last one's end)."""
        lists = pc.split_pattern(texts, " ")
        cuts = lists.offsets.to_numpy().astype(np.int64)
        cuts -= cuts[0]
        if self.chunks.nbytes + self.words.nbytes > self.most:
            self.clear()
        chunks = lists.flatten()
        at, new = self.chunks.codes([chunks])
        self.chunks.add(*self._table(new))
        source, size, odd = self.chunks.source, self.chunks.size, self.chunks.odd
        if self.spaced and len(texts):
            # a text's first chunk has no space before it: an entry of its own; of an odd text it is the whole text
            odd = _sums(odd[at], cuts) > 0
            firsts = chunks.take(pa.array(cuts[:-1])).to_pylist()
            known = dict(zip(u := list(set(firsts)), self._ids(u), strict=True))
            heads = [b"".join(self._ids(_SAFE.split(texts[i].as_py()))) if o else known[x] for i, (x, o) in enumerate(zip(firsts, odd, strict=True))]
            at[np.repeat(odd, np.diff(cuts))] = len(size) + len(heads)
            at[cuts[:-1]] = len(size) + np.arange(len(heads))
            more, n = _held(heads)
            source, size = np.concatenate([source, more]), np.concatenate([size, n, [0]])
        ids, n = _taken(source, size, at)
        return ids, np.concatenate([[0], np.cumsum(n)])[cuts]


@contextmanager
def chunk_tokenizer(path: str, spaced: bool, most: int = 48_000_000) -> Iterator[ChunkTokenizer]:
    """For one task: opening the vocabulary takes a quarter of a second, keeping it would hold a worker's memory for good."""
    encoder = ChunkTokenizer(path, spaced, most)
    try:
        yield encoder
    finally:
        encoder.clear()
        del encoder
        release()
