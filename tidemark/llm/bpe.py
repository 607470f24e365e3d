"""Byte-pair encoding with a compiled token automaton.

The merges of a byte-level BPE vocabulary are compiled into a deterministic automaton over tokens: it accepts a token
sequence exactly if that sequence is how BPE tokenises the bytes it spells. The automaton starts with one state and a
loop for each byte. Each merge (a, b) -> c adds a gadget, in the order of the merges:

* the state that `a` leads to loses its arc for `b` from now on, as `a b` no longer stays apart;
* wherever an arc for `a` is followed by one for `b`, an arc for `c` skips both; it leads to a copy of the state that
  `b` led to.

All arcs of one label lead to one state, so a state is named by the token that leads to it, and a copy is kept as a
reference to the copied state and the time of copying. Transitions are looked up in a table that fills as pairs occur.

Encoding reads a pre-split word from the left, follows the longest arc that the state has and the word's bytes spell,
and goes back where no arc fits; each word has one accepted path. Decoding emits the label of each arc.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

#: How a text is split before merging: contractions, letters, numbers, other signs, white space (fixed values of the vocabulary format).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries that each of the two generations of a worker's cache may hold.
CACHE_ENTRIES = 200_000
NEVER = 1 << 60


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class SplitEncoder:
    """Splits whole texts into words, remembers the ids of frequent words, and leaves the rest to word()."""

    def __init__(self, specials: dict[str, int]):
        self.specials = specials
        self.split = regex.compile(PRE_SPLIT).findall
        self.runs = regex.compile(r"\s \s|\s $|[\x1c-\x1f]").search
        self.special_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(specials, key=len, reverse=True)) + ")").split if specials else None
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.signs = {x: self.word(x.encode()) for x in ".,"}

    def word(self, word: bytes) -> tuple[int, ...]:
        raise NotImplementedError

    def join(self, found: Iterable[tuple[int, ...]]) -> tuple[int, ...]:
        return tuple(chain.from_iterable(found))

    def _words(self, text: str) -> tuple[int, ...]:
        return self.join([self.word(w.encode()) for w in self.split(text)])

    def _part(self, part: str) -> tuple[int, ...]:
        """The ids of a space and the part after it; parts seen lately are kept, in two generations."""
        if (found := self.young.get(part)) is not None:
            return found
        if (found := self.old.get(part)) is None:
            if part[-1:] in self.signs and part[:-1].isalpha():  # the sign stands alone: the word before it may be known
                return self._part(part[:-1]) + self.signs[part[-1]]
            found = self.word(b" " + part.encode()) if part.isalpha() else self._words(" " + part)
        if len(part) <= 64:
            if len(self.young) >= CACHE_ENTRIES:
                self.old, self.young = self.young, {}
            self.young[part] = found
        return found

    def _plain(self, text: str) -> tuple[int, ...]:
        if not text or self.runs(text):  # a space between other white space: parts would depend on their neighbours
            return self._words(text)
        first, *rest = text.split(" ")  # else the pre-split never joins what a space divides
        found = list(map(self.young.get, rest))
        if None in found:
            part = self._part
            found = [part(p) if x is None else x for p, x in zip(rest, found, strict=True)]
        return self.join([self._words(first), *found])

    def encode(self, text: str | None) -> tuple[int, ...]:
        """The ids of a whole text; the strings of special tokens in it become their ids."""
        if not text or self.special_split is None or not any(s in text for s in self.specials):
            return self._plain(text or "")
        return self.join([self.special(x) if x in self.specials else self._plain(x) for x in self.special_split(text)])

    def special(self, text: str) -> tuple[int, ...]:
        return (self.specials[text],)


class Automaton(SplitEncoder):
    """The token automaton of one vocabulary, with encoding and decoding."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], specials: dict[str, int] | None = None):
        signs = byte_signs()
        self.labels: dict[int, bytes] = {i: bytes(signs[c] for c in token) for token, i in vocab.items() if all(c in signs for c in token)}
        self.specials = specials or {}
        self.labels |= {i: text.encode() for text, i in self.specials.items()}
        self.byte_id = {self.labels[i]: i for i in self.labels if len(self.labels[i]) == 1 and i not in self.specials.values()}
        #: For each state: arcs it has lost, with the time; the state it was copied from, with the time; for each label: its left part.
        self.lost: dict[int, dict[int, int]] = {i: {} for i in self.byte_id.values()}
        self.copied: dict[int, tuple[int, int]] = {}
        self.left: dict[int, tuple[int, int]] = {}
        self.ids: dict[bytes, int] = dict(self.byte_id)
        for time, (a, b) in enumerate(merges):
            self._gadget(vocab[a], vocab[b], vocab[a + b], time)
        self.longest = max(map(len, self.ids), default=1)
        self.numbers = {i: str(i) for i in self.labels}
        self.table: dict[tuple[int, int], bool] = {}
        super().__init__(self.specials)

    @classmethod
    def of(cls, data: bytes) -> Automaton:
        """From the bytes of a tokenizer's JSON file."""
        x = json.loads(data)
        pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in x["model"]["merges"])
        return cls(x["model"]["vocab"], pairs, {t["content"]: t["id"] for t in x.get("added_tokens", [])})

    def _gadget(self, a: int, b: int, c: int, time: int) -> None:
        if c in self.left or a not in self.lost or b not in self.lost or b in self.lost[a]:
            return  # a merge that can't apply changes nothing
        self.lost[a][b] = time
        self.lost[c] = {}
        self.copied[c] = (b, time)
        self.left[c] = (a, time)
        self.ids[self.labels[a] + self.labels[b]] = c

    def _lost_at(self, state: int, arc: int) -> int:
        """When the state lost its arc, itself or the states that it was copied from, before the copy was made."""
        found = until = NEVER
        while True:
            if (t := self.lost[state].get(arc, NEVER)) < until:
                found = min(found, t)
            if state not in self.copied:
                return found
            state, time = self.copied[state]
            until = min(until, time)

    def _compile(self, state: int, arc: int) -> bool:
        """Whether the state has the arc: each left part must have been there when the next longer label was made."""
        made = NEVER
        while True:
            if (lost := self._lost_at(state, arc)) != NEVER and lost <= made:
                return False
            if arc not in self.left:
                return True
            arc, made = self.left[arc]

    def has(self, state: int, arc: int) -> bool:
        key = (state, arc)
        if (found := self.table.get(key)) is None:
            if len(self.table) > 400_000:
                self.table.clear()
            found = self.table[key] = self._compile(state, arc)
        return found

    def word(self, word: bytes) -> tuple[int, ...]:
        """The ids of one pre-split word."""
        ids, table = self.ids, self.table
        n, longest = len(word), self.longest
        path: list[tuple[int, int]] = []  # (token, its length)
        dead: set[tuple[int, int]] = set()  # (place, state) from where no path reaches the end
        at, state, size = 0, -1, min(n, longest)
        while at < n:
            step = 0
            while size:
                token = ids.get(word[at : at + size])
                if token is not None:
                    ok = True if state < 0 else table.get((state, token))
                    if ok is None:
                        ok = self.has(state, token)
                    if ok and (not dead or (at + size, token) not in dead):
                        step = size
                        break
                size -= 1
            if step:
                path.append((token, step))
                at, state = at + step, token
                size = min(n - at, longest)
            else:
                if not path:  # bytes that the vocabulary lacks emit nothing
                    return self.word(bytes(b for b in word if bytes([b]) in ids))
                dead.add((at, state))
                token, back = path.pop()
                at, state = at - back, path[-1][0] if path else -1
                size = back - 1
        return tuple(x for x, _ in path)

    def decode(self, ids: Iterable[int]) -> str:
        """The labels of the arcs; ids without one emit nothing, bytes that are no UTF-8 the replacement sign."""
        get = self.labels.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")


_compiled: dict[bytes, Automaton] = {}
common.remember("bpe", _compiled)


def automaton(data: bytes) -> Automaton:
    """The automaton of a tokenizer file, compiled once in each process."""
    key = hashlib.sha1(data).digest()
    if key not in _compiled:
        _compiled[key] = Automaton.of(data)
    return _compiled[key]


def encode_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, ids array<int>. Null and empty texts have no ids; equal rows give equal rows.

    The vocabulary file is read by the driver only and broadcast; its size is that of a published vocabulary, not of the data.
    """
    common.long_rows(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("bpe")
        auto = automaton(data.value)
        for batch in batches:
            ids = pa.array([auto.encode(x) for x in common.texts_of(batch.column(1))], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), ids], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """From doc_id and ids to doc_id and text. Null ids give an empty text."""
    common.long_rows(encoded.sparkSession)
    data = encoded.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("bpe")
        auto = automaton(data.value)
        for batch in batches:
            texts = pa.array([auto.decode(x.as_py() or ()) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of a text's encoding and of that encoding's decoding, without moving the ids between processes.

    One row per row of docs: doc_id, n_tokens long, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the
    decoded text in UTF-8). Null texts count as empty: no tokens, and the digest of nothing twice. Repeated rows repeat.
    """
    common.long_rows(docs.sparkSession)
    data = docs.sparkSession.sparkContext.broadcast(Path(tokenizer_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.serve("bpe")
        auto = automaton(data.value)
        number = auto.numbers.__getitem__
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for text in common.texts_of(batch.column(1)):
                ids = auto.encode(text)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(number, ids)).encode()).hexdigest())
                of_text.append(hashlib.sha256(auto.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
