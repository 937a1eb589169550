"""Byte-pair encoding and decoding with a given vocabulary.

The distinct words of a batch lie as symbols in one flat array.  Each round looks all neighbouring
pairs up in the sorted pair keys by binary search, takes the lowest rank of every word and merges all
places of that pair at once; words without a known pair leave the rounds.  Texts need no shuffle."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NONE = np.int64(1 << 40)
#: Distinct words a worker remembers before it starts anew (memory only; results do not depend on it).
REMEMBERED_WORDS = 400_000
_SPACES = regex.compile(r"\s+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else one above 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


@dataclass
class Vocabulary:
    """Tables of a word-end vocabulary: tokens by id, sorted pair keys with rank and merged id."""

    tokens: list[str]
    pattern: str
    special: dict[str, int]
    keys: np.ndarray
    ranks: np.ndarray
    merged: np.ndarray
    first: np.ndarray  # id of each byte inside a word
    last: np.ndarray  # id of each byte at a word's end

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a vocabulary file; its size is the file's, whatever the corpus."""
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, end = file["model"], file["model"]["end_of_word_suffix"]
        ids = dict(model["vocab"])
        special = {t["content"]: t["id"] for t in file["added_tokens"]}
        tokens = [""] * (max([*ids.values(), *special.values()]) + 1)
        for token, i in [*ids.items(), *special.items()]:
            tokens[i] = token
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        letters = byte_letters()
        return cls(
            tokens, file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], special, keys[order],
            np.arange(len(pairs), dtype=np.int64)[order],
            np.array([ids[a + b] for a, b in pairs], np.int64)[order],
            np.array([ids[c] for c in letters], np.int64), np.array([ids[c + end] for c in letters], np.int64))


def merge_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, end to end, and the n + 1 offsets of the words."""
    lengths = np.array([len(w) for w in words], np.int64)
    raw = np.frombuffer(b"".join(words), np.uint8)
    symbols = v.first[raw]
    ends = np.cumsum(lengths)
    symbols[ends - 1] = v.last[raw[ends - 1]]
    word = np.repeat(np.arange(len(words)), lengths)
    done_symbols, done_words = [], []
    while len(symbols):
        key = symbols[:-1] << 32 | symbols[1:]
        place = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        rank = np.append(np.where((v.keys[place] == key) & (word[:-1] == word[1:]), v.ranks[place], _NONE), _NONE)
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(starts, len(word)))
        lowest = np.minimum.reduceat(rank, starts)
        going = np.repeat(lowest < _NONE, sizes)
        if not going.all():
            done_symbols.append(symbols[~going])
            done_words.append(word[~going])
        hits = np.flatnonzero((rank == np.repeat(lowest, sizes)) & going)
        if not len(hits):
            break
        # In a run of overlapping places (as in "aaa") every second one stands.
        fresh = np.append(True, np.diff(hits) != 1)
        run = np.maximum.accumulate(np.where(fresh, np.arange(len(hits)), 0))
        hits = hits[(np.arange(len(hits)) - run) % 2 == 0]
        symbols[hits] = v.merged[place[hits]]
        keep = going
        keep[hits + 1] = False
        symbols, word = symbols[keep], word[keep]
    if not done_words:
        return np.zeros(0, np.int64), np.zeros(len(words) + 1, np.int64)
    symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    counts = np.bincount(word, minlength=len(words))
    return symbols[order], np.append(0, np.cumsum(counts))


@dataclass
class Encoder:
    """Encodes texts batch by batch and remembers words it has met."""

    v: Vocabulary
    seen: dict[str, int] = field(default_factory=dict)
    ids: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.split = regex.compile(self.v.pattern)
        self.marks = regex.compile("|".join(map(regex.escape, self.v.special))) if self.v.special else None

    def words(self, text: str) -> list[str]:
        """Words of a text as they enter the merges; special tokens stand for themselves."""
        if self.marks is None or not self.marks.search(text):
            return self._plain(text)
        out, done = [], 0
        for m in self.marks.finditer(text):
            out += [*self._plain(text[done : m.start()]), "\0" + m[0]]
            done = m.end()
        return out + self._plain(text[done:])

    def _plain(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        # Letter by letter: a capital sigma does not look at its neighbours.
        return self.split.findall(_SPACES.sub(" ", text).replace("Σ", "σ").lower())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > REMEMBERED_WORDS:
            self.seen, self.ids = {}, []
        parts = [self.words(t) for t in texts]
        new = list(dict.fromkeys(w for p in parts for w in p if w not in self.seen))
        plain = [w for w in new if w[0] != "\0" or w[1:] not in self.v.special]
        if plain:
            flat, at = merge_words([w.encode() for w in plain], self.v)
            self._add(plain, [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)])
        special = [w for w in new if w not in self.seen]
        self._add(special, [np.array([self.v.special[w[1:]]], np.int64) for w in special])
        seen, ids, empty = self.seen, self.ids, [np.zeros(0, np.int64)]
        return [np.concatenate([ids[seen[w]] for w in p] or empty) for p in parts]

    def _add(self, words: list[str], ids: list[np.ndarray]) -> None:
        self.seen.update(zip(words, range(len(self.ids), len(self.ids) + len(words)), strict=True))
        self.ids += ids


def decode(ids: np.ndarray, tokens: list[str]) -> str:
    """Tokens with one space between, special ones included: these vocabularies name no decoder."""
    return " ".join(map(tokens.__getitem__, ids.tolist()))


def encode_documents(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id",
                     keep_ids: bool = False) -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids, if kept).

    A null or empty text has no tokens; null, equal and repeated doc_ids pass through row by row;
    other columns are ignored; an empty table gives no rows.  `path` is read on the driver; the
    tables travel with the tasks and are as large as that file."""
    v = Vocabulary.load(path)
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(v)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                all_ids = encoder.encode([t or "" for t in part.column(1).to_pylist()])
                columns = [
                    part.column(0), pa.array([len(i) for i in all_ids], pa.int64()),
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in all_ids], pa.string()),
                    pa.array([hashlib.sha256(decode(i, v.tokens).encode()).hexdigest() for i in all_ids], pa.string())]
                if keep_ids:
                    columns.append(pa.array([i.astype(np.int32) for i in all_ids], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, schema_names)

    schema_names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * keep_ids
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
