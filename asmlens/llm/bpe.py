"""Byte-pair encoding and decoding with a merge table.

A text is cut at the added tokens of the vocabulary, then into words by the
byte-level pattern. Within a word the merges wait in a priority queue by rank
and place, over a doubly linked list of symbols; an entry whose symbols have
changed since is stale and skipped. So a word of n bytes takes n log n steps,
however long it is. Words seen before come from a table of bounded size.
Decoding concatenates the vocabulary's byte strings.

Cases: null text counts as empty and has no tokens. Rows that repeat are encoded
alike. Texts of any length are encoded whole; memory grows with the longest one.
An empty table gives an empty table. Columns of the input that have the name of
an output are replaced. Bytes that are no UTF-8 decode to replacement characters.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asmlens.llm import _text as X

# Fixed value: how byte-level vocabularies of this kind split text into words.
WORDS = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
EARLY = bytes(range(0xD5))  # bytes of letters before the first that tables of different age disagree on
SLICE = 1 << 18  # bytes of text that are worked on at once
KNOWN, KNOWN_BYTES = 1 << 18, 64  # words in the table, and the longest of them


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _newer_letters() -> re.Pattern:
    """Letters, digits and spaces that the pattern knows and Python's character table doesn't: there libraries may differ."""
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    found = [ord(c) for c in regex.findall(r"[\p{L}\p{N}\s]", every) if unicodedata.category(c) == "Cn"]
    runs: list[list[int]] = []
    for c in found:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in runs) + "]" if runs else r"(?!)")


class _Known(dict):
    """Words and their ids; starts anew when it is full, and keeps no long words."""

    def __init__(self, table: Coder):
        self.merge = table.merge

    def __missing__(self, word: str) -> list[int]:
        data = word.encode()
        ids = self.merge(data)
        if len(data) <= KNOWN_BYTES:
            if len(self) >= KNOWN:
                self.clear()
            self[word] = ids
        return ids


class Coder:
    """A byte-level merge table out of a ``tokenizer.json`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre, added = spec["model"], spec["pre_tokenizer"] or {}, spec["added_tokens"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or not plain or spec["normalizer"] or odd or any(a["single_word"] or a["lstrip"] or a["rstrip"] for a in added):
            raise ValueError(f"{path} is no plain byte-level merge table")
        letters, vocabulary = byte_letters(), model["vocab"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made = [vocabulary[a + b] for a, b in pairs]  # what each rank's merge makes
        self.ranks: list[dict[int, int]] = [{} for _ in range(max(vocabulary.values()) + 2)]  # by left symbol, then right; the last is of no symbol
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocabulary[a]][vocabulary[b]] = rank
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = vocabulary[letter]
        self.added = {a["content"]: a["id"] for a in added}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.strings: dict[int, bytes] = {}
        for token, number in (vocabulary | self.added).items():
            known = all(c in letters for c in token)
            self.strings[number] = bytes(letters[c] for c in token) if known else token.encode()
        self.written = {number: str(number) for number in self.strings}
        self.newer = _newer_letters()
        self.known = _Known(self)

    def words(self, text: str) -> list[str]:
        if not text.encode().translate(None, EARLY) or not self.newer.search(text):
            return WORDS.findall(text)
        import tokenizers

        splitter = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        return [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)]

    def merge(self, data: bytes) -> list[int]:
        """The ids of one word."""
        of_byte, ranks, made, n = self.of_byte, self.ranks, self.made, len(data)
        symbols, shift, queue = [of_byte[b] for b in data], n.bit_length(), []
        for k, (left, right) in enumerate(zip(symbols, symbols[1:])):
            if (rank := ranks[left].get(right)) is not None:
                queue.append(rank << shift | k)
        heapify(queue)
        before, after, low = [*range(-1, n - 1)], [*range(1, n + 1)], (1 << shift) - 1  # the linked list; n ends it
        symbols.append(-1)
        while queue:
            entry = heappop(queue)
            k = entry & low
            other = after[k]
            if ranks[symbols[k]].get(symbols[other]) != entry >> shift:
                continue  # stale
            symbol = symbols[k] = made[entry >> shift]
            symbols[other] = -1
            follower = after[k] = after[other]
            if follower < n:
                before[follower] = k
                if (rank := ranks[symbol].get(symbols[follower])) is not None:
                    heappush(queue, rank << shift | k)
            if (previous := before[k]) >= 0 and (rank := ranks[symbols[previous]].get(symbol)) is not None:
                heappush(queue, rank << shift | previous)
        return [s for s in symbols if s >= 0]

    def encode(self, text: str) -> list[int]:
        parts = self.cut.split(text) if self.cut else [text]
        ids: list[int] = []
        for part in parts:
            if part in self.added:
                ids.append(self.added[part])
            elif part:
                ids.extend(chain.from_iterable(map(self.known.__getitem__, self.words(part))))
        return ids

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; ids that the vocabulary lacks are left out."""
        return b"".join([s for i in ids if (s := self.strings.get(i)) is not None]).decode("utf-8", "replace")

    def line(self, ids: list[int]) -> str:
        """Decimal ids with a comma between."""
        return ",".join(map(self.written.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One table a Python worker."""
    return Coder(path)


OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
KINDS = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string()}


def encode(docs: DataFrame, vocabulary: str, text: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``docs`` with the columns of ``OUTPUTS`` that are named. ``vocabulary`` is the path of a file every executor has.

    ``decoded_sha256`` is the digest of the text that the ids decode to.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in outputs))
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(", ".join(f"{o} {OUTPUTS[o]}" for o in outputs)).fields])
    names, at = schema.names, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(vocabulary)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for row, offsets, _ in X.texts(batch.column(at), SLICE):
                part = batch.slice(row, len(offsets) - 1)
                ids = [tool.encode(t or "") for t in part.column(at).to_pylist()]
                make = {
                    "ids": lambda: pa.ListArray.from_arrays(np.cumsum([0, *map(len, ids)]).astype(np.int32), pa.array([*chain.from_iterable(ids)], pa.int32())),
                    "n_tokens": lambda: [*map(len, ids)],
                    "ids_sha256": lambda: [digest(tool.line(i)) for i in ids],
                    "decoded_sha256": lambda: [digest(tool.decode(i)) for i in ids],
                }
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(make[o](), KINDS[OUTPUTS[o]]) for o in outputs)], names=names)

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``tokens`` with the text of ``ids`` in column ``into`` (null ids give null)."""
    tokens = tokens.drop(*(c for c in tokens.columns if c.lower() == into.lower()))
    names, at = [*tokens.columns, into], tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = coder(vocabulary)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                texts = [None if x is None else tool.decode(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return tokens.mapInArrow(run, tokens.select("*", F.lit("").alias(into)).schema)


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op13_bpe_merge_queue(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens and round trip, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, default_vocabulary(), outputs=("n_tokens", "ids_sha256", "decoded_sha256")).drop("text")
