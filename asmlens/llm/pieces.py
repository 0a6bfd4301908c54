"""SentencePiece encoding and decoding that keeps offsets.

Normalisation takes, at each place, the longest prefix that the model's
compiled character map knows, writes its replacement and records for each byte
written the source byte it came from. The sentencepiece library merges the
pieces, and their bytes in the normalised text project every piece back to its
span of the original one. Texts are worked on in slices of whole texts.

Cases: null text counts as empty and gives the end id only. Rows that repeat
are encoded alike. Texts of any length are encoded whole; memory grows with the
longest one. An empty table gives an empty table. Columns of the input that
have the name of an output are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asmlens.llm import _text as X
from asmlens.llm._spark import stage

MARK = "▁"
SLICE = 1 << 17  # bytes of text that are worked on at once


def character_map(blob: bytes) -> dict[str, str]:
    """All entries of a compiled character map: the length of a double-array trie, its units, then NUL-ended replacements."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units, texts = np.frombuffer(blob, np.uint32, size // 4, 4).tolist(), blob[4 + size :]
    offset = lambda u: (u >> 10) << ((u & 512) >> 6)
    found: dict[str, str] = {}
    todo = [(b"", offset(units[0]))]
    while todo:
        key, base = todo.pop()
        for label in range(1, 256):
            at = base ^ label
            if at >= len(units) or units[at] & 0x800000FF != label:
                continue
            unit = units[at]
            deeper = at ^ offset(unit)
            if unit >> 8 & 1:
                place = units[deeper] & 0x7FFFFFFF
                found[(key + bytes([label])).decode()] = texts[place : texts.index(0, place)].decode()
            todo.append((key + bytes([label]), deeper))
    return found


class Normalizer:
    """Longest-prefix normalisation with an alignment to source bytes."""

    def __init__(self, spec):
        self.map = character_map(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        heads: dict[str, set[int]] = {}
        for key in self.map:
            heads.setdefault(key[0], set()).add(len(key))
        self.lengths = {c: sorted(n, reverse=True) for c, n in heads.items()}
        self.candidates = re.compile("[" + "".join(map(re.escape, sorted(heads))) + "]") if heads else None

    def _mapped(self, text: str) -> tuple[str, np.ndarray]:
        """Mapped text, and the source byte of each of its bytes and of its end."""
        raw = text.encode()
        if not self.candidates:
            return text, np.arange(len(raw) + 1)
        out, source, at, byte = [], [], 0, 0
        while m := self.candidates.search(text, at):
            head = m.start()
            plain = text[at:head].encode()
            source.append(np.arange(byte, byte + len(plain)))
            out.append(text[at:head])
            byte += len(plain)
            for n in self.lengths[text[head]]:
                if (key := text[head : head + n]) in self.map:
                    break
            else:
                key = text[head]
            new = self.map.get(key, key)
            source.append(np.full(len(new.encode()), byte))
            out.append(new)
            byte += len(key.encode())
            at = head + len(key)
        out.append(text[at:])
        source.append(np.arange(byte, len(raw) + 1))
        return "".join(out), np.concatenate(source)

    def __call__(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and the source byte of each of its UTF-8 bytes and of its end."""
        text, source = self._mapped(text)
        data = np.frombuffer(text.encode(), np.uint8)
        space = data == 32
        keep = np.ones(len(data), bool)
        if self.squeeze and len(data):
            keep = ~(space & np.concatenate([[True], space[:-1]]))
            solid = np.flatnonzero(~space)
            keep[solid[-1] + 1 if len(solid) else 0 :] = False
            text = " ".join(filter(None, text.split(" ")))
        last = source[np.flatnonzero(keep)[-1] + 1] if keep.any() else source[-1]
        data, source = data[keep], source[:-1][keep]
        if not len(data):
            return "", np.array([last])
        if self.escape:
            source = np.repeat(source, np.where(data == 32, len(MARK.encode()), 1))
            text = text.replace(" ", MARK)
        if self.prefix:
            mark = MARK if self.escape else " "
            text, source = mark + text, np.concatenate([np.full(len(mark.encode()), source[0]), source])
        return text, np.append(source, last)


class Encoder:
    """A tokenizer, its normaliser, and the byte length of every piece."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.normal = Normalizer(proto.normalizer_spec)
        self.unknown = self.library.unk_id()
        self.size = np.array([1 if p.type == 6 else 0 if p.type == 3 else len(p.piece.encode()) for p in proto.pieces])  # type 6: a single byte, 3: control
        self.written = [str(k) for k in range(len(proto.pieces))]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text, with the end id."""
        return self.library.encode(texts, add_eos=True, num_threads=1)

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of each piece's source in ``text`` (the end id has an empty span)."""
        _, source = self.normal(text)
        sizes = self.size[np.array(ids, np.int64)]
        if self.unknown in ids:  # the surface of an unknown run is as long as the run
            sizes = np.array([*(len(p.encode()) for p in self.library.encode(text, out_type=str)), 0])
        ends = np.cumsum(sizes)
        if ends[-1] != len(source) - 1:
            raise ValueError("the pieces don't tile the normalised text")
        return source[ends - sizes], source[ends]

    def line(self, ids: list[int]) -> str:
        """Decimal ids with a space between."""
        return " ".join(map(self.written.__getitem__, ids))

    def decode(self, ids: list[list[int]]) -> list[str]:
        """The text of each list of ids."""
        return self.library.decode(ids, num_threads=1) if ids else []


OUTPUTS = {
    "ids": "array<int>",
    "starts": "array<int>",
    "ends": "array<int>",
    "n_tokens": "long",
    "ids_sha256": "string",
    "decoded_sha256": "string",
    "covered_bytes": "long",
}
KINDS = {"array<int>": pa.list_(pa.int32()), "long": pa.int64(), "string": pa.string()}


def _covered(start: np.ndarray, stop: np.ndarray) -> int:
    """Bytes in the union of spans that follow each other."""
    before = np.concatenate([[0], np.maximum.accumulate(stop)[:-1]])
    return int(np.maximum(stop - np.maximum(start, before), 0).sum())


def _lists(values: list) -> pa.Array:
    """A column of lists of ints."""
    ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
    flat = np.concatenate([np.asarray(v, np.int32) for v in values])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(docs: DataFrame, model: str, text: str = "text", outputs: tuple[str, ...] = ("ids", "starts", "ends")) -> DataFrame:
    """``docs`` with the columns of ``OUTPUTS`` that are named. ``model`` is the path of a model file every executor has.

    ``starts`` and ``ends`` are byte offsets in the text; ``covered_bytes`` is the length of the union of all spans.
    Spans, decoding and digests are made only if a named column needs them.
    """
    docs = docs.drop(*(c for c in docs.columns if c.lower() in outputs))
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(", ".join(f"{o} {OUTPUTS[o]}" for o in outputs)).fields])
    names, at = schema.names, docs.columns.index(text)
    aligned = not {"starts", "ends", "covered_bytes"}.isdisjoint(outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Encoder(model)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            for row, offsets, _ in X.texts(batch.column(at), SLICE):
                part = batch.slice(row, len(offsets) - 1)
                texts = [t or "" for t in part.column(at).to_pylist()]
                ids = tool.encode(texts)
                spans = [tool.spans(t, i) for t, i in zip(texts, ids)] if aligned else []
                make = {
                    "ids": lambda: _lists(ids),
                    "starts": lambda: _lists([a for a, _ in spans]),
                    "ends": lambda: _lists([b for _, b in spans]),
                    "n_tokens": lambda: [*map(len, ids)],
                    "ids_sha256": lambda: [digest(tool.line(i)) for i in ids],
                    "decoded_sha256": lambda: [*map(digest, tool.decode(ids))],
                    "covered_bytes": lambda: [_covered(a, b) for a, b in spans],
                }
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(make[o](), KINDS[OUTPUTS[o]]) for o in outputs)], names=names)

    return docs.mapInArrow(run, schema)


def decode(tokens: DataFrame, model: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``tokens`` with the text of ``ids`` in column ``into`` (null ids give null)."""
    tokens = tokens.drop(into) if into.lower() in {c.lower() for c in tokens.columns} else tokens
    names, at = [*tokens.columns, into], tokens.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Encoder(model)
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                lists = part.column(at).to_pylist()
                texts = [None if x is None else t for x, t in zip(lists, tool.decode([x or [] for x in lists]))]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return tokens.mapInArrow(run, tokens.select("*", F.lit("").alias(into)).schema)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op5_sentencepiece_offsets(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens and round trip, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode(docs, default_model(), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes")).drop("text")


@stage
def tokens(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last pipeline stage: each row's id, source, number of tokens and ids."""
    return encode(docs.select("doc_id", "source", "text"), default_model(), outputs=("n_tokens", "ids")).drop("text")
