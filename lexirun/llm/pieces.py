"""SentencePiece encoding that keeps, for every piece, the span of original bytes it came from."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

SPACE = "▁"
#: Documents whose results a worker holds at a time.
SLICE = 128


class CharacterMap:
    """A compiled character map: a double-array trie from byte strings to replacements."""

    def __init__(self, blob: bytes):
        self.units, self.texts = np.zeros(0, "<u4"), b""
        if blob:
            size = int.from_bytes(blob[:4], "little")
            self.units, self.texts = np.frombuffer(blob[4 : 4 + size], "<u4"), blob[4 + size :]
        self.seen: dict[bytes, tuple[int, bytes] | None] = {}

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest key that data has at position at."""
        units, node, found = self.units, 0, None
        if not len(units):
            return None
        unit = int(units[0])
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = int(units[node])
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                value = int(units[node]) & 0x7FFFFFFF
                found = i + 1 - at, self.texts[value : self.texts.index(b"\0", value)]
        return found


@dataclass(frozen=True)
class Rules:
    charmap: CharacterMap
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    #: Pieces that pass as they are, wherever they stand.
    fixed: re.Pattern[bytes] | None = None


def normalise(text: str, rules: Rules, align: bool = True) -> tuple[bytes, np.ndarray | None]:
    """The normalised bytes of text, and, if asked to align, for each of them, and for their end, the offset of its source byte in UTF-8."""
    data, mark = text.encode("utf-8", "replace"), (SPACE if rules.escape else " ").encode()
    if not len(rules.charmap.units) and not rules.squeeze:  # each byte is its own longest prefix
        if not align:
            return mark * (rules.dummy_prefix and data != b"") + data.replace(b" ", mark), None
        return _replace_spaces(data, mark, rules.dummy_prefix)
    out, source, at, after_space = bytearray(), [], 0, rules.squeeze
    parts: list[tuple[bytes, int, int]] = []
    while at < len(data):
        whole = rules.fixed.match(data, at) if rules.fixed else None
        found = (len(whole[0]), whole[0]) if whole else rules.charmap.longest(data, at)
        if found is None:
            size = 1 if data[at] < 0x80 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
            found = size, data[at : at + size]
        parts.append((found[1], at, at + found[0]))
        at += found[0]
    end = len(data)
    if rules.squeeze:
        while parts and parts[0][0] in (b" ", b""):
            parts.pop(0)
        if not parts:
            return b"", np.zeros(1, np.int64)
    if not parts:
        return b"", np.zeros(1, np.int64)
    if rules.dummy_prefix:
        out += mark
        source += [parts[0][1]] * len(mark)
    after_space = rules.squeeze
    for new, start, _ in parts:
        if after_space:
            new = new.lstrip(b" ")
        for i in range(len(new)):
            byte = new[i : i + 1]
            add = mark if byte == b" " else byte
            out += add
            source += [start] * len(add)
        if new:
            after_space = rules.squeeze and new.endswith(b" ")
    if rules.squeeze:
        while out.endswith(mark):
            del out[-len(mark) :]
            end = source[-len(mark)]
            del source[-len(mark) :]
    return bytes(out), np.array([*source, end], np.int64)


def _replace_spaces(data: bytes, mark: bytes, prefix: bool) -> tuple[bytes, np.ndarray]:
    if not data:
        return b"", np.zeros(1, np.int64)
    width = np.ones(len(data) + 1, np.int8)
    width[:-1][np.frombuffer(data, np.uint8) == 0x20] = len(mark)
    width[0] += len(mark) * prefix
    return mark * prefix + data.replace(b" ", mark), np.repeat(np.arange(len(data) + 1, dtype=np.int32), width)


class Encoder:
    """Encodes as the library does for one model: normalises itself, has the result cut into pieces, and projects these to the original bytes.

    The segmenter is the library with the same pieces and no normalisation of its own, so what it sees is what
    normalise() made.
    """

    def __init__(self, model: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model, "rb") as f:
            blob = f.read()
        proto = pb.ModelProto()
        proto.ParseFromString(blob)
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"white space as suffix isn't supported: {model}")
        n, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        fixed = sorted((p.piece.encode() for p in proto.pieces if p.type == kinds.USER_DEFINED), key=len, reverse=True)
        self.rules = Rules(CharacterMap(n.precompiled_charsmap), n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces, re.compile(b"|".join(map(re.escape, fixed))) if fixed else None)
        self.width = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=blob)
        n.Clear()
        n.name, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", False, False, False
        self.segmenter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())

    def encode(self, text: str, align: bool = True) -> tuple[list[int], np.ndarray | None]:
        """The ids, and, if asked to align, for each of them start and end of its source in the UTF-8 bytes of text; an id without own bytes gets an empty span."""
        data, source = normalise(text, self.rules, align)
        norm = data.decode("utf-8")
        ids = self.segmenter.encode(norm)
        if not align:
            return ids, None
        ends = np.cumsum(self.width[np.array(ids, np.int32)])
        if len(ids) and ends[-1] != len(data):  # unknown pieces: the segmenter alone knows how much each took
            ends = np.cumsum([len(p.surface.encode()) if not self.segmenter.is_byte(p.id) else 1 for p in self.segmenter.encode(norm, return_type="proto").pieces])
        edges = source[np.concatenate([[0], ends])]
        return ids, np.stack([edges[:-1], edges[1:]], axis=1).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        return self.decoder.decode(ids)


@lru_cache(2)
def encoder(model: str) -> Encoder:
    return Encoder(model)


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _said(ids: list[int]) -> str:
    return ",".join(map(str, ids))


#: What encode_documents can return: type for Spark, type for Arrow, and how it comes from encoder, ids and spans.
COLUMNS = {
    "ids": ("array<int>", pa.list_(pa.int32()), lambda e, ids, spans: np.array(ids, np.int32)),
    "spans": ("array<bigint>", pa.list_(pa.int64()), lambda e, ids, spans: spans.ravel()),
    "decoded": ("string", pa.string(), lambda e, ids, spans: e.decode(ids)),
    "n_tokens": ("bigint", pa.int64(), lambda e, ids, spans: len(ids)),
    "ids_sha256": ("string", pa.string(), lambda e, ids, spans: _sha(_said(ids).encode())),
    "decoded_sha256": ("string", pa.string(), lambda e, ids, spans: _sha(e.decode(ids).encode())),
    "spans_sha256": ("string", pa.string(), lambda e, ids, spans: _sha(spans.astype("<i8").tobytes())),
}


def encode_documents(docs: DataFrame, model: str, columns: tuple[str, ...] = ("ids", "spans", "decoded"), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id and the asked columns (see COLUMNS).

    ids are those of the library without begin or end ids; spans has start, end, start, end ... in bytes of the
    text; decoded is the library's text for ids. A null text is empty and has no ids. Texts of any length are encoded
    whole; an empty table gives an empty one. Ids may be null or come twice; other columns are ignored, whatever their
    names. Every text is aligned, whatever is asked; columns only say what is returned. model: a path that every
    executor has.
    """
    kinds = [COLUMNS[c] for c in columns]

    def encoded(batches):
        e = encoder(model)
        for b in slices(batches, SLICE):  # ids and spans take many times the room of their text
            out = [[] for _ in columns]
            for t in b.column(1):
                ids, spans = e.encode(t.as_py() or "")
                for values, kind in zip(out, kinds, strict=True):
                    values.append(kind[2](e, ids, spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, k[1]) for v, k in zip(out, kinds, strict=True)]], names=["doc_id", *columns])

    raw = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return raw.mapInArrow(encoded, ", ".join([f"doc_id {raw.schema['doc_id'].dataType.simpleString()}", *[f"{c} {k[0]}" for c, k in zip(columns, kinds, strict=True)]]))
