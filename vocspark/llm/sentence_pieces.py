"""Encoding and decoding by a sentence-piece model, with every piece's place in the original text.

A text is normalised by the longest prefix that the model's compiled character map (a double-array trie) knows at each
place; every normalised byte keeps the number of source bytes read up to it.  A model without a map leaves the bytes as
they are.  The pieces of the normalised text are found by merging neighbours in the order of their scores, and
each piece's end is then read off the alignment, so pieces tile the original text: piece k covers the source bytes
ends[k - 1] … ends[k].  The blank that the model puts in front belongs to no source byte.

Where no piece of the model goes on with a blank or line end after another character, merges never cross such places: texts are cut there,
and equal parts of a batch are merged once.  Within the subpackage blanks stand for the model's blank sign U+2581.

Null and empty texts have no pieces but begin and end (if asked for); a source U+2581 counts as a blank, as in the library.  Repeated rows
give the same ids, empty tables an empty result, other columns are carried and one named like an added column is replaced.
Texts of any length are encoded whole.  Models other than byte-fallback BPE, or with user-defined or unused pieces, are refused.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vocspark.llm.common import add_columns, table, text_bytes
from vocspark.llm.pair_merges import PairTable, merge_words, spread
from vocspark.llm.registry import query

BLANK = "▁"
SIGN = BLANK.encode()
# Kinds of pieces, and the unit for undecodable bytes.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE = 2
REPLACEMENT = "�"
# Symbols from here on are characters without a piece, by code point.
LOOSE = 1 << 21
# Bytes of text that are worked on together.
BATCH_BYTES = 1 << 21
# Code points of white space beyond ASCII, after which no cut is made.
WIDE_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x2581]
_WIDE = re.compile("|".join(chr(c) for c in WIDE_SPACES).encode())


def message_fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at
    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 2:
            size, at = varint(at)
            value, at = data[at:at + size], at + size
        else:
            size = 8 if kind == 1 else 4
            value, at = struct.unpack("<d" if kind == 1 else "<f", data[at:at + size])[0], at + size
        yield tag >> 3, value


class CharacterMap:
    """Longest-prefix replacements from a compiled map: a double-array trie, then the replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4:4 + size], dtype="<u4").tolist()
        self.replacements = compiled[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix at a place, and what replaces it."""
        units, found = self.units, None
        node = (units[0] >> 10) << ((units[0] & 0x200) >> 6)
        for end in range(at, len(data)):
            node ^= data[end]
            if node >= len(units) or units[node] & 0x800000FF != data[end]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = end + 1 - at, self.replacements[start:self.replacements.index(b"\0", start)]
        return found

    def apply(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The replaced bytes, and the source bytes read before each of them and at the end."""
        if not self.units:
            return data, np.arange(len(data) + 1)
        out, ends, at = [], [], 0
        while at < len(data):
            first = data[at]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            size, new = self.longest(data, at) or (width, data[at:at + width])
            out.append(new)
            ends.append((at, len(new)))
            at += size
        before = np.repeat([e for e, _ in ends], [n for _, n in ends]) if ends else np.zeros(0, dtype=np.int64)
        return b"".join(out), np.append(before.astype(np.int64), len(data))


class PieceModel:
    """The pieces, merges and normalisation of a model file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            data = file.read()
        pieces, spec, trainer = [], {}, {}
        for number, value in message_fields(data):
            if number == 1:
                pieces.append({1: b"", 2: 0.0, 3: NORMAL} | dict(message_fields(value)))
            elif number == 2:
                trainer = dict(message_fields(value))
            elif number == 3:
                spec = dict(message_fields(value))
        self.texts = [p[1].decode() for p in pieces]
        self.kinds = np.array([p[3] for p in pieces])
        if trainer.get(3) != BPE or (self.kinds == BYTE).sum() != 256 or np.isin(self.kinds, [USER_DEFINED, UNUSED]).any() or not spec.get(5, 1):
            raise ValueError("a byte-fallback BPE model without user-defined or unused pieces is needed")
        self.characters = CharacterMap(spec.get(2, b""))
        self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.begin = self.texts.index("<s>") if "<s>" in self.texts else None
        self.end = self.texts.index("</s>") if "</s>" in self.texts else None
        self.byte_ids = np.zeros(256, dtype=np.int64)
        for i in np.flatnonzero(self.kinds == BYTE).tolist():
            self.byte_ids[int(self.texts[i][3:5], 16)] = i
        self._symbols([(i, t.replace(BLANK, " "), p[2]) for i, (t, p) in enumerate(zip(self.texts, pieces)) if p[3] == NORMAL])
        self._outputs()

    def _symbols(self, normal: list[tuple[int, str, float]]) -> None:
        """Numbers of single characters, and the pairs that merge with their ranks."""
        number = {text: i for i, text, _ in normal}
        spare = len(self.texts)
        for _, text, _ in normal:
            for c in text:
                if c not in number:  # occurs in pieces but is none itself
                    number[c], spare = spare, spare + 1
        self.of_point = np.arange(0x110000, dtype=np.int32) + LOOSE
        for text, i in number.items():
            if len(text) == 1:
                self.of_point[ord(text)] = i
        self.point_of_spare = np.array([ord(c) for c, i in sorted(number.items(), key=lambda x: x[1]) if i >= len(self.texts)], dtype=np.int64)
        scores = {s: k for k, s in enumerate(sorted({s for _, _, s in normal}, reverse=True))}
        rows = [(number[t[:k]], number[t[k:]], scores[s], i) for i, t, s in normal for k in range(1, len(t)) if t[:k] in number and t[k:] in number]
        self.pairs = PairTable(*zip(*rows)) if rows else PairTable([], [], [], [])
        # Characters before which a text may be cut: no piece has one after a character of another kind.
        self.cut_bytes = [ord(c) for c in " \n" if not any(re.search(f"[^ \t-\r]{c}", t) for _, t, _ in normal)]

    def _outputs(self) -> None:
        """Bytes of every id with its offsets: the decoding table."""
        of_byte = {int(i): bytes([b]) for b, i in enumerate(self.byte_ids.tolist())}
        self.outputs = [of_byte[i] if i in of_byte else b"" if k in (CONTROL, UNKNOWN) else t.replace(BLANK, " ").encode()
                        for i, (t, k) in enumerate(zip(self.texts, self.kinds.tolist()))]
        self.sizes = np.array([len(t) for t in self.outputs], dtype=np.int64)
        self.offsets = np.concatenate(([0], np.cumsum(self.sizes)))
        self.blob = np.frombuffer(b"".join(self.outputs), dtype=np.uint8)
        self.is_byte, self.is_control = self.kinds == BYTE, self.kinds == CONTROL
        self.leads = np.array([t.startswith(b" ") for t in self.outputs]) & (self.kinds == NORMAL)

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray | None]:
        """Normalised bytes with the model's blank as a blank, and the source bytes read up to each (null: all as they are, after the prefix)."""
        if not text:
            return b"", None
        if not self.characters.units and not self.squeeze and SIGN not in text:
            return (b" " + text if self.prefix else text), None
        data, before = self.characters.apply(text)
        if SIGN in data:
            keep = np.ones(len(data) + 1, dtype=bool)
            for m in re.finditer(SIGN, data):
                keep[m.start() + 1:m.end()] = False
            data, before = data.replace(SIGN, b" "), before[keep]
        if self.squeeze:
            raw = np.frombuffer(data, dtype=np.uint8)
            blank = raw == 32
            keep = ~blank | np.append(False, ~blank[:-1])
            last = np.flatnonzero(~blank)
            keep[(last[-1] + 1 if len(last) else 0):] = False
            data, before = raw[keep].tobytes(), np.append(before[:-1][keep], before[-1])
            if len(data):
                before[0] = 0
        if self.prefix and data:
            data, before = b" " + data, np.concatenate(([0], before))
        return data, before

    def encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their bounds of many normalised parts (an array of binary), with single bytes for characters without a piece."""
        bounds = np.frombuffer(parts.buffers()[1], dtype=np.int32)[parts.offset:parts.offset + len(parts) + 1].astype(np.int64)
        raw = np.frombuffer(parts.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]
        points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), dtype="<u4")
        counted = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
        ids, ends = merge_words(self.of_point[points], counted[bounds - bounds[0]], self.pairs)
        loose = np.flatnonzero(ids >= len(self.texts))
        if not len(loose):
            return ids, ends
        point = ids[loose] - LOOSE
        spare = point < 0
        point[spare] = self.point_of_spare[ids[loose[spare]] - len(self.texts)]
        width = np.ones(len(ids), dtype=np.int64)
        width[loose] = 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)
        places = np.concatenate(([0], np.cumsum(width)))
        out = np.repeat(ids, width)
        out[spread(places[loose], width[loose])] = self.byte_ids[
            np.frombuffer(point.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8"), dtype=np.uint8)]
        return out, places[ends]

    def parts_of(self, texts: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """Parts of normalised texts that merge on their own, and the first part of each text (and the end)."""
        joined = b"".join(texts)
        data = np.frombuffer(joined, dtype=np.uint8)
        starts = np.cumsum([0, *map(len, texts)])
        cut = cut_places(data, joined, self.cut_bytes)
        cut[starts[:-1][np.diff(starts) > 0]] = True
        at = np.flatnonzero(cut)
        bounds = np.append(at, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(joined)])
        return parts, np.searchsorted(at, starts)

    def encode_batch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts without begin and end, their bounds per text, and every piece's end in the source bytes."""
        normal, alignments = zip(*map(self.normalise, texts)) if texts else ((), ())
        parts, first = self.parts_of(list(normal))
        coded = parts.dictionary_encode()
        ids, bounds = self.encode_parts(coded.dictionary)
        which = coded.indices.to_numpy().astype(np.int64)
        sizes = np.diff(bounds)[which]
        out = ids[spread(bounds[which], sizes)]
        text_bounds = np.concatenate(([0], np.cumsum(sizes)))[first]
        ends = np.concatenate(([0], np.cumsum(self.sizes[out])))
        ends = ends[1:] - np.repeat(ends[text_bounds[:-1]], np.diff(text_bounds))
        if self.prefix and any(a is None for a in alignments):
            ends -= np.repeat([int(a is None) for a in alignments], np.diff(text_bounds))
        for k, a in enumerate(alignments):
            if a is not None:
                span = slice(text_bounds[k], text_bounds[k + 1])
                ends[span] = a[ends[span]]
        return out, text_bounds, ends

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: byte pieces as UTF-8 with a sign for every byte that is none, and without the blank in front."""
        shown = np.flatnonzero(~self.is_control[ids])
        if not len(shown):
            return ""
        ids = ids[shown[0]:shown[-1] + 1]
        raw = self.blob[spread(self.offsets[ids], self.sizes[ids])].tobytes()
        lead = int((self.prefix or self.squeeze) and bool(self.leads[ids[0]]))
        try:
            if len(shown) < len(ids) or (self.kinds[ids] == UNKNOWN).any():
                raise ValueError
            return raw[lead:].decode("utf-8")
        except ValueError:
            return self._decode_loosely(ids, lead)

    def _decode_loosely(self, ids: np.ndarray, lead: int) -> str:
        out, at = [], 0
        while at < len(ids):
            if not self.is_byte[ids[at]]:
                out.append(" ⁇ " if self.kinds[ids[at]] == UNKNOWN else self.outputs[ids[at]].decode())
                at += 1
                continue
            stop = at
            while stop < len(ids) and self.is_byte[ids[stop]]:
                stop += 1
            raw = b"".join(self.outputs[i] for i in ids[at:stop].tolist())
            while raw:
                size = next((n for n in (1, 2, 3, 4) if _valid(raw[:n])), 0)
                out.append(raw[:size].decode() if size else REPLACEMENT)
                raw = raw[size or 1:]
            at = stop
        return "".join(out)[lead:]


def _valid(raw: bytes) -> bool:
    try:
        return len(raw.decode("utf-8")) == 1
    except UnicodeDecodeError:
        return False


def cut_places(data: np.ndarray, joined: bytes, cut_bytes: list[int]) -> np.ndarray:
    """Where a blank (or another of the given bytes) follows something that is no white space."""
    spaces = np.zeros(256, dtype=bool)
    spaces[[9, 10, 11, 12, 13, 32]] = True
    cuts = np.zeros(256, dtype=bool)
    cuts[cut_bytes] = True
    visible = ~spaces[data]
    if not joined.isascii():
        for m in _WIDE.finditer(joined):
            visible[m.end() - 1] = False
    cut = cuts[data]
    cut[1:] &= visible[:-1]
    cut[:1] = False
    return cut


def text_groups(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Index ranges of consecutive texts of about BATCH_BYTES each; a long text is alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > BATCH_BYTES:
            yield start, i
            start, size = i, 0
        size += len(text)
    if texts:
        yield start, len(texts)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def framed(m: PieceModel, texts: list[bytes], begin: bool, end: bool) -> Iterator[tuple[list, list]]:
    """Ids and ends of every text, as arrays, with the begin and end id put around."""
    for first, last in text_groups(texts):
        ids, bounds, ends = m.encode_batch(texts[first:last])
        for k, text in enumerate(texts[first:last]):
            a, b = bounds[k], bounds[k + 1]
            head, tail = [m.begin] * begin, [m.end] * end
            yield np.concatenate((head, ids[a:b], tail)).astype("<u4"), np.concatenate((head and [0], ends[a:b], tail and [len(text)])).astype("<u4")


def round_trip(docs: DataFrame, path: str | None = None, text: str = "text", begin: bool = True, end: bool = True) -> DataFrame:
    """``docs`` with ``ids`` and ``ends`` (little-endian unsigned 32-bit integers) and ``decoded``, in one pass over the texts.

    ``ends`` are the source bytes up to the end of each piece; a piece begins where the one before it ends.  ``path``
    must exist on the executors; null is the installed public model.
    """
    def work(texts):
        m = model(path or default_path())
        found = list(framed(m, text_bytes(texts), begin, end))
        return [[i.tobytes() for i, _ in found], [e.tobytes() for _, e in found],
                pa.array([m.decode(i.astype(np.int64)) for i, _ in found], pa.string())]

    return add_columns(docs, [text], "ids binary, ends binary, decoded string", work)


def decode_documents(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of packed ids; null ids give the empty text."""
    def work(packed):
        m = model(path or default_path())
        return [pa.array([m.decode(np.frombuffer(x or b"", dtype="<u4").astype(np.int64)) for x in packed.to_pylist()], pa.string())]

    return add_columns(rows, [ids], "decoded string", work)


def piece_spans(coded: DataFrame) -> DataFrame:
    """One row for each piece of a round trip's rows: the other columns, place, id, and its first and past-last source byte."""
    others = [c for c in coded.columns if c not in ("ids", "ends", "decoded", "place", "id", "first_byte", "end_byte")]

    def task(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                ids = np.frombuffer(row.column("ids")[0].as_py() or b"", dtype="<u4")
                ends = np.frombuffer(row.column("ends")[0].as_py() or b"", dtype="<u4").astype(np.int64)
                same = row.select(others).take(pa.array(np.zeros(len(ids), dtype=np.int64))) if others else None
                yield pa.RecordBatch.from_arrays(
                    (same.columns if others else []) + [pa.array(np.arange(len(ids), dtype=np.int64)), pa.array(ids.astype(np.int64)),
                                                        pa.array(np.concatenate(([0], ends))[:len(ids)]), pa.array(ends)],
                    names=others + ["place", "id", "first_byte", "end_byte"])

    from pyspark.sql.types import StructType
    schema = StructType([coded.schema[c] for c in others] + list(StructType.fromDDL("place bigint, id bigint, first_byte bigint, end_byte bigint")))
    return coded.select(*others, "ids", "ends").mapInArrow(task, schema)


@query("op13_sentence_pieces")
def sentence_pieces(spark, folder):
    coded = round_trip(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), F.sha2("ends", 256).alias("ends_sha256"))
