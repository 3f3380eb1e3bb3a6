"""Token ids as flat binary files with 64-bit document offsets.

Documents are range-partitioned by id.  Each task writes one shard: ``.bin`` with unsigned 16- or 32-bit little-endian
ids (by the size of the vocabulary), ``.idx`` with n + 1 unsigned 64-bit offsets in ids, ``.ids`` with the documents' ids.
The shards' first positions in the whole corpus are prefix sums of their lengths.  Only shards that the committed manifest names
count, so a task that is run again does no harm.  Readers map the files into memory where the folder is local, and
read ranges elsewhere.

Null texts are empty documents, which still get the end id.  Documents of equal id stand next to each other in the
order of their texts; rows without an id come first.  Extra columns are ignored; an empty table gives no shard and no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vocspark.llm.bpe import byte_characters
from vocspark.llm.common import fresh_folder, make_folder, materialise, store, table, text_bytes, with_column_batches
from vocspark.llm.pair_merges import PairTable, merge_words, spread
from vocspark.llm.registry import query
from vocspark.llm.sentence_pieces import text_groups

END_ID = 2
CACHED_WORDS = 200_000
CACHED_BYTES = 64
JOINED_PARTS = 1000
# Code points below 0180 have no combining marks; all but U+0130 have one lower-case letter each.
_SIMPLE = re.compile("[\x00-\u012f\u0131-\u017f]*").fullmatch
NO_ID = -(1 << 63)
# Documents that one reading task takes from a shard.
READ_DOCUMENTS = 8192
TASK_TOKENS = 1 << 24
MANIFEST = "part bigint, shard string, width int, documents bigint, tokens bigint"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


_BLANK, _MARK, _PLAIN = (np.isin(np.arange(256), list(chars)) for chars in (b" \n", b",.", b"abcdefghijklmnopqrstuvwxyz0123456789"))


def _part_starts(data: np.ndarray) -> np.ndarray:
    """Places behind a blank or line end, and at a single comma or full stop between a plain letter or digit and a blank, which is a piece of its own."""
    blank = _BLANK[data]
    start = _MARK[data]
    start[:-1] &= blank[1:]
    start[1:] &= _PLAIN[data[:-1]]
    start[1:] |= blank[:-1]
    start[:1] = True
    return start


class WordEncoder:
    """Ids as by the tokenizers library.  The vocabulary drops white space and never joins across it, so a text's ids are
    those of its parts between blanks and line ends; equal parts are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items()
                   if t.special and t.content.startswith("<|") and not (t.normalized or t.single_word or t.lstrip or t.rstrip)]
        self.separator_id, self.separator = special[0] if special else (None, None)
        # Normal form, white space and lower case: for letters without marks that is lower case alone.
        self.plain = None
        if "NFC" in str(self.tokenizer.normalizer) and "Lowercase" in str(self.tokenizer.normalizer):
            self.plain = Tokenizer.from_file(path)
            self.plain.no_truncation()
            self.plain.no_padding()
            self.plain.normalizer = normalizers.Sequence([])
        self.known: dict[bytes, bytes] = {b"": b""}
        self._letters = self._merges(path) if self.plain is not None else None

    def _merges(self, path: str) -> tuple[PairTable, np.ndarray, np.ndarray] | None:
        """Merges of a byte-level vocabulary whose words end in a suffix, and the ids of single bytes inside and at the end of a word."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)["model"]
        suffix, ids = spec.get("end_of_word_suffix"), spec["vocab"]
        characters = byte_characters()
        if spec["type"] != "BPE" or not suffix or spec.get("dropout") or not all(c in ids and c + suffix in ids for c in characters):
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["merges"]]
        pairs = PairTable([ids[a] for a, _ in merges], [ids[b] for _, b in merges], range(len(merges)), [ids[a + b] for a, b in merges])
        return pairs, np.array([ids[c] for c in characters]), np.array([ids[c + suffix] for c in characters])

    def _words(self, raw: list[bytes]) -> list[bytes]:
        """Packed ids of lower-case words of simple letters alone, which the pattern keeps whole: merged together."""
        pairs, inside, last = self._letters
        bounds = np.cumsum([0, *map(len, raw)])
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        symbols = inside[data]
        symbols[bounds[1:] - 1] = last[data[bounds[1:] - 1]]
        ids, ends = merge_words(symbols, bounds, pairs)
        packed, cuts = ids.astype(self.dtype).tobytes(), (ends * self.dtype.itemsize).tolist()
        return [packed[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def _new(self, parts: list[bytes]) -> dict[bytes, bytes]:
        """Packed ids of distinct parts: many are encoded at once, parted by a special token, which the library
        cuts out before anything else.  Parts that hold its text go alone; simple parts skip the normalizer, and words of
        simple letters are merged here."""
        out: dict[bytes, bytes] = {}
        groups: tuple[list, list] = ([], [])
        words: list[tuple[bytes, bytes]] = []
        for part in parts:
            if part.isalpha() and self._letters is not None:  # letters of ASCII alone
                words.append((part, part.lower()))
                continue
            text = part.decode("utf-8")
            if self._letters is not None and text.isalpha() and _SIMPLE(text):
                words.append((part, text.lower().encode()))
            elif self.separator is None or b"<|" in part:
                out[part] = np.array(self._ids(self.tokenizer, text), dtype=self.dtype).tobytes()
            else:
                groups[self.plain is not None and _SIMPLE(text) is not None].append((part, text))
        if words:
            out.update(zip([p for p, _ in words], self._words([t for _, t in words])))
        for tokenizer, group, change in ((self.tokenizer, groups[0], str), (self.plain, groups[1], str.lower)):
            for at in range(0, len(group), JOINED_PARTS):
                some = group[at:at + JOINED_PARTS]
                joined = self.separator.join([change(text) for _, text in some])
                ids = np.array(self._ids(tokenizer, joined), dtype=self.dtype)
                cuts, size = np.flatnonzero(ids == self.separator_id), self.dtype.itemsize
                raw, starts = ids.tobytes(), [0, *((cuts + 1) * size).tolist()]
                ends = [*(cuts * size).tolist(), len(raw)]
                out.update((part, raw[a:b]) for (part, _), a, b in zip(some, starts, ends))
        return out

    @staticmethod
    def _ids(tokenizer, text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def forget(self) -> None:
        """Drop the encoded parts, as idle workers stay beside the executor."""
        self.known = {b"": b""}

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of the texts, in the file's width."""
        return [ids for first, last in text_groups(texts) for ids in self._encode_group(texts[first:last])]

    def _encode_group(self, texts: list[bytes]) -> list[bytes]:
        """Parts are cut and numbered as arrays; only a group's distinct parts are looked up or encoded."""
        joined = b"\n".join(texts) + b"\n"
        data = np.frombuffer(joined, dtype=np.uint8)
        at = np.flatnonzero(_part_starts(data))
        parts = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(np.append(at, len(data)).astype(np.int32)), pa.py_buffer(joined)])
        coded = parts.dictionary_encode()
        offsets = np.frombuffer(coded.dictionary.buffers()[1], dtype=np.int32)[:len(coded.dictionary) + 1]
        raw = coded.dictionary.buffers()[2].to_pybytes()
        stops = offsets[1:] - _BLANK[np.frombuffer(raw, dtype=np.uint8)[offsets[1:] - 1]]
        distinct = [raw[a:b] for a, b in zip(offsets.tolist(), stops.tolist())]
        new = list({p for p in distinct if p not in self.known})
        if len(self.known) + len(new) > CACHED_WORDS:
            self.forget()
            new = list({p for p in distinct if p})
        found = self._new(new)
        self.known.update((p, v) for p, v in found.items() if len(p) <= CACHED_BYTES)
        packed = [self.known[p] if p in self.known else found[p] for p in distinct]
        ids = np.frombuffer(b"".join(packed), dtype=self.dtype)
        bounds = np.cumsum([0, *map(len, packed)]) // self.dtype.itemsize
        which = coded.indices.to_numpy().astype(np.int64)
        sizes = np.diff(bounds)[which]
        out = ids[spread(bounds[which], sizes)]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.concatenate(([0], np.cumsum(sizes)))[np.searchsorted(at, starts)].tolist()
        return [out[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_shards(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode and write (doc_id, text) in ascending order of doc_id; gives the manifest with every shard's ``base``."""
    make_folder(folder)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange("doc_id")
    ordered = ordered.sortWithinPartitions("doc_id", "text")

    def task(batches):
        coder = encoder(path or default_path())
        name, out = f"{folder}/{uuid.uuid4().hex}", {}
        end, width, at, documents = np.array([end_id], dtype=coder.dtype).tobytes(), coder.dtype.itemsize, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not out:
                files, place = store(name)
                out = {k: files.open_output_stream(f"{place}.{k}", compression=None) for k in ("bin", "idx", "ids")}
                out["idx"].write(np.zeros(1, dtype="<u8").tobytes())
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                packed = coder.encode_batch(text_bytes(part.column("text")))
                ends = at + np.cumsum([len(p) // width + 1 for p in packed])
                out["bin"].write(end.join(packed) + end)
                out["idx"].write(ends.astype("<u8").tobytes())
                out["ids"].write(part.column("doc_id").fill_null(NO_ID).to_numpy().astype("<i8").tobytes())
                at, documents = int(ends[-1]), documents + part.num_rows
        coder.forget()
        for file in out.values():
            file.close()
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([name]), pa.array([width], pa.int32()),
                 pa.array([documents], pa.int64()), pa.array([at], pa.int64())],
                names=["part", "shard", "width", "documents", "tokens"])

    manifest = materialise(with_column_batches(ordered, ["doc_id", "text"], MANIFEST, task), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return materialise(manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long"))), "token-bases")


def opened(uri: str) -> pa.NativeFile:
    """A shard's file, mapped into memory where that is possible."""
    files, path = store(uri)
    return pa.memory_map(path) if files.type_name == "local" else files.open_input_file(path)


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts over all shards."""
    step = READ_DOCUMENTS
    ranges = manifest.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("documents") - 1, F.lit(step).cast("long"))))
    # tasks by the ids to read, as the rows that name them are few
    tokens = manifest.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    ranges = ranges.repartition(1 + tokens // TASK_TOKENS, "shard", "first")

    def task(batches):
        for batch in batches:
            for row in batch.to_pylist():
                count = min(step, row["documents"] - row["first"])
                with opened(row["shard"] + ".idx") as f:
                    bounds = np.frombuffer(f.read_at(8 * (count + 1), 8 * row["first"]), dtype="<u8").astype(np.int64)
                with opened(row["shard"] + ".ids") as f:
                    ids = np.frombuffer(f.read_at(8 * count, 8 * row["first"]), dtype="<i8")
                sums = []
                with opened(row["shard"] + ".bin") as f:
                    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                        raw = f.read_at((b - a) * row["width"], a * row["width"])
                        sums.append(zlib.crc32(np.frombuffer(raw, dtype=f"<u{row['width']}").astype("<u4").tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, mask=ids == NO_ID), pa.array(bounds[:-1] + row["base"]), pa.array(np.diff(bounds)),
                     pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return with_column_batches(ranges, ["shard", "width", "documents", "base", "first"],
                               "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", task)


@query("op5_token_files")
def token_files(spark: SparkSession, folder: str):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return read_documents(write_shards(docs, fresh_folder(spark, "tokens")))
