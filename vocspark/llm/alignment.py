"""Alignment of two tokenizers over the bytes of each document.

Both tokenizers split the same bytes, so the places where tokens of both end cut a document into groups, and two tokens are linked
where their bytes overlap.  A batch is an Arrow pipeline: the id lists are flattened with their parent indices; segmented cumulative sums of token
lengths give every token's end in its document; a full outer Acero join of both sides on the key (document, end) gives one row for each
stretch between neighbouring ends.  In order of the key, filling backwards names the tokens over each stretch: every row is one link, rows
with an end on both sides close a group.  ``Table.group_by`` counts the links of each id pair.

Spark merges the partial counts.  A task writes its documents' links, as numbers of the pairs of a batch, to a file in the shared folder and gives the
pairs of the file (a chunk) with their counts; these are summed over the corpus, the highest count of each B id is found, and the totals go back to
the chunk that asked for them.  So one row for each pair of a chunk moves, never one for each link, and no count is broadcast.  A common pair
has one row for each chunk.  Only files of the committed report count, so a task run again after a lost executor does no harm.

A (byte-level BPE) encodes a blank and the text, B (sentence pieces) the text, to which it adds the blank; special tokens' strings are plain text.
Null and empty texts, and texts whose bytes B changes (those with U+2581), have no tokens: zeros and an empty string.  Repeated
rows are counted each time; an empty table gives no rows; rows without an id stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.llm import sentence_pieces
from vocspark.llm.bpe import LATER_NUMBERS, PATTERN, byte_characters, default_path
from vocspark.llm.common import fresh_folder, make_folder, materialise, store, table, text_bytes, with_column_batches
from vocspark.llm.pair_merges import PairTable, merge_words, spread
from vocspark.llm.registry import query

# Bytes of text in a batch, and links in a chunk (a file with one set of pairs).
BATCH_BYTES = 1 << 21
CHUNK_LINKS = 1 << 25
# Row of a chunk's pairs that every chunk has, so that chunks without links are seen.
NO_PAIR = -1
REPORT = "chunk bigint, pair bigint, n bigint"
DOCUMENTS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


class ByteModel:
    """A byte-level BPE vocabulary for encoding many parts at once."""

    def __init__(self, path: str):
        import regex
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        ids = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        self.size = 1 + max(ids.values())
        self.lengths = np.zeros(self.size, dtype=np.int64)
        for text, i in ids.items():
            self.lengths[i] = len(text)  # one character stands for one byte
        self.of_byte = np.zeros(256, dtype=np.int64)
        for c, b in byte_of.items():
            self.of_byte[b] = ids[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.pairs = PairTable([ids[a] for a, _ in merges], [ids[b] for _, b in merges], range(len(merges)), [ids[a + b] for a, b in merges])
        numbers = rf"[\p{{N}}--[{LATER_NUMBERS}]]"
        self.split = regex.compile("(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{L}}{numbers}]").replace(r"?\p{N}", "?" + numbers)).findall
        self.split_plain, self.space = regex.compile(PATTERN).findall, regex.compile(r"\s").match

    def encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many parts, and where each part's begin and how many there are.

        Parts begin with white space and all but a text's last end with something else, where the pattern always cuts: these are split in one
        string.  Parts that end in white space would melt into the next one and are split alone.
        """
        texts = [t.decode("utf-8") for t in parts.to_pylist()]
        tails = [k for k, t in enumerate(texts) if self.space(t[-1])]
        order = np.concatenate((np.setdiff1d(np.arange(len(texts)), tails), np.array(tails, dtype=np.int64))).astype(np.int64)
        whole = "".join(texts[k] for k in order[:len(texts) - len(tails)].tolist())
        pieces = (self.split_plain if whole.isascii() else self.split)(whole)
        ends = np.cumsum(np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces)))
        part_ends = np.cumsum([len(texts[k]) for k in order[:len(texts) - len(tails)].tolist()])
        last = (np.searchsorted(ends, part_ends) + 1).tolist()
        for k in tails:
            pieces += self.split(texts[k])
            last.append(len(pieces))
        coded = pa.array(pieces, pa.string()).cast(pa.binary()).dictionary_encode()
        ids, at = merge_words(*self._bytes_of(coded.dictionary), self.pairs)
        which = coded.indices.to_numpy().astype(np.int64)
        sizes = np.diff(at)[which]
        out = ids[spread(at[which], sizes)]
        bounds = np.concatenate(([0], np.cumsum(sizes)))[np.array([0, *last])]
        starts, counts = np.empty(len(texts), dtype=np.int64), np.empty(len(texts), dtype=np.int64)
        starts[order], counts[order] = bounds[:-1], np.diff(bounds)
        return out, starts, counts

    def _bytes_of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds = np.frombuffer(pieces.buffers()[1], dtype=np.int32)[pieces.offset:pieces.offset + len(pieces) + 1].astype(np.int64)
        raw = np.frombuffer(pieces.buffers()[2] or b"", dtype=np.uint8)[bounds[0]:bounds[-1]]
        return self.of_byte[raw], bounds - bounds[0]


class Pair:
    """Both vocabularies with what aligning needs."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteModel(path_a), sentence_pieces.model(path_b)
        self.width = len(self.b.texts)
        self.lengths = {"a": pa.array(self.a.lengths), "b": pa.array(self.b.sizes)}
        # How an id is written inside a group and at the end of its side of the group.
        signs = [(str(i) + ",", str(i) + "|") for i in range(self.a.size)] + [(str(i) + ",", str(i) + ";") for i in range(self.width)]
        self.written = pa.array([w for both in signs for w in both], pa.string())

    def lists(self, texts: list[bytes]) -> dict[str, pa.ListArray]:
        """The id lists of both sides; a text without tokens has empty ones."""
        ready = [b" " + t if t and sentence_pieces.SIGN not in t else b"" for t in texts]
        parts, first = self.b.parts_of(ready)
        coded = parts.dictionary_encode()
        which = coded.indices.to_numpy().astype(np.int64)
        ids_b, bounds = self.b.encode_parts(coded.dictionary)
        found = {"a": self.a.encode_parts(coded.dictionary), "b": (ids_b, bounds[:-1], np.diff(bounds))}
        out = {}
        for side, (ids, starts, counts) in found.items():
            sizes = counts[which]
            offsets = np.concatenate(([0], np.cumsum(sizes)))[first]
            out[side] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[spread(starts[which], sizes)], pa.int64()))
        return out

    def ends(self, lists: pa.ListArray, side: str) -> pa.Table:
        """(key, id) of every token: the key is its document and where its bytes end there."""
        ids, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        total = pc.cumulative_sum(self.lengths[side].take(ids))
        before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(lists.offsets)
        end = pc.subtract(total, before.take(parent))
        return pa.table({"key": pc.bit_wise_or(pc.shift_left(parent.cast(pa.int64()), pa.scalar(36, pa.int64())), end), side: ids})

    def align(self, texts: list[bytes], keep_groups: bool = False) -> tuple[dict[str, pa.Array], pa.Table]:
        """Columns for the documents of a batch, with ``links`` as numbers of pairs, and the (pair, n) of the batch in that numbering."""
        lists = self.lists(texts)
        both = self.ends(lists["a"], "a").join(self.ends(lists["b"], "b"), "key", join_type="full outer", use_threads=False)
        both = both.take(pc.sort_indices(both["key"])).combine_chunks()
        text_of = both["key"].to_numpy() >> 36
        in_a, in_b = (pc.is_valid(both[s]).to_numpy(zero_copy_only=False) for s in "ab")
        over = {s: pc.fill_null_backward(both[s]) for s in "ab"}
        coded = pa.array(over["a"].to_numpy() * self.width + over["b"].to_numpy(), pa.int64()).dictionary_encode()
        counted = pa.table({"number": coded.indices}).group_by("number", use_threads=False).aggregate([([], "count_all")])
        n = len(texts)
        links = np.bincount(text_of, minlength=n)
        columns = {"n_a": pa.array(np.diff(lists["a"].offsets.to_numpy()), pa.int64()), "n_b": pa.array(np.diff(lists["b"].offsets.to_numpy()), pa.int64()),
                   "n_groups": pa.array(np.bincount(text_of[in_a & in_b], minlength=n)), "n_links": pa.array(links)}
        written = list(self.groups(over["a"].to_numpy(), over["b"].to_numpy(), in_a, in_b,
                                   lists["a"].offsets.to_numpy().astype(np.int64) + lists["b"].offsets.to_numpy()))
        columns["groups_sha256"] = pa.array([hashlib.sha256(w).hexdigest() if len(w) else "" for w in written], pa.string())
        if keep_groups:
            columns["groups"] = pa.array([bytes(w) for w in written], pa.binary()).cast(pa.string())
        columns["links"] = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(links))), pa.int32()), coded.indices.cast(pa.int32()))
        return columns, pa.table({"pair": coded.dictionary.take(counted["number"]), "n": counted["count_all"], "number": counted["number"]})

    def groups(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, bounds: np.ndarray) -> Iterator[memoryview]:
        """``a1,a2|b1;…`` of every text: each token's written form is put at its place and Arrow joins them."""
        closes = in_a & in_b
        seen_a, seen_b = np.cumsum(in_a), np.cumsum(in_b)
        group, at = np.cumsum(closes) - closes, np.flatnonzero(closes)
        codes = np.empty(int(bounds[-1]), dtype=np.int64)
        codes[(seen_a - 1 + np.concatenate(([0], seen_b[at]))[group])[in_a]] = 2 * a[in_a] + closes[in_a]
        codes[(seen_b - 1 + seen_a[at][group])[in_b] if len(at) else []] = 2 * (b[in_b] + self.a.size) + closes[in_b]
        joined = self.written.take(pa.array(codes))
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int32)[:len(codes) + 1] if len(codes) else np.zeros(1, dtype=np.int32)
        data = memoryview(joined.buffers()[2]) if len(codes) else memoryview(b"")
        for first, last in zip(ends[bounds[:-1]].tolist(), ends[bounds[1:]].tolist()):
            yield data[first:max(first, last - 1)]


@lru_cache(maxsize=1)
def vocabularies(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class ChunkFile:
    """One file of documents with their links, and the counts of its pairs."""

    def __init__(self, folder: str, schema: pa.Schema):
        self.number = uuid.uuid4().int >> 65
        files, path = store(f"{folder}/{self.number:016x}")
        self.file = files.open_output_stream(path, compression=None)
        self.writer = pa.ipc.new_stream(self.file, schema, options=pa.ipc.IpcWriteOptions(compression="zstd"))
        self.schema, self.counts = schema, []
        self.links = self.waiting = 0

    def add(self, doc_ids: pa.Array, columns: dict[str, pa.Array], counts: pa.Table) -> None:
        by_number = np.empty(counts.num_rows, dtype=np.int64)
        by_number[counts["number"].to_numpy()] = counts["pair"].to_numpy()
        pairs = pa.array([by_number] + [None] * (len(doc_ids) - 1), pa.list_(pa.int64()))  # once for the batch
        self.writer.write_batch(pa.RecordBatch.from_pydict({"doc_id": doc_ids, **columns, "pairs": pairs}, schema=self.schema))
        self.counts.append(counts.select(["pair", "n"]))
        self.links, self.waiting = self.links + len(columns["links"].values), self.waiting + counts.num_rows
        if self.waiting > 1 << 22:
            self._add_up()

    def _add_up(self) -> None:
        total = pa.concat_tables(self.counts).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        self.counts, self.waiting = [total.rename_columns(["pair", "n"])], 0

    def close(self) -> Iterator[pa.RecordBatch]:
        """The report: counts of all pairs, after one row for the file itself."""
        self.writer.close()
        self.file.close()
        self._add_up()
        own = pa.table({"pair": pa.array([NO_PAIR]), "n": pa.array([0])})
        both = pa.concat_tables([own, self.counts[0].cast(own.schema)])
        chunk = pa.array(np.full(both.num_rows, self.number))
        yield from pa.table({"chunk": chunk, "pair": both["pair"], "n": both["n"]}).to_batches(max_chunksize=100_000)


def batches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about BATCH_BYTES of text; a long text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text").cast(pa.large_binary())), 0).to_numpy()
        start = size = 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and size + n > BATCH_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if batch.num_rows:
            yield batch.slice(start)


def write_links(docs: DataFrame, folder: str, path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False) -> DataFrame:
    """Align (doc_id, text), write the links to files of ``folder``; gives the report (chunk, pair, n)."""
    make_folder(folder)
    schema = file_schema(keep_groups)

    def task(batches):
        two, chunk = vocabularies(path_a or default_path(), path_b or sentence_pieces.default_path()), None
        for batch in batches_of(batches):
            chunk = chunk or ChunkFile(folder, schema)
            chunk.add(batch.column("doc_id"), *two.align(text_bytes(batch.column("text")), keep_groups))
            if chunk.links >= CHUNK_LINKS:
                yield from chunk.close()
                chunk = None
        if chunk:
            yield from chunk.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(with_column_batches(rows, ["doc_id", "text"], REPORT, task), "alignment-report")


def file_schema(keep_groups: bool) -> pa.Schema:
    fields = [("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string())]
    return pa.schema(fields + [("groups", pa.string())] * keep_groups + [("links", pa.list_(pa.int32())), ("pairs", pa.list_(pa.int64()))])


def pair_counts(report: DataFrame, width: int) -> DataFrame:
    """(pair, total, best): links of each pair in the corpus, and whether its B id has no pair with more.

    The highest counts are one row for each B id, so at most as many as the vocabulary has.
    """
    totals = materialise(report.filter(F.col("pair") != NO_PAIR).groupBy("pair").agg(F.sum("n").alias("total")), "alignment-totals")
    totals = totals.withColumn("b", F.col("pair") % width)
    most = totals.groupBy("b").agg(F.max("total").alias("most"))
    return totals.join(F.broadcast(most), "b").select("pair", "total", (F.col("total") == F.col("most")).alias("best"))


def read_links(report: DataFrame, counts: DataFrame, folder: str, keep_groups: bool = False) -> DataFrame:
    """The documents of all chunks with ``n_best`` and ``count_sum``; a task holds the totals of one chunk's pairs."""
    chunks = report.filter(F.col("pair") == NO_PAIR).count()
    asked = report.select("chunk", "pair").join(counts, "pair", "left").repartition(max(1, chunks), "chunk").sortWithinPartitions("chunk", "pair")
    names = [n for n in file_schema(keep_groups).names if n not in ("links", "pairs")]

    def finish(chunk, pairs, totals, best):
        files, path = store(f"{folder}/{chunk:016x}")
        with files.open_input_stream(path, compression=None) as file, pa.ipc.open_stream(file) as reader:
            for batch in reader:
                links = batch.column("links")
                where = np.searchsorted(pairs, batch.column("pairs")[0].values.to_numpy())
                numbers, bounds = links.values.to_numpy(), links.offsets.to_numpy()
                sums = [np.diff(np.concatenate(([0], np.cumsum(x[where][numbers])))[bounds]) for x in (best.astype(np.int64), totals)]
                yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(s, pa.int64()) for s in sums], names=[*names, "n_best", "count_sum"])

    def task(batches):
        current, held = None, []
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(chunk)]
            for first, last in zip(cuts[:-1], cuts[1:]):
                if last == first:
                    continue
                if current is not None and chunk[first] != current:
                    yield from finish(current, *_columns(held))
                    held = []
                current = int(chunk[first])
                held.append(batch.slice(first, last - first))
        if held:
            yield from finish(current, *_columns(held))

    shown = DOCUMENTS + ", groups string" * keep_groups + ", n_best bigint, count_sum bigint"
    return with_column_batches(asked, ["chunk", "pair", "total", "best"], shown, task)


def _columns(held: list[pa.RecordBatch]) -> list[np.ndarray]:
    whole = pa.Table.from_batches(held)
    return [pc.fill_null(whole[c], v).to_numpy() for c, v in (("pair", 0), ("total", 0), ("best", False))]


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents with their alignment figures (and, if asked for, ``groups``), and the id pairs of the corpus with their counts.

    The paths must exist on driver and executors; null is the installed public vocabulary.
    """
    folder = fresh_folder(docs.sparkSession, "alignment")
    report = write_links(docs, folder, path_a, path_b, keep_groups)
    width = len(sentence_pieces.model(path_b or sentence_pieces.default_path()).texts)
    counts = pair_counts(report, width)
    named = counts.select(F.floor(F.col("pair") / width).alias("a_id"), (F.col("pair") % width).alias("b_id"), F.col("total").alias("n"), "best")
    return read_links(report, counts, folder, keep_groups), named


@query("op12_tokenizer_alignment")
def tokenizer_alignment(spark: SparkSession, folder: str):
    documents, _ = align(table(spark, folder, "documents").select("doc_id", "text"))
    return documents.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
