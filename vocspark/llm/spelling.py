"""Spelling variants: words that differ by one character, and the frequent form each rare one stands for.

The vocabulary is counted by Spark.  Every word is then looked up through its edits: single deletions, and replacements by letters of the vocabulary
that come later in code-point order.  The other edits need not be made, since a pair is near from both sides.  An edit is a number, not a
string: the word's polynomial hash with one term changed, so millions are made a second in NumPy.  They probe blocked Bloom filters, one
for each word length (a deletion asks the shorter length's, a replacement its own), which tasks read from the shared folder.  Only positives shuffle, as pairs of hashes:
an exact join with the vocabulary by hash, then by the words themselves, removes the filters' false positives and any equal hashes.

A filter has 16 bits for each word of its length, at most FILTER_BLOCKS blocks of 64 bits (16 MB); the words of a task are sorted by length, so a task
holds two filters at a time.  Beyond some 8 million words of one length the filters pass more false positives, which costs shuffle and
no result.  Words of LONG_FROM characters and more share a filter.

Null texts have no words; a null id counts as the empty text in the choice of the runs that lose a character.  Repeated rows count each time, empty
tables give no rows, extra columns are ignored.  Runs of any length are taken whole.  Of near words with equal counts the smallest in code-point order is the form.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vocspark.llm.common import fresh_folder, make_folder, materialise, mix64, store, table, with_column_batches
from vocspark.llm.registry import query

# Fixed values of the word rule.
LETTER = r"[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DELETED_OF = 31
LEAST_LENGTH, LEAST_COUNT, FORM_FACTOR = 7, 2, 10

LONG_FROM = 64
WORDS_A_BLOCK = 4
FILTER_BLOCKS = 1 << 21
PROBES = 6
# Words for each probing task, edits that are probed at a time, and letters before a very long word is done in pieces.
TASK_WORDS = 20_000
AT_ONCE = 1 << 16

_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_BASE = 0x9FB21C651E98DF25
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
_BLOCK, _BITS = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x9E3779B97F4A7C15)
VOCABULARY = "word string, n bigint, length int, h bigint"
POSITIVES = "h bigint, edited bigint, at int, letter string"


def occurrences(docs: DataFrame, least_length: int = 1) -> DataFrame:
    """(word): every run of a document, in lower case and with the character that its checksum takes away.

    Shorter runs than ``least_length`` are left out at once, since a run only gets shorter.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all("text", F.lit(f"{LETTER}{{{least_length},}}"), F.lit(0))).alias("run"))
    plain = F.octet_length("run") == F.char_length("run")
    runs = runs.select(F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, LOWER)).alias("run"), "id")
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.expr("substring(run, cast(h % char_length(run) AS int) + 2)"))
    return runs.select(F.when(F.col("h") % DELETED_OF == 0, cut).otherwise(F.col("run")).alias("word"))


def letters_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points (all under 256) of the words, one after the other, and the words' bounds."""
    found = [w.encode("latin-1") for w in words.to_pylist()]
    return np.frombuffer(b"".join(found), dtype=np.uint8), np.cumsum([0, *map(len, found)])


def powers(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(_BASE))
    out[:1] = 1
    return np.multiply.accumulate(out)


def hashes(letters: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Polynomial hash of every word: the sum of value(letter) * base ** place."""
    lengths = np.diff(bounds)
    place = np.arange(len(letters)) - np.repeat(bounds[:-1], lengths)
    total = np.zeros(len(letters) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[letters] * powers(int(lengths.max()) if len(lengths) else 0)[place], out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n, length, h): the words in question with their counts and hashes, as a table."""
    words = occurrences(docs, least_length).filter(F.char_length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    words = words.filter(F.col("n") >= least_count)

    def task(batches):
        for batch in batches:
            letters, bounds = letters_of(batch.column("word"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), batch.column("n"), pa.array(np.diff(bounds), pa.int32()), pa.array(hashes(letters, bounds).view(np.int64))],
                names=["word", "n", "length", "h"])

    return materialise(with_column_batches(words, ["word", "n"], VOCABULARY, task), "spelling-words")


def shard_of(length):
    """The filter that knows words of a length; works for numbers and columns."""
    return F.least(length, F.lit(LONG_FROM)) if isinstance(length, F.Column) else min(length, LONG_FROM)


def block_counts(words: DataFrame) -> dict[int, int]:
    """Blocks (a power of two) of every filter; one row for each length under LONG_FROM reaches the driver."""
    sizes = words.groupBy(shard_of(F.col("length")).alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["shard"]: min(FILTER_BLOCKS, 1 << max(0, (r["n"] // WORDS_A_BLOCK)).bit_length()) for r in sizes}


def places(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of every hash, and the number that chooses its bits there."""
    mixed = (h ^ (h >> np.uint64(29))) * _BLOCK
    mixed ^= mixed >> np.uint64(32)
    return (mixed & np.uint64(blocks - 1)).astype(np.int64), mixed * _BITS


def bit_of(chosen: np.ndarray, k: int) -> np.ndarray:
    return chosen >> np.uint64(58 - 6 * k) & np.uint64(63)


def write_filters(words: DataFrame, blocks: dict[int, int], folder: str) -> dict[int, str]:
    """One file of 64-bit blocks for each length: partial blocks of a batch are joined by OR, in Spark and in the one task of a length.

    Gives the file of every filter.  A task that is run again writes a file of its own, and only the reported ones are read.
    """
    make_folder(folder)

    def partial(batches):
        for batch in batches:
            length, h = batch.column("length").to_numpy(), batch.column("h").to_numpy().view(np.uint64)
            shard = np.minimum(length, LONG_FROM)
            for s in np.unique(shard).tolist():
                block, chosen = places(h[shard == s], blocks[s])
                mask = np.zeros(len(block), dtype=np.uint64)
                for k in range(PROBES):
                    mask |= np.uint64(1) << bit_of(chosen, k)
                order = np.argsort(block, kind="stable")
                block, mask = block[order], mask[order]
                first = np.flatnonzero(np.diff(block, prepend=-1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(first), s), pa.int32()), pa.array(block[first]), pa.array(np.bitwise_or.reduceat(mask, first).view(np.int64))],
                    names=["shard", "block", "mask"])

    def save(batches):
        shard, held = None, None
        for batch in batches:
            column = batch.column("shard").to_numpy()
            for s in np.unique(column).tolist():  # sorted by shard
                if s != shard:
                    if held is not None:
                        yield _written(folder, shard, held)
                    shard, held = s, np.zeros(blocks[s], dtype=np.uint64)
                here = column == s
                held[batch.column("block").to_numpy()[here]] |= batch.column("mask").to_numpy()[here].view(np.uint64)
        if held is not None:
            yield _written(folder, shard, held)

    parts = with_column_batches(words, ["length", "h"], "shard int, block bigint, mask bigint", partial)
    joined = parts.groupBy("shard", "block").agg(F.bit_or("mask").alias("mask"))
    ready = joined.repartition(max(1, len(blocks)), "shard").sortWithinPartitions("shard")
    return {r["shard"]: r["place"] for r in with_column_batches(ready, ["shard", "block", "mask"], "shard int, place string", save).collect()}


def _written(folder: str, shard: int, held: np.ndarray) -> pa.RecordBatch:
    place = f"{folder}/{shard}-{uuid.uuid4().hex}"
    files, path = store(place)
    with files.open_output_stream(path, compression=None) as out:
        out.write(held.astype("<u8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([place])], names=["shard", "place"])


@lru_cache(maxsize=2)
def load_filter(place: str) -> np.ndarray:
    files, path = store(place)
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype="<u8")


def passes(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of the hashes that the filter may hold."""
    block, chosen = places(h, len(filter_))
    held = filter_[block]
    left = np.flatnonzero(held >> bit_of(chosen, 0) & np.uint64(1))
    for k in range(1, PROBES):
        left = left[(held[left] >> bit_of(chosen[left], k) & np.uint64(1)).astype(bool)]
    return left


def edits(codes: np.ndarray, letters: np.ndarray, known: dict[int, str], load) -> Iterator[tuple]:
    """Positive edits of words of one length (a matrix of code points): row, place, new letter (0: deleted), hash of the edit."""
    count, length = codes.shape
    up = powers(length)
    terms = _VALUES[codes] * up
    whole = terms.sum(axis=1, dtype=np.uint64)
    shorter = shard_of(length - 1)
    if shorter in known:
        upto = np.cumsum(terms, axis=1, dtype=np.uint64)
        made = (upto - terms + (whole[:, None] - upto) * _INVERSE).ravel()
        # of equal neighbours only the first need go
        wanted = np.ones(codes.shape, dtype=bool)
        wanted[:, 1:] = codes[:, 1:] != codes[:, :-1]
        at = np.flatnonzero(wanted.ravel())
        found = at[passes(load(shorter), made[at])]
        yield found // length, found % length, np.zeros(len(found), dtype=np.uint8), made[found]
    own, without = load(shard_of(length)), (whole[:, None] - terms).ravel()
    flat, place = codes.ravel(), np.tile(up, count)
    for letter in letters.tolist():
        at = np.flatnonzero(flat < letter)
        made = without[at] + _VALUES[letter] * place[at]
        found = passes(own, made)
        yield at[found] // length, at[found] % length, np.full(len(found), letter, dtype=np.uint8), made[found]


def positives(words: DataFrame, filters: dict[int, str], letters: str) -> DataFrame:
    """(h, edited, at, letter): hashes of a word and of an edit that some filter may hold, with the edit itself."""
    sorted_letters = np.array(sorted(map(ord, letters)), dtype=np.uint8)
    tasks = max(1, sum(r["n"] for r in words.agg(F.count(F.lit(1)).alias("n")).collect()) // TASK_WORDS)
    ready = words.select("length", "h", "word").repartition(tasks, "h").sortWithinPartitions("length")

    def task(batches):
        for batch in batches:
            points, bounds = letters_of(batch.column("word"))
            length, h = np.diff(bounds), batch.column("h").to_numpy()
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                for some in np.array_split(rows, max(1, -(-len(rows) * n // AT_ONCE))):
                    if not len(some):
                        continue
                    codes = points[bounds[some][:, None] + np.arange(n)]
                    for row, at, letter, made in edits(codes, sorted_letters, filters, lambda s: load_filter(filters[s])):
                        if len(row):
                            signs = letter.tobytes().decode("latin-1")
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(h[some][row]), pa.array(made.view(np.int64)), pa.array(at, pa.int32()),
                                 pa.array([c if c != "\0" else "" for c in signs], pa.string())], names=["h", "edited", "at", "letter"])

    return with_column_batches(ready, ["word", "h"], POSITIVES, task)


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): all pairs of words that differ by one character, in both directions."""
    spark = words.sparkSession
    folder, blocks = fresh_folder(spark, "spelling-filters"), block_counts(words)
    filters = write_filters(words, blocks, folder)
    # At most the 90 letters of the word rule.
    letters = "".join(r["c"] for r in words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c")).distinct().collect() if r["c"])
    found = positives(words, filters, letters)
    other = words.select(F.col("h").alias("edited"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    hits = found.join(other, "edited").select("h", "at", "letter", "near", "near_n")
    edited = F.concat(F.expr("substring(word, 1, at)"), F.col("letter"), F.expr("substring(word, at + 2)"))
    one_way = materialise(hits.join(words.select("h", "word", "n"), "h").filter(edited == F.col("near")).select("word", "n", "near", "near_n"), "spelling-pairs")
    return one_way.unionByName(one_way.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words with a form: pointers are doubled until none moves.

    A form is at least FORM_FACTOR times as frequent, so chains are short and end.
    """
    step = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialise(step.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
                            "spelling-roots")
        step = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return step


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FORM_FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with at least the given length and count."""
    words = vocabulary(docs, least_length, least_count)
    best = near_pairs(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("first"))
    known = words.select("word", "n").join(best, "word", "left")
    takes = -F.col("first.less") >= F.col("n") * factor
    known = materialise(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(takes, F.col("first.near")).alias("form"),
                                     F.when(takes, -F.col("first.less")).alias("form_n")), "spelling-forms")
    ends = roots(known.filter(F.col("form").isNotNull()))
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


SQL = f"""WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
   CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
dist AS (SELECT doc_id, run, count(*) AS times FROM runs GROUP BY ALL),
crc AS (SELECT run, times, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''),
   lambda s: CASE WHEN unicode(s) < 128 THEN [CAST(unicode(s) AS BIGINT)] ELSE [192 | (unicode(s) >> 6), 128 | (unicode(s) & 63)] END))),
   lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM dist, tab),
occ AS (SELECT CASE WHEN h % {DELETED_OF} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM crc),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n, length(word) AS len FROM occ WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(times) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, len, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(len)) AS i FROM words)),
pairs AS (SELECT DISTINCT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.len = b.len AND a.word < b.word),
near AS (SELECT a AS word, an AS n, b AS near, bn AS near_n FROM pairs UNION ALL SELECT b, bn, a, an FROM pairs),
best AS (SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY ALL),
forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {FORM_FACTOR} * words.n THEN near END AS form,
  CASE WHEN near_n >= {FORM_FACTOR} * words.n THEN near_n END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (WITH RECURSIVE c AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL
  SELECT c.word, f.form, step + 1 FROM c JOIN forms f ON c.root = f.word WHERE f.form IS NOT NULL) SELECT word, arg_max(root, step) AS root FROM c GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN chain USING (word)"""


@query("op11_spelling_variants", SQL)
def spelling_variants(spark: SparkSession, folder: str):
    return variants(table(spark, folder, "documents").select("doc_id", "text"))
