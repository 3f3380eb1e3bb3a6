"""Which of very many keywords a text contains, as a join: no keyword list in the plan, no bound on its size.

Keywords of at most six code points are looked up by hash from every place of a text (``short_keywords``).  Every longer keyword is filed under the rarest of its grams (runs of ``GRAM`` code points; a shorter keyword is its own gram), by how often the gram occurs in the
documents.  A document offers its grams, each in a window with the code points around it; those under which no keyword is filed are dropped inside the task by
a bitmap of fixed size, and the rest meet the keywords in a join that deals frequent grams over many tasks.  The window shows whether the rest
of the keyword stands around the gram, so no text moves.  Only keywords that reach beyond the window are confirmed by ``contains`` on the whole text.

The work grows with the length of a text, not with its square; long texts are read in overlapping pieces.  A keyword with a gram that occurs nowhere goes no further.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocspark.functions.common import col
from vocspark.operators.short_keywords import LONGEST, parts_of, save_parts, short_pairs
from vocspark.operators.spread_join import SHARE, spread_join
from vocspark.session import scratch_path

GRAM = 5
# Code points around a gram that its window holds on either side, at most; no more than the longest keyword needs.
AROUND = 16
# Stands before the start of a text; keywords that hold it are confirmed on the whole text.
PAD = "\uffff"
PIECE = 1 << 16
# Places of a bitmap of grams: a constant of one megabyte, whatever the number of keywords.
BITS = 1 << 23
# So many keys that stand in several rows, or fewer, are broadcast; with more, the pairs of all keys meet.
REPEATED_KEYS = 100_000


def _runs(text: Column, pattern: str) -> Column:
    """What the pattern finds from every code point, in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=({pattern}))"), F.lit(1))


def _pieces(texts: DataFrame, gram: int, around: int) -> DataFrame:
    """(key, piece): texts cut so that every gram and its surroundings lie whole in the piece in which the gram starts."""
    padded = F.concat(F.lit(PAD * around), "t")
    last = F.floor((F.length("t") - 1) / PIECE).cast("int")
    cut = texts.select("key", padded.alias("p"), F.explode(F.sequence(F.lit(0), last)).alias("i"))
    return cut.select("key", F.substring("p", F.col("i") * PIECE + 1, F.lit(PIECE - 1 + 2 * around + gram)).alias("piece"))


def _windows(size: int, around: int) -> Column:
    """Grams of the piece with what stands around them; a gram that starts in the next piece may be offered twice."""
    return _runs(F.col("piece"), f".{{{around}}}.{{{size}}}.{{0,{around}}}")


def _gram_of(window: Column, size: int, around: int) -> Column:
    return F.substring(window, around + 1, size)


def _place(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BITS))


def _passes(grams: DataFrame) -> Callable[[Column], Column]:
    """A test of a gram against the bitmap of ``grams``; at most ``BITS / 64`` numbers reach the driver."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    numbers = grams.select(_place(F.col("gram")).alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(bit).alias("bits")).collect()
    table = ["0"] * (BITS // 64)
    for r in numbers:
        table[r["at"]] = str(r["bits"])
    bitmap = F.split(F.lit(",".join(table)), ",").cast("array<bigint>")

    def test(gram: Column) -> Column:
        place = _place(gram)
        word = F.get(bitmap, F.shiftright(place, 6).cast("int"))
        bit = F.call_function("shiftrightunsigned", word, (place % 64).cast("int"))
        return bit.bitwiseAND(F.lit(1).cast("long")) == 1

    return test


def keyword_pairs(docs: DataFrame, key: str, text: Column | str, keywords: DataFrame, word: str = "keyword", gram: int = GRAM, share: int = SHARE,
                  carry: str | None = None, named: bool = True) -> DataFrame:
    """(key, keyword) for every lower-case keyword contained in the lower-case text, each pair once.

    ``key`` should be unique and not null; the rows of a repeated key count as one text.  Keywords are taken in lower case, equal ones once; null and empty keywords match nothing, as do null texts.
    ``docs`` is read up to three times and should be a table.  ``carry`` names a column of whole numbers of ``keywords``, one for each keyword in lower case,
    that the pairs have too, so that they need not meet the keywords again.  Without ``named`` the pairs have no column for the keyword.
    """
    spark, folder = docs.sparkSession, scratch_path(docs.sparkSession, "keyword-join")
    texts = docs.select(F.col(key).alias("key"), F.lower(col(text)).alias("t")).filter(F.col("t") != "")
    carried = [] if carry is None else [carry]
    own = F.lit(0).cast("long") if carry is None else F.col(carry)
    keywords.select(F.lower(word).alias("word"), own.alias("carried")).filter(F.col("word") != "").groupBy("word").agg(F.min("carried").alias("carried")).withColumn(
        "short", (F.length("word") <= LONGEST) & F.col("carried").isNotNull()).write.parquet(f"{folder}/listed")
    listed = spark.read.parquet(f"{folder}/listed")
    counts = listed.groupBy("short", F.least(F.length("word"), F.lit(LONGEST + 1)).alias("size")).count().collect()
    sizes = {r["size"]: r["count"] for r in counts if r["short"]}
    found = []
    if sizes:
        given = listed.filter("short").select("word", F.col("carried").cast("long").alias("carried"))
        parts = parts_of(sum(sizes.values()))
        held = (sorted(sizes), parts, save_parts(given, parts))
        once, again = _by_key(docs, key, texts)
        if once is not None:
            found.append(short_pairs(once, *held, named))
        if again is not None:
            found.append(short_pairs(again, *held).dropDuplicates(["key", "word"]))
    if not sizes or not all(r["short"] for r in counts):
        found.append(_window_pairs(texts, listed.filter("NOT short").select("word", "carried"), gram, share, folder))
    kept = [F.col("word").alias("keyword")] * named + [F.col("carried").cast(listed.schema["carried"].dataType).alias(c) for c in carried]
    return reduce(DataFrame.unionByName, [f.select(F.col("key").alias(key), *kept) for f in found])


def _by_key(docs: DataFrame, key: str, texts: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The texts of keys that stand in one row, and the others, whose rows may hold the same keyword; None if there are none."""
    repeated = docs.select(F.col(key).alias("_repeated")).groupBy("_repeated").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("_repeated")
    keys = repeated.limit(REPEATED_KEYS + 1).collect()
    if not keys:
        return texts, None
    if len(keys) > REPEATED_KEYS:
        return None, texts
    few = F.broadcast(docs.sparkSession.createDataFrame(keys, repeated.schema))
    same = F.col("key").eqNullSafe(F.col("_repeated"))
    return texts.join(few, same, "left_anti"), texts.join(few, same, "left_semi")


def _window_pairs(texts: DataFrame, keywords: DataFrame, gram: int, share: int, folder: str) -> DataFrame:
    """(key, word, carried) for every keyword of ``keywords`` (word, carried) in ``texts`` (key, t), each once, by grams and their windows."""
    spark = texts.sparkSession
    listed = keywords.select("word").distinct()
    size = F.least(F.length("word"), F.lit(gram))
    own = F.coalesce(*[F.when(size == s, _runs(F.col("word"), f".{{{s}}}")) for s in range(1, gram + 1)])
    # a run that starts inside a surrogate pair is no part of the keyword
    listed.select("word", size.alias("size"), F.explode(F.filter(F.array_distinct(own), lambda g: F.contains("word", g))).alias("gram")).write.parquet(f"{folder}/words")
    filed = spark.read.parquet(f"{folder}/words")
    longest = {r["size"]: r["longest"] for r in filed.groupBy("size").agg(F.max(F.length("word")).alias("longest")).collect()}
    sizes = sorted(longest)
    if not sizes:
        return texts.limit(0).select("key", F.lit("").alias("word"), F.lit(0).cast("long").alias("carried"))
    # one code point more than stands before a gram: a window may start inside a surrogate pair
    around = min(AROUND, max(n - size for size, n in longest.items()) + 1)

    def offered(test) -> DataFrame:
        """(key, gram, window) of the grams that pass."""
        def of_size(s: int) -> Column:
            return F.transform(F.filter(_windows(s, around), lambda w: test(_gram_of(w, s, around))), lambda w: F.struct(_gram_of(w, s, around).alias("gram"), w.alias("window")))

        found = F.flatten(F.array(*map(of_size, sizes)))
        return _pieces(texts, gram, around).select("key", F.explode(found).alias("o")).select("key", "o.*")

    test = _passes(filed)
    # how often a gram occurs; the overlaps of pieces count twice, which only the order of the grams could notice
    seen = F.flatten(F.array(*[F.filter(_runs(F.col("piece"), f".{{{s}}}"), test) for s in sizes]))
    held = _pieces(texts, gram, around).select(F.explode(seen).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = filed.join(held, "gram", "left").groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    at = F.instr(F.col("word"), F.col("gram"))
    before, after = F.substring("word", F.lit(1), at - 1), F.substring("word", at + F.length("gram"), F.length("word"))
    placed = rarest.filter(F.col("r.n") > 0).select("word", "r.gram", "r.n").join(keywords, "word")
    # one code point less before the gram, as above
    placed.select(
        "word", "gram", "n", "carried", F.right(before, F.lit(around - 1)).alias("before"), F.left(after, F.lit(around)).alias("after"),
        ((F.length(before) >= around) | (F.length(after) > around) | F.contains("word", F.lit(PAD))).alias("beyond")).write.parquet(f"{folder}/rarest")
    chosen = spark.read.parquet(f"{folder}/rarest")
    counts = chosen.groupBy("gram").agg(F.first("n").alias("n"))
    met = spread_join(offered(_passes(chosen)), chosen.drop("n"), "gram", counts, "key", share)
    left = F.substring("window", 1, around)
    right = F.substring(F.col("window"), F.lit(around + 1) + F.length("gram"), F.lit(around))
    fitting = met.filter(F.endswith(left, F.col("before")) & F.startswith(right, F.col("after"))).select("key", "word", "beyond", "carried")
    near = fitting.repartition("key").groupBy("key", "word").agg(*[F.first(c).alias(c) for c in ("beyond", "carried")])
    if chosen.filter("beyond").isEmpty():
        found = near
    else:
        near.write.parquet(f"{folder}/near")
        near = spark.read.parquet(f"{folder}/near")
        whole = texts.join(near.filter("beyond"), "key").filter(F.contains("t", F.col("word")))
        found = near.filter(~F.col("beyond")).drop("beyond").unionByName(whole.select("key", "word", "carried"))
    return found.select("key", "word", "carried")


def numbered_groups(groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyword, set) and (set, groups): a number for every set of groups that keywords are in; ``groups`` as for :func:`best_groups`."""
    folder = scratch_path(groups.sparkSession, "keyword-groups")
    listed = groups.select(F.lower("keyword").alias("keyword"), F.struct("group", "ord").alias("g")).filter(F.col("keyword") != "")
    listed.groupBy("keyword").agg(F.array_sort(F.collect_set("g")).alias("groups")).write.parquet(f"{folder}/listed")
    by_keyword = groups.sparkSession.read.parquet(f"{folder}/listed")
    by_keyword.select("groups").distinct().withColumn("set", F.monotonically_increasing_id()).write.parquet(f"{folder}/sets")
    sets = groups.sparkSession.read.parquet(f"{folder}/sets")
    return by_keyword.join(sets, "groups").select("keyword", "set"), sets


def best_groups(pairs: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """(key, group, hits): the group with the most keywords in the text, ties by the smaller ``ord``.

    ``groups`` has the columns keyword, group and ord; a keyword may be in several groups.  Keys without a keyword have no row.
    If ``pairs`` carry the numbers of :func:`numbered_groups`, ``groups`` are its sets, and only a key's counts meet them.
    """
    if "set" in pairs.columns:
        met = pairs.groupBy(key, "set").agg(F.count(F.lit(1)).alias("n")).join(groups, "set").select(key, "n", F.explode("groups").alias("g"))
        hits = met.groupBy(key, "g.group", "g.ord").agg(F.sum("n").alias("hits"))
    else:
        listed = groups.select(F.lower("keyword").alias("keyword"), "group", "ord").distinct()
        hits = pairs.join(listed, "keyword").groupBy(key, "group", "ord").agg(F.count(F.lit(1)).alias("hits"))
    best = hits.groupBy(key).agg(F.max_by(F.struct("group", "hits"), F.struct("hits", -F.col("ord"))).alias("b"))
    return best.select(key, "b.group", "b.hits")
