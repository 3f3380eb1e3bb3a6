"""Keyword and sentiment lists as tables, next to the plain rule on every text."""

import random

import pytest
from pyspark.sql import functions as F

from bindings.fixture import LEXICON
from vocspark.functions.sentiment import sentiment
from vocspark.operators import keyword_join as K
from vocspark.operators import short_keywords
from vocspark.operators import spread_join as S
from vocspark.operators.lexicon_join import LexiconTable, sentiment_by_table
from vocspark.sources.tables import read_table

FOLDER = "/root/testdata/sf0.001"


def contained(texts, keywords):
    words = {w.lower() for w in keywords if w}
    return sorted((k, w) for k, t in texts if t for w in words if w in t.lower())


def pairs(spark, texts, keywords, **options):
    docs = spark.createDataFrame(texts, "doc_id long, text string, keyword string") if texts and len(texts[0]) == 3 else spark.createDataFrame(
        texts, "doc_id long, text string")
    listed = spark.createDataFrame([(w,) for w in keywords], "keyword string")
    return sorted(tuple(r) for r in K.keyword_pairs(docs, "doc_id", "text", listed, **options).collect())


def test_pairs_equal_contains_on_random_texts(spark, monkeypatch):
    monkeypatch.setattr(K, "PIECE", 40)
    rnd = random.Random(5)
    letters = "aab c\n.ÉßÄ漢😀?"
    texts = [(i, "".join(rnd.choice(letters) for _ in range(rnd.choice([0, 1, 3, 10, 50, 300])))) for i in range(60)] + [(100, None), (101, "")]
    texts += [(200 + i, texts[7][1]) for i in range(3)]
    keywords = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 7))) for _ in range(150)} | {"", "zz", "A", "￿a"}
    for _, t in texts:
        for size in (6, 15, 16, 17, 21, 22, 38, 60):  # also keywords that reach beyond the window
            if t and len(t) > size:
                start = rnd.randint(0, len(t) - size)
                keywords.add(t[start:start + size])
    keywords |= {k[:-1] + "#" for k in list(keywords) if len(k) > 20}
    want = contained(texts, keywords)
    assert any(len(w) > 37 for _, w in want)
    assert pairs(spark, texts, [*keywords, None, "a"]) == want
    assert pairs(spark, texts, keywords, gram=3, share=2) == want


def test_ties_empty_tables_and_clashing_columns(spark):
    assert pairs(spark, [(1, "abc")], []) == pairs(spark, [], ["abc"]) == []
    assert pairs(spark, [(1, "abcabc", "other"), (2, "ABC", None)], ["abc", "ABC"]) == [(1, "abc"), (2, "abc")]


def test_two_hundred_thousand_keywords(spark):
    rows = [(r["doc_id"], r["text"]) for r in read_table(spark, FOLDER, "documents").select("doc_id", "text").collect()]
    grams = {i: {t.lower()[k:k + 7] for k in range(len(t) - 6)} for i, t in rows if t and len(t.lower()) == len(t)}
    seen = sorted({g for gs in grams.values() for g in gs})
    rnd = random.Random(1)
    listed = set(rnd.sample(seen, min(len(seen), 60_000)))
    while len(listed) < 200_000:
        listed.add("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(7)))
    words = spark.createDataFrame([(w,) for w in listed], "keyword string")
    found = K.keyword_pairs(read_table(spark, FOLDER, "documents"), "doc_id", "text", words).groupBy("doc_id").count().collect()
    got = {r["doc_id"]: r["count"] for r in found if r["doc_id"] in grams}
    assert got == {i: n for i, gs in grams.items() if (n := len(gs & listed))}


def test_best_group_takes_most_hits_then_the_first(spark):
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "c"), (2, "a"), (3, "x")], "doc_id long, keyword string")
    groups = spark.createDataFrame([("A", "late", 2), ("b", "late", 2), ("c", "early", 1), ("c", "early", 1)], "keyword string, group string, ord int")
    assert sorted(tuple(r) for r in K.best_groups(hits, "doc_id", groups).collect()) == [(1, "late", 2), (2, "early", 1)]


def test_no_bucket_takes_more_than_its_share(spark):
    left = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5_000)).alias("k"), "id")
    right = left.select("k").distinct().withColumn("v", F.length("k"))
    counts = left.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    heavy = {r["k"]: r["_splits"] for r in S.heavy_keys(counts, "k", 100).collect()}
    assert heavy == {"hot": 34}
    joined = S.spread_join(left, right, "k", counts, "id", 100)
    assert joined.count() == 30_000 and joined.select("id").distinct().count() == 30_000 and joined.filter(F.col("v") != F.length("k")).isEmpty()
    assert S.heavy_keys(counts.limit(0), "k").isEmpty()


@pytest.mark.parametrize("share", [3, 1_000])
def test_lexicon_table_equals_the_constant_path(spark, share):
    docs = read_table(spark, FOLDER, "documents").select("doc_id", "text", F.lit("x").alias("word"))
    extra = spark.createDataFrame([(9001, None, "x"), (9002, "", "x"), (9003, "not the. THE und und", "x"), (9004, "zz", "x")], docs.schema)
    docs = docs.unionByName(extra)
    entries = spark.createDataFrame([(w.upper(), *v) for w, v in LEXICON.entries.items()] + [("the", -1.0, 0.0), (None, 1.0, 1.0), ("zz", None, 1.0)],
                                    "word string, polarity double, subjectivity double")
    got = sentiment_by_table(docs, "doc_id", "text", LexiconTable(entries, LEXICON.negators, LEXICON.boosters), share)
    want = docs.select("doc_id", sentiment("text", LEXICON).alias("r")).select("doc_id", "r.*")
    assert sorted(tuple(r) for r in got.select(*want.columns).collect()) == sorted(tuple(r) for r in want.collect())


def test_hundred_thousand_entries(spark):
    rnd = random.Random(3)
    lexicon = {f"w{i}": (rnd.randint(-1000, 1000), rnd.randint(0, 1000)) for i in range(100_000)}
    texts = [(k, " ".join(f"w{rnd.randint(0, 120_000)}" if rnd.random() < 0.7 else "not" for _ in range(50))) for k in range(40)]
    entries = spark.createDataFrame([(w, p / 1000, s / 1000) for w, (p, s) in lexicon.items()], "word string, polarity double, subjectivity double")
    got = {r["doc_id"]: (r["sentiment_score"], r["subjectivity"]) for r in sentiment_by_table(
        spark.createDataFrame(texts, "doc_id long, text string"), "doc_id", "text", LexiconTable(entries)).collect()}
    for k, t in texts:
        tokens = t.split()
        hits = [(lexicon[w][0] * (-50 if before == "not" else 100), lexicon[w][1]) for before, w in zip(["", *tokens], tokens) if w in lexicon]
        score, subjective = sum(p for p, _ in hits) / (100 * len(hits)), sum(s for _, s in hits) / len(hits)
        assert abs(got[k][0] * 1000 - score) <= 0.5 and abs(got[k][1] * 1000 - subjective) <= 0.5


def test_groups_that_pairs_carry(spark):
    rows = [(1, "alpha beta gamma"), (2, "Beta 😀x delta"), (3, None), (4, "nothing")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    groups = spark.createDataFrame(
        [("Alpha", "a", 0), ("beta", "a", 0), ("beta", "b", 1), ("delta", "b", 1), ("😀x", "c", 2), ("", "c", 2), (None, "c", 2), ("BETA", "b", 1)],
        'keyword string, `group` string, ord int')
    plain = K.best_groups(K.keyword_pairs(docs, "doc_id", "text", groups), "doc_id", groups).collect()
    listed, sets = K.numbered_groups(groups)
    pairs = K.keyword_pairs(docs, "doc_id", "text", listed, carry="set")
    best = K.best_groups(pairs, "doc_id", sets)
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, plain)) == [(1, "a", 2), (2, "b", 2)]
    assert K.keyword_pairs(docs, "doc_id", "text", listed.limit(0), carry="set").columns == ["doc_id", "keyword", "set"]


def test_short_keywords_are_looked_up_in_the_tasks(spark, monkeypatch):
    """Keywords of all sizes in several files; no gram or window is shuffled."""
    monkeypatch.setattr(short_keywords, "PART", 50)
    monkeypatch.setattr(short_keywords, "OUT_ROWS", 5)
    monkeypatch.setattr(K, "_window_pairs", None)
    rnd = random.Random(8)
    letters = "aabc\x00\n.Éß漢😀\uffff"
    texts = [(i, "".join(rnd.choice(letters) for _ in range(rnd.choice([1, 4, 6, 7, 20, 200])))) for i in range(40)] + [(100, None), (101, "")]
    keywords = {"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(300)}
    keywords |= {t[k:k + 6] for _, t in texts if t for k in range(0, len(t), 5)}
    want = contained(texts, keywords)
    assert len(want) > 1_000 and {len(w) for _, w in want} == set(range(1, 7))
    assert pairs(spark, texts, [*keywords, "", None]) == want


@pytest.mark.parametrize("most", [0, 100_000])
def test_repeated_and_null_keys_have_each_keyword_once(spark, monkeypatch, most):
    monkeypatch.setattr(K, "REPEATED_KEYS", most)
    docs = spark.createDataFrame([(1, "one two"), (1, "TWO three"), (2, "two"), (None, "one"), (None, "one four")], "doc_id long, text string")
    listed = spark.createDataFrame([("one", 1), ("two", 2), ("three", 3), ("four", 4)], "keyword string, number long")
    want = [(1, "one", 1), (1, "three", 3), (1, "two", 2), (2, "two", 2), (None, "four", 4), (None, "one", 1)]
    got = K.keyword_pairs(docs, "doc_id", "text", listed, carry="number")
    assert sorted(map(tuple, got.collect()), key=str) == want
    bare = K.keyword_pairs(docs, "doc_id", "text", listed, carry="number", named=False)
    assert sorted(map(tuple, bare.collect()), key=str) == sorted(((k, n) for k, _, n in want), key=str)


def test_texts_in_pieces_and_keywords_in_files(spark, monkeypatch):
    """Keywords over the cuts between pieces, in texts of many pieces and in pieces of many texts; each once."""
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("aab 漢😀") for _ in range(n)) for n in (0, 30, 1, 0, 3, 5, 100, 2, 0)]
    keywords = sorted({t[k:k + n] for t in texts for n in (1, 2, 3, 4, 6) for k in range(len(t) - n + 1)})
    listed = spark.createDataFrame([(w, k) for k, w in enumerate(keywords)], "word string, carried long")
    places = short_keywords.save_parts(listed, 3)
    assert sorted(places) == [0, 1, 2]
    for piece in (4, 1 << 19):
        monkeypatch.setattr(short_keywords, "PIECE", piece)
        got = [(int(t), keywords[short_keywords._part(p)[4][w]]) for p, text, word in short_keywords._found(texts, [1, 2, 3, 4, 6], 3, places)
               for t, w in zip(text, word)]
        assert sorted(got) == contained(list(enumerate(texts)), keywords)
    for _, _, high, low, carried in map(short_keywords._part, places.values()):
        assert short_keywords._words(high, low) == [keywords[k] for k in carried]


def test_pairs_without_names_and_with_any_number(spark):
    docs = spark.createDataFrame([("a", "one two three hundred"), ("b", "two"), (None, None)], "doc_id string, text string")
    listed = spark.createDataFrame([("ONE", 7), ("two", -(2**31)), ("hundred", 3), ("three", None), ("four", 1)], "keyword string, number int")
    got = K.keyword_pairs(docs, "doc_id", "text", listed, carry="number")
    assert [f.dataType.simpleString() for f in got.schema] == ["string", "string", "int"]
    assert sorted(map(tuple, got.collect()), key=str) == [
        ("a", "hundred", 3), ("a", "one", 7), ("a", "three", None), ("a", "two", -(2**31)), ("b", "two", -(2**31))]
    assert sorted(map(tuple, K.keyword_pairs(docs, "doc_id", "text", listed, carry="number", named=False).collect()), key=str) == [
        ("a", -(2**31)), ("a", 3), ("a", 7), ("a", None), ("b", -(2**31))]


def test_largest_entry_of_a_word_holds_without_sorting_entries(spark, capsys):
    """Of several entries the largest (polarity, subjectivity); every occurrence of a word may be an entry, so none is sorted."""
    rows = [("Good", 0.5, 0.1), ("good", 0.5, 0.9), ("GOOD", 0.2, 1.0), ("bad", -0.5, 0.3), ("bad", -0.7, 1.0), ("x", None, 0.1), (None, 0.3, 0.1)]
    entries = spark.createDataFrame(rows, "word string, polarity double, subjectivity double")
    table = LexiconTable(entries).table()
    assert sorted(tuple(r) for r in table.collect()) == [("bad", -500, 300), ("good", 500, 900)]
    table.explain()
    assert "SortAggregate" not in capsys.readouterr().out


def test_heavy_keys_and_their_parts(spark):
    counts = spark.createDataFrame([("a", 70), ("b", 25), ("c", 5), (None, 0)], "word string, n long")
    assert sorted(tuple(r) for r in S.heavy_keys(counts, "word", 10).collect()) == [("a", 7), ("b", 3)]
    assert S.heavy_keys(counts.limit(0), "word", 10).count() == 0
