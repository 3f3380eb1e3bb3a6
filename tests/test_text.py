"""Cleaning, identifiers, gist, sentiment, dates and tokens against plain statements."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from bindings.fixture import GIST
from tests import plain
from vocspark.functions import actor, common, dates, gist, ids, sentiment, text
from vocspark.sources.tables import read_table
from vocspark.taxonomy import default_taxonomy

DATA = "/root/testdata/sf0.001"
NOISE = [
    None, "", "   ", "Plain words, nothing else.", "p.MsoNormal, li.MsoNormal {margin:0; color:red;} Hello there",
    "a: p.xxmsonormal, li.xxmsonormal, div.xxmsonormal { keep me", "file.name, other.name, third.part { rest",
    "<p>Hi&nbsp;you &amp; me</p><br/>next", "font-family: Arial; text color: blue; more", "Description: it is slow",
    "From: me\nTo: you\nbody", "write to someone@x1.com or a.b@c.org please", "[EXTERNAL] warning text",
    "It breaks. Thanks, Bob and all the rest", "fine Best Regards, Ann", "x -----Original Message----- y\nz",
    "wow!!!??? really,,,,", "span.EmailStyle17 {color:x} tail", "div.WordSection1 stays open", ".MsoChpDefault x } y",
    "p.x_MsoNormal, li.x_MsoNab cut, on", "a:b c:d; e", "x_.MsoNormal0, after", "line\x1cone\x85two three", "one{two", "{a}{b} c",
]
PIECES = ["a", "Z", "9", ".", ",", ":", ";", "{", "}", " ", "\n", "<", ">", "&nbsp;", "p.MsoNormal", "li.x_MsoNormal", "font-", "margin:",
          "color:", "Thanks", "x@y1.com", "@b2.org", "MsoNormal", "Description:", "From:", "!", "?", "é", " ", "-", "_", "#"]


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").repartition(4)
    return [r[0] for r in rows.orderBy("i").select(fn("v")).collect()]


def test_clean_text_on_known_noise(spark):
    assert column(spark, NOISE, text.clean_text) == [plain.clean(v) for v in NOISE]


def test_clean_text_on_random_mixtures(spark):
    rng = random.Random(7)
    values = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 25))) for _ in range(3000)]
    got = column(spark, values, text.clean_text)
    assert [(v, g) for v, g in zip(values, got, strict=True) if g != plain.clean(v)] == []


def test_clean_text_survives_long_selector_lists(spark):
    value = ", ".join(["ab.cd"] * 20_000) + " end"
    assert column(spark, [value], text.clean_text) == [plain.clean(value)]


def test_clean_text_is_linear_in_long_runs(spark):
    run = "aB3x_" * 40_000
    values = [f"{run} @ {run}", f"{'ab' * 100_000} p.MsoNormal", f"{'-a.' * 60_000}:", f"a@b1.com_x@y1.org {run}"]
    got = column(spark, values, text.clean_text)
    assert got[3].startswith("[email-removed][email-removed]") and all(len(g) > 100 or g == "" for g in got)


def hashed(key):
    digest = hashlib.sha256(key.encode()).hexdigest()
    return "-".join((digest[:8], digest[8:12], digest[12:16], digest[16:20], digest[20:32]))


# Records, and the key that is hashed for each.
IDENTIFIED = [
    (("Title!", "Some  content, here", "Reddit", "Ann", "2024-02-03T23:30:00Z"), "title|some content here|reddit|ann|2024-02-03"),
    ((None, "x y", None, "", None), "x y"),
    (("", "", "", "", ""), ""),
    (("Ünïcode—title", "çà va? 1² ok_", "GitHub", None, "2024-02-03T01:00:00+05:00"), "ünïcodetitle|çà va 1² ok_|github|2024-02-03"),
    (("t", "!? " * 1500 + "end", "s", "a", "Yesterday at 5"), "t|" + " " * 1500 + "end|s|a|Yesterday "),
]


def test_identifier_keys(spark):
    df = spark.createDataFrame([r for r, _ in IDENTIFIED], "t string, c string, s string, a string, d string")
    got = [r[0] for r in df.select(ids.feedback_id("t", "c", "s", "a", "d")).collect()]
    assert got == [hashed(key) for _, key in IDENTIFIED]


def test_keys_read_whole_texts_unless_told_otherwise(spark):
    df = spark.createDataFrame([("t", "w" * 900 + end) for end in "ab"], "t string, c string")
    long_, short, sig, sig_short = ({r[0] for r in df.select(c).collect()} for c in (
        ids.feedback_id("t", "c", F.lit("s")), ids.feedback_id("t", "c", F.lit("s"), lengths=ids.SHORT),
        ids.content_signature("t", "c"), ids.content_signature("t", "c", ids.SHORT)))
    assert long_ == {hashed("t|" + "w" * 900 + end + "|s") for end in "ab"} and short == {hashed("t|" + "w" * 500 + "|s")}
    assert len(sig) == 2 and sig_short == {"t|" + "w" * 200}


def test_identifier_ignores_case_spacing_and_punctuation(spark):
    same = ["Hello,   World", "hello world!", "HELLO\nworld"]
    got = column(spark, same, lambda c: ids.feedback_id(F.lit(""), c, F.lit("x")))
    assert len(set(got)) == 1


def test_record_identifier_takes_first_filled_fields(spark):
    rows = [(None, None, "f" * 150, "s", "c", "2024-01-01"), ("T", "C", "F", "s", None, None)]
    df = spark.createDataFrame(rows, "title string, content string, feedback string, source string, customer string, created string")
    got = [r[0] for r in df.select(ids.feedback_id_from_record()).collect()]
    assert got == [hashed("f" * 150 + "|" + "f" * 150 + "|s|c|2024-01-01"), hashed("t|c|s")]


GISTS = [
    (None, "No content"), ("", "No content"), ("  ", "Empty feedback"), ("Exports fail every night. The rest is not", "Exports fail every night"),
    ("A first sentence is taken. The rest is not", "first sentence taken. rest not"),
    ("a b c", "a b c"), ("x" * 400, "x" * 147 + "..."), ("no topics at all in the of it", "topics all"),
]


def test_gists(spark):
    got = column(spark, [v for v, _ in GISTS], lambda c: gist.gist(c, GIST))
    assert [(v, g) for (v, w), g in zip(GISTS, got, strict=True) if g != w] == []


def test_gist_vocabulary_comes_from_the_caller(spark):
    text = "We are glad. Everything about the login page waits for ages today, we think. x"
    assert column(spark, [text], gist.gist)[0].startswith("glad. Everything login page")  # no topics: leading words
    profile = gist.GistProfile.of_taxonomy(default_taxonomy())
    assert column(spark, [text], lambda c: gist.gist(c, profile)) == ["Everything about the login page waits for ages today, we think"]
    only_terms = gist.GistProfile({"pages": ("page",)})
    assert column(spark, ["I am on page one"], lambda c: gist.gist(c, only_terms)) == ["page one"]


def test_gists_of_documents_are_short_and_from_the_text(spark):
    docs = [r["text"] for r in read_table(spark, DATA, "documents").collect()]
    for value, got in zip(docs, column(spark, docs, lambda c: gist.gist(c, GIST)), strict=True):
        assert 0 < len(got) <= 150
        assert got in ("No content", "Empty feedback") or got[:5].lower() in " ".join(value.split()).lower() or " - " in got


def test_title_case(spark):
    assert column(spark, ["multi-tenant power bi", "a & b-c1d", ""], lambda c: text.title_case(F.col(c))) == [
        "Multi-Tenant Power Bi", "A & B-C1D", ""]


def test_sentiment(spark):
    lex = sentiment.Lexicon({"good": (0.6, 0.5), "bad": (-0.8, 0.3)}, ("not",), {"very": 1.5})
    rows = column(spark, ["good", "not good", "very good!", "bad, bad. good", "", None, "nothing here"],
                  lambda c: sentiment.sentiment(c, lex))
    got = [(r["sentiment_score"], r["subjectivity"], r["sentiment"], r["sentiment_confidence"]) for r in rows]
    assert got == [(0.6, 0.5, "Positive", "High"), (-0.3, 0.5, "Negative", "Medium"), (0.9, 0.5, "Positive", "High"),
                   (-0.333, 0.367, "Negative", "Medium"), (0.0, 0.0, "Neutral", "Low"), (0.0, 0.0, "Neutral", "Low"),
                   (0.0, 0.0, "Neutral", "Low")]


def test_sentiment_thresholds_are_strict(spark):
    df = spark.createDataFrame([(0.1,), (0.101,), (-0.1,), (-0.2,), (0.5,)], "p double")
    got = [tuple(r) for r in df.select(sentiment.sentiment_label("p"), sentiment.sentiment_confidence("p")).collect()]
    assert got == [("Neutral", "Low"), ("Positive", "Low"), ("Neutral", "Low"), ("Negative", "Medium"), ("Positive", "High")]


def test_existing_scores_are_kept(spark):
    df = spark.createDataFrame([("good", 0.9, "X"), ("good", None, None)], "feedback string, sentiment_score double, sentiment string")
    got = sentiment.with_sentiment(df).select("sentiment_score", "sentiment").collect()
    assert [tuple(r) for r in got] == [(0.9, "X"), (0.7, "Positive")]


def test_lexicon_size_is_bounded(spark):
    with pytest.raises(ValueError):
        sentiment.Lexicon({f"w{i}": (0.0, 0.0) for i in range(sentiment.MAX_LEXICON + 1)})
    table = spark.createDataFrame([("Good", 0.5, 0.1)], "word string, polarity double, subjectivity double")
    assert sentiment.lexicon_from_frame(table).entries == {"good": (0.5, 0.1)}


def test_forum_dates(spark):
    as_of = F.lit("2024-06-15 12:30:00").cast("timestamp")
    cases = {"03-04-2024 05:06 PM": "2024-03-04 17:06:00", "3-4-2024 5:06 am": "2024-03-04 05:06:00", "03-04-2024": "2024-03-04 00:00:00",
             "Mar 4, 2024 11:59 PM": "2024-03-04 23:59:00", "25-03-2024 01:00 AM": "2024-03-25 01:00:00",
             "Yesterday at 3:07 PM": "2024-06-14 15:07:00", "today at 9:00am": "2024-06-15 09:00:00", "today at noon": "2024-06-15 00:00:00",
             "7 minutes ago": "2024-06-15 12:23:00", "2 Hours ago": "2024-06-15 10:30:00", "10 days ago": "2024-06-05 12:30:00",
             "some time ago": "2024-06-15 12:30:00", "": "2024-06-15 12:30:00"}
    got = column(spark, list(cases), lambda c: F.date_format(dates.forum_timestamp(c, as_of), "yyyy-MM-dd HH:mm:ss"))
    assert got == list(cases.values())


def test_iso_and_epoch(spark):
    got = column(spark, ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "soon", None],
                 lambda c: F.date_format(dates.iso_timestamp(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == ["2024-01-02 03:04:05", "2024-01-02 01:04:05", None, None]
    df = spark.createDataFrame([(0.0,), (1.5,)], "x double")
    assert [r[0] for r in df.select(dates.epoch_to_iso("x")).collect()] == ["1970-01-01T00:00:00", "1970-01-01T00:00:01.500000"]


def test_actor(spark):
    got = column(spark, ["Bearer a.eyJ1cG4iOiJtZSJ9.c", "a.eyJzdWIiOiJpZDEifQ", "a.e30.c", "nonsense", "a.%%%.c"], actor.actor_from_token)
    assert got[:3] == ["me", "id1", "Unknown User"]
    assert all(g.startswith("User-") for g in got[3:])


def test_small_helpers(spark):
    assert column(spark, ["abcdef", "abc", None], lambda c: common.truncate(c, 4)) == ["abcd...", "abc", None]
    assert column(spark, ["a\x00\x07b\t\n\x7f"], text.sanitize) == ["ab\t\n"]
    assert column(spark, [None, "", "x"], lambda c: common.first_filled(c, F.lit("y"))) == ["y", "y", "x"]
    df = spark.createDataFrame([(float("nan"), [1.0, float("nan")], "a\x01"), (2.0, None, None)], "x double, a array<double>, s string")
    assert [tuple(r) for r in text.nan_to_null(df).collect()] == [(None, [1.0, None], "a\x01"), (2.0, None, None)]
    assert text.sanitize_frame(df).first()["s"] == "a"


def test_request_keywords(spark):
    assert column(spark, ["The API is slow, slow; and it-will crash!"], text.request_keywords) == [["api", "slow", "slow", "crash"]]


def test_forum_dates_are_local_times(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        as_of = F.lit("2024-06-15 12:30:00").cast("timestamp")
        df = spark.createDataFrame([("Yesterday at 3:00 PM",), ("today at 9:05 am",), ("today at noon",)], "c string")
        got = [r[0] for r in df.select(F.date_format(dates.forum_timestamp("c", as_of), "yyyy-MM-dd HH:mm")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == ["2024-06-14 15:00", "2024-06-15 09:05", "2024-06-15 00:00"]


def test_iso_needs_a_full_date(spark):
    values = ["12:30", "2024", "2024-05", "T10:00", "2024-05-06", "2024-05-06T07:08", "2024-05-06 07:08:09.5Z", "2024-05-06T07:08:09+02:00", "2024-13-45", None]
    got = column(spark, values, lambda c: F.date_format(dates.iso_timestamp(c), "yyyy-MM-dd HH:mm:ss"))
    assert got == [None] * 4 + ["2024-05-06 00:00:00", "2024-05-06 07:08:00", "2024-05-06 07:08:09", "2024-05-06 05:08:09", None, None]


@pytest.mark.parametrize("opening", [1, 5, 12, 30, 2_000])
def test_first_sentences_from_an_opening_are_those_of_the_text(spark, monkeypatch, opening):
    monkeypatch.setattr(gist, "OPENING", opening)
    texts = ["", "no mark at all but long", "A first sentence. Second one is here! Third, long too? Fourth one is last", "...", "ab. cd. ef. gh. a long sentence here. x",
             "The first one goes on...!? The second one goes on. The third one goes on. The fourth goes on.", "Eleven char.Eleven char.Eleven char"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", gist._first_sentences(F.col("t")).alias("s")).collect():
        assert row["s"] == [p.strip() for p in re.split("[.!?]+", row["t"]) if len(p.strip()) > 10][:3]


def test_words_are_those_of_the_compare_form(spark):
    texts = ["", None, " a\u00a0b--c_d ", "\u0130stanbul, \u00c9T\u00c9! x1", "...", "\U0001F600 a\u0301b"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select(text.words("t").alias("w"), text.compare_form("t").alias("f")).collect():
        assert row["w"] == row["f"].split()
