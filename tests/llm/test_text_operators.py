"""Quality rules, byte-pair encoding, token files, licences and toxicity on hand-made rows and against plain versions."""

import hashlib
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vocspark.llm import bpe, license_scan, quality, token_files, toxicity
from vocspark.llm.common import fresh_folder

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, kept string"
LONG = " ".join(f"word{i} of item{i} the" for i in range(4000))
TEXTS = [None, "", " \n\t ", "a", "a a a a a a", "the cat sat on the mat\nthe cat sat on the mat\n\nthe cat", "x" * 30_000, LONG,
         "Ünïcode — 漢字 and 😀 <|endoftext|> 's don't\x0b\x0c\r\n  end ", "AND!! SO!! ON!! " * 30, "#$%&|<> " * 60, LONG, "a"]


def rows(spark, texts=TEXTS):
    data = [(None if i == 3 else i, t, None if i % 2 else "en", "src1", None, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(data + data[4:6], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_measures(text):
    text = text or ""
    ws = words(text)
    windows = Counter(tuple(ws[i:i + 3]) for i in range(len(ws) - 2))
    covered = {i + k for i in range(len(ws) - 2) if windows[tuple(ws[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_quality_measures_and_verdicts(spark):
    got = quality.judge(rows(spark)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        m = plain_measures(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0])
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {7, 11}
    assert quality.judge(rows(spark).limit(0)).count() == 0
    assert quality.stage(spark, rows(spark), "").columns == rows(spark).columns


def test_long_texts_take_the_other_sort_with_the_same_result(spark):
    text = " ".join(f"w{i % 70_000}" for i in range(140_001)) + " only once here"
    r = quality.judge(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert (r.n_words, r.n_repeat_words) == (plain_measures(text)[0], plain_measures(text)[4])


def test_encoding_is_that_of_the_library(spark):
    library = Tokenizer.from_file(bpe.default_path())
    for r in bpe.decode_documents(bpe.encode_documents(rows(spark))).collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)
        assert r.score == "clash"
    got = bpe.digests(rows(spark).select("doc_id", "text")).where("doc_id = 1").first()
    assert (got.n_tokens, got.ids_sha256) == (0, hashlib.sha256(b"").hexdigest())
    assert bpe.digests(rows(spark).limit(0)).count() == 0


def test_backtracking_on_joined_tokens():
    vocab, library = bpe.vocabulary(bpe.default_path()), Tokenizer.from_file(bpe.default_path())
    some = [t for t in list(vocab.tokens.values())[300:30_000:37] if t.isascii()]
    for a, b, c in zip(some, some[5:], some[11:]):
        text = (a + b + c).decode()
        assert np.frombuffer(vocab.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_decoding_replaces_what_is_no_text(spark):
    ids = np.array([222, 50256], dtype="<u4").tobytes()
    df = spark.createDataFrame([(bytearray(ids),), (None,)], "ids binary")
    library = Tokenizer.from_file(bpe.default_path())
    assert [r.decoded for r in bpe.decode_documents(df).collect()] == [library.decode([222, 50256], skip_special_tokens=False), ""]


def test_token_files_against_the_library(spark):
    library = Tokenizer.from_file(token_files.default_path())
    docs = rows(spark)
    manifest = token_files.write_shards(docs, fresh_folder(spark, "t"))
    got = token_files.read_documents(manifest).collect()
    given = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, want = 0, Counter()
    for doc_id, text in given:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        want[doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
        at += len(ids)
    assert Counter(tuple(r) for r in got) == want
    empty = token_files.write_shards(docs.limit(0), fresh_folder(spark, "t"))
    assert token_files.read_documents(empty).count() == 0


@pytest.mark.parametrize("text, names, value", [
    ("MIT", ["mit"], 1.0),
    ("(MIT OR GPL-3.0-only) AND MPL-2.0", ["gpl-3.0-only", "mit", "mpl-2.0"], 0.6),
    ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl-2.0", "gpl-2.0-with-classpath-exception-2.0"], 0.65),
    ("Apache-2.0 OR", ["apache-2.0"], 1.0),
    ("MIT */ trailing", ["mit"], 1.0),
    ("GPL-3.0 AND (MIT", ["gpl-3.0"], 0.3),
])
def test_licence_expressions(text, names, value):
    assert license_scan.expression(text)[0] == names
    assert license_scan.expression(text)[1] == pytest.approx(value)


def test_long_licence_expressions():
    names = [f"name-{i}" for i in range(100_000)]
    begin = time.process_time()
    got = license_scan.expression(" or ".join(names) + " and")
    assert got == (sorted(names), 0.5)
    assert license_scan.expression("(" * 50_000 + "MIT" + ") and gpl" * 50_000) == (["gpl", "mit"], 0.3)
    assert license_scan.expression("a" + " with b" * 50_000) == (["a", "a-with-b"], 0.75)
    assert license_scan.expression("(" * 100_000 + "MIT") is None
    assert time.process_time() - begin < 10


@pytest.mark.parametrize("text, names, value", [
    ("GPL-2.0 with x and MIT", ["gpl-2.0", "gpl-2.0-with-x", "mit"], 0.65),
    ("MIT or GPL-2.0 with x", ["gpl-2.0", "gpl-2.0-with-x", "mit"], 1.0),
    ("(MIT or GPL-2.0) with x", ["gpl-2.0", "mit"], 1.0),
    ("MIT with (x or y)", ["mit"], 1.0),
    ("gpl and (mpl or (mit and agpl))", ["agpl", "gpl", "mit", "mpl"], 0.3),
    ("mit) or gpl", ["mit"], 1.0),
    ("mit mit", ["mit"], 1.0),
])
def test_exceptions_and_brackets(text, names, value):
    assert license_scan.expression(text) == (names, pytest.approx(value))


def test_no_expression():
    assert license_scan.expression("") is None and license_scan.expression("AND MIT") is None and license_scan.expression(") (") is None


def plain_licences(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in license_scan.BASE_PHRASES.items() for i in range(len(ws))
            if ws[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return (len(ws), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits})))


def test_licence_scan(spark):
    texts = TEXTS + ["MIT License, CC-BY; cc by cc by Apache\nLicense", "mit license mit license", "Émit license", "submit license mit licenses",
                     "// SPDX-License-Identifier: MIT OR GPL-3.0\nGNU General Public License"]
    got = license_scan.license_scan_columns(rows(spark, texts)).collect()
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_licences(r.text)
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    last = [r for r in got if (r.text or "").startswith("//")][0]
    assert last.labels == "gpl,gpl-3.0,mit" and last.score == pytest.approx(0.3)
    assert license_scan.license_scan_columns(rows(spark).limit(0)).count() == 0


def test_marks_of_the_composed_grammar():
    lexicon = toxicity.seed_model().lexicon()
    assert toxicity.matches("You are an idiot.", lexicon) == [("plain", 0.8)]
    assert toxicity.matches("I am not an idiot.", lexicon) == [("negated", 0.8)]
    assert toxicity.matches("They said: idiot", lexicon) == [("plain", 0.8)]
    assert toxicity.matches("They said idiot", lexicon) == [("reported", 0.8)]
    assert toxicity.matches("She said not idiot", lexicon) == [("negated+reported", 0.8)]
    assert toxicity.matches("kill the process", lexicon) == []
    assert toxicity.matches("you die, I will tell him: kill you", lexicon) == []
    assert toxicity.matches("him I kill", lexicon) == [("plain", 1.0)]


def test_targets_after_a_match_direct_it():
    model = toxicity.seed_model()
    lexicon = model.lexicon()
    assert toxicity.directed_matches("I will kill you", lexicon) == [("threat+plain", 1.0)]
    assert toxicity.directed_matches("kill you all", lexicon) == [("threat+plain", 1.0)]
    assert toxicity.directed_matches("him I kill", lexicon) == [("threat+plain", 1.0)]
    assert toxicity.directed_matches("I will not kill you", lexicon) == [("threat+negated", 1.0)]
    assert toxicity.directed_matches("kill the process. you", lexicon) == []
    assert toxicity.directed_matches("You are an idiot.", lexicon) == [("directed+plain", 0.8)]
    assert toxicity.directed_matches("idiot, that is what you are", lexicon) == [("directed+plain", 0.8)]
    assert toxicity.directed_matches("what an idiot! you see", lexicon) == [("plain", 0.8)]
    assert toxicity.score_text("I will kill you", model, lexicon) > 0.5 > toxicity.score_text("kill the process", model, lexicon)


def test_directed_insults_learn_a_weight_of_their_own(spark):
    rows = [(i, f"You are an idiot number {i}", 1) for i in range(150)] + [(i, f"the word idiot number {i}", int(i % 2)) for i in range(150, 300)]
    rows += [(i, f"You are an hour late, number {i}", 0) for i in range(300, 450)]  # so that the target is not learned as an insult
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    weights = toxicity.fit(docs, labels).weights
    assert weights["directed+plain"] > 0.95 and weights["plain"] < 0.7


def test_toxicity_learns_stems(spark):
    clean = [(i, f"plain words number {i} zorbing along the road", 0) for i in range(200)]
    toxic = [(i, f"plain words number {i} with zorgle{'abcdefgh'[i % 8]} in it", 1) for i in range(200, 300)]
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in clean + toxic] + [(900, None, "x"), (901, "", "x")], "doc_id bigint, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in clean + toxic] + [(None, 1), (900, None), (200, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(got[i].predicted == y and 0 <= got[i].score <= 1 for i, _, y in clean + toxic)
    assert got[900].predicted == got[901].predicted == 0
    assert toxicity.fit(docs, labels.limit(0)) == toxicity.seed_model()
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    got = toxicity.toxicity_grammar(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.99 and n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.7
