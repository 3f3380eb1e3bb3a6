"""Sentence pieces and tokenizer alignment against the libraries and against plain versions."""

import hashlib
import os
import random
import struct
from collections import Counter

import numpy as np
import pytest

from vocspark.llm import alignment, sentence_pieces
from vocspark.llm.pair_merges import PairTable, merge_one, merge_words

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SOME = ["abc", "the ing", " ", "  ", "\n", "\t", "\r\n", "é", "漢字", "😀", "　", "\xa0", "\x85", "\x1c", "\x00", "<0x41>", "<s>", "</s>", "<unk>",
        "<|endoftext|>", "'ll", "();", "9", "ſ", " ", "."]
DOCS = "doc_id bigint, text string, ids string, ends string, decoded string, _in0 string, pair string, chunk string"


def mixtures(n, seed, extra=()):
    rnd = random.Random(seed)
    return ["".join(rnd.choice([*SOME, *extra]) for _ in range(rnd.randint(0, 25))) for _ in range(n)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "y", "z", "in", "p", "c") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_path())


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(alignment.default_path())
    found.encode_special_tokens = True
    return found


def test_merges_take_the_least_rank_first():
    rnd = random.Random(3)
    rules = {}
    while len(rules) < 60:
        a, b = rnd.randrange(40), rnd.randrange(40)
        rules.setdefault((a, b), (rnd.randrange(25), 5 + len(rules) % 35))
    pairs = PairTable([a for a, _ in rules], [b for _, b in rules], [r for r, _ in rules.values()], [m for _, m in rules.values()])

    def plain(word):
        word = list(word)
        while True:
            open_ = [(rules[p][0], i) for i, p in enumerate(zip(word, word[1:])) if p in rules]
            if not open_:
                return word
            _, i = min(open_)
            word[i:i + 2] = [rules[word[i], word[i + 1]][1]]

    words = [[rnd.randrange(6) for _ in range(rnd.choice([0, 1, 2, 5, 30, 95, 96, 97, 300]))] for _ in range(300)]
    ids, bounds = merge_words(np.array(sum(words, [])), np.cumsum([0, *map(len, words)]), pairs)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [plain(w) for w in words]
    assert [merge_one(list(w), pairs) for w in words if w] == [plain(w) for w in words if w]
    assert pairs.find(np.array([50]), np.array([50])).tolist() == [-1]


def test_pieces_equal_the_library(spark, library):
    texts = [None, "", " ", "a", "a", *mixtures(1500, 1, ["▁", "▁▁"]), "x" * 30_000, "word " * 40_000, "漢" * 5000]
    got = {r.doc_id: r for r in sentence_pieces.round_trip(docs(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        want = [1, *library.encode(text or ""), 2]
        assert np.frombuffer(got[i].ids, dtype="<u4").tolist() == want, repr(text)[:80]
        assert got[i].decoded == library.decode(want)
        assert (got[i]._in0, got[i].pair, got[i].text) == ("in", "p", text)
        ends = np.frombuffer(got[i].ends, dtype="<u4").tolist()
        assert ends[0] == 0 and ends == sorted(ends) and ends[-1] == len((text or "").encode())
    assert sentence_pieces.round_trip(docs(spark, [])).count() == 0


def test_spans_hold_the_pieces(spark):
    texts = mixtures(200, 2, ["▁", "▁ "])
    coded = sentence_pieces.round_trip(docs(spark, list(enumerate(texts)))).select("doc_id", "ids", "ends", "decoded", "pair")
    model = sentence_pieces.model(sentence_pieces.default_path())
    rows = sorted(sentence_pieces.piece_spans(coded).collect(), key=lambda r: (r.doc_id, r.place))
    assert len(rows) == sum(len(r.ids) // 4 for r in coded.collect()) and {r.pair for r in rows} == {"p"}
    for r in rows:
        span = texts[r.doc_id].encode()[r.first_byte:r.end_byte].replace("▁".encode(), b" ")
        want = model.outputs[r.id]
        assert span == (want[1:] if r.place == 1 and want.startswith(b" ") else want)


def test_any_ids_are_decoded_as_by_the_library(spark, library):
    rnd = random.Random(4)
    rows = [(i, b"".join(struct.pack("<I", rnd.choice([rnd.randrange(32_000), rnd.randrange(3, 259), rnd.randrange(3), 29871])) for _ in range(rnd.randrange(12))))
            for i in range(2000)] + [(2000, None)]
    got = sentence_pieces.decode_documents(spark.createDataFrame(rows, "n int, ids binary")).collect()
    for r in got:
        assert r.decoded == library.decode([x[0] for x in struct.iter_unpack("<I", r.ids or b"")])


def compiled_map(rules):
    """A double array with the given replacements: every state at its own 256 places, as the format allows."""
    states, edges, values, blob = {b"": 0}, {}, {}, b""
    for old, new in rules.items():
        for n in range(len(old)):
            edges.setdefault(old[:n], set()).add(old[n])
            states.setdefault(old[:n + 1], len(states))
        values[old] = len(blob)
        blob += new + b"\0"
    units = np.zeros(512 * (len(states) + 1), dtype=np.uint32)
    base = {s: 512 * (k + 1) for s, k in states.items()}

    def shift(at, to):
        """Offset from a unit to its children; large ones are kept in steps of 256."""
        gap = at ^ to
        return (gap << 10) if gap < 1 << 21 else (gap >> 8 << 10) | 0x200

    place = {b"": 0}
    for state in sorted(states, key=len):
        for byte in edges.get(state, ()):
            place[state + bytes([byte])] = base[state] ^ byte
    for state, at in place.items():
        label = state[-1] if state else 0
        units[at] = shift(at, base[state]) | label | (0x100 if state in values else 0)
        if state in values:
            units[base[state]] = values[state] | 0x80000000
    return struct.pack("<I", 4 * len(units)) + units.astype("<u4").tobytes() + blob


def test_longest_prefix_of_the_compiled_map():
    rules = {b"A": b"a", "ﬁ".encode(): b"fi", b"ab": b"X", b"abcd": b"YYY", "　".encode(): b" ", b"zz": b""}
    found = sentence_pieces.CharacterMap(compiled_map(rules))
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["A", "ﬁ", "ab", "abc", "abcd", "　", "z", "é", "漢", "b"]) for _ in range(rnd.randrange(12))).encode()
        out, before, at = b"", [], 0
        while at < len(text):
            old = max((r for r in rules if text.startswith(r, at)), key=len, default=None)
            width = len(old) if old else len(text[at:].decode()[0].encode())
            new = rules[old] if old else text[at:at + width]
            out, before, at = out + new, before + [at] * len(new), at + width
        got, ends = found.apply(text)
        assert (got, ends.tolist()) == (out, [*before, len(text)])
    assert sentence_pieces.CharacterMap(b"").apply(b"A b")[0] == b"A b"


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "m.model"
    path.write_bytes(b"\x0a\x05\x0a\x03abc")
    with pytest.raises(ValueError):
        sentence_pieces.PieceModel(str(path))


def plain_alignment(rows, library, byte_library):
    """Links, groups and counts by comparing every token of one side with those of the other."""
    found, count = [], Counter()
    for doc_id, text in rows:
        whole = b" " + (text or "").encode()
        a = byte_library.encode(" " + text, add_special_tokens=False) if text else None
        b = library.encode(text) if text else []
        pieces = [library.id_to_piece(i) for i in b]
        of_b = [bytes([int(p[3:5], 16)]) if library.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces)]
        if not text or b"".join(of_b) != whole:
            found.append((doc_id, [], [], [], ""))
            continue
        table = alignment.byte_characters()
        ids_a = a.ids
        of_a = [bytes(table.index(c) for c in byte_library.id_to_token(i)) for i in ids_a]
        assert b"".join(of_a) == whole
        ends_a, ends_b = np.cumsum([len(x) for x in of_a]).tolist(), np.cumsum([len(x) for x in of_b]).tolist()
        links = [(x, y) for x, e, s in zip(ids_a, ends_a, [0, *ends_a]) for y, f, t in zip(b, ends_b, [0, *ends_b]) if s < f and t < e]
        shared = sorted(set(ends_a) & set(ends_b))
        groups = ["|".join(",".join(str(i) for i, e in zip(ids, ends) if lo < e <= hi) for ids, ends in ((ids_a, ends_a), (b, ends_b)))
                  for lo, hi in zip([0, *shared], shared)]
        count.update(links)
        found.append((doc_id, ids_a, b, links, ";".join(groups)))
    most = {}
    for (_, y), n in count.items():
        most[y] = max(most.get(y, 0), n)
    return count, Counter((i, len(a), len(b), g.count(";") + 1 if g else 0, len(ls), sum(count[p] == most[p[1]] for p in ls), sum(count[p] for p in ls),
                           hashlib.sha256(g.encode()).hexdigest() if g else "", g) for i, a, b, ls, g in found)


def test_alignment_equals_a_plain_version(spark, library, byte_library, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_BYTES", 2000)
    monkeypatch.setattr(alignment, "CHUNK_LINKS", 3000)
    rows = list(enumerate([None, "", " ", "▁", "a ▁ b", "same", "same", *mixtures(400, 6), "long " * 300 + "x" * 400])) + [(None, "no id"), (5, "same")]
    documents, pairs = alignment.align(docs(spark, rows).repartition(3), keep_groups=True)
    count, want = plain_alignment(rows, library, byte_library)
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in documents.collect())
    assert got == want
    assert {(r.a_id, r.b_id): r.n for r in pairs.collect()} == dict(count)
    best = {r.b_id: r.n for r in pairs.collect() if r.best}
    assert all(best[b] == max(n for (_, y), n in count.items() if y == b) for b in best) and set(best) == {b for _, b in count}
    assert alignment.align(docs(spark, []))[0].count() == 0


def test_queries_of_the_tokenizers(spark, library, byte_library):
    from vocspark.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op13_sentence_pieces"](spark, folder).collect():
        ids = [1, *library.encode(texts[r.doc_id] or ""), 2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    some = [i for i in sorted(texts) if len(texts[i] or "") < 1500][:40]
    rows = QUERIES["op12_tokenizer_alignment"](spark, folder).collect()
    assert len(rows) == len(texts)
    _, want = plain_alignment([(i, texts[i]) for i in some], library, byte_library)
    plain = {w[0]: w for w in want}
    for r in rows:
        if r.doc_id in plain:
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups_sha256) == (*plain[r.doc_id][1:5], plain[r.doc_id][7])
        assert r.n_links == max(r.n_a + r.n_b - r.n_groups, 0) and 0 <= r.n_best <= r.n_links <= r.count_sum


def test_word_ids_equal_the_library():
    from tokenizers import Tokenizer
    from vocspark.llm import token_files
    path = token_files.default_path()
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    coder = token_files.WordEncoder(path)
    assert coder._letters is not None
    texts = ["", *mixtures(1500, 8, ["Ł", "ß", "ªº", "İ", "don't", "12.", "a,", ". ", ", ", "É", "word", "THE"]), "x" * 3000, "Abc" * 200]
    got = coder.encode_batch([t.encode() for t in texts])
    for text, ids in zip(texts, got):
        assert np.frombuffer(ids, dtype=coder.dtype).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)[:80]


def test_writing_tasks_keep_no_encoded_parts(spark):
    from vocspark.llm import token_files
    frame = spark.createDataFrame([(i, f"some word{i} more") for i in range(3000)], "doc_id bigint, text string")
    token_files.write_shards(frame, token_files.fresh_folder(spark, "tokens"))

    def held(batches):
        import pyarrow as pa
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(token_files.encoder(token_files.default_path()).known)])], names=["n"])

    # Workers stay between jobs; a new one holds the empty part alone, as one that has written should.
    rows = spark.range(0, 64, 1, 8).mapInArrow(held, "n bigint").collect()
    assert {r.n for r in rows} == {1}
    coder = token_files.encoder(token_files.default_path())
    ids = coder.encode_batch([b"Some words, and more."])
    assert len(coder.known) > 1
    coder.forget()
    assert len(coder.known) == 1 and coder.encode_batch([b"Some words, and more."]) == ids
