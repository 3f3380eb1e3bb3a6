"""WARC, mixing, vectors, near-duplicates, context mixing and the pipeline on hand-made rows and against plain versions."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from vocspark.llm import components, context_mixing, minhash, mixing, vectors, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, domain string, component_id string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", None, "clash", "clash") for i, t in texts], DOCS)


def test_warc_round_trip(spark):
    big, ties = "é<p>" * 400, "x" * 1200
    pages = [(1, "http://a.example.com/x?q=1", big), (2, "https://b.example.org:8080/", big), (3, None, big), (4, "", None), (5, "no url\r\nX: y", ""),
             (6, "http://a.example.com/x?q=1", "small"), (7, "http://a.example.com/x?q=1", "small"), (8, "http://u@H.example.com", ties), (8, "http://u@H.example.com", ties),
             (None, "http://n.example.com", ties), (9, "http://z.example.com/" + "p" * 5000, "y" * 200_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id bigint, url string, html string, payload string")
    got = warc.round_trip(spark, df.select("page_id", "url", "html")).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter()
    for i, _, html in pages:
        same = [j for j, _, h in pages if h == html and len((h or "").encode()) >= 1000 and j is not None]
        main = max(same, default=None) if len((html or "").encode()) >= 1000 else None
        revisit = main is not None and i != main
        want[i, len((html or "").encode()), sha(html), "revisit" if revisit else "response", main if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(bytes(r.payload) == (b"" if r.record_type == "revisit" else r.payload) for r in got)
    assert warc.round_trip(spark, df.select("page_id", "url", "html").limit(0)).count() == 0


def test_keys_are_reversed_hosts(spark):
    urls = ["http://www.Example.COM/a/b?c#d", "https://u:p@x.org:81/", "//h.net", "", None, "mailto:me"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(warc.surt(F.col("u"))).collect()]
    assert got[:5] == ["com,example,www)/a/b?c#d", "org,x):81/", "net,h)", "", ""]


def test_index_finds_every_key_and_no_other(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    report = spark.createDataFrame([(f"com,h{i % 7})", i // 2, "f", i, 1) for i in range(200)], warc.REPORT)
    from vocspark.llm.common import fresh_folder
    index = warc.build_index(report, fresh_folder(spark, "index"))
    wanted = spark.createDataFrame([("com,h1)", 0), ("com,h0)", 0), ("zz", 1), ("", None)], "surt string, page_id bigint")
    got = {(r.surt, r.page_id, r.offset) for r in warc.look_up(wanted, index).collect()}
    assert got == {("com,h0)", 0, 0), ("com,h1)", 0, 1)}
    assert warc.look_up(report.select("surt", "page_id"), index).count() == 200


def plain_budget(given, children):
    """Children (cap, weight): fill in proportion to the weights until all is given or full."""
    out, open_ = {}, dict(children)
    while open_:
        total = sum(w for _, w in open_.values())
        left = given - sum(out.values())
        full = {k: c for k, (c, w) in open_.items() if c * total <= w * left}
        if not full:
            return out | {k: w * left // total for k, (c, w) in open_.items()}
        out |= full
        open_ = {k: v for k, v in open_.items() if k not in full}
    return out


def test_budgets_go_to_siblings_before_ancestors(spark):
    mix = mixing.Mix(domain_of={"s1": "d1", "s2": "d1", "s3": "d2"}, domains={"d1": 3, "d2": 1}, languages={"en": 2, "de": 1}, share=100, max_epochs=2)
    leaves = [("d1", "en", "s1", 100), ("d1", "en", "s2", 900), ("d1", "de", "s1", 50), ("d2", "en", "s3", 1000), ("d2", "", "", 0)]
    got = {tuple(r[:3]): r.budget for r in mixing.leaf_budgets(
        spark.createDataFrame(leaves, "_domain string, _lang string, _source string, tokens bigint"), mix).collect()}
    top = plain_budget(2050, {"d1": (2100, 3), "d2": (2000, 1)})
    d1 = plain_budget(top["d1"], {"en": (2000, 2), "de": (100, 1)})
    d2 = plain_budget(top["d2"], {"en": (2000, 2), "": (0, 1)})
    want = {("d1", "en", k): v for k, v in plain_budget(d1["en"], {"s1": (200, 1), "s2": (1800, 1)}).items()}
    want |= {("d1", "de", "s1"): d1["de"], ("d2", "en", "s3"): d2["en"], ("d2", "", ""): 0}
    assert got == want


def test_mixture_takes_prefixes_of_epochs(spark):
    rows = docs(spark, [(i, "w " * (i % 5)) for i in range(300)] + [(None, "a b"), (7, "w w"), (8, None)])
    mix = mixing.Mix(domain_of={"src0": "a", "src1": "b"}, domains={"a": 5, "b": 1}, share=100, max_epochs=3)
    got = mixing.mix_documents(rows, mix).collect()
    per_leaf = {}
    for r in got:
        per_leaf.setdefault((r.domain, r.source, r.leaf_target), Counter())[r.epoch] += r.n_tokens
    for (_, _, target), epochs in per_leaf.items():
        assert sum(epochs.values()) >= target > sum(epochs.values()) - 5 - 2
        assert sorted(epochs) == list(range(max(epochs) + 1))
    assert mixing.mix_documents(rows.limit(0), mix).count() == 0
    with pytest.raises(ValueError):
        mixing.Mix(share=0)


def plain_vectors(rows):
    ok = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and None not in v and all(map(math.isfinite, v)) and any(v):
            ok[i] = (np.array(v, dtype=float) / np.linalg.norm(v), label)
    links = {i: [j for j in ok if j != i and ok[j][1] == ok[i][1] and len(ok[j][0]) == len(ok[i][0]) and ok[i][0] @ ok[j][0] >= 0.98] for i in ok}
    comp = {i: i for i, _, _ in rows}
    for _ in rows:
        for i in links:
            comp[i] = min([comp[i], *(comp[j] for j in links[i])])
    return {i: (len(links.get(i, ())), comp[i], comp[i] == i) for i, _, _ in rows}


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(30):
        centre = rng.normal(size=16)
        for k in range(int(rng.integers(1, 12))):
            rows.append((len(rows), [float(x) for x in centre + rng.normal(size=16) * 0.1], c % 3))
    rows += [(len(rows) + k, v, label) for k, (v, label) in enumerate([
        (None, 1), ([], 1), ([0.0] * 16, 1), ([None] + [1.0] * 15, 1), ([math.nan] * 16, 1), ([math.inf] * 16, 1), ([1.0] * 16, None), (rows[0][1], 0), (rows[0][1], 1),
        ([2.0, 0.0], 1), ([1.0, 0.0], 1)])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id bigint, embedding array<double>, label int, n_links int")
    for block in (2048, 4):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_vectors(df, block=block).collect()}
        assert got == plain_vectors(rows)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def shingles(text):
    ws = [w.decode() for w in (text or "").encode().lower().split()]
    return {tuple(ws[i:i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} if ws else set()


def plain_near(rows):
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    for _ in rows:
        for i in sets:
            for j in sets:
                if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def near_rows():
    rng = np.random.default_rng(4)
    vocab, rows = [f"w{i}" for i in range(3000)], []
    for _ in range(8):
        base = [vocab[k] for k in rng.integers(0, 3000, 120)]
        for _ in range(6):
            copy = list(base)
            for k in rng.integers(0, 120, int(rng.integers(0, 9))):
                copy[k] = vocab[int(rng.integers(0, 3000))]
            rows.append((len(rows), " ".join(copy)))
    return rows + [(len(rows) + k, t) for k, t in enumerate([None, "", "  ", "one two", "ONE  two", "one two three", rows[0][1].upper(), rows[3][1], "z " * 20_000])]


def test_near_duplicates_against_all_pairs(spark, monkeypatch):
    rows = near_rows()
    for block in (256, 3):
        monkeypatch.setattr(minhash, "BLOCK_ROWS", block)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
        assert got == plain_near(rows)
    twice = minhash.near_duplicates(docs(spark, rows[:3] + rows[:1] + [(None, rows[0][1])])).collect()
    assert len(twice) == 5 and [r.kept for r in twice if r.doc_id is None] == [True]
    assert minhash.near_duplicates(docs(spark, []).limit(0)).count() == 0


def test_sketches_leave_texts_behind(spark):
    found = minhash.sketches(docs(spark, [(1, "a b c d e f"), (2, None)]))
    assert found.columns == ["doc_id", "n_shingles", "print_1", "print_2", "sketch"]
    assert sorted((r.doc_id, r.n_shingles) for r in found.collect()) == [(1, 2), (2, 0)]


def test_large_families_are_cut_by_set_size(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(6)
    sizes = {i: int(rng.integers(1, 400)) for i in range(200)} | {1000 + i: 5 + i for i in range(10)}
    sized = spark.createDataFrame([(i, i // 1000, n) for i, n in sizes.items()], "id bigint, family bigint, n bigint")
    blocks = {}
    for r in minhash.block_pairs(sized).collect():
        blocks.setdefault((r.family, r.lo, r.hi), []).append((r.id, r.mine))
    compared = Counter()
    for (_, lo, hi), rows in blocks.items():
        compared.update(frozenset((a, b)) for a, x in rows for b, y in rows if (x, y) == (lo, hi) and (a < b if lo == hi else a != b))
    near = {frozenset((a, b)) for a in sizes for b in sizes if a < b and a // 1000 == b // 1000 and 100 * min(sizes[a], sizes[b]) >= 75 * max(sizes[a], sizes[b])}
    assert near <= set(compared) and set(compared.values()) == {1}
    assert len(compared) < 0.5 * 200 * 199 / 2  # the whole family before
    assert sum(a > 999 for pair in compared for a in pair) == 10 * 9  # a small family stays whole


def test_near_duplicates_of_families_cut_by_set_size(spark, monkeypatch):
    rows = near_rows()
    rows += [(100 + k, " ".join(rows[0][1].split()[:n])) for k, n in enumerate(range(40, 121, 4))]  # one text cut short, in a chain
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 2)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs(spark, rows)).collect()}
    assert got == plain_near(rows)


def test_pairs_of_a_full_pair_of_blocks_are_kept_small():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 380).astype(np.uint64)
    sets = [np.unique(np.concatenate((base, rng.integers(0, 2**63, 16).astype(np.uint64)))) for _ in range(1024)]
    marks = np.stack([minhash.sketch(x) for x in sets])
    tracemalloc.start()
    found = minhash.block_links(list(range(512)), list(range(512, 1024)), sets, marks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 1023 and peak < 16_000_000  # 33.7 MB before


def test_possible_takes_each_pair_of_sizes_on_its_own():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 900).astype(np.uint64)
    sets = [np.unique(np.concatenate((base[:n], rng.integers(0, 2**63, m).astype(np.uint64)))) for n, m in ((900, 0), (800, 90), (700, 10), (500, 400), (900, 0))]
    marks, sizes = np.stack([minhash.sketch(x) for x in sets]), np.array([len(x) for x in sets])
    together = minhash.possible(np.broadcast_to(marks[0], marks.shape), marks, np.full(len(sets), sizes[0]), sizes)
    alone = [minhash.possible(marks[:1], marks[k:k + 1], sizes[:1], sizes[k:k + 1])[0] for k in range(len(sets))]
    assert together.tolist() == alone and alone[0] and not alone[3]


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(1)
    a, b = (np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (900, 700))
    one, two = minhash.sketch(a), minhash.sketch(b)
    assert (minhash.merged(one, two) == minhash.sketch(np.union1d(a, b))).all()
    near = np.unique(np.concatenate((a[:850], b[:50])))
    sizes = np.array([len(a)]), np.array([len(near)])
    assert minhash.possible(one[None], minhash.sketch(near)[None], *sizes)[0]
    assert not minhash.possible(one[None], two[None], sizes[0], np.array([len(b)]))[0]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.id: r.component_id for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}


def test_context_mixing_base_and_distribution(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Sat", "mat", f"odd{i}"], int(rng.integers(0, 12))))) for i in range(120)] + [(500, None), (501, "")]
    df = docs(spark, rows + [rows[5]])
    small = context_mixing.score_documents(df, frequent=3).collect()
    large = {r.doc_id: r for r in context_mixing.score_documents(df).collect()}
    given = rows + [rows[5]]
    tokens = [(i, (t or "").encode().lower().split() + [None]) for i, t in given]
    learns = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    c = Counter(w for i, ws in tokens if learns(i) for w in ws)
    n, v = sum(c.values()), len(c)
    assert len(small) == len(given)
    for r in small:
        ws = dict(tokens)[r.doc_id]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learns(r.doc_id), len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
        assert (large[r.doc_id].score, large[r.doc_id].base_score) == (pytest.approx(r.score), pytest.approx(r.base_score))
    assert context_mixing.score_documents(df.limit(0)).count() == 0


def test_bit_probabilities_add_up():
    counts = np.zeros((context_mixing.CONTEXTS, 2, 1 << context_mixing.SLOT_BITS), dtype=np.float32)
    model = context_mixing.Tables(counts, context_mixing.start_weights(), np.zeros((context_mixing.GATES, context_mixing.BUCKETS, 2)))
    one_byte = [bytes([b]) for b in range(256) if b not in (10, 32)]
    firsts = context_mixing.log10_scores(one_byte, model) - 8 * math.log10(0.5)  # without the blank that follows
    assert sum(10 ** firsts) + 2 / 256 == pytest.approx(1.0, abs=1e-3)


def test_frequent_words_cost_fewer_bits(spark):
    rows = [(i, "common common common rare" + str(i)) for i in range(200)]
    got = {r.doc_id: r.score for r in context_mixing.score_documents(docs(spark, rows + [(900, "common"), (901, "qzxjvk")])).collect()}
    assert got[900] > got[901]


def test_context_counts_are_exact_across_parts(spark):
    rng = np.random.default_rng(7)
    words = sorted({bytes(rng.choice(list(b"abcd\xc3\0"), int(rng.integers(1, 9))).tolist()) for _ in range(3000)}) + [b"abc" * 300, b"abc" * 300 + b"d"]
    rows = [(i * 37, w, int(i % 4 and rng.integers(0, 5000))) for i, w in enumerate(words)] + [(-1, b"", 11)]
    df = spark.createDataFrame(rows, "tok bigint, word binary, c bigint")
    want = Counter()
    for _, w, c in rows:
        spelled = w + b" " if w else b"\n"
        for i, byte in enumerate(spelled):
            for kind, ctx in enumerate((min(i, 20), spelled[max(0, i - 1):i], spelled[max(0, i - 2):i], spelled[max(0, i - 3):i], spelled[:i])):
                bits = f"{byte:08b}"
                for k in range(8):
                    want[kind, ctx, bits[:k], bits[k]] += c
    for size in (2000, 1 << 20):
        between = context_mixing.cuts(df, size)
        assert (len(between) > 3) == (size == 2000)
        heads, parts = context_mixing.heads_of(between), context_mixing.deal(df, between)
        grams = context_mixing.count_grams(parts, heads, context_mixing.fresh_folder(spark, "lm"))
        seen = 0
        for _, copies, data in context_mixing._parts(parts.toArrow().to_batches()):
            part = context_mixing.Part(data, copies, heads, grams)
            counts = [part.lookup()(k) for k in range(8)]
            for a, b in zip(part.starts[:-1], part.starts[1:]):
                spelled = data[a:b]
                seen += 1
                for i in sorted({*range(min(len(spelled), 12)), len(spelled) - 1}):
                    contexts = (min(i, 20), spelled[max(0, i - 1):i], spelled[max(0, i - 2):i], spelled[max(0, i - 3):i], spelled[:i])
                    bits = f"{spelled[i]:08b}"
                    for k in range(8):
                        for kind, ctx in enumerate(contexts):
                            assert tuple(counts[k][side][kind, a + i] for side in (0, 1)) == tuple(want[kind, ctx, bits[:k], side] for side in "01")
        assert seen == len(rows)


def test_inputs_are_worked_out_once_for_each_gram(spark, monkeypatch):
    rows = [(i, w, i % 5) for i, w in enumerate(sorted({b"%d" % (i * i) for i in range(3000)}))]
    df = spark.createDataFrame(rows, "tok bigint, word binary, c bigint")
    parts = context_mixing.deal(df, [])
    heads = context_mixing.heads_of([])
    grams = context_mixing.count_grams(parts, heads, context_mixing.fresh_folder(spark, "lm"))
    (_, copies, data), = context_mixing._parts(parts.toArrow().to_batches())
    part, sizes, stretched = context_mixing.Part(data, copies, heads, grams), [], context_mixing._stretched
    monkeypatch.setattr(context_mixing, "_stretched", lambda zeros, ones: sizes.append(zeros.size) or stretched(zeros, ones))
    known = np.flatnonzero(np.repeat(copies, np.diff(part.starts)) > 0)
    for at in (known, known[::3]):
        lookup = part.lookup(at)
        for place, (_, bit) in enumerate(context_mixing.bits(part.data[at])):
            for taken in (None, bit):
                inputs, gates = context_mixing._predictions(lookup, place, taken)
                plain_inputs, plain_gates = context_mixing._predictions(lambda k: lookup(k), place, taken)
                assert inputs.tolist() == plain_inputs.tolist() and gates.tolist() == plain_gates.tolist()
                sizes.pop()
    # With and without the byte at hand: each distinct gram, and each byte with the word so far.
    assert sum(sizes) == 2 * 8 * (part.zeros.shape[1] + len(part.data)) and part.zeros.shape[1] < len(part.data)


def test_places_of_hashes_and_equal_values():
    rng = np.random.default_rng(2)
    ends = np.array([-2**63, -2**63 + 1, -1, 0, 1, 2**63 - 2, 2**63 - 1])
    for held in (np.sort(np.concatenate((rng.integers(-2**63, 2**63 - 1, 5000), ends))), ends[::2], ends[3:4], ends[:0]):
        wanted = np.concatenate((rng.permutation(held), ends, rng.integers(-2**63, 2**63 - 1, 500), held[:50] + (held[:50] < 2**62)))
        at = context_mixing.Places(held).of(wanted)
        for x, i in zip(wanted.tolist(), at.tolist()):
            assert i == 0 if not len(held) else (held[i] == x) == (x in held)
    few = rng.integers(-2**63, 2**63 - 1, 40)
    for values in (rng.integers(0, 40, 600), few[rng.integers(0, 40, 600)], few[:3], few[:0], np.array([5, 6, 5, 6, 6]) | 1 << 62):
        order, new = context_mixing.by_value(values)
        want = {}
        for i, x in enumerate(values.tolist()):
            want.setdefault(x, []).append(i)
        got = np.split(order, np.flatnonzero(new)[1:]) if len(values) else []
        assert sorted(g.tolist() for g in got) == sorted(want.values())


def test_frequent_words_are_learned_from_as_often_as_they_stand():
    copies = np.arange(1, 5001) % 7 + 1
    copies[[3, 4000]] = 5_000_000, 1001
    learned = np.zeros(len(copies))
    for some, loads in context_mixing.steps(copies, np.random.default_rng(3).permutation(len(copies))):
        learned[some] += loads
        assert loads.sum() < 2 * copies.sum() / 3
    assert learned == pytest.approx(copies)


def test_weights_do_not_depend_on_how_often_all_texts_are_repeated():
    rng = np.random.default_rng(5)
    words = sorted({bytes(rng.choice(list(b"abcdefg"), int(rng.integers(1, 9))).tolist()) for _ in range(400)})
    data, starts = context_mixing.spellings(words)
    copies = rng.integers(1, 900, len(words)).astype(float)
    table = rng.integers(1, 50, (context_mixing.CONTEXTS, 2, 1 << context_mixing.SLOT_BITS)).astype(np.float32)
    got = []
    for times in (1, 1000):
        weights, refined = context_mixing.start_weights(), np.zeros((context_mixing.GATES, context_mixing.BUCKETS, 2))
        curve, load = np.full(weights.shape, context_mixing.CURVE_START), np.repeat(copies * times, np.diff(starts))
        lookup = context_mixing.Tables(table, None, None).lookup(data, starts)
        for seen in range(5):
            context_mixing.train(data, lookup, load, weights, refined, curve, seen, load.sum())
        got.append((weights, refined / times))
    assert got[0][0] == pytest.approx(got[1][0]) and got[0][1] == pytest.approx(got[1][1])
    assert np.abs(got[0][0] - context_mixing.start_weights()).max() > 1e-3


def test_context_mixing_reads_over_words_and_adapts(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):  # words that end in x are followed by words that begin with qu
        words = [str(w) for _ in range(10) for w in (lambda a: (f"a{a}x", f"qu{a}") if a % 2 else (f"b{a}y", f"zo{a}"))(int(rng.integers(0, 40)))]
        rows.append((i, " ".join(words)))
    held_out = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1]
    probes = list(zip(held_out, ["a1x qu3 b2y zo4", "a1x zo4 b2y qu3", "newword1 newword1 newword1 newword1", "newword1", None]))
    right, shuffled, four, one, none = held_out[:5]
    df = docs(spark, rows + probes)
    got = {r.doc_id: r for r in context_mixing.score_documents(df, part_bytes=300).collect()}
    assert got[right].base_score == pytest.approx(got[shuffled].base_score) and got[right].score > got[shuffled].score + 1
    assert got[four].score > 4 * got[one].score + 1
    assert got[none].bits_per_byte == pytest.approx(-got[none].score / math.log10(2))
    spelled = sum(len(w) + 1 for w in probes[0][1].split()) + 1
    assert got[right].bits_per_byte == pytest.approx(-got[right].score / math.log10(2) / spelled)
    for tasks in (1, 8):
        again = {r.doc_id: r.score for r in context_mixing.score_documents(df.repartition(tasks), part_bytes=300).collect()}
        assert again == pytest.approx({k: r.score for k, r in got.items()}, rel=1e-9)


def test_border_probabilities_add_up():
    rng = np.random.default_rng(4)
    grams = np.unique(rng.integers(97, 103, 60) << 16 | rng.integers(97, 103, 60) << 8 | rng.integers(97, 110, 60))
    border = context_mixing.Border(grams, rng.integers(1, 50, len(grams)).astype(float))
    for left in (grams[0] >> 8, 0x2020):
        assert (10 ** border.lookup((left << 8) + np.arange(256))).sum() == pytest.approx(1.0)
    assert 10 ** border.lookup(grams[:1])[0] > 0.01


def test_text_so_far_and_its_odds():
    hashes = np.array([5, 7, 5, 5, 9, 5, 9, 7])
    before, same = context_mixing.text_so_far(hashes, np.array([0, 5, 8]))
    assert before.tolist() == [0, 1, 2, 3, 4, 0, 1, 2] and same.tolist() == [0, 0, 1, 2, 0, 0, 0, 0]
    histogram = np.zeros((context_mixing.TEXT_GATES, context_mixing.CELLS))
    histogram[3, [0, context_mixing.CELL_ZERO + 40]] = 700, 300  # never there, and 10**5 times likelier by the text so far
    odds = context_mixing.text_odds(histogram.ravel())
    assert odds[3] == pytest.approx(300 / 701, rel=1e-2) and odds[2] == 0


def test_pipeline_stages_take_effect(spark):
    folder = "/root/testdata/sf0.001"
    given = spark.read.parquet(f"{folder}/documents.parquet")
    now, names = given, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "toxicity", "minhash_near_dedup", "mix_sources", "bpe_round_trip"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, folder)
        assert after.columns == given.columns and after.dtypes == given.dtypes
        now = after
    kept = now.count()
    assert 0 < kept
    out = corpus_pipeline.run(spark, folder)
    assert out.count() == kept and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    for r in now.join(out.select("doc_id", "decoded_sha256"), "doc_id").collect():
        assert r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_all_queries_are_registered():
    numbers = {int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in entry.queries()) if m}
    assert numbers == set(range(1, 11)) and "pipeline" in entry.queries()


def test_stages_carry_columns_of_any_name(spark):
    names = ["_text", "_words", "_lines", "_hashes", "kept", "n_words", "score", "predicted", "epochs", "epoch", "cut", "_lang", "_domain", "_source", "domain",
             "component_id", "u", "_in0", "carried_0", "n_tokens_of_mine", "a.b"]
    text = "Some words that say nothing bad, and then a few more of them so that the text is long enough for every rule. " * 3
    rows = [(i, text.replace("few", f"few{i} other{i} x{i} y{i} z{i} w{i} v{i}"), "en", f"src{i % 2}", 10, *[f"{n}-{i}" for n in names]) for i in range(12)]
    rows += [(50, None, "en", "src1", None, *names), (51, "", None, None, 0, *names)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{n}` string" for n in names))
    own = {r[0]: tuple(r)[5:] for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, docs, "/root/testdata/sf0.001")
        for r in got.select("doc_id", *[f"`{n}`" for n in names]).collect():
            assert tuple(r)[1:] == own[r.doc_id], name
        assert stage(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    assert {"ids", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns)
    replaced = corpus_pipeline.STAGES[-1][1](spark, docs.withColumnRenamed("n_tokens_of_mine", "N_tokens"), "")
    assert [c.lower() for c in replaced.columns].count("n_tokens") == 1
