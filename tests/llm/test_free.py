"""The other operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fieldcast.llm import (_bytes, _graph, _tokens, classifier, decontaminate, lm_scoring, near_dedup, packing,
                           suffix_dedup, token_output)
from fieldcast.llm._graph import components
from fieldcast.session import stored
from tests.llm.frames import clashing, documents, empty, odd_documents

WS = r"[^\x20\x09-\x0D]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(WS, (text or "").translate(LOWER))


def test_word_hashes_tell_words_apart():
    texts = [r[1] for r in odd_documents()]
    flat, rows = _bytes.word_hashes(pa.array(texts))
    own = {}
    for a, b, t in zip(rows[:-1], rows[1:], texts):
        w = words(t)
        assert b - a == len(w)
        for h, x in zip(flat[a:b].tolist(), w):
            assert own.setdefault(x, h) == h
    assert len(set(own.values())) == len(own)


# -- op3 ----------------------------------------------------------------------
def test_decontaminate(spark):
    item = " ".join(f"Tok{i}" for i in range(30))
    swapped = item.split(" ")
    swapped[4], swapped[13], swapped[22] = "zz", "yy", "xx"
    far = [w if i % 2 else "no" for i, w in enumerate(item.split(" "))]
    rows = [(1, f"before {item.upper()} after"), (2, " ".join(swapped)), (3, " ".join(far)),
            (4, " ".join(item.split(" ")[:6])), (5, "before, " + item.replace(" ", ", ") + "!"),
            (6, None), (7, ""), (1, f"before {item} after"), (None, item), (8, item * 3)]
    docs = clashing(spark.createDataFrame(rows, "doc_id int, text string"))
    bench = clashing(spark.createDataFrame([(10, item), (11, "too short"), (12, None), (13, item)],
                                           "item_id int, text string"))
    got = Counter((r.doc_id, r.n_items) for r in decontaminate.report(docs, bench).collect())
    assert got == Counter({(1, 2): 2, (2, 2): 1, (3, 0): 1, (4, 0): 1, (5, 2): 1, (6, 0): 1, (7, 0): 1,
                           (None, 2): 1, (8, 2): 1})
    blocks = decontaminate.report(docs, bench, block=20).collect()
    assert Counter((r.doc_id, r.n_items) for r in blocks) == got
    hit = decontaminate.report(docs, bench).where("doc_id = 2").first().hits[0]
    assert (hit.length, hit.matched, hit.doc_start) == (30, 27, 0)
    clean = decontaminate.clean_only(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {3, 4, 6, 7}
    none = spark.createDataFrame([], "item_id int, text string")
    assert decontaminate.clean_only(docs, none).count() == len(rows)


def test_short_items_and_items_without_an_id(spark):
    short = "who wrote the old green book"
    long = " ".join(f"Tok{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"they ask: {short.upper()}? yes"), (2, "who wrote the new green book"),
                                  (3, "a b c d e"), (4, long), (5, short)], "doc_id int, text string")
    bench = spark.createDataFrame([(10, short), (None, long), (11, "a b c d e"), (None, None)],
                                  "item_id int, text string")
    got = {r.doc_id: [h.item_id for h in r.hits] for r in decontaminate.report(docs, bench).collect()}
    assert got == {1: [10], 2: [], 3: [], 4: [None], 5: [10]}


# -- op4 ----------------------------------------------------------------------
def repeats(texts, length):
    at = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for x in raw:
        for i in range(len(x) - length + 1):
            at[x[i:i + length]] += 1
    out = []
    for x in raw:
        gone = np.zeros(len(x) + 1, bool)
        for i in range(len(x) - length + 1):
            if at[x[i:i + length]] > 1:
                gone[i:i + length] = True
        gone = gone[:-1]
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2048, 1])
def test_suffix_dedup(spark, hot):
    rows = odd_documents()
    want = Counter((r[0], *x) for r, x in zip(rows, repeats([r[1] for r in rows], 60)))
    got = suffix_dedup.deduplicated(clashing(documents(spark, rows)), length=60, gram=20, hot=hot)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)
                   for r in got.collect()) == want


def test_columns_find_what_sorting_finds():
    rng = np.random.default_rng(5)
    for _ in range(20):
        m, length, gram = 30, 12, 4
        n = rng.integers(1, length - gram + 2, m)
        anchors = np.array([rng.integers(max(0, k - 1), length - gram + 1) for k in n])
        keys = np.sort(rng.integers(0, 4, m)).astype(np.uint64)
        texts = [bytes(rng.integers(97, 99, k + length - 1).astype(np.uint8)) for k in n]
        starts = np.cumsum([0, *map(len, texts)])[:-1]
        hit = suffix_dedup.order_columns(keys, np.frombuffer(b"".join(texts), np.uint8), starts, n,
                                         anchors, length, gram)
        # only strings that start in the same column of a collection can be compared
        seen = Counter((int(keys[i]), int(s - anchors[i]), texts[i][s:s + length])
                       for i in range(m) for s in range(n[i]))
        for i in range(m):
            for s in range(n[i]):
                assert hit[i, s] == (seen[int(keys[i]), int(s - anchors[i]), texts[i][s:s + length]] > 1)


# -- op5 ----------------------------------------------------------------------
def test_lm_scoring(spark):
    rows = odd_documents()
    got = lm_scoring.report(clashing(documents(spark, rows))).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter()
    for r in rows:
        if not held(r[0]):
            c.update(words(r[1]) + [None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for r in rows:
        w = words(r[1]) + [None]
        base = sum(math.log10((c[x] + 1) / (n + 1 * (v + 1))) for x in w)
        want[r[0], held(r[0]), len(w), sum(c[x] > 0 for x in w), n, round(base, 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens,
                    round(r.base_score, 6)) for r in got) == want
    assert all(r.score <= 0 for r in got)


def test_classifier_learns_in_a_task(spark, monkeypatch):
    import os

    monkeypatch.setattr(classifier, "train", lambda texts, labels, **_: classifier.Model(
        np.array([os.getpid() % 2**20, len(texts)], np.float32), 0.5))
    docs = documents(spark, [(i, f"text {i}", None, None, None) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    model = classifier.fit(docs, labels)
    assert model.weights[0] != os.getpid() % 2**20 and model.weights[1] > 20 and model.bias == 0.5
    none = classifier.fit(docs.where("doc_id < 0"), labels)
    assert none.weights[1] == 0


def test_lm_scoring_of_a_block_holds_little_by_the_token():
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 400) % 100_000) for _ in range(4000)]
    part = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts)})
    flat, rows = lm_scoring.tokens(part.column("text"))
    n_words, n_pairs = len(np.unique(flat)), len(np.unique(lm_scoring.pair_keys(flat, rows)[0]))
    ones = lambda n, kind=np.uint8: lm_scoring.packed(np.ones(n, kind))
    told = pa.table({"kind": pa.array([0, 1], pa.int32()), "share": pa.array([0, 0], pa.int32()),
                     "levels": [ones(n_pairs), ones(n_words)], "rests": [None, ones(n_words)],
                     "counts": [None, ones(n_words, np.int64)]})
    none = lm_scoring.Table(np.empty(0, np.uint64), np.empty(0, np.int64))
    tracemalloc.start()
    got = lm_scoring._block_scores(pa.Table.from_batches([part]), told, none, None, 1000, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got["doc_id"].to_pylist() == list(range(len(texts)))
    assert got["known"].to_pylist() == got["n"].to_pylist() == np.diff(rows).tolist()
    assert peak < 12 * sum(map(len, texts))


def test_merging_counts_holds_little():
    import tracemalloc

    rng = np.random.default_rng(8)
    keys = [np.unique(rng.integers(0, 1 << 18, 1 << 16).astype(np.uint64)) for _ in range(4)]
    tracemalloc.start()
    held = [(k.copy(), k * np.uint64(3), np.arange(len(k))) for k in keys]
    size = sum(x.nbytes for t in held for x in t)
    k, v, c = lm_scoring._merged(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = Counter()
    for x in keys:
        want.update(dict(zip(x.tolist(), range(len(x)))))
    assert dict(zip(k.tolist(), c.tolist())) == want and (np.diff(k.astype(np.int64)) > 0).all()
    assert (v == k * np.uint64(3)).all() and peak < 3 * size
    none = np.empty(0, np.uint64)
    assert [len(x) for x in lm_scoring._merged([(none, none, none.astype(np.int64))])] == [0, 0, 0]


def test_filter_holds_every_count():
    keys = _bytes.mix(np.arange(3000, dtype=np.uint64))
    counts = np.random.default_rng(1).integers(1, 10**6, 3000)
    f = lm_scoring.Part.of(keys, counts)
    assert f.size >= lm_scoring.ROOM * lm_scoring.level(counts).sum()
    want, got = (lm_scoring.MEANS[x] for x in (lm_scoring.level(counts), f.levels(keys)))
    assert (got >= want).all() and (got == want).mean() > 0.9  # errors only raise a count
    assert (f.levels(_bytes.mix(np.arange(10**6, 10**6 + 2000, dtype=np.uint64))) == 0).mean() > 0.9
    assert abs(want / counts - 1).max() < 0.25
    empty_part = lm_scoring.Part.of(keys[:0], counts[:0])
    assert not empty_part.levels(keys).any()


def test_numbers_survive_packing():
    for x in (np.array([], np.uint64), np.array([5, 9, 2**63, 2**64 - 1], np.uint64)):
        assert np.array_equal(lm_scoring.rising(lm_scoring.gaps(x)), x)
    for c in (np.array([], np.int64), np.array([1, 254, 255, 256, 10**12])):
        assert np.array_equal(lm_scoring._counts(*lm_scoring._small(c)), c)


def test_broadcast_and_shards_give_the_same_levels(spark, monkeypatch):
    docs = documents(spark)
    model = lm_scoring.train(docs)
    # as in a large corpus: most words are not in the broadcast table
    top = model.heavy.values >= 40
    few = model._replace(heavy=lm_scoring.Table(model.heavy.keys[top], model.heavy.values[top]))
    monkeypatch.setattr(lm_scoring, "BLOCK", 1 << 13)  # many blocks
    want = Counter(map(tuple, lm_scoring.scored(docs, model).collect()))
    for m, bound in ((model, 0), (few, lm_scoring.BOUND), (few, 0)):
        got = lm_scoring.scored(docs, m, bound)
        assert Counter(map(tuple, got.collect())) == want
        # the texts moved once, for the questions and for the scores
        assert "ReusedExchange" in got._jdf.queryExecution().executedPlan().toString()
    # many shares, passed on in small pieces
    monkeypatch.setattr(lm_scoring, "SHARE_BITS", 4)
    monkeypatch.setattr(lm_scoring, "HELD", 64)
    again = lm_scoring.train(docs)
    assert again.bits > model.bits and (again.n, again.v) == (model.n, model.v)
    rows = lambda m, b: {(r.doc_id, r.n_tokens): (r.n_known, round(r.base_score, 9), r.score)
                         for r in lm_scoring.scored(docs, m, b).collect()}
    one, two = rows(again, 0), rows(again, lm_scoring.BOUND)
    assert one == two and {k: v[:2] for k, v in one.items()} == {k: v[:2] for k, v in rows(model, 0).items()}


def test_scores_follow_the_formula(spark):
    rows = [r for r in odd_documents() if r[0] is not None]
    got = lm_scoring.report(documents(spark, rows)).collect()
    one, two = Counter(), Counter()
    for d, t, *_ in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            w = words(t) + [None]
            one.update(w)
            two.update(zip(w, w[1:]))
    kept = Counter()
    for (v, _), c in two.items():
        kept[v] += c - lm_scoring.DISCOUNT
    mean = lambda c: lm_scoring.MEANS[lm_scoring.level(np.int64(c))]

    def logs(w):
        for v, x in zip([None, *w], w):
            p = (mean(one[x]) + 1) / (one.total() + len(one) + 1)
            if v is not None and one[v]:
                rest = mean(max(round(one[v] - kept[v]), 1))
                p = min(min(max(mean(two.get((v, x), 0)) - lm_scoring.DISCOUNT, 0) / mean(one[v]), 1)
                        + min(rest / mean(one[v]), 1) * p, 1)
            yield math.log10(p)

    want = defaultdict(list)
    for d, t, *_ in rows:
        w = words(t) + [None]
        want[d].append((len(w), sum(logs(w))))
    near = [min(abs(r.score - s) / n for n, s in want[r.doc_id]) for r in got]
    # a token's logarithm; the filter only errs upwards, and seldom
    assert np.median(near) < 0.01 and np.mean(near) < 0.05


def test_rare_pairs_count_in_a_large_corpus(spark):
    # 600,000 tokens: four would be under one in 2**17
    filler = [(i, " ".join(f"w{(i * 7 + j) % 500}" for j in range(1200)), "en", "s", 1) for i in range(500)]
    pairs = [(1000 + i, f"alpha{i // 4} beta{i // 4}", "en", "s", 1) for i in range(160)]
    asked = [(2000 + i, f"alpha{i} beta{i}", "en", "s", 1) for i in range(40)]
    asked += [(3000 + i, f"beta{i} alpha{i}", "en", "s", 1) for i in range(40)]
    docs = documents(spark, filler + pairs)
    got = {r.doc_id: r.score for r in lm_scoring.scored(
        documents(spark, asked), lm_scoring.train(docs)).collect()}
    # each pair was met four times, in this order only
    assert sum(got[2000 + i] > got[3000 + i] + 1 for i in range(40)) >= 36


# -- op6 and op10 -------------------------------------------------------------
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_encoded_like_the_text(name):
    odd = ["a  b", " x", "x ", "\n a", "a\n b", "a \nb", "<|endoftext|> hi <|endoftext|>", "I'm don't",
           "ÀÉ é ́x", "１２３ 45 x", "x y z", "a  b", "\ta b\t", "", None, "Σας ΣΑΣ",
           "a\x85b c", "q​c d", "a　b c", "a  b", "1 22 333", "it 's so", "a ' b"]
    texts = odd + [r[1] for r in odd_documents()]
    enc = _tokens.Encoder(name)
    for _ in range(2):  # unknown pieces, then known ones
        ids, rows = enc.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[rows[i]:rows[i + 1]].tolist() == enc.tokenizer.encode(
                t or "", add_special_tokens=False).ids, t


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_are_cut_at_marks_only_where_the_tokenizer_does(name):
    rng = random.Random(5)
    signs = [*"abZ'.,-!_1 \n\t", "\x1c", "\x7f", "é", "×", "ÿ", "ñ", "’", "—", "日", "İ", "Σ", "\u0301", "\u00ad",
             "'s", "'re", "'ll", "<", "|", "'S"]
    texts = ["".join(rng.choices(signs, k=rng.randrange(1, 14))) for _ in range(6000)]
    enc = _tokens.Encoder(name)
    for _ in range(2):
        ids, rows = enc.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[rows[i]:rows[i + 1]].tolist() == enc.tokenizer.encode(
                t, add_special_tokens=False).ids, repr(t)


def test_a_word_beside_marks_is_encoded_once():
    class Spy:
        seen = []

        def __init__(self, tokenizer):
            self.own = tokenizer

        def encode(self, *args, **kw):
            return self.own.encode(*args, **kw)

        def encode_batch_fast(self, texts, **kw):
            self.seen += texts
            return self.own.encode_batch_fast(texts, **kw)

    enc = _tokens.Encoder("byte_bpe_50k.json")
    enc.tokenizer = Spy(enc.tokenizer)
    texts = ["x zéphyrous, x zéphyrous.\nzéphyrous! x", "(zéphyrous) y zéphyrous...", "y zéphyrous,\ty"]
    ids, rows = enc.encode(pa.array(texts))
    # once with a blank and once without
    assert sum(t.count("zéphyrous") for t in Spy.seen) == 2
    for i, t in enumerate(texts):
        assert ids[rows[i]:rows[i + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [6, 9, 18])
def test_code_lengths(limit):
    counts = np.array([0, 900, 1, 1, 2, 3, 5, 8, 13, 21, 34, 55, 0, 89] + [1] * 40)
    bits = token_output.code_lengths(counts, limit)
    used = counts > 0
    assert (bits[used] >= 1).all() and bits.max() <= limit and not bits[~used].any()
    assert np.sum(2.0 ** -bits[used].astype(float)) == 1
    if limit == 18:  # no limit felt: as good as a plain Huffman tree
        import heapq
        heap, cost = sorted(counts[used].tolist()), 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            cost += a + b
            heapq.heappush(heap, a + b)
        assert cost == int((counts * bits).sum())


def test_token_files(spark):
    rows = odd_documents()
    got = sorted(token_output.round_trip(clashing(documents(spark, rows)), block=16, buckets=4).collect(),
                 key=lambda r: r.start)
    tok = _tokens.load("byte_bpe_50k.json")
    ids = [(r[0], np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")) for r in rows]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter(
        (d, len(x), zlib.crc32(x.tobytes())) for d, x in ids)
    at, last = 0, -1
    for r in got:
        assert r.start == at and (r.doc_id is None) <= (last == -1)
        assert r.doc_id is None or r.doc_id >= last
        at, last = at + r.n_tokens, last if r.doc_id is None else r.doc_id


def test_one_id_and_cut_segment():
    bits = token_output.code_lengths(np.array([0, 0, 7]))
    data, at, marks = token_output.encode(np.array([2, 2, 2]), np.array([0, 1, 3]), bits,
                                          token_output.canonical(bits), 2)
    blob = token_output.segment(np.array([5, 9]), np.array([True, True]), np.array([1, 2]),
                                [data[a:b] for a, b in zip(at, at[1:])], marks, 40, 2)
    out = token_output.read_segment(blob, token_output.Decoder(bits))
    assert out[3] == 40 and out[4].tolist() == [2, 2, 2]
    with pytest.raises(ValueError):
        token_output.read_segment(blob[:-1], token_output.Decoder(bits))


@pytest.mark.parametrize("size,carry", [(64, 1 << 15), (64, 1)])
def test_packing(spark, size, carry):
    rows = odd_documents()
    got = packing.packed_documents(clashing(documents(spark, rows)).repartition(5), size=size,
                                   carry=carry, fan=2).collect()
    tok = _tokens.load("word_bpe_49k.json")
    want = Counter()
    for r in rows:
        ids = np.array([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), size)):
            want[r[0], k, a, len(ids[a:a + size]), zlib.crc32(ids[a:a + size].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= size
    if carry > 1:
        assert len(bins) <= 1.05 * sum(r.length for r in got) / size + 2


def test_more_bins_than_a_task_takes(spark):
    rng = np.random.default_rng(4)
    items = spark.createDataFrame([(int(x),) for x in rng.integers(1, 40, 3000)], "length long").repartition(12)
    got = packing.packed(items, size=64, slack=0, fan=2, carry=20).collect()
    bins = Counter()
    for r in got:
        bins[r.sequence_id] += r.length
    total = sum(r.length for r in got)
    assert max(bins.values()) <= 64 and len(bins) <= 1.03 * total / 64 + 2


# -- op7 ----------------------------------------------------------------------
@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_dedup(spark, k, percent):
    rows = [r for r in odd_documents() if r[0] != 3]  # ids that name one text
    got = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_duplicates(
        clashing(documents(spark, rows)), k, percent).collect()}
    sets = {}
    for r in rows:
        w = words(r[1])
        sets[r[0]] = {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())
        if r[0] is None:
            del sets[None]
    root = {d: d for d in sets}

    def top(d):
        return d if root[d] == d else top(root[d])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and \
                    100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    for d, s in sets.items():
        r = got[d, len(s)]
        assert r.component_id == top(d) and r.kept == (top(d) == d), d
    assert len({top(d) for d in sets}) < len(sets)


def test_families_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    test_near_dedup(spark, 3, 85)


def test_one_of_each(spark):
    docs = clashing(documents(spark))
    out = near_dedup.one_of_each(docs)
    assert out.columns == docs.columns and 0 < out.count() < docs.count()


def test_components(spark):
    links = [(1, 2), (3, 2), (3, 9), (7, 8), (8, 7), (5, 5)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 7: 7, 8: 7} | {100 + i: 100 for i in range(41)}


def test_components_take_no_rounds_that_a_task_can_save(spark, monkeypatch):
    names = []
    monkeypatch.setattr(_graph, "stored", lambda df, name: names.append(name) or stored(df, name))
    rng = np.random.default_rng(5)
    order = rng.permutation(400).tolist()
    links = spark.createDataFrame([*zip(order[:299], order[1:300]), *zip(order[300:399], order[301:])], "a bigint, b bigint")
    want = {i: min(part) for part in (order[:300], order[300:]) for i in part}
    # a path across many tasks took several rounds of twelve stages
    assert {r.id: r.root for r in _graph.components(links.repartition(16)).collect()} == want
    assert names == ["links", "links", "nodes"]
    # with more links than a task takes, the stars end what is open
    names.clear()
    monkeypatch.setattr(_graph, "HELD", 8)
    assert {r.id: r.root for r in _graph.components(links.repartition(16)).collect()} == want
    assert names.count("nodes") > 1


def test_joined_up():
    rng = np.random.default_rng(6)
    for n in (1, 2, 9, 60):
        a, b = rng.integers(-n, n + 1, (2, n))
        a, b = a[a != b], b[a != b]
        root = {i: i for i in [*a.tolist(), *b.tolist()]}
        for _ in root:
            for x, y in zip(a.tolist(), b.tolist()):
                root[x] = root[y] = min(root[x], root[y])
        ids, roots = _graph.joined_up(a, b)
        assert dict(zip(ids.tolist(), roots.tolist())) == {i: r for i, r in root.items() if i != r}


# -- op8 ----------------------------------------------------------------------
def test_classifier_on_held_out_rows(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    labels = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/labels.parquet")
    got = classifier.report(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95


def test_classifier_odd_rows(spark):
    docs = clashing(documents(spark))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 1), (5, None, 0), (999, 1, 0)],
                                   "doc_id bigint, quality int, toxic int")
    got = classifier.report(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = {r.doc_id for r in got if r.held_out}
    assert held == {r.doc_id for r in got if r.doc_id is not None
                    and zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    none = labels.where("quality = 1")
    assert {r.score for r in classifier.report(docs, none).collect()} == {0.5}
    out = classifier.good_only(docs, labels)
    assert out.columns == docs.columns


def test_empty_tables(spark):
    e = empty(spark)
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id bigint, text string")
    assert classifier.report(e, labels).count() == 0
    assert decontaminate.report(e, bench).count() == 0
    assert suffix_dedup.deduplicated(e).count() == 0
    assert lm_scoring.report(e).count() == 0
    assert token_output.round_trip(e).count() == 0
    assert near_dedup.near_duplicates(e).count() == 0
    assert packing.packed_documents(e).count() == 0
