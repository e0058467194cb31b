"""Spelling variants, periodic runs and source mixing against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from fieldcast.llm import periodic_runs, queries, source_mixing, spelling_variants
from tests.llm.frames import clashing, documents, empty, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(w, words=6, periods=4):
    out = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if n >= max(words, periods * q) and not any(
                    all(w[k] == w[k + d] for k in range(i, i + n - d)) for d in range(1, q)):
                out.append((i, n, q))
            i = max(j, i + 1)
    return sorted(out)


def test_runs_of_short_words():
    rng = random.Random(1)
    for _ in range(400):
        w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.randrange(60))]
        if w and rng.random() < 0.5:
            a, p = rng.randrange(len(w)), rng.randrange(1, 6)
            w = w[:a] + [w[a + (i - a) % p] if a + (i - a) % p < len(w) else w[i] for i in range(a, len(w))]
        x = np.array(w, np.uint64)
        for words, periods in ((6, 4), (2, 2), (5, 3)):
            at = periodic_runs.recurring(x, np.array([0, len(x)]),
                                         periodic_runs.least_prefix(words, periods))
            got = periodic_runs.runs_of(x, at, words, periods) if len(at) else []
            assert got == all_runs(w, words, periods)


def expected_periods(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = all_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)),
            sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_periodic_report(spark):
    rows = odd_documents() + [(i, "a b c " * 9 + f"tail {i}", "en", "s", 1) for i in range(200, 240)]
    got = [tuple(r) for r in periodic_runs.report(clashing(documents(spark, rows))).collect()]
    assert sorted(got, key=str) == sorted((expected_periods(r[0], r[1]) for r in rows), key=str)
    assert any(r[1] > 0 for r in got)
    assert periodic_runs.report(empty(spark)).count() == 0


def test_runs_keep_all_columns(spark):
    df = clashing(documents(spark))
    out = periodic_runs.with_runs(df)
    assert set(df.columns) < set(out.columns) and out.count() == df.count()
    assert out.where("doc_id is null").count() == 2


def variants_by_hand(rows, typos, least=7, occurs=2, ratio=10):
    count = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if typos and h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= least:
                count[w] += 1
    count = {w: n for w, n in count.items() if n >= occurs}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))

    near = {a: [b for b in count if abs(len(a) - len(b)) < 2 and one_edit(a, b)] for a in count}
    form = {}
    for w, n in count.items():
        top = min(near[w], key=lambda x: (-count[x], x), default=None)
        if top and count[top] >= ratio * n:
            form[w] = top
    out = {}
    for w, n in count.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, len(near[w]), count.get(form.get(w)))
    return out


def typed_documents():
    rng = random.Random(5)
    letters = "abcdeïßä"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(5, 14))) for _ in range(40)]
    base += ["x" * 70, "x" * 71, "y" * 80 + "q" + "y" * 20, "y" * 80 + "r" + "y" * 20, "ab" * 32,
             "ab" * 32 + "c", "a" * 7, "a" * 8, "a" * 9, "Straßenbahn", "x" * 3000]
    texts = []
    for d in range(200):
        words = []
        for _ in range(50):
            w = base[int(len(base) * rng.random() ** 3)]
            k, r = rng.randrange(len(w)), rng.random()
            if r < 0.1:
                w = w[:k] + rng.choice(letters) + w[k + 1:]
            elif r < 0.2:
                w = w[:k] + rng.choice(["", "q"]) + w[k + (r < 0.15):]
            words.append(w.upper() if rng.random() < 0.2 else w)
        texts.append((None if d == 7 else d, rng.choice([" ", "·", "-日"]).join(words), "en", "s", 1))
    texts += [(900, "chainword " * 300, "en", "s", 1), (901, "chainwird " * 24, "en", "s", 1),
              (902, "chainwirt " * 2, "en", "s", 1)]
    return texts + odd_documents()


@pytest.mark.parametrize("typos", [True, False])
def test_variants(spark, typos):
    rows = typed_documents()
    got = spelling_variants.variants(clashing(documents(spark, rows)), typos=typos).collect()
    want = variants_by_hand([(r[0], r[1]) for r in rows], typos)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert len(got) == len(want)
    assert any(v[1] not in (w, v[0]) for w, v in want.items())  # a way of two steps


def test_no_words(spark):
    assert spelling_variants.variants(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        spelling_variants.variants(empty(spark), least=3)


def test_checksums_are_crc32():
    data = np.frombuffer(b"abcdefghij", np.uint8)
    got = spelling_variants.checksums(np.array([zlib.crc32(b"1:"), zlib.crc32(b"22:")], np.uint32),
                                      data, np.array([0, 3]), np.array([3, 7]))
    assert got.tolist() == [zlib.crc32(b"1:abc"), zlib.crc32(b"22:defghij")]


def by_heap(votes, seats, most=None):
    got = [0] * len(votes)
    heap = [(-v, i) for i, v in enumerate(votes) if v > 0]
    heapq.heapify(heap)
    while seats and heap:
        _, i = heapq.heappop(heap)
        if most is None or got[i] < most[i]:
            got[i] += 1
            seats -= 1
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def test_apportionment(spark):
    rng = random.Random(3)
    for _ in range(200):
        v = [rng.choice([0, 1, 5, 7, rng.random() * 100]) for _ in range(rng.randrange(1, 9))]
        most = [rng.randrange(30) if x else 0 for x in v]
        seats = rng.randrange(60)
        assert source_mixing.sainte_lague(np.array(v, float), seats, np.array(most)).tolist() \
            == by_heap(v, seats, most)
    for votes, seats in (([10., 20., 30., 5.5, .25], 17), ([5.] * 4, 6), ([1.] * 7, 3), ([3., 1.], 1),
                         ([100., 1., 1., 1.], 200), ([7.], 0)):
        df = spark.createDataFrame(list(enumerate(votes)), "number bigint, votes double")
        got = source_mixing.apportioned(df, seats, "number").orderBy("number").collect()
        assert [r["seats"] for r in got] == by_heap(votes, seats)


def test_permutation():
    for n in (1, 2, 3, 7, 64, 65, 1000):
        x = np.arange(n, dtype=np.uint64)
        got = source_mixing.permuted(x, np.full(n, n, np.uint64), np.full(n, 77, np.uint64))
        assert sorted(got.tolist()) == list(range(n))


def target_by_hand(sizes):
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, live = {}, Fraction(3 * sum(sizes.values()), 2), order
    while live:
        part = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        over = [s for s in live if part[s] > 2 * sizes[s]]
        if not over:
            return {s: float(x) for s, x in (out | part).items()}
        out |= {s: Fraction(2 * sizes[s]) for s in over}
        left -= sum(2 * sizes[s] for s in over)
        live = [s for s in live if s not in over]
    return {s: float(x) for s, x in out.items()}


def check_mix(df, block=source_mixing.BLOCK, **options):
    out = source_mixing.report(df, block=block, **options).collect()
    again = source_mixing.report(df.repartition(3), block=block, **options).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))
    rows = [(r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in df.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    target = target_by_hand(sizes)
    assert (Counter((d, n, sizes[s], round(target[s], 6)) for d, s, n in rows)
            == Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in out))
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in out)
    taken, aim = Counter(), {(sizes[s], round(t, 6)): t * sum(1 for x in sizes if (
        sizes[x], target[x]) == (sizes[s], t)) for s, t in target.items()}
    for r in out:
        taken[r["source_size"], round(r["target"], 6)] += r["taken"]
    return [(taken[k], t) for k, t in aim.items()]


def test_mix_meets_targets(spark, sf):
    for got, aim in check_mix(spark.read.parquet(f"{sf}/documents.parquet")):
        assert abs(got - aim) <= max(2 * source_mixing.BLOCK, 0.005 * aim)
    # many small shards: their rounding stays within a block each
    for got, aim in check_mix(documents(spark), block=4, shard=100):
        assert abs(got - aim) <= max(8, 0.05 * aim)
    assert source_mixing.report(empty(spark)).count() == 0
    blank = documents(spark, [(1, None, None, None, None), (2, " ", None, "s", 1)])
    assert [(r["target"], r["taken"]) for r in source_mixing.report(blank).collect()] == [(0.0, 0)] * 2


def test_mix_gives_the_words_it_counts(spark):
    df = clashing(documents(spark))
    spans = source_mixing.mixed(df, block=8)
    assert spans.select("row.*").columns == df.columns
    for r in spans.collect():
        assert sum(s["length"] * s["copies"] for s in r["spans"]) == r["taken"]
        at = 0
        for s in r["spans"]:
            assert s["first"] >= at and s["copies"] in (1, 2)
            at = s["first"] + s["length"]
        assert at <= r["size"]
    texts = source_mixing.taken_texts(df, block=8).collect()
    assert sum(len(r["text"].split(" ")) for r in texts) == sum(
        r["taken"] for r in source_mixing.report(df, block=8).collect())


def test_new_queries_have_a_row_per_document(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op12_periodic_runs", "op13_source_mixing"):
        assert queries.registered()[name](spark, sf).count() == n
