"""Quality rules, line dedup and chat rotation against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldcast.llm import chat_rotation, line_dedup, quality_rules
from tests.llm.frames import clashing, documents, empty, odd_documents

WS = r"[^\x20\x09-\x0D]+"


def counts(text):
    w = re.findall(WS, text or "")
    lines = [x for x in (text or "").split("\n") if re.search(WS, x)]
    grams = defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i:i + 8])].append(i)
    cover = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(cover))


def test_counts_and_base(spark):
    rows = odd_documents() + [(900, " ".join(f"t{i % 11}" for i in range(60)), "en", "s1", 1)]
    got = quality_rules.apply_rules(clashing(documents(spark, rows))).collect()
    assert len(got) == len(rows)
    want = Counter((r[0], *counts(r[1])) for r in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines,
                    r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept is not None and not (r.base_failed and r.kept)


def test_fence_follows_the_group(spark):
    clean = "plain words stand here in some order and nothing else is in this text at all now but for a few "
    rows = [(i, clean + f"{i} # " * (i % 3), "en", "s1", 1) for i in range(150)]
    rows += [(500, "# $ % " * 40 + clean, "en", "s1", 1)]
    # a source in which symbols are common keeps them
    rows += [(1000 + i, clean + "".join(f"a{i}{j} # b{j} $ " for j in range(6 + i % 5)), "en", "code", 1) for i in range(150)]
    got = {r.doc_id: r.kept for r in quality_rules.apply_rules(documents(spark, rows)).collect()}
    assert not got[500]
    assert all(got[i] for i in range(150)) and all(got[1000 + i] for i in range(150))


def test_each_fence_rejects_what_the_base_keeps(spark):
    plain = lambda i: [f"word{i}x{j}" for j in range(100)]
    rows = [(i, " ".join(plain(i)), "en", "s1", 1) for i in range(150)]
    again = plain(901)[:12]
    odd = {"symbol_rate": " ".join(w + "#" for w in plain(900)),
           "repeat_rate": " ".join(again + plain(902)[:76] + again),
           "upper_rate": " ".join(plain(903)).upper(),
           "dup_line_rate": "\n".join(["one line"] * 4 + plain(904)[:3]) + " " + " ".join(plain(905))}
    rows += [(500 + i, t, "en", "s1", 1) for i, t in enumerate(odd.values())]
    got = {r.doc_id: r for r in quality_rules.apply_rules(documents(spark, rows)).collect()}
    assert all(got[i].kept for i in range(150))
    for i, name in enumerate(odd):
        r = got[500 + i]
        over = [x for x in quality_rules.RATES if r[x] > r[f"{x}_fence"]]
        assert over == [name] and not r.base_failed and not r.kept


def test_sketches_merge(spark):
    docs = quality_rules.features(documents(spark))
    rates = list(quality_rules.RATES)
    whole = quality_rules.sketch(docs, ["lang"], rates)
    parts = quality_rules.merged(quality_rules.sketch(docs, ["lang", "source"], rates), ["lang"])
    assert sorted(map(str, whole.collect())) == sorted(map(str, parts.select(*whole.columns).collect()))


def later_lines(rows, min_words):
    """Deleted (id, text) -> line numbers among lines with a word."""
    seqs = {(r[0], r[1]): [x for x in (r[1] or "").split("\n") if re.search(WS, x)] for r in rows}
    first, out = {}, defaultdict(set)
    windows = [(h, tuple(s[i:i + h]), (-2**63 if d is None else d, i), (d, t), i)
               for (d, t), s in seqs.items() for h in (1, 2) for i in range(len(s) - h + 1)]
    for h, g, at, _, _ in windows:
        first[h, g] = min(first.get((h, g), at), at)
    for h, g, at, key, i in windows:
        if at != first[h, g] and (h == 2 or len(re.findall(WS, g[0])) >= min_words):
            out[key] |= set(range(i, i + h))
    return out


@pytest.mark.parametrize("min_words", [25, 50])
def test_line_dedup(spark, min_words):
    rows = odd_documents()
    gone = later_lines(rows, min_words)
    want = Counter()
    for r in rows:
        n, kept = -1, []
        for x in (r[1] or "").split("\n"):
            n += bool(re.search(WS, x))
            if not (re.search(WS, x) and n in gone[r[0], r[1]]):
                kept.append(x)
        left = "\n".join(kept) if r[1] is not None else None
        want[r[0], left] += 1
    out = line_dedup.with_removals(clashing(documents(spark, rows)), min_words)
    assert Counter((r.doc_id, r["_kept"]) for r in out.select("row.doc_id", F.col("kept").alias("_kept")).collect()) == want
    assert any(gone.values())


def test_runs_have_their_exact_length(spark):
    rng = random.Random(6)
    block = [f"line {i}" for i in range(23)]
    texts = []
    for _ in range(30):
        a = rng.randrange(23)
        texts.append([*(f"own {rng.random()}" for _ in range(rng.randrange(3))), *block[a:a + rng.randrange(1, 20)],
                      *(rng.choice(["x", "y"]) for _ in range(rng.randrange(6)))])
    texts += [["z"] * 37, block, block, ["x", "y"] * 9]
    docs = spark.createDataFrame([(i, "\n".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r._d, r.ln): r.lcp for r in line_dedup.run_lengths(line_dedup.repeats(docs)).collect()}
    at = [(d, i) for d, t in enumerate(texts) for i in range(len(t))]

    def common(p, q):
        x, y = texts[p[0]][p[1]:], texts[q[0]][q[1]:]
        return next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))

    want = {p: max(common(p, q) for q in at[:k]) for k, p in enumerate(at) if k}
    assert got == {p: n for p, n in want.items() if n}
    longest = {r.doc_id: r.shared_lines for r in line_dedup.report(docs).collect()}
    assert longest == {d: max([want.get((d, i), 0) for i in range(len(t)) if want.get((d, i), 0) > 1], default=0)
                       for d, t in enumerate(texts)}


def test_line_dedup_keeps_columns(spark):
    docs = clashing(documents(spark))
    out = line_dedup.drop_repeated_lines(docs)
    assert out.columns == docs.columns
    for r in out.select("text", "n_chars").collect():
        assert r.text is None or r.n_chars in (None, 1) or r.n_chars == len(r.text)


def test_chat_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", " hi\n"), (1, 2, "bob", "yo"), (1, 3, "cy", None),
            (1, 4, "ann", ""), (1, 4, "ann", ""), (2, 0, None, "who"), (2, None, "bob", "x"),
            (None, 0, "ann", "lost"), (3, 0, "system", "alone"), (1, 5000, "bob", "late")]
    turns = clashing(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    out = chat_rotation.rotate(turns)
    got = out.collect()
    people = {1: 3, 2: 2, None: 1, 3: 0}
    assert len(got) == sum(people[r[0]] for r in rows)
    texts = {}
    for r in sorted(got, key=lambda r: (str(r.conv_id), r.speaker, r.char_start)):
        key = (r.conv_id, r.speaker)
        assert len(texts.get(key, "")) == r.char_start
        texts[key] = texts.get(key, "") + r.rendered
        assert r.char_end == len(texts[key])
        assert (r.train_start is not None) == (r.role == r.speaker)
    for r in got:
        if r.train_start is not None:
            body = texts[r.conv_id, r.speaker][r.train_start:r.train_end]
            assert body.endswith("<|end|>") and r.chat_role == "assistant" and r.name is None
    assert texts[1, "bob"].startswith("<|system|>\nbe kind<|end|>\n<|user name=ann|>\nhi<|end|>\n"
                                      "<|assistant|>\nyo<|end|>\n<|user name=cy|>\n<|end|>\n")
    whole = {(r.conv_id, r.speaker): r for r in chat_rotation.assembled(out).collect()}
    assert {k: r.text for k, r in whole.items()} == texts
    assert len(whole[1, "ann"].trained) == 3


def test_empty_tables(spark):
    assert quality_rules.apply_rules(empty(spark)).count() == 0
    assert line_dedup.report(empty(spark)).count() == 0
    none = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    assert chat_rotation.rotate(none).count() == 0
