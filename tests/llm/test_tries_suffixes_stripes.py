"""Prefix trie, suffix arrays and divergence audit against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from ratelantern.llm import divergence_audit, prefix_trie, suffix_array, suffix_dedup

TURNS = "conv_id long, turn long, role string, text string"


def trie_of(rows):
    """Nodes by definition, as sorted tuples."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    members = defaultdict(list)
    for c, own in convs.items():
        head = zlib.crc32(str(c).encode()) % 9
        turns = convs.get(c - c % 5 if c >= 0 else c + -c % 5, [])[:head] + own[head:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append((c, d == len(turns)))
    found = []
    for path, held in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) > len(p) for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c, end in held if end))
        parent = min(c for c, _ in members[path[:-1]]) if path else None
        found.append((min(c for c, _ in held), len(path), parent, len(held), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted((tuple(r) for r in df.select(*TRIE).collect()), key=repr)


def conversations(seed, n=60, texts=3):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant", None]), r.choice(["", None, "é", *(f"text {k}" for k in range(texts))])) for c in range(n) for t in range(r.randint(0, 7))]


@pytest.mark.parametrize("shard_size", [4, 4096])
def test_trie(spark, shard_size):
    rows = conversations(shard_size)
    rows += [(7, None, "user", "first"), (7, 3, None, None), (7, 3, None, None), (None, 0, "user", "x"), (-7, 0, "user", "x"), (10**12, 0, "user", "a" * 5000)]
    df = spark.createDataFrame(rows, TURNS).repartition(3)
    assert trie_rows(prefix_trie.prefix_trie(df, shard_size)) == trie_of(rows)


def test_trie_of_a_common_first_turn_and_a_long_conversation(spark):
    rows = [(5 * c, 0, "user", "hello") for c in range(300)] + [(5 * c, 1, "user", str(c % 3)) for c in range(0, 300, 2)]
    rows += [(1, t, "user", f"t{t}") for t in range(400)]
    found = trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, TURNS), 50))
    assert found == trie_of(rows)
    assert max(n for _, _, _, n, *_ in found) == 301


def test_trie_ignores_other_columns_and_takes_empty_tables(spark):
    rows = conversations(1, 20)
    df = spark.createDataFrame([(*r, 1, 2, 3, "z") for r in rows], TURNS + ", family long, h1 long, members long, turns string")
    assert trie_rows(prefix_trie.prefix_trie(df)) == trie_of(rows)
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame([], TURNS))) == []


@pytest.mark.parametrize("seed", range(40))
def test_suffix_array(seed):
    r = random.Random(seed)
    symbols = r.choice([1, 2, 3, 50])
    text = np.array([r.randint(1, symbols) for _ in range(r.randint(0, 300))] + [0])
    order = suffix_array.suffix_array(text)
    assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
    common = suffix_array.permuted_common_prefixes(text, order)
    for a, b in zip(order[:-1].tolist(), order[1:].tolist(), strict=True):
        n = 0
        while max(a, b) + n < len(text) and text[a + n] == text[b + n]:
            n += 1
        assert common[b] == n


def test_suffix_array_recurses(monkeypatch):
    """Names with many suffixes each are sorted by recursion, not by doubling."""
    monkeypatch.setattr(suffix_array, "_doubled", lambda names: pytest.fail("doubled"))
    monkeypatch.setattr(suffix_array, "LEAST_PER_BUCKET", 1)
    r = random.Random(1)
    text = np.array([r.randint(1, 4) for _ in range(5000)] + [0])
    raw = text.astype(np.uint8).tobytes()
    assert suffix_array.suffix_array(text).tolist() == sorted(range(len(text)), key=lambda i: raw[i:])


def cut(texts, window):
    """(n_bytes, n_removed, n_spans, kept) of each text by definition."""
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + window] for b in raw for i in range(len(b) - window + 1))
    found = []
    for b in raw:
        gone = [False] * len(b)
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not p for g, p in zip(gone, [False, *gone], strict=False))
        found.append((len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return found


@pytest.mark.parametrize("kw", [{}, {"hot": 3}, {"hot": 1, "filter_bytes": 64}, {"shard_bytes": 100, "part_bytes": 200, "portion_bytes": 300}])
def test_repeated_bytes(spark, documents, kw):
    r = random.Random(len(kw))
    base = ["".join(r.choice("ab é") for _ in range(r.randint(0, 60))) for _ in range(40)]
    texts = [None, "", *base, *[base[3]] * 5, *(base[5][5:30] + base[7][3:40] for _ in range(3)), "a" * 100, "xyz" * 400, "a" * 50]
    ids = [None, 5, 5, *range(10, 10 + len(texts) - 3)]
    df = documents(*texts, ids=ids).withColumnRenamed("lang", "k1").withColumnRenamed("source", "ranges").repartition(3)
    found = suffix_dedup.without_repeats(df, window=8, gram=4, **kw).collect()
    expected = [(i, *rest) for i, rest in zip(ids, cut(texts, 8), strict=True)]
    assert sorted(((*tuple(x)[:4], bytes(x[4])) for x in found), key=repr) == sorted(expected, key=repr)


def test_repeated_bytes_of_empty_tables(documents):
    assert suffix_dedup.without_repeats(documents()).collect() == []
    (row,) = suffix_dedup.without_repeats(documents(None)).collect()
    assert tuple(row)[1:4] == (0, 0, 0) and row.kept == b""


def audit_of(rows, min_docs, top):
    """(lang, source, part, item, value, rank) by definition."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df, n = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = term.findall((text or "").translate(lower))
        df[lang or ""].update(set(words))
        n[lang or "", source or ""].update(words)
    out = []
    for lang, source in n:
        kept = {t for t, k in df[lang].items() if k >= min_docs}
        whole = sum((c for (x, _), c in n.items() if x == lang), Counter())

        def share(counts, t, kept=kept):
            return 1 + 10**9 * (counts[t] + 2) // (sum(counts[k] for k in kept) + 2 * len(kept))

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        mine = n[lang, source]
        pairs = [(-sum(f(share(mine, t), share(n[x, s], t)) for t in kept), s.encode(), s) for x, s in n if x == lang and s != source]
        terms = [(-f(p, q), t.encode(), t) for t in kept if mine[t] for p, q in [(share(mine, t), share(whole, t))] if p > q]
        out += [(lang, source, "pair", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(pairs))]
        out += [(lang, source, "term", item, -v, i + 1) for i, (v, _, item) in enumerate(sorted(terms)[:top])]
    return sorted(out)


def audit_rows(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("kw", [{}, {"shard_bytes": 300}])
def test_divergences(spark, kw):
    r = random.Random(3)
    words = ["the", "The", "éa", "ÉA", "x1y", "日本", "z", *(f"w{chr(97 + k)}" for k in range(20))]
    rows = [
        (" ".join(r.choices(words, k=r.randint(0, 30))) if r.random() < 0.9 else None, r.choice(["en", "fr", None, ""]), r.choice(["a", "b", "c", None]))
        for _ in range(120)
    ]
    rows += [("rare", "xx", "a"), (None, "xx", "b"), ("", "yy", "only")] + [rows[0]] * 4
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "text string, lang string, source string, n long, shard long").repartition(3)
    assert audit_rows(divergence_audit.divergences(df, min_docs=4, top=3, **kw)) == audit_of(rows, 4, 3)


def test_divergences_of_spilled_stripes_and_empty_tables(spark):
    rows = [(f"{a} {b} {a}", "en", s) for a in ("aa", "bb", "cc") for b in ("dd", "ee") for s in ("p", "q") for _ in range(2 if s == "p" else 1)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(2)
    spilled = divergence_audit.stripe_entries(df, most_entries=3).groupBy("lang", "term", "source").sum("n", "docs")
    whole = divergence_audit.stripe_entries(df).groupBy("lang", "term", "source").sum("n", "docs")
    assert sorted(map(tuple, spilled.collect())) == sorted(map(tuple, whole.collect()))
    assert audit_rows(divergence_audit.divergences(df, min_docs=2)) == audit_of(rows, 2, 10)
    assert audit_rows(divergence_audit.divergences(df.limit(0))) == []


def test_shares_are_exact():
    r = random.Random(5)
    totals = [r.randint(1, 2**53) for _ in range(200)]
    counts = [r.randint(0, t) for t in totals]
    assert divergence_audit.scaled(np.array(counts), np.array(totals)).tolist() == [1 + 10**9 * c // t for c, t in zip(counts, totals, strict=True)]


def test_suffix_dedup_stores_no_text(documents, monkeypatch):
    stored, write_stage = [], suffix_dedup.write_stage
    monkeypatch.setattr(suffix_dedup, "write_stage", lambda df, name: stored.append(df.columns) or write_stage(df, name))
    found = suffix_dedup.without_repeats(documents("abcdefghij 1", "abcdefghij 2", "abcdefghij 1"), window=8, gram=4).collect()
    assert sorted(r.n_removed for r in found) == [11, 12, 12]
    assert stored == [["h1", "h2", "covered"]]
