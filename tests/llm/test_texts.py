"""Operators on texts against brute force and the libraries."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ratelantern.llm import bayes_minhash, context_mixing, language_id, pfair, recompression, sentencepieces, splitters, token_transducer

AWKWARD = [
    None,
    "",
    " ",
    "x",
    "x",
    "one two\tthree\nfour  five",
    "<|endoftext|> a<|endoftext|>b",
    "héllo wörld 🙂 日本語 ▁x",
    "a " * 60,
    "don't we'll  \n\n  end \x1c q",
    "word" * 200,
]
IDS = [7, 1, 2, 3, 3, None, 5, 6, 8, 9, 10]


def awkward(documents):
    return documents(*AWKWARD, ids=IDS)


@pytest.mark.parametrize("chunk", [65_536, 7])
def test_token_counts(documents, chunk):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rows = token_transducer.token_counts(awkward(documents), path, limit=20, chunk_chars=chunk).collect()
    expected = [(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in zip(IDS, AWKWARD)]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in rows), key=repr) == sorted(expected, key=repr)
    assert all(r.over_limit == (r.n_tokens > 20) for r in rows)


def test_pieces(documents):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    encoded = sentencepieces.encode(awkward(documents), path)
    rows = encoded.collect()
    expected = [(i, None if t is None else library.encode(t)) for i, t in zip(IDS, AWKWARD)]
    assert sorted(((r.doc_id, r.ids) for r in rows), key=repr) == sorted(expected, key=repr)
    assert all(r.round_trip in (True, None) for r in rows)
    texts = sorted((r.text for r in sentencepieces.decode(encoded, path).collect()), key=repr)
    assert texts == sorted((None if t is None else t.replace("▁", " ") for t in AWKWARD), key=repr)


def removed(docs, window):
    words = {i: (t or "").split() for i, t in docs}
    seen, gone = set(), Counter()
    result = {}
    for i in sorted(words):
        cover = [False] * len(words[i])
        for s in range(len(words[i]) - window + 1):
            key = tuple(words[i][s : s + window])
            if key in seen:
                cover[s : s + window] = [True] * window
            seen.add(key)
        result[i] = [w for w, c in zip(words[i], cover) if not c]
        gone[i] = sum(cover)
    return result, gone


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_repeats(documents, rounds):
    rng = random.Random(rounds)
    passage = [rng.choice("abcdefgh") * 2 for _ in range(40)]
    texts = [None, "", "a " * 70, "b " * 25 + "c"]
    for _ in range(40):
        words = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(60))]
        at, cut = rng.randrange(20), rng.randrange(15, 40)
        texts.append(" ".join(words + passage[at : at + cut] + words[:30]))
    kept, gone = removed(list(enumerate(texts)), 20)
    for r in recompression.without_repeats(documents(*texts), rounds=rounds).collect():
        assert (r.kept_text or "").split() == kept[r.doc_id] and r.n_removed == gone[r.doc_id]
        assert (r.kept_text is None) == (texts[r.doc_id] is None)


def components_of(docs, shingle, percent):
    def of(t):
        w = (t or "").lower().split()
        return {tuple(w)} if 0 < len(w) < shingle else {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)}

    sets = {i: of(t) for i, t in docs}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(documents):
    rng = random.Random(5)
    texts = [None, "", "One two", "one TWO", "same same same same"]
    for _ in range(12):
        base = [f"w{rng.randrange(300)}" for _ in range(80)]
        for _ in range(5):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(80)] = "new"
            texts.append(" ".join(copy))
    found = bayes_minhash.near_duplicates(documents(*texts)).collect()
    expected = components_of(list(enumerate(texts)), 3, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)
    rows = bayes_minhash.near_duplicates(awkward(documents)).collect()
    assert len(rows) == len(AWKWARD) and all(r.kept and r.component_id is None for r in rows if r.doc_id is None)


def test_language(documents):
    rng = random.Random(1)
    words = {"en": "the and of that with from this have".split(), "de": "der und nicht eine auch sich wird sein".split()}
    langs = [rng.choice(["en", "de"]) for _ in range(90)]
    texts = [" ".join(rng.choices(words[lang], k=12)) for lang in langs] + [None, "12 !!", ""]
    docs = documents(*texts, langs=[*langs, "en", None, "de"])
    rows = {r.doc_id: r for r in language_id.identified(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert all(rows[i].lang_pred == lang for i, lang in enumerate(langs))
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (90, 91, 92))
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 for i, r in rows.items())


def test_context_mixing(documents):
    rng = random.Random(2)
    texts = [" ".join(rng.choices(["the", "red", "House", "was", "seen"], k=rng.randrange(1, 30))) for _ in range(40)] + [None, ""]
    rows = {r.doc_id: r for r in context_mixing.scored(documents(*texts)).collect()}

    def tokens(t):
        return [*(t or "").lower().split(), None]

    train = Counter(w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 7 != 2 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(t)), sum(w in train for w in tokens(t)), n)
        assert math.isclose(r.base_score, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens(t)), rel_tol=1e-9)
        assert r.score < 0 and r.bits_per_byte > 0
    # Seen words cost far less than the 8 bits a byte of no model.
    assert sum(r.bits_per_byte for r in rows.values()) / len(rows) < 4


def test_shards(documents):
    rng = random.Random(3)
    texts = [("same text" if rng.random() < 0.4 else "x" * rng.randrange(200)) for _ in range(3000)] + AWKWARD
    docs = documents(*texts, ids=[*range(100, 3100), *IDS])
    rows = splitters.shard(docs).collect()
    assert len(rows) == len(texts) and {r.shard for r in rows} == set(range(24))
    expected = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in zip([*range(100, 3100), *IDS], texts))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == expected
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    mean = sum(sizes.values()) / 24
    assert all(abs(s - mean) <= max(900, 0.05 * mean) for s in sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_mix_stays_within_a_block(spark, documents):
    docs = documents(*["t"] * 600, sources=[["a", "b", "c", None][i % 4] for i in range(600)])
    weights = {"a": 5, "b": 3}
    rows = pfair.mixed(docs, weights, 1, 16).collect()
    assert len(rows) == 600
    q = 10
    share = {"a": 5, "b": 3, "c": 1, None: 1}
    slot_of = {(r.source, r.block): r.slot for r in rows}
    assert len(set(slot_of.values())) == len(slot_of)
    assert all(r.release <= r.slot < r.deadline for r in rows)
    used = {s: sorted(t for (x, _), t in slot_of.items() if x == s) for s in share}
    for t in range(min(max(u) for u in used.values())):
        for s, w in share.items():
            assert abs(sum(x < t for x in used[s]) - w * t / q) < 1


def test_empty_tables(documents):
    none = documents()
    pieces = public_tokenizers.path("piece_bpe_32k.model")
    for made in (
        token_transducer.token_counts(none, public_tokenizers.path("byte_bpe_50k.json")),
        sentencepieces.encode(none, pieces),
        recompression.without_repeats(none),
        bayes_minhash.near_duplicates(none),
        language_id.identified(none, pieces),
        context_mixing.scored(none),
        splitters.shard(none),
        pfair.mixed(none, {"a": 2}),
    ):
        assert made.count() == 0


def test_digest_of_query(documents):
    row = recompression.without_repeats(documents("a  b\tc")).first()
    assert hashlib.sha256(row.kept_text.encode()).hexdigest() == hashlib.sha256(b"a b c").hexdigest()


def test_words_are_summed_over_all_segmentations(monkeypatch):
    table = language_id.piece_table(public_tokenizers.path("piece_bpe_32k.model"))
    weights = np.random.default_rng(4).uniform(1e-6, 1e-2, (table.unknown + 1, 2))
    row = {p: i for i, p in enumerate(table.pieces)}

    def cuts(word):
        """All segmentations as lists of rows."""
        if not word:
            return [[]]
        heads = [(n, row.get(word[:n], table.unknown if n == 1 else None)) for n in range(1, len(word) + 1)]
        return [[h, *tail] for n, h in heads if h is not None for tail in cuts(word[n:])]

    words = ["▁the", "▁house", "▁über", "▁日x", "▁aaaa"]
    expected = np.array([np.log(sum(np.prod(weights[c], axis=0) for c in cuts(w))) for w in words])
    uses = np.zeros(table.unknown + 1)
    for w in words:
        shares = [(c, np.prod(weights[c, 0])) for c in cuts(w)]
        for c, share in shares:
            np.add.at(uses, c, 2 * share / sum(s for _, s in shares))
    for longest in (48, 3):
        monkeypatch.setattr(language_id, "LONG", longest)
        assert np.allclose(language_id.word_scores(table, words, weights), expected, rtol=1e-9)
        assert np.allclose(language_id.expected_counts(table, words, np.full(len(words), 2.0), weights[:, :1]), uses, rtol=1e-9)
    assert np.isfinite(language_id.word_scores(table, ["▁" + "qx" * 3000], weights)).all()


def test_no_letter_is_no_language(documents):
    docs = documents("the cat", "the dog", "the end", "x² ½", "² ½ _ 7", "ª", ids=[0, 2, 3, 4, 5, 6])
    rows = {r.doc_id: r.lang_pred for r in language_id.identified(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert rows == {0: "en", 2: "en", 3: "en", 4: "en", 5: "und", 6: "en"}


def test_scores_do_not_depend_on_packing(spark, documents, monkeypatch):
    rng = random.Random(8)
    docs = documents(*[" ".join(f"w{int(rng.expovariate(0.05))}" for _ in range(60)) for _ in range(80)])

    def scores(partitions, words_per_task):
        monkeypatch.setattr(context_mixing, "WORDS_PER_TASK", words_per_task)
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        return {r.doc_id: r.score for r in context_mixing.scored(docs.repartition(partitions)).collect()}

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        first = scores(1, 500_000)
        assert first == scores(3, 500_000) == scores(8, 20)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_scores_of_rare_words_are_looked_up(documents, monkeypatch):
    rng = random.Random(9)
    docs = documents(*[" ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(50)) for _ in range(60)], None, "", "unseen", "z" * 50_000)
    sent = {r.doc_id: r for r in context_mixing.scored(docs).collect()}
    monkeypatch.setattr(context_mixing, "TOP_WORDS", 3)
    for r in context_mixing.scored(docs, part_bytes=1_000).collect():
        assert (r.n_tokens, r.n_known, r.held_out) == (sent[r.doc_id].n_tokens, sent[r.doc_id].n_known, sent[r.doc_id].held_out)
        assert math.isclose(r.score, sent[r.doc_id].score, rel_tol=1e-9)
        assert math.isclose(r.base_score, sent[r.doc_id].base_score, rel_tol=1e-9)


def test_mixer_against_brute_force():
    """Bit by bit in plain Python: contexts as dictionaries of the bytes themselves instead of hashed slots."""
    rng = random.Random(11)
    words = sorted({"".join(rng.choices(["th", "on", "er", "an"], k=rng.randrange(1, 4))).encode() for _ in range(30)}) + [b""]
    counts = np.zeros((2, context_mixing.FIRST_SLOT[-1]), dtype=np.int64)
    for _, _, _, slots, bits in context_mixing.spelled(words):
        for s in slots:
            np.add.at(counts.reshape(-1), s + bits * context_mixing.FIRST_SLOT[-1], 1)
    odds = np.rint(np.log((counts[1] + 0.4) / (counts[0] + 0.4)) * 8).astype(np.int8)
    sure = np.digitize(counts.sum(axis=0)[context_mixing.FIRST_SLOT[3] :], [0.5, 3.5, 30.5]).astype(np.int8)
    weights = np.array([[rng.random() / 3 for _ in range(5)] for _ in range(16)])
    mixer = context_mixing.Mixer(odds, sure, weights)

    def steps(word):
        data = word + b" "
        for i, byte in enumerate(data):
            contexts = [(k, data[max(0, i - k) : i].rjust(k, b"\1")) for k in (1, 2, 3, 4)] + [(5, data[:i])]
            for j in range(8):
                yield [(c, j, byte >> (8 - j)) for c in contexts], byte >> (7 - j) & 1

    seen = Counter((key, bit) for w in words for keys, bit in steps(w) for key in keys)
    assert len({key for key, _ in seen}) == np.count_nonzero(counts.sum(axis=0))  # no two of these contexts share a slot
    for word, found in zip(words, mixer.word_scores(words), strict=True):
        logs = np.zeros(3)
        for keys, bit in steps(word):
            n = [(seen[k, 0], seen[k, 1]) for k in keys]
            x = [round(math.log((b + 0.4) / (a + 0.4)) * 8) / 8 for a, b in n]
            four, whole = (sum(sum(ab) > t for t in (0.5, 3.5, 30.5)) for ab in n[3:])
            z = context_mixing.VARIANTS @ (weights[four * 4 + whole] * x)
            logs -= np.log10(1 + np.exp(np.clip(-z if bit else z, -12, 12)))
        assert np.allclose(found, logs, rtol=1e-5)
    new = 0.25
    n = np.array([i % 3 for i in range(len(words))])
    shares = 10.0 ** mixer.token_scores(words, n, 100, new)
    assert np.allclose(shares, (1 - new) * n[:, None] / 100 + new * 10.0 ** mixer.word_scores(words))


def test_mix_keeps_columns_of_any_name(documents):
    docs = documents(*["t"] * 40, sources=[["a", None][i % 2] for i in range(40)])
    wide = docs.selectExpr("*", "1 AS q", "2 AS blocks", "'x' AS _source", "3 AS _k", "4 AS _slot", "5 AS _at", "6 AS `row`", "7 AS slot")
    plain, mixed = pfair.mixed(docs, {"a": 2}, 1, 4), pfair.mixed(wide, {"a": 2}, 1, 4)
    assert {(r.doc_id, r.slot) for r in plain.collect()} == {(r.doc_id, r.slot) for r in mixed.collect()}
    assert {tuple(r) for r in mixed.select("q", "blocks", "_source", "_k", "_slot", "_at", "row").collect()} == {(1, 2, "x", 3, 4, 5, 6)}


@pytest.mark.parametrize("range_rows", [4_000_000, 7])
def test_groups_of_equal_texts_share_a_shard(documents, range_rows):
    rng = random.Random(6)
    texts = [t for i in range(300) for t in [f"text {i} " + "y" * rng.randrange(40)] * 8] + ["z" * 20] * 900
    shards = {}
    for r in splitters.shard(documents(*texts), keep_together=0.3, range_rows=range_rows).collect():
        shards.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert all(len(s) == 1 for t, s in shards.items() if t[0] != "z") and len(shards["z" * 20]) > 1
