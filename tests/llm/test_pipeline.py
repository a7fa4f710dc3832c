"""The stages of the pipeline against brute force, each on its own input."""

import gc
import random
import weakref

import corpus_pipeline as pipeline
import public_tokenizers
import pytest
import sentencepiece

from ratelantern.llm import bayes_minhash, language_id, pfair, sentencepieces
from ratelantern.llm.queries import MIX_BLOCK_DOCS, MIX_WEIGHTS
from test_texts import components_of, removed

WORDS = {"en": "the and of that with from this have which were".split(), "de": "der und nicht eine auch sich wird sein oder nach".split()}
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture
def corpus(documents):
    rng = random.Random(9)
    passage = " ".join(f"p{rng.randrange(999)}" for _ in range(60))
    texts, langs = [], []
    for i in range(60):
        lang = rng.choice(["en", "de"])
        words = [rng.choice(WORDS[lang]) + (f"{rng.randrange(99)}" if rng.random() < 0.5 else "") for _ in range(60)]
        if i % 6 == 1:
            words = texts[i - 1].split()  # a near copy of the one before
            words[30] = "other"
            lang = langs[-1]
        texts.append(" ".join([*words, passage]) if i % 10 == 0 else " ".join(words))
        langs.append(lang)
    texts += [None, "", "12 34 !!", texts[5], texts[7]]
    langs += ["en", None, "de", langs[5], None]
    ids = [*range(len(texts) - 2), None, 7]  # a row without an id, and one repeated row
    return documents(*texts, ids=ids, langs=langs, sources=[["a", "src0", None][i % 3] for i in range(len(texts))])


def test_a_worker_remembers_one_operator_at_a_time():
    """Workers outlive the stages of the pipeline."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    kept = sentencepieces.encoder(model)
    assert sentencepieces.encoder(model) is kept
    gone = [weakref.ref(kept)]
    kept = language_id.piece_table(model)
    gone.append(weakref.ref(kept))
    del kept
    names = bayes_minhash.shingle_set("a b c d", 3).tolist()
    gc.collect()
    assert [found() for found in gone] == [None, None]
    assert bayes_minhash.shingle_set("a b c d", 3).tolist() == names


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_are_the_five_in_order():
    assert [name for name, _ in pipeline.STAGES] == ["identify_language", "near_dedup", "substring_dedup", "mix_sources", "encode_pieces"]


def test_language_rejects_only_what_has_none(spark, corpus):
    kept = pipeline.identify_language(spark, corpus, "")
    assert kept.columns == COLUMNS
    rejected = corpus.exceptAll(kept)
    assert {r.text for r in rejected.collect()} == {None, "", "12 34 !!"}


def test_near_dedup_keeps_one_of_each_group(spark, corpus):
    kept = pipeline.near_dedup(spark, corpus, "")
    assert kept.columns == COLUMNS
    texts = texts_of(corpus.where("doc_id IS NOT NULL"))
    expected = {i for i, (_, component) in components_of(sorted(texts.items()), 5, 80).items() if i == component}
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == sorted(expected)
    assert sum(r.doc_id is None for r in rows) == 1
    assert len(expected) < len(texts)


def test_substring_dedup(spark, corpus):
    docs = corpus.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    found = pipeline.substring_dedup(spark, docs, "")
    assert found.columns == COLUMNS
    texts = texts_of(docs)
    kept, gone = removed(sorted(texts.items()), 20)
    assert any(gone.values())
    rows = found.collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        assert r.text == (" ".join(kept[r.doc_id]) if gone[r.doc_id] else texts[r.doc_id])
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_mixing_and_encoding_keep_all_rows(spark, corpus):
    mixed = pipeline.mix_sources(spark, corpus, "")
    assert mixed.columns == COLUMNS
    assert mixed.exceptAll(corpus).count() == corpus.exceptAll(mixed).count() == 0
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = [(r.doc_id, None if r.text is None else library.encode(r.text)) for r in corpus.collect()]
    encoded = pipeline.encode_pieces(spark, mixed, "").collect()
    assert sorted(((r.doc_id, r.ids) for r in encoded), key=repr) == sorted(expected, key=repr)
    slots = {(r.doc_id, r.n_ids): r.slot for r in encoded}
    schedule = pfair.mixed(corpus, MIX_WEIGHTS, 1, MIX_BLOCK_DOCS).collect()
    assert len({r.slot for r in schedule}) > 1
    assert sorted((str(r.doc_id), r.slot) for r in schedule) == sorted((str(r.doc_id), r.slot) for r in encoded)
    # The files of the stage before are in the same order.
    order = [slots[r.doc_id, None if r.text is None else len(library.encode(r.text))] for r in mixed.collect()]
    assert order == sorted(order)


def test_rows_that_share_an_id_are_one_document(spark, documents):
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(30)) for _ in range(4)]
    docs = documents(*texts, None, ids=[1, 1, 2, None, 1])
    for _ in range(2):
        rows = pipeline.near_dedup(spark, docs.repartition(3), "").collect()
        assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted([(1, min(texts[:2])), (2, texts[2]), (None, texts[3])], key=repr)


def test_columns_beyond_those_of_documents(spark, corpus):
    """Columns with the names of what operators add do no harm."""
    wide = corpus.selectExpr("*", "'x' AS lang_pred", "1 AS score", "2 AS slot", "'y' AS class", "3 AS component_id", "4 AS n_words", "'z' AS kept_text", "5 AS block")
    for name, stage in pipeline.STAGES:
        plain, extra = stage(spark, corpus, ""), stage(spark, wide, "")
        assert extra.columns == plain.columns, name
        assert extra.count() == plain.count(), name


def test_empty(spark, corpus):
    none = corpus.where("false")
    for _, stage in pipeline.STAGES:
        assert stage(spark, none, "").count() == 0
