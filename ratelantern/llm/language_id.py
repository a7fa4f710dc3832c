"""Language identification by unigrams whose segmentation is summed out.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum over all ways to cut it into pieces, found by the forward
algorithm over the word's lattice; a text is scored as the product over its words and the share of
the language. Piece probabilities are fitted by expectation maximisation: each round spreads a
word's count over its pieces by forward and backward sums.

Fitting uses up to ``sample_docs`` documents per language, chosen by a hash of their ids; the
shares of languages count all documents to learn from. Prediction reads every whole text.

* A text that is null or has no letter is ``und`` with score 0; so is every text if no document can be learned from.
* Documents with null text or language are not learned from. A null id is not held out.
* Repeated rows are predicted one by one; equal scores go to the first language by name. Only
  ``doc_id``, ``text`` and (to learn) ``lang`` are read.
"""

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ratelantern.llm.common import id_remainder, remembered
from ratelantern.llm.lattice import Edges, PieceTable
from ratelantern.session import write_stage

LETTER = regex.compile(r"\p{L}")
#: Probability of a character that is no piece, the same in every language.
UNKNOWN = 1e-7
SMOOTHING = 0.05
MAX_KNOWN = 300_000
#: Words above this length are summed one by one, with sums rescaled at every position.
LONG = 48


def piece_table(path: str) -> PieceTable:
    return remembered((__name__, path), lambda: PieceTable(path))


def words_of(text: str) -> list[str]:
    """Lower-case words, marked at their start."""
    return ["▁" + w for w in text.lower().split()]


def forward(edges, weights: np.ndarray) -> np.ndarray:
    """Sums over all segmentations: [word, position, language], from the start of the word."""
    longest = int(edges.lengths.max(initial=0))
    alpha = np.zeros((len(edges.lengths), longest + 1, weights.shape[1]))
    alpha[:, 0] = 1
    cuts = np.searchsorted(edges.end, np.arange(1, longest + 2))
    for end in range(1, longest + 1):
        rows = slice(cuts[end - 1], cuts[end])
        word = edges.word[rows]
        if not len(word):
            continue
        gained = alpha[word, edges.start[rows]] * weights[edges.piece[rows]]
        first = np.nonzero(np.diff(word, prepend=-1))[0]  # rows of one word are neighbours
        alpha[word[first], end] = np.add.reduceat(gained, first, axis=0)
    return alpha


def word_scores(table: PieceTable, words: list[str], weights: np.ndarray) -> np.ndarray:
    """Natural log of each word's probability per language."""
    scores = np.zeros((len(words), weights.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LONG]
    if short:
        edges = table.edges([words[i] for i in short])
        alpha = forward(edges, weights)
        scores[short] = np.log(np.maximum(alpha[np.arange(len(short)), edges.lengths], 1e-300))
    for i, word in enumerate(words):
        if len(word) > LONG:
            scores[i] = long_word_sums(table, word, weights)[0][len(word)]
    return scores


def long_word_sums(table: PieceTable, word: str, weights: np.ndarray) -> tuple[np.ndarray, Edges]:
    """Natural log of the sums over all segmentations of each prefix of one word, and the word's edges.

    The sums that later positions reach back to are kept relative to a scale per language, which moves with the position.
    """
    edges = table.edges([word])
    logs = np.zeros((len(word) + 1, weights.shape[1]))
    cuts = np.searchsorted(edges.end, np.arange(1, len(word) + 2))
    for end in range(1, len(word) + 1):
        rows = slice(cuts[end - 1], cuts[end])
        terms = logs[edges.start[rows]] + np.log(weights[edges.piece[rows]])
        most = terms.max(axis=0)
        logs[end] = most + np.log(np.exp(terms - most).sum(axis=0))
    return logs, edges


def long_word_counts(table: PieceTable, word: str, count: float, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in one long word, for one language."""
    before, edges = long_word_sums(table, word, weights)
    w = np.log(weights[:, 0])
    after = np.full(len(word) + 1, -np.inf)
    after[len(word)] = 0
    order = np.argsort(-edges.start, kind="stable")
    cuts = np.searchsorted(-edges.start[order], -np.arange(len(word) - 1, -2, -1))
    for start, a, b in zip(range(len(word) - 1, -1, -1), cuts[:-1], cuts[1:], strict=True):
        rows = order[a:b]
        terms = after[edges.end[rows]] + w[edges.piece[rows]]
        most = terms.max()
        after[start] = most + np.log(np.exp(terms - most).sum())
    used = np.exp(before[edges.start, 0] + w[edges.piece] + after[edges.end] - before[len(word), 0]) * count
    return np.bincount(edges.piece, used, minlength=len(weights))


def expected_counts(table: PieceTable, words: list[str], counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Expected number of times each piece is used, for one language (``weights`` has one column)."""
    long = [i for i, w in enumerate(words) if len(w) > LONG]
    if long:
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        result = expected_counts(table, [words[i] for i in short], counts[short], weights)
        for i in long:
            result += long_word_counts(table, words[i], counts[i], weights)
        return result
    edges = table.edges(words)
    alpha = forward(edges, weights)[:, :, 0]
    beta = np.zeros_like(alpha)
    beta[np.arange(len(words)), edges.lengths] = 1
    order = np.lexsort((edges.word, -edges.start))
    starts = -edges.start[order]
    w = weights[:, 0]
    for start in range(int(edges.lengths.max(initial=1)) - 1, -1, -1):
        rows = order[np.searchsorted(starts, -start) : np.searchsorted(starts, -start, side="right")]
        word = edges.word[rows]
        if not len(word):
            continue
        gained = beta[word, edges.end[rows]] * w[edges.piece[rows]]
        first = np.nonzero(np.diff(word, prepend=-1))[0]
        beta[word[first], start] = np.add.reduceat(gained, first)
    total = np.maximum(alpha[np.arange(len(words)), edges.lengths], 1e-300)
    used = alpha[edges.word, edges.start] * w[edges.piece] * beta[edges.word, edges.end] * (counts / total)[edges.word]
    return np.bincount(edges.piece, used, minlength=len(weights))


def _normal(counts: np.ndarray) -> np.ndarray:
    """Probabilities from counts; the last row, for unknown characters, is fixed."""
    p = counts + SMOOTHING
    p[-1] = 0
    p /= p.sum(axis=0)
    p[-1] = UNKNOWN
    return p


def fit(docs: DataFrame, model: str, sample_docs: int = 3000, rounds: int = 3) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log shares and piece probabilities [piece, language].

    ``docs`` are the documents to learn from. One number per piece and language comes to the driver.
    """
    spark = docs.sparkSession
    table = piece_table(model)
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    shares = sorted((r["lang"], r["n"]) for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect())
    languages = [lang for lang, _ in shares]
    if not languages:
        return [], np.zeros(0), np.zeros((table.unknown + 1, 0))
    scale = 1 << 30
    quota = F.lit(0)
    for lang, n in shares:
        quota = F.when(F.col("lang") == lang, F.lit(min(scale, int(scale * sample_docs / n)))).otherwise(quota)
    sample = known.where(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(scale)) < quota).select("lang", "text")

    def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for w in words_of(text):
                    counts[lang, w] = counts.get((lang, w), 0) + 1
            keys = list(counts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in keys], pa.string()), "word": pa.array([k[1] for k in keys], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    words = write_stage(
        sample.mapInArrow(word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "language-words"
    )
    pieces = table.unknown + 1
    start = np.array([2.0 ** (-len(p)) for p in table.pieces] + [0.0])
    weights = np.repeat(_normal(start)[:, None], len(languages), axis=1)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(weights)

        def expect(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            own = piece_table(model)
            for batch in batches:
                for lang, rows in batch.groupby("lang"):
                    at = languages.index(lang)
                    for i in range(0, len(rows), 10_000):
                        part = rows.iloc[i : i + 10_000]
                        used = expected_counts(own, list(part["word"]), part["n"].to_numpy(float), sent.value[:, at : at + 1])
                        piece = np.nonzero(used)[0]
                        yield pd.DataFrame({"at": at, "piece": piece, "n": used[piece]})

        counts = np.zeros((pieces, len(languages)))
        used = words.mapInPandas(expect, "at int, piece int, n double").groupBy("at", "piece").agg(F.sum("n").alias("n")).toPandas()
        counts[used["piece"], used["at"]] = used["n"]
        weights = np.stack([_normal(counts[:, i]) for i in range(len(languages))], axis=1)
        sent.unpersist()
    total = sum(n for _, n in shares)
    return languages, np.log([n / total for _, n in shares]), weights


class Predictor:
    def __init__(self, model: str, weights: np.ndarray):
        self.table, self.weights = piece_table(model), weights
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((0, weights.shape[1]))

    def texts(self, texts: list[str]) -> np.ndarray:
        """Log probability of each text per language."""
        by_text = [words_of(t) for t in texts]
        if len(self.rows) > MAX_KNOWN:
            self.rows, self.scores = {}, np.zeros((0, self.weights.shape[1]))
        rows = self.rows
        new = list({w for words in by_text for w in words if w not in rows})
        made = [self.scores]
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            made.append(word_scores(self.table, part, self.weights))
            rows.update(zip(part, range(len(rows), len(rows) + len(part)), strict=True))
        self.scores = np.concatenate(made)
        result = np.zeros((len(texts), self.weights.shape[1]))
        for i, words in enumerate(by_text):
            if words:
                at = np.fromiter(map(rows.__getitem__, words), dtype=np.int64, count=len(words))
                result[i] = self.scores[at].sum(axis=0)
        return result


def predict(docs: DataFrame, model: str, fitted: tuple[list[str], np.ndarray, np.ndarray], rows_at_once: int = 1024) -> DataFrame:
    """The rows of ``docs`` with lang_pred and score; ``docs`` has a column text."""
    languages, prior, weights = fitted
    sent = docs.sparkSession.sparkContext.broadcast((prior, weights))
    name = uuid.uuid4().hex
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prior, weights = sent.value
        predictor = remembered((__name__, name), lambda: Predictor(model, weights)) if languages else None
        for whole in batches:
            for i in range(0, whole.num_rows, rows_at_once):
                batch = whole.slice(i, rows_at_once)
                texts = batch.column("text").to_pylist()
                scored = [j for j, t in enumerate(texts) if t is not None and predictor and LETTER.search(t)]
                lang: list[str] = ["und"] * len(texts)
                score = [0.0] * len(texts)
                if scored:
                    logs = predictor.texts([texts[j] for j in scored]) + prior
                    logs -= logs.max(axis=1, keepdims=True)
                    share = np.exp(logs)
                    share /= share.sum(axis=1, keepdims=True)
                    best = share.argmax(axis=1)
                    for j, b, s in zip(scored, best, share, strict=True):
                        lang[j], score[j] = languages[b], float(s[b])
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names, "lang_pred", "score"]
                )

    return docs.mapInArrow(run, schema)


def identified(docs: DataFrame, model: str, fold: int = 1, folds: int = 3) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the documents outside ``fold``."""
    base = docs.select(F.col("doc_id").cast("long"), "text", "lang")
    fitted = fit(base.where(id_remainder("doc_id", folds) != fold), model)
    rows = base.select("doc_id", (id_remainder("doc_id", folds) == fold).alias("held_out"), "text")
    return predict(rows, model, fitted).drop("text")
