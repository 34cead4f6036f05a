"""Language identification by piece models that add up all ways to cut a word into pieces.

A language is a distribution over the pieces of a fixed public vocabulary. The probability of a word is the sum, over
all its segmentations, of the products of their pieces' probabilities; a forward pass adds them up. Piece
probabilities are fitted by expectation-maximisation, whose expected counts come from the same sums.
"""

import functools
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.tables import discard
from ebbtide.llm.text import held, parts, vocabulary
from ebbtide.session import materialized

UNDETERMINED = "und"
#: Expected number of texts of one language that a model is fitted on at most (a hash decides which ones).
TEXTS_PER_LANGUAGE = 1500
EM_ROUNDS = 3
#: A character outside the vocabulary is a piece of its own with this probability.
UNKNOWN = 1e-7
#: Added to every expected count, so that pieces a language never showed keep a small probability.
SMOOTHING = 0.05
LONGEST_WORD = 40
BOUNDARY = "▁"


@functools.lru_cache(maxsize=2)
def pieces_of(path):
    """Lower-case pieces of a public vocabulary, with the mark of a word's start; piece to number."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_control(i)}
    kept = sorted(p for p in found if p and not p.startswith("<0x") and p != "<unk>")
    return {piece: i for i, piece in enumerate(kept)}


@functools.lru_cache(maxsize=2)
def beginnings_of(path):
    return beginnings(pieces_of(path))


@functools.lru_cache(maxsize=2)
def steps_of(path):
    return Steps(pieces_of(path))


def beginnings(numbers):
    """Every beginning of a piece to the piece's number, or to -1 if it is no piece itself: a trie as one table."""
    found = {piece[:n]: -1 for piece in numbers for n in range(1, len(piece))}
    return found | numbers


class Steps:
    """The beginnings of pieces as arrays, through which many words go at once, a character at a time.

    State 0 is the empty beginning, -1 is none; ``piece`` has the number of each state's piece, or -1.
    """

    def __init__(self, numbers):
        known = beginnings(numbers)
        state = {beginning: i for i, beginning in enumerate(known, 1)} | {"": 0}
        chars = {c: i for i, c in enumerate(sorted(set("".join(numbers))), 1)}
        self.kind = np.zeros(0x110000, np.int32)  # characters that no piece has are of kind 0
        self.kind[[ord(c) for c in chars]] = list(chars.values())
        self.kinds = len(chars) + 1
        found = sorted((state[b[:-1]] * self.kinds + chars[b[-1]], i) for b, i in state.items() if b)
        self.keys, self.states = np.array(found, np.int64).reshape(-1, 2).T.copy()
        self.keys = np.append(self.keys, np.iinfo(np.int64).max)
        self.states = np.append(self.states, -1)
        self.piece = np.array([-1, *known.values()], np.int64)

    def next(self, states, kinds):
        keys = states * self.kinds + kinds
        at = np.searchsorted(self.keys, keys)
        return np.where(self.keys[at] == keys, self.states[at], -1)


_RUN = re.compile(r"[^\W\d_]+")


def letters_of(run):
    """A run may have number signs, which are no letters."""
    return run if run.isalpha() else "".join(c for c in run if c.isalpha())


def runs_of(text):
    """Lower-case runs that the pattern finds, to how often each is there; long runs come in parts of their letters."""
    counts = Counter(_RUN.findall(text.lower()))
    if max(map(len, counts), default=0) > LONGEST_WORD:
        for run in [r for r in counts if len(r) > LONGEST_WORD]:
            n, letters = counts.pop(run), letters_of(run)
            for i in range(0, len(letters), LONGEST_WORD):
                counts[letters[i : i + LONGEST_WORD]] += n
    return counts


def words_of(runs):
    """The runs that have a letter, each as its letters behind the mark of a word's start."""
    return [BOUNDARY + letters for letters in map(letters_of, runs) if letters]


def forward(words, numbers, probability, steps=None):
    """Probability of each word under each language: a row for each word.

    ``probability`` has a row for each piece, then one for an unknown character and one of zeros; ``steps``:
    ``Steps(numbers)``. All words go through the pass together, the longest first: from each place on they are followed
    as far as some piece goes on.
    """
    unknown = len(probability) - 2
    steps = Steps(numbers) if steps is None else steps
    order = sorted(range(len(words)), key=lambda i: -len(words[i]))
    words = [words[i] for i in order]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    kinds = steps.kind[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
    first = np.cumsum(sizes) - sizes  # of a word's characters; its places are one more than these
    place = first + np.arange(len(words))
    reached = np.zeros((len(kinds) + len(words), probability.shape[1]))
    reached[place] = 1.0
    for start in range(sizes[0] if len(words) else 0):
        rows = np.arange(np.searchsorted(-sizes, -start))  # words that are longer than this
        states = np.zeros(len(rows), np.int64)
        end = start
        while len(rows):
            states = steps.next(states, kinds[first[rows] + end])
            end += 1
            pieces = np.where(states < 0, -1, steps.piece[states])
            if end == start + 1:
                pieces = np.where(pieces < 0, unknown, pieces)
            used = pieces >= 0
            here = place[rows[used]]
            reached[here + end] += reached[here + start] * probability[pieces[used]]
            on = (states >= 0) & (sizes[rows] > end)
            rows, states = rows[on], states[on]
    result = np.empty((len(words), probability.shape[1]))
    result[order] = reached[place + sizes]
    return result


def expected_pieces(word, numbers, probability, unknown=UNKNOWN, known=None):
    """Expected number of times each piece is used over all segmentations of a word, under one language."""
    known = beginnings(numbers) if known is None else known
    n = len(word)
    edges = []
    for start in range(n):
        end = start + 1
        k = known.get(word[start:end])
        if k is None or k < 0:
            edges.append((start, end, -1, unknown))
        while k is not None:
            if k >= 0:
                edges.append((start, end, k, probability[k]))
            end += 1
            k = known.get(word[start:end]) if end <= n else None
    ahead, behind = [1.0] + [0.0] * n, [0.0] * n + [1.0]
    for start, end, _, p in edges:
        ahead[end] += ahead[start] * p
    for start, end, _, p in reversed(edges):
        behind[start] += p * behind[end]
    whole = ahead[n]
    counts = defaultdict(float)
    if whole > 0.0:
        for start, end, k, p in edges:
            if k >= 0:
                counts[k] += ahead[start] * p * behind[end] / whole
    return counts


class LanguageModel:
    """Piece probabilities of every language, and how common the languages are."""

    WORDS_KEPT = 250_000
    TEXTS_AT_ONCE = 400

    def __init__(self, languages, priors, probability, path):
        self.name = uuid.uuid4().hex
        self.languages = list(languages)
        self.log_priors = np.log(np.asarray(priors, float))
        self.probability = probability
        self.path = path
        self._forget()

    def _forget(self):
        """No run is known: ``known`` has the row of each known run in ``scores``, or -1 if it has no letter."""
        self.known, self.scores = {}, np.empty((0, len(self.log_priors)))
        self.n_rows = 0

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "scores": self.scores[:0], "n_rows": 0}

    def _learn(self, new):
        some = np.fromiter((bool(letters_of(run)) for run in new), bool, len(new))
        found = forward(words_of(new), None, self.probability, steps_of(self.path))
        n, size = self.n_rows, len(found)
        if n + size > len(self.scores):
            grown = np.empty((2 * (n + size), self.scores.shape[1]))
            grown[:n] = self.scores[:n]
            self.scores = grown
        self.scores[n : n + size] = np.log(np.maximum(found, 1e-300))
        self.n_rows = n + size
        self.known.update(zip(new, np.where(some, n + np.cumsum(some) - 1, -1).tolist()))

    def predict_all(self, texts):
        """(language, share of the posterior) of each whole text; (und, 0) for null or a text without letters."""
        out = []
        for i in range(0, len(texts), self.TEXTS_AT_ONCE):
            counts = [runs_of(t) if t else Counter() for t in texts[i : i + self.TEXTS_AT_ONCE]]
            if len(self.known) > self.WORDS_KEPT:
                self._forget()
            new = list(set().union(*counts).difference(self.known))
            for first in range(0, len(new), 10_000):
                self._learn(new[first : first + 10_000])
            out += [self._best(c) for c in counts]
        return out

    def _best(self, counts):
        n = np.fromiter(counts.values(), float, len(counts))
        rows = np.fromiter(map(self.known.__getitem__, counts), np.int64, len(counts))
        if rows.min(initial=0) < 0:
            n, rows = n[rows >= 0], rows[rows >= 0]
        if not len(rows) or not self.languages:
            return UNDETERMINED, 0.0
        total = self.log_priors + n @ self.scores[rows]
        share = np.exp(total - total.max())
        best = int(np.argmax(total))
        return self.languages[best], float(share[best] / share.sum())


def _in_worker(model):
    """The worker's own copy of a model, which keeps the words it has scored from task to task."""
    return held(("language", model.name), lambda: model)


def held_out(id_column="doc_id"):
    """One document in five by its id; never true without an id."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnable():
    return F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()


def _word_counts(labelled):
    def count(batches):
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words = Counter()
                for text in texts:
                    words.update(runs_of(text))
                words = {run: n for run, n in words.items() if letters_of(run)}
                yield pd.DataFrame({"lang": lang, "word": words_of(words), "n": list(words.values())})

    counted = labelled.mapInPandas(count, "lang string, word string, n long")
    return counted.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _expected(word_counts, languages, probability, path):
    """Sum of expected piece counts: a matrix of pieces by languages."""
    place = {lang: i for i, lang in enumerate(languages)}

    def expect(batches):
        numbers, known = pieces_of(path), beginnings_of(path)
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                of_language = probability[:, place[lang]].tolist()
                total = defaultdict(float)
                for word, n in zip(rows["word"], rows["n"]):
                    for k, c in expected_pieces(word, numbers, of_language, known=known).items():
                        total[k] += n * c
                yield pd.DataFrame({"lang": lang, "piece": list(total), "n": list(total.values())})

    summed = (
        word_counts.mapInPandas(expect, "lang string, piece int, n double")
        .groupBy("lang", "piece")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # at most a row for each language and piece of the vocabulary
    )
    counts = np.zeros((len(probability) - 2, len(languages)))
    counts[summed["piece"], summed["lang"].map(place)] = summed["n"]
    return counts


def fit_languages(docs: DataFrame, per_language=TEXTS_PER_LANGUAGE, rounds=EM_ROUNDS, path=None) -> LanguageModel:
    """Piece models of all languages in the learnable rows (text, lang and doc_id not null, not held out).

    The fit reads a bounded sample: about ``per_language`` texts of each language, chosen by a hash of the row; the
    languages and how common they are come from all learnable rows. Without learnable rows there is no language, and
    every text is undetermined.
    """
    path = path or vocabulary("piece_bpe_32k.model")
    labelled = docs.where(learnable()).select(F.col("lang").cast("string").alias("lang"), "doc_id", "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    n_pieces = len(pieces_of(path))
    probability = np.full((n_pieces + 2, max(len(languages), 1)), 1.0 / n_pieces)
    probability[-2], probability[-1] = UNKNOWN, 0.0
    if not languages:
        return LanguageModel([], [1.0], probability, path)
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000))
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    counts = materialized(_word_counts(labelled.where(draw < share * 1_000_000)), "language-words")
    for _ in range(rounds):
        expected = _expected(counts, languages, probability, path) + SMOOTHING
        probability[:-2] = expected / expected.sum(axis=0)
    discard(docs.sparkSession, counts)
    return LanguageModel(languages, [sizes[x] for x in languages], probability, path)


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with a struct column ``language`` (lang_pred, score), from the whole text and nothing else.

    lang_pred is a learned language, or und (score 0) where the text is null or has no letter; score is the share of
    the posterior. Repeated texts get equal answers.
    """

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        own = _in_worker(model)
        found = []
        for part in parts(texts, own.TEXTS_AT_ONCE):
            found += own.predict_all(part)
        names, scores = zip(*found) if found else ((), ())
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"]
        )

    # A filter on the answer must not be pushed below it: it would ask the model again.
    return docs.withColumn("language", predict.asNondeterministic()(F.col("text").cast("string")))


def predicted_languages(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``doc_id, text, lang``, by a model fitted on them."""
    rows = docs.select("doc_id", "text", "lang")
    return identified(rows.select("doc_id", "text"), fit_languages(rows, **settings)).select(
        "doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score"
    )


def with_known_language(docs: DataFrame, least_score=0.5, **settings) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose language the model can tell; the others are rejected."""
    model = fit_languages(docs.select("doc_id", "text", "lang"), **settings)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    told = identified(packed, model).where(
        (F.col("language.lang_pred") != UNDETERMINED) & (F.col("language.score") >= least_score)
    )
    return told.select("row.*")
