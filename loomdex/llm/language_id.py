"""Language identification by unigram piece models, marginalised over segmentations.

The pieces come from a fixed public vocabulary. Every language has its own piece
probabilities, learnt by expectation maximisation on the words of a sample of its documents.
A word's probability is the sum over all its segmentations into pieces (forward algorithm);
a text's is the product over its words.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, kind_of

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"[^\W\d_]+")
#: Longer words are scored on their own with a scaled forward pass, so that no product underflows;
#: the learner, which reads a bounded sample, takes them as several words of this many characters.
WORD_CHARS = 32
MARK = "▁"
#: Probability of a character that no piece covers.
UNKNOWN = 1e-8
#: Words remembered by a Python worker; scoring stays the same when it forgets them.
CACHE_WORDS = 300_000
MAX_LANGUAGES = 1000


def vocabulary(path: str = VOCABULARY) -> list[str]:
    """Lower-case pieces of letters, with or without the mark of a word's start."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (model.id_to_piece(i) for i in range(len(model)))
    return sorted({p for p in pieces if p.removeprefix(MARK).isalpha() and p == p.lower()} | {MARK})


def numbered(pieces: list[str]) -> dict[str, int]:
    """Piece to number; -1 for what only begins a piece."""
    begins = {p[:i]: -1 for p in pieces for i in range(1, len(p))}
    return begins | {p: i for i, p in enumerate(pieces)}


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def stretches(words: list[str]) -> list[str]:
    """The words, those over WORD_CHARS characters in several parts."""
    return [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]


class Lattice:
    """All segmentations of a list of words as arrays of arcs (word, start, end, piece)."""

    def __init__(self, words: list[str], ids: dict[str, int], unknown: int):
        word, start, end, piece = [], [], [], []
        get = ids.get
        self.ends = np.array([len(w) + 1 for w in words], np.int64)
        for n, w in enumerate(words):
            s = MARK + w
            size = len(s)
            for i in range(size):
                one = get(s[i], -1)
                word.append(n), start.append(i), end.append(i + 1), piece.append(one if one >= 0 else unknown)
                for j in range(i + 2, size + 1):
                    p = get(s[i:j])
                    if p is None:
                        break
                    if p >= 0:
                        word.append(n), start.append(i), end.append(j), piece.append(p)
        self.n = len(words)
        self.word, self.start, self.end, self.piece = (np.array(x, np.int64) for x in (word, start, end, piece))
        self.width = int(self.ends.max(initial=0))
        order = np.argsort(self.end, kind="stable")
        self.by_end = np.split(order, np.searchsorted(self.end[order], np.arange(1, self.width + 1)))[1:] if self.n else []

    def forward(self, probabilities: np.ndarray) -> np.ndarray:
        """[words, positions, models]: summed probability of reaching each position; probabilities [pieces + 1, models]."""
        alpha = np.zeros((self.width + 1, self.n, probabilities.shape[1]))
        alpha[0] = 1
        for at, arcs in enumerate(self.by_end, 1):
            word = self.word[arcs]
            flow = alpha[self.start[arcs], word] * probabilities[self.piece[arcs]]
            for m in range(flow.shape[1]):
                alpha[at, :, m] = np.bincount(word, flow[:, m], self.n)
        return alpha

    def log_probabilities(self, probabilities: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros((0, probabilities.shape[1]))
        alpha = self.forward(probabilities)
        return np.log(np.maximum(alpha[self.ends, np.arange(self.n)], 1e-300))

    def expected(self, probabilities: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece for one model, over words seen ``counts`` times."""
        alpha = self.forward(probabilities[:, None])[:, :, 0]
        beta = np.zeros((self.width + 1, self.n))
        beta[self.ends, np.arange(self.n)] = 1
        order = np.argsort(-self.start, kind="stable")
        for arcs in np.split(order, np.searchsorted(-self.start[order], np.arange(-self.width + 2, 1))):
            if len(arcs):
                at = self.start[arcs[0]]
                beta[at] += np.bincount(self.word[arcs], beta[self.end[arcs], self.word[arcs]] * probabilities[self.piece[arcs]], self.n)
        total = np.maximum(alpha[self.ends, np.arange(self.n)], 1e-300)
        use = alpha[self.start, self.word] * probabilities[self.piece] * beta[self.end, self.word] / total[self.word] * counts[self.word]
        return np.bincount(self.piece, use, len(probabilities))


def long_word(word: str, ids: dict[str, int], probabilities: np.ndarray) -> np.ndarray:
    """Log probability by model of a word of any length: the forward pass with each position scaled to one."""
    s, unknown = MARK + word, len(probabilities) - 1
    total = np.zeros(probabilities.shape[1])
    reach: list[list[tuple[int, int]]] = [[] for _ in s]  # by end: start and piece
    for i in range(len(s)):
        one = ids.get(s[i], -1)
        reach[i].append((i, one if one >= 0 else unknown))
        for j in range(i + 2, len(s) + 1):
            p = ids.get(s[i:j])
            if p is None:
                break
            if p >= 0:
                reach[j - 1].append((i, p))
    longest = max(end + 1 - i for end, arcs in enumerate(reach) for i, _ in arcs)
    # by position: its probability over that of the latest one
    scaled = {0: np.ones(probabilities.shape[1])}
    for end, arcs in enumerate(reach):
        now = sum(scaled[i] * probabilities[p] for i, p in arcs)
        total += np.log(now)
        scaled = {i: a / now for i, a in scaled.items() if i + longest >= end + 2}
        scaled[end + 1] = np.ones(len(now))
    return total


def train(docs: DataFrame, pieces: list[str], docs_per_language: int = 4000, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities [pieces + 1, languages] from the labelled rows of ``docs``.

    About ``docs_per_language`` documents of each language are read, those with the lowest hashes of
    their ids: the documented bound of the fit. The E step runs where the word counts are, which
    executors keep on their disks until the last round.
    """
    spark = docs.sparkSession
    labelled = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(sizes)
    if not languages:
        return [], np.zeros((len(pieces) + 1, 0))
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit(7)), 11) / F.lit(float(1 << 53))
    taken = F.lit(False)
    for lang in languages:
        taken = taken | ((F.col("lang") == lang) & (draw < docs_per_language / sizes[lang]))

    def count(batches):
        seen: dict[tuple[str, str], int] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for w in stretches(words_of(text)):
                    seen[lang, w] = seen.get((lang, w), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "word", "n"])

    counted = labelled.where(taken).select("lang", "text").mapInArrow(count, "lang string, word string, n long")
    words = counted.groupBy("lang", "word").agg(F.sum("n").alias("n")).persist(StorageLevel.DISK_ONLY)
    ids = spark.sparkContext.broadcast(numbered(pieces))
    number, size = {lang: i for i, lang in enumerate(languages)}, len(pieces)
    model = np.full((size + 1, len(languages)), 1 / (size + 1))
    model[size] = UNKNOWN
    for _ in range(rounds):
        now = spark.sparkContext.broadcast(model)

        def expect(batches, now=now):
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                lang = np.array([number[x] for x in batch.column(0).to_pylist()])
                word, n = batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for at in np.unique(lang).tolist():
                    rows = np.flatnonzero(lang == at)
                    for a in range(0, len(rows), 4096):
                        part = rows[a : a + 4096]
                        use = Lattice([word[i] for i in part], ids.value, size).expected(now.value[:, at], n[part].astype(float))
                        sums[at] = sums.get(at, 0) + use
            for at, use in sums.items():
                hit = np.flatnonzero(use)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hit), at, np.int32)), pa.array(hit.astype(np.int32)), pa.array(use[hit])], ["lang", "piece", "uses"])

        uses = words.mapInArrow(expect, "lang int, piece int, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses")).toArrow()  # at most pieces * languages rows
        found = np.zeros_like(model)
        found[uses["piece"].to_numpy(), uses["lang"].to_numpy()] = uses["uses"].to_numpy()
        known = found[:size] + 0.01
        model = np.vstack([known / known.sum(axis=0), np.full((1, len(languages)), UNKNOWN)])
        now.destroy()
    words.unpersist()
    ids.destroy()
    return languages, model


#: The scorer of the latest model in a Python worker.
_MEMORY: dict = {}


class _Scorer:
    def __init__(self, ids: dict[str, int], model: np.ndarray):
        self.ids, self.model = ids, model
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, model.shape[1]), np.float64)

    def learn(self, words: list[str]) -> None:
        for a in range(0, len(words), 4096):
            part = words[a : a + 4096]
            first = len(self.rows)
            while first + len(part) > len(self.scores):
                self.scores = np.vstack([self.scores, np.zeros_like(self.scores)])
            short = [w if len(w) <= WORD_CHARS else "" for w in part]
            self.scores[first : first + len(part)] = Lattice(short, self.ids, len(self.model) - 1).log_probabilities(self.model)
            for i, w in enumerate(part):
                if len(w) > WORD_CHARS:
                    self.scores[first + i] = long_word(w, self.ids, self.model)
            self.rows.update(zip(part, range(first, first + len(part)), strict=True))

    def sums(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Per text the log probability by language; None without letters. Holds some texts' words at a time."""
        out = []
        for a in range(0, len(texts), 200):
            split = [words_of(t) for t in texts[a : a + 200]]
            met = {w for words in split for w in words}
            new = [w for w in met if w not in self.rows]
            if len(self.rows) + len(new) > CACHE_WORDS:
                self.rows.clear()
                new = list(met)
            self.learn(new)
            row = self.rows.__getitem__
            for words in split:
                if any(c.isalpha() for w in words for c in w):
                    out.append(self.scores[np.fromiter(map(row, words), np.int64, len(words))].sum(axis=0))
                else:
                    out.append(None)
        return out


def identify(docs: DataFrame, languages: list[str], model: np.ndarray, pieces: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for each row, over whole texts.

    Score is the posterior of the likeliest language under equal priors; ties go to the first
    language by name. Null texts, texts without letters and any text under a model without
    languages give 'und' and 0. Ids have any type. Repeated rows and null ids are scored like others; an empty table
    gives no rows; other columns are ignored.
    """
    predict = _predictor(docs, languages, model, pieces)

    def run(batches):
        for batch in batches:
            names, scores = predict(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    found = rows.mapInArrow(run, f"id {kind_of(rows, 'id')}, lang_pred string, score double")
    return found.withColumnRenamed("id", id_col)


def _remembered(key: str, ids: dict[str, int], model: np.ndarray) -> _Scorer:
    """The worker's scorer of this model, with the words that it has met in earlier tasks."""
    if key not in _MEMORY:
        _MEMORY.clear()
        _MEMORY[key] = _Scorer(ids, model)
    return _MEMORY[key]


def _predictor(docs: DataFrame, languages: list[str], model: np.ndarray, pieces: list[str]):
    """A function for workers from a column of texts to languages and scores."""
    shared = docs.sparkSession.sparkContext.broadcast((numbered(pieces), model, languages))  # vocabulary times languages
    key = uuid.uuid4().hex

    def predict(texts: pa.Array) -> tuple[list[str], list[float]]:
        ids, model, languages = shared.value
        scorer = _remembered(key, ids, model)
        names, scores = [], []
        for s in scorer.sums(texts.to_pylist()) if languages else [None] * len(texts):
            if s is None:
                names.append("und"), scores.append(0.0)
            else:
                best = int(s.argmax())
                names.append(languages[best]), scores.append(float(1 / np.exp(s - s[best]).sum()))
        return names, scores

    return predict


def identified(docs: DataFrame, languages: list[str], model: np.ndarray, pieces: list[str], least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, that have a language and a score of ``least_score`` or more (see ``identify``)."""
    predict = _predictor(docs, languages, model, pieces)

    def run(batches):
        for batch in batches:
            names, scores = predict(batch.column(batch.schema.get_field_index(text_col)))
            yield batch.filter(pa.array([n != "und" and s >= least_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op10_language_id(spark, sf_dir, vocabulary_path: str = VOCABULARY):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    pieces = vocabulary(vocabulary_path)
    languages, model = train(docs.where(~held_out(F.col("doc_id"), 4)), pieces)
    found = identify(docs, languages, model, pieces)
    return found.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "lang_pred", "score")
