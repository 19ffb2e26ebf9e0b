"""Language identification by unigram piece models summed over all segmentations.

Each language has a probability for each piece of a fixed public vocabulary, learned by expectation maximisation
from labelled texts. A word's probability in a language is the sum over all its segmentations into pieces, found
by the forward algorithm; a text's is the product over its words, and the prediction is the language with the
largest posterior under equal priors. Words are runs of letters of any length, lower-cased, with the vocabulary's
mark of a word's beginning; what is no letter ends a word. A letter outside the vocabulary has one small
probability in every language. Sums are scaled as they go, so a word of a million letters has its probability too.

Fitting is one group for each language, in the executors; the driver gets a number for each piece of the vocabulary
and each language, which grows with the languages and not with the documents.

Defined results: a text that is null or has no letter is `und` with score 0; so is every text when nothing was
learned; equal posteriors go to the language that is first in order; repeated rows get equal results. Columns of
the input are carried along whatever their names, except those named like outputs.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import kept, map_texts, quoted

UNDETERMINED = "und"

#: The models are fitted on about this many labelled texts of each language, taken by a hash of their text.
MAX_TRAINING_TEXTS = 1000

#: Numbers (words times languages) and characters of words that a worker remembers; more are forgotten and computed again.
REMEMBERED = 4 << 20
REMEMBERED_CHARS = 4 << 20

#: Letters of a word whose pieces are looked up at once, and numbers of a batch of words.
CHUNK = 4096
BATCH = 1 << 18

_LETTERS = re.compile(r"[^\W\d_]+")
_UNKNOWN = 1e-7
MARK = "▁"


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased; characters that count as parts of words but are no letters end a run."""
    out = []
    for run in _LETTERS.findall(text.lower()):
        if run.isalpha():
            out.append(run)
        else:
            out += "".join(c if c.isalpha() else " " for c in run).split()
    return out


def read_pieces(model_path: str) -> list[str]:
    """Pieces of a public vocabulary that consist of letters, lower-cased, with and without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_byte(i) and not model.is_unknown(i)}
    return sorted(p for p in pieces if p.removeprefix(MARK).isalpha() and MARK not in p[1:])


class Pieces:
    """The vocabulary as a hash table over the characters of substrings (open addressing)."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.mask = (1 << max(4, (8 * len(pieces)).bit_length())) - 1
        self.keys, self.rows = np.zeros(self.mask + 1, np.uint64), np.full(self.mask + 1, -1, np.int32)
        for row, piece in enumerate(pieces):
            key = 0
            for c in piece:
                key = (key * _BASE + ord(c) + 1) & (1 << 64) - 1
            slot = self._slots(np.array([key], np.uint64))[0]
            while self.rows[slot] >= 0:
                if int(self.keys[slot]) == key:
                    raise ValueError("two pieces of the vocabulary have one hash")
                slot = slot + 1 & self.mask
            self.keys[slot], self.rows[slot] = key, row

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of the piece with each hash, -1 for none."""
        flat = keys.ravel()
        slots = self._slots(flat)
        out = self.rows[slots]
        rest = np.flatnonzero((out >= 0) & (self.keys[slots] != flat))
        while len(rest):
            slots[rest] = (slots[rest] + 1) & self.mask
            out[rest] = self.rows[slots[rest]]
            rest = rest[(out[rest] >= 0) & (self.keys[slots[rest]] != flat[rest])]
        return out.reshape(keys.shape)

    def lay_out(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """chars[i, word], the marked words' characters, and the words' ends."""
        ends = np.fromiter(map(len, words), np.int64, len(words)) + 1
        width = int(ends.max())
        text = np.frombuffer("".join([(MARK + w).ljust(width, "\0") for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32)
        return np.ascontiguousarray(text.reshape(len(words), width).T), ends

    def rows_at(self, chars: np.ndarray, start: int, end: int) -> np.ndarray:
        """rows[length - 1, i, word]: the piece of `length` characters at place start + i, -1 for none."""
        width, count = chars.shape
        longest = min(self.longest, width)
        part = chars[start : end + longest - 1].astype(np.uint64) + np.uint64(1)
        rows = np.full((longest, end - start, count), -1, np.int32)
        key = np.zeros_like(part)
        for n in range(min(longest, len(part))):
            key = key[: len(part) - n] * np.uint64(_BASE) + part[n:]
            rows[n, : len(key)] = self.find(key[: end - start])
        return rows


_BASE = 0x100000001B3


class PieceModel:
    """Piece probabilities of each language: a row of numbers for each piece."""

    def __init__(self, languages: list[str], pieces: Pieces, p: np.ndarray):
        self.languages, self.width, self.pieces, self.p = languages, len(languages), pieces, p

    def _steps(self) -> np.ndarray:
        # the last row, found at -1: no such piece
        return np.vstack([self.p, np.zeros(self.width)])

    def forward(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language: the sum over all segmentations."""
        chars, ends = self.pieces.lay_out(words)
        p, (width, count) = self._steps(), chars.shape
        longest = min(self.pieces.longest, width)
        ahead = np.zeros((longest + 1, count, self.width))  # sums for this place and those that pieces lead to, in a ring
        ahead[0] = 1
        scale, out = np.zeros((count, self.width)), np.zeros((count, self.width))
        for start in range(0, width, CHUNK):
            rows = self.pieces.rows_at(chars, start, min(width, start + CHUNK))
            some = (rows >= 0).any(axis=2)
            for i in range(rows.shape[1]):
                at = start + i
                here = ahead[at % (longest + 1)]
                for n in range(longest):
                    if n == 0:
                        step = p[rows[0, i]]
                        step[rows[0, i] < 0] = _UNKNOWN
                    elif some[n, i]:
                        step = p[rows[n, i]]
                    else:
                        continue
                    ahead[(at + n + 1) % (longest + 1)] += here * step
                here[:] = 0
                done = ends == at + 1
                if done.any():
                    out[done] = np.log(np.maximum(ahead[(at + 1) % (longest + 1)][done], 1e-300)) + scale[done]
                if at % 8 == 7:
                    most = np.maximum(ahead.max(axis=0), 1e-300)
                    ahead /= most
                    scale += np.log(most)
        return out

    def expected(self, words: list[str], counts: np.ndarray, language: int) -> np.ndarray:
        """Expected uses of each piece in all segmentations of the words (forward and backward sums)."""
        chars, ends = self.pieces.lay_out(words)
        p, (width, count) = self._steps()[:, language], chars.shape
        longest = min(self.pieces.longest, width)

        def steps(start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
            rows = self.pieces.rows_at(chars, start, end)
            step = p[rows]
            step[0][rows[0] < 0] = _UNKNOWN
            return rows, step

        # sums at each place, and the logarithm that each is scaled by
        alpha, scale = np.zeros((width + longest + 1, count)), np.zeros((width + 1, count))
        alpha[0] = 1
        log = np.zeros(count)
        for start in range(0, width, CHUNK):
            _, step = steps(start, min(width, start + CHUNK))
            for i in range(step.shape[1]):
                at = start + i
                scale[at] = log
                for n in range(longest):
                    alpha[at + n + 1] += alpha[at] * step[n, i]
                if at % 8 == 7:
                    most = np.maximum(alpha[at + 1 : at + longest + 1].max(axis=0), 1e-300)
                    alpha[at + 1 : at + longest + 1] /= most
                    log = log + np.log(most)
        scale[width] = log
        which = np.arange(count)
        total = np.log(np.maximum(alpha[ends, which], 1e-300)) + scale[ends, which]
        uses = np.zeros(len(self.p) + 1)
        # backwards: what follows a place, scaled likewise, with pieces leaving the places of one chunk at a time
        beta, log = np.zeros((width + longest + 1, count)), np.zeros(count)
        beta[ends, which] = 1
        for start in range((width - 1) // CHUNK * CHUNK, -1, -CHUNK):
            rows, step = steps(start, min(width, start + CHUNK))
            for i in range(rows.shape[1] - 1, -1, -1):
                at = start + i
                weight = np.where(ends > at, counts * np.exp(np.clip(scale[at] + log - total, -700, 700)), 0.0) * alpha[at]
                for n in range(longest):
                    part = beta[at + n + 1] * step[n, i]
                    beta[at] += part
                    step[n, i] = part * weight
                if at % 8 == 0:
                    most = np.maximum(beta[at : at + longest + 1].max(axis=0), 1e-300)
                    most[ends < at] = 1
                    beta[at : at + longest + 1] /= most
                    log = log + np.log(most)
            uses += np.bincount(rows.ravel() % len(uses), step.ravel(), len(uses))
        return uses[:-1]


def _by_length(words: list[str], width: int = 1, size: int = 2000):
    """Words in order of length, a batch of bounded size at a time; a longer word is alone."""
    batch: list[str] = []
    for w in sorted(words, key=len):
        if batch and (len(batch) >= size or (len(batch) + 1) * (len(w) + 1) * width > BATCH):
            yield batch
            batch = []
        batch.append(w)
    if batch:
        yield batch


def fit_one(seen: dict[str, float], pieces: Pieces, rounds: int = 3) -> np.ndarray:
    """A probability for each piece from the counts of a language's words, by expectation maximisation from equal ones."""
    n = len(pieces.pieces)
    model = PieceModel(["one"], pieces, np.full((n, 1), 1 / max(1, n)))
    for _ in range(rounds):
        uses = sum(model.expected(w, np.array([seen[x] for x in w]), 0) for w in _by_length(list(seen)))
        model.p[:, 0] = (uses + 0.01) / (np.sum(uses) + 0.01 * n)
    return model.p[:, 0]


def training_words(train: DataFrame, text_col: str, lang_col: str, max_texts: int = MAX_TRAINING_TEXTS) -> DataFrame:
    """Rows (lang, word, n): counts of the words of about `max_texts` texts of each language, chosen by a hash of the text."""
    rows = train.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    # a row for each language, of which the models that are sent out have a column each
    share = F.broadcast(rows.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(max_texts)) / F.count(F.lit(1))).alias("share")))
    chosen = rows.join(share, "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("share") * F.lit(1 << 30)).select("lang", "text")

    def count(parts):
        for part in parts:
            found: dict[str, Counter] = {}
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found.setdefault(lang, Counter()).update(words_of(text))
            rows = [(k, w, n) for k, c in found.items() for w, n in c.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])

    return chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(words: DataFrame, pieces: list[str], rounds: int = 3) -> PieceModel:
    """Models of the languages in `words` (lang, word, n); each language is fitted by one task from its bounded sample."""
    shared = words.sparkSession.sparkContext.broadcast(pieces)
    key = uuid.uuid4().hex

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("word")
        table = kept(key, lambda: Pieces(shared.value))
        p = fit_one(dict(zip(rows.column("word").to_pylist(), map(float, rows.column("n").to_pylist()))), table, rounds)
        return pa.table({"lang": pa.array([rows.column("lang")[0].as_py()], pa.string()), "p": pa.array([p.tobytes()], pa.binary())})

    # as many parts as the session asks for: few rows, but much work for each language
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = {r.lang: np.frombuffer(bytes(r.p)) for r in words.repartition(parts, "lang").groupBy("lang").applyInArrow(one, "lang string, p binary").toLocalIterator()}
    languages = sorted(found)
    return PieceModel(languages, Pieces(pieces), np.stack([found[x] for x in languages], axis=1) if languages else np.zeros((len(pieces), 0)))


class Scorer:
    """Scores texts; remembers the words' log probabilities."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.place: dict[str, int] = {}
        self.chars = 0
        self.table = np.zeros((0, model.width))

    def _learn(self, new: list[str]) -> None:
        blocks, n = [self.table], len(self.table)
        for words in _by_length(new, self.model.width):
            self.place |= zip(words, range(n, n + len(words)))
            blocks.append(self.model.forward(words))
            n += len(words)
        self.chars += sum(map(len, new))
        self.table = np.concatenate(blocks)

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [words_of(t) if t else [] for t in texts]
        if not self.model.width:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        new = set().union(*found).difference(self.place)
        if (len(self.place) + len(new)) * self.model.width > REMEMBERED or self.chars + sum(map(len, new)) > REMEMBERED_CHARS:
            self.place, self.chars, self.table = {}, 0, self.table[:0]
            new = set().union(*found)
        self._learn(sorted(new))
        get = self.place.__getitem__
        names, scores = [], []
        for words in found:
            if not words:
                names.append(UNDETERMINED)
                scores.append(0.0)
                continue
            total = self.table[np.fromiter(map(get, words), np.int64, len(words))].sum(axis=0)
            best = int(total.argmax())
            names.append(self.model.languages[best])
            scores.append(1 / float(np.exp(np.clip(total - total[best], -700, 0)).sum()))
        return names, scores


def identify(df: DataFrame, train: DataFrame, vocabulary_path: str, text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None, max_training_texts: int = MAX_TRAINING_TEXTS) -> DataFrame:
    """`df` with lang_pred and score (the posterior, 0 to 1), by models of `train`.

    Fitting sees a bounded sample of texts, `max_training_texts` of each language or about so; scoring is a map over
    partitions. The models sent to the executors have a number for each piece of the vocabulary and each language.
    """
    model = fit(training_words(train, text_col, lang_col, max_training_texts), read_pieces(vocabulary_path))
    shared = df.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def make():
        scorer = kept(key, lambda: Scorer(shared.value))

        def work(texts: pa.Array) -> dict:
            names, scores = scorer.score(texts.to_pylist())
            return {"lang_pred": names, "score": scores}

        return work

    return map_texts(df, text_col, make, T.StructType().add("lang_pred", T.StringType()).add("score", T.DoubleType()), df.columns if carry is None else carry)
