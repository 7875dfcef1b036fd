"""Language identification with interpolated Kneser-Ney models over the characters of words.

Every language has a model of order four: a character of a word is predicted from the three before it,
the word's edges included. A model is three kinds of numbers in arrays sorted by n-gram hash: discounted
probabilities of n-grams, back-off weights of contexts. A text's language is the one with the lowest
cross-entropy per character; it is rejected where that entropy lies above what known texts of the
language and of like length reach.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footstats.llm.common import map_rows

ORDER = 4
#: Bound of the labelled sample: rows for each language, taken by the hash of their id.
SAMPLE_ROWS = 3000
#: Words (in number) that a task remembers with their scores, and their longest length.
MEMO_WORDS, MEMO_LENGTH = 300_000, 64
#: Words of the texts that are scored together; characters of the words that are looked up together.
BLOCK_WORDS, BLOCK_CHARS = 50_000, 400_000
#: Upper ends of the classes of length, in characters, that have their own limit of entropy.
LENGTH_CLASSES = (40, 120, 400, 1500)
#: How far above the highest entropy of known texts a text may lie.
SLACK = 1.6

_WORD = re.compile(r"[^\W\d_]+")
_EDGE = 0  # code of a word's start and end
_SHIFT = np.uint64(21)  # bits of a code point


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    # Number signs such as the squared or the half are word characters, too, but no letters.
    return [w for word in found for w in "".join(c if c.isalpha() else " " for c in word).split()]


def batches_of(words: list[str]) -> Iterator[list[str]]:
    """Slices of ``words`` with about ``BLOCK_CHARS`` characters each."""
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) // BLOCK_CHARS
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(words)]
    return (words[a:b] for a, b in zip(cuts, cuts[1:]) if a < b)


def gram_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the words with the three before them: (codes[n, 4], characters per word).

    A word's end is predicted like a character; before its start stand edges.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    pad = "\0" * (ORDER - 1)
    line = np.frombuffer((pad + ("\0" + pad).join(words) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes + ORDER - 1)
    last = np.ones(len(line), bool)  # not the padding before a word
    starts = ends - sizes - (ORDER - 1)
    for k in range(ORDER - 1):
        last[starts + k] = False
    at = np.flatnonzero(last)
    return np.stack([line[at - k] for k in range(ORDER - 1, -1, -1)], axis=1), sizes


def hashed(codes: np.ndarray) -> np.ndarray:
    """64-bit hash of each row of character codes; rows of up to three characters keep all their bits."""
    h = np.zeros(len(codes), np.uint64)
    for column in codes.T:
        h = (h << _SHIFT) ^ (h >> np.uint64(43)) * np.uint64(0x9E3779B97F4A7C15) ^ column.astype(np.uint64)
    return h


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted if len(keys) else np.zeros(len(wanted), bool)


@dataclass
class Models:
    """All languages: for each order sorted n-gram hashes with probabilities, sorted context hashes with weights."""

    langs: list[str]
    floor: np.ndarray  # probability of any character, by language
    grams: list[tuple[np.ndarray, np.ndarray]]  # hashes, discounted probability [n, languages]
    contexts: list[tuple[np.ndarray, np.ndarray]]  # hashes, back-off weight [n, languages]
    limits: np.ndarray | None = None  # highest entropy accepted [languages, length classes]
    sharpness: float = 1.0

    def log2(self, codes: np.ndarray) -> np.ndarray:
        """log2 probability of each character under each language."""
        p = np.repeat(self.floor[None, :], len(codes), axis=0)
        for k in range(1, ORDER + 1):
            keys, weights = self.contexts[k - 1]
            at, hit = _lookup(keys, hashed(codes[:, ORDER - k : ORDER - 1]))
            if len(keys):
                p *= np.where(hit[:, None], weights[at], 1.0)
            keys, probabilities = self.grams[k - 1]
            at, hit = _lookup(keys, hashed(codes[:, ORDER - k :]))
            if len(keys):
                p += np.where(hit[:, None], probabilities[at], 0.0)
        return np.log2(p)

    def word_scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log2 by word and language, characters by word)."""
        codes, sizes = gram_codes(words)
        return np.add.reduceat(self.log2(codes), np.concatenate([[0], np.cumsum(sizes)[:-1]])), sizes


def kneser_ney(grams: np.ndarray, counts: np.ndarray) -> tuple[list, list, float]:
    """One language: ([{gram: discounted probability}], [{context: weight}], floor) by order, from counts of order four.

    Below the full order a gram counts the different characters seen before it; grams that begin at a
    word's start keep their counts, as nothing stands before them.
    """
    levels = [(grams, counts.astype(float))]
    for k in range(ORDER - 1, 0, -1):
        longer, n = levels[0]
        shorter, back = np.unique(longer[:, 1:], axis=0, return_inverse=True)
        back = back.ravel()
        kinds = np.bincount(back, minlength=len(shorter)).astype(float)
        if k > 1:
            edge = shorter[:, 0] == _EDGE
            kinds[edge] = np.bincount(back, weights=n, minlength=len(shorter))[edge]
        levels.insert(0, (shorter, kinds))
    probabilities, contexts = [], []
    floor = 1.0 / (len(levels[0][0]) + 1)
    for rows, n in levels:
        once, twice = (n == 1).sum(), (n == 2).sum()
        discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once + twice else 0.5
        heads, back = np.unique(rows[:, :-1], axis=0, return_inverse=True) if rows.shape[1] > 1 else (rows[:1, :0], np.zeros(len(rows), int))
        back = back.ravel()
        total = np.bincount(back, weights=n)
        kept = np.maximum(n - discount, 0.0)
        probabilities.append((hashed(rows), kept / total[back]))
        contexts.append((hashed(heads), 1.0 - np.bincount(back, weights=kept) / total))
    return probabilities, contexts, floor


def merged(langs: list[str], parts: list[tuple[list, list, float]]) -> Models:
    """The models of all languages over common sorted hash arrays; a language without an entry keeps its default."""

    def together(tables: list[tuple[np.ndarray, np.ndarray]], default: float):
        keys = np.unique(np.concatenate([k for k, _ in tables]))
        values = np.full((len(keys), len(tables)), default)
        for i, (k, v) in enumerate(tables):
            values[np.searchsorted(keys, k), i] = v
        return keys, values

    return Models(
        langs, np.array([f for _, _, f in parts]),
        [together([p[0][k] for p in parts], 0.0) for k in range(ORDER)],
        [together([p[1][k] for p in parts], 1.0) for k in range(ORDER)],
    )


class WordScores:
    """Scores of words under ``models``; those of short words are kept for later texts."""

    def __init__(self, models: Models):
        self.models = models
        self.rows: dict[str, int] = {}
        self.scores = np.empty((1024, len(models.langs) + 1))

    def entropies(self, texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, int] | None]:
        """(bits per character by language, characters) of each text, None where it has no word."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(words_of(text) if self.models.langs else [])
            size += len(held[-1])
            if size >= BLOCK_WORDS:
                yield from self._block(held)
                held, size = [], 0
        yield from self._block(held)

    def _block(self, texts: list[list[str]]) -> Iterator[tuple[np.ndarray, int] | None]:
        distinct = dict.fromkeys(chain.from_iterable(texts))
        new = [w for w in distinct if w not in self.rows]
        if len(self.rows) + len(new) > MEMO_WORDS:
            self.rows.clear()
            new = list(distinct)
        end = len(self.rows) + len(new)
        if end > len(self.scores):
            self.scores = np.concatenate([self.scores, np.empty((max(end, len(self.scores)), self.scores.shape[1]))])
        for slice_ in batches_of(new):
            first = len(self.rows)
            bits, sizes = self.models.word_scores(slice_)
            self.scores[first : first + len(slice_)] = np.column_stack([bits, sizes])
            self.rows.update(zip(slice_, range(first, first + len(slice_))))
        for words in texts:
            if words:
                total = self.scores[np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))].sum(axis=0)
                yield -total[:-1] / total[-1], int(total[-1])
            else:
                yield None
        if any(len(w) > MEMO_LENGTH for w in new):
            self.rows = {}  # very long words aren't kept


def calibrate(models: Models, known: list[tuple[str, list[float], int]]) -> None:
    """Sets the limits of entropy and the sharpness of the score.

    ``known``: language, bits per character under each model and characters of texts that the counts don't hold.
    """
    limits = np.zeros((len(models.langs), len(LENGTH_CLASSES) + 1))
    index = {lang: i for i, lang in enumerate(models.langs)}
    margins, right = [], []
    for lang, bits, n in known:
        bits = np.array(bits)
        best = int(bits.argmin())
        if best == index[lang]:
            limits[best, length_class(n)] = max(limits[best, length_class(n)], bits[best])
        margins.append(bits - bits.min())
        right.append(index[lang])
    # Shorter texts vary more: a class allows at least what longer ones do; one without texts takes the highest.
    for row in limits:
        row[:] = np.maximum.accumulate(row[::-1])[::-1]
        row[row == 0] = row.max() or np.log2(1.0 / models.floor.min())
    models.limits = limits * SLACK
    if margins:
        m, y = np.array(margins), np.array(right)
        grid = [0.5, 1, 2, 4, 8, 16]
        loss = [np.mean(-np.log(np.maximum(_posterior(m, s)[np.arange(len(y)), y], 1e-9))) for s in grid]
        models.sharpness = float(grid[int(np.argmin(loss))])


def length_class(n: int) -> int:
    return int(np.searchsorted(LENGTH_CLASSES, n))


def _posterior(margins: np.ndarray, sharpness: float) -> np.ndarray:
    p = np.exp2(-sharpness * margins)
    return p / p.sum(axis=-1, keepdims=True)


def learn_languages(
    docs: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> Models:
    """Models from the labelled rows of ``docs`` that ``learn`` marks.

    At most ``sample_rows`` rows of each language are used, those with the smallest hash of their id; one in
    five of them only calibrates. The counting is a Spark job; the driver receives the n-grams of the bounded
    sample, each once with its count: all of them, as the discounts rest on the rare ones.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
        F.xxhash64(F.col(id_col).cast("string")).alias("h"),
    )
    sizes = rows.groupBy("lang").count().collect()
    if not sizes:
        return Models([], np.zeros(0), [], [])
    # The share of the hash range that holds the wanted number of rows.
    shares = [x for r in sizes for x in (F.lit(r["lang"]), F.lit(int(min(1.0, sample_rows / r["count"]) * 1_000_000)))]
    sample = rows.where(F.pmod("h", F.lit(1_000_000)) < F.element_at(F.create_map(*shares), F.col("lang")))
    sample = sample.select("lang", "text", (F.pmod(F.shiftright("h", 24), F.lit(5)) == 0).alias("part"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                words.setdefault(lang, Counter()).update(words_of(text))
        for lang, found in words.items():
            if found:
                codes, sizes = gram_codes(list(found))
                weight = np.repeat(np.fromiter(found.values(), np.int64, len(found)), sizes)
                _, at, back = np.unique(hashed(codes), return_index=True, return_inverse=True)
                yield pd.DataFrame({
                    "lang": lang, "gram": list(codes[at].astype(np.int32)),
                    "n": np.bincount(back, weights=weight).astype(np.int64),
                })

    counts = (
        sample.where("NOT part").select("lang", "text").mapInPandas(count, "lang string, gram array<int>, n long")
        .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    )
    known = sorted(counts["lang"].unique())
    if not known:
        return Models([], np.zeros(0), [], [])
    parts = [kneser_ney(np.array(g["gram"].tolist(), np.uint32), g["n"].to_numpy()) for _, g in counts.groupby("lang", sort=True)]
    models = merged(known, parts)
    shared = docs.sparkSession.sparkContext.broadcast(vars(models))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = WordScores(received(shared.value))
        for batch in batches:
            out = [(lang, *x) for lang, x in zip(batch["lang"], scores.entropies(batch["text"])) if x]
            yield pd.DataFrame(out, columns=["lang", "bits", "n"])

    held = sample.where("part").where(F.col("lang").isin(known)).select("lang", "text")
    calibrate(models, [tuple(r) for r in held.mapInPandas(measure, "lang string, bits array<double>, n long").collect()])
    return models


def received(fields: dict) -> Models:
    """Models from what was broadcast: plain values, as a worker may be unable to import this package."""
    models = Models.__new__(Models)
    vars(models).update(fields)
    return models


def identify_languages(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``lang_pred``, ``score`` (0 to 1), ``bits`` (per character) and ``accepted``.

    Text that is null or has no letter: ``und``, score 0, not accepted. Equal entropies: the language that
    sorts first. Nothing but the text decides; repeated rows are scored alike, other columns aren't read.
    A map over rows with the models (bounded by the labelled sample) broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(models))

    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = received(shared.value)
        scores = WordScores(known)
        for batch in batches:
            out = []
            for found in scores.entropies(batch["text"]):
                if found is None:
                    out.append(("und", 0.0, None, False))
                    continue
                bits, n = found
                best = int(bits.argmin())
                score = float(_posterior(bits - bits[best], known.sharpness)[best])
                out.append((known.langs[best], min(1.0, score), float(bits[best]), bool(bits[best] <= known.limits[best, length_class(n)])))
            made = pd.DataFrame(out, columns=["lang_pred", "score", "bits", "accepted"])
            made.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield made

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(
        narrow, predict, "lang_pred string, score double, bits double, accepted boolean"
    ).withColumnRenamed("doc_id", id_col)


def is_accepted(models: Models, spark: SparkSession):
    """A column function: whether a text is in one of the known languages, for filters that keep all columns."""
    shared = spark.sparkContext.broadcast(vars(models))

    @F.pandas_udf("boolean")
    def accepted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = received(shared.value)
        scores = WordScores(known)
        for batch in texts:
            yield pd.Series([
                x is not None and bool(x[0].min() <= known.limits[int(x[0].argmin()), length_class(x[1])]) for x in scores.entropies(batch)
            ], dtype=bool)

    return accepted
