"""Document probability over all segmentations into the pieces of an existing subword vocabulary.

A word (with the mark of its start) is a lattice: every way to cut it into vocabulary pieces is a path, a
path's probability is the product of its pieces' weights, and the word's is the sum over paths, found by a
forward recursion in log space. The weights begin with the vocabulary's own scores (the rank of a piece)
and are fitted to the training texts by expectation-maximisation. A document is its words and one end.

Words differ without bound, so they are counted by Spark. The most frequent ones (a fixed number) are
broadcast; the others of a document meet their counts and probabilities in a join on the word.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from math import exp, log1p

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footstats.llm.common import cut, map_rows

#: Words that are broadcast with their counts, and words that a task counts before it hands them on.
HOT_WORDS, PARTIAL_WORDS = 100_000, 200_000
#: Expected count that every piece has before the training texts add theirs.
PRIOR = 0.1
WORD_START = "▁"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


class Lattice:
    """Pieces with natural-log weights; characters that are no piece fall back to their bytes."""

    def __init__(self, pieces: list[str], weights: np.ndarray):
        """``weights``: the pieces, then the 256 bytes, then the end of a document."""
        self.size = len(pieces)
        self.weights = weights.tolist()
        # Beginnings of pieces that are no piece themselves have number -1: a search goes on there.
        self.numbers = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | {p: i for i, p in enumerate(pieces)}

    @property
    def end(self) -> float:
        return self.weights[-1]

    def edges(self, word: str) -> list[list[tuple[int, float, int]]]:
        """From each position of a word: (end position, weight, number of the piece or -1 for a character's bytes)."""
        out, numbers, weights, size = [], self.numbers, self.weights, len(word)
        for i in range(size):
            here = []
            j = i + 1
            found = numbers.get(word[i])
            if found is None or found < 0:
                here.append((j, sum(weights[n] for n in self.byte_numbers(word[i])), -1))
            else:
                here.append((j, weights[found], found))
            while found is not None and j < size:
                j += 1
                found = numbers.get(word[i:j])
                if found is not None and found >= 0:
                    here.append((j, weights[found], found))
            out.append(here)
        return out

    def byte_numbers(self, character: str) -> list[int]:
        return [self.size + b for b in character.encode("utf-8", "surrogatepass")]

    def forward(self, all_edges: list[list[tuple[int, float, int]]]) -> list[float]:
        """Log probability of reaching each position over all ways."""
        reach: list[float | None] = [0.0] + [None] * len(all_edges)
        for i, edges in enumerate(all_edges):
            at = reach[i]
            for j, w, _ in edges:
                a, b = reach[j], at + w
                if a is None:
                    reach[j] = b
                elif a >= b:
                    reach[j] = a + log1p(exp(b - a))
                else:
                    reach[j] = b + log1p(exp(a - b))
        return reach

    def log_probability(self, word: str) -> float:
        """Natural log of the probability of a word, over all its segmentations."""
        return self.forward(self.edges(WORD_START + word))[-1]

    def expect(self, word: str, times: float, counts: list[float]) -> None:
        """Adds the expected uses of each piece in ``times`` occurrences of a word."""
        word = WORD_START + word
        all_edges = self.edges(word)
        reach = self.forward(all_edges)
        total, back = reach[-1], [0.0] * (len(word) + 1)
        for i in range(len(word) - 1, -1, -1):
            edges = all_edges[i]
            if len(edges) == 1:
                j, w, _ = edges[0]
                rest = back[j] + w
            else:
                rest = None
                for j, w, _ in edges:
                    b = back[j] + w
                    if rest is None:
                        rest = b
                    elif rest >= b:
                        rest += log1p(exp(b - rest))
                    else:
                        rest = b + log1p(exp(rest - b))
            back[i] = rest
            lead = reach[i] - total
            for j, w, n in edges:
                share = times * exp(lead + w + back[j])
                if n >= 0:
                    counts[n] += share
                else:
                    for n in self.byte_numbers(word[i]):
                        counts[n] += share


def vocabulary(model_file: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a vocabulary file and first weights from its scores: a piece of rank r weighs 1 / (r + 2)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    usable = [
        i for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)) and model.get_score(i) > -1e8
    ]
    pieces = [model.id_to_piece(i) for i in usable]
    ranks = -np.array([model.get_score(i) for i in usable])
    weight = np.concatenate([1.0 / (ranks - ranks.min() + 2.0), np.full(257, 1.0 / (len(pieces) + 2.0))])
    return pieces, np.log(weight / weight.sum())


def count_words(docs: DataFrame, learn: Column, text_col: str = "text") -> DataFrame:
    """(word, c): every word of ``docs`` with its number in the rows that ``learn`` marks (0 if only elsewhere)."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def flush() -> pd.DataFrame:
            known = found[True]
            known.update(dict.fromkeys(found[False].keys() - known.keys(), 0))
            out = pd.DataFrame({"word": [w.decode("utf-8", "replace") for w in known], "c": list(known.values())}, dtype=object)
            known.clear()
            found[False].clear()
            return out

        for batch in batches:
            for text, learned in zip(batch["text"], batch["learned"]):
                found[bool(learned)].update(words_of(text))
                if len(found[True]) + len(found[False]) > PARTIAL_WORDS:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(text_col).alias("text"), learn.alias("learned"))
    return rows.mapInPandas(count, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def fit_weights(counts: DataFrame, documents: int, pieces: list[str], weights: np.ndarray, rounds: int = 1) -> np.ndarray:
    """Weights after ``rounds`` of expectation-maximisation over the counted words and the documents' ends.

    Each round is a job over the distinct words; the driver gets one number for each piece in use.
    """
    for _ in range(rounds):
        shared = counts.sparkSession.sparkContext.broadcast((pieces, weights))

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            lattice = Lattice(*shared.value)
            counted = [0.0] * len(weights)
            for batch in batches:
                for word, c in zip(batch["word"], batch["c"]):
                    lattice.expect(word, c, counted)
            expected = np.array(counted)
            used = np.flatnonzero(expected)
            yield pd.DataFrame({"piece": used, "n": expected[used]})

        got = counts.where("c > 0").mapInPandas(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        total = np.full(len(weights), PRIOR)
        for r in got:
            total[r["piece"]] += r["n"]
        total[-1] += documents
        weights = np.log(total / total.sum())
    return weights


def score_documents(
    docs: DataFrame, learn: Column, model_file: str, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``.

    Tokens are the words and one end. ``base_score``: smoothed unigram log10 probability; ``score``: log10
    probability over all segmentations. Null or empty text: the end alone. Without training rows all counts
    are 0 and the vocabulary's own weights stand. Rows with equal ids are scored one by one; other columns
    aren't read. The words beyond the ``HOT_WORDS`` most frequent ones are joined, so none is left out.
    """
    spark = docs.sparkSession
    learned = docs.where(learn)
    counts = cut(count_words(docs, learn, text_col))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = learned.count()
    total, distinct = sums["c"] + ends, sums["v"] + (ends > 0)
    scale = total + 0.5 * (distinct + 1)

    pieces, first = vocabulary(model_file)
    weights = fit_weights(counts, ends, pieces, first, rounds) if total else first
    fitted = spark.sparkContext.broadcast((pieces, weights))
    end_log10 = weights[-1] / math.log(10)

    def segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lattice = Lattice(*fitted.value)
        for batch in batches:
            batch["lp"] = [lattice.log_probability(w) / math.log(10) for w in batch["word"]]
            yield batch

    scored = cut(counts.mapInPandas(segment, "word string, c long, lp double"))
    top = scored.orderBy(F.desc("c"), "word").limit(HOT_WORDS).toPandas()
    hot = spark.sparkContext.broadcast({
        word.encode("utf-8", "surrogatepass"): (math.log10((n + 0.5) / scale), lp, n > 0)
        for word, n, lp in zip(top["word"], top["c"], top["lp"])
    })

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, row = hot.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                base = math.log10((ends + 0.5) / scale)
                lp, n_known, n, rest = end_log10, int(ends > 0), 1, []
                for word, times in Counter(words_of(text)).items():
                    n += times
                    got = known.get(word)
                    if got is None:
                        rest.append((doc_id, row, word.decode("utf-8", "replace"), times, 0, 0, 0.0, 0.0))
                    else:
                        base += times * got[0]
                        lp += times * got[1]
                        n_known += times * got[2]
                # The document's own row joins nothing: no word holds a line end.
                out.append((doc_id, row, f"\n{row}", 0, n, n_known, base, lp))
                out += rest
                row += 1
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names, dtype=object)
                    out = []
            yield pd.DataFrame(out, columns=names, dtype=object)

    names = ["doc_id", "row", "word", "times", "n_tokens", "n_known", "base", "lp_hot"]
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = map_rows(
        narrow, meet, "row long, word string, times long, n_tokens long, n_known long, base double, lp_hot double"
    )
    times, c = F.col("times"), F.coalesce("c", F.lit(0))
    return (
        words.join(scored, "word", "left").groupBy("row", "doc_id").agg(
            F.sum("n_tokens").alias("n_tokens"),
            F.sum(F.col("n_known") + F.when(c > 0, times).otherwise(0)).alias("n_known"),
            F.lit(int(total)).cast("long").alias("train_tokens"),
            F.sum(F.col("base") + times * F.log10((c + 0.5) / F.lit(float(scale)))).alias("base_score"),
            F.sum(F.col("lp_hot") + times * F.coalesce("lp", F.lit(0.0))).alias("score"),
        ).drop("row").withColumnRenamed("doc_id", id_col)
    )
