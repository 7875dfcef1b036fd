"""Toxicity by compression distance: windows that a toxic dictionary shortens more than an ordinary one does.

Two zstandard dictionaries are trained on labelled texts, one on ordinary text, one on what is peculiar to
toxic text: its byte sequences that toxic texts share and ordinary ones hardly hold. A window of a text is compressed
with the ordinary dictionary, and with the ordinary one extended by the toxic one; the bytes saved are its
distance. Means and peaks of the distances over a whole text give the score, calibrated on labelled texts
that trained neither dictionary.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footstats.llm.common import cut, map_rows

#: Bound of the labelled sample: rows of each label, taken by the hash of their id; their texts are read whole.
SAMPLE_ROWS = 6000
#: Sizes of the dictionaries, of windows and of their overlap, in bytes; length of a peculiar sequence.
TOXIC_BYTES, ORDINARY_BYTES, WINDOW, OVERLAP, SEQUENCE = 1536, 8192, 64, 12, 6
#: A sequence is peculiar if this many standard deviations more toxic texts hold it than expected, and if
#: ordinary texts hold it at most this often against toxic ones.
EXCESS, FOREIGN = 7.0, 0.2
#: Sequences that a task holds before it hands on their counts.
TALLY = 4_000_000
#: Limits of bytes saved from which windows count as hit.
HITS = (2, 4, 6)


def normal_form(text: str | None) -> bytes:
    return (" " + " ".join((text or "").lower().split()) + " ").encode("utf-8", "surrogatepass")


def windows(line: bytes) -> list[bytes]:
    step = WINDOW - OVERLAP
    return [line[i : i + WINDOW] for i in range(0, max(1, len(line) - OVERLAP), step)]


def sequences(line: bytes) -> np.ndarray:
    """Every run of ``SEQUENCE`` bytes as a number."""
    b = np.frombuffer(line, np.uint8).astype(np.uint64)
    n = max(0, len(b) - SEQUENCE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(SEQUENCE):
        out = (out << np.uint64(8)) | b[k : k + n]
    return out


def probes(line: bytes, number: int = 6) -> list[int]:
    """Smallest word-triple hashes of a line, one of each mixing."""
    words = line.split()
    triples = [zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))]
    mixed = np.array(triples, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    least = [(mixed ^ (mixed >> np.uint64(29 + k)) * np.uint64(2 * k + 0xC2B2AE3D27D4EB4F)).min() for k in range(number)]
    return np.array(least, np.uint64).view(np.int64).tolist()


def unlike(probed: list[list[int]]) -> list[int]:
    """Places of lines that aren't near copies of earlier ones, which share half of their ``probes``."""
    seen: set[tuple[int, int]] = set()
    out = []
    for at, found in enumerate(probed):
        keys = list(enumerate(found))
        if 2 * sum(key in seen for key in keys) < len(keys):
            out.append(at)
        seen.update(keys)
    return out


def counted(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct sequences, lines that hold each) of each line's distinct sequences."""
    return np.unique(np.concatenate(lines), return_counts=True) if lines else (np.zeros(0, np.uint64), np.zeros(0, int))


def peculiar_sequences(rows: DataFrame, kept: set[int], toxic: int, ordinary: int) -> np.ndarray:
    """Sequences that are in far more toxic texts than chance explains: sorted.

    Of ``rows`` (h, text, y) those with ``h`` in ``kept`` count, ``toxic`` and ``ordinary`` of them. Tasks count
    the sequences of whole texts; only what is peculiar comes back.
    """
    shared = rows.sparkSession.sparkContext.broadcast(kept)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {0: [], 1: []}

        def handed() -> Iterator[pd.DataFrame]:
            for y, lines in held.items():
                found, n = counted(lines)
                yield pd.DataFrame({"code": found.astype(np.int64), "n": n * (y == 1), "other": n * (y == 0)})
                lines.clear()

        for batch in batches:
            for h, text, y in zip(batch["h"], batch["text"], batch["y"]):
                if h in shared.value:
                    held[y].append(np.unique(sequences(normal_form(text))))
                    if sum(map(len, held[0])) + sum(map(len, held[1])) >= TALLY:
                        yield from handed()
        yield from handed()

    counts = rows.mapInPandas(tally, "code long, n long, other long").groupBy("code").agg(F.sum("n").alias("n"), F.sum("other").alias("other"))
    expected = toxic * (F.col("n") + F.col("other")) / (toxic + ordinary)
    found = counts.where("n >= 3").where(
        (F.col("n") - expected >= EXCESS * F.sqrt(expected)) & (F.col("other") * toxic <= FOREIGN * F.col("n") * ordinary)
    )
    return np.sort(np.array([r["code"] for r in found.select("code").collect()], np.uint64))


def stretches(line: bytes, peculiar: np.ndarray) -> bytes:
    """The parts of ``line`` made of ``peculiar`` sequences, end to end."""
    codes = sequences(line)
    if not len(codes) or not len(peculiar):
        return b""
    hit = peculiar[np.minimum(np.searchsorted(peculiar, codes), len(peculiar) - 1)] == codes
    covered = np.zeros(len(line), bool)
    for k in range(SEQUENCE):
        covered[k : k + len(hit)] |= hit
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
    return b"".join(line[a:b] for a, b in zip(edges[::2], edges[1::2]))


def trained(size: int, samples: list[bytes], segment: int) -> bytes:
    """Content of a dictionary; of too few samples, the samples themselves."""
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=6, steps=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass
class ToxicityModel:
    ordinary: bytes
    toxic: bytes
    weights: list[float] | None = None  # of the features, the constant last

    def compressors(self):
        def of(content: bytes):
            params = zstandard.ZstdCompressionParameters.from_level(
                3, dict_size=len(content), source_size=WINDOW, min_match=4, strategy=zstandard.STRATEGY_LAZY,
                write_content_size=0, write_dict_id=0,
            )
            return zstandard.ZstdCompressor(
                dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=params
            )

        # The ordinary part stands nearest to the window in both, so that only the toxic part tells them apart.
        return of(b"\0" * len(self.toxic) + self.ordinary), of(self.toxic + self.ordinary)

    def features(self, text: str | None, plain, toxic) -> list[float]:
        """Mean distance, shares of windows from each limit of distance on, and the largest distance."""
        saved = np.array([len(plain.compress(w)) - len(toxic.compress(w)) for w in windows(normal_form(text))], float)
        return [float(saved.mean()), *(float((saved >= h).mean()) for h in HITS), float(min(saved.max(), 12.0) / 4)]

    def score(self, features: list[float]) -> float:
        z = float(np.dot(self.weights, [*features, 1.0]))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression (Newton steps), the constant last."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn_toxicity(
    docs: DataFrame, labels: DataFrame, learn: Column, sample_rows: int = SAMPLE_ROWS,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
) -> ToxicityModel | None:
    """Dictionaries and calibration from the labelled rows that ``learn`` (over the id) marks.

    At most ``sample_rows`` ids of each label are used, those with the smallest hash, with their whole texts;
    one in three calibrates and trains no dictionary; of near copies among the others one trains, so that no sequence is peculiar
    for its copies alone; of several texts of an id the least. An id with both labels counts as toxic. None if either
    label is missing. Sequences are counted and calibration texts scored in all tasks; each dictionary is then
    trained in one task from this bounded number of texts.
    """
    spark = docs.sparkSession
    known = labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64(F.col("id").cast("string")))
    ids = [known.where(F.col("y") == y).orderBy("h", "id").limit(sample_rows) for y in (0, 1)]
    # At most 2 * sample_rows ids: a bounded broadcast.
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    sample = sample.join(F.broadcast(ids[0].unionByName(ids[1])), "id").select(
        "id", "h", "text", "y", (F.pmod(F.shiftright("h", 20), F.lit(3)) == 0).alias("part")
    )
    # Written, as several steps read it and must see the same text of an id.
    rows = cut(sample.where("NOT part").groupBy("id", "h", "y").agg(F.min("text").alias("text")))

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "h": batch["h"], "y": batch["y"], "p": [probes(normal_form(t)) for t in batch["text"]]})

    kind = rows.schema["id"].dataType.simpleString()
    probed = sorted(rows.mapInPandas(probe, f"id {kind}, h long, y int, p array<long>").collect(), key=lambda r: r["id"])
    lines = {y: [r for r in probed if r["y"] == y] for y in (0, 1)}
    kept = {y: {lines[y][at]["h"] for at in unlike([r["p"] for r in lines[y]])} for y in (0, 1)}
    if not kept[0] or not kept[1]:
        return None
    peculiar = spark.sparkContext.broadcast(peculiar_sequences(rows, kept[0] | kept[1], len(kept[1]), len(kept[0])))
    both = spark.sparkContext.broadcast(kept[0] | kept[1])

    def samples(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[[h in both.value for h in batch["h"]]]
            texts = [normal_form(t) for t in batch["text"]]
            parts = [stretches(x, peculiar.value) if y else x for x, y in zip(texts, batch["y"])]
            yield pd.DataFrame({"id": batch["id"], "y": batch["y"], "part": parts})

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        y, parts = int(group["y"].iloc[0]), group["part"].map(bytes).tolist()
        return pd.DataFrame({"y": [y], "content": [trained(TOXIC_BYTES, parts, 16) if y else trained(ORDINARY_BYTES, parts, 64)]})

    parts = rows.mapInPandas(samples, f"id {kind}, y int, part binary")
    built = {r["y"]: bytes(r["content"]) for r in parts.groupBy("y").applyInPandas(build, "y int, content binary").collect()}
    model = ToxicityModel(built[0], built[1])
    shared = spark.sparkContext.broadcast(vars(model))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = ToxicityModel(**shared.value)
        pair = known.compressors()
        for batch in batches:
            yield pd.DataFrame({"y": batch["y"], "x": [known.features(t, *pair) for t in batch["text"]]})

    got = sample.where("part").select("y", "text").mapInPandas(measure, "y int, x array<double>").collect()
    y = np.array([r["y"] for r in got], float)
    if not len(got) or y.min() == y.max():
        model.weights = [1.0] + [0.0] * (len(HITS) + 1) + [-1.0]
    else:
        model.weights = logistic(np.array([r["x"] for r in got]), y).tolist()
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``score`` from 0 to 1, higher where toxic text is likelier.

    The whole text is read, in windows; null and empty texts are scored as one empty window. Without a model
    (labels missing) every score is 0. Repeated rows get equal scores; other columns aren't read. A map over
    rows with two dictionaries of fixed size broadcast.
    """
    # Plain values, as a worker may be unable to import this package.
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value and ToxicityModel(**shared.value)
        pair = known.compressors() if known else None
        for batch in batches:
            yield pd.DataFrame({
                "doc_id": batch["doc_id"],
                "score": [known.score(known.features(t, *pair)) if known else 0.0 for t in batch["text"]],
            })

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(narrow, score, "score double").withColumnRenamed("doc_id", id_col)
