"""Personal data by weak supervision: labelers vote on candidate spans, their reliability is estimated, a classifier decides.

Certain kinds (e-mail, IP address, card, phone) follow fixed patterns and are always reported. Beyond them,
broad patterns propose candidates (secrets, local phone numbers, national and bank numbers). Regex, gazetteer
and context labelers vote for or against each candidate or abstain. Expectation-maximisation over the counts
of vote patterns estimates how often each labeler votes how for personal and for other spans; a logistic
regression trained on its posteriors is the final classifier. Proposing, voting, counting and classifying run on
DataFrame functions; what the driver iterates is the table of vote patterns, whose size is bounded by the number of
kinds and labelers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds with fixed patterns, in the order of the output, and kinds that the classifier may add.
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("bank", "local_phone", "national", "secret")

# The base patterns. Possessive repeats and a start at the beginning of a run (or where the last match
# ended) find the same leftmost matches in one pass, without deep recursion on very long runs.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Broad patterns of candidates: bank number; local phone; national number; secret.
_CANDIDATE = (
    r"(?<![A-Za-z0-9])(?:[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}|\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:[A-Za-z]{2,8}[_-])?[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])"
)
#: Gazetteer: words that name personal data where they stand right before it.
NAMES = (
    "account", "api", "bank", "call", "fax", "iban", "id", "key", "mobile", "passport", "password", "passwd", "phone",
    "pin", "pwd", "secret", "social", "ssn", "tel", "token",
)
LABELERS = ("shape", "gazetteer", "assigned", "near_base", "mixed")
#: Characters before a candidate that context labelers see; distance to a base span that counts as near.
CONTEXT, NEAR = 40, 80
ROUNDS = 12


def found_spans(text: Column, pattern: str, kind: Column | str, valid) -> Column:
    """array<struct<kind, start, end, value>>: matches of ``pattern`` that are ``valid(value)``, in code points.

    The parts between matches give the places; only valid matches are kept while walking over them.
    """
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    empty = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int,value:string>>")

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["gap"])
        end = start + F.length(z["value"])
        label = F.lit(kind) if isinstance(kind, str) else kind(z["value"])
        span = F.struct(label.alias("kind"), start.alias("start"), end.alias("end"), z["value"].alias("value"))
        return F.struct(end.alias("at"), F.when(valid(z["value"]), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("value")))
    return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _octet(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def base_spans(text: Column) -> Column:
    """All base spans of a text (array of arrays by kind, flattened)."""
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int,value:string>>")
    digit = text.rlike("[0-9]")
    kinds = [
        (text.contains("@"), found_spans(text, _EMAIL, "email", lambda v: F.lit(True))),
        (digit, found_spans(text, _IP, "ip", lambda v: F.forall(F.split(v, r"\."), _octet))),
        (digit, found_spans(text, _CARD, "card", lambda v: F.length(_digits(v)).between(14, 19) & F.call_function("luhn_check", _digits(v)))),
        (text.contains("+"), found_spans(text, _PHONE, "phone", lambda v: F.length(_digits(v)).between(10, 15))),
    ]
    return F.flatten(F.array(*[F.when(some, spans).otherwise(none) for some, spans in kinds]))


def _kind_of(value: Column) -> Column:
    return (
        F.when(value.rlike(r"^[A-Z]{2}[0-9]{2}(\x20?[A-Z0-9]{4}){3,7}$"), "bank")
        .when(value.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "national")
        .when(value.rlike(r"^\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"), "local_phone")
        .otherwise("secret")
    )


def candidate_spans(text: Column, base: Column) -> Column:
    """Candidates apart from base spans, with their votes: array<struct<kind, start, end, value, one int per labeler>>."""
    none = F.from_json(F.lit("[]"), "array<struct<kind:string,start:int,end:int,value:string>>")
    # A secret mixes digits and letters; the other kinds hold digits by their pattern.
    proposed = F.when(text.rlike("[0-9]"), found_spans(
        text, _CANDIDATE, _kind_of, lambda v: v.rlike("[0-9]") & (v.rlike("[A-Za-z]") | (_kind_of(v) != "secret"))
    )).otherwise(none)
    free = F.filter(proposed, lambda c: ~F.exists(base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    names = "|".join(NAMES)

    def voted(c: Column) -> Column:
        before = F.substring(text, F.greatest(c["start"] - CONTEXT, F.lit(0)) + 1, F.least(c["start"], F.lit(CONTEXT)))
        value = c["value"]
        strict = (
            F.when(c["kind"] == "secret", F.length(value) >= 20)
            .when(c["kind"] == "national", ~value.rlike("^(000|666|9)"))
            .when(c["kind"] == "local_phone", ~value.rlike(r"^\(?[01]"))
            .otherwise(F.lit(True))
        )
        votes = {
            "shape": F.when(strict, 1).otherwise(-1),
            "gazetteer": F.when(before.rlike(rf"(?i)\b({names})[^A-Za-z0-9]{{0,6}}$"), 1).otherwise(0),
            "assigned": F.when(before.rlike(r"[=:]\s*[\"']?$"), 1).when(before.rlike(r"[A-Za-z,.]\s*$"), -1).otherwise(0),
            "near_base": F.when(F.exists(base, lambda b: (b["start"] < c["end"] + NEAR) & (c["start"] - NEAR < b["end"])), 1).otherwise(0),
            "mixed": F.when(F.size(F.array_distinct(F.split(value, ""))) >= 6, 1).otherwise(-1),
        }
        return F.struct(*[c[x].alias(x) for x in ("kind", "start", "end")], *[votes[n].alias(n) for n in LABELERS])

    return F.transform(free, voted)


def _posteriors(votes: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, dict]:
    """(posterior of being personal for each vote pattern, estimated rates) from ``votes`` [patterns, labelers] and counts."""
    total = votes.sum(axis=1)
    p = np.where(total > 0, 0.85, np.where(total < 0, 0.15, 0.5))
    rates: dict = {}
    for _ in range(rounds):
        yes, no = (n * p).sum(), (n * (1 - p)).sum()
        up, down = np.log((yes + 1) / (yes + no + 2)), np.log((no + 1) / (yes + no + 2))
        up, down = np.full(len(n), up), np.full(len(n), down)
        for i, x in enumerate(LABELERS):
            for v in (-1, 0, 1):
                here = votes[:, i] == v
                rates[x, v] = (float(((n * p)[here].sum() + 1) / (yes + 3)), float(((n * (1 - p))[here].sum() + 1) / (no + 3)))
                up, down = up + here * np.log(rates[x, v][0]), down + here * np.log(rates[x, v][1])
        p = 1 / (1 + np.exp(np.clip(down - up, -700, 700)))
    return p, rates


def estimate_reliability(patterns: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict]:
    """(patterns with ``p``, the posterior of being personal; the estimated rates) from counts ``n`` of vote patterns.

    ``patterns``: kind, one column for each labeler (-1, 0, 1), n. Starts from the sum of votes; rates are smoothed by one
    count, so that no vote is ever certain. There are at most kinds x 3 ** labelers patterns (972): they are brought
    to the driver once and iterated there.
    """
    rows = patterns.collect()
    if not rows:
        return patterns.withColumn("p", F.lit(0.0)), {}
    votes = np.array([[r[x] for x in LABELERS] for r in rows])
    p, rates = _posteriors(votes, np.array([float(r["n"]) for r in rows]), rounds)
    schema = T.StructType([*patterns.schema.fields, T.StructField("p", T.DoubleType())])
    return patterns.sparkSession.createDataFrame([(*r, float(x)) for r, x in zip(rows, p)], schema), rates


def _logistic(x: np.ndarray, p: np.ndarray, n: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights, the constant last, of a ridge-penalised logistic regression on targets ``p`` with weights ``n`` (Newton steps)."""
    x = np.column_stack([x, np.ones(len(x))])
    n = n / n.sum()
    ridge = np.diag([*[penalty] * (x.shape[1] - 1), 1e-9])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (n * q * (1 - q))) @ x + ridge, x.T @ (n * (p - q)) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return w


def train_classifier(patterns: list, rounds: int = ROUNDS) -> tuple[float, dict[str, float]] | None:
    """(constant, weight by labeler and added kind) of a logistic regression on the posteriors of counted vote patterns; None without any."""
    if not patterns:
        return None
    # In one order: sums of floating point depend on it.
    patterns = sorted(patterns, key=lambda r: (r["kind"], *[r[x] for x in LABELERS]))
    votes, n = np.array([[r[x] for x in LABELERS] for r in patterns], float), np.array([float(r["n"]) for r in patterns])
    p, _ = _posteriors(votes, n, rounds)
    kinds = np.array([[float(r["kind"] == k) for k in ADDED_KINDS] for r in patterns])
    *weights, constant = _logistic(np.column_stack([votes, kinds]), p, n).tolist()
    return constant, dict(zip([*LABELERS, *[f"kind_{k}" for k in ADDED_KINDS]], weights))


def learn_personal(docs: DataFrame, text_col: str = "text") -> tuple[float, dict[str, float]] | None:
    """The classifier's (constant, weights) from the votes on all candidates of all texts; None without candidates."""
    based = docs.select(F.coalesce(text_col, F.lit("")).alias("text")).withColumn("base", base_spans(F.col("text")))
    votes = based.select(F.explode(candidate_spans(F.col("text"), F.col("base"))).alias("c")).select("c.kind", *[f"c.{x}" for x in LABELERS])
    return train_classifier(votes.groupBy("kind", *LABELERS).agg(F.count("*").alias("n")).collect())


def with_spans(
    docs: DataFrame, model: tuple[float, dict[str, float]] | None, limit: float = 0.5, text_col: str = "text", spans_col: str = "spans"
) -> DataFrame:
    """``docs`` with ``spans_col``: array<struct<kind, start, end, p>> in order, ends exclusive, in code points.

    Base spans have ``p`` 1; added ones the classifier's probability, at least ``limit``, and overlap no base
    span. Null and empty texts: an empty array.
    """
    text, base = F.coalesce(text_col, F.lit("")), F.col("base_spans_")
    spans = F.transform(base, lambda b: F.struct(
        b["kind"].alias("kind"), b["start"].alias("start"), b["end"].alias("end"), F.lit(1.0).alias("p")
    ))
    if model is not None:
        constant, weights = model

        def scored(c: Column) -> Column:
            z = F.lit(constant)
            for x in LABELERS:
                z = z + F.lit(weights[x]) * c[x]
            for k in ADDED_KINDS:
                z = z + F.when(c["kind"] == k, weights[f"kind_{k}"]).otherwise(0.0)
            return F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), (1 / (1 + F.exp(-z))).alias("p"))

        spans = F.concat(spans, F.filter(F.transform(candidate_spans(text, base), scored), lambda c: c["p"] >= limit))
    order = F.create_map(*[F.lit(x) for i, k in enumerate(BASE_KINDS + ADDED_KINDS) for x in (k, i)])
    keyed = F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), order[s["kind"]].alias("place"), s["end"].alias("end"), s["kind"].alias("kind"), s["p"].alias("p")
    ))
    ordered = F.transform(F.array_sort(keyed), lambda s: F.struct(*[s[x].alias(x) for x in ("kind", "start", "end", "p")]))
    return docs.withColumn("base_spans_", base_spans(text)).withColumn(spans_col, ordered).drop("base_spans_")


def find_personal(docs: DataFrame, limit: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, text and ``spans`` (see ``with_spans``), learned and found over all of them.

    Null and empty texts: an empty array. Repeated rows are answered each; other columns aren't read.
    """
    rows = docs.select(id_col, text_col)
    return with_spans(rows, learn_personal(rows, text_col), limit, text_col)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(text: Column, spans: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; a span that begins inside an earlier one joins it."""
    def step(acc: Column, s: Column) -> Column:
        new = s["start"] >= acc["at"]
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(new, F.array_append(acc["out"], F.concat(kept, F.lit("["), s["kind"], F.lit("]")))).otherwise(acc["out"]).alias("out"),
        )

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, walked).otherwise(text)
