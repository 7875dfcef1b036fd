"""Operators that map texts: brute force, odd rows and ties."""

import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footstats.llm import tokens
from footstats.llm.common import tokenizer_path
from footstats.llm.language import identify_languages, is_accepted, learn_languages
from footstats.llm.licenses import NOTICES, fuzzy_matches, normal_form, prepared, scan_licenses, split_seeds
from footstats.llm.packing import cut_lengths, pack_documents, token_encoder
from footstats.llm.personal import BASE_KINDS, digest, estimate_reliability, find_personal, redact
from footstats.llm.toxicity import learn_toxicity, score_toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, labels string"


def frame(spark, texts, langs=None):
    """Rows with nulls, clashing extra columns and repeated ids where asked."""
    return spark.createDataFrame(
        [(i, t, (langs or [None] * len(texts))[i], None, None, 1.0, "x") for i, t in enumerate(texts)], DOCS
    )


ODD = [None, "", " ", "!!!", "a", "ß É", "x" * 5000, "the same row", "the same row"]


def test_edited_tokens_match_encoding_the_edited_text(spark):
    count = tokens.token_counter(tokenizer_path("byte_bpe_50k.tiktoken"))
    pick, alphabet = random.Random(1), ["a", "b", " ", "  ", "\n", "'", "l", "'ll", "s", "1", "é", ".", " the", "re", "\t"]
    for block in (2, 64):
        tokens.BLOCK = block
        for _ in range(300):
            tree = tokens.TokenTree("".join(pick.choices(alphabet, k=pick.randint(0, 60))), count)
            for _ in range(4):
                start = pick.randint(0, len(tree.text))
                end = pick.randint(start, min(len(tree.text), start + pick.choice([0, 1, 5, 40])))
                new = "".join(pick.choices(alphabet, k=pick.choice([0, 1, 3, 10])))
                want = tree.text[:start] + new + tree.text[end:]
                tree.edit(start, end, new)
                again = tokens.TokenTree(want, count)
                assert (tree.text, tree.total, tree.pretokens) == (want, again.total, again.pretokens)
    tokens.BLOCK = 64


def test_edit_touches_only_its_surroundings():
    count = tokens.token_counter(tokenizer_path("byte_bpe_50k.tiktoken"))
    tree = tokens.TokenTree("some words here " * 5000, count)
    before = tree.encoded
    tree.edit(40_000, 40_004, "other")
    assert tree.encoded - before < 10


def test_edited_tokens_rows(spark):
    rows = frame(spark, ODD).withColumn("edits", F.when(F.col("doc_id") != 4, tokens.editorial_edits(F.col("text"))))
    got = {r["doc_id"]: r for r in tokens.count_edited_tokens(rows, tokenizer_path("byte_bpe_50k.tiktoken")).collect()}
    assert len(got) == len(ODD) and got[0]["tokens_before"] == 0 and got[4]["n_edits"] == 0
    assert got[7].asDict() | {"doc_id": 0} == got[8].asDict() | {"doc_id": 0}
    assert tokens.count_edited_tokens(rows.limit(0), tokenizer_path("byte_bpe_50k.tiktoken")).count() == 0


def test_languages_on_held_out_texts(spark):
    pick = random.Random(2)
    words = {"aa": ["bana", "nana", "baba", "naba"], "bb": ["tiko", "kito", "toki", "kiti"]}
    langs = [pick.choice(["aa", "bb"]) for _ in range(400)]
    texts = [" ".join(pick.choices(words[x], k=20)) for x in langs]
    docs = frame(spark, texts + ODD, langs + [None] * len(ODD))
    models = learn_languages(docs, F.col("doc_id") < 300)
    got = {r["doc_id"]: r for r in identify_languages(docs, models).collect()}
    assert all(got[i]["lang_pred"] == langs[i] and got[i]["accepted"] for i in range(300, 400))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for i in (400, 401, 402, 403):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
    kept = docs.where(is_accepted(models, spark)("text"))
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["accepted"]}
    strange = identify_languages(frame(spark, ["zzqwx vvjjh qqxz " * 9]), models).first()
    assert not strange["accepted"]


def test_languages_without_labels(spark):
    docs = frame(spark, ["some text", None])
    models = learn_languages(docs, F.lit(True))
    assert [r["lang_pred"] for r in identify_languages(docs, models).collect()] == ["und", "und"]


def plain_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_base_places(spark):
    texts = ODD + [
        "MIT License. the mit-license, MITÉ license", "apache license apache license", "GNU General Public License v3",
        "x mit license mit license " * 200, "Licensd under teh Apache Licence, Version 2.0", "Licensed under CC BY-NC 4.0.",
    ]
    got = {r["doc_id"]: r for r in scan_licenses(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == plain_licenses(t)
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[len(ODD) + 4]["labels"] == "apache" and got[len(ODD) + 4]["n_base"] == 0
    assert got[len(ODD) + 5]["labels"] == "cc-by-nc" and 0 < got[len(ODD) + 5]["score"] <= 1
    m = got[len(ODD) + 5]["matches"][0]
    assert (m["start"], m["end"], m["errors"]) == (0, 7, 0)


def test_seeds_find_all_that_a_full_search_finds():
    import regex

    pick = random.Random(3)
    for label, phrase, k, *_ in NOTICES:
        notice = prepared([(label, phrase, k)])[0]
        assert b"".join(s for _, s in split_seeds(notice.phrase, k)) == notice.phrase
        pattern = regex.compile(b"(?:" + regex.escape(notice.phrase) + b"){e<=%d}" % k, regex.ENHANCEMATCH)
        for _ in range(15):
            chars = list(phrase)
            for _ in range(pick.randint(0, k)):
                i = pick.randrange(len(chars))
                chars[i] = pick.choice(["", "x", chars[i] + "y"])
            line = normal_form("some words before " + "".join(chars) + " and after")
            assert fuzzy_matches(line, notice, pattern)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    pick = random.Random(4)
    texts = ODD + ["It's <|endoftext|> don't\x1cstop"] + [
        " ".join(pick.choices(["Words", "été,", "a.b!", "12", "the"], k=pick.choice([1, 40, 700, 5000]))) for _ in range(60)
    ]
    docs = frame(spark, texts).repartition(3)
    pieces = pack_documents(docs, tokenizer_path("word_bpe_49k.json"), capacity=256, granule=32).toPandas()
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        own = pieces[pieces["doc_id"] == i].sort_values("start")
        assert own["start"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() == len(ids)
        assert (own["doc_tokens"] == len(ids)).all()
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32
    padding = 0
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == [0, *s["length"].cumsum().tolist()[:-1]]
        size = int(s["length"].sum())
        assert size <= 256
        padding += 0 if size & (size - 1) == 0 else 256 - size
    assert padding < 0.05 * pieces["length"].sum()
    assert pack_documents(docs.limit(0), tokenizer_path("word_bpe_49k.json")).count() == 0


def test_cut_lengths():
    for total in range(1, 5000, 7):
        parts = cut_lengths(total, 2048, 128)
        assert sum(parts) == total and all(0 < p <= 2048 for p in parts) and sum(p < 128 for p in parts) <= 1


def test_encoder_forgets_and_still_agrees(monkeypatch):
    from tokenizers import Tokenizer

    from footstats.llm import packing

    monkeypatch.setattr(packing, "MEMO_WORDS", 3)
    encode = token_encoder(tokenizer_path("word_bpe_49k.json"), 1)
    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    for t in ("Été naïve, it's!", "ΣΑΣ İstanbul ﬁ", "A.B.C 's s' x-y", "日本語。テスト"):
        assert np.frombuffer(encode(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [1]


def test_toxicity_on_held_out_texts(spark):
    pick = random.Random(5)
    common = ["".join(pick.choices("aeiounrtslm", k=pick.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(360):
        words, toxic = pick.choices(common, k=60), i % 3 == 0
        for _ in range(4 if toxic else 0):
            words[pick.randrange(60)] = pick.choice(["gruzzle", "blathok", "snirkit"])
        rows.append(" ".join(words))
        labels.append((i, int(toxic)))
    docs = frame(spark, rows + ODD)
    marks = spark.createDataFrame(labels + [(0, 1), (999, 1)], "doc_id long, toxic int")
    model = learn_toxicity(docs, marks, F.col("doc_id") < 240)
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    assert len(got) == len(rows) + len(ODD) and all(0 <= s <= 1 for s in got.values())
    right = [(got[i] >= 0.7) == bool(y) for i, y in labels if i >= 240]
    assert np.mean(right) > 0.95
    assert got[360 + 7] == got[360 + 8]


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    pick = random.Random(6)
    common = ["".join(pick.choices("aeiounrtslm", k=pick.randint(3, 8))) for _ in range(400)]
    rows, labels = [], []
    for i in range(240):
        words = pick.choices(common, k=1600)
        for _ in range(24 if i % 3 == 0 else 0):
            words[pick.randrange(1500, 1600)] = pick.choice(["gruzzle", "blathok", "snirkit"])
        assert len(" ".join(words[:1500])) > 8192
        rows.append(" ".join(words))
        labels.append((i, int(i % 3 == 0)))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    docs = frame(spark, rows)
    model = learn_toxicity(docs, marks, F.col("doc_id") < 180)
    assert any(w in model.toxic for w in (b"gruzzle", b"blathok", b"snirkit"))
    got = {r["doc_id"]: r["score"] for r in score_toxicity(docs, model).collect()}
    assert np.mean([(got[i] >= 0.7) == bool(y) for i, y in labels if i >= 180]) > 0.9


def test_toxicity_without_labels(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert learn_toxicity(docs, none, F.lit(True)) is None
    assert {r["score"] for r in score_toxicity(docs, None).collect()} == {0.0}


PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def plain_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(PLAIN):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), place, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_personal_base_spans(spark):
    pick = random.Random(6)
    bits = [
        "a@b.co", "a@b.co_x@d.com", "x.y@z", "1.2.3.4", "1.2.3.4.5.6.7.8", "999.1.1.1", "001.02.0003.255", "4111 1111 1111 1111",
        "4111-1111-1111-1111 2", "+1 (555) 010-9999", "+1+22 333 444 5555", "é", "日本", " ", ".", "@", "-", "12", "5500005555555559", "😀",
    ]
    texts = ODD + ["".join(pick.choices(bits, k=pick.randint(1, 12))) for _ in range(300)] + ["1" * 30_000, "a" * 30_000, "a.b" * 5000 + "@c.d" + ".e" * 5000, "1 " * 9000]
    found = find_personal(frame(spark, texts))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    got = {r["doc_id"]: r["d"] for r in found.select("doc_id", digest(base).alias("d")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == plain_spans(t or ""), (t or "")[:80]


def test_personal_added_spans_and_redaction(spark):
    secret = hashlib.sha1(b"x").hexdigest()
    texts = [f"Mail é a@b.co, token = \"{secret}\" end", "nothing here", None, ""] + [f"text {i} password={hashlib.md5(bytes([i])).hexdigest()} a{i}@b.org" for i in range(40)]
    found = find_personal(frame(spark, texts)).withColumn("clean", redact(F.col("text"), F.col("spans")))
    got = {r["doc_id"]: r for r in found.collect()}
    assert got[0]["clean"] == 'Mail é [email], token = "[secret]" end'
    assert got[1]["clean"] == "nothing here" and got[2]["clean"] is None and got[3]["clean"] == ""
    assert [s["kind"] for s in got[0]["spans"]] == ["email", "secret"]
    assert find_personal(frame(spark, texts).limit(0)).count() == 0


def test_reliability_of_labelers(spark):
    """Votes drawn with known rates: the posterior tells the two sides apart."""
    pick, rows = random.Random(7), []
    for _ in range(4000):
        y = pick.random() < 0.4
        good = [1 if (pick.random() < 0.9) == y else -1 for _ in range(4)]
        rows.append(("secret", *good, pick.choice([-1, 1]), y))
    names = ["shape", "gazetteer", "assigned", "near_base", "mixed"]
    votes = pd.DataFrame(rows, columns=["kind", *names, "y"])
    counts = votes.groupby(["kind", *names], as_index=False).agg(n=("y", "size"), y=("y", "mean"))
    fitted, rates = estimate_reliability(spark.createDataFrame(counts))
    out = fitted.toPandas()
    assert ((out["p"] > 0.5) == (out["y"] > 0.5)).mul(out["n"]).sum() / out["n"].sum() > 0.95
    assert rates["shape", 1][0] > 0.8 and abs(rates["mixed", 1][0] - rates["mixed", 1][1]) < 0.1


@pytest.mark.parametrize("function", [scan_licenses, find_personal])
def test_empty_tables(spark, function):
    assert function(frame(spark, ["x"]).limit(0)).count() == 0


# --- neighbours, ids, letters and long secrets


@pytest.mark.parametrize("text, labels", [
    ("released under the BSD license", ""), ("released under the GPL license", ""), ("released under the ISC license", ""),
    ("released under the X11 license", ""), ("released under the permit license", ""), ("reelased undr the MIT license", "mit"),
    ("released under the MIT licence", "mit"), ("licensed under CC BY-SA 4.0", ""), ("licensed under CC BY-ND 4.0", ""),
    ("licenced under CC BY-NC 4.0", "cc-by-nc"), ("licensed under the GNU Affero General Public License", "gpl"),
    ("licensed under the GNU Lesser General Public License", "gpl,lgpl"), ("licensed undr the GNU General Public Licence", "gpl"),
    ("licensed undr the Apache Licence, Version 2.0", "apache"), ("subject to the terms of the Modzilla Public License", ""),
    ("subject to terms of the Mozilla Public License", "mpl"),
])
def test_neighbour_licenses_are_told_apart(spark, text, labels):
    assert scan_licenses(frame(spark, [text])).first()["labels"] == labels


def test_ids_pass_unaltered_beside_null_ids(spark):
    from footstats.llm.jaccard import similarity_classes
    from footstats.llm.lattice import score_documents
    from footstats.llm.tokens import count_edited_tokens

    ids = [2**60 + 1, None, 2**60 + 3]
    docs = spark.createDataFrame([(i, f"the words of a text {i}", "aa") for i in ids], "doc_id long, text string, lang string").coalesce(1)
    none = F.array().cast("array<struct<start:int,end:int,new:string>>")
    made = [
        count_edited_tokens(docs.withColumn("edits", none), tokenizer_path("byte_bpe_50k.tiktoken")),
        identify_languages(docs, learn_languages(docs, F.lit(True))), scan_licenses(docs), score_toxicity(docs, None), find_personal(docs),
        pack_documents(docs, tokenizer_path("word_bpe_49k.json")), similarity_classes(docs),
        score_documents(docs, F.lit(True), tokenizer_path("piece_bpe_32k.model"), rounds=0),
    ]
    for out in made:
        assert {r["doc_id"] for r in out.collect()} == set(ids)
    assert {r["component_id"] for r in made[6].collect()} == set(ids)


def test_number_signs_are_no_letters(spark):
    docs = frame(spark, ["² ½ ①", "Ⅷ ½", "a²b", "x"], ["aa", "aa", "aa", "aa"])
    got = {r["doc_id"]: r["lang_pred"] for r in identify_languages(docs, learn_languages(docs, F.lit(True))).collect()}
    assert got == {0: "und", 1: "und", 2: "aa", 3: "aa"}


def test_language_models_of_and_for_empty_tables(spark):
    none = frame(spark, ["x"], ["aa"]).limit(0)
    models = learn_languages(none, F.lit(True))
    assert identify_languages(none, models).count() == 0
    assert identify_languages(frame(spark, ["x"]), models).first()["lang_pred"] == "und"


def test_secrets_of_any_length_are_found(spark):
    pick = random.Random(9)
    keys = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=n)) for n in (40, 64, 65, 66, 128, 3000)]
    got = find_personal(frame(spark, [f"the secret token = {k} is here" for k in keys])).collect()
    for r in got:
        key = keys[r["doc_id"]]
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"]] == [("secret", 19, 19 + len(key))]
