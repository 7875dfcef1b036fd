"""Benchmark decontamination with a positional inverted index of training tokens.

Test items are cut into windows of consecutive words. The index stores where the training documents hold the
windows' rarest words (document, place); the lists of a window's rare words, each moved back by the word's
place in the window, are intersected, and what is left is compared with the document's words. Built from
DataFrame operations alone; sizes are checked before anything is broadcast. Near matches (all but a fifth of a
window's words, each within some words of its place) are found where the rare words are read, from the words around them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from footstats.llm.common import cut

#: Rows up to which a table of test words may be broadcast; larger ones are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Bytes up to which the windows of near matches are broadcast, counting so many for each window beside its words.
BROADCAST_BYTES, ROW_BYTES = 64 << 20, 400
#: Rare words of a window whose lists are intersected.
RARE_WORDS = 2
#: Bits of the map that sorts out words before their surroundings are copied.
MAP_BITS = 1 << 17
#: A near match lacks at most one word of so many of its window.
LACKING = 5
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_list(text: Column) -> Column:
    """Words of a text: ASCII letters in lower case, digits and all beyond ASCII; none for null."""
    text = F.coalesce(text, F.lit(""))
    # ``lower`` is right, and faster, where all characters are ASCII.
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def line_words(line: Column) -> Column:
    """The words of a line in which they are parted by one blank each."""
    return F.array_remove(F.split(line, " "), "")


def checked(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def test_windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, item, s, phrase, words): each window of ``width`` consecutive words; a shorter item is one window.

    ``item`` is the hash of an item's words: items with one id, or none, and different texts are told apart.
    """
    words = items.select(F.col(id_col).alias("item_id"), word_list(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    words = words.withColumn("item", F.xxhash64(F.array_join("all", " ")))
    starts = F.sequence(F.lit(0), F.greatest(F.size("all") - width, F.lit(0)))
    return words.select("item_id", "item", "all", F.explode(starts).alias("s")).select(
        "item_id", "item", "s", F.slice("all", F.col("s") + 1, F.lit(width)).alias("words")
    ).select("item_id", "item", "s", F.xxhash64(F.array_join("words", " ")).alias("phrase"), "words").distinct()


@dataclass
class PositionalIndex:
    """``postings``: (row, place, word) of rare test words; ``rare``: (item, s, phrase, size, rank, at, word).

    ``at`` is the place of a window's rare word in its item, so that windows which overlap share their lists.
    ``docs``: (row, words), and ``ranked``, all words of all windows, serve near matches.
    """

    postings: DataFrame
    rare: DataFrame
    rare_rows: int
    docs: DataFrame
    ranked: DataFrame

    def aligned(self) -> DataFrame:
        """(row, item, shift, at): postings moved back to where their item would begin."""
        anchors = self.rare.select("item", "at", "word").distinct()
        return self.postings.join(checked(anchors, self.rare_rows), "word").select(
            "row", "item", (F.col("place") - F.col("at")).alias("shift"), "at"
        )

    def phrase_starts(self) -> DataFrame:
        """(row, phrase, start, size): places where all rare words of a window stand as in the window."""
        met = self.aligned().groupBy("row", "item", "shift").agg(F.collect_set("at").alias("met"))
        windows = self.rare.groupBy("item", "s", "phrase", "size").agg(F.collect_set("at").alias("needed")).groupBy("item").agg(
            F.collect_list(F.struct("s", "phrase", "size", "needed")).alias("windows"), F.min(F.size("needed")).alias("least")
        )
        whole = met.join(checked(windows, self.rare_rows), "item").where(F.size("met") >= F.col("least")).select(
            "row", "shift", F.explode(F.filter("windows", lambda w: F.size(F.array_except(w["needed"], F.col("met"))) == 0)).alias("w")
        )
        return whole.select("row", "w.phrase", (F.col("shift") + F.col("w.s")).alias("start"), "w.size").where("start >= 0").distinct()

    def near(self, slack: int, width: int) -> DataFrame:
        """(row, phrase, start): windows with all but a fifth of their words within ``slack`` of their places.

        Windows of up to four words lack none. ``start`` is the first place from which the window's words are
        found so. Of the ``misses + 1`` rarest words of a window one must stand wherever it is found, and two of the
        ``misses + 2`` rarest, words that no document holds being among the rarest. Postings of these words carry
        the words around them, so that all is compared where they are read and only matches are dealt.
        """
        each = self.ranked.groupBy("item", "s", "phrase", "size").agg(
            F.array_sort(F.collect_list(F.struct("offset", "word", "rank", "times"))).alias("w")
        ).withColumn("misses", F.floor(F.col("size") / LACKING).cast("int"))
        each = each.where(F.size(F.filter("w", lambda x: x["times"].isNull())) <= F.col("misses"))
        seeds = F.filter("w", lambda x: x["times"].isNotNull() & (x["rank"] <= F.col("misses") + 1))
        each = each.select("item", "s", "phrase", "size", "misses", "w", F.explode(seeds).alias("seed"))
        beside = F.filter("w", lambda x: (x["rank"] <= F.col("misses") + 2) & (x["offset"] != F.col("seed.offset")))
        each = each.select(
            F.col("seed.word").alias("word"), "item", (F.col("s") + F.col("seed.offset")).alias("at"), (F.col("size") == 1).alias("alone"),
            F.transform(beside, lambda x: x["word"]).alias("beside"),
            F.struct("phrase", "size", "misses", F.col("seed.offset").alias("offset"), F.transform("w", lambda x: x["word"]).alias("wanted")).alias("window"),
        )
        each = cut(each.groupBy("word", "item", "at").agg(
            F.max("alone").alias("alone"), F.array_distinct(F.flatten(F.collect_list("beside"))).alias("beside"), F.collect_list("window").alias("windows")
        ))
        anchors = each.select("word", "item", "at", "alone", "beside")
        windows = each.select("word", "item", "at", "windows")
        held = may_hold(each.select("word"))
        # Both tables are met where the documents are read, as long as they are small.
        letters = F.aggregate("windows", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(F.array_join(w["wanted"], " ")) + ROW_BYTES)
        if each.agg(F.coalesce(F.sum(letters), F.lit(0))).first()[0] <= BROADCAST_BYTES:
            anchors, windows = F.broadcast(anchors), F.broadcast(windows)

        reach = width - 1 + 2 * slack
        first = lambda i: F.greatest(i - reach, F.lit(0))
        places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: held(F.get("words", i)))
        around = F.transform(places, lambda i: F.struct(
            i.alias("place"), F.get("words", i).alias("word"), first(i).alias("first"),
            F.slice("words", first(i) + 1, i - first(i) + reach + 1).alias("around"),
        ))
        listed = self.docs.where(F.size("words") > 0).select("row", F.inline(around))
        met = listed.join(anchors, "word").where(F.col("alone") | F.arrays_overlap("around", "beside"))

        def known(w: Column) -> Column:
            return F.size(F.filter(w["wanted"], lambda x: F.array_contains("around", x))) >= w["size"] - w["misses"]

        near = met.join(windows, ["word", "item", "at"]).select(
            "row", "place", "first", "around", F.explode(F.filter("windows", known)).alias("w")
        ).select("row", "place", "first", "around", "w.*")

        def stands(start: Column, i: Column) -> Column:
            low = F.greatest(start + i - slack, F.col("first"))
            part = F.slice("around", low - F.col("first") + 1, F.greatest(start + i + slack + 1 - low, F.lit(0)))
            return F.array_contains(part, F.get("wanted", i))

        def enough(start: Column) -> Column:
            places = F.sequence(F.lit(0), F.col("size") - 1)
            return F.size(F.filter(places, lambda i: stands(start, i))) >= F.col("size") - F.col("misses")

        middle = F.col("place") - F.col("offset")
        starts = F.filter(F.sequence(middle - slack, middle + slack), enough)
        return near.select("row", "phrase", F.array_min(starts).alias("start")).where("start IS NOT NULL").groupBy("row", "phrase").agg(
            F.min("start").alias("start")
        )


def may_hold(words: DataFrame) -> Callable[[Column], Column]:
    """A test whether a word can be among ``words``, never false for one that is: a bitmap of hashes of ``MAP_BITS`` bits."""
    slot = F.pmod(F.hash("word"), F.lit(MAP_BITS))
    cells = words.select((slot / 32).cast("int").alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), slot % 32).alias("bit"))
    bits = {r["cell"]: r["bits"] for r in cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).collect()}
    bitmap = F.expr(f"array({','.join(f'{bits.get(i, 0)}L' for i in range(MAP_BITS // 32))})")

    def test(word: Column) -> Column:
        slot = F.pmod(F.hash(word), F.lit(MAP_BITS))
        return F.get(bitmap, (slot / 32).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), slot % 32)) != 0

    return test


def build_index(docs: DataFrame, windows: DataFrame, rare_words: int = RARE_WORDS) -> PositionalIndex:
    """Index of ``docs`` (row, words) for the rarest words of ``windows`` (item, s, phrase, words).

    All documents are counted for all words of the windows; windows with a word that no document holds
    cannot occur and leave, but for near matches. Then the places of each window's ``rare_words`` rarest words are stored.
    """
    windows = windows.select("item", "s", "phrase", "words").distinct()
    terms = cut(windows.select("item", "s", "phrase", F.size("words").alias("size"), F.posexplode("words").alias("offset", "word")))
    known = terms.select("word").distinct()
    counts = docs.select(F.explode("words").alias("word")).join(checked(known, known.count()), "word", "left_semi")
    counts = cut(counts.groupBy("word").agg(F.count("*").alias("times")))
    one = Window.partitionBy("item", "s")
    ranked = terms.join(counts, "word", "left").withColumn("at", F.col("s") + F.col("offset"))
    ranked = cut(ranked.withColumn("rank", F.row_number().over(one.orderBy(F.coalesce("times", F.lit(0)), "offset"))))
    rare = ranked.withColumn("absent", F.max(F.col("times").isNull()).over(one)).where("NOT absent").where(F.col("rank") <= rare_words)
    rare = cut(rare.select("item", "s", "phrase", "size", "rank", "at", "word"))
    wanted = rare.select("word").distinct()
    places = docs.select("row", F.posexplode("words").alias("place", "word"))
    postings = cut(places.join(checked(wanted, wanted.count()), "word", "left_semi"))
    return PositionalIndex(postings, rare, rare.count(), docs, ranked)


def find_contamination(
    docs: DataFrame, items: DataFrame, width: int = 10, slack: int | None = None,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """One row per document: its words, those inside any test window, and the items whose windows it holds.

    Null and empty texts have no words. An item without words has no window. Rows that repeat are answered
    each; rows with one id and different texts are told apart, items too. Columns: ``id_col``, n_words, n_hit,
    n_items (a null id counts as one), items_sha256 (item ids sorted as text, joined by commas), contaminated; with ``slack`` also n_near, the
    windows that stand there with all but a fifth of their words within that many words of their places.
    """
    # The texts are read once; their words are written in one line each, as a list of them would be slow to read.
    rows = cut(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"),
        F.array_join(word_list(F.col(text_col)), " ").alias("line"),
    ))
    listed = rows.select("row", line_words(F.col("line")).alias("words"))
    windows = cut(test_windows(items, width, item_col, item_text_col))
    index = build_index(listed, windows)

    # What the rare words agree on is compared with the words that stand there.
    found = index.phrase_starts().groupBy("row").agg(
        F.collect_set(F.struct(F.col("start").cast("int").alias("start"), "size", "phrase")).alias("found")
    )
    held = rows.select("row", "line").join(found, "row")
    placed = held.select("row", line_words(F.col("line")).alias("words"), "found").select("row", "words", F.explode("found").alias("c"))
    same = F.xxhash64(F.array_join(F.slice("words", F.col("c.start") + 1, F.col("c.size")), " ")) == F.col("c.phrase")
    exact = cut(placed.where(same).select("row", "c").groupBy("row").agg(F.array_sort(F.collect_set("c")).alias("found")))

    def sweep(acc: Column, c: Column) -> Column:
        end = c["start"] + c["size"]
        return F.struct(
            (acc["n"] + F.greatest(end - F.greatest(c["start"], acc["end"]), F.lit(0))).alias("n"),
            F.greatest(acc["end"], end).alias("end"),
        )

    hits = exact.select("row", F.aggregate(
        "found", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), sweep, lambda acc: acc["n"].cast("long")
    ).alias("n_hit"))
    phrases = exact.select("row", F.explode(F.array_distinct(F.col("found.phrase"))).alias("phrase"))
    owners = phrases.join(windows.select("phrase", F.col("item_id").cast("string").alias("item_id")), "phrase").distinct()
    owned = owners.groupBy("row").agg(
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max(F.col("item_id").isNull().cast("int")).alias("unnamed")
    )
    result = hits.join(owned, "row")
    if slack is not None:
        near = index.near(slack, width).groupBy("row").agg(F.count_distinct("phrase").alias("n_near"))
        result = result.join(near, "row", "full")
    zero = F.lit(0).cast("long")
    columns = [
        F.coalesce("n_hit", zero).alias("n_hit"),
        F.coalesce(F.size("items") + F.col("unnamed"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    ]
    if slack is not None:
        columns.append(F.coalesce("n_near", zero).alias("n_near"))
    sized = rows.select("doc_id", "row", F.size(line_words(F.col("line"))).cast("long").alias("n_words"))
    return sized.join(result, "row", "left").select(F.col("doc_id").alias(id_col), "n_words", *columns)


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS p
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS p
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win))),
m AS (SELECT * FROM g WHERE p IN (SELECT p FROM win)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM m) GROUP BY doc_id),
o AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM m JOIN win USING (p) GROUP BY doc_id),
it AS (SELECT w, row_number() OVER () AS k FROM (SELECT DISTINCT w FROM b WHERE len(w) > 0)),
iw AS (SELECT k, unnest(w) AS word, unnest(range(len(w))) AS pos FROM it),
ws AS (SELECT k, n, s, array_to_string(list_slice(w, s + 1, s + n), ' ') AS p
       FROM (SELECT k, w, least(len(w), 10) AS n, unnest(range(greatest(len(w) - 9, 1))) AS s FROM it)),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM d),
sh AS (SELECT DISTINCT doc_id, k, place - pos + delta AS t, pos FROM dw JOIN iw USING (word), (SELECT unnest(range(-2, 3)) AS delta)),
st AS (SELECT doc_id, k, t, list(pos) AS stand FROM sh GROUP BY doc_id, k, t),
ne AS (SELECT doc_id, count(DISTINCT p) AS n_near FROM st JOIN ws USING (k)
       WHERE len(stand) >= n - n // 5 AND len(list_filter(stand, lambda x: x >= s AND x < s + n)) >= n - n // 5 GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(n_near, 0)::BIGINT AS n_near
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN ne USING (doc_id)
"""
