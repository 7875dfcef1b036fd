"""Similarity join on word shingles: a blocked product of the sparse document by shingle matrix with itself.

Only products that can reach the threshold are formed. Documents with equal sets are one row. With the
shingles in one global order (common ones last), two rows that link must share a shingle among the first
``n - ceil(t n) + 1`` of either, so a column block holds the rows that have its shingle there, in parts
between whose sizes no link can reach. Parts of few pairs give them, their shared leading shingles are counted;
a pair goes on only if that count and what may follow can reach the overlap its sizes demand. Parts of many
pairs are joined into groups, cut into tiles of rows of similar size, and each pair of tiles whose sizes can
link is multiplied on its own. Nothing is capped or sampled: every link between two different sets is found,
and a group of near copies never gives all its pairs as rows.

On disk a leading shingle takes five bytes of its hash, and the entries of a block travel packed: shingles that
agree in these bytes only share a block, which adds candidates and loses none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footstats.llm.common import cut, map_rows, remove, written

#: Rows of a column block up to which its pairs are listed (of more rows, where sizes leave as few pairs a row), and rows of a tile.
PAIR_ROWS, TILE_ROWS = 128, 512
#: Entries of column blocks that a task sorts (about), that are packed at once, and pairs that are listed at once.
BLOCK_ENTRIES, PACKED_ENTRIES, LISTED_PAIRS = 150_000, 400_000, 200_000
#: Shingles of the product that are multiplied at once.
TILE_COLUMNS = 4096
#: Rows sent to tiles up to which their ids are broadcast to the texts; more meet them in a shuffle.
BROADCAST_ROWS = 1_000_000
#: Documents (at least, and as a share) and shingles that decide which shingles come last in the order. The order changes the work, not the links.
ORDER_DOCUMENTS, ORDER_SHARE, ORDER_SHINGLES, ORDER_TIMES = 40_000, 0.03, 2_000_000, 32
#: Documents whose shingles are counted at once.
ORDER_BATCH = 500
#: Words whose hashes a task remembers.
MEMO_WORDS = 500_000

#: An entry of a column block: five bytes of the shingle's hash, the set and its size.
ENTRY = np.dtype([("s", "u1", 5), ("set_id", "<i8"), ("n", "<u4")])

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Shingler:
    """text -> sorted distinct 64-bit hashes of its word shingles."""

    def __init__(self, width: int):
        self.width = width
        self.memo: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        memo = self.memo
        if len(memo) > MEMO_WORDS:
            memo.clear()
        for w in words:
            if w not in memo:
                memo[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        n = len(h) - width + 1
        out = np.full(n, width, np.uint64)
        for k in range(width):
            out = (out ^ h[k : k + n]) * _A
            out ^= out >> np.uint64(29)
        return np.unique((out * _B) ^ (out >> np.uint64(32)))


def prefix_length(n, percent: int):
    return n - (percent * n + 99) // 100 + 1


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def common_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, times): those that many documents hold, by a share of the documents (sorted, bounded in number)."""
    total = docs.count()
    share = min(1.0, max(ORDER_DOCUMENTS / max(total, 1), ORDER_SHARE))
    times = max(3, int(ORDER_TIMES * share))

    def list_all(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = Shingler(width)
        for batch in batches:
            for at in range(0, len(batch), ORDER_BATCH):
                values = [shingles(t) for t in batch["text"][at : at + ORDER_BATCH]]
                keys, n = np.unique(np.concatenate(values), return_counts=True)
                yield pd.DataFrame({"s": _signed(keys), "n": n})

    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000)) < int(share * 1_000_000)).select("text")
    counts = cut(some.mapInPandas(list_all, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= times))
    least = kept = 0
    for n, shingles in sorted(map(tuple, counts.groupBy("n").count().collect()), reverse=True):
        if kept + shingles > ORDER_SHINGLES:
            break
        least, kept = n, kept + shingles
    top = counts.where(F.col("n") >= least if kept else F.lit(False)).toArrow()
    keys = top["s"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(keys)
    return keys[order], top["n"].to_numpy().astype(np.int64)[order]


def leading(shingles: np.ndarray, last: np.ndarray, times: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the global order: by how common they are, then by hash."""
    if len(last):
        at = np.minimum(np.searchsorted(last, shingles), len(last) - 1)
        common = last[at] == shingles
        late = np.argsort(times[at[common]], kind="stable")
        shingles = np.concatenate([shingles[~common], shingles[common][late]])
    return shingles[: prefix_length(len(shingles), percent)]


def pack_entries(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """(set_id, n, lead) -> (part, entries): the leading shingles as entries, those of a part of the hashes in a row."""

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        times = pc.binary_length(table["lead"]).to_numpy() // 5
        entries = np.empty(times.sum(), ENTRY)
        entries["s"] = np.frombuffer(b"".join(table["lead"].to_pylist()), np.uint8).reshape(-1, 5)
        entries["set_id"] = np.repeat(table["set_id"].to_numpy(), times)
        entries["n"] = np.repeat(table["n"].to_numpy(), times)
        part = entry_hashes(entries) % parts
        order = np.argsort(part, kind="stable")
        entries, part = entries[order], part[order]
        found, starts = np.unique(part, return_index=True)
        ends = [*starts[1:], len(entries)]
        return pa.RecordBatch.from_arrays(
            [pa.array(found.astype(np.int32)), pa.array([entries[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())], ["part", "entries"]
        )

    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            held.append(batch.slice(at, 1000))
            size += pc.sum(pc.binary_length(held[-1].column("lead"))).as_py() // 5
            if size >= PACKED_ENTRIES:
                yield pack(held)
                held, size = [], 0
    if size:
        yield pack(held)


def entry_hashes(entries: np.ndarray) -> np.ndarray:
    """The five bytes of each entry's hash as a number."""
    wide = np.zeros((len(entries), 8), np.uint8)
    wide[:, :5] = entries["s"]
    return wide.view("<i8")[:, 0]


def list_pairs(entries: np.ndarray, percent: int, pair_rows: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, na, nb) of whole column blocks: pairs of sets that share a shingle and whose sizes can link, a row for each
    shared shingle. Sets of a part with too many pairs are paired with the least of them, both sizes given as 0."""
    s, n = entry_hashes(entries), entries["n"].astype(np.int64)
    order = np.lexsort((n, s))
    s, n, ids = s[order], n[order], entries["set_id"][order]
    alone = np.ones(len(s), bool)
    alone[1:] &= s[1:] != s[:-1]
    alone[:-1] &= s[1:] != s[:-1]
    s, n, ids = s[~alone], n[~alone], ids[~alone]
    if not len(s):
        return
    # Of each row the rows that follow in its block and are not too large; no link spans two parts.
    block = np.cumsum(np.r_[True, s[1:] != s[:-1]])
    span = max(int(n.max()) + 1, 1)
    end = np.searchsorted(block * span + n, block * span + np.minimum(100 * n // percent, span - 1), side="right")
    follow = end - np.arange(len(n)) - 1
    first = np.flatnonzero(np.r_[True, follow[:-1] == 0])
    rows = np.diff(np.r_[first, len(n)])
    many = 2 * np.add.reduceat(follow, first) > pair_rows * rows
    chained = np.repeat(many, rows)
    head = np.repeat(np.minimum.reduceat(ids, first), rows)
    star = chained & (ids != head)
    zero = np.zeros(star.sum(), np.int64)
    yield head[star], ids[star], zero, zero
    follow = np.where(chained, 0, follow)
    done = np.cumsum(follow)
    start = 0
    while start < len(n):
        before = done[start] - follow[start]
        stop = max(int(np.searchsorted(done, before + LISTED_PAIRS, side="right")), start + 1)
        times = follow[start:stop]
        left = np.repeat(np.arange(start, stop), times)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        left, right = np.where(ids[left] < ids[right], left, right), np.where(ids[left] < ids[right], right, left)
        other = ids[left] != ids[right]
        left, right = left[other], right[other]
        yield ids[left], ids[right], n[left], n[right]
        start = stop


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates stars around the smaller and the larger end of each edge until nothing changes; only row
    counts and a checksum come to the driver. A node with very many edges is split by adaptive execution.
    """
    spark = edges.sparkSession
    now, path = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large, middle = written(both.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        remove(spark, path)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        now, path = written(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        )
        remove(spark, middle)
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        state = new


def set_number(shingles: np.ndarray) -> int:
    """64-bit hash of a set, as a signed number."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def tile_links(ids: np.ndarray, values: list[np.ndarray], tile: np.ndarray, same: bool, percent: int) -> list[tuple[int, int]]:
    """Links between the rows of two tiles that join all that their product joins (a spanning forest)."""
    sizes = np.array([len(v) for v in values])
    rows = np.repeat(np.arange(len(ids)), sizes)
    _, columns, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
    shared = times[columns] > 1  # a shingle of one row alone adds to no overlap
    rows, columns = rows[shared], np.unique(columns[shared], return_inverse=True)[1]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    left = np.arange(len(ids)) if same else np.flatnonzero(tile == tile.min())
    right = left if same else np.flatnonzero(tile != tile.min())
    overlap = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(columns[-1]) + 1 if len(columns) else 0, TILE_COLUMNS):
        a, b = np.searchsorted(columns, [start, start + TILE_COLUMNS])
        block = np.zeros((len(ids), TILE_COLUMNS), np.float32)
        block[rows[a:b], columns[a:b] - start] = 1
        overlap += block[left] @ block[right].T
    union = sizes[left][:, None] + sizes[right][None, :] - overlap
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(100 * overlap >= percent * union)):
        x, y = root(int(left[i])), root(int(right[j]))
        if x != y:
            parent[x] = y
            out.append((int(ids[left[i]]), int(ids[right[j]])))
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """64-bit hash of id and text: tells rows apart where ids are null or repeated."""
    return F.xxhash64(id_col, text_col)


def similar_rows(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """((doc_id, key, n, set_id) of each row, (set_id, doc_id, root) of each set): rows link as ``similarity_classes`` says.

    ``key`` is the ``row_key``, ``n`` the size of the row's set, ``root`` names the class; rows without shingles have no set.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    spark = docs.sparkSession
    late = spark.sparkContext.broadcast(common_shingles(rows, width))

    def outline(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, (last, times) = Shingler(width), late.value
        for batch in batches:
            sizes, sets, leads = [], [], []
            for text in batch["text"]:
                s = shingles(text)
                sizes.append(len(s))
                sets.append(set_number(s) if len(s) else None)
                # A set of few shingles links with no other: one shingle more or less is too much.
                links = 100 * len(s) >= percent * (len(s) + 1)
                leads.append(leading(s, last, times, percent).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes() if links else None)
            yield pd.DataFrame({
                "doc_id": batch["doc_id"], "key": batch["key"], "n": sizes, "set_id": pd.array(sets, "Int64"), "lead": pd.Series(leads, dtype=object),
            })

    outlined, wide = written(map_rows(rows, outline, "key long, n int, set_id long, lead binary"))
    sets = cut(outlined.where("set_id IS NOT NULL").groupBy("set_id", "n").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key")))

    # Leading shingles, once for each set; then those of the rows go.
    leads, narrow = written(outlined.where("lead IS NOT NULL").select("set_id", "n", "lead").dropDuplicates(["set_id"]))
    outlined = cut(outlined.drop("lead"))
    remove(spark, wide)

    # Column blocks: the entries of a shingle meet in one task, packed, and leave as pairs.
    entries = leads.agg(F.sum(F.expr(f"n - floor(({percent} * n + 99) / 100) + 1"))).first()[0] or 0
    pair_rows = PAIR_ROWS
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(entries) // BLOCK_ENTRIES))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return pack_entries(batches, 4 * parts)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for batch in batches for x in batch.column("entries").to_pylist()]
        if found:
            for columns in list_pairs(np.frombuffer(b"".join(found), ENTRY), percent, pair_rows):
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["a", "b", "na", "nb"])

    packed = leads.mapInArrow(pack, "part int, entries binary").repartition(parts, "part")
    lead = {x: F.expr(f"{x} - floor(({percent} * {x} + 99) / 100) + 1") for x in ("na", "nb")}
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent))
    reach = F.col("shared") + F.greatest(F.col("na") - lead["na"], F.col("nb") - lead["nb"]) >= need
    pairs, candidates = written(
        packed.mapInArrow(pair, "a long, b long, na long, nb long").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
        .where((F.col("na") == 0) | reach).select("a", "b")
    )
    remove(spark, narrow)

    # Rows that these hold together form groups. Large ones are cut by size, so that links lie in a class of sizes or between
    # two neighbours, and the classes into tiles.
    groups = components(pairs)
    remove(spark, candidates)
    step = max(math.log(100 / percent), 1e-6) * (1 + 1e-9)
    large = groups.groupBy("root").agg(F.count("*").alias("rows")).where("rows > 1")
    sized, members_folder = written(groups.join(large, "root").join(sets, F.col("node") == F.col("set_id")).select(
        "set_id", "key", "root",
        F.when(F.col("rows") > TILE_ROWS, F.floor(F.log("n") / step)).otherwise(0).cast("long").alias("class"),
    ))
    classes = sized.groupBy("root", "class").agg(F.ceil(F.count("*") / TILE_ROWS).cast("int").alias("tiles"))
    around = classes.select(
        "root", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"), F.struct("class", "tiles").alias("near"),
    ).groupBy("root", "class").agg(F.collect_list("near").alias("near"))
    own = F.filter("near", lambda x: x["class"] == F.col("class"))[0]["tiles"]
    number = F.col("class") * (1 << 24)
    others = F.flatten(F.transform("near", lambda x: F.transform(F.sequence(F.lit(0), x["tiles"] - 1), lambda i: x["class"] * (1 << 24) + i)))
    members = cut(sized.join(around, ["root", "class"]).select(
        "key", "root", (number + F.pmod(F.xxhash64("set_id", F.lit(5)), own)).alias("tile"), others.alias("others")
    ))
    remove(spark, members_folder)

    # Texts of the rows that are left go to the pairs of tiles they are part of; whole sets are made there.
    if (members.agg(F.sum(F.size("others"))).first()[0] or 0) <= BROADCAST_ROWS:
        members = F.broadcast(members)
    texts, texts_folder = written(rows.join(members, "key").select("key", "text", "root", "tile", "others").dropDuplicates(["key"]))
    dealt = texts.select("text", "root", "tile", F.explode("others").alias("other")).select(
        "root", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "text"
    )

    def multiply(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        shingles = Shingler(width)
        values = [shingles(t) for t in group["text"]]
        ids = np.array([set_number(v) for v in values], np.int64)
        links = tile_links(ids, values, group["tile"].to_numpy(), key[1] == key[2], percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    linked = components(dealt.groupBy("root", "lo", "hi").applyInPandas(multiply, "a long, b long"))
    remove(spark, texts_folder)

    named = sets.join(linked, sets["set_id"] == linked["node"], "left").select(
        "set_id", "doc_id", F.coalesce("root", "set_id").alias("root")
    )
    return outlined.select("doc_id", "key", "n", "set_id"), named


def similarity_classes(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: ``n_shingles`` and ``component_id``, the smallest id that links reach.

    Two documents link when the overlap of their sets of ``width``-word shingles is at least ``percent``
    hundredths of the union. Words lie between ASCII white space, A-Z in lower case; fewer words than
    ``width`` are one shingle. Null, empty or blank text: no shingle, linked with nothing, its own class.
    Repeated rows stand in one class; rows with one id but other texts are told apart, also where that id is null:
    null ids link like others, and only a class of null ids alone has a null ``component_id``. Shingles, sets and
    rows are told by 64-bit hashes. An empty table has no rows. Other columns aren't read.
    """
    outlined, named = similar_rows(docs, width, percent, id_col, text_col)
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    classes = named.select("set_id", "root").join(smallest, "root").select("set_id", "component_id")
    return outlined.join(classes, "set_id", "left").select(
        F.col("doc_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS g
      FROM (SELECT *, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0) GROUP BY ALL),
sets AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS h FROM s GROUP BY doc_id),
reps AS MATERIALIZED (SELECT h, min(doc_id) AS doc_id, any_value(n) AS n FROM sets GROUP BY h),
r AS MATERIALIZED (SELECT s.doc_id, n, g FROM s JOIN reps USING (doc_id)),
p AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS MATERIALIZED (SELECT x, y FROM p UNION SELECT y, x FROM p),
c(doc_id, c) AS (SELECT doc_id, doc_id FROM reps UNION SELECT e.y, c.c FROM c JOIN e ON e.x = c.doc_id WHERE c.c < e.y),
best AS (SELECT doc_id, min(c) AS c FROM c GROUP BY doc_id)
SELECT w.doc_id, coalesce(sets.n, 0)::BIGINT AS n_shingles, coalesce(best.c, w.doc_id) AS component_id
FROM w LEFT JOIN sets USING (doc_id) LEFT JOIN reps USING (h) LEFT JOIN best ON best.doc_id = reps.doc_id
"""
