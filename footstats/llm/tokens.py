"""Token counts under edits: a segment tree over the pre-tokens of each document.

The leaves are pre-tokens with their characters and tokens; the inner nodes hold sums. An edit splits again
only the pre-tokens it touches and those next to it, until a border of the new split meets a border of the
old one behind the edit; from there on the old leaves hold, as a split depends only on what follows. The
tokens of the replaced leaves are counted, and the sums above them updated.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footstats.llm.common import map_rows

#: Fixed value: how the vocabulary's tokenizer splits a text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that a split looks beyond a pre-token's end (white space before a word, "'l" before an "l").
LOOKAHEAD = 2
#: Pre-tokens of a leaf block; pre-tokens whose count a task remembers.
BLOCK, MEMO = 64, 500_000

_PATTERN = regex.compile(SPLIT)


def token_counter(ranks_file: str) -> Callable[[str], int]:
    """pre-token -> its number of tokens under a byte-level vocabulary (file of base64 tokens and ranks)."""
    import tiktoken

    with open(ranks_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    memo: dict[str, int] = {}

    def count(part: str) -> int:
        n = memo.get(part)
        if n is None:
            if len(memo) > MEMO:
                memo.clear()
            n = len(encoding.encode_ordinary(part))
            if len(part) <= 64:
                memo[part] = n
        return n

    return count


class TokenTree:
    """Pre-tokens of one text as blocks of leaves under a binary tree of sums."""

    def __init__(self, text: str, count: Callable[[str], int]):
        self.text, self.count = text, count
        parts = _PATTERN.findall(text)
        self.encoded = len(parts)
        leaves = [(len(p), count(p)) for p in parts]
        self._plant([leaves[i : i + BLOCK] for i in range(0, len(leaves), BLOCK)])

    def _plant(self, blocks: list[list[tuple[int, int]]]) -> None:
        self.blocks = blocks
        self.width = 1 << max(0, (len(blocks) - 1).bit_length())
        self.chars, self.tokens, self.parts = ([0] * (2 * self.width) for _ in range(3))
        for i, block in enumerate(blocks):
            self._sum(i, block)
        for node in range(self.width - 1, 0, -1):
            self._lift(node)

    def _sum(self, i: int, block: list[tuple[int, int]]) -> None:
        at = self.width + i
        self.chars[at], self.tokens[at], self.parts[at] = sum(c for c, _ in block), sum(t for _, t in block), len(block)

    def _lift(self, node: int) -> None:
        for sums in (self.chars, self.tokens, self.parts):
            sums[node] = sums[2 * node] + sums[2 * node + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def pretokens(self) -> int:
        return self.parts[1]

    def locate(self, at: int) -> tuple[int, int, int]:
        """(block, leaf, first character) of the pre-token that holds character ``at``; beyond the text, what would follow."""
        if at >= self.chars[1]:
            return len(self.blocks), 0, self.chars[1]
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        block = node - self.width
        for leaf, (chars, _) in enumerate(self.blocks[block]):
            if at < start + chars:
                return block, leaf, start
            start += chars
        raise AssertionError("sums and leaves differ")

    def edit(self, start: int, end: int, new: str) -> None:
        """Replaces the characters from ``start`` to ``end`` (cut to the text) by ``new``."""
        size = len(self.text)
        start = min(max(start, 0), size)
        end = min(max(end, start), size)
        first_block, first_leaf, begin = self.locate(max(0, start - LOOKAHEAD))
        if begin > start:
            begin = start
        self.text = self.text[:start] + new + self.text[end:]
        shift, settled = len(new) - (end - start), start + len(new)
        leaves, at = [], begin
        last_block, last_leaf = len(self.blocks), 0
        for m in _PATTERN.finditer(self.text, begin):
            if at >= settled:
                block, leaf, old = self.locate(at - shift)
                if old == at - shift:
                    last_block, last_leaf = block, leaf
                    break
            leaves.append((m.end() - at, self.count(m.group())))
            at = m.end()
        self.encoded += len(leaves)
        self._splice(first_block, first_leaf, last_block, last_leaf, leaves)

    def _splice(self, b1: int, l1: int, b2: int, l2: int, leaves: list[tuple[int, int]]) -> None:
        """Puts ``leaves`` in place of those from (b1, l1) up to, not with, (b2, l2)."""
        head = self.blocks[b1][:l1] if b1 < len(self.blocks) else []
        tail = self.blocks[b2][l2:] if b2 < len(self.blocks) else []
        merged = head + leaves + tail
        if b1 == b2 < len(self.blocks) and 0 < len(merged) <= 2 * BLOCK:
            self.blocks[b1] = merged
            self._sum(b1, merged)
            node = (self.width + b1) // 2
            while node:
                self._lift(node)
                node //= 2
            return
        # Several blocks change: new ones take their place, and the tree above is summed again.
        new = [merged[i : i + BLOCK] for i in range(0, len(merged), BLOCK)]
        self._plant(self.blocks[:b1] + new + self.blocks[b2 + 1 :])


def count_edited_tokens(
    docs: DataFrame, ranks_file: str, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits"
) -> DataFrame:
    """One row per document: tokens before and after its edits, and how much was encoded for them.

    ``edits_col``: array<struct<start, end, new>>, applied in order, each in characters of the text as the
    one before left it; places outside the text are cut to it. Null text is empty, null edits and null
    members of an edit change nothing. Columns: tokens_before, tokens_after, pretokens, n_edits, reencoded
    (pre-tokens encoded for the edits), n_chars. Repeated rows are counted each; other columns aren't read.
    A map over rows: a document's tree lives in one row's task only.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(edits_col).alias("edits"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(ranks_file)
        for batch in batches:
            out = []
            for doc_id, text, edits in zip(batch["doc_id"], batch["text"], batch["edits"]):
                tree = TokenTree(text or "", count)
                before, encoded, n = tree.total, tree.encoded, 0
                for e in edits if edits is not None else ():
                    if e is not None and e["start"] is not None and e["end"] is not None and e["new"] is not None:
                        tree.edit(int(e["start"]), int(e["end"]), e["new"])
                        n += 1
                out.append((doc_id, before, tree.total, tree.pretokens, n, tree.encoded - encoded, len(tree.text)))
            yield pd.DataFrame(out, columns=["doc_id", "tokens_before", "tokens_after", "pretokens", "n_edits", "reencoded", "n_chars"])

    return map_rows(
        narrow, run, "tokens_before long, tokens_after long, pretokens long, n_edits long, reencoded long, n_chars long"
    ).withColumnRenamed("doc_id", id_col)


def editorial_edits(text):
    """A usual revision of a text as edits, the last place first: a closing line, a filler in the middle, no first sentence."""
    size = F.length(text)
    middle, first = (size / 2).cast("int"), F.locate(". ", text)

    def edit(start, end, new: str):
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(new).alias("new"))

    return F.array(
        edit(size, size, "\nThe end."), edit(middle, middle + 12, " and so on 2024"), edit(F.lit(0), first, ""), edit(F.lit(0), F.lit(0), "# Notes\n")
    )
