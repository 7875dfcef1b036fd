"""Harmonic packing: pieces are classed by reciprocal capacity, a class's bin holds a fixed number of them.

Class ``j`` takes the pieces whose length is in ``(capacity / (j + 1), capacity / j]``; its bins hold ``j``
pieces. The longer part of a document is first cut at halves of the capacity (whole, 1/2, 1/4 ... down to
``granule``), whose bins are filled without a gap; only the rest, shorter than ``granule``, is packed by its
own length. Each worker packs its own partition: nothing is shuffled or shared. Bins that are still open
when a partition ends are emptied into full sequences, and the last of these is cut into powers of two,
which need no padding.
"""

from __future__ import annotations

import os
import re
import string
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

from footstats.llm.common import map_rows

SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
#: Distinct words and word cores whose ids a task remembers.
MEMO_WORDS = 400_000
#: Marks that the tokenizer keeps apart from the letters before them.
_MARKS = "".join(c for c in string.punctuation if c != "'")

#: The byte-level alphabet: bytes that print stand for themselves, the others for letters from 256 on.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}


def token_encoder(tokenizer_file: str, end_id: int):
    """text -> its ids and the end id, as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and never joins words across it, nor letters with the marks after them.
    So ids are looked up word by word, and by letters and marks; letters in lower case go straight to the
    tokenizer's model, as its other steps leave them as they are. All else it encodes whole.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task its core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file)
    model = tokenizer.model
    words: dict[str, bytes] = {}
    cores: dict[str, bytes] = {"": b""}
    end = struct.pack("<I", end_id)
    # White space for str.split() alone: such texts are encoded whole.
    only_python = re.compile("[\x1c-\x1f]")

    def packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def core(part: str) -> bytes:
        found = cores.get(part)
        if found is None:
            if part.isascii() and part.isalpha():
                found = packed([t.id for t in model.tokenize(part)])
            elif part.isalpha() and part == part.lower() and unicodedata.is_normalized("NFC", part):
                found = packed([t.id for t in model.tokenize(part.encode().decode("latin-1").translate(_BYTE_LETTERS))])
            else:
                found = packed(tokenizer.encode(part, add_special_tokens=False).ids)
            cores[part] = found
        return found

    def word_ids(word: str) -> bytes:
        letters = word.rstrip(_MARKS)
        if len(letters) < len(word) and letters.isalpha():
            return core(letters.lower() if letters.isascii() else letters) + core(word[len(letters) :])
        return core(word.lower() if word.isascii() and word.isalpha() else word)

    def encode(text: str | None) -> bytes:
        if not text:
            return end
        if only_python.search(text):
            return packed(tokenizer.encode(text, add_special_tokens=False).ids) + end
        if len(words) > MEMO_WORDS or len(cores) > MEMO_WORDS:
            words.clear()
            cores.clear()
            cores[""] = b""
        parts = text.split()
        try:
            return b"".join(map(words.__getitem__, parts)) + end
        except KeyError:
            for word in parts:
                if word not in words:
                    words[word] = word_ids(word)
        return b"".join(map(words.__getitem__, parts)) + end

    return encode


def cut_lengths(total: int, capacity: int, granule: int) -> list[int]:
    """Lengths of a document's pieces: whole capacities, then halves of it, then a rest below ``granule``."""
    whole, rest = divmod(total, capacity)
    out, size = [capacity] * whole, capacity // 2
    while size >= granule:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * (rest > 0)


def pack_documents(
    docs: DataFrame, tokenizer_file: str, capacity: int = 2048, granule: int = 128, end_id: int = 1,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    ``capacity`` and ``granule`` are powers of two. Null or empty text is a document of the end id alone.
    Rows with equal ids or texts are documents of their own. Other columns are not read. An empty table
    gives no rows. ``sequence_id`` is unique over the table (partition number and count). A worker holds
    only what its open bins hold: less than one sequence for each class.
    """
    narrow = docs.selectExpr(f"CAST(`{id_col}` AS LONG) AS doc_id", f"`{text_col}` AS text")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = token_encoder(tokenizer_file, end_id)
        base, made = TaskContext.get().partitionId() << 40, 0
        # class -> pieces of its open bin: (doc_id, start, length, ids, tokens of the document)
        bins: dict[int, list[tuple]] = {}
        rows: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal made
            at = 0
            for doc_id, start, length, ids, tokens in pieces:
                rows.append((doc_id, start, length, zlib.crc32(ids), tokens, base + made, at))
                at += length
            made += 1

        def table() -> pd.DataFrame:
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                ids = encode(text)
                tokens, start = len(ids) // 4, 0
                for length in cut_lengths(tokens, capacity, granule):
                    piece = (doc_id, start, length, ids[4 * start : 4 * (start + length)], tokens)
                    start += length
                    fits = capacity // length
                    pieces = bins.setdefault(fits, [])
                    pieces.append(piece)
                    if len(pieces) == fits:
                        close(bins.pop(fits))
            yield table()

        # What is left, in order, cut at each full sequence and at last at powers of two.
        left = [p for fits in sorted(bins) for p in bins[fits]]
        rest, sequence, room = sum(p[2] for p in left), [], 0
        for doc_id, start, length, ids, tokens in left:
            while length:
                if not room:
                    room = capacity if rest >= capacity else 1 << (rest.bit_length() - 1)
                take = min(length, room)
                sequence.append((doc_id, start, take, ids[: 4 * take], tokens))
                start, length, ids, room, rest = start + take, length - take, ids[4 * take :], room - take, rest - take
                if not room:
                    close(sequence)
                    sequence = []
        yield table()

    return map_rows(narrow, pack, SCHEMA).withColumnRenamed("doc_id", id_col)
