"""Best-fit packing of tokenised documents into sequences of a fixed length.

Tokenise, cut what is longer than a sequence, then place each piece by bounded-space online best-fit: a
fixed number of open bins, a bitset keyed by free space that finds the tightest bin in one step; when no
bin fits and all are open, the fullest closes.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LENGTH = 4096
END_ID = 1
#: Open bins in each packing task, and pieces of a block. Blocks come one after the other, each largest first: about as many bins as a block's
#: pieces fill must be open for its small pieces to find room beside its large ones, and what is left is for the next blocks.
OPEN_BINS, BLOCK = 1_024, 4_000
#: Pieces for one packing task: about a second of work.
PIECES_A_TASK = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long"

#: Texts made of these only are split here as the tokenizer's own rules do: normal form C and lower case change one character at
#: a time in them. Printable ASCII, common white space, Latin letters up to U+017F that lower to one.
PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-įı-ňŊ-ſ]*")
#: The vocabulary's own splitting rule, for such texts in lower case.
PART = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^\\sa-z0-9ß-öø-ſ]+")
SPECIAL = "<|"


class Parts(dict):
    """Ids, packed, of each part of a plain word in lower case: the vocabulary's merges over the part's bytes."""

    def __init__(self, tokenizer, most: int):  # noqa: ANN001
        super().__init__()
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.model, self.most = tokenizer, tokenizer.model, most
        self.byte_level = ByteLevel(add_prefix_space=False, use_regex=False)

    def whole(self, text: str) -> bytes:
        """By the library from end to end."""
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        visible = part if part.isascii() else "".join(x for x, _ in self.byte_level.pre_tokenize_str(part))
        ids = [x.id for x in self.model.tokenize(visible)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(part) <= 64 and len(self) < self.most:
            self[part] = out
        return out


class Words(dict):
    """Ids, packed, of what stands between blanks. White space parts the tokenizer's words, so a text's ids are its words' ids joined."""

    def __init__(self, parts: Parts, most: int):
        super().__init__({"": b""})
        self.parts, self.most = parts, most

    def __missing__(self, word: str) -> bytes:
        out = b"".join(map(self.parts.__getitem__, PART.findall(word.lower()))) if PLAIN.fullmatch(word) and SPECIAL not in word else self.parts.whole(word)
        if len(word) <= 64 and len(self) < self.most:
            self[word] = out
        return out


@functools.cache
def words(path: str) -> Words:
    """One for a Python worker, as large as its two bounds allow (about 60 MB)."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Words(Parts(Tokenizer.from_file(path), 200_000), 200_000)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_ids(text: str, vocabulary: str) -> bytes:
    """Ids of ``text`` as little-endian unsigned 32-bit numbers, with no end mark."""
    return b"".join(map(words(vocabulary).__getitem__, text.replace("\n", " ").split(" ")))


def pieces(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """The pieces of each document: its ids and the end mark, cut every ``length`` ids.

    A null or empty text is the end mark alone. Repeated rows are documents of their own. No shuffle.
    """
    vocabulary = vocabulary or default_vocabulary()
    end = struct.pack("<I", end_id)

    def rows(batch: list) -> Iterable[tuple]:
        for doc_id, text in batch:
            ids = token_ids(text or "", vocabulary) + end
            for piece, at in enumerate(range(0, len(ids), 4 * length)):
                part = ids[at : at + 4 * length]
                yield doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)

    return common.map_rows(docs.select("doc_id", "text"), rows, PIECES)


class BestFit:
    """Open bins by free space. ``place`` returns (bin, offset) of a piece."""

    def __init__(self, length: int, most: int):
        self.length, self.most, self.open, self.made = length, most, 0, 0
        self.bits = 0  # bit f: there's an open bin with f free
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def pop(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        self.open -= 1
        if not stack:
            self.bits ^= 1 << free
        return number

    def place(self, size: int) -> tuple[int, int]:
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self.pop(free)
        else:
            if self.open >= self.most:
                self.pop((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            free, number = self.length, self.made
            self.made += 1
        if left := free - size:
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.length - free


def pack(rows: DataFrame, tasks: int, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Place pieces (of ``PIECES``) into sequences; each of ``tasks`` tasks fills sequences of its own.

    Pieces are dealt out evenly, whichever are equal, and in a task by a hash to blocks, so that each sees a like mix of sizes whatever the
    order of the input; in a block the largest come first. A task's number is the upper part of its sequences' ids.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PACKED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 40
        fit = BestFit(length, open_bins)
        for batch in batches:
            placed = [fit.place(size) for size in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + n for n, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())], schema=schema)

    mark = F.xxhash64("doc_id", "piece", "ids_crc32", F.lit("block"))
    order = [F.pmod(mark, F.lit(max(1, PIECES_A_TASK // BLOCK))), F.desc("length"), mark, "doc_id", "piece"]
    return rows.repartition(tasks).sortWithinPartitions(*order).mapInArrow(run, PACKED)


def packed(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenise and pack: one row a piece with its place.

    A null or empty text is the end mark alone; repeated rows are packed each; an empty table gives no rows.
    Lost tasks are computed again with the same result, for Spark deals out rows in the order of their hashes, and the order here follows their values.
    """
    n = common.input_rows(docs)
    # a document is one piece, and one more for each sequence it fills, of at least four bytes a token in most texts; a task has a thousand documents at least
    tasks = 1 + min(n // 1_000, (n + common.planned_bytes(docs) // (4 * length)) // PIECES_A_TASK)
    return pack(pieces(docs, vocabulary, length, end_id), tasks, length, open_bins)
