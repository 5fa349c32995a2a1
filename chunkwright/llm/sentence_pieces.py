"""SentencePiece encoding and decoding, with giant documents split over tasks by max-plus transfer matrices.

The vocabulary is a BPE model, whose encoding has a local test: a sequence of pieces is the encoding of its
text just when each two neighbours are the encoding of theirs (merges go by score, then from the left, and until a
merge crosses the border of two pieces, neither side knows of the other). So the encoding is the one path of weight
0 in a lattice of pieces where two neighbours weigh 0 if they pass the test and minus infinity otherwise.

A document of more than CHUNK characters is cut there, in the middle of a word or not. For each chunk a
max-plus transfer matrix tells from which pieces over its left border which pieces over its right border are
reached; as all weights are 0 or minus infinity, a row is a set of bits. The matrices are combined as a scan over blocks: those of BLOCK chunks
are multiplied in a task of their own, as a tree (the product is associative); from a document's products come the pieces
over its blocks' borders; from these, again block by block, those over each chunk's; and each chunk then traces its own path back.
Where no piece can span a place (before a blank that follows something else) all paths meet, and between the first and
the last such place of a chunk the library encodes the text.
"""

from __future__ import annotations

import functools
import zlib
from collections import defaultdict
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

CHUNK = 1 << 14
#: Chunks whose matrices one task multiplies.
BLOCK = 64
BLANK = "▁"
#: The state before a document: a piece of no length.
START = (0, 0, -1)


class Vocabulary:
    """The library's model and its pieces."""

    #: Pairs that have been tested, at most.
    MOST = 200_000

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        spec = model.normalizer_spec
        pieces = [(p.piece, p.score, i) for i, p in enumerate(model.pieces) if p.type == pb.ModelProto.SentencePiece.NORMAL]
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces:
            raise ValueError("this needs a BPE model that keeps texts as they are and puts a blank before them")
        if any(BLANK in p.lstrip(BLANK) for p, _, _ in pieces):
            raise ValueError("this needs a vocabulary with blanks at the start of pieces only")
        self.ids = {p: i for p, _, i in pieces}
        self.names = {i: p for p, _, i in pieces}
        self.scores = {p: s for p, s, _ in pieces}
        self.longest = max(map(len, self.ids))
        self.letter = next(i for p, _, i in pieces if p.isascii() and p.isalpha())
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.tested: dict[tuple[str, str], bool] = {}

    def parts(self, text: str) -> list[str]:
        """The pieces of a short escaped text, by merging the best pair again and again."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def neighbours(self, a: str, b: str) -> bool:
        ok = self.tested.get((a, b))
        if ok is None:
            ok = self.parts(a + b) == [a, b]
            if len(self.tested) < self.MOST:
                self.tested[a, b] = ok
        return ok

    def starting(self, text: str, at: int) -> list[str]:
        """Pieces that the text has from ``at``; a character that is no piece stands for itself."""
        found = [text[at : at + n] for n in range(1, min(self.longest, len(text) - at) + 1) if text[at : at + n] in self.ids]
        return found if text[at] in self.ids else [text[at], *found]

    def numbers(self, piece: str) -> list[int]:
        number = self.ids.get(piece)
        return [self.bytes[b] for b in piece.encode()] if number is None else [number]


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def escaped(text: str) -> str:
    """The text as the model sees it; an empty one stays so."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def clear(text: str, at: int) -> bool:
    """No piece can span the place before ``text[at]``."""
    return text[at] == BLANK and at > 0 and text[at - 1] != BLANK


def over_border(vocab: Vocabulary, text: str, border: int) -> list[tuple[int, int]]:
    """All pieces, as (start, end), that hold the character before ``border`` and may go beyond it."""
    found = []
    for start in range(max(0, border - vocab.longest), border):
        found += [(start, start + len(p)) for p in vocab.starting(text, start) if start + len(p) >= border]
    return found


def clear_stretch(text: str, low: int, high: int) -> tuple[int, int] | None:
    """First and last clear place in ``low`` to ``high``, if there are two."""
    first = next((i for i in range(max(low, 1), high) if clear(text, i)), None)
    if first is None:
        return None
    last = next(i for i in range(high - 1, first - 1, -1) if clear(text, i))
    return (first, last) if last > first else None


def paths(vocab: Vocabulary, text: str, low: int, high: int, entries: list[tuple[int, int]]) -> tuple[dict, dict]:
    """Forward pass from pieces over ``low`` to pieces over ``high``.

    Returns the bits of ``entries`` that reach each piece over ``high``, and for each piece the pieces before it on a way
    from some entry. A piece is (start, end); the stretch between clear places is one piece.
    """
    stretch = clear_stretch(text, low + vocab.longest, high - 1)
    reached: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)  # by end
    before: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
    for bit, (start, end) in enumerate(entries):
        reached[end][start, end] = 1 << bit
    out: dict[tuple[int, int], int] = {}
    at = low if any(end == low for _, end in entries) else low + 1
    if not any(end > start for start, end in entries):
        at = low
    while at < high + vocab.longest + 1:
        here = reached.pop(at, {})
        if at >= high:
            for piece, bits in here.items():
                if piece[0] < high:
                    out[piece] = out.get(piece, 0) | bits
            at += 1
            continue
        if here:
            free = clear(text, at) or at == 0
            if stretch and at == stretch[0]:
                nexts = [(at, stretch[1])]
            else:
                nexts = [(at, at + len(p)) for p in vocab.starting(text, at)]
            for piece, bits in here.items():
                long = stretch is not None and piece == stretch
                left = "" if long else text[piece[0] : piece[1]]
                for nxt in nexts:
                    if free or long or not left or vocab.neighbours(left, text[nxt[0] : nxt[1]]):
                        reached[nxt[1]][nxt] = reached[nxt[1]].get(nxt, 0) | bits
                        before[nxt].append(piece)
        at += 1
    return out, before


def border_pieces(vocab: Vocabulary, text: str, low: int, first: bool) -> list[tuple[int, int]]:
    return [START[:2]] if first else over_border(vocab, text, low)


def matrix(vocab: Vocabulary, text: str, low: int, high: int, first: bool) -> list[tuple[int, int, int, int]]:
    """The chunk's transfer matrix: (start, end) of a piece over the left border and of one over the right border that it
    leads to, as distances from the border. ``text`` is the chunk from ``low`` to ``high`` with what is around it."""
    entries = border_pieces(vocab, text, low, first)
    out, _ = paths(vocab, text, low, high, entries)
    return [(a - low, b - low, c - high, d - high) for bit, (a, b) in enumerate(entries) for (c, d), bits in sorted(out.items()) if bits >> bit & 1]


def product(a: list[tuple], b: list[tuple]) -> list[tuple]:
    """Max-plus product of two transfer matrices whose weights are 0 (listed) and minus infinity."""
    rows = defaultdict(list)
    for c, d, e, f in b:
        rows[c, d].append((e, f))
    return sorted({(x, y, e, f) for x, y, c, d in a for e, f in rows[c, d]})


def combined(matrices: list[list[tuple]]) -> list[tuple]:
    """The product of neighbouring matrices, as a tree."""
    while len(matrices) > 1:
        matrices = [product(*matrices[k : k + 2]) if k + 1 < len(matrices) else matrices[k] for k in range(0, len(matrices), 2)]
    return matrices[0]


def states(matrices: list[list[tuple]], left: tuple[int, int] = (0, 0), right: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """The piece over the right border of each matrix, on the one path from ``left`` to ``right`` (without it: to the end of the document)."""
    reached = [{left}]
    for m in matrices:
        reached.append({(c, d) for a, b, c, d in m if (a, b) in reached[-1]})
    out = [right or next((c, d) for c, d in reached[-1] if d == 0)]
    for m, before in zip(reversed(matrices[1:]), reversed(reached[1:-1]), strict=True):
        out.append(next((a, b) for a, b, c, d in m if (c, d) == out[-1] and (a, b) in before))
    return out[::-1]


def trace(vocab: Vocabulary, text: str, low: int, high: int, first: bool, entry: tuple[int, int], exit_: tuple[int, int]) -> list[int]:
    """The ids of the pieces that start in the chunk: those after ``entry`` up to and with ``exit_`` (distances from the borders)."""
    start = START[:2] if first else (entry[0] + low, entry[1] + low)
    piece = exit_[0] + high, exit_[1] + high
    if piece == start:
        return []
    _, before = paths(vocab, text, low, high, [start])
    stretch = clear_stretch(text, low + vocab.longest, high - 1)
    out = []
    while piece != start:
        out.append(piece)
        piece = before[piece][0]
    ids: list[int] = []
    for a, b in reversed(out):
        ids += vocab.library.encode(text[a + 1 : b].replace(BLANK, " ")) if (a, b) == stretch else vocab.numbers(text[a:b])
    return ids


def decode(vocab: Vocabulary, ids: list[int], first: bool = True) -> str:
    """Text of a document's ids, or of a later chunk's: there a blank at the start is part of the text."""
    return vocab.library.decode(ids) if first else vocab.library.decode([vocab.letter, *ids]).removeprefix(vocab.names[vocab.letter])


def packed_ids(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def _chunk_rows(docs: DataFrame, chunk: int, longest: int) -> DataFrame:
    """The chunks of giant documents with what is around them, dealt evenly; rows equal in id and text are one, ``copies`` says of how many."""

    def rows(batch: list) -> Iterable[tuple]:
        for doc_id, row, text in batch:
            whole = escaped(text)
            for n in range(-(-len(whole) // chunk)):
                low, high = n * chunk, min((n + 1) * chunk, len(whole))
                from_ = max(0, low - longest)
                yield doc_id, row, n, low - from_, high - from_, whole[from_ : high + longest]

    found = docs.select("doc_id", F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), common.text_of()), 256).alias("row"), common.text_of().alias("text"))
    cut = common.map_rows(found.where(F.char_length("text") >= chunk), rows, "doc_id long, row string, chunk int, low int, high int, part string")
    same = [F.first(c).alias(c) for c in ("doc_id", "low", "high", "part")]
    return cut.groupBy("row", "chunk").agg(*same, F.count("*").alias("copies"))


def _lines(group: pa.Table, order: str) -> tuple[list[int], list[list[tuple]]]:
    """The numbers and matrices of a group, by number."""
    lines = sorted(zip(group.column(order).to_pylist(), group.column("matrix").to_pylist(), strict=True))
    return [n for n, _ in lines], [[tuple(m[i : i + 4]) for i in range(0, len(m), 4)] for _, m in lines]


def _sides(left: list[tuple[int, int]], right: list[tuple[int, int]]) -> dict[str, pa.Array]:
    return {k: pa.array([x[j] for x in side], pa.int32()) for side, names in ((left, "ab"), (right, "cd")) for j, k in enumerate(names)}


def _borders(made: DataFrame) -> DataFrame:
    """``row``, ``chunk``, ``a``, ``b`` (the piece over the left border), ``c``, ``d`` (over the right one) from ``made`` (``row``, ``chunk``, ``matrix``)."""
    made = made.withColumn("block", F.floor(F.col("chunk") / BLOCK).cast("int"))

    def multiplied(group: pa.Table) -> pa.Table:
        numbers, matrices = _lines(group, "chunk")
        flat = [x for line in combined(matrices) for x in line]
        return pa.table({"row": group.column("row")[:1], "block": group.column("block")[:1], "matrix": pa.array([flat], pa.list_(pa.int32()))})

    def over_blocks(group: pa.Table) -> pa.Table:
        numbers, matrices = _lines(group, "block")
        right = states(matrices)
        return pa.table({"row": group.column("row"), "block": pa.array(numbers, pa.int32()), **_sides([(0, 0), *right[:-1]], right)})

    def over_chunks(chunks: pa.Table, ends: pa.Table) -> pa.Table:
        numbers, matrices = _lines(chunks, "chunk")
        a, b, c, d = (ends.column(k)[0].as_py() for k in "abcd")
        right = states(matrices, (a, b), (c, d))
        return pa.table({"row": chunks.column("row"), "chunk": pa.array(numbers, pa.int32()), **_sides([(a, b), *right[:-1]], right)})

    blocks = made.groupBy("row", "block").applyInArrow(multiplied, "row string, block int, matrix array<int>")
    ends = blocks.groupBy("row").applyInArrow(over_blocks, "row string, block int, a int, b int, c int, d int")
    return made.groupBy("row", "block").cogroup(ends.groupBy("row", "block")).applyInArrow(over_chunks, "row string, chunk int, a int, b int, c int, d int")


def encoded_chunks(docs: DataFrame, path: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, ``row`` (a digest of id and text), ``copies``, ``chunk``, ``n_chars``, ``round_trip``, ``ids`` (array) of the pieces that start
    in each chunk of documents of ``chunk`` characters or more; rows equal in id and text are one, of ``copies``."""
    path = path or default_vocabulary()
    cut = common.checkpointed(_chunk_rows(docs, chunk, vocabulary(path).longest))

    def matrices(batch: list) -> Iterable[tuple]:
        vocab = vocabulary(path)
        for row, n, low, high, part in batch:
            yield row, n, [x for line in matrix(vocab, part, low, high, n == 0) for x in line]

    made = common.checkpointed(common.map_rows(cut.select("row", "chunk", "low", "high", "part"), matrices, "row string, chunk int, matrix array<int>"))
    borders = _borders(made)

    def traced(batch: list) -> Iterable[tuple]:
        vocab = vocabulary(path)
        for doc_id, row, copies, n, low, high, part, a, b, c, d in batch:
            ids = trace(vocab, part, low, high, n == 0, (a, b), (c, d))
            own = part[low + b : high + d].replace(BLANK, " ")
            own = own[1:] if n == 0 else own  # the blank that the model puts before a text
            yield doc_id, row, copies, n, len(own), decode(vocab, ids, n == 0) == own, ids

    return common.map_rows(cut.join(borders, ["row", "chunk"]).select("doc_id", "row", "copies", "chunk", "low", "high", "part", "a", "b", "c", "d"), traced, "doc_id long, row string, copies long, chunk int, n_chars long, round_trip boolean, ids array<int>")


def encoded(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, with_ids: bool = True) -> DataFrame:
    """``doc_id``, ``n_chars``, ``n_tokens``, ``ids_crc32`` (of the ids as little-endian unsigned 32-bit numbers), ``round_trip``
    (the ids decode to the text) and, ``with_ids``, ``ids`` (array) for each row.

    A null or empty text has no ids. Repeated rows give repeated results; of giant documents equal in id and text one is
    encoded and given back as often as they come. An empty table gives no rows.
    """
    path = path or default_vocabulary()
    schema = "doc_id long, n_chars long, n_tokens long, ids_crc32 long, round_trip boolean" + ", ids array<int>" * with_ids

    def whole(batch: list) -> Iterable[tuple]:
        vocab = vocabulary(path)
        for doc_id, text in batch:
            ids = vocab.library.encode(text)
            yield doc_id, len(text), len(ids), zlib.crc32(packed_ids(ids)), decode(vocab, ids) == text, *[ids] * with_ids

    texts = docs.select("doc_id", common.text_of().alias("text"))
    short = common.map_rows(texts.where(F.char_length("text") < chunk), whole, schema)

    def joined(batch: list) -> Iterable[tuple]:
        for doc_id, copies, n_chars, round_trip, parts in batch:
            ids = [i for p in sorted(parts, key=lambda p: p["chunk"]) for i in p["ids"]]
            yield copies, doc_id, n_chars, len(ids), zlib.crc32(packed_ids(ids)), round_trip, *[ids] * with_ids

    chunks = encoded_chunks(docs, path, chunk)
    giants = chunks.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("copies").alias("copies"), F.sum("n_chars").alias("n_chars"), F.bool_and("round_trip").alias("round_trip"), F.collect_list(F.struct("chunk", "ids")).alias("parts"))
    giants = common.map_rows(giants.select("doc_id", "copies", "n_chars", "round_trip", "parts"), joined, f"copies long, {schema}")
    each = giants.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
    return short.unionByName(each)
