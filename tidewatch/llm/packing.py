"""Packing documents into fixed windows by the sum-of-squares rule.

Online and without a shuffle: every partition of the input keeps its own open windows
in a level array, ``count[h]`` windows filled to level ``h``.  A document is cut into
full windows and one remainder.  The remainder of size ``s`` goes to the level ``h``
(an open window, or a new one with ``h = 0``) for which the sum of squared counts
after the move is smallest; ties take the fullest window.

At the end of a partition the open windows are closed: their pieces are cut once more
and strung together into full windows, and the single rest is divided into sequences
whose lengths are powers of two, which need no padding.  So a partition pads nothing.

Defined cases: a null or empty text is the end id alone, one token; repeated rows are
packed each on its own; an empty table gives no pieces.  A repeated task packs its
partition the same way, so sequence ids (partition and number) survive lost executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidewatch.llm.common import map_rows, table
from tidewatch.llm.tokens import token_ids

WIDTH = 1024
END = b"\0\0\0\0"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Piece:
    """Ids ``start`` to ``start + length`` of a document, not yet placed for good."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc, start: int, ids: bytes, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, length: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[: 4 * length], self.total),
            Piece(self.doc, self.start + length, self.ids[4 * length :], self.total),
        )


class SumOfSquares:
    """Open windows by level, and the rule that chooses among them."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.count = np.zeros(width + 1, dtype=np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(width + 1)]

    def level_for(self, size: int) -> int:
        """Growth of the sum of squares for each level, the smallest wins."""
        top = self.width - size
        growth = 2 * self.count[size : self.width + 1] + 2 - 2 * self.count[: top + 1]
        growth[0] = 2 * self.count[size] + 1
        growth[top] = 1 - 2 * self.count[top] if top else 0
        open_ = self.count[: top + 1] > 0
        open_[0] = True
        growth[~open_] = np.iinfo(np.int64).max
        return top - int(np.argmin(growth[::-1]))

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece in a window; a window that is full is returned."""
        size = len(piece)
        level = self.level_for(size)
        window = []
        if level:
            self.count[level] -= 1
            window = self.windows[level].pop()
        window.append(piece)
        if level + size == self.width:
            return window
        self.count[level + size] += 1
        self.windows[level + size].append(window)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """The open windows as full ones, then one rest in powers of two."""
        filling, room = [], self.width
        for level in range(self.width - 1, 0, -1):
            for window in self.windows[level]:
                for piece in window:
                    while len(piece) >= room:
                        part, piece = piece.cut(room)
                        yield [*filling, part]
                        filling, room = [], self.width
                    if len(piece):
                        filling.append(piece)
                        room -= len(piece)
        rest = self.width - room
        while rest:
            size = 1 << (rest.bit_length() - 1)
            out, need = [], size
            while need:
                piece = filling.pop(0)
                if len(piece) > need:
                    piece, back = piece.cut(need)
                    filling.insert(0, back)
                out.append(piece)
                need -= len(piece)
            yield out
            rest -= size
        self.__init__(self.width)


def pack(docs: DataFrame, width: int = WIDTH, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Pieces of every document with the sequence and offset each one lies at."""

    def run(batches: Iterator[dict]) -> Iterator[list[tuple]]:
        codec, levels = token_ids(vocabulary), SumOfSquares(width)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 36
        rows: list[tuple] = []

        def taken() -> list[tuple]:
            out = rows.copy()
            rows.clear()
            return out

        def emit(window: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for p in window:
                rows.append((p.doc, p.start, len(p), zlib.crc32(p.ids), p.total, number, offset))
                offset += len(p)
            number += 1

        for batch in batches:
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = codec.ids(text or "") + END
                total = len(ids) // 4
                piece = Piece(doc, 0, ids, total)
                while len(piece) >= width:
                    part, piece = piece.cut(width)
                    emit([part])
                if len(piece):
                    full = levels.place(piece)
                    if full:
                        emit(full)
            if rows:
                yield taken()
        for window in levels.close():
            emit(window)
        if rows:
            yield taken()

    return map_rows(docs.select("doc_id", "text"), run, PIECES)


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of its documents."""
    return pack(docs)


def op8_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
