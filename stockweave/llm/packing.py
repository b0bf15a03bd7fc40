"""Hierarchical multi-length packing.

Each task packs the documents of its own input split, so nothing is shuffled. A document is routed to the
smallest context tier that holds its tokens; longer ones give whole windows of the longest tier and route the
rest. A tier's queue becomes a sequence once it fills the tier's window: whole documents first, then the gap is
filled from shorter tiers, and only when these have nothing left is a document cut. What a task holds at its
end goes out as sequences whose lengths are powers of two, which need no padding. A task holds less than one window a tier.

Step groups: sequences of one tier are held until they make a group of ``step_tokens`` tokens, so that every optimiser
step sees the same number of tokens. What is left at a task's end, of all tiers and the tail, is dealt to groups of that size
together, largest sequences first: only a task's last group is smaller. A task holds less than one group a tier.

Defined results: null text is empty (only the end id); every row is packed, repeated ones too; an empty table
gives no pieces; other columns are ignored. sequence_id is unique over tasks.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockweave.llm.tokens import encoder
from stockweave.llm.words import trimmed
from stockweave.session import attach

TIERS = (512, 1024, 2048, 4096)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])


class Packer:
    """A piece is (doc_id, start, length, ids as a view of 4 bytes a token, tokens of its document); cutting moves the view."""

    def __init__(self, tiers=TIERS, step_tokens=8 * 4096, first_id=0):
        self.tiers, self.step_tokens, self.next_id, self.next_group = sorted(tiers), step_tokens, first_id, first_id
        self.queues = {t: deque() for t in self.tiers}
        self.held = dict.fromkeys(self.tiers, 0)
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}
        self.out: list[tuple] = []

    def _push(self, piece: tuple, front: bool = False) -> None:
        tier = next(t for t in self.tiers if piece[2] <= t)
        (self.queues[tier].appendleft if front else self.queues[tier].append)(piece)
        self.held[tier] += piece[2]

    @staticmethod
    def _cut(piece: tuple, n: int) -> tuple[tuple, tuple]:
        d, s, length, ids, total = piece
        return (d, s, n, ids[: 4 * n], total), (d, s + n, length - n, ids[4 * n :], total)

    def _close(self, sequences: list[tuple[int, list]]) -> None:
        """Write a step group of (size, pieces) sequences."""
        for size, pieces in sequences:
            at = 0
            for d, s, n, ids, total in pieces:
                self.out.append((d, s, n, bytes(ids), total, self.next_id, at, size, self.next_group))
                at += n
            self.next_id += 1
        self.next_group += 1

    def _sequence(self, tier: int, pieces: list[tuple]) -> None:
        waiting = self.waiting[tier]
        waiting.append((tier, pieces))
        if (len(waiting) + 1) * tier > self.step_tokens:
            self._close(waiting)
            self.waiting[tier] = []

    def add(self, doc_id, ids: bytes) -> None:
        total, top = len(ids) // 4, self.tiers[-1]
        piece = (doc_id, 0, total, memoryview(ids), total)
        while piece[2] > top:
            window, piece = self._cut(piece, top)
            self._sequence(top, [window])
        if piece[2]:
            self._push(piece)
        for tier in self.tiers:
            while self.held[tier] >= tier:
                self._fill(tier)

    def _fill(self, tier: int) -> None:
        """One full window of a tier whose queue has enough: whole pieces, then shorter tiers' pieces, then a cut."""
        pieces, room = [], tier
        for t in [x for x in reversed(self.tiers) if x <= tier]:
            queue = self.queues[t]
            for _ in range(len(queue)):
                piece = queue.popleft()
                if piece[2] <= room:
                    pieces.append(piece)
                    room -= piece[2]
                    self.held[t] -= piece[2]
                else:
                    queue.append(piece)
            if not room:
                break
        if room:  # every piece left is longer than the room: cut the shortest
            t, k = min(((t, k) for t in self.tiers if t <= tier for k in range(len(self.queues[t]))), key=lambda x: self.queues[x[0]][x[1]][2])
            piece = self.queues[t][k]
            del self.queues[t][k]
            self.held[t] -= piece[2]
            head, rest = self._cut(piece, room)
            pieces.append(head)
            self._push(rest, front=True)
        self._sequence(tier, pieces)

    def finish(self) -> None:
        rest = deque(p for t in reversed(self.tiers) for p in self.queues[t])
        left, top = sum(p[2] for p in rest), self.tiers[-1]
        open_ = [s for t in self.tiers for s in self.waiting[t]]
        while left:
            size = min(top, 1 << (left.bit_length() - 1))
            pieces, room = [], size
            while room:
                piece = rest.popleft()
                if piece[2] > room:
                    piece, tail = self._cut(piece, room)
                    rest.appendleft(tail)
                pieces.append(piece)
                room -= piece[2]
            open_.append((size, pieces))
            left -= size
        # sizes are powers of two, or tiers: the largest first, every group but the last fills up
        group, n = [], 0
        for size, pieces in sorted(open_, key=lambda x: -x[0]):
            if group and n + size > self.step_tokens:
                self._close(group)
                group, n = [], 0
            group.append((size, pieces))
            n += size
        if group:
            self._close(group)
        for t in self.tiers:
            self.queues[t].clear()
            self.held[t], self.waiting[t] = 0, []


def pack(docs: DataFrame, tokenizer: str, end_id: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = 8 * 4096) -> DataFrame:
    """One row per piece, with its ids (little-endian unsigned 32-bit)."""
    attach(docs.sparkSession)
    end = end_id.to_bytes(4, "little")

    def run(batches):
        enc, packer = encoder(tokenizer), Packer(tiers, step_tokens, TaskContext.get().partitionId() << 33)

        def rows():
            cols = list(zip(*packer.out, strict=True)) if packer.out else [()] * len(_ARROW)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW, strict=True)], schema=_ARROW)

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.ids_of(text.as_py()) + end
                packer.add(doc_id, ids)
                held += len(ids)
                if held > 4 << 20:
                    yield rows()
                    held = 0
        packer.finish()
        yield rows()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run, encodes=True), SCHEMA)
