"""Vector bin packing of token sequences by the dot-product heuristic.

An example is a vector (tokens, segments, loss-bearing tokens) and a sequence is a bin
with a limit on each. Among the examples that still fit, the bin takes the one whose
vector has the largest weighted inner product with the bin's free capacity: examples
go where the dimension that is scarce is not wasted. What exceeds a sequence is cut
into full ones first. When nothing fits whole, a piece is cut to fill the gap unless the
gap is under ``min_piece``.

Each partition packs its own rows in one pass with a bounded buffer: there is no shuffle,
at most the last sequence of a partition is short, and a rerun task makes the same
sequences. Null texts count as empty (their end id alone); repeated rows, also those of one
doc_id, are packed once each; a very long text is tokenised whole and cut into full sequences;
of examples that fit equally well the first is taken; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chat
from .bpe import encoder
from .common import give_back, shuffle_parts, text_slices


#: Bytes of text that are tokenised at a time; the arrays of it are some dozen times as large.
SLICE = 1 << 19


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024
    min_piece: int = 8
    buffer: int = 2048


@dataclass
class Example:
    """A stretch of a document's ids that isn't placed yet."""

    key: int
    total: int
    start: int
    length: int
    loss: np.ndarray | None  # whether each id bears loss; None: all do

    def loss_of(self, n: int) -> int:
        return n if self.loss is None else int(self.loss[self.start : self.start + n].sum())


class Packer:
    """Feeds on examples, gives (example key, start, length, sequence, offset, total)."""

    def __init__(self, limits: Limits, first_sequence: int = 0):
        self.limits, self.next = limits, first_sequence
        self.held: list[Example] = []

    def add(self, key: int, total: int, loss: np.ndarray | None = None) -> list[tuple]:
        lim, out, start = self.limits, [], 0
        if loss is None and lim.loss_tokens >= lim.tokens:
            while total - start >= lim.tokens:  # full sequences need no placing
                out.append((key, start, lim.tokens, self.next, 0, total))
                self.next += 1
                start += lim.tokens
        while start < total:
            n = self._most(loss, start, min(total - start, lim.tokens), lim.loss_tokens)
            self.held.append(Example(key, total, start, n, loss))
            start += n
        return out

    @staticmethod
    def _most(loss: np.ndarray | None, start: int, n: int, allowed: int) -> int:
        """The most ids from start, n at most, with no more than the allowed loss-bearing ones."""
        if loss is None:
            return min(n, allowed)
        return int(np.searchsorted(np.cumsum(loss[start : start + n]), allowed, "right"))

    def pack(self, all_of_it: bool) -> list[tuple]:
        """Empties the buffer, but for a last sequence's worth unless all_of_it."""
        lim, out, items = self.limits, [], self.held
        cap = np.array([lim.tokens, lim.segments, lim.loss_tokens], float)
        v = np.array([(x.length, 1, x.loss_of(x.length)) for x in items], float).reshape(-1, 3)
        # a dimension weighs as much as the examples ask of it
        weight = v.mean(0) / cap if len(v) else cap
        free_tokens = float(v[:, 0].sum())
        scaled = v / cap * weight / cap
        there = np.ones(len(v), bool)
        keep_back = 0 if all_of_it else lim.tokens
        while free_tokens > keep_back:
            room, offset = cap.copy(), 0
            while room[1] >= 1 and room[0] >= 1:
                fits = there & (v <= room).all(1)
                if fits.any():
                    score = np.where(fits, scaled @ room, -1)
                    i = int(score.argmax())
                    x, n = items[i], int(v[i, 0])
                elif not there.any() or room[0] < lim.min_piece:
                    break
                else:
                    i = int(np.where(there, v[:, 0], -1).argmax())
                    x = items[i]
                    n = self._most(x.loss, x.start, int(min(room[0], x.length)), int(room[2]))
                    if n < 1:
                        break
                took_loss = x.loss_of(n)
                out.append((x.key, x.start, n, self.next, offset, x.total))
                offset += n
                room -= (n, 1, took_loss)
                free_tokens -= n
                if n == x.length:
                    there[i] = False
                else:
                    items[i] = y = Example(x.key, x.total, x.start + n, x.length - n, x.loss)
                    v[i] = (y.length, 1, y.loss_of(y.length))
                    scaled[i] = v[i] / cap * weight / cap
            self.next += 1
        self.held = [x for x, t in zip(items, there, strict=True) if t]
        return out


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Every piece of every document's ids followed by ``end_id``.

    (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens[, ids]).
    """
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + ", ids array<int>" * with_ids

    def run(batches):
        from pyspark import TaskContext

        e = encoder(path, native=True)
        packer = Packer(limits, TaskContext.get().partitionId() << 36)
        ids_of: dict[int, np.ndarray] = {}
        doc_of: dict[int, int] = {}
        left: dict[int, int] = {}
        rows: list[tuple] = []
        n = 0

        def emit():
            cols = [*zip(*rows, strict=True)] if rows else [()] * (8 + with_ids)
            kinds = [pa.int64()] * 8 + [pa.list_(pa.int32())] * with_ids
            names = [x.split()[0] for x in fields.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            rows.clear()
            return batch

        def take(pieces):
            for key, start, length, seq, offset, total in pieces:
                part = ids_of[key][start : start + length]
                rows.append((doc_of[key], start, length, zlib.crc32(part.astype("<u4").tobytes()), total, seq, offset, length, *([part.tolist()] * with_ids)))
                left[key] -= length
                if not left[key]:
                    del ids_of[key], doc_of[key], left[key]

        for data, off, _, batch in text_slices(batches, SLICE):
            ids, count = e.encode(data, off)
            end = np.cumsum(count)
            for doc, i, j in zip(batch.column("doc_id").to_pylist(), (end - count).tolist(), end.tolist(), strict=True):
                ids_of[n], doc_of[n], left[n] = np.append(ids[i:j], np.int32(end_id)), doc, j - i + 1
                take(packer.add(n, j - i + 1))
                n += 1
                if len(packer.held) >= limits.buffer:
                    take(packer.pack(False))
            if rows:
                yield emit()
        take(packer.pack(True))
        if rows:
            yield emit()

    return docs.select("doc_id", "text").mapInArrow(run, fields)


def pack_examples(examples: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Instruction data: rows (example_id, ids array<int>, loss array<boolean>) to the same pieces, with ids and mask.

    ``example_id`` may be of any type. Null or empty ids give no piece; a null mask bears loss everywhere.
    """
    fields = f"example_id {examples.schema['example_id'].dataType.simpleString()}, start long, length long, sequence_id long, offset long, loss_tokens long, ids array<int>, loss array<boolean>"

    def run(batches):
        from pyspark import TaskContext

        packer, held, n = Packer(limits, TaskContext.get().partitionId() << 36), {}, 0
        names = [x.split()[0] for x in fields.split(", ")]
        kinds = [pa.int64()] * 5 + [pa.list_(pa.int32()), pa.list_(pa.bool_())]
        id_type = pa.int64()

        def emit(pieces):
            rows = []
            for key, start, length, seq, offset, _ in pieces:
                x, ids, loss, left = held[key]
                part = loss[start : start + length]
                rows.append((x, start, length, seq, offset, int(part.sum()), ids[start : start + length].tolist(), part.tolist()))
                held[key] = (x, ids, loss, left - length)
                if left == length:
                    del held[key]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [id_type, *kinds], strict=True)], names)

        for batch in batches:
            id_type = batch.schema.field("example_id").type
            for x, ids, loss in zip(*(batch.column(c).to_pylist() for c in ("example_id", "ids", "loss")), strict=True):
                if not ids:
                    continue
                mask = np.ones(len(ids), bool) if loss is None else np.array([bool(b) for b in [*loss, *[False] * len(ids)][: len(ids)]])
                held[n] = (x, np.array(ids, np.int32), mask, len(ids))
                yield from emit(packer.add(n, len(ids), mask))
                n += 1
                if len(packer.held) >= limits.buffer:
                    yield from emit(packer.pack(False))
        yield from emit(packer.pack(True))

    return examples.select("example_id", "ids", "loss").mapInArrow(run, fields)


def turn_examples(rows: DataFrame, path: str, limits: Limits = Limits(), loss_role: str = chat.ASSISTANT) -> DataFrame:
    """Conversations as examples: (example_id struct<conv_id, turn, n_turns>, ids, loss).

    Rows (conv_id, turn, role, text) go across the cluster in ranges of (conv_id, turn), so a conversation that
    holds a third of all rows is many tasks. In each range consecutive turns of a conversation make an example as
    long as it keeps within the limits on tokens and loss-bearing ones; a turn that exceeds them by itself is an example of its own,
    which packing cuts. A turn's mark, body and end are tokenised apart (``chat.write_turn``), so the mask falls
    between tokens: it covers the bodies of ``loss_role``. Strings of special tokens are plain text.

    Null roles and texts are empty; null conversations are one conversation, null turns come first; rows of
    one turn are in the order of their hash, repeated ones each count; an empty table gives no rows; other columns are ignored.
    """
    clean = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    m = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *clean).withColumn("read", F.monotonically_increasing_id())
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.xxhash64("role", "text"), F.col("read")]
    spread = m.repartitionByRange(max(2, shuffle_parts(rows.sparkSession)), *keys).sortWithinPartitions(*keys)
    fields = "example_id struct<conv_id: bigint, turn: bigint, n_turns: bigint>, ids array<int>, loss array<boolean>"
    key_type = pa.struct([("conv_id", pa.int64()), ("turn", pa.int64()), ("n_turns", pa.int64())])

    def encoded(batches):
        """(conv_id, turn, ids, mask) of each row, in order."""
        e = encoder(path, native=True)
        for batch in batches:
            held, size = [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
                held.append(row)
                size += len(row[3])
                if size >= SLICE:
                    yield from tokens(e, held)
                    held, size = [], 0
            if held:
                yield from tokens(e, held)

    def tokens(e, held):
        parts = []
        for _, _, role, text in held:
            turn, i, j = chat.write_turn(role, text)
            parts += [turn[:i].encode(), turn[i:j].encode(), turn[j:].encode()]
        off = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        ids, count = e.encode(np.frombuffer(b"".join(parts), np.uint8), off, specials=False)
        count = count.reshape(-1, 3)
        end = np.cumsum(count.sum(1))
        for (conv, turn, role, _), (head, body, tail), stop in zip(held, count.tolist(), end.tolist(), strict=True):
            mask = np.zeros(head + body + tail, bool)
            mask[head : head + body] = role == loss_role
            yield conv, turn, ids[stop - len(mask) : stop], mask

    def run(batches):
        give_back()
        first, parts, n_ids, n_loss, rows = None, [], 0, 0, []

        def close():
            rows.append(({"conv_id": first[0], "turn": first[1], "n_turns": len(parts)}, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])))

        def flush():
            cols = zip(*rows, strict=True)
            kinds = (key_type, pa.list_(pa.int32()), pa.list_(pa.bool_()))
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["example_id", "ids", "loss"])
            rows.clear()
            return out

        for conv, turn, ids, mask in encoded(batches):
            loss = int(mask.sum())
            if first is not None and (conv != first[0] or n_ids + len(ids) > limits.tokens or n_loss + loss > limits.loss_tokens):
                close()
                first, parts, n_ids, n_loss = None, [], 0, 0
                if sum(len(r[1]) for r in rows) >= SLICE:
                    yield flush()
            first = first or (conv, turn)
            parts.append((ids, mask))
            n_ids, n_loss = n_ids + len(ids), n_loss + loss
        if parts:
            close()
        if rows:
            yield flush()
        give_back()

    return spread.mapInArrow(run, fields)


def pack_turns(rows: DataFrame, path: str, limits: Limits = Limits(), loss_role: str = chat.ASSISTANT) -> DataFrame:
    """Conversations packed under all three limits: the pieces of ``pack_examples`` of the examples of ``turn_examples``.

    (conv_id, turn, n_turns, start, length, sequence_id, offset, loss_tokens, ids, loss); conv_id and turn are
    of the example's first row. Examples go on to packing in the partitions they were made in: one shuffle in all.
    """
    return pack_examples(turn_examples(rows, path, limits, loss_role), limits).select("example_id.*", "start", "length", "sequence_id", "offset", "loss_tokens", "ids", "loss")
