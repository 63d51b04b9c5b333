"""Byte-level BPE by a bounded-lookahead streaming transducer, and its decoder.

``sufficient_lookahead`` derives from the merge list alone how many bytes after a
token boundary can still move it: a boundary is undone only through a chain of
overlapping merges of falling rank to its right, so the longest such chain (a
dynamic programme over the merges in rank order) bounds the look-ahead. A piece
longer than the window is therefore encoded in windows: tokens that end that far
before the window's end are stable and are emitted, the rest is carried over.
Short pieces are encoded many at a time with array operations, each round
merging the lowest-ranked pair of every piece. Memory is bounded by the window,
the slice of text in hand and a memo of limited size; a text longer than a slice is a
slice of its own and lies in memory whole.

Null texts count as empty; repeated rows give repeated results, null doc_ids are kept as they
are, and an empty table gives no rows. Texts that hold the special token's string give its id,
as the public library does by default.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Rolling, text_slices

#: The classes of the pre-tokeniser's pattern: letters, numbers, white space, others.
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
#: The suffixes that the pre-tokeniser splits off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
NONE = np.int32(2**31 - 1)
MEMO_PIECES = 1_200_000


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point, by the property tests of the regex library."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "\ud800" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for k, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            out[m.start() : m.end()] = k
    return out


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """The vocabulary file as arrays: sorted pair keys with rank and result, and the bytes of each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.bytes_of: list[bytes] = [b""] * (max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]) + 1)
        for s, i in vocab.items():
            self.bytes_of[i] = bytes(back[c] for c in s)
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.of_byte = np.zeros(256, np.int32)
        for c, b in back.items():
            self.of_byte[b] = vocab[c]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        key = np.array([a << 32 | b for a, b, _ in self.rules], np.int64)
        order = np.argsort(key, kind="stable")
        self._key, self._rank, self._made = key[order], order.astype(np.int32), np.array([c for *_, c in self.rules], np.int32)
        bits = 19
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        # open addressing: a probe costs one or two gathers where a search costs sixteen
        self._slot_key, self._slot_rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        todo, keys, ranks = self._slot(key), key.copy(), np.arange(len(key), dtype=np.int32)
        self._probes = 0
        while len(keys):
            free = self._slot_key[todo] < 0
            cand = np.flatnonzero(free)
            _, first = np.unique(todo[cand], return_index=True)
            win = cand[first]
            self._slot_key[todo[win]], self._slot_rank[todo[win]] = keys[win], ranks[win]
            left = np.ones(len(keys), bool)
            left[win] = False
            todo, keys, ranks = (todo[left] + 1) & self._mask, keys[left], ranks[left]
            self._probes += 1
        self.lookahead = sufficient_lookahead(self.rules, [len(b) for b in self.bytes_of])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where no merge has it. Ids below 0 never match."""
        key = a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)
        key[(a < 0) | (b < 0)] = -2
        at = self._slot(key)
        out = np.where(self._slot_key[at] == key, self._slot_rank[at], NONE)
        todo = np.flatnonzero((self._slot_key[at] != key) & (self._slot_key[at] >= 0))
        for _ in range(self._probes):
            if not len(todo):
                break
            at2 = (at[todo] + 1) & self._mask
            at[todo] = at2
            hit = self._slot_key[at2] == key[todo]
            out[todo[hit]] = self._slot_rank[at2[hit]]
            todo = todo[~hit & (self._slot_key[at2] >= 0)]
        return out

    def made(self, rank: np.ndarray) -> np.ndarray:
        return self._made[rank]


def sufficient_lookahead(rules: list[tuple[int, int, int]], length: list[int]) -> int:
    """Bytes after a token's end that suffice to know that end is final.

    A merge (u, v) can be prevented from the right only by an earlier merge whose left
    part lies on the right edge of v's derivation; reach[r] adds that merge's own right
    part and whatever can prevent it in turn. Ranks fall along a chain, so one pass in
    rank order settles all.
    """
    right_edge: dict[int, tuple[int, ...]] = {}
    best_left: dict[int, int] = {}
    top = 0
    for u, v, made in rules:
        edge = right_edge.get(v, ()) + (v,)
        reach = length[v] + max((best_left.get(t, 0) for t in edge), default=0)
        best_left[u] = max(best_left.get(u, 0), reach)
        right_edge[made] = edge
        top = max(top, reach)
    return top + max(length)


class Pieces:
    """Pre-tokens of a slice of texts, as arrays of byte bounds; texts never share one."""

    @staticmethod
    def bounds(data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Sorted byte positions at which a piece starts."""
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        n = len(code)
        if not n:
            return np.zeros(0, np.int64)
        kind = char_classes()[code]
        first = np.zeros(n + 1, bool)  # a text starts here
        first[np.searchsorted(lead, off[:-1])] = True
        first[n] = True
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= first[:n]
        # one plain space before a run that is not white space belongs to that run
        space = (code == 32) & ~first[1:]
        joins = np.flatnonzero(space[:-1] & (kind[1:] != SPACE)) if n > 1 else np.zeros(0, np.int64)
        start[joins + 1] = False
        start[joins] = True
        # white space before other text: its last character is a piece of its own unless it joined above
        white = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~first[1:n]) if n > 1 else np.zeros(0, np.int64)
        start[white] = True
        lone = white[code[white] != 32]
        start[lone + 1] = True
        # contractions are tried first wherever a piece would start at an apostrophe
        at = np.flatnonzero((code == 39) & start)
        if len(at):
            Pieces._contractions(code, kind, start, first, at)
        return lead[np.flatnonzero(start)]

    @staticmethod
    def _contractions(code: np.ndarray, kind: np.ndarray, start: np.ndarray, first: np.ndarray, at: np.ndarray) -> None:
        n = len(code)
        for i in at.tolist():
            j = i
            if not start[j] or (j and code[j - 1] == 32 and not first[j] and not start[j]):
                continue
            for s in CONTRACTIONS:
                e = j + 1 + len(s)
                if e <= n and not first[j + 1 : e].any() and all(code[j + 1 + k] == ord(c) for k, c in enumerate(s)):
                    start[j + 1 : e] = False
                    if e < n:
                        # what follows is matched afresh from e
                        start[e] = True
                    break


class Encoder:
    """Ids of whole texts; a piece's ids are computed once and kept in a bounded memo."""

    def __init__(self, path: str, window: int | None = None, native: bool = False):
        """native: pieces are encoded by a compiled library instead of the transducer; the ids are the same."""
        self.merges = Merges(path)
        self._native = self._compiled() if native else None
        self.window = max(window or 0, 2 * self.merges.lookahead, 256)
        self._h = (Rolling(11), Rolling(12))
        self._reset()

    def _compiled(self):
        """tiktoken's merge routine over this vocabulary, whose ids rise with the merges' ranks."""
        import tiktoken

        made = [c for *_, c in self.merges.rules]
        if made != sorted(made):
            return None
        ranks = {b: i for i, b in enumerate(self.merges.bytes_of) if i not in self.merges.special.values()}
        core = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        return core.encode_single_piece

    def _reset(self) -> None:
        self._known = np.zeros(0, np.uint64)
        self._check = np.zeros(0, np.uint64)
        self._at = np.zeros(0, np.int64)
        self._len = np.zeros(0, np.int32)
        self._pool = np.zeros(0, np.int32)

    def pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, concatenated, and their counts; pieces longer than the window go through ``stream``."""
        m, size = self.merges, ends - starts
        if self._native is not None:
            raw, one = data.tobytes(), self._native
            lists = [one(raw[i:j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
            count = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter((t for x in lists for t in x), np.int32, int(count.sum())), count
        count = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # which, counts, ids in that order
        edges = [0, 1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, self.window]
        for lo, hi in zip(edges, [*edges[1:], None], strict=True):
            if hi is None:
                break
            for some in np.array_split(which := np.flatnonzero((size > lo) & (size <= hi)), max(1, len(which) * hi // 2_000_000)):
                if len(some):
                    k, ids = self._matrix(m.of_byte[data[np.minimum(starts[some, None] + np.arange(hi), len(data) - 1)]], size[some])
                    parts.append((some, k, ids))
                    count[some] = k
        for i in np.flatnonzero(size > self.window).tolist():
            ids = np.concatenate([*self.stream([data[starts[i] : ends[i]]])])
            parts.append((np.array([i]), np.array([len(ids)]), ids))
            count[i] = len(ids)
        out = np.zeros(int(count.sum()), np.int32)
        first = np.cumsum(count) - count
        for which, k, ids in parts:
            out[np.repeat(first[which] - (np.cumsum(k) - k), k) + np.arange(len(ids))] = ids
        return out, count

    def _matrix(self, tok: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of byte ids, padded: merges the lowest-ranked pair of every row until none has one."""
        m = self.merges
        width = tok.shape[1]
        tok = np.where(np.arange(width) < size[:, None], tok, -1).astype(np.int32)
        final = tok.copy()
        live = np.arange(len(tok))
        rank = m.ranks(tok[:, :-1].ravel(), tok[:, 1:].ravel()).reshape(len(tok), width - 1) if width > 1 else np.full((len(tok), 0), NONE)
        while len(live) and width > 1:
            low = rank.min(1)
            done = low == NONE
            if done.any():
                final[live[done]] = -1
                final[live[done], :width] = tok[done]
                tok, rank, live, low = tok[~done], rank[~done], live[~done], low[~done]
                if not len(live):
                    break
            rows, cols = np.nonzero(rank == low[:, None])
            # left to right, overlapping occurrences of a pair such as (a, a) skip every second one
            run = np.zeros(len(rows), np.int64)
            same = (rows[1:] == rows[:-1]) & (cols[1:] == cols[:-1] + 1)
            if same.any():
                idx = np.arange(len(rows))
                begin = np.maximum.accumulate(np.where(np.r_[True, ~same], idx, 0))
                run = idx - begin
            keep = run % 2 == 0
            rows, cols = rows[keep], cols[keep]
            tok[rows, cols] = m.made(low[rows])
            alive = np.ones(tok.shape, bool)
            alive[rows, cols + 1] = False
            # close the gaps: stable order of what is left in each row
            shift = np.cumsum(~alive, 1)
            r, c = np.nonzero(alive)
            moved = np.full_like(tok, -1)
            to = c - shift[r, c]
            moved[r, to] = tok[r, c]
            tok = moved
            kept = np.full(rank.shape, NONE, np.int32)
            ok = c < width - 1
            inside = to[ok]
            good = inside < width - 1
            kept[r[ok][good], inside[good]] = rank[r[ok][good], c[ok][good]]
            rank = kept
            at = cols - shift[rows, cols]
            right = at < width - 1
            rank[rows[right], at[right]] = m.ranks(tok[rows[right], at[right]], tok[rows[right], at[right] + 1])
            left = at > 0
            rank[rows[left], at[left] - 1] = m.ranks(tok[rows[left], at[left] - 1], tok[rows[left], at[left]])
        if len(live):
            final[live] = -1
            final[live, :width] = tok
        ok = final >= 0
        return ok.sum(1), final[ok]

    def stream(self, chunks) -> "object":
        """The transducer on one piece: yields ids as they become stable, holding a window of bytes at most.

        Give the piece's bytes in any chunks.
        """
        m, held = self.merges, np.zeros(0, np.uint8)
        for chunk in chunks:
            for i in range(0, max(len(chunk), 1), self.window):
                held = np.concatenate([held, chunk[i : i + self.window]])
                if len(held) <= 2 * m.lookahead:
                    continue
                ids = self._one(held)
                ends = np.cumsum([len(m.bytes_of[t]) for t in ids.tolist()])
                n = int(np.searchsorted(ends, len(held) - m.lookahead, "right"))
                if n:
                    yield ids[:n]
                    held = held[ends[n - 1] :]
        if len(held):
            yield self._one(held)

    def _one(self, raw: np.ndarray) -> np.ndarray:
        """A doubly linked list and a heap: n log n for a window of n bytes."""
        import heapq

        m = self.merges
        tok = m.of_byte[raw].tolist()
        n = len(tok)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        rank = m.ranks(np.array(tok[:-1], np.int32), np.array(tok[1:], np.int32)).tolist() if n > 1 else []
        heap = [(r, i, tok[i], tok[i + 1]) for i, r in enumerate(rank) if r != NONE]
        heapq.heapify(heap)
        dead = [False] * n
        get = self._pair
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if dead[i] or tok[i] != a or j < 0 or tok[j] != b:
                continue
            tok[i] = int(m._made[r])
            dead[j] = True
            nxt[i] = nxt[j]
            if nxt[j] >= 0:
                prv[nxt[j]] = i
            for x in (prv[i], i):
                if x >= 0 and nxt[x] >= 0 and (q := get(tok[x], tok[nxt[x]])) is not None:
                    heapq.heappush(heap, (q, x, tok[x], tok[nxt[x]]))
        return np.array([t for t, d in zip(tok, dead, strict=True) if not d], np.int32)

    def _pair(self, a: int, b: int) -> int | None:
        if not hasattr(self, "_pairs"):
            self._pairs = {(u, v): r for r, (u, v, _) in enumerate(self.merges.rules)}
        return self._pairs.get((a, b))

    def encode(self, data: np.ndarray, off: np.ndarray, specials: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, count for each text); without specials their strings are plain text."""
        n_texts = len(off) - 1
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(n_texts, np.int64)
        special = self._special_spans(data, off) if specials else ()
        if len(special):
            # cut at the special token: each stretch is pre-tokenised as a text of its own
            cuts = np.unique(np.concatenate([off, special[:, 0], special[:, 1]]))
            starts = Pieces.bounds(data, cuts)
        else:
            starts = Pieces.bounds(data, off)
        ends = np.r_[starts[1:], len(data)]
        p1, p2 = self._h[0].prefix(data), self._h[1].prefix(data)
        h, g = self._h[0].of(p1, starts, ends), self._h[1].of(p2, starts, ends)
        ids, count = self._lookup(data, starts, ends, h, g)
        if len(special):
            is_special = np.isin(starts, special[:, 0])
            ids, count = self._put_special(ids, count, starts, is_special, special)
        per_text = np.diff(np.r_[0, np.cumsum(count)][np.searchsorted(starts, off)])
        return ids, per_text

    def _special_spans(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        raw, found = data.tobytes(), []
        for s, i in self.merges.special.items():
            b = s.encode()
            k = raw.find(b)
            while k >= 0:
                t = int(np.searchsorted(off, k, "right"))
                if k + len(b) <= off[t]:
                    found.append((k, k + len(b), i))
                    k = raw.find(b, k + len(b))
                else:
                    k = raw.find(b, k + 1)
        return np.array(sorted(found), np.int64).reshape(-1, 3)

    @staticmethod
    def _put_special(ids, count, starts, is_special, special):
        """Where a special span begins, its own pieces (there may be several) give way to the one id."""
        span = np.searchsorted(special[:, 0], starts, "right") - 1
        inside = (span >= 0) & (starts < special[np.maximum(span, 0), 1])
        keep = np.repeat(~inside, count)
        new_count = np.where(inside, is_special.astype(np.int64), count)
        out = np.zeros(int(new_count.sum()), np.int32)
        owner = np.repeat(inside, new_count)
        out[~owner] = ids[keep]
        out[owner] = special[span[is_special], 2]
        return out, new_count

    def _lookup(self, data, starts, ends, h, g):
        uniq, first, inv = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self._known, uniq)
        found = np.zeros(len(uniq), bool)
        inside = at < len(self._known)
        found[inside] = (self._known[at[inside]] == uniq[inside]) & (self._check[at[inside]] == g[first[inside]])
        new = np.flatnonzero(~found)
        if len(new):
            if len(self._known) + len(new) > MEMO_PIECES and len(self._known):
                self._reset()
                return self._lookup(data, starts, ends, h, g)
            f = first[new]
            ids, count = self.pieces(data, starts[f], ends[f])
            base = len(self._pool)
            self._pool = np.concatenate([self._pool, ids])
            # both sides are sorted: inserting is linear
            put = at[new]
            self._known = np.insert(self._known, put, uniq[new])
            self._check = np.insert(self._check, put, g[f])
            self._at = np.insert(self._at, put, base + np.cumsum(count) - count)
            self._len = np.insert(self._len, put, count.astype(np.int32))
            at = np.searchsorted(self._known, uniq)
        where = at[inv]
        count = self._len[where].astype(np.int64)
        ids = self._pool[np.repeat(self._at[where] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))]
        return ids, count


class Decoder:
    """Bytes of ids to text, any number of ids at a time.

    The state between calls is the start of a UTF-8 sequence, three bytes at most;
    invalid bytes become U+FFFD as in the public library.
    """

    def __init__(self, bytes_of: list[bytes]):
        import codecs

        self._bytes_of = bytes_of
        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        get = self._bytes_of.__getitem__
        return self._machine.decode(b"".join(map(get, ids)))

    def finish(self) -> str:
        return self._machine.decode(b"", True)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, native: bool = False) -> Encoder:
    """One per Python worker and vocabulary file: later tasks find the memo warm."""
    if (path, native) not in _ENCODERS:
        _ENCODERS[path, native] = Encoder(path, native=native)
    return _ENCODERS[path, native]


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes ``text`` of every row of (doc_id, text): (doc_id, n_tokens, ids array, decoded).

    One pass of map tasks, no shuffle. Null and empty texts give no ids and an empty text;
    repeated rows give repeated results; other columns are ignored.
    """

    def run(batches):
        e = encoder(path)
        for data, off, _, rows in text_slices(batches):
            ids, count = e.encode(data, off)
            end = np.cumsum(count)
            texts = []
            for i, j in zip((end - count).tolist(), end.tolist(), strict=True):
                d = Decoder(e.merges.bytes_of)
                # fed in stretches: the machine keeps at most an unfinished character
                texts.append("".join([*(d.feed(ids[k : min(k + 4096, j)].tolist()) for k in range(i, j, 4096)), d.finish()]))
            values = pa.ListArray.from_arrays(pa.array(np.r_[0, end].astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(count, pa.int64()), values, pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, decoded string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ``round_trip`` with its outputs digested where they are made."""
    from hashlib import sha256

    def run(batches):
        e = encoder(path)
        for data, off, _, rows in text_slices(batches):
            ids, count = e.encode(data, off)
            end = np.cumsum(count)
            id_sha, text_sha = [], []
            for i, j in zip((end - count).tolist(), end.tolist(), strict=True):
                id_sha.append(sha256(ids[i:j].astype("<u4").tobytes()).hexdigest())
                d, h = Decoder(e.merges.bytes_of), sha256()
                for k in range(i, j, 4096):
                    h.update(d.feed(ids[k : min(k + 4096, j)].tolist()).encode())
                h.update(d.finish().encode())
                text_sha.append(h.hexdigest())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(count, pa.int64()), pa.array(id_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
