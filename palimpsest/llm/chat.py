"""Reply trees to conversations: paths by iterative self-joins, ranked, then formatted.

``paths`` enumerates root-to-leaf paths by pointer doubling. Round k joins the table of
2**k-th ancestors, with the sum of the scores on the way, to itself, so a chain of n replies
takes log2(n) rounds; each round's table has one row for a node and is written to the
checkpoint folder. After them every node that has a root knows its path's mean score:
``rank_paths`` orders a tree's branches by it, then by length, then by leaf, before any path
is written out. The rows of the chosen paths alone are then found by joining them to the
rounds' tables. ``format_paths`` streams each chosen path's rows, in order, through a writer
of constant memory.

The template marks a turn as ``### <role>: <text> </turn>`` and a line feed. In roles and
texts a backslash is put before every backslash, hash sign, colon and
opening angle bracket, so no text can be read as a mark and reading back gives it unchanged.

Defined cases: null roles and texts are empty, null scores 0; a null tree (conversation) is
a tree like any other; a node whose parent is missing is a root; nodes that lead into a
cycle have no root and form no path, and what hangs on them neither; repeated rows of one
(tree, node) count once, the least by role and text, with the least parent and the highest
score; rows without a node are left out; extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir

#: The template's control strings.
HEAD, AFTER_ROLE, TAIL = "### ", ": ", " </turn>\n"
ESCAPE, GUARDED = "\\", "\\#:<"
ASSISTANT = "assistant"


def escape(text: str) -> str:
    for c in GUARDED:
        text = text.replace(c, ESCAPE + c)
    return text


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn's text and where its escaped body begins and ends in it."""
    head = HEAD + escape(role) + AFTER_ROLE
    body = escape(text)
    return head + body + TAIL, len(head), len(head) + len(body)


class Reader:
    """Reads a formatted conversation back, chunk by chunk: (role, text) for each turn."""

    def __init__(self):
        self.rest = ""

    def feed(self, chunk: str) -> Iterator[tuple[str, str]]:
        self.rest += chunk
        while (end := self._find(self.rest, TAIL, 0)) >= 0:
            colon = self._find(self.rest, AFTER_ROLE, len(HEAD))
            if not self.rest.startswith(HEAD) or not 0 <= colon <= end:
                raise ValueError("not a formatted turn")
            yield unescape(self.rest[len(HEAD) : colon]), unescape(self.rest[colon + len(AFTER_ROLE) : end])
            self.rest = self.rest[end + len(TAIL) :]

    @staticmethod
    def _find(s: str, mark: str, at: int) -> int:
        """First place of the mark that isn't escaped: an even number of backslashes stands before its guarded character."""
        lead = next(i for i, c in enumerate(mark) if c in GUARDED)
        while (k := s.find(mark, at)) >= 0:
            j = k + lead
            while j > 0 and s[j - 1] == ESCAPE:
                j -= 1
            if (k + lead - j) % 2 == 0:
                return k
            at = k + 1
        return -1


def unescape(text: str) -> str:
    out, i = [], 0
    while (k := text.find(ESCAPE, i)) >= 0:
        out.append(text[i:k])
        out.append(text[k + 1 : k + 2])
        i = k + 2
    return "".join([*out, text[i:]])


def chain(rows: DataFrame, tree: str = "conv_id", order: str = "turn") -> DataFrame:
    """Messages of linear conversations: each row replies to the one before it in ``order``.

    (tree, node, parent, role, text, score); ties in order are broken by role and text.
    """
    w = Window.partitionBy("tree").orderBy("at", "role", "text")
    m = rows.select(F.col(tree).alias("tree"), F.col(order).alias("at"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    m = m.withColumn("node", F.row_number().over(w).cast("long"))
    return m.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _nodes(messages: DataFrame) -> DataFrame:
    """(tree, node, parent, score, role, text), one row for each; ``tree`` in a struct, in which nulls are equal to each other."""
    m = messages.where("node is not null").select(F.struct("tree").alias("tree"), "node", "parent", F.coalesce("score", F.lit(0.0)).alias("score"), F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("m"))
    m = m.groupBy("tree", "node").agg(F.min("parent").alias("parent"), F.max("score").alias("score"), F.min("m").alias("m"))
    return m.select("tree", "node", "parent", "score", "m.role", "m.text")


def _doubled(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The rounds' tables of ancestors (tree, node, to), and (tree, node, total, n) of every node that has a root."""
    ensure_checkpoint_dir(nodes.sparkSession)
    ids = nodes.select("tree", F.col("node").alias("parent"), F.lit(True).alias("there"))
    state = nodes.select("tree", "node", "parent", "score").join(ids, ["tree", "parent"], "left")
    # a node's way so far: up to ``to``, which isn't part of it; none: up to the root
    state = state.select("tree", "node", F.when(F.col("there"), F.col("parent")).alias("to"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n")).checkpoint()
    rounds, longest = [], None
    while not (jump := state.where("to is not null")).isEmpty():
        # no way is longer than its tree: what goes on beyond leads into a cycle
        longest = longest or nodes.groupBy("tree").count().agg(F.max("count")).first()[0]
        if 2 ** len(rounds) > longest:
            break
        rounds.append(jump.select("tree", "node", "to"))
        # only ways that go on are joined; every node that is gone to is in the table
        next_one = state.select("tree", F.col("node").alias("to"), F.col("to").alias("beyond"), F.col("total").alias("more"), F.col("n").alias("m"))
        longer = jump.join(next_one, ["tree", "to"]).select("tree", "node", F.col("beyond").alias("to"), (F.col("total") + F.col("more")).alias("total"), (F.col("n") + F.col("m")).alias("n"))
        state = state.where("to is null").union(longer).checkpoint()
    return rounds, state.where("to is null").select("tree", "node", "total", "n")


def _leaves(nodes: DataFrame, rooted: DataFrame) -> DataFrame:
    """(tree, leaf, total, n) of the nodes with a root that nobody replies to."""
    parents = nodes.where("parent is not null").select("tree", F.col("parent").alias("node")).distinct()
    return rooted.join(parents, ["tree", "node"], "left_anti").withColumnRenamed("node", "leaf")


def _walked(leaves: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(tree, leaf, node, up): all nodes on the paths of the given leaves."""
    found = leaves.select("tree", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("up"))
    for k, jump in enumerate(rounds):
        further = found.join(jump, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + 2**k).alias("up"))
        # cut from the lineage in each round: the plan would double otherwise
        found = found.union(further).checkpoint()
    return found


def _ranked(leaves: DataFrame) -> DataFrame:
    w = Window.partitionBy("tree").orderBy(F.desc("score"), F.desc("n"), "leaf")
    per = leaves.select("tree", "leaf", (F.col("total") / F.col("n")).alias("score"), "n")
    return per.withColumn("rank", F.row_number().over(w))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, node, up): for each leaf with a root, the nodes on its path, ``up`` steps above the leaf."""
    nodes = _nodes(messages)
    rounds, rooted = _doubled(nodes)
    return _walked(_leaves(nodes, rooted), rounds).select("tree.tree", "leaf", "node", "up")


def rank_paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, score, n, rank): branches of each tree, best mean score first."""
    nodes = _nodes(messages)
    return _ranked(_leaves(nodes, _doubled(nodes)[1])).select("tree.tree", "leaf", "score", "n", "rank")


def chosen_turns(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """(tree, leaf, rank, up, role, text) of each tree's ``best`` branches (None: all)."""
    nodes = _nodes(messages)
    rounds, rooted = _doubled(nodes)
    ranked = _ranked(_leaves(nodes, rooted))
    if best is not None:
        ranked = ranked.where(F.col("rank") <= best)
    ranked = ranked.select("tree", "leaf", "rank").checkpoint()
    p = _walked(ranked, rounds).join(ranked, ["tree", "leaf"])
    return p.join(nodes.select("tree", "node", "role", "text"), ["tree", "node"]).select("tree.tree", "leaf", "rank", "up", "role", "text")


def _by_path(turns: DataFrame) -> DataFrame:
    return turns.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", F.desc("up"))


def format_paths(turns: DataFrame, loss_role: str = ASSISTANT) -> DataFrame:
    """(tree, leaf, rank, formatted, loss): ``loss`` holds [begin, end) of each assistant body in code points."""

    def run(batches):
        key, rank, parts, spans, at = None, None, [], [], 0

        def done():
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([rank], pa.int32()), pa.array(["".join(parts)]), pa.array([spans], pa.list_(pa.list_(pa.int64())))], ["tree", "leaf", "rank", "formatted", "loss"])

        for b in batches:
            for tree, leaf, r, role, text in zip(*(b.column(c).to_pylist() for c in ("tree", "leaf", "rank", "role", "text")), strict=True):
                if (tree, leaf) != key:
                    if key is not None:
                        yield done()
                    key, rank, parts, spans, at = (tree, leaf), r, [], [], 0
                turn, i, j = write_turn(role, text)
                if role == loss_role:
                    spans.append([at + i, at + j])
                parts.append(turn)
                at += len(turn)
        if key is not None:
            yield done()

    return _by_path(turns).mapInArrow(run, "tree long, leaf long, rank int, formatted string, loss array<array<long>>")


def digest_paths(turns: DataFrame, loss_role: str = ASSISTANT) -> DataFrame:
    """Each path formatted, read back from the formatted text as it is written, and digested: memory of one turn.

    (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars).
    """
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        key, state, rows = None, None, []

        def done():
            rows.append((key[0], state["n"], state["turns"].hexdigest(), state["loss_n"], state["loss"].hexdigest(), state["chars"]))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names)
            rows.clear()
            return out

        for b in batches:
            for tree, leaf, role, text in zip(*(b.column(c).to_pylist() for c in ("tree", "leaf", "role", "text")), strict=True):
                if (tree, leaf) != key:
                    if key is not None:
                        done()
                    key, state = (tree, leaf), {"n": 0, "turns": sha256(), "loss_n": 0, "loss": sha256(), "chars": 0, "reader": Reader()}
                turn, i, j = write_turn(role, text)
                state["chars"] += len(turn)
                if role == loss_role:
                    masked = unescape(turn[i:j])
                    state["loss_n"] += len(masked)
                    state["loss"].update(masked.encode())
                for back_role, back_text in state["reader"].feed(turn):
                    state["n"] += 1
                    state["turns"].update(f"{back_role}\n{back_text}\n".encode())
            if rows:
                yield flush()
        if key is not None:
            done()
            yield flush()

    return _by_path(turns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
