"""Transcripts to canonical chat turns by a hidden Markov model over lines.

A transcript is a run of lines in which speakers are marked in some style, or not at all.  The model's states
are (role, first line of a turn or a later one); what a line shows is its speaker marker and its length, first
and last characters.  Start, transition and emission probabilities are counted on labelled conversations
(those whose id has crc32 modulo 3 other than 1, as elsewhere), and Viterbi recovers the states; lines are
then joined to turns and rendered as ``<|role|>`` line, text, ``<|end|>``.

Scale: a conversation is cut into blocks of rows.  A block reduces to a max-plus matrix from the state before
it to its last state; the matrices of a conversation's blocks are chained forwards and backwards to fix the
state at every border, and each block is then decoded by itself.  This is exact Viterbi, and no task holds
a whole conversation's text, however long.

Definitions for unusual input: rows of a null conversation id form one conversation; a null turn comes first;
rows of one turn are ordered by their text; a null text is an empty line; a repeated row is a turn of its
own; without labelled rows all probabilities are uniform; an empty table gives an empty result; other columns
play no part.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, prepare
from .labels import held_out

ROLES = ("system", "user", "assistant")
S = 2 * len(ROLES)  # state 2*r: first line of a turn of role r; 2*r+1: a later line

_NAMES = (
    ("user", "human", "q", "question", "customer", "prompt", "client"),
    ("assistant", "ai", "bot", "a", "answer", "response", "agent", "model"),
    ("system", "sys", "context", "instructions", "setup"),
)
_CLASS = {name: i + 1 for i, names in enumerate(_NAMES) for name in names}
#: A name with brackets, hashes or stars around it, or with a colon after it; or a dash.
_MARK = re.compile(
    r"\s*(?:(?:#+\s*|\[|<\|?|\*\*)\s*([A-Za-z]+)\s*(?:\]|\|?>|:?\*\*|:|$)\s*:?\s*|([A-Za-z]+)\s*:\s*|(?:-|>>|•)\s+)"
)
MARKS, SIZES, HEADS, TAILS = 5, 8, 3, 4
_FEATURES = (MARKS, SIZES, HEADS, TAILS)


def marker(line: str) -> tuple[int, str]:
    """Class of the line's speaker marker (0: none, 1-3: a known name, 4: a dash), and the rest of the line."""
    m = _MARK.match(line)
    if not m:
        return 0, line
    name = m[1] or m[2]
    if name is None:
        return 4, line[m.end() :]
    c = _CLASS.get(name.lower())
    return (c, line[m.end() :]) if c else (0, line)


def line_features(line: str) -> tuple[tuple[int, ...], str]:
    mark, rest = marker(line)
    body = rest.strip()
    head = 0 if not body else 1 if body[0].isupper() else 2
    tail = 0 if not body else {"?": 1, ".": 2}.get(body[-1], 3)
    return (mark, min(len(body).bit_length(), SIZES - 1), head, tail), rest


class Model(NamedTuple):
    start: np.ndarray  # log, S
    move: np.ndarray  # log, S x S
    show: tuple[np.ndarray, ...]  # log, S x values of each feature

    def emissions(self, features: list[tuple[int, ...]]) -> np.ndarray:
        x = np.asarray(features).reshape(-1, len(_FEATURES))
        return sum(t[:, x[:, i]].T for i, t in enumerate(self.show))


def _best(before: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = before[:, None] + move
    at = t.argmax(axis=0)
    return t[at, np.arange(S)], at


def viterbi(model: Model, shown: np.ndarray, entry: int | None = None, last: int | None = None) -> list[int]:
    """Best states of a run of lines: after state ``entry`` (None: from the start), ending in ``last`` (None: the best)."""
    if not len(shown):
        return []
    value = (model.start if entry is None else model.move[entry]) + shown[0]
    ways = []
    for e in shown[1:]:
        value, at = _best(value, model.move)
        value = value + e
        ways.append(at)
    states = [int(value.argmax()) if last is None else last]
    for at in reversed(ways):
        states.append(int(at[states[-1]]))
    return states[::-1]


def transfer(model: Model, shown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from the start: S; from each state before: S x S) best scores of ending in each state."""
    both = np.vstack([model.start, model.move]) + shown[0]
    for e in shown[1:]:
        both = (both[:, :, None] + model.move[None]).max(axis=1) + e
    return both[0], both[1:]


# ---------------------------------------------------------------- raw transcripts

_STYLES = (
    ("System: ", "User: ", "Assistant: "),
    ("System: ", "Human: ", "AI: "),
    ("### System\n", "### User\n", "### Assistant\n"),
    ("[system] ", "[user] ", "[assistant] "),
    ("Context: ", "Q: ", "A: "),
    ("- ", "- ", "- "),
)


def raw_transcripts(conversations: DataFrame, unmarked: int = 10) -> DataFrame:
    """(conv_id, turn, raw, gold): turns as a transcript would show them, in one style for each conversation.

    The style and the one turn in ``unmarked`` that lacks its marker follow from hashes of the ids.
    """
    style = F.pmod(F.xxhash64("conv_id", F.lit("style")), F.lit(len(_STYLES)))
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.coalesce("role", F.lit("user")))
    role = F.when(role > 0, role - 1).otherwise(1)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.element_at(F.array(*(F.lit(x) for s in _STYLES for x in s)), (style * len(ROLES) + role + 1).cast("int"))
    bare = F.pmod(F.xxhash64("conv_id", "turn", F.lit("bare")), F.lit(unmarked)) == 0
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(bare, text).otherwise(F.concat(mark, text)).alias("raw"),
        role.cast("int").alias("gold"),
    )


def train(raw: DataFrame) -> Model:
    """Counts over all labelled rows outside the held-out third; tables of a fixed size come to the driver."""
    prepare(raw.sparkSession)
    rows = raw.where(~held_out(F.col("conv_id")))

    def count(batches):
        total: dict[tuple[int, int, int], int] = {}
        for b in batches:
            for gold, text in zip(b["gold"], b["raw"], strict=True):
                for i, line in enumerate(text.split("\n")):
                    s = 2 * gold + (i > 0)
                    for f, v in enumerate(line_features(line)[0]):
                        total[f, s, v] = total.get((f, s, v), 0) + 1
                    if i:
                        key = (-1, s - (i == 1), s)
                        total[key] = total.get(key, 0) + 1
        yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["f", "s", "v", "n"])

    seen = rows.select("gold", "raw").mapInPandas(count, "f int, s int, v int, n long")
    last = (2 * F.col("gold") + F.when(F.instr("raw", "\n") > 0, 1).otherwise(0)).alias("s")
    ends = rows.select("conv_id", (F.col("turn") + 1).alias("turn"), last)
    moves = ends.join(rows.select("conv_id", "turn", (2 * F.col("gold")).alias("v")), ["conv_id", "turn"])
    moves = moves.groupBy("s", "v").agg(F.count("*").alias("n")).select(F.lit(-1).alias("f"), "s", "v", "n")
    begins = rows.where("turn = 0").groupBy((2 * F.col("gold")).alias("v")).agg(F.count("*").alias("n"))
    begins = begins.select(F.lit(-2).alias("f"), F.lit(0).alias("s"), "v", "n")
    table = seen.unionByName(moves).unionByName(begins).groupBy("f", "s", "v").agg(F.sum("n").alias("n")).collect()
    start, move = np.full(S, 0.1), np.full((S, S), 0.1)
    show = [np.full((S, n), 0.5) for n in _FEATURES]
    for r in table:
        if r["f"] == -2:
            start[r["v"]] += r["n"]
        elif r["f"] == -1:
            move[r["s"], r["v"]] += r["n"]
        else:
            show[r["f"]][r["s"], r["v"]] += r["n"]
    return Model(
        np.log(start / start.sum()),
        np.log(move / move.sum(axis=1, keepdims=True)),
        tuple(np.log(t / t.sum(axis=1, keepdims=True)) for t in show),
    )


# ---------------------------------------------------------------- parsing

_TURNS = "conv_id long, block long, local int, role string, content string, n_lines int, fresh int"


def _lines(part: pd.DataFrame) -> tuple[list[tuple[int, ...]], list[str]]:
    features, rests = [], []
    for text in part.sort_values(["turn", "raw"], na_position="first")["raw"]:
        for line in text.split("\n"):
            f, rest = line_features(line)
            features.append(f)
            rests.append(rest)
    return features, rests


def _turns(conv, block: int, states: list[int], rests: list[str], entry: int | None) -> list[tuple]:
    """Fragments of turns; ``local`` counts the turns begun in the block, from 1 (0: goes on with the one before)."""
    out, before, local = [], entry, 0
    for s, rest in zip(states, rests, strict=True):
        if before is None or s % 2 == 0 or s // 2 != before // 2:
            local += 1
            out.append([conv, block, local, ROLES[s // 2], [], 0])
        elif not out:
            out.append([conv, block, 0, ROLES[s // 2], [], 0])
        out[-1][4].append(rest)
        out[-1][5] += 1
        before = s
    return [(c, b, i, r, "\n".join(text), n, local) for c, b, i, r, text, n in out]


def parse(raw: DataFrame, model: Model, block_turns: int = 64, block_rows: int = 4096) -> DataFrame:
    """(conv_id, turn, role, content, n_lines, rendered): the canonical turns of transcripts (conv_id, turn, raw)."""
    spark = prepare(raw.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    rows = raw.select("conv_id", "turn", F.coalesce("raw", F.lit("")).alias("raw"))
    turn = F.coalesce(F.col("turn"), F.lit(-1))
    coarse = F.floor(turn / block_turns)
    # a turn number that very many rows share: its rows are cut by the first bytes of their text
    full = rows.groupBy("conv_id", coarse.alias("coarse")).agg(F.count("*").alias("n")).where(F.col("n") > block_rows)
    full = materialize(full, "full-blocks")
    rows = rows.withColumns({"coarse": coarse, "fine": F.lit(0).cast("long")})
    if not full.isEmpty():
        dense = rows["conv_id"].eqNullSafe(full["conv_id"]) & (rows["coarse"] == full["coarse"])
        crowded = rows.join(full, dense, "left_semi")
        lead = F.rpad(F.hex(F.encode(F.substring("raw", 1, 2), "utf-8")), 8, "0")
        fine = F.pmod(turn, F.lit(block_turns)) * F.lit(1 << 32) + F.conv(lead, 16, 10).cast("long")
        rows = rows.join(full, dense, "left_anti").unionByName(crowded.withColumn("fine", fine))
    blocks = rows.select("conv_id", "turn", "raw", F.struct("coarse", "fine").alias("key"))
    sizes = blocks.groupBy("conv_id", "key").agg(F.count("*").alias("n"))
    counts = sizes.groupBy("conv_id").agg(F.count("*").alias("blocks"))
    many = materialize(counts.where("blocks > 1"), "long-conversations")
    total = raw.count()
    tasks = max(1, -(-total // 2000))

    def whole(part):
        out = []
        for conv, mine in part.groupby("conv_id", dropna=False):
            features, rests = _lines(mine)
            states = viterbi(shared.value, shared.value.emissions(features))
            out += _turns(None if pd.isna(conv) else int(conv), 0, states, rests, None)
        return pd.DataFrame(out, columns=[c.split()[0] for c in _TURNS.split(", ")])

    same = blocks["conv_id"].eqNullSafe(many["conv_id"])
    short = blocks.join(many, same, "left_anti")
    task = F.pmod(F.xxhash64("conv_id"), F.lit(tasks))
    found = short.select("conv_id", "turn", "raw", task.alias("task")).groupBy("task").applyInPandas(whole, _TURNS)
    if not many.isEmpty():
        found = found.unionByName(_long_turns(blocks.join(many, same, "left_semi"), shared))
    found = materialize(found, "turns")
    # number the turns: those begun in earlier blocks come first
    from pyspark.sql import Window

    begun = found.groupBy("conv_id", "block").agg(F.max("fresh").alias("fresh"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    begun = begun.join(many, begun["conv_id"].eqNullSafe(many["conv_id"]), "left_semi")
    base = begun.withColumn("base", F.coalesce(F.sum("fresh").over(earlier), F.lit(0))).withColumnsRenamed(
        {"conv_id": "c", "block": "b"}
    )
    numbered = found.join(base, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("b")), "left")
    number = F.coalesce("base", F.lit(0)) + F.col("local") - 1
    turns = numbered.groupBy("conv_id", number.cast("long").alias("turn")).agg(
        F.max("role").alias("role"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "content"))), lambda x: x["content"]), "\n").alias(
            "content"
        ),
        F.sum("n_lines").cast("long").alias("n_lines"),
    )
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>\n"))
    return turns.withColumn("rendered", rendered)


def _long_turns(blocks: DataFrame, shared) -> DataFrame:
    """Fragments of turns of conversations of several blocks."""

    def reduce(part):
        features, _ = _lines(part)
        first, between = transfer(shared.value, shared.value.emissions(features))
        conv = part["conv_id"].iloc[0]
        return pd.DataFrame(
            {
                "conv_id": pd.array([None if pd.isna(conv) else int(conv)], "Int64"),
                "coarse": [part["coarse"].iloc[0]],
                "fine": [part["fine"].iloc[0]],
                "matrix": [np.vstack([first, between]).astype("<f8").tobytes()],
            }
        )

    flat = blocks.select("conv_id", "turn", "raw", "key.coarse", "key.fine")
    matrices = flat.groupBy("conv_id", "coarse", "fine").applyInPandas(
        reduce, "conv_id long, coarse long, fine long, matrix binary"
    )

    def chain(part):
        part = part.sort_values(["coarse", "fine"])
        m = [np.frombuffer(x, "<f8").reshape(S + 1, S) for x in part["matrix"]]
        forward = [m[0][0]]
        for x in m[1:]:
            forward.append((forward[-1][:, None] + x[1:]).max(axis=0))
        last = [int(forward[-1].argmax())]
        for i in range(len(m) - 1, 0, -1):
            last.append(int((forward[i - 1] + m[i][1:, last[-1]]).argmax()))
        last.reverse()
        return pd.DataFrame(
            {
                "conv_id": part["conv_id"].astype("Int64"),
                "coarse": part["coarse"],
                "fine": part["fine"],
                "block": np.arange(len(m)),
                "entry": [-1, *last[:-1]],
                "last": last,
            }
        )

    borders = materialize(
        matrices.groupBy("conv_id").applyInPandas(
            chain, "conv_id long, coarse long, fine long, block long, entry int, last int"
        ),
        "borders",
    ).withColumnsRenamed({"conv_id": "c", "coarse": "k", "fine": "f"})
    ready = flat.join(
        borders, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("coarse") == F.col("k")) & (F.col("fine") == F.col("f"))
    )

    def decode(part):
        features, rests = _lines(part)
        entry = int(part["entry"].iloc[0])
        entry = None if entry < 0 else entry
        states = viterbi(shared.value, shared.value.emissions(features), entry, int(part["last"].iloc[0]))
        conv = part["conv_id"].iloc[0]
        rows = _turns(None if pd.isna(conv) else int(conv), int(part["block"].iloc[0]), states, rests, entry)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _TURNS.split(", ")])

    return ready.select("conv_id", "turn", "raw", "block", "entry", "last").groupBy("conv_id", "block").applyInPandas(decode, _TURNS)
