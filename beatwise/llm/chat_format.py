"""Transcript parsing by a hidden Markov model, and canonical rendering of the turns.

A line's hidden state is the role it belongs to and whether it opens a turn; what is seen is the kind of speaker marker
in front and the shape of the line. Viterbi runs over pieces of a transcript apart: a piece becomes a matrix of the best
scores from each state before it to each at its end, these are chained per transcript, and each piece is then decoded
between its two known states. Scores are integers, so the chain is exact.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")
#: Names of speakers in transcripts.
NAMES = {"system": ("system", "instructions", "context"), "user": ("user", "human", "question", "q", "customer"),
         "assistant": ("assistant", "ai", "bot", "answer", "a", "model")}
#: Positions are (turn << TURN_BITS) + line; a piece has 2^PIECE_BITS of those.
TURN_BITS, PIECE_BITS = 20, 25
STATES = [(role, opens) for role in ROLES for opens in (True, False)]
KINDS = 4 * 3
ONE = 1_000_000


def _marker(role: str) -> str:
    names = "|".join(NAMES[role])
    return rf"^\s*(?:<\|(?:{names})\|>|\[(?:{names})\]|#{{2,4}}\s*(?:{names})\s*:?\s*$|\*\*(?:{names}):?\*\*:?|(?:{names})\s*[:>])\s*"


def _kind(line: Column) -> Column:
    """Marker (0: none, else the role's number) and shape (blank, up to 80 characters, longer) as one number."""
    low = F.lower(line)
    marker = F.lit(0)
    for i, role in reversed(list(enumerate(ROLES))):
        marker = F.when(low.rlike(_marker(role)), i + 1).otherwise(marker)
    shape = F.when(F.trim(line) == "", 0).when(F.length(line) <= 80, 1).otherwise(2)
    return marker * 3 + shape


def as_transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id, pos, line and the true role and ``opens`` of the lines of plain transcripts of ``conversations``
    (conv_id, turn, role, text). Six manners of marking speakers take turns by conv_id. Null text is empty; turns
    without number or with a role that is not known are left out."""
    role = F.lower(F.trim("role"))
    style = F.pmod(F.xxhash64("conv_id"), F.lit(6))
    title = F.initcap(role)
    human = F.when(role == "user", "Human").when(role == "assistant", "AI").otherwise("System")
    short = F.when(role == "user", "Q").when(role == "assistant", "A").otherwise("Context")
    text = F.coalesce("text", F.lit(""))
    shown = (F.when(style == 0, F.concat(title, F.lit(": "), text)).when(style == 1, F.concat(F.lit("### "), human, F.lit("\n"), text))
             .when(style == 2, F.concat(F.lit("<|"), role, F.lit("|>\n"), text)).when(style == 3, F.concat(F.lit("["), role, F.lit("] "), text))
             .when(style == 4, F.concat(F.lit("**"), human, F.lit(":** "), text)).otherwise(F.concat(short, F.lit(": "), text)))
    return (conversations.filter(F.col("turn").isNotNull() & role.isin(*ROLES))
            .select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), F.posexplode(F.split(shown, "\n", -1)).alias("n", "line"))
            .select("conv_id", (F.shiftleft("turn", TURN_BITS) + F.col("n")).alias("pos"), "line", "role", (F.col("n") == 0).alias("opens")))


def train(lines: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Integer log scores (transitions, emissions) from the counts of all labelled ``lines`` (line, role, opens)."""
    seen = np.ones((len(STATES), KINDS)) * 0.1
    for r in lines.groupBy("role", "opens", _kind(F.col("line")).alias("kind")).count().collect():
        seen[STATES.index((r["role"], r["opens"])), r["kind"]] += r["count"]
    total = seen.sum(axis=1)
    go = np.full((len(STATES), len(STATES)), 1e-9)
    opened = total[::2] / total[::2].sum()
    for i, (role, _) in enumerate(STATES):
        k = ROLES.index(role)
        stay = total[2 * k + 1] / (total[2 * k] + total[2 * k + 1])
        go[i, 2 * k + 1] = stay
        go[i, ::2] = (1 - stay) * opened
    whole = lambda p: np.round(ONE * np.log(p)).astype("int64")
    return whole(go), whole(seen / total[:, None])


def _step(enter: np.ndarray, go: np.ndarray, emission: np.ndarray) -> np.ndarray:
    """Best scores to each state one line on; ``enter`` has one row per state before the piece."""
    return (enter[:, :, None] + go[None]).max(axis=1) + emission


def canonical_turns(lines: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """conv_id, turn (from 0), role, text and rendered form of the turns of ``lines`` (conv_id, pos, line).

    Lines follow ``pos``, equal ones the line; a null line is empty. Markers are cut from opening lines, and an opening
    line that was only a marker goes. Lines before any marker are a turn of the role that fits best. Lines without
    conv_id are one transcript. A piece holds the lines of 32 turns; one row per piece meets in a task per transcript.
    """
    go, emissions = model
    own = lines.select("conv_id", "pos", F.coalesce("line", F.lit("")).alias("line")).withColumns(
        {"piece": F.shiftright("pos", PIECE_BITS), "kind": _kind(F.col("line"))})
    conv = own.schema["conv_id"].dataType.simpleString()
    nowhere = -(1 << 60)

    def matrix(frame: pd.DataFrame) -> pd.DataFrame:
        m = np.full((len(STATES), len(STATES)), nowhere)
        np.fill_diagonal(m, 0)
        for kind in frame.sort_values(["pos", "line"])["kind"]:
            m = _step(m, go, emissions[:, kind])
        return pd.DataFrame({"conv_id": frame["conv_id"].iloc[:1].to_numpy(), "piece": [frame["piece"].iat[0]], "m": [m.ravel()]})

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece")
        steps = [np.asarray(m).reshape(len(STATES), -1) for m in frame["m"]]
        # Before the first line any turn may have ended: all states stand for the start alike.
        best = [np.zeros(len(STATES), "int64")]
        for m in steps:
            best.append((best[-1][:, None] + m).max(axis=0))
        leave = [int(best[-1].argmax())]
        for m, b in zip(reversed(steps), reversed(best[:-1])):
            leave.append(int((b + m[:, leave[-1]]).argmax()))
        leave.reverse()
        return pd.DataFrame({"conv_id": frame["conv_id"], "piece": frame["piece"], "enter": leave[:-1], "leave": leave[1:]})

    def decode(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pos", "line"])
        score, back = np.full(len(STATES), nowhere), []
        score[frame["enter"].iat[0]] = 0
        for kind in frame["kind"]:
            every = score[:, None] + go
            back.append(every.argmax(axis=0))
            score = every.max(axis=0) + emissions[:, kind]
        state = [int(frame["leave"].iat[0])]
        for b in reversed(back[1:]):
            state.append(int(b[state[-1]]))
        state = np.array(state[::-1])
        opens = state % 2 == 0
        return pd.DataFrame({"conv_id": frame["conv_id"], "piece": frame["piece"], "pos": frame["pos"], "line": frame["line"],
                             "role": [STATES[s][0] for s in state], "opens": opens, "local": np.cumsum(opens)})

    pieces = own.groupBy("conv_id", "piece").applyInPandas(matrix, f"conv_id {conv}, piece long, m array<long>")
    ends = pieces.groupBy("conv_id").applyInPandas(chain, f"conv_id {conv}, piece long, enter int, leave int")
    ends = ends.select(F.col("conv_id").alias("_c"), F.col("piece").alias("_p"), "enter", "leave")
    ready = own.join(ends, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_p"))).drop("_c", "_p")
    decoded = ready.groupBy("conv_id", "piece").applyInPandas(
        decode, f"conv_id {conv}, piece long, pos long, line string, role string, opens boolean, local long")
    counts = decoded.groupBy("conv_id", "piece").agg(F.max("local").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("conv_id").alias("_c"), F.col("piece").alias("_p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = decoded.join(counts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("piece") == F.col("_p")))
    every = "|".join(_marker(r) for r in ROLES)
    bare = F.when(F.col("opens"), F.regexp_replace("line", f"(?i)(?:{every})", "")).otherwise(F.col("line"))
    kept = F.when(F.col("opens") & (bare == ""), F.lit(None)).otherwise(bare)
    turns = placed.groupBy("conv_id", (F.col("before") + F.col("local")).alias("turn")).agg(
        F.first("role").alias("role"), F.array_sort(F.collect_list(F.struct("pos", "line", kept.alias("kept")))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda v: v["kept"]), "\n")
    # A transcript that opens with a marker has its first turn at 1, one that does not at 0.
    least = turns.groupBy("conv_id").agg(F.min("turn").alias("least")).withColumnRenamed("conv_id", "_c")
    return turns.join(least, F.col("conv_id").eqNullSafe(F.col("_c"))).select(
        "conv_id", (F.col("turn") - F.col("least")).alias("turn"), "role", text.alias("text"),
        F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), text, F.lit("\n<|end|>")).alias("rendered"))
