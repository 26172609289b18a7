"""Transcripts to canonical chat turns: a hidden Markov model over lines finds who speaks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow, cut, table

ROLES = ("system", "user", "assistant")
SPEAKERS = {"system": 0, "instructions": 0, "context": 0, "user": 1, "human": 1, "customer": 1, "question": 1, "q": 1, "me": 1, "assistant": 2, "ai": 2, "bot": 2, "agent": 2, "model": 2, "answer": 2, "a": 2}
_MARKER = re.compile(r"^\s*(?:#+\s*|\*\*|\[|<\|?)?(" + "|".join(sorted(SPEAKERS, key=len, reverse=True)) + r")(?:\*\*|\]|\|?>)?\s*(?::\**|(?<=>)|(?<=\]))\s*", re.IGNORECASE)
#: Turns of a conversation that one task decodes in a row; a longer conversation is decoded block by block.
BLOCK = 256
START, NONE = 3, 3

# The model, in probabilities. Observations: marker (a role, or none), whether a turn may begin, question, length.
_CHANGE = np.log(np.array([[0.04, 0.90, 0.06], [0.02, 0.10, 0.88], [0.02, 0.90, 0.08], [0.25, 0.70, 0.05]]))
_STAY = np.log(np.where(np.eye(3, dtype=bool), 0.998, 0.001).tolist() + [[0.25, 0.70, 0.05]])
_MARKED = np.log(np.array([[0.95, 0.01, 0.01, 0.03], [0.01, 0.95, 0.01, 0.03], [0.01, 0.01, 0.95, 0.03]]))
_ASKS = np.array([0.02, 0.30, 0.08])
_LONG = np.log(np.array([[0.45, 0.45, 0.10], [0.55, 0.35, 0.10], [0.25, 0.40, 0.35]]))


def observe(line: str, first: bool) -> tuple[int, str]:
    """Marker, turn start, question and length in one number, and the line without its marker."""
    m = _MARKER.match(line)
    marker, rest = (SPEAKERS[m[1].lower()], line[m.end() :]) if m else (NONE, line)
    asks = rest.rstrip().endswith(("?", "？"))
    return marker + 4 * (first or m is not None) + 8 * asks + 16 * ((len(rest) > 80) + (len(rest) > 400)), rest


def _tables() -> np.ndarray:
    """Log weights of a step in millionths, [observation, role before (or START), role]: sums of integers are exact."""
    out = np.zeros((48, 4, 3))
    for o in range(48):
        marker, first, asks, length = o % 4, o // 4 % 2, o // 8 % 2, o // 16
        emit = _MARKED[:, marker] * first + np.log(_ASKS if asks else 1 - _ASKS) + _LONG[:, length]
        out[o] = (_CHANGE if first else _STAY) + emit
    return np.round(out * 1e6).astype(np.int64)


STEPS = _tables()


def transfer(observed: list[int]) -> np.ndarray:
    """Best log weight of all paths through these lines, [role before, role of the last line]."""
    best = STEPS[observed[0]]
    for o in observed[1:]:
        best = (best[:, :, None] + STEPS[o][None, :3, :]).max(axis=1)
    return best


def viterbi(observed: list[int], before: int = START, last: int | None = None) -> list[int]:
    """The likeliest roles, given the role before and, if known, the role of the last line; ties go to the lower role."""
    score = STEPS[observed[0]][before]
    back = []
    for o in observed[1:]:
        ways = score[:, None] + STEPS[o][:3]
        back.append(ways.argmax(axis=0))
        score = ways.max(axis=0)
    at = int(score.argmax()) if last is None else last
    out = [at]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


def _groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Runs of rows of one (conv_id, block); a row without a conv_id is a run of its own."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and (r["conv_id"] is None or (r["conv_id"], r["block"]) != (held[0]["conv_id"], held[0]["block"])):
                yield held
                held = []
            held.append(r)
    if held:
        yield held


def _lines(rows: list[dict]) -> list[list[tuple[int, str]]]:
    return [[observe(x, i == 0) for i, x in enumerate((r["text"] or "").split("\n"))] for r in rows]


def _bounds(rows: DataFrame) -> DataFrame:
    """(conv_id, block, before, last) for conversations of several blocks.

    A block is reduced to its transfer table (max-plus matrix) by a task of its own; only the tables of a conversation,
    one for BLOCK turns, meet in one task, which decodes the roles at the ends of blocks.
    """
    many = rows.groupBy("conv_id").agg(F.min("block").alias("p"), F.max("block").alias("q")).where("p < q").select("conv_id")
    some = rows.join(many, "conv_id", "left_semi")

    def reduce(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches):
            m = transfer([o for ls in _lines(g) for o, _ in ls])
            yield pa.record_batch([pa.array([g[0]["conv_id"]], pa.int64()), pa.array([g[0]["block"]], pa.int64()), pa.array([m.reshape(-1).tolist()])], names=["conv_id", "block", "m"])

    def solve(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("block")
        score, back = None, []
        for m in (np.array(v).reshape(4, 3) for v in x["m"]):
            ways = m[START:] if score is None else score[:, None] + m[:3]
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0)
        at, last, before = int(score.argmax()), [], []
        for k, b in reversed(list(enumerate(back))):
            last.append(at)
            at = START if k == 0 else int(b[at])
            before.append(at)
        return pd.DataFrame({"conv_id": x["conv_id"], "block": x["block"], "before": before[::-1], "last": last[::-1]})

    tables = arrow(_dealt(some), reduce, "conv_id long, block long, m array<bigint>")
    return tables.groupBy("conv_id").applyInPandas(solve, "conv_id long, block long, before int, last int")


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", F.col("turn").asc_nulls_last(), "text")


def parse(transcripts: DataFrame) -> DataFrame:
    """conv_id, turn, roles, n_lines and rendered for each row of transcripts(conv_id, turn, text).

    The lines of a conversation, in the order of turn and text, are observed by their speaker marker (if any), whether
    a turn may begin there, a question mark and their length; the likeliest sequence of roles is decoded over the whole
    conversation, exactly, in blocks of turns (of equally likely sequences, blocks decide which). rendered has each run of lines of one role as
    `<|role|>`, the lines without markers, and `<|end|>`; roles has the role of each run.

    Null or empty text: one empty line, which gets a role from its neighbours. Null turn: after all others. A row
    without a conv_id is a conversation of its own. Repeated rows are turns of their own; other columns are ignored.
    """
    turn = F.col("turn").cast("long")
    rows = transcripts.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("turn"), F.col("text").cast("string").alias("text"), F.coalesce(F.floor(turn / BLOCK), F.lit((1 << 62))).cast("long").alias("block"))
    bounds = cut(_bounds(rows.where("conv_id is not null")), "bounds")
    joined = rows.join(bounds, ["conv_id", "block"], "left").select("conv_id", "block", "turn", "text", "before", "last")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for g in _groups(batches):
            lines = _lines(g)
            before = START if g[0]["before"] is None else g[0]["before"]
            roles = iter(viterbi([o for ls in lines for o, _ in ls], before, g[0]["last"]))
            for r, ls in zip(g, lines, strict=True):
                spoken: list[tuple[int, list[str]]] = []
                for o, x in ls:
                    role = next(roles)
                    if not spoken or role != spoken[-1][0] or o % 4 != NONE:
                        spoken.append((role, []))
                    spoken[-1][1].append(x)
                text = "".join(f"<|{ROLES[k]}|>\n" + "\n".join(x) + "\n<|end|>\n" for k, x in spoken)
                out.append((r["conv_id"], r["turn"], [ROLES[k] for k, _ in spoken], len(ls), text))
            if len(out) >= 2000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return arrow(_dealt(joined), run, "conv_id long, turn long, roles array<string>, n_lines long, rendered string")


def _batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = (("conv_id", pa.int64()), ("turn", pa.int64()), ("roles", pa.list_(pa.string())), ("n_lines", pa.int64()), ("rendered", pa.string()))
    return pa.record_batch([pa.array([r[i] for r in out], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def transcripts_of(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as a transcript: each turn's text after a speaker marker, if its role is known."""
    role = F.col("role").cast("string")
    return conversations.select("conv_id", "turn", F.concat(F.when(role.isNull() | (role == ""), "").otherwise(F.concat(F.initcap(role), F.lit(": "))), F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = parse(transcripts_of(table(spark, sf_dir, "conversations")))
    return out.select("conv_id", "turn", F.get("roles", F.lit(0)).alias("role"), F.size("roles").alias("n_runs"), "n_lines", F.sha2("rendered", 256).alias("rendered_sha256"))
