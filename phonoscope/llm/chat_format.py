"""Chat formatting with minimum-cost role repair.

A legal conversation may open with a system message and then alternates user and assistant, from user to
assistant.  Each turn may start a message under its own role or another (a relabel), or join the message
before it (a merge); empty messages may be inserted anywhere.  The cheapest repair is found by dynamic
programming over the automaton of legal turns.

A conversation may hold any share of all rows, so it is not gathered: turns are put in order over the cluster by
range, which cuts long conversations into pieces of bounded size.  A piece acts on the automaton's states as
a min-plus matrix; the matrices of a cut conversation are composed in order, which fixes the state at each cut, and each
piece is then repaired and rendered on its own.  Rendered pieces in order are the formatted conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonoscope.llm.common import materialize, small

ROLES = ("system", "user", "assistant")
#: States of the automaton: nothing yet, or the role of the last message.
STATES = ("", *ROLES)
NEXT = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = "assistant"
#: Costs: a merge, a relabel, a relabel of a role that is none of the three, an empty message.
MERGE, RELABEL, UNKNOWN, INSERT = 2, 3, 1, 4
#: Template of a message; what joins merged turns.
HEAD, END, JOIN = "<|{role}|>\n", "<|end|>\n", "\n\n"
#: Turns in a piece, about.
PIECE = 20000
_FAR = 1 << 40


def _paths() -> dict[tuple[str, str], tuple[str, ...]]:
    """For each pair of states the fewest messages, and the first such in the order of ROLES, that lead from one to the other."""
    out = {(s, s): () for s in STATES}
    edge = [(s, s, ()) for s in STATES]
    while edge:
        edge = [(a, to, (*p, to)) for a, b, p in edge for to in NEXT[b]]
        edge = [e for e in edge if e[:2] not in out]
        for a, b, p in edge:
            out.setdefault((a, b), p)
    return out


PATHS = _paths()


def choices(role: str) -> list[tuple[str, str, int, str, tuple[str, ...]]]:
    """(state before, state after, cost, action, inserted roles) for a turn of this role, cheapest first for each pair of states."""
    best: dict[tuple[str, str], tuple] = {}
    for before in STATES:
        for label in ROLES:
            change = 0 if label == role else RELABEL if role in ROLES else UNKNOWN
            named = "keep" if not change else "relabel"
            options = []
            if before == label:
                options.append((MERGE + change, "merge", ()))
            for via in STATES:
                if label in NEXT[via] and (before, via) in PATHS:
                    path = PATHS[before, via]
                    options.append((INSERT * len(path) + change, named, path))
            for cost, action, path in options:
                known = best.get((before, label))
                if known is None or (cost, len(path)) < (known[0], len(known[2])):
                    best[before, label] = (cost, action, path)
    return sorted(((a, b, *rest) for (a, b), rest in best.items()), key=lambda c: (STATES.index(c[0]), STATES.index(c[1])))


CHOICES = {role: choices(role) for role in (*ROLES, "other")}


def role_of(role: str | None) -> str:
    role = (role or "").strip().lower()
    return role if role in ROLES else "other"


def _matrix(role: str) -> np.ndarray:
    m = np.full((len(STATES), len(STATES)), _FAR, dtype=np.int64)
    for a, b, cost, _, _ in CHOICES[role]:
        m[STATES.index(a), STATES.index(b)] = cost
    return m


MATRICES = {role: _matrix(role) for role in CHOICES}


def compose(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product: first a, then b."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), _FAR)


def piece_matrix(roles: list[str]) -> np.ndarray:
    """Costs from each entry to each exit state; composed pairwise, level by level."""
    maps = np.stack([MATRICES[r] for r in roles])
    while len(maps) > 1:
        odd = maps[-1:] if len(maps) % 2 else maps[:0]
        even = maps[: len(maps) // 2 * 2]
        maps = np.concatenate([np.minimum((even[0::2][:, :, :, None] + even[1::2][:, None, :, :]).min(axis=2), _FAR), odd])
    return maps[0]


def cut_states(matrices: list[np.ndarray]) -> list[tuple[str, str]]:
    """(entry, exit) of each piece on the cheapest repair of the whole; ties go to the earlier state."""
    costs = [np.array([0] + [_FAR] * (len(STATES) - 1))]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    end = [costs[-1][k] + INSERT * len(PATHS.get((s, FINAL), "x" * 99)) for k, s in enumerate(STATES)]
    k = int(np.argmin(end))
    out = []
    for m, before in zip(reversed(matrices), reversed(costs[:-1]), strict=True):
        j = int(np.argmin(before + m[:, k]))
        out.append((STATES[j], STATES[k]))
        k = j
    return out[::-1]


def repair(roles: list[str], entry: str, leave: str) -> list[tuple[str, str, tuple[str, ...]]]:
    """(action, role, inserted roles before it) of each turn on the cheapest way from entry to leave."""
    cost, back = {entry: 0}, []
    for role in roles:
        now: dict[str, tuple[int, tuple]] = {}
        for a, b, c, action, path in CHOICES[role]:
            if a in cost and (b not in now or cost[a] + c < now[b][0]):
                now[b] = (cost[a] + c, (a, action, path))
        cost = {b: c for b, (c, _) in now.items()}
        back.append({b: how for b, (_, how) in now.items()})
    state, out = leave, []
    for step in reversed(back):
        before, action, path = step[state]
        out.append((action, state, path))
        state = before
    return out[::-1]


def render(turns: list[tuple[str, str]], entry: str, leave: str, last: bool) -> list[list[tuple[str, str, str]]]:
    """For each turn (role, text) the (action, role, rendered text) rows it gives: messages inserted before it, itself, and after a conversation's last turn what closes it."""
    out, open_message = [], entry != ""
    steps = repair([r for r, _ in turns], entry, leave)
    for k, ((_, text), (action, role, path)) in enumerate(zip(turns, steps, strict=True)):
        rows = []
        for inserted in path:
            rows.append(("insert", inserted, (END if open_message else "") + HEAD.format(role=inserted)))
            open_message = True
        rows.append((action, role, (JOIN if action == "merge" else (END if open_message else "") + HEAD.format(role=role)) + text))
        open_message = True
        if last and k == len(turns) - 1:
            for inserted in PATHS[leave, FINAL]:
                rows.append(("insert", inserted, END + HEAD.format(role=inserted)))
            rows[-1] = (*rows[-1][:2], rows[-1][2] + END)
        out.append(rows)
    return out


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups out of batches in which the rows of a group are neighbours."""
    kept: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        named = batch[keys].astype(object).where(batch[keys].notna(), None)
        new = ((named != named.shift()) & ~(named.isna() & named.shift().isna())).any(axis=1)
        new.iloc[0] = True
        cuts = [*np.flatnonzero(new), len(batch)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            part = batch.iloc[a:b]
            if k == 0 and kept and all(_same(kept[-1][c].iloc[-1], part[c].iloc[0]) for c in keys):
                kept.append(part)
                continue
            if kept:
                yield pd.concat(kept)
            kept = [part]
    if kept:
        yield pd.concat(kept)


def _same(a: object, b: object) -> bool:
    return bool((pd.isna(a) and pd.isna(b)) or a == b)


def _summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for g in _groups(batches, ["conv", "piece"]):
        rows.append((g["conv"].iloc[0], g["piece"].iloc[0], len(g), piece_matrix(list(g["role"])).ravel().tolist()))
        if len(rows) >= 1000:
            yield pd.DataFrame(rows, columns=["conv", "piece", "n", "m"])
            rows = []
    yield pd.DataFrame(rows, columns=["conv", "piece", "n", "m"])


def _cuts(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
    pieces = pieces.sort_values("piece")
    size = len(STATES)
    states = cut_states([np.array(m).reshape(size, size) for m in pieces["m"]])
    counts = pieces["n"].to_numpy()
    return pd.DataFrame({"conv": pieces["conv"], "piece": pieces["piece"], "entry": [a for a, _ in states], "leave": [b for _, b in states], "rank": np.cumsum(counts) - counts, "last": [k == len(pieces) - 1 for k in range(len(pieces))]})


def _rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["conv", "turn", "rank", "sub", "role_in", "action", "role", "rendered"]
    rows = []
    for g in _groups(batches, ["conv", "piece"]):
        conv, entry, leave, rank, last = (g[c].iloc[0] for c in ("conv", "entry", "leave", "rank", "last"))
        turns = list(zip(g["role"], g["text"], strict=True))
        if pd.isna(leave):  # a conversation in one piece: nothing was cut, so its states are found here
            (entry, leave), rank, last = cut_states([piece_matrix(list(g["role"]))])[0], 0, True
        for k, (made, turn, given) in enumerate(zip(render(turns, entry, leave, bool(last)), g["turn"], g["role_in"], strict=True)):
            own = max(n for n, row in enumerate(made) if row[0] != "insert")
            for sub, (action, role, text) in enumerate(made):
                rows.append((conv, turn, int(rank) + k, sub, given if sub == own else None, action, role, text))
        if len(rows) >= 2000:
            yield pd.DataFrame(rows, columns=names)
            rows = []
    yield pd.DataFrame(rows, columns=names)


def formatted(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn and per inserted message: conv, turn, rank, sub, role_in, action, role, rendered.

    rank is the turn's place in its conversation and sub the row's place within the turn; `rendered` of all rows of a
    conversation, in that order, is the formatted text.  Roles are compared without case or outer
    white space; null and other roles are relabelled; a null text is empty; null conversation ids make one
    conversation; a null turn comes first, and turns with one number are ordered by role and text.
    """
    named = conversations.select(
        F.col(f"`{conv_col}`").cast("string").alias("conv"),
        F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.col(f"`{role_col}`").cast("string").alias("role_in"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )
    plain = F.lower(F.trim(F.coalesce("role_in", F.lit(""))))
    named = named.withColumn("role", F.when(plain.isin(*ROLES), plain).otherwise(F.lit("other")))
    order: list[Column] = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role_in").asc_nulls_first(), F.col("text").asc()]
    parts = max(1, -(-conversations.count() // PIECE))
    placed = named.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    turns = materialize(placed.withColumn("piece", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    # Only a conversation that reaches over a range's border is in more than one piece.
    cut = turns.groupBy("conv").agg(F.min("piece").alias("a"), F.max("piece").alias("b")).where("a < b").select("conv")
    cut = materialize(cut)
    back = turns.join(small(cut, 64), turns["conv"].eqNullSafe(cut["conv"]), "left_semi")
    split = back.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "at").select("conv", "piece", "role")
    summaries = split.mapInPandas(_summaries, "conv string, piece int, n long, m array<bigint>")
    states = materialize(summaries.groupBy("conv").applyInPandas(_cuts, "conv string, piece int, entry string, leave string, rank long, last boolean"))  # a row for each piece
    known = small(states.select(F.col("conv").alias("c"), F.col("piece").alias("p"), "entry", "leave", "rank", "last"), 128)
    joined = turns.join(known, turns["conv"].eqNullSafe(F.col("c")) & (turns["piece"] == F.col("p")), "left").drop("c", "p")
    whole = joined.repartition("conv", "piece").sortWithinPartitions("conv", "piece", "at")
    return whole.mapInPandas(_rendered, "conv string, turn long, rank long, sub int, role_in string, action string, role string, rendered string")


def op9_chat_format(spark, sf_dir: str) -> DataFrame:
    made = formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return made.withColumn("conv_id", F.col("conv").cast("long")).select("conv_id", "turn", "rank", "sub", "role_in", "action", "role", "rendered")


ORACLE = {
    "op9_chat_format": """
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, role AS role_in, coalesce(text, '') AS text,
         CASE WHEN lower(trim(role)) IN ('system', 'user', 'assistant') THEN lower(trim(role)) ELSE 'other' END AS role,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, coalesce(text, '')) - 1 AS rank,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations
), named(state, label) AS (VALUES (0, ''), (1, 'system'), (2, 'user'), (3, 'assistant')),
roles(role) AS (VALUES ('system'), ('user'), ('assistant'), ('other')),
steps AS (
  -- From a state to a state by a turn: a change of role, and a merge, an empty user message, or nothing besides.
  SELECT role, a.state AS a, b.state AS b, CASE WHEN a.state = b.state THEN 'merge' WHEN role = b.label THEN 'keep' ELSE 'relabel' END AS action,
         a.state <> b.state AND b.state = 3 AND a.state <> 2 AS inserts,
         CASE WHEN role = b.label THEN 0 WHEN role = 'other' THEN 1 ELSE 3 END + CASE WHEN a.state = b.state THEN 2 WHEN b.state = 3 AND a.state <> 2 THEN 4 ELSE 0 END AS cost
  FROM roles, named a, named b
  WHERE b.state > 0 AND (a.state = b.state OR b.state > 1 OR a.state = 0)
), costs AS (
  SELECT role, [coalesce(max(CASE WHEN a = 0 AND b = 1 THEN cost END), 1000000000), coalesce(max(CASE WHEN a = 1 AND b = 1 THEN cost END), 1000000000)] AS s,
         list(cost ORDER BY a) FILTER (b = 2) AS u, list(cost ORDER BY a) FILTER (b = 3) AS v
  FROM steps GROUP BY role
), priced AS (SELECT t.conv_id, t.rank, t.n, c.s, c.u, c.v FROM turns t JOIN costs c USING (role)),
ahead AS (
  SELECT conv_id, -1::BIGINT AS rank, [0::BIGINT, 1000000000, 1000000000, 1000000000] AS c FROM turns GROUP BY conv_id
  UNION ALL
  SELECT p.conv_id, p.rank, [1000000000::BIGINT, least(c[1] + s[1], c[2] + s[2]),
         least(c[1] + u[1], c[2] + u[2], c[3] + u[3], c[4] + u[4]), least(c[1] + v[1], c[2] + v[2], c[3] + v[3], c[4] + v[4])]
  FROM ahead a JOIN priced p ON p.conv_id IS NOT DISTINCT FROM a.conv_id AND p.rank = a.rank + 1
), before AS (SELECT p.*, a.c FROM priced p JOIN ahead a ON p.conv_id IS NOT DISTINCT FROM a.conv_id AND a.rank = p.rank - 1),
ends AS (
  SELECT a.conv_id, a.rank, [c[1] + 8, c[2] + 8, c[3] + 4, c[4]] AS e
  FROM ahead a JOIN priced p ON p.conv_id IS NOT DISTINCT FROM a.conv_id AND p.rank = a.rank AND p.rank = p.n - 1
), back AS (
  -- The state after each turn, and the one before it, from the last turn to the first; of equal ones the first.
  SELECT conv_id, rank, list_position(e, list_min(e)) - 1 AS state FROM ends
  UNION ALL
  SELECT b.conv_id, b.rank - 1,
         CASE k.state WHEN 1 THEN list_position([c[1] + s[1], c[2] + s[2]], least(c[1] + s[1], c[2] + s[2]))
           WHEN 2 THEN list_position([c[1] + u[1], c[2] + u[2], c[3] + u[3], c[4] + u[4]], least(c[1] + u[1], c[2] + u[2], c[3] + u[3], c[4] + u[4]))
           ELSE list_position([c[1] + v[1], c[2] + v[2], c[3] + v[3], c[4] + v[4]], least(c[1] + v[1], c[2] + v[2], c[3] + v[3], c[4] + v[4])) END - 1
  FROM back k JOIN before b ON b.conv_id IS NOT DISTINCT FROM k.conv_id AND b.rank = k.rank
), taken AS (
  SELECT t.*, x.action, x.inserts, n2.label, y.state
  FROM turns t
  JOIN back y ON y.conv_id IS NOT DISTINCT FROM t.conv_id AND y.rank = t.rank
  JOIN back z ON z.conv_id IS NOT DISTINCT FROM t.conv_id AND z.rank = t.rank - 1
  JOIN steps x ON x.role = t.role AND x.a = z.state AND x.b = y.state
  JOIN named n2 ON n2.state = y.state
), made AS (
  SELECT conv_id, turn, rank, 0 AS sub, NULL AS role_in, 'insert' AS action, 'user' AS role, '' AS text FROM taken WHERE inserts
  UNION ALL
  SELECT conv_id, turn, rank, CAST(inserts AS INTEGER), role_in, action, label, text FROM taken
  UNION ALL
  SELECT conv_id, turn, rank, CAST(inserts AS INTEGER) + 1, NULL, 'insert', 'user', '' FROM taken WHERE rank = n - 1 AND state < 2
  UNION ALL
  SELECT conv_id, turn, rank, CAST(inserts AS INTEGER) + CASE WHEN state < 2 THEN 2 ELSE 1 END, NULL, 'insert', 'assistant', '' FROM taken WHERE rank = n - 1 AND state < 3
)
SELECT conv_id, turn, rank, CAST(sub AS INTEGER) AS sub, role_in, action, role,
       CASE WHEN action = 'merge' THEN chr(10) || chr(10) WHEN rank = 0 AND sub = 0 THEN '<|' || role || '|>' || chr(10) ELSE '<|end|>' || chr(10) || '<|' || role || '|>' || chr(10) END
       || text || CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY rank DESC, sub DESC) = 1 THEN '<|end|>' || chr(10) ELSE '' END AS rendered
FROM made
"""
}
