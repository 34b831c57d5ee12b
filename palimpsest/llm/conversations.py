"""Repair of conversations by weighted finite-state composition.

The rows of a conversation are an input acceptor, what may be done with a row is an edit transducer, and the
legal orders of roles are a grammar acceptor. Their composition is built lazily, one column of states a row,
and searched from the end for the path of least (cost, labels): labels are put in front of what follows, which
keeps the order of strings, so the least path of every state is known before it is used. Rows that offer the
same edits and end in the same costs have the same column, which is composed once and remembered.

A conversation is read in order by one task, as its digest has to be; what is held of a row is a few bytes, and
texts of a long conversation wait on disk until its edits are known.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidied

WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
#: Grammar of role initials, (s?(ua)+)?: state -> {initial: next state}.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING = {0, 3}
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
_DELETE, _REROLE, _INSERT, _MEND = 4, 3, 3, 3
_NEVER = 1 << 40


def row_edits(initial: str, fault: int) -> list[tuple[str, int, str]]:
    """Arcs of the edit transducer that read one row: (label, cost, initial written, if any)."""
    arcs = [("D", _DELETE, "")]
    if fault not in (BLANK, DUPLICATE):
        mend = _MEND if fault == TRUNCATED else 0
        arcs.append(("K", mend, initial))
        arcs += [("R", _REROLE + mend, to) for to in ROLES]
    return arcs


def _column(arcs: list[tuple[str, int, str]], after: tuple[int, ...]) -> tuple[list[int], list[tuple]]:
    """Least costs from each grammar state before a row, and (labels, initials inserted, edit, initial written, next state).

    More than two insertions in a row lead nowhere that fewer do not; no labels of one column start another's.
    """
    costs, steps = [], []
    for q in GRAMMAR:
        best: tuple = (_NEVER, "")
        paths = [(q, 0, "")]
        for state, spent, put in paths:
            for label, cost, out in arcs:
                to = GRAMMAR[state].get(out) if out else state
                if to is not None:
                    best = min(best, (spent + cost + after[to], "I" * len(put) + label, put, label, out, to))
            if len(put) < 2:
                paths += [(to, spent + _INSERT, put + out) for out, to in GRAMMAR[state].items() if out in ROLES]
        costs.append(best[0])
        steps.append(best[1:])
    return costs, steps


def _ending() -> tuple[list[int], list[str]]:
    """The column after the last row: insertions until the grammar accepts."""
    costs, puts = [], []
    for q in GRAMMAR:
        put = ""
        while q not in ACCEPTING:
            out, q = next((o, t) for o, t in GRAMMAR[q].items() if o in ROLES)
            put += out
        costs.append(_INSERT * len(put))
        puts.append(put)
    return costs, puts


class Composer:
    """Shortest paths through the lazily composed columns of conversations."""

    def __init__(self):
        self.known: dict[tuple, tuple] = {}
        self.kinds: list[tuple[str, int]] = []
        self.number: dict[tuple[str, int], int] = {}
        self.last, self.puts = _ending()

    def kind(self, initial: str, fault: int) -> int:
        key = (initial if initial in ("s", "u", "a") else "?", fault)
        if key not in self.number:
            self.number[key] = len(self.kinds)
            self.kinds.append(key)
        return self.number[key]

    def repair(self, kinds) -> tuple[int, Iterator[tuple[str, str, str]]]:
        """Least cost, and for each row (initials inserted before it, edit, initial written); one more for the end."""
        total, after = min(self.last), tuple(c - min(self.last) for c in self.last)
        columns: list = []
        numbers, used = array("I"), {}
        for k in reversed(kinds):
            step = self.known.get((k, after))
            if step is None:
                costs, steps = _column(row_edits(*self.kinds[k]), after)
                least = min(costs)
                step = self.known[k, after] = (least, tuple(c - least for c in costs), steps)
            total, after = total + step[0], step[1]
            if id(step) not in used:
                used[id(step)] = len(columns)
                columns.append(step[2])
            numbers.append(used[id(step)])

        def walk():
            q = 0
            for i in reversed(range(len(numbers))):
                _, put, label, out, q = columns[numbers[i]][q]
                yield put, label, out
            yield self.puts[q], "", ""

        return total + after[0], walk()


class Conversation:
    """Rows of one conversation as they come: facts in arrays, texts in memory up to ``held`` bytes and on disk beyond."""

    def __init__(self, key, held: int):
        self.key = key
        self.words = tempfile.SpooledTemporaryFile(max_size=held)  # noqa: SIM115  closed by close()
        self.sizes, self.initials, self.faults = array("q"), bytearray(), bytearray()
        self.digests = bytearray()
        self.illegal = self.turns = 0
        self.low = self.high = self.before = None

    def add(self, turn, role: str, text: str) -> None:
        raw_role, raw = role.encode(), text.encode()
        bare = text.rstrip(WHITE)
        self.faults.append(BLANK if not bare else 0 if bare[-1] in ".!?" else TRUNCATED)
        h = hashlib.blake2b(raw, digest_size=16, person=b"turn")
        h.update(b"\0%d\0" % len(raw) + raw_role)
        self.digests += h.digest()
        first = role[:1] if role[:1] in ("s", "u", "a") else "?"
        if self.initials:
            self.illegal += chr(self.initials[-1]) + first not in ("su", "ua", "au")
        self.initials.append(ord(first))
        self.words.write(raw_role + raw)
        self.sizes.extend((len(raw_role), len(raw)))
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.high
            self.high = turn

    def mark_copies(self) -> None:
        """What is not blank and stands earlier with the same role is a duplicate (equal by 128 bits of a digest)."""
        two = np.frombuffer(bytes(self.digests), dtype="<u8").reshape(-1, 2)
        order = np.lexsort((two[:, 1], two[:, 0]))  # stable: the earliest of equal rows first
        again = order[1:][(two[order[1:]] == two[order[:-1]]).all(1)]
        faults = np.frombuffer(self.faults, dtype=np.uint8)
        faults[again[faults[again] != BLANK]] = DUPLICATE

    def edits(self, composer: Composer) -> tuple[int, Iterator[tuple[str, str, str]]]:
        if len(self.faults) > 1:
            self.mark_copies()
        kinds = {}
        for pair in set(zip(self.initials, self.faults)):
            kinds[pair] = composer.kind(chr(pair[0]), pair[1])
        return composer.repair([kinds[p] for p in zip(self.initials, self.faults)])

    def texts(self) -> Iterator[tuple[str, str]]:
        self.words.seek(0)
        for i in range(0, len(self.sizes), 2):
            yield self.words.read(self.sizes[i]).decode(), self.words.read(self.sizes[i + 1]).decode()

    def report(self, composer: Composer) -> tuple:
        """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest of the repaired rows)."""
        cost, edits = self.edits(composer)
        audit, digest, texts, first = [], hashlib.sha256(), self.texts(), True
        for put, label, out in edits:
            audit.append("I" * len(put) + label)
            rows = [f"{ROLES[p]}:" for p in put]
            if label:
                role, text = next(texts)
                if label != "D":
                    rows.append(f"{role if label == 'K' else ROLES[out]}:{text}")
            for row in rows:
                digest.update((row if first else "\n" + row).encode())
                first = False
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (gaps, *(self.faults.count(f) for f in (BLANK, DUPLICATE, TRUNCATED)), self.illegal, cost, "".join(audit), digest.hexdigest())

    def rows(self, composer: Composer) -> Iterator[tuple]:
        """(step, edit, role, text) for each edit; a deleted row has neither role nor text."""
        _, edits = self.edits(composer)
        texts, step = self.texts(), 0
        for put, label, out in edits:
            for p in put:
                yield step, "I", ROLES[p], ""
                step += 1
            if label:
                role, text = next(texts)
                yield (step, "D", None, None) if label == "D" else (step, label, role if label == "K" else ROLES[out], text)
                step += 1

    def close(self) -> None:
        self.words.close()


def _in_order(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).cast("long").alias("_turn"), text(role_col).alias("_role"), text(text_col).alias("_text"))
    # null ids are one conversation; rows of one turn lie by role and text
    return rows.repartition("_conv").sortWithinPartitions("_conv", "_turn", "_role", "_text")


def _by_conversation(rows: DataFrame, conv_col: str, added: list[tuple[str, str]], make: Callable, held: int) -> DataFrame:
    """``make(conversation, composer)`` -> rows of ``added``, for each conversation of rows that lie in order."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    kinds = [to_arrow_type(_parse_datatype_string(t)) for _, t in added]
    key_kind = to_arrow_type(rows.schema["_conv"].dataType)
    names = ["_conv", *(c for c, _ in added)]

    def run(batches):
        composer, out, size = Composer(), [], 0

        def batch():
            columns = list(zip(*out)) or [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in zip(columns, [key_kind, *kinds])], names=names)

        def done(c):
            nonlocal out, size
            for row in make(c, composer):
                out.append((c.key, *row))
                size += 64 + sum(len(x) for x in row if isinstance(x, str))
                if size > 1 << 23:
                    yield batch()
                    out, size = [], 0
            c.close()

        now = None
        for b in batches:
            for key, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("_conv", "_turn", "_role", "_text"))):
                if now is None or key != now.key:
                    if now is not None:
                        yield from done(now)
                    now = Conversation(key, held)
                now.add(turn, role, text)
        if now is not None:
            yield from done(now)
        yield batch()

    schema = f"_conv {rows.schema['_conv'].dataType.simpleString()}, " + ", ".join(f"`{c}` {t}" for c, t in added)
    return rows.mapInArrow(tidied(run), schema).withColumnRenamed("_conv", conv_col)


REPORT = [(c, "long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", "string"), ("repaired_sha256", "string")]
HELD = 1 << 25


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", held: int = HELD) -> DataFrame:
    """(conv_id, step, edit, role, text): the edits of each conversation in order; deleted rows carry null role and text.

    Nulls, ties, long texts and empty tables are treated as in ``repair_report``.
    """
    rows = _in_order(turns, conv_col, turn_col, role_col, text_col)
    return _by_conversation(rows, conv_col, [("step", "long"), ("edit", "string"), ("role", "string"), ("text", "string")], lambda c, composer: c.rows(composer), held)


def repair_report(turns: DataFrame, ids: DataFrame | None = None, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", held: int = HELD) -> DataFrame:
    """One row a conversation: gaps, faults, illegal neighbours, cost, audit and the digest of its repaired rows.

    Conversations of ``ids`` that have no row come with zeros, an empty audit and the digest of nothing. Null roles
    and texts are one space, null ids one conversation, null turns come first and leave no gap. Rows of one turn lie
    by role, then text; repeated rows are duplicates. Roles are told by their first letter, also where it is none of
    the grammar's. Texts are read whole, those of conversations beyond ``held`` bytes wait in a temporary file of the
    task. Other columns are ignored, whatever their names; an empty table gives no row.
    """
    found = _by_conversation(_in_order(turns, conv_col, turn_col, role_col, text_col), conv_col, REPORT, lambda c, composer: [c.report(composer)], held)
    if ids is None:
        return found
    every = ids.select(F.col(conv_col).alias("_every")).distinct()
    rows = every.join(found.hint("shuffle_merge"), F.col("_every").eqNullSafe(F.col(conv_col)), "left")
    nothing = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return rows.select(F.col("_every").alias(conv_col), *[F.coalesce(c, F.lit(nothing.get(c, 0)).cast(t)).alias(c) for c, t in REPORT])


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) with the faults that crc32 of ``conv_id:turn`` modulo 20 deals out.

    0 drops the row, 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes its role user; nulls of role and
    text, and of id and turn where they are hashed, are one space.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20).alias("_fault"))
    rows = rows.filter("_fault <> 0").withColumn("_copy", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    changed = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), changed.alias("text"))


#: DuckDB: crc32 byte by byte, and the least (cost, audit) of each grammar state from the last row to the first.
REPAIR_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), dealt AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(k) + 1), lambda i: ascii(k[i])::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 20 AS f
  FROM marked, crc
), rows_ AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM dealt, (SELECT unnest([0, 1]) AS copy) WHERE f <> 0 AND (copy = 0 OR f = 3)
), placed AS (
  SELECT *, row_number() OVER w AS pos, substr(role, 1, 1) AS x, lag(substr(role, 1, 1)) OVER w AS before
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), facts AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault
  FROM placed
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM facts GROUP BY conv_id
), best AS (
  -- one struct (cost, audit, repaired rows, each closed by a line feed) a state of the grammar
  SELECT conv_id, n AS pos, {'c': 0, 'l': '', 'r': ''} AS q0, {'c': 6, 'l': 'II', 'r': E'user:\nassistant:\n'} AS q1, {'c': 3, 'l': 'I', 'r': E'assistant:\n'} AS q2, {'c': 0, 'l': '', 'r': ''} AS q3 FROM counts
  UNION ALL
  SELECT conv_id, pos - 1,
         list_sort([d0, {'c': ku.c + k_u, 'l': 'K' || ku.l, 'r': ku.r}, {'c': ks.c + k_s, 'l': 'K' || ks.l, 'r': ks.r}, {'c': ru.c + k_r, 'l': 'R' || ru.l, 'r': ru.r}, {'c': i3.c + 3, 'l': 'I' || i3.l, 'r': E'user:\n' || i3.r}])[1],
         list_sort([d1, {'c': ku.c + k_u, 'l': 'K' || ku.l, 'r': ku.r}, {'c': ru.c + k_r, 'l': 'R' || ru.l, 'r': ru.r}, {'c': i3.c + 3, 'l': 'I' || i3.l, 'r': E'user:\n' || i3.r}])[1],
         i3,
         list_sort([d3, {'c': ku.c + k_u, 'l': 'K' || ku.l, 'r': ku.r}, {'c': ru.c + k_r, 'l': 'R' || ru.l, 'r': ru.r}, {'c': i3.c + 3, 'l': 'I' || i3.l, 'r': E'user:\n' || i3.r}])[1]
  FROM (
    SELECT *,
           -- after u: an assistant row, or an inserted one before what a state after a would do
           list_sort([d2, {'c': ka.c + k_a, 'l': 'K' || ka.l, 'r': ka.r}, {'c': ra.c + k_r, 'l': 'R' || ra.l, 'r': ra.r},
                      {'c': d3.c + 3, 'l': 'I' || d3.l, 'r': E'assistant:\n' || d3.r}, {'c': ku.c + k_u + 3, 'l': 'IK' || ku.l, 'r': E'assistant:\n' || ku.r}, {'c': ru.c + k_r + 3, 'l': 'IR' || ru.l, 'r': E'assistant:\n' || ru.r}])[1] AS i3
    FROM (
      SELECT b.conv_id, b.pos,
             {'c': q0.c + 4, 'l': 'D' || q0.l, 'r': q0.r} AS d0, {'c': q1.c + 4, 'l': 'D' || q1.l, 'r': q1.r} AS d1, {'c': q2.c + 4, 'l': 'D' || q2.l, 'r': q2.r} AS d2, {'c': q3.c + 4, 'l': 'D' || q3.l, 'r': q3.r} AS d3,
             {'c': q1.c, 'l': q1.l, 'r': role || ':' || text || E'\n' || q1.r} AS ks, {'c': q2.c, 'l': q2.l, 'r': role || ':' || text || E'\n' || q2.r} AS ku, {'c': q3.c, 'l': q3.l, 'r': role || ':' || text || E'\n' || q3.r} AS ka,
             {'c': q2.c, 'l': q2.l, 'r': 'user:' || text || E'\n' || q2.r} AS ru, {'c': q3.c, 'l': q3.l, 'r': 'assistant:' || text || E'\n' || q3.r} AS ra,
             CASE WHEN fault IN (1, 2) OR x <> 's' THEN 1000000000 WHEN fault = 3 THEN 3 ELSE 0 END AS k_s,
             CASE WHEN fault IN (1, 2) OR x <> 'u' THEN 1000000000 WHEN fault = 3 THEN 3 ELSE 0 END AS k_u,
             CASE WHEN fault IN (1, 2) OR x <> 'a' THEN 1000000000 WHEN fault = 3 THEN 3 ELSE 0 END AS k_a,
             CASE WHEN fault IN (1, 2) THEN 1000000000 WHEN fault = 3 THEN 6 ELSE 3 END AS k_r
      FROM best b JOIN facts f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.pos = b.pos
    )
  )
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(q0.c, 0)::BIGINT AS cost, coalesce(q0.l, '') AS audit, sha256(coalesce(left(q0.r, length(q0.r) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM i.conv_id AND b.pos = 0
"""
