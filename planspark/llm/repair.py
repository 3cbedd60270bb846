"""Conversation structure repair by Hirschberg's divide and conquer over four states.

A conversation is well formed if its roles read ``(s?(ua)+)?``: an optional system row, then pairs of user and
assistant. What stands before a row is one of four states (nothing, system, user, assistant), so the cheapest
edits are a path of states. Forward cost vectors over the first half and backward cost vectors over the second
half meet mid-conversation; the cheapest crossing is taken and both halves are solved alike. Of crossings that
cost the same the one with the ASCII-least audit is taken: the forward vector carries, beside each state's cost,
the rank of its least audit among the four, which is all that is needed, as from one state a letter leads to
one state only and so no audit of a stretch is the beginning of another. Nothing but vectors is kept.

A stretch of rows acts on the vector as a table of 16 costs and ranks, and tables compose like rows do. So
conversations are cut in blocks of bounded size wherever rows happen to lie after a range sort; blocks that hold
a whole conversation are solved at once, and of others only the tables meet, to settle the states at their borders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, join_counted, plain, table, written

#: Costs of the edits; a truncated row that stays costs TRUNCATED more.
DELETE, INSERT, RENAME, TRUNCATED = 3, 2, 2, 1
#: States: nothing yet, after system, after user, after assistant. What a user or assistant row may follow:
USER_AFTER, ASSISTANT_AFTER, USER, ASSISTANT = (0, 1, 3), (2,), 2, 3
#: Faults of a row, by number.
FAULTS = (None, "blank", "duplicate", "truncated")
#: Rows of a block at most.
BLOCK = 4096
FAR = 1 << 60
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

Table = tuple[list[list[int]], list[list[int]]]


def _moves(code: int) -> list[list[tuple[int, str] | None]]:
    """Cheapest cost and then ASCII-least letters from state to state over one row, inserts before it included.

    code is 4 * (0 system, 1 user, 2 assistant, 3 other) + fault.
    """
    initial, fault = divmod(code, 4)
    out: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]

    def offer(p: int, q: int, cost: int, letters: str) -> None:
        if out[p][q] is None or (cost, letters) < out[p][q]:
            out[p][q] = (cost, letters)

    for p in range(4):
        state, paid, letters = p, 0, ""
        for _ in range(3):  # none, one or two inserts
            offer(p, state, paid + DELETE, letters + "D")
            if fault not in (1, 2):
                more = TRUNCATED * (fault == 3)
                to = USER if state in USER_AFTER else ASSISTANT
                offer(p, to, paid + RENAME + more, letters + "R")
                if initial == 0 and state == 0:
                    offer(p, 1, paid + more, letters + "K")
                if initial == to - 1:
                    offer(p, to, paid + more, letters + "K")
            state, paid, letters = (USER if state in USER_AFTER else ASSISTANT), paid + INSERT, letters + "I"
    return out


MOVES = [_moves(c) for c in range(16)]
STEPS: list[Table] = [([[FAR if m is None else m[0] for m in row] for row in moves], [[sorted(x[1] for x in row if x).index(m[1]) if m else 0 for m in row] for row in moves]) for moves in MOVES]
#: Cost and letters from each state to the end.
END = [(0, ""), (2 * INSERT, "II"), (INSERT, "I"), (0, "")]


def forward(steps: list[Table], lo: int, hi: int, state: int) -> tuple[list[int], list[int]]:
    """Cost from state to each state over steps lo .. hi-1, and the rank of its least audit among the four."""
    cost, rank = [FAR] * 4, [0] * 4
    cost[state] = 0
    for costs, orders in steps[lo:hi]:
        best = [(FAR, 0, 0)] * 4
        for p in range(4):
            if cost[p] < FAR:
                paid, row, order, place = cost[p], costs[p], orders[p], rank[p]
                for q in range(4):
                    if row[q] < FAR:
                        met = (paid + row[q], place, order[q])
                        if best[q][0] == FAR or met < best[q]:
                            best[q] = met
        cost = [b[0] for b in best]
        strings = sorted({b[1:] for b in best if b[0] < FAR})
        rank = [strings.index(b[1:]) if b[0] < FAR else 0 for b in best]
    return cost, rank


def backward(steps: list[Table], lo: int, hi: int, state: int) -> list[int]:
    """Cost from each state to state over steps lo .. hi-1."""
    cost = [FAR] * 4
    cost[state] = 0
    for costs, _ in reversed(steps[lo:hi]):
        cost = [min(row[q] + cost[q] for q in range(4)) for row in costs]
        cost = [min(c, FAR) for c in cost]
    return cost


def crossings(steps: list[Table], first: int, last: int) -> list[int]:
    """The state before each step and after the last one, on the cheapest, then audit-least way from first to last."""
    out = [first] * (len(steps) + 1)
    out[-1] = last

    def meet(lo: int, hi: int) -> None:
        if hi - lo < 2:
            return
        mid = (lo + hi) // 2
        cost, rank = forward(steps, lo, mid, out[lo])
        rest = backward(steps, mid, hi, out[hi])
        out[mid] = min((c + r, k, q) for q, (c, k, r) in enumerate(zip(cost, rank, rest, strict=True)) if c < FAR and r < FAR)[2]
        meet(lo, mid)
        meet(mid, hi)

    meet(0, len(steps))
    return out


def ending(steps: list[Table]) -> int:
    """The state after the last step of a conversation that starts with nothing and ends well formed."""
    cost, rank = forward(steps, 0, len(steps), 0)
    return min((cost[q] + END[q][0], rank[q], q) for q in range(4) if cost[q] < FAR)[2]


def edits(codes: bytes, first: int, last: int) -> str:
    """Letters of all edits of a stretch of rows between two states."""
    at = crossings([STEPS[c] for c in codes], first, last)
    return "".join(MOVES[c][p][q][1] for c, p, q in zip(codes, at[:-1], at[1:], strict=True))


def whole_edits(codes: bytes) -> str:
    """Letters of all edits of a whole conversation."""
    last = ending([STEPS[c] for c in codes])
    return edits(codes, 0, last) + END[last][1]


def _table_of(codes: bytes) -> bytes:
    """Costs and ranks of a block between all states."""
    steps = [STEPS[c] for c in codes]
    both = [forward(steps, 0, len(steps), p) for p in range(4)]
    return np.array([[b[0] for b in both], [b[1] for b in both]], "<i8").tobytes()


def _cells(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in role and text, and same: a digest of conversation, role and text."""
    rows = plain(convs, conv_id="long", turn="long", role="string", text="string").withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("-")), F.lit(":"), F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.withColumn("same", F.substring(F.unhex(F.sha2(said, 256)), 1, 16))


def _marked(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, same, code, n: equal rows of a turn once, n times over, with the fault of the first of them."""
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 0).when(initial == "u", 4).when(initial == "a", 8).otherwise(12) + fault
    rows = written(_cells(convs).select("conv_id", "turn", "role", "same", code.alias("code")).groupBy("conv_id", "turn", "role", "same").agg(F.max("code").alias("code"), F.count("*").alias("n")))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = rows.groupBy("same").agg(F.min(place).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    rows = join_counted(rows, again, "same", "rows", "left")
    late = F.coalesce(place > F.col("first"), F.lit(False)) & (F.col("code") % 4 != 1)
    return rows.select("conv_id", "turn", "role", "same", F.when(late, F.col("code") - F.col("code") % 4 + 2).otherwise(F.col("code")).cast("int").alias("code"), "n")


def _cut(block: int):
    """Blocks of the conversations of a sorted partition; whole ones are solved, of others the table goes on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: dict[str, list] = {k: [] for k in ("conv_id", "part", "seq", "codes", "letters", "table")}
        now, held, seq, begun, inner = "", bytearray(), 0, 0, False

        def give(codes: bytes, whole: bool) -> None:
            out["conv_id"].append(now)
            out["part"].append(part)
            out["seq"].append(seq)
            out["codes"].append(codes)
            out["letters"].append(whole_edits(codes) if whole else None)
            out["table"].append(None if whole else _table_of(codes))

        for pdf in batches:
            code, n = pdf["code"].to_numpy(np.uint8), pdf["n"].to_numpy(np.int64)
            ids = pdf["conv_id"].to_numpy(object)
            new = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(code) else np.zeros(0, int)
            for a, b in zip(new.tolist(), [*new[1:].tolist(), len(code)], strict=True):
                conv = ids[a]
                if conv != now:
                    if now != "":  # the first conversation of a partition may have begun in another
                        give(bytes(held), inner and seq == begun)
                        seq, inner = seq + 1, True
                    now, held, begun = conv, bytearray(), seq
                for c, times in zip(code[a:b].tolist(), n[a:b].tolist(), strict=True):
                    held.append(c)
                    times -= 1
                    while times or len(held) > block:
                        take = min(times, block + 1 - len(held)) if times else 0
                        held += bytes([c if c % 4 == 1 else c - c % 4 + 2]) * max(take, 0)
                        times -= max(take, 0)
                        if len(held) > block:
                            give(bytes(held[:block]), False)
                            held, seq = held[block:], seq + 1
            if len(out["seq"]) > 1000:
                yield pd.DataFrame(out)
                out = {k: [] for k in out}
        if now != "":
            give(bytes(held), False)
        yield pd.DataFrame(out)

    return run


def _streams(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[str | None, Iterator[tuple]]]:
    """Each conversation's id and an iterator of its rows, of a stream in which conversations lie together."""

    def rows() -> Iterator[tuple]:
        for pdf in batches:
            yield from zip(*[pdf[c].tolist() for c in ["conv_id", *columns]], strict=True)

    yield from groupby(rows(), key=lambda r: r[0])


def _settled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The states at the borders of each conversation's blocks, and the letters after its last one."""
    out: list[tuple] = []
    columns = ["part", "seq", "p", "q", "tail"]
    for _, blocks in _streams(batches, ["part", "seq", "table"]):
        where, steps = [], []
        for _, part, seq, data in blocks:
            where.append((part, seq))
            steps.append(tuple(np.frombuffer(data, "<i8").reshape(2, 4, 4).tolist()))
        last = ending(steps)
        at = crossings(steps, 0, last)
        out += [(*w, p, q, END[last][1] if k == len(where) - 1 else "") for k, (w, p, q) in enumerate(zip(where, at[:-1], at[1:], strict=True))]
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=columns)
            out = []
    yield pd.DataFrame(out, columns=columns)


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        letters = [edits(c, p, q) + t for c, p, q, t in zip(pdf["codes"], pdf["p"], pdf["q"], pdf["tail"], strict=True)]
        yield pdf[["conv_id", "part", "seq", "codes"]].assign(letters=letters)


#: Ids and turns travel as text through Python, where numbers beside nulls would become floating.
PIECE = "conv_id string, part int, seq int, codes binary, letters string"


def pieces(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, part, seq, codes, letters: the edits of every stretch of every conversation, in order of part and seq."""
    by = ["conv_id", "turn", "role", "same"]
    rows = _marked(convs).repartitionByRange(*by).sortWithinPartitions(*by).select(F.col("conv_id").cast("string"), "code", "n")
    cut = written(rows.mapInPandas(frugal(_cut(block)), PIECE + ", table binary"))
    parted = cut.where("letters is null").drop("letters")
    tables = parted.select("conv_id", "part", "seq", "table").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    states = tables.mapInPandas(_settled, "part int, seq int, p int, q int, tail string")
    solved = parted.drop("table").join(states, ["part", "seq"]).mapInPandas(frugal(_solved), PIECE)
    return cut.where("letters is not null").drop("table").unionByName(solved).withColumn("conv_id", F.col("conv_id").cast("long"))


ROW = "conv_id string, position string, turn string, had_role string, role string, text string, edit string, fault string"


def _applied(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of ROW of conversations whose pieces come before their rows."""
    out: list[tuple] = []
    names = ["user", "assistant"]
    for conv, events in _streams(batches, ["turn", "role", "text", "codes", "letters"]):
        codes, letters, at, row, state, position = b"", "", 0, 0, 0, 0
        held_codes, held_letters = [], []

        def inserts() -> None:
            nonlocal at, state, position
            while at < len(letters) and letters[at] == "I":
                state = USER if state in USER_AFTER else ASSISTANT
                out.append((conv, str(position), None, None, names[state - USER], "", "I", None))
                at, position = at + 1, position + 1

        for _, turn, role, text, code, letter in events:
            if code is not None:
                held_codes.append(code)
                held_letters.append(letter)
                continue
            if held_letters:
                codes, letters, held_codes, held_letters = b"".join(held_codes), "".join(held_letters), [], []
            inserts()
            edit, code = letters[at], codes[row]
            at, row = at + 1, row + 1
            if edit == "D":
                out.append((conv, None, turn, role, None, text, edit, FAULTS[code % 4]))
            else:
                state = 1 if edit == "K" and code < 4 else USER if state in USER_AFTER else ASSISTANT
                out.append((conv, str(position), turn, role, role if edit == "K" else names[state - USER], text, edit, FAULTS[code % 4]))
                position += 1
            if len(out) > 5_000:
                yield _rows(out)
                out.clear()
        inserts()
    yield _rows(out)


def _rows(out: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(out, columns=[c.split()[0] for c in ROW.split(", ")], dtype=object)


def _reported(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """REPORT of the rows of _applied, in their order."""
    out: list[tuple] = []
    pairs = {"su", "ua", "au"}
    for conv, rows in _streams(batches, ["position", "turn", "had_role", "role", "text", "edit", "fault"]):
        faults = dict.fromkeys(FAULTS, 0)
        digest, audit, before, illegal, cost, first, last, turns, seen = hashlib.sha256(), [], None, 0, 0, None, None, 0, None
        for _, position, turn, had, role, text, edit, fault in rows:
            audit.append(edit)
            cost += {"K": 0, "R": RENAME, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
            if edit != "D":
                digest.update(("\n" * (position != "0") + role + ":" + text).encode("utf-8", "surrogatepass"))
            if edit == "I":
                continue
            faults[fault] += 1
            illegal += before is not None and before + had[:1] not in pairs
            before = had[:1]
            if turn is not None and turn != seen:
                first, last, turns, seen = int(turn) if first is None else first, int(turn), turns + 1, turn
        gaps = 0 if first is None else last - first + 1 - turns
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), digest.hexdigest()))
        if len(out) > 2_000:
            yield pd.DataFrame(out, columns=REPORTED)
            out = []
    yield pd.DataFrame(out, columns=REPORTED)


REPORT = "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
REPORTED = [c.split()[0] for c in REPORT.split(", ")]


def _events(convs: DataFrame, block: int) -> DataFrame:
    """Pieces and rows of each conversation together, pieces first, both in order."""
    rows = _cells(convs).withColumns({"kind": F.lit(1), "part": F.lit(0), "seq": F.lit(0), "codes": F.lit(None).cast("binary"), "letters": F.lit(None).cast("string")})
    done = pieces(convs, block).withColumns({"kind": F.lit(0), "turn": F.lit(None).cast("long"), "role": F.lit(""), "same": F.lit(None).cast("binary"), "text": F.lit(None).cast("string")})
    return rows.unionByName(done).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "part", "seq", "turn", "role", "same").select(F.col("conv_id").cast("string"), F.col("turn").cast("string"), "role", "text", "codes", "letters")


def repaired(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row of every conversation and every inserted row, with its edit: ROW.

    convs: conv_id, turn, role, text (other columns are ignored). position counts the rows of the repaired conversation,
    null for deleted ones; role is the repaired role, had_role the one before; edit is K, R, D or I (keep, rename, delete,
    insert); fault is blank, duplicate, truncated or null. Rows come by turn, nulls first, rows of one turn by role and
    then by a digest of their text, so ties always fall alike. Null role and text are one space; rows whose conv_id is null
    are one conversation; rows that repeat role and text of their conversation are duplicates from the second on, repeated
    rows of one turn too; texts are read whole, whatever their length; an empty table gives no rows.
    """
    rows = _events(convs, block).mapInPandas(frugal(_applied), ROW)
    return rows.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "position", "turn")})


def report(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """REPORT of every conversation of convs, of the rows that ``repaired`` gives, where they are made.

    A conversation's SHA-256 reads its rows in order, so its texts pass through one task as a stream; nothing of them is held.
    """
    return _events(convs, block).mapInPandas(frugal(lambda batches: _reported(_applied(batches))), REPORT).withColumn("conv_id", F.col("conv_id").cast("long"))


def damaged(convs: DataFrame) -> DataFrame:
    """The rows of convs with planted faults by crc32(conv_id:turn) % 20; nulls are one space."""
    rows = plain(convs, conv_id="long", turn="long", role="string", text="string").withColumns({"role": F.coalesce("role", F.lit(" ")), "text": F.coalesce("text", F.lit(" "))})
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    rows = rows.withColumn("k", F.crc32(F.concat_ws(":", *named)) % 20).where("k <> 0")
    text: Column = F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = table(spark, sf_dir, "conversations")
    ids = plain(convs, conv_id="long").distinct()
    found = report(damaged(convs)).withColumnRenamed("conv_id", "found_id")
    zeros = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: DuckDB has no crc32: bit by bit over the characters of the key.
_CRC = "xor(list_reduce(list_transform(range(0, length(k) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(substr(k, i, 1)) END::UBIGINT), lambda crc, b: list_reduce(list_prepend(xor(crc, b), repeat([0::UBIGINT], 8)), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)), 4294967295::UBIGINT)"

ORACLE_SQL = f"""
WITH RECURSIVE given AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k, conv_id
  FROM conversations
), numbered AS (SELECT *, ({_CRC}) % 20 AS h FROM given
), damaged AS (
  SELECT cid, conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM numbered WHERE h <> 0
), keyed AS (
  SELECT *, sha256(coalesce(conv_id::VARCHAR, '-') || ':' || strlen(role) || ':' || role || text) AS same,
    right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ended FROM damaged
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, same) AS pos FROM keyed
), faulty AS (
  SELECT *, substr(role, 1, 1) AS initial,
    CASE WHEN ended = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY pos) > 1 THEN 'duplicate' WHEN ended NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), states(p, follows) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)
), inserts AS (
  SELECT p, p AS pos, 0 AS cost, '' AS letters FROM states
  UNION ALL SELECT p, follows, 2, 'I' FROM states
  UNION ALL SELECT s.p, n.follows, 4, 'II' FROM states s JOIN states n ON n.p = s.follows
), moves AS (
  SELECT i.p, f.initial, f.fault, e.edit, CASE e.edit WHEN 'D' THEN i.pos WHEN 'R' THEN s.follows WHEN 'K' THEN strpos('sua', f.initial) END AS q,
    i.cost + CASE e.edit WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN f.fault = 'truncated' AND e.edit <> 'D' THEN 1 ELSE 0 END AS cost, i.letters || e.edit AS letters
  FROM inserts i JOIN states s ON s.p = i.pos, (SELECT DISTINCT initial, fault FROM faulty) f, (VALUES ('D'), ('K'), ('R')) e(edit)
  WHERE e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (e.edit = 'R' OR f.initial = 's' AND i.pos = 0 OR f.initial = 'u' AND s.follows = 2 OR f.initial = 'a' AND s.follows = 3)
), walk AS (
  SELECT DISTINCT cid, 0::BIGINT AS pos, 0 AS state, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM faulty
  UNION ALL
  SELECT w.cid, w.pos + 1, m.q, min({{'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.letters}})
  FROM walk w JOIN faulty r ON r.cid = w.cid AND r.pos = w.pos + 1 JOIN moves m ON m.p = w.state AND m.initial = r.initial AND m.fault = r.fault
  GROUP BY w.cid, w.pos, m.q
), solved AS (
  SELECT cid, min({{'cost': best.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END, 'audit': best.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END}}) AS best
  FROM walk JOIN (SELECT cid, max(pos) AS n FROM faulty GROUP BY cid) USING (cid) WHERE pos = n GROUP BY cid
), letters AS (
  SELECT cid, i, substr(best.audit, i, 1) AS letter FROM solved, range(1, length(best.audit) + 1) t(i)
), lettered AS (
  SELECT *, sum((letter <> 'I')::INT) OVER (PARTITION BY cid ORDER BY i) AS pos, sum((letter <> 'D')::INT) OVER (PARTITION BY cid ORDER BY i) AS place FROM letters
), told AS (
  SELECT l.cid, l.i, l.letter, l.place, r.role, r.text, max((l.letter = 'K' AND l.place = 1 AND r.initial = 's')::INT) OVER (PARTITION BY l.cid) AS headed
  FROM lettered l LEFT JOIN faulty r ON r.cid = l.cid AND r.pos = l.pos AND l.letter <> 'I'
), repaired AS (
  SELECT cid, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (place - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY i)) AS repaired_sha256
  FROM told WHERE letter <> 'D' GROUP BY cid
), counted AS (
  SELECT cid, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum((fault = 'blank')::BIGINT) AS blank, sum((fault = 'duplicate')::BIGINT) AS duplicate, sum((fault = 'truncated')::BIGINT) AS truncated,
    sum(coalesce((before || initial NOT IN ('su', 'ua', 'au'))::BIGINT, 0)) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY cid ORDER BY pos) AS before FROM faulty) GROUP BY cid
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0)::BIGINT AS cost, coalesce(best.audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT cid, conv_id FROM given) g LEFT JOIN counted USING (cid) LEFT JOIN solved USING (cid) LEFT JOIN repaired USING (cid)
"""
