"""Conversation structure repair: the cheapest edits of a conversation's rows after which its roles alternate as they should.

A grammar of four states (nothing yet, after system, after user, after assistant) reads the rows. An edit is an arc between
nodes (row, state): Delete, Insert, Keep or Rerole, written D, I, K, R. A cost pass from the end gives each node the least
cost to finish; arcs that lie on a cheapest path stay. The audit is the least string, in ASCII order, of the letters on a path
of such arcs. Nodes are ranked by their least strings of 1, 2, 4, ... letters (rank and pointer of a doubled length come from
those of the half), arcs of a node are chosen by letter and the rank of their head, and the path is read off the doubled
pointers.

Conversations in the middle of a partition are repaired where they lie. Those at its edges, and those of more than ``WAITING``
rows, are cut into blocks: a block's least costs from state to state go back through the conversation, its paths are then
found block by block in parallel, and the state it is entered in comes forward. No task holds more of them than a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, staged
from .conversations import in_order, in_tasks, partition

DELETE, INSERT, KEEP, REROLE = range(4)
#: In ASCII order, so that a lesser number is a lesser letter.
LETTERS = "DIKR"
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
#: What an undeleted truncated row adds.
TRUNCATED_COST = 5
BAD = 1 << 40

START, SYSTEM, USER, ASSISTANT = range(4)
#: The role, and so the state, that an inserted or reroled row takes in each state.
NEXT = np.array([USER, USER, ASSISTANT, USER])
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The least cost to finish after the last row, by state, and the edits for it.
FINISH, TAIL = [0, 10, 5, 0], ["", "II", "I", ""]

INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: A row is coded as the class of its role's initial and four times its fault.
N_CODES = 16

#: Rows that wait for the end of their conversation, rows of a block, and rows repaired at once.
WAITING, BLOCK, BATCH = 4096, 1024, 16384


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """Cost and head of the arcs that a row of each code gives to each state, by letter; inserts are the same for all rows."""
    cost, head = np.full((N_CODES, 4, 4), BAD), np.zeros((N_CODES, 4, 4), dtype=np.int64)
    for code in range(N_CODES):
        initial, fault = code % 4, code // 4
        for state in range(4):
            cost[code, state, DELETE], head[code, state, DELETE] = COST[DELETE], state
            if fault in (BLANK, DUPLICATE):
                continue
            extra = TRUNCATED_COST if fault == TRUNCATED else 0
            cost[code, state, REROLE], head[code, state, REROLE] = COST[REROLE] + extra, NEXT[state]
            fits = {0: SYSTEM if state == START else None, 1: USER if state != USER else None, 2: ASSISTANT if state == USER else None, OTHER: None}[initial]
            if fits is not None:
                cost[code, state, KEEP], head[code, state, KEEP] = COST[KEEP] + extra, fits
    return cost, head


ARC_COST, ARC_HEAD = _arcs()
_STEPS = [[[(int(ARC_COST[c, s, x]), int(ARC_HEAD[c, s, x])) for x in (DELETE, KEEP, REROLE) if ARC_COST[c, s, x] < BAD] for s in range(4)] for c in range(N_CODES)]


def costs_to_go(codes: Iterable[int], finish: list[int]) -> np.ndarray:
    """The least cost from each row and state to the end, where ``finish`` is to be paid; the last line is ``finish``."""
    after, out = list(finish), [list(finish)]
    for code in reversed(list(codes)):
        steps = _STEPS[code]
        c0, c1, c2, c3 = (min(w + after[t] for w, t in steps[s]) for s in range(4))
        u, a = min(c2, c3 + 5), min(c3, c2 + 5)
        after = [min(c0, u + 5), min(c1, u + 5), u, a]
        out.append(after)
    return np.array(out[::-1], dtype=np.int64)


def least_paths(parts: list[tuple[np.ndarray, np.ndarray]], entries: list[tuple[int, int]]) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """For each (part, state) of ``entries`` the least path through that part: letters, nodes (4 row + state), and the state left in.

    ``parts`` are codes and costs to go. The nodes of all parts are ranked together.
    """
    heads, letters, tails, starts, total = [], [], [], [], 0
    for codes, cost in parts:
        n = len(codes)
        # Arcs by (row, state, letter): those that keep to the least cost.
        arc, to = np.full((n, 4, 4), BAD), np.zeros((n, 4, 4), dtype=np.int64)
        if n:
            arc[:], to[:] = ARC_COST[codes], 4 * (np.arange(n)[:, None, None] + 1) + ARC_HEAD[codes]
            arc = arc + cost[1:].ravel()[np.minimum(to - 4, 4 * n - 1)]
            to[:, :, INSERT] = 4 * np.arange(n)[:, None] + NEXT
            arc[:, :, INSERT] = COST[INSERT] + cost[:-1][:, NEXT]
        row, state, letter = np.nonzero(arc == cost[:-1][:, :, None])
        tails.append(total + 4 * row + state)
        letters.append(letter)
        heads.append(total + to[row, state, letter])
        starts.append(total)
        total += 4 * (n + 1)
    tail, letter, head = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tails, letters, heads))

    def first_arcs(order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's letter (plus one; 0 at the end) and head, by the first of its arcs in an order."""
        own, at = np.unique(tail[order], return_index=True)
        mark, pointer = np.zeros(total, np.int64), np.arange(total)
        mark[own], pointer[own] = letter[order][at] + 1, head[order][at]
        return mark, pointer

    mark, pointer = first_arcs(np.lexsort((letter, tail)))
    rank, pointers = mark, [pointer]
    while (pointer[pointer] != pointer).any():
        # Twice the length: by the first half, then by the half that follows it.
        rank = np.unique(rank * (len(mark) + 5) + rank[pointer], return_inverse=True)[1]
        pointer = pointer[pointer]
        pointers.append(pointer)
    # Now whole strings are ranked: arcs by letter, then by what follows.
    mark, pointer = first_arcs(np.lexsort((rank[head], letter, tail)))
    pointers = [pointer]
    while (pointer[pointer] != pointer).any():
        pointer = pointer[pointer]
        pointers.append(pointer)
    out = []
    for part, state in entries:
        path = np.array([starts[part] + state])
        for p in pointers:
            if not mark[path[-1]]:
                break
            path = np.concatenate([path, p[path]])
        path = path[: int(np.argmin(mark[path] > 0)) + 1]
        nodes = path - starts[part]
        out.append((mark[path[:-1]] - 1, nodes[:-1], int(nodes[-1] % 4)))
    return out


def repaired_lines(letters: np.ndarray, nodes: np.ndarray, rows: list[tuple[str, str]]) -> list[str]:
    """``role:text`` of the rows that the edits leave."""
    out = []
    for letter, node in zip(letters.tolist(), nodes.tolist()):
        row, state = divmod(node, 4)
        if letter == KEEP:
            out.append(f"{rows[row][0]}:{rows[row][1]}")
        elif letter == REROLE:
            out.append(f"{ROLE[int(NEXT[state])]}:{rows[row][1]}")
        elif letter == INSERT:
            out.append(f"{ROLE[int(NEXT[state])]}:")
    return out


def _tail(state: int) -> list[str]:
    out = []
    for _ in TAIL[state]:
        state = int(NEXT[state])
        out.append(f"{ROLE[state]}:")
    return out


def written(letters: np.ndarray) -> str:
    return "".join(map(LETTERS.__getitem__, letters.tolist()))


def code_of(role: str, text: str, seen: bool) -> int:
    """A row's code; ``seen``: its role and text stand earlier in the conversation."""
    body = text.strip(WHITE)
    fault = BLANK if not body else DUPLICATE if seen else FINE if body[-1] in ".!?" else TRUNCATED
    return INITIALS.get(role[:1], OTHER) + 4 * fault


LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def damage(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, lost``: rows spoilt by ``crc32("conv_id:turn") % 20``; a dropped row stays, marked as lost.

    Nulls are one space, in ids within that key as well; 0 drops a row, 1 empties its text, 2 takes ``.!?`` out of it, 3 repeats
    the row, 4 makes its role user.
    """
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    out = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(F.concat_ws(":", *spelled)) % 20).alias("kind"))
    kind = F.col("kind")
    out = out.withColumns({
        "text": F.when(kind <= 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")), "role": F.when(kind == 4, "user").otherwise(F.col("role")), "lost": kind == 0,
        "copies": F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1)),
    })
    return out.select("conv_id", "turn", "role", "text", "lost", F.explode("copies").alias("copy")).drop("copy")


FOUND = T.StructType([*[T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])


def _sha(lines: list[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()


def _gaps(turns: set) -> int:
    return max(turns) - min(turns) + 1 - len(turns) if turns else 0


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` for each conversation of ``rows``.

    Reads ``conv_id, turn, role, text`` (null role or text: one space) and ``lost``, if there: a lost row only says that its
    conversation exists. Rows are taken in the order of ``in_order``: null turns first, ties by role and text; repeated rows
    are duplicates. A null ``conv_id`` is one conversation. Without rows that are not lost all numbers are 0, the audit is
    empty and the hash is that of the empty string. No rows give no rows; other columns are not read.
    """
    text = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    lost = F.col("lost") if "lost" in rows.columns else F.lit(False)
    ordered = in_order(rows.select("conv_id", "turn", *text, lost.alias("lost")))
    conv = ordered.schema["conv_id"]
    kept = T.StructType([
        T.StructField("part", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("code", T.IntegerType()), T.StructField("hash", T.BinaryType()),
    ])
    none, no_row = (None,) * len(FOUND), (None,) * len(kept)

    def inside(given: Iterator[tuple]) -> Iterator[tuple]:
        part, done = partition(), []

        def results() -> Iterator[tuple]:
            parts = []
            for _, own in done:
                codes = np.array([r[5] for r in own], dtype=np.int64)
                parts.append((codes, costs_to_go(codes.tolist(), FINISH)))
            for (conv_id, own), (codes, cost), (letters, nodes, state) in zip(done, parts, least_paths(parts, [(k, START) for k in range(len(parts))])):
                texts, faults = [(r[3], r[4]) for r in own], np.bincount(codes // 4, minlength=4)
                illegal = sum((x[:1], y[:1]) not in LEGAL for (x, _), (y, _) in zip(texts, texts[1:]))
                found = (_gaps({r[2] for r in own if r[2] is not None}), *map(int, faults[[BLANK, DUPLICATE, TRUNCATED]]), illegal, int(cost[0][START]))
                yield (conv_id, *found, written(letters) + TAIL[state], _sha(repaired_lines(letters, nodes, texts) + _tail(state)), *no_row)
            done.clear()

        now, begun, first, passed, waiting, seen, size = None, False, True, False, [], set(), 0
        for pos, (conv_id, turn, role, body, gone) in enumerate(given):
            if begun and conv_id != now:
                if first:
                    yield from ((now, *none, *w) for w in waiting)
                elif not passed:
                    # A lost row has told of its conversation.
                    done.append((now, [w for w in waiting if w[5] is not None]))
                    size += len(waiting) + 1
                first, passed, waiting, seen = False, False, [], set()
                if size >= BATCH:
                    yield from results()
                    size = 0
            now, begun = conv_id, True
            mark = hashlib.blake2b(f"{len(role)}:{role}{body}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            code = None if gone else code_of(role, body, mark in seen)
            if not gone:
                seen.add(mark)
            waiting.append((part, pos, turn, role, body, code, mark))
            if passed or len(waiting) > WAITING:
                yield from ((now, *none, *w) for w in waiting)
                waiting, passed = [], True
        yield from results()
        yield from ((now, *none, *w) for w in waiting)

    both = staged(in_tasks(ordered, T.StructType([conv, *FOUND, *kept]), inside))
    whole = both.where("part IS NULL").select("conv_id", *FOUND.names)
    return whole.union(_in_blocks(both.where("part IS NOT NULL").select("conv_id", *kept.names)))


def _in_blocks(rows: DataFrame) -> DataFrame:
    """The same results for rows with ``part, pos`` (their order), ``code`` (null: lost) and ``hash`` of role and text."""
    # A key that is never null.
    rows = rows.withColumn("key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    everyone = rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"))
    live, fault = rows.where("code IS NOT NULL"), F.col("code") / 4
    # Each task has found the duplicates within its own rows: what is left has one row a text and task.
    firsts = live.where((F.floor(fault) == FINE) | (F.floor(fault) == TRUNCATED)).groupBy("key", "hash").agg(F.min(F.struct("part", "pos")).alias("earliest"))
    again = F.struct("part", "pos") > F.col("earliest")
    code = F.when(again & F.floor(fault).isin(FINE, TRUNCATED), F.col("code") % 4 + 4 * DUPLICATE).otherwise(F.col("code")).cast("int")
    coded = live.join(firsts, ["key", "hash"], "left").select("key", "part", F.floor(F.col("pos") / BLOCK).alias("block"), F.struct("pos", code.alias("code"), "turn", "role", "text").alias("r"))
    blocks = staged(coded.groupBy("key", "part", "block").agg(F.array_sort(F.collect_list("r")).alias("r")))
    at = ["key", "part", "block"]
    codes = blocks.select(*at, F.transform("r", lambda r: r["code"]).alias("codes"), F.transform("r", lambda r: F.substring(r["role"], 1, 1)).alias("initials"))
    place = T.StructType([blocks.schema[c] for c in at])
    numbers = T.ArrayType(T.LongType())

    def crossing(given: Iterator[tuple]) -> Iterator[tuple]:
        """The least cost from each state of entry to each state at the block's end."""
        for key, part, block, own, _ in given:
            yield key, part, block, np.stack([costs_to_go(own, [0 if s == e else BAD for s in range(4)])[0] for e in range(4)], 1).ravel().tolist()

    def backward(given: Iterator[tuple]) -> Iterator[tuple]:
        """Costs to go at each block's end, from the conversation's last block to its first."""
        now, to_go = None, FINISH
        for key, part, block, cost in given:
            to_go = to_go if key == now else FINISH
            yield key, part, block, to_go, key != now
            now, to_go = key, [min(c + t for c, t in zip(cost[4 * s : 4 * s + 4], to_go)) for s in range(4)]

    def inner(given: Iterator[tuple]) -> Iterator[tuple]:
        """Each block's least path from each state of entry."""
        for key, part, block, own, initials, to_go, last in given:
            codes = np.array(own, dtype=np.int64)
            cost = costs_to_go(own, to_go)
            found = least_paths([(codes, cost)], [(0, s) for s in range(4)])
            illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
            yield key, part, block, [f[0].tolist() for f in found], [f[1].tolist() for f in found], [f[2] for f in found], illegal, initials[0], initials[-1], last, int(cost[0][START])

    def forward(given: Iterator[tuple]) -> Iterator[tuple]:
        """The path that a block's state of entry picks, and the conversation's cost at its first block."""
        now, state, before = None, START, None
        for key, part, block, letters, nodes, left, illegal, begins, ends, last, cost in given:
            new = key != now
            state = START if new else state
            illegal += not new and (before, begins) not in LEGAL
            yield key, part, block, letters[state], nodes[state], illegal, left[state] if last else None, cost if new else 0
            now, state, before = key, left[state], ends

    def edited(given: Iterator[tuple]) -> Iterator[tuple]:
        for key, part, block, own, letters, nodes, state in given:
            letters, nodes = np.array(letters, dtype=np.int64), np.array(nodes, dtype=np.int64)
            lines = repaired_lines(letters, nodes, [(r["role"], r["text"]) for r in own])
            end = state is not None
            yield key, part, block, written(letters) + (TAIL[state] if end else ""), lines + (_tail(state) if end else [])

    def through(given: Iterator[tuple]) -> Iterator[tuple]:
        """Texts are hashed in order, a block at a time."""
        now, audit, sums, some = None, [], hashlib.sha256(), False
        for key, _, _, letters, lines in given:
            if now is not None and key != now:
                yield now, "".join(audit), sums.hexdigest()
                audit, sums, some = [], hashlib.sha256(), False
            now = key
            audit.append(letters)
            for line in lines:
                sums.update((("\n" if some else "") + line).encode("utf-8", "surrogatepass"))
                some = True
        if now is not None:
            yield now, "".join(audit), sums.hexdigest()

    def placed(*fields: tuple[str, T.DataType]) -> T.StructType:
        return T.StructType([*place, *[T.StructField(n, t) for n, t in fields]])

    def sorted_by(df: DataFrame, up: bool) -> DataFrame:
        return df.repartition("key").sortWithinPartitions(*[F.col(c) if up else F.col(c).desc() for c in at])

    crossings = in_tasks(codes, placed(("cost", numbers)), crossing)
    ends = in_tasks(sorted_by(crossings, False), placed(("to_go", numbers), ("last", T.BooleanType())), backward)
    lists = T.ArrayType(numbers)
    paths = in_tasks(codes.join(ends, at), placed(
        ("letters", lists), ("nodes", lists), ("left", numbers), ("illegal", T.LongType()), ("begins", T.StringType()), ("ends", T.StringType()), ("last", T.BooleanType()), ("cost", T.LongType())
    ), inner)
    picked = staged(in_tasks(sorted_by(paths, True), placed(("letters", numbers), ("nodes", numbers), ("illegal", T.LongType()), ("state", T.LongType()), ("cost", T.LongType())), forward))
    lines = in_tasks(blocks.join(picked.select(*at, "letters", "nodes", "state"), at).select(*at, "r", "letters", "nodes", "state"), placed(("audit", T.StringType()), ("lines", T.ArrayType(T.StringType()))), edited)
    hashed = in_tasks(sorted_by(lines, True), T.StructType([T.StructField("key", T.StringType()), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())]), through)
    sums = picked.groupBy("key").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    flat = blocks.select("key", F.explode("r").alias("r")).select("key", "r.turn", F.floor(F.col("r.code") / 4).alias("fault"))
    faults = flat.groupBy("key").agg(*[F.count_if(F.col("fault") == k).alias(n) for k, n in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))])
    span = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    gaps = flat.select("key", "turn").distinct().groupBy("key").agg(F.coalesce(span, F.lit(0)).alias("gaps"))
    out = everyone
    for part in (gaps, faults, sums, hashed):
        out = out.join(part, "key", "left")
    empty = {"audit": "", "repaired_sha256": _sha([])}
    return out.select("conv_id", *[F.coalesce(f.name, F.lit(empty.get(f.name, 0))).cast(f.dataType).alias(f.name) for f in FOUND])
