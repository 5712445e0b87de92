"""Conversation structure repair by an auction shortest-path algorithm.

The repaired turns of a conversation have roles ``(s?(ua)+)?`` by their initials.
The edits of n turns are paths through a lattice of n + 1 stages and four states
(nothing yet, after the system turn, after a user, after an assistant): keep,
rerole and delete lead to the next stage, insert stays in its stage. All costs are
whole numbers and every cycle (two inserts) costs something.

``auction`` keeps a price per node, never above the cost of an arc plus the price at
its end. A path grows from an origin along the cheapest arc while the price of its
last node equals that arc's cost plus the price behind it (extension); otherwise the
price rises to that sum and the node leaves the path (contraction). Origins are
taken from the last stage to the first and prices stay, so a path ends at the first
node that an earlier path has settled. Settled prices are distances; arcs whose cost
is the difference of the prices are tight, and following the least letter among the
tight arcs from the start gives the ASCII-least of the cheapest edits.

Rows are range-partitioned by conversation and turn and read as a stream. A
conversation within one piece (``PIECE`` rows) is solved where it is read. One that
is longer, or meets the end of a partition, is solved by pieces: each piece gives its
distances between boundary states, a backward stream over these small tables gives
the price of each state at each boundary, every piece traces its edits for each
state it may be entered in, and a forward stream picks one. No task ever holds more
than one piece of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.llm.common import kept, partitions

#: rows and bytes of text at which a piece is closed
PIECE = 1024
PIECE_BYTES = 4 << 20
_BLANKS = " \t\n\v\f\r"
_ENDS = ".!?"
#: cost of an edit; a truncated row that stays costs one more
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
#: states: 0 nothing yet, 1 system, 2 user, 3 assistant
_EXPECTED = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: price of each state behind the last turn: the empty repair, or one that ends with an assistant
_END = (0, None, None, 0)


def _arcs(symbol: str) -> list[list[tuple[str, int, int, int]]]:
    """Per state the arcs (letter, cost, stages, next state) of a row, by letter. Symbols:
    the initial of the role (``o`` for any other), upper case if truncated; ``x`` for a
    row that must go; empty behind the last row."""
    out = []
    for q in range(4):
        arcs = [("I", INSERT, 0, _EXPECTED[q])]
        if symbol:
            arcs.append(("D", DELETE, 1, q))
        if symbol not in ("", "x"):
            late = int(symbol.isupper())
            role = {"s": 1, "u": 2, "a": 3}.get(symbol.lower())
            if role == _EXPECTED[q] or role == 1 and q == 0:
                arcs.append(("K", KEEP + late, 1, role))
            arcs.append(("R", REROLE + late, 1, _EXPECTED[q]))
        out.append(sorted(arcs))
    return out


ARCS = {s: _arcs(s) for s in ("", "x", *"suaoSUAO")}


def auction(symbols: str, exits=_END) -> list[int | None]:
    """Prices of all nodes (four a stage): the cost of the cheapest way from there to
    the exits, whose own costs are ``exits``; None where there is no way."""
    n = len(symbols)
    price: list[int | None] = [None] * (4 * n + 4)
    settled = bytearray(4 * n + 4)
    goal = -1
    for i in range(n, -1, -1):
        arcs = ARCS[symbols[i] if i < n else ""]
        # which states have a way at all: by a row arc or an exit, or by inserts to one that has
        ways = {q for q in range(4) if (exits[q] is not None if i == n else any(
            step and price[4 * i + 4 + r] is not None for _, _, step, r in arcs[q]))}
        while more := {q for q in range(4) if q not in ways and _EXPECTED[q] in ways}:
            ways |= more
        # no price may exceed an arc's cost plus the price behind it: the least of the next stage never does
        floor = min(x for x in (exits if i == n else price[4 * i + 4:4 * i + 8]) if x is not None)
        for q in ways:
            price[4 * i + q] = floor
        for origin in sorted(ways, reverse=True):
            path = [4 * i + origin]
            while (v := path[-1]) != goal and not settled[v]:
                best, to = None, goal
                for _, cost, step, r in arcs[v & 3]:
                    w = v - (v & 3) + 4 * step + r
                    if price[w] is not None and (best is None or cost + price[w] < best):
                        best, to = cost + price[w], w
                if i == n and exits[v & 3] is not None and (best is None or exits[v & 3] <= best):
                    best, to = exits[v & 3], goal
                if price[v] < best:
                    price[v] = best
                    if len(path) > 1:
                        path.pop()
                else:
                    path.append(to)
            for v in path:
                if v != goal:
                    settled[v] = 1
    return price


def trace(symbols: str, price: list, state: int, exits=_END) -> tuple[str, int]:
    """The ASCII-least letters along tight arcs from ``state`` before the first row, and
    the state in which they end."""
    letters, i, n = [], 0, len(symbols)
    while True:
        here = price[4 * i + state]
        if i == n and exits[state] == here:
            return "".join(letters), state
        for letter, cost, step, r in ARCS[symbols[i] if i < n else ""][state]:
            behind = price[4 * (i + step) + r]
            if behind is not None and cost + behind == here:
                letters.append(letter)
                i, state = i + step, r
                break


def repaired(edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    out_roles, out_texts, at = [], [], 0
    for e in edits:
        if e == "I":
            state = _EXPECTED[state]
            out_roles.append(_ROLE[state])
            out_texts.append("")
            continue
        if e == "K":
            state = 1 if state == 0 and roles[at][0] == "s" else _EXPECTED[state]
            out_roles.append(roles[at])
            out_texts.append(texts[at])
        elif e == "R":
            state = _EXPECTED[state]
            out_roles.append(_ROLE[state])
            out_texts.append(texts[at])
        at += 1
    return out_roles, out_texts


class Piece:
    """Consecutive rows of one conversation, equal rows held once with their number."""

    def __init__(self, conv):
        self.conv, self.turns, self.roles, self.texts, self.times = conv, [], [], [], []
        self.rows = self.bytes = 0

    def add(self, turn, role: str, text: str, times: int) -> None:
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.times.append(times)
        self.rows += times
        self.bytes += len(text)

    def expand(self, values: list) -> list:
        return [v for v, k in zip(values, self.times, strict=True) for _ in range(k)]

    def faults(self, seen: set | frozenset = frozenset()) -> tuple[str, dict]:
        """Symbols of the rows, and counts. ``seen``: keys of rows of earlier pieces."""
        symbols, met = [], set()
        count = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for role, text, times in zip(self.roles, self.texts, self.times, strict=True):
            end = text.rstrip(_BLANKS)
            if not end:
                count["blank"] += times
                symbols.append("x" * times)
                continue
            if (role, text) in met or seen and row_key(role, text) in seen:
                count["duplicate"] += times
                symbols.append("x" * times)
                continue
            met.add((role, text))
            first = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if end[-1] not in _ENDS:
                count["truncated"] += 1
                first = first.upper()
            count["duplicate"] += times - 1
            symbols.append(first + "x" * (times - 1))
        initials = [r[:1] for r in self.expand(self.roles)]
        count["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        turns = [t for t in self.turns if t is not None]
        count |= {"rows": self.rows, "turns": len(set(turns)), "min_turn": turns[0] if turns else None,
                  "max_turn": turns[-1] if turns else None}
        return "".join(symbols), count


def row_key(role: str, text: str) -> bytes:
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode("utf-8", "surrogatepass")).digest()


_COUNTS = "rows long, blank long, duplicate long, truncated long, illegal long, turns long, min_turn long, max_turn long"
_RESULT = f"edits string, roles array<string>, texts array<string>, cost long, {_COUNTS}"
_RAW = "in_turns array<long>, in_roles array<string>, in_texts array<string>, in_times array<long>"
_READ = f"conv long, part int, no int, alone boolean, {_RESULT}, {_RAW}"
_MATRIX = f"conv long, part int, no int, matrix array<long>, symbols string, {_COUNTS}, {_RAW}"
_EXITS = "part int, no int, exits array<long>"
_TRACED = f"conv long, part int, no int, ways array<string>, ends array<int>, costs array<long>, {_COUNTS}, {_RAW}"
_PIECES = f"conv long, piece int, alone boolean, {_RESULT}"


_KINDS = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
_KINDS |= {f"array<{k}>": pa.list_(v) for k, v in _KINDS.items()}


def _names(ddl: str) -> list[str]:
    return [f.split(" ")[0] for f in ddl.split(", ")]


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(f.split(" ")[0], _KINDS[f.split(" ")[1]]) for f in ddl.split(", ")])


class _Writer:
    """Record batches of rows, closed at some rows or bytes."""

    def __init__(self, ddl: str):
        self.schema, self.rows, self.bytes = _arrow(ddl), [], 0

    def add(self, row: dict, size: int = 0) -> bool:
        self.rows.append(row)
        self.bytes += size
        return len(self.rows) >= 2048 or self.bytes >= PIECE_BYTES

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.bytes = self.rows, [], 0
        return pa.RecordBatch.from_pylist(rows, schema=self.schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for lo in range(0, b.num_rows, 1024):
            part = b.slice(lo, 1024)
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the rows of one partition; conversations that lie wholly inside it and
    inside one piece are solved."""
    from pyspark import TaskContext
    part = TaskContext.get().partitionId()
    out, known, no = _Writer(_READ), {}, 0

    def solved(p: Piece) -> dict:
        symbols, count = p.faults()
        if symbols not in known:
            if len(known) >= 1 << 16:
                known.clear()
            price = auction(symbols)
            known[symbols] = trace(symbols, price, 0)[0], price[0]
        edits, cost = known[symbols]
        roles, texts = repaired(edits, 0, p.expand(p.roles), p.expand(p.texts))
        return count | {"edits": edits, "cost": cost, "roles": roles, "texts": texts}

    def raw(p: Piece) -> dict:
        return {"in_turns": p.turns, "in_roles": p.roles, "in_texts": p.texts, "in_times": p.times}

    piece, whole, first = None, False, True
    for conv, turn, role, text, times in _rows(batches):
        if piece is not None and piece.conv != conv:
            # the first conversation of the partition may have begun in the one before
            alone = whole and not first
            if out.add({"conv": piece.conv, "part": part, "no": no, "alone": alone}
                       | (solved(piece) if alone else raw(piece)), piece.bytes):
                yield out.batch()
            piece, whole, first, no = None, False, False, no + 1
        while times:
            if piece is None:
                piece, whole = Piece(conv), True
            elif piece.rows >= PIECE or piece.bytes + len(text) > PIECE_BYTES:
                if out.add({"conv": conv, "part": part, "no": no, "alone": False} | raw(piece), piece.bytes):
                    yield out.batch()
                piece, whole, no = Piece(conv), False, no + 1
            some = min(times, PIECE - piece.rows)
            piece.add(turn, role, text, some)
            times -= some
    if piece is not None:  # the last one may go on in the next partition
        out.add({"conv": piece.conv, "part": part, "no": no, "alone": False} | raw(piece))
    if out.rows:
        yield out.batch()


def _piece_of(row: dict) -> Piece:
    p = Piece(row["conv"])
    for x in zip(row["in_turns"], row["in_roles"], row["in_texts"], row["in_times"], strict=True):
        p.add(*x)
    return p


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for lo in range(0, b.num_rows, 16):
            yield from b.slice(lo, 16).to_pylist()


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances of a piece from each state before it to each state behind it."""
    out = _Writer(_MATRIX)
    for row in _dicts(batches):
        symbols, count = _piece_of(row).faults(frozenset(row.pop("seen") or ()))
        matrix = [[None] * 4 for _ in range(4)]
        for e in range(4):
            price = auction(symbols, tuple(0 if q == e else None for q in range(4)))
            for q in range(4):
                matrix[q][e] = price[q]
        if out.add(row | count | {"symbols": symbols, "matrix": sum(matrix, [])}, sum(map(len, row["in_texts"]))):
            yield out.batch()
    if out.rows:
        yield out.batch()


def _back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Price of each state behind each piece: pieces come last first."""
    out, conv, exits, begun = _Writer(_EXITS), None, list(_END), False
    for row in _dicts(batches):
        if not begun or row["conv"] != conv:
            conv, exits, begun = row["conv"], list(_END), True
        if out.add({"part": row["part"], "no": row["no"], "exits": exits}):
            yield out.batch()
        m = row["matrix"]
        exits = [min((m[4 * q + e] + exits[e] for e in range(4) if m[4 * q + e] is not None and exits[e] is not None),
                     default=None) for q in range(4)]
    if out.rows:
        yield out.batch()


def _traces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of a piece for each state that it may be entered in."""
    out = _Writer(_TRACED)
    for row in _dicts(batches):
        symbols, exits = row.pop("symbols"), tuple(row.pop("exits"))
        price = auction(symbols, exits)
        found = [trace(symbols, price, q, exits) if price[q] is not None else ("", 0) for q in range(4)]
        costs = [price[q] - exits[e] if price[q] is not None else None for q, (_, e) in enumerate(found)]
        if out.add(row | {"ways": [w for w, _ in found], "ends": [e for _, e in found], "costs": costs},
                   sum(map(len, row["in_texts"]))):
            yield out.batch()
    if out.rows:
        yield out.batch()


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits that hold: pieces come in order, each is entered where the one before ended."""
    out, conv, state, no, last, turn, begun = _Writer(_PIECES), None, 0, 0, "", None, False
    for row in _dicts(batches):
        if not begun or row["conv"] != conv:
            conv, state, no, last, turn, begun = row["conv"], 0, 0, None, None, True
        p = _piece_of(row)
        edits = row["ways"][state]
        roles, texts = repaired(edits, state, p.expand(p.roles), p.expand(p.texts))
        done = {k: row[k] for k in ("rows", "blank", "duplicate", "truncated", "illegal", "turns", "min_turn", "max_turn")}
        done["illegal"] += last is not None and last + p.roles[0][:1] not in ("su", "ua", "au")
        done["turns"] -= turn is not None and row["min_turn"] == turn
        if out.add(done | {"conv": conv, "piece": no, "alone": False, "edits": edits, "roles": roles, "texts": texts,
                           "cost": row["costs"][state]}, p.bytes):
            yield out.batch()
        state, no, last = row["ends"][state], no + 1, p.roles[-1][:1]
        turn = row["max_turn"] if row["max_turn"] is not None else turn
    if out.rows:
        yield out.batch()


def _seen_before(open_pieces: DataFrame) -> DataFrame:
    """(part, no, seen): keys of a piece's rows that an earlier piece of its conversation holds."""
    rows = F.expr("transform(arrays_zip(in_roles, in_texts), x -> unhex(sha2(encode(concat("
                  "char_length(x.in_roles), ':', x.in_roles, ':', x.in_texts), 'utf-8'), 256)))")
    place = F.struct("part", "no")
    keys = open_pieces.select("conv", place.alias("at"), F.explode(F.array_distinct(rows)).alias("key"))
    first = (keys.groupBy("conv", "key").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("k"))
             .where(F.col("k") > 1).withColumnRenamed("conv", "c").withColumnRenamed("key", "first_key"))
    later = keys.join(first, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("first_key"))
                      & (F.col("at") > F.col("first")))
    return later.groupBy("at.part", "at.no").agg(F.collect_set("key").alias("seen"))


def repair_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """Repaired conversations in pieces, most in one: (conv, piece, alone, edits, roles,
    texts, cost, and counts of the rows before the repair).

    ``edits`` has K, R, D or I per edit, ``roles`` and ``texts`` the turns that result;
    the pieces of a conversation follow each other by ``piece``; ``alone`` marks
    conversations of one piece. Rows are ordered by turn (nulls first), then role and
    text. A null role or text is one space, so such a text is blank and such a role is
    no role that may stay; so is an empty one. Rows with a null conversation are one
    conversation. Repeated rows are duplicates of the first. Texts of any length are
    whole; a text longer than a piece is a piece of its own. Other columns are ignored.
    An empty table gives no rows.
    """
    space = F.lit(" ")
    view = turns.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
                        F.coalesce(F.col(role_col).cast("string"), space).alias("role"),
                        F.coalesce(F.col(text_col).cast("string"), space).alias("text"))
    # equal rows follow each other whatever their number, so they travel as one
    rows = view.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("times"))
    # the bounds of the ranges are sampled on the driver: a beginning of the text is enough to part rows of one turn
    ranged = (rows.repartitionByRange(partitions(view), "conv", "turn", "role", F.substring("text", 1, 64))
              .sortWithinPartitions("conv", "turn", "role", "text"))
    read = kept(ranged.mapInArrow(_read, _READ), "turns-read")
    alone = read.where("alone").withColumn("piece", F.lit(0)).select(*_names(_PIECES))
    raw = _names(_RAW)
    open_pieces = read.where("not alone").select("conv", "part", "no", *raw)
    seen = open_pieces.join(_seen_before(open_pieces), ["part", "no"], "left").select("conv", "part", "no", *raw, "seen")
    matrices = kept(seen.mapInArrow(_matrices, _MATRIX), "turns-matrices")
    n = partitions(view)
    small = matrices.select("conv", "part", "no", "matrix")
    exits = (small.repartition(n, "conv").sortWithinPartitions("conv", F.desc("part"), F.desc("no"))
             .mapInArrow(_back, _EXITS))
    traced = matrices.drop("matrix").join(exits, ["part", "no"]).mapInArrow(_traces, _TRACED)
    pieces = (traced.repartition(n, "conv").sortWithinPartitions("conv", "part", "no").mapInArrow(_forward, _PIECES))
    return alone.unionByName(pieces)


_DIGEST = ("conv long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string, turns long, min_turn long, max_turn long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation; pieces come in order and are hashed as they come."""
    out, sums = _Writer(_DIGEST), ("blank", "duplicate", "truncated", "illegal", "cost", "turns")
    held, sha, audit, started = None, None, [], False

    def row():
        return held | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    for p in _dicts(batches):
        if held is None or p["piece"] == 0:
            if held is not None and out.add(row(), len(audit)):
                yield out.batch()
            held = dict.fromkeys(sums, 0) | {"conv": p["conv"], "min_turn": None, "max_turn": None}
            sha, audit, started = hashlib.sha256(), [], False
        for k in sums:
            held[k] += p[k]
        if held["min_turn"] is None:
            held["min_turn"] = p["min_turn"]
        if p["max_turn"] is not None:
            held["max_turn"] = p["max_turn"]
        audit.append(p["edits"])
        for role, text in zip(p["roles"], p["texts"], strict=True):
            sha.update(f"{chr(10) if started else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            started = True
    if held is not None:
        out.add(row())
    if out.rows:
        yield out.batch()


def digest(pieces: DataFrame, conversations: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation of ``conversations``: gaps between its turns, faults, cost,
    edits (``audit``) and the SHA-256 of the repaired turns (``role:text`` lines).

    A conversation without rows in ``pieces`` has zeros, no edits and the hash of an
    empty text; a null id is one conversation.
    """
    pieces = kept(pieces, "turns-pieces")
    alone = pieces.where("alone").mapInArrow(_digest, _DIGEST)
    rest = (pieces.where("not alone").repartition(partitions(pieces), "conv").sortWithinPartitions("conv", "piece")
            .mapInArrow(_digest, _DIGEST))
    found = alone.unionByName(rest)
    every = conversations.select(F.col(conv_col).cast("long").alias(conv_col)).distinct()
    both = every.join(found, every[conv_col].eqNullSafe(found["conv"]), "left")
    zero = F.lit(0).cast("long")
    gaps = F.coalesce(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"), zero)
    return both.select(conv_col, gaps.alias("gaps"),
                       *[F.coalesce(c, zero).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
                       F.coalesce("audit", F.lit("")).alias("audit"),
                       F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def damage(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Rows with faults put in by crc32(``conversation:turn``) % 20: 0 drops the row, 1
    empties its text, 2 removes ``.``, ``!`` and ``?``, 3 repeats it, 4 makes it a user's.
    Nulls are one space, also in the key; other columns are dropped."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    view = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                        text(role_col).alias("role"), text(text_col).alias("text"),
                        (F.crc32(F.concat(text(conv_col), F.lit(":"), text(turn_col)).cast("binary")) % 20).alias("k"))
    k = F.col("k")
    changed = view.where(k != 0).select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate("text", _ENDS, "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return changed.drop("copy")
