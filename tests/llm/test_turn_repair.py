"""Conversation repair against a plain search over (cost, edits), on edge rows, long
conversations that are cut into pieces, and the registered query."""

import hashlib
import random
import zlib
from functools import lru_cache

from weft.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, conv string, part int, no int, piece int"
SF = "/root/testdata/sf0.01"
WHITE = " \t\n\v\f\r"


def plain_repair(rows):
    """(cost, edits, repaired) of (turn, role, text) rows in order, from the contract's words."""
    seen, marks = set(), []
    for _, role, text in rows:
        end = text.rstrip(WHITE)
        marks.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    n = len(rows)

    # the state is what the initials so far are: "", "s", "u" (ends with a user) or "a"
    def nexts(i, state, spent):
        want = "a" if state == "u" else "u"
        if not spent:
            yield "I", 2, i, want, ("user" if want == "u" else "assistant", "")
        if i < n:
            yield "D", 3, i + 1, state, None
            if marks[i] not in ("b", "d"):
                late = marks[i] == "t"
                first = rows[i][1][:1]
                if first == want or first == "s" and state == "":
                    yield "K", int(late), i + 1, first, rows[i][1:]
                yield "R", 2 + late, i + 1, want, ("user" if want == "u" else "assistant", rows[i][2])

    # two inserts after each other between the same rows bring the state back: never cheapest beyond two
    @lru_cache(None)
    def best(i, state, inserts):
        found = [(0, "", ())] if i == n and state in ("", "a") else []
        for letter, cost, j, after, out in nexts(i, state, inserts >= 2):
            rest = best(j, after, inserts + 1 if letter == "I" else 0)
            if rest is not None:
                found.append((cost + rest[0], letter + rest[1], ((out,) if out else ()) + rest[2]))
        return min(found, key=lambda x: x[:2]) if found else None

    cost, edits, out = best(0, "", 0)
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return cost, edits, sha, [marks.count(x) for x in "bdt"]


def expected(rows, conv):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    cost, edits, sha, (b, d, t) = plain_repair(rows)
    turns = [x for x, *_ in rows if x is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(rows, rows[1:]))
    return conv, gaps, b, d, t, illegal, cost, edits, sha


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else "".join(c for c in text if c not in ".!?") if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        conv = None if c == 3 else c
        for t in range(rng.randint(1, longest)):
            turn = rng.choice([t, t, t, None, t + 5])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "sage"])
            text = rng.choice([f"Word {rng.randint(0, 9)}.", "same text.", "cut off", "", " \t", None, "end! \x0b", "q?",
                               "naïve 日本語.", "no "])
            rows.append((conv, turn, role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    return rows


def check(spark, rows):
    frame = spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], SCHEMA).repartition(3)
    got = tr.digest(tr.repair_turns(tr.damage(frame)), frame).collect()
    by = {}
    for conv, *rest in damaged(rows):
        by.setdefault(conv, []).append(tuple(rest))
    want = [expected(by[c], c) if c in by else (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
            for c in {r[0] for r in rows}]

    def order(r):
        return (r[0] is not None, r[0] or 0)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    return got


def test_edge_rows(spark):
    check(spark, conversations(1, 80, 9))


def test_conversations_that_meet_the_ends_of_partitions(spark):
    check(spark, conversations(2, 4, 300))


def test_one_long_conversation_spans_many_pieces(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]),
             rng.choice([f"Line {rng.randint(0, 500)}.", "Same.", "", "open"])) for t in range(6000)]
    frame = spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], SCHEMA).repartition(6)
    pieces = tr.repair_turns(frame)
    assert pieces.count() > 5
    got = tr.digest(pieces, frame).collect()
    cost, edits, sha, faults = forward_plain([r[1:] for r in rows])
    (row,) = got
    assert (row.cost, row.audit, row.repaired_sha256) == (cost, edits, sha)
    assert [row.blank, row.duplicate, row.truncated] == faults
    assert row.illegal == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))


def forward_plain(rows):
    """As ``plain_repair`` without recursion: distances from the end by a table."""
    seen, marks = set(), []
    for _, role, text in rows:
        end = text.rstrip(WHITE)
        marks.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    inf = 10 ** 9
    n = len(rows)
    want = {"": "u", "s": "u", "u": "a", "a": "u"}
    table = [None] * (n + 1)

    def moves(i, q):
        if i < n:
            yield "D", 3, i + 1, q
        yield "I", 2, i, want[q]
        if i < n and marks[i] not in ("b", "d"):
            late, first = int(marks[i] == "t"), rows[i][1][:1]
            if first == want[q] or first == "s" and q == "":
                yield "K", late, i + 1, first
            yield "R", 2 + late, i + 1, want[q]

    for i in range(n, -1, -1):
        table[i] = {q: 0 if i == n and q in ("", "a") else inf for q in want}
        for _ in range(4):
            for q in want:
                for _, cost, j, r in moves(i, q):
                    table[i][q] = min(table[i][q], cost + table[j][r])
    i, q, edits, out = 0, "", [], []
    while not (i == n and table[i][q] == 0):
        for letter, cost, j, r in moves(i, q):
            if cost + table[j][r] == table[i][q]:
                edits.append(letter)
                if letter == "I":
                    out.append(("user" if r == "u" else "assistant") + ":")
                elif letter == "K":
                    out.append(f"{rows[i][1]}:{rows[i][2]}")
                elif letter == "R":
                    out.append(("user" if r == "u" else "assistant") + f":{rows[i][2]}")
                i, q = j, r
                break
    return (table[0][""], "".join(edits), hashlib.sha256("\n".join(out).encode()).hexdigest(),
            [marks.count(x) for x in "bdt"])


def test_auction_prices_are_distances():
    rng = random.Random(9)
    for _ in range(300):
        symbols = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(0, 12)))
        exits = rng.choice([tr._END, (0, None, None, None), (None, 0, None, None), (None, None, 0, None), (3, 1, 0, 2)])
        n, inf = len(symbols), 10 ** 6
        far = [[inf] * 4 for _ in range(n + 1)]
        far[n] = [inf if x is None else x for x in exits]
        for i in range(n, -1, -1):
            for _ in range(5):
                for q in range(4):
                    for _, cost, step, r in tr.ARCS[symbols[i] if i < n else ""][q]:
                        far[i][q] = min(far[i][q], cost + far[i + step][r])
        got = [inf if p is None else p for p in tr.auction(symbols, exits)]
        assert got == [x for stage in far for x in stage]


def test_repeated_row_without_end(spark):
    rows = [(1, 0, "user", "Hi.")] * 5000 + [(1, 1, "assistant", "Yes.")]
    frame = spark.createDataFrame([(*r, "x", 1, None, 2) for r in rows], SCHEMA).repartition(4)
    (row,) = tr.digest(tr.repair_turns(frame), frame).collect()
    assert (row.cost, row.audit, row.duplicate, row.illegal) == (3 * 4999, "K" + "D" * 4999 + "K", 4999, 4999)


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert tr.repair_turns(frame).count() == 0
    assert tr.digest(tr.repair_turns(tr.damage(frame)), frame).count() == 0


def test_registered_query_against_plain_search(spark):
    from tests.conftest import SF_MID
    from weft.llm.queries import QUERIES
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r) for r in QUERIES["op12_turn_repair"](spark, SF).collect()}
    by = {}
    for conv, *rest in damaged(rows):
        by.setdefault(conv, []).append(tuple(rest))
    assert got.keys() == {r[0] for r in rows}
    for c, found in got.items():
        assert found == (expected(by[c], c) if c in by else (c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
