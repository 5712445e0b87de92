"""SentencePiece BPE encoding of documents of any length, as a max-plus scan.

Model files of the BPE kind (identity normaliser, dummy prefix, byte fallback)
have a local test: a sequence of tokens is the encoding of its text if, and only
if, every two neighbours are the encoding of their own two texts put together. So
encoding is a path search: the states at a position are the tokens that reach up
to or over it, two tokens may follow each other if they pass the test, and exactly
one path through a text is allowed.

Documents of more than ``chunk`` characters are cut there, at any character. A
chunk's transfer matrix holds, for each state at its left and each at its right
boundary, the number of tokens that end in the chunk on the path between them, or
minus infinity where there is none. Matrices of one document are combined by
max-plus products (associative, so as a prefix scan); the start and end of the
document then fix every boundary state, and each chunk is traced back alone.
Inside a chunk, the path is forced wherever a space follows another character
(no piece holds a space after one): the words between the first and the last such
place are encoded one by one, each distinct word once per worker.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.llm.common import kept, trim

CHUNK = 1 << 15
SPACE = "▁"
NONE = -np.inf
_WORDS = re.compile(rf"{SPACE}+[^{SPACE}]*")
#: words and pairs of tokens a worker remembers (some 200 bytes each)
_MEMO = 1 << 19
#: rows encoded or decoded at once
_ROWS = 1024


class Pieces:
    """A model file, loaded on first use in each worker."""

    def __init__(self, path: str):
        self.path = path

    def __getstate__(self):
        return {"path": self.path}

    def __getattr__(self, name):  # only before loading
        if name.startswith("__") or "path" not in self.__dict__:
            raise AttributeError(name)
        self._load()
        return self.__dict__[name]

    def _load(self):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=self.path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.sp = sp
        self.special = {i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)}
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.id_of = {p: i for i, p in enumerate(names) if i not in self.special and not sp.is_byte(i)}
        if len(self.byte_id) != 256 or any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a model with byte fallback and no piece across words is needed")
        self.score = {p: sp.get_score(i) for p, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        by_id = [p.replace(SPACE, " ").encode() for p in names]
        for b, i in self.byte_id.items():
            by_id[i] = bytes([b])
        for i in self.special:
            by_id[i] = b""
        self.bytes_of = by_id
        self.words, self.fits = {}, {}

    # ---- the local test -----------------------------------------------------
    def merge(self, text: str) -> list[str]:
        """Tokens of a short text: the best-scored, leftmost pair is merged first."""
        t, score = list(text), self.score
        while True:
            best, at = NONE, -1
            for i in range(len(t) - 1):
                s = score.get(t[i] + t[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                return t
            t[at:at + 2] = [t[at] + t[at + 1]]

    def follow(self, a: str, b: str) -> bool:
        """Whether token b may follow token a."""
        if b[0] == SPACE and a[-1] != SPACE:
            return True
        key = (a, b)
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > _MEMO:
                self.fits.clear()
            ok = self.fits[key] = self.merge(a + b) == [a, b]
        return ok

    def token(self, t: str) -> bool:
        return t in self.id_of or len(t) == 1

    def ids(self, tokens: list[str]) -> list[int]:
        out = []
        for t in tokens:
            i = self.id_of.get(t)
            if i is None:
                out.extend(self.byte_id[b] for b in t.encode("utf-8", "replace"))
            else:
                out.append(i)
        return out

    # ---- whole words --------------------------------------------------------
    def word_ids(self, words: list[str]) -> bytes:
        """Ids (as bytes) of words, each of which stands for itself with a space before."""
        memo = self.words
        new = set(words).difference(memo)  # not `- memo.keys()`, which goes over the memory
        if new:
            if len(memo) > _MEMO:
                memo.clear()
                new = set(words)
            new.discard("")
            new = list(new)
            for w, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True):
                memo[w] = np.array(ids, "<i4").tobytes()
            memo[""] = np.array([self.id_of[SPACE]], "<i4").tobytes()
        return b"".join(map(memo.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.zeros(0, "<i4")
        text = text.replace(SPACE, " ")
        if "  " in text or text[0] == " " or text[-1] == " ":
            words = [w[1:] for w in _WORDS.findall(SPACE + text.replace(" ", SPACE))]
        else:
            words = text.split(" ")
        return np.frombuffer(self.word_ids(words), "<i4")

    def decode(self, ids) -> bytes:
        """UTF-8 text of ids, without the dummy prefix."""
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        return out[1:] if out[:1] == b" " else out

    # ---- chunks -------------------------------------------------------------
    def states(self, left: str, right: str) -> list[tuple[str, int]]:
        """(token, characters of it after the boundary) of every token that ends at
        or reaches over the boundary between ``left`` and ``right``."""
        out = []
        for a in range(1, min(self.longest, len(left)) + 1):
            for r in range(min(self.longest - a, len(right)) + 1):
                t = left[len(left) - a:] + right[:r]
                if self.token(t):
                    out.append((t, r))
        return out

    def forward(self, text: str, first: str | None, at: int, stop: int) -> dict[int, tuple[int, str, int]]:
        """Positions reached from token ``first`` ending at ``at`` (None: the start of
        the document): position -> (tokens since, last token, position before).
        Tokens start before ``stop``; ``text`` may go on behind it."""
        reached = {at: (0, first, -1)}
        for b in range(at, stop):
            if b not in reached:
                continue
            n, last, _ = reached[b]
            for e in range(b + 1, min(b + self.longest, len(text)) + 1):
                t = text[b:e]
                if self.token(t) and e not in reached and (last is None or self.follow(last, t)):
                    reached[e] = (n + 1, t, b)
        return reached


def _forced(text: str, lo: int) -> list[int]:
    """First and last place at or after ``lo`` where a space follows another character."""
    first = re.compile(rf"(?<=[^{SPACE}]){SPACE}").search(text, max(lo, 1))
    if not first:
        return []
    last = len(text) - 1
    while not (text[last] == SPACE and text[last - 1] != SPACE):
        last -= 1
    return [first.start(), last]


def _inner(m: Pieces, text: str) -> bytes:
    """Ids of whole words: a text that starts with a space after a forced place."""
    return m.word_ids([w[1:] for w in _WORDS.findall(text)])


class Chunk:
    """One chunk with up to ``longest`` characters of text on either side."""

    def __init__(self, m: Pieces, before: str, body: str, after: str):
        self.m, self.before, self.body, self.after = m, before, body, after
        self.left = m.states(before, body + after) if before else [(None, 0)]
        self.right = m.states(before + body, after) if after else []
        if not after:  # the document ends here: only tokens that end here
            self.right = [s for s in m.states((before + body)[-m.longest:], "") if s[1] == 0]
        forced = _forced(body, 0)
        self.forced = forced if forced and (not before or forced[0] >= 0) else []

    def _ends(self, reached, first, r, place):
        """(count, tokens back) for every right state that a path comes to."""
        for j, (t, over) in enumerate(self.right):
            at = place + over
            if at in reached and reached[at][1] == t and (reached[at][2] >= 0 or (first == t and at == r)):
                yield j, at

    def matrix(self) -> np.ndarray:
        out = np.full((len(self.left), len(self.right)), NONE)
        n, text = len(self.body), self.body + self.after
        if not self.forced:
            for i, (t, r) in enumerate(self.left):
                reached = self.m.forward(text, t, r, n) if r < n else {r: (0, t, -1)}
                for j, at in self._ends(reached, t, r, n):
                    out[i, j] = reached[at][0]
            return out
        a, z = self.forced
        head = np.full(len(self.left), NONE)
        for i, (t, r) in enumerate(self.left):
            if r <= a:
                got = self.m.forward(text[:a], t, r, a)
                if a in got:
                    head[i] = got[a][0]
        middle = len(_inner(self.m, text[a:z])) // 4
        tail = np.full(len(self.right), NONE)
        reached = self.m.forward(text, None, z, n)
        for j, at in self._ends(reached, None, -1, n):
            tail[j] = reached[at][0]
        return head[:, None] + middle + tail[None, :]

    def trace(self, i: int, j: int) -> bytes:
        """Ids of the tokens that start in this chunk, on the path from left state i to right state j."""
        m, n, text = self.m, len(self.body), self.body + self.after
        t, r = self.left[i]

        def back(reached, at):
            tokens = []
            while reached[at][2] >= 0:
                tokens.append(reached[at][1])
                at = reached[at][2]
            return np.array(m.ids(tokens[::-1]), "<i4").tobytes()

        end = n + self.right[j][1]
        if not self.forced:
            return back(m.forward(text, t, r, n) if r < n else {r: (0, t, -1)}, end)
        a, z = self.forced
        head = back(m.forward(text[:a], t, r, a), a)
        return head + _inner(m, text[a:z]) + back(m.forward(text, None, z, n), end)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1) if a.size and b.size else np.full((len(a), b.shape[1]), NONE)


def boundary_states(matrices: list[np.ndarray]) -> list[tuple[int, int]]:
    """(left, right) state of every chunk on the one allowed path. Prefix and
    suffix products are built by doubling, so the combination is a scan."""
    def scan(ms, mul):
        out, step = list(ms), 1
        while step < len(out):
            out = [out[k] if k < step else mul(out[k - step], out[k]) for k in range(len(out))]
            step *= 2
        return out
    forward = scan(matrices, product)
    backward = scan(matrices[::-1], lambda later, earlier: product(earlier, later))[::-1]
    at = [0]
    for k in range(len(matrices) - 1):
        through = forward[k][0] + backward[k + 1].max(axis=1)
        at.append(int(np.argmax(through)))
        if through[at[-1]] == NONE:
            raise ValueError("no path through a document")
    last = int(np.argmax(forward[-1][0]))
    return list(zip(at, at[1:] + [last], strict=True))


def _chunk(m: Pieces, before, body, after) -> Chunk:
    return Chunk(m, before, body, after)


def _matrices(m: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, *texts = (c.to_pylist() for c in b.columns)
            got = [_chunk(m, *t).matrix() for t in zip(*texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(no, pa.int64()), pa.array([len(g) for g in got], pa.int32()),
                 pa.array([g.astype(np.float32).tobytes() for g in got], pa.binary())],
                ["row", "no", "n_left", "matrix"])

    return run


def _scan(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("no")
    ms = [np.frombuffer(x, np.float32).reshape(n, -1).astype(np.float64)
          for x, n in zip(rows["matrix"], rows["n_left"], strict=True)]
    states = boundary_states(ms)
    return pd.DataFrame({"row": rows["row"].to_numpy(), "no": rows["no"].to_numpy(),
                         "i": [s[0] for s in states], "j": [s[1] for s in states]})


def _trace(m: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, no, before, body, after, i, j = (c.to_pylist() for c in b.columns)
            got = [_chunk(m, *t[:3]).trace(*t[3:]) for t in zip(before, body, after, i, j, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row, pa.int64()), pa.array(no, pa.int64()), pa.array(got, pa.binary())], ["row", "no", "part"])

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task, few at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, _ROWS):
            yield b.slice(lo, _ROWS)
    trim()


def _short(m: Pieces):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            ids = [m.encode(t).tobytes() for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ids, pa.binary())],
                                             [*b.schema.names[:-1], "_ids"])

    return run


def encode_ids(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "piece_ids",
               chunk: int = CHUNK) -> DataFrame:
    """``docs`` with ``ids_col``: the piece ids of each text, 32-bit little-endian.

    Equal to the sentencepiece library's encoding of the whole text. A null or
    empty text has no ids. All columns but an older ``ids_col`` stay, repeated
    rows too; an empty table gives no rows. Only texts of more than ``chunk``
    characters are cut and shuffled, by chunk.
    """
    m = Pieces(path)
    rows = docs.drop(ids_col)
    cols = rows.columns
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]
    text = F.coalesce(F.col(text_col), F.lit(""))
    giant = F.length(text) > chunk
    short = rows.where(~giant).withColumn("_text", text)
    short = short.mapInArrow(_short(m), ", ".join([*kinds, "_ids binary"]))

    halo = 16 * 4  # a piece's length at most
    big = kept(rows.where(giant).withColumn("_row", F.monotonically_increasing_id()), "giants")
    whole = F.concat(F.lit(SPACE), F.translate(text, " ", SPACE))
    chunks = big.select(F.col("_row").alias("row"), whole.alias("t")).select(
        "row", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.length("t") - 1) / chunk))).alias("no"))
    at = F.col("no") * chunk
    reach = F.least(at, F.lit(halo)).cast("int")
    cut = lambda start, n: F.substr("t", (start + 1).cast("int"), F.lit(n).cast("int") if isinstance(n, int) else n)
    chunks = kept(chunks.select("row", "no", cut(at - reach, reach).alias("before"), cut(at, chunk).alias("body"),
                                cut(at + chunk, halo).alias("after")).repartition("row", "no"), "chunks")
    moves = chunks.mapInArrow(_matrices(m), "row long, no long, n_left int, matrix binary")
    states = moves.groupBy("row").applyInPandas(_scan, "row long, no long, i int, j int")
    traced = chunks.join(states, ["row", "no"]).select("row", "no", "before", "body", "after", "i", "j").mapInArrow(
        _trace(m), "row long, no long, part binary")
    parts = traced.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("no", "part"))).alias("p"))
    joined = parts.select("row", F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["part"]))
                          .alias("_ids"))
    long = big.join(joined, big["_row"] == joined["row"]).select(*cols, "_ids")
    return short.select(*cols, "_ids").unionByName(long).withColumnRenamed("_ids", ids_col)


def decode_ids(docs: DataFrame, path: str, ids_col: str = "piece_ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with ``text_col``: the text of the ids (the space mark reads as a
    space; null ids give null)."""
    m = Pieces(path)
    rows = docs.drop(text_col)
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            got = [None if x is None else m.decode(np.frombuffer(x, "<i4").tolist()).decode("utf-8", "replace")
                   for x in b.column("_x").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(got, pa.string())],
                                             [*b.schema.names[:-1], text_col])

    return rows.withColumn("_x", F.col(ids_col)).mapInArrow(run, ", ".join([*kinds, f"`{text_col}` string"]))


def digest(encoded: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           ids_col: str = "piece_ids", decoded: str = "decoded") -> DataFrame:
    """(id, n_pieces, ids_crc32, round_trip) of an encoded and decoded table."""
    same = F.col(decoded).eqNullSafe(F.translate(F.coalesce(F.col(text_col), F.lit("")), SPACE, " "))
    return encoded.select(id_col, (F.octet_length(ids_col) / 4).cast("long").alias("n_pieces"),
                          F.crc32(ids_col).alias("ids_crc32"), same.alias("round_trip"))
