"""Token ids in binary files, each id in the fewest bits that hold the vocabulary.

File format (little-endian). A file is a run of blocks; a block is

    4 bytes   b"WTB2"
    4 x u32   bits per id, documents, bytes of the id part, bytes of the block
    documents x i64   document ids
    documents x u32   ids of each document
    documents, a bit each: 1 marks a document without an id (its i64 is 0)
    ids, ``bits`` bits each, least significant bit first, padded to a byte
    1 byte    0x0A

``write_index`` leaves a table of block offsets and their least and largest document
id beside the files, so ``read_document`` reaches a document by one seek; a block is
unpacked with vectorised bit operations. Spark writes the files (one per task, through
whatever file system the path names) and reads them back as binary rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.llm.common import kept, partitions, scratch, starts, trim

MAGIC = b"WTB2"
HEAD = 20
END = b"\n"
#: rows encoded together: the more, the fewer times a frequent word is looked up
ROWS = 2048
#: a block is closed at this many ids (a document is never split)
BLOCK_IDS = 1 << 18
_MARK = re.compile(r"([.,])(?<=[a-z\u00df-\u00f6\u00f8-\u00ff][.,])[ \n]")
FILE_ROWS = "file string, block_at long, block_bytes long, doc_id long, ids_in_file_before long, n_tokens long, ids_crc32 long"


def bits_for(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first."""
    if bits == 16:
        return ids.astype("<u2").tobytes()
    if bits == 8:
        return ids.astype(np.uint8).tobytes()
    flat = ((ids.astype(np.uint32)[:, None] >> np.arange(bits, dtype=np.uint32)) & 1).astype(np.uint8)
    return np.packbits(flat.ravel(), bitorder="little").tobytes()


def unpack_ids(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, "<u2", n).astype(np.uint32)
    if bits == 8:
        return np.frombuffer(data, np.uint8, n).astype(np.uint32)
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def write_block(doc_ids: list, per_doc: list[np.ndarray], bits: int) -> bytes:
    """One block; a document id may be None."""
    ids = np.concatenate(per_doc) if per_doc else np.zeros(0, np.uint32)
    body = pack_ids(ids, bits)
    null = np.packbits([i is None for i in doc_ids], bitorder="little").tobytes()
    size = HEAD + 12 * len(doc_ids) + len(null) + len(body) + len(END)
    return b"".join([MAGIC, np.array([bits, len(doc_ids), len(body), size], "<u4").tobytes(),
                     np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
                     np.array([len(x) for x in per_doc], "<u4").tobytes(), null, body, END])


def read_block(data: bytes, at: int = 0):
    """(document ids, which of them are null, ids per document, all ids, offset of the next block)."""
    if data[at:at + 4] != MAGIC:
        raise ValueError(f"no block at byte {at}")
    bits, n, body, size = np.frombuffer(data, "<u4", 4, at + 4).tolist()
    doc_ids = np.frombuffer(data, "<i8", n, at + HEAD)
    counts = np.frombuffer(data, "<u4", n, at + HEAD + 8 * n).astype(np.int64)
    marks = at + HEAD + 12 * n
    first = marks + -(-n // 8)
    null = np.unpackbits(np.frombuffer(data, np.uint8, first - marks, marks), count=n, bitorder="little").astype(bool)
    return doc_ids, null, counts, unpack_ids(data[first:first + body], int(counts.sum()), bits), at + size


class LibraryEncoder:
    """Ids of texts as a ``tokenizers`` file gives them, with every distinct
    word encoded once per worker.

    Valid for tokenizers that drop white space and never join what an ASCII
    space parts (``word_bpe_49k.json``). A word of Latin letters needs no
    normalisation but lower case, and punctuation after it is a pre-token of its
    own; so such words go to a copy of the tokenizer without the normaliser, each
    lower-cased form once. All other strings go to the tokenizer as it is. The
    memory is emptied at ``limit`` words.
    """

    #: letters beyond these are not their own composed form
    _OTHER = re.compile("[\u0130\u0180-\U0010ffff]")
    _PUNCTUATION = ".,;:!?$%&*#|"

    def __init__(self, path: str, limit: int = 1 << 19):
        self.path, self.limit, self._memo = path, limit, None

    def __getstate__(self):
        return {"path": self.path, "limit": self.limit, "_memo": None}

    def _load(self):
        import json
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self._full = Tokenizer.from_file(self.path)
        self._kind = "<u2" if self._full.get_vocab_size() <= 1 << 16 else "<u4"
        self._full.no_truncation()
        self._full.no_padding()
        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        spec |= {"normalizer": None, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None,
                 "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                                   "use_regex": False}}
        self._plain = Tokenizer.from_str(json.dumps(spec))
        self._memo = {"": b""}

    def forget(self) -> None:
        self._memo = {"": b""}

    def _ids(self, tokenizer, words: list[str]) -> list[bytes]:
        got = tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, self._kind).tobytes() for e in got]

    def _learn(self, words: list[str]) -> None:
        memo, marks, other_letter = self._memo, self._PUNCTUATION, self._OTHER.search
        letters, parts, other = [], [], []
        for w in words:
            body = w if w.isalpha() else w.rstrip(marks)
            if not body.isalpha() or not body.isascii() and other_letter(body) is not None:
                other.append(w)
            elif body is w:
                letters.append(w)
            else:
                parts.append((w, body.lower(), w[len(body):]))
        memo.update(zip(letters, self._ids(self._plain, [w.lower() for w in letters]), strict=True))
        new = list({b for _, b, _ in parts}.difference(memo))
        memo.update(zip(new, self._ids(self._plain, new), strict=True))
        other += {t for _, _, t in parts}.difference(memo, other)
        memo.update(zip(other, self._ids(self._full, other), strict=True))
        memo.update((w, memo[b] + memo[t]) for w, b, t in parts)

    def _plainer(self, text: str) -> str:
        """The text in lower case, and with a space before a comma or full stop that
        stands alone between a letter and a space, where neither changes its ids."""
        if "<|" in text or not text or not text.isascii() and self._OTHER.search(text):
            return text
        return _MARK.sub(r" \1 ", text.lower())

    def __call__(self, texts: list[bytes]) -> list[np.ndarray]:
        if self._memo is None:
            self._load()
        if len(self._memo) > self.limit:
            self._memo = {"": b""}
        lines = pa.array([self._plainer(t.decode("utf-8", "replace")).replace("\n", " ") for t in texts], pa.large_string())
        split = pc.split_pattern(lines, " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        unknown = [w for w in words if w not in self._memo]
        if unknown:
            self._learn(unknown)
        # ids of the distinct words one after the other, and from them those of all words
        held = list(map(self._memo.__getitem__, words))
        flat = np.frombuffer(b"".join(held), self._kind)
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // flat.itemsize
        word = coded.indices.to_numpy()
        n = sizes[word]
        ends = np.cumsum(n)
        ids = flat[np.repeat(starts(sizes)[:-1][word] - (ends - n), n) + np.arange(int(n.sum()))]
        cut = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:z] for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _encode(encoder: Callable[[list[bytes]], list[np.ndarray]], end_id: int | None, bits: int):
    """Rows (one block each) of the documents of a task, in their order."""
    tail = np.array([] if end_id is None else [end_id], "<u2" if bits <= 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc_ids, per_doc):
            return pa.RecordBatch.from_arrays([pa.array([write_block(doc_ids, per_doc, bits)], pa.binary())], ["value"])
        trim()  # what the task before left
        doc_ids, per_doc, held = [], [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                got = encoder(part.column(1).to_pylist())
                for i, ids in zip(part.column(0).to_pylist(), got, strict=True):
                    doc_ids.append(i)
                    per_doc.append(np.concatenate([ids, tail]))
                    held += len(ids) + len(tail)
                    if held >= BLOCK_IDS:
                        yield row(doc_ids, per_doc)
                        doc_ids, per_doc, held = [], [], 0
        if doc_ids:
            yield row(doc_ids, per_doc)
        getattr(encoder, "forget", int)()
        trim()

    return run


def write_ids(docs: DataFrame, path: str, encoder: Callable[[list[bytes]], list[np.ndarray]], vocab_size: int,
              end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Write the ids of all texts, in ascending id order, as files below ``path``.

    The rows are dealt out by ranges of the id, so files follow each other in id
    order and no task holds more than its range. A null text is empty (its end
    id alone is written). Null ids come first and stay null. Rows with the same
    id follow each other in text order. An empty table gives no blocks. Ids must
    be below ``vocab_size``. Returns ``path``.
    """
    view = docs.select(F.col(id_col).cast("long").alias("id"),
                       F.coalesce(F.col(text_col).cast("binary"), F.lit(b"")).alias("text"))
    ranged = view.repartitionByRange(partitions(view), "id").sortWithinPartitions("id", "text")
    rows = ranged.mapInArrow(_encode(encoder, end_id, bits_for(vocab_size)), "value binary")
    # each row of the text writer is the row's bytes and one line feed: the block's last byte is that line feed
    body = F.expr("substring(value, 1, length(value) - 1)").cast("string")
    rows.select(body.alias("value")).write.text(path)
    return path


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            at, before = 0, 0
            while at < len(data):
                doc_ids, null, counts, ids, after = read_block(data, at)
                cut = starts(counts)
                raw = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a:4 * z]) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * len(doc_ids)), pa.array([at] * len(doc_ids), pa.int64()),
                     pa.array([after - at] * len(doc_ids), pa.int64()), pa.array(doc_ids, mask=null),
                     pa.array(before + cut[:-1]), pa.array(counts), pa.array(crc, pa.int64())],
                    ["file", "block_at", "block_bytes", "doc_id", "ids_in_file_before", "n_tokens", "ids_crc32"])
                at, before = after, before + int(counts.sum())


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files below ``path``, read back from them: file,
    byte offset and bytes of its block, id, ids before it in the file, its number of
    ids and the CRC-32 of them as little-endian unsigned 32-bit integers."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_documents, FILE_ROWS)


def write_index(rows: DataFrame, path: str) -> str:
    """Write the block table of the files below ``path`` beside them (``_index``): file,
    block_at, block_bytes, least and largest document id of each block. ``rows`` is what
    ``read_ids`` gives. Returns the table's path."""
    index = f"{path.rstrip('/')}/_index"
    blocks = rows.groupBy("file", "block_at", "block_bytes").agg(F.min("doc_id").alias("least"),
                                                                 F.max("doc_id").alias("most"))
    blocks.sort("least", "file", "block_at").write.mode("overwrite").parquet(index)
    return index


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[np.ndarray]:
    """The ids of the documents named ``doc_id`` (none, one, or repeated rows): only the
    blocks whose range holds the id are read, each by one seek."""
    index = spark.read.parquet(f"{path.rstrip('/')}/_index")
    held = index.where(F.lit(doc_id).between(F.col("least"), F.col("most"))).sort("file", "block_at").collect()
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for block in held:
        at = jvm.org.apache.hadoop.fs.Path(block["file"])
        stream = at.getFileSystem(conf).open(at)
        try:
            stream.seek(block["block_at"])
            data = bytes(stream.readNBytes(block["block_bytes"]))
        finally:
            stream.close()
        doc_ids, null, counts, ids, _ = read_block(data)
        cut = starts(counts)
        found += [ids[cut[i]:cut[i + 1]] for i in np.flatnonzero((doc_ids == doc_id) & ~null).tolist()]
    return found


def global_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all files and documents before. Files follow each
    other by their first id, null before any; the running sum is over one row per file."""
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"), F.min("doc_id").alias("first"),
                                     F.max(F.col("doc_id").isNull()).alias("null"))
    w = Window.orderBy(F.desc("null"), "first", "file").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    return rows.join(before, "file").withColumn("start", F.col("before") + F.col("ids_in_file_before"))


def packed_ids(docs: DataFrame, encoder: Callable[[list[bytes]], list[np.ndarray]], vocab_size: int, end_id: int,
               path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files (below ``path``, by default the shared scratch folder) and
    return (id, start, n_tokens, ids_crc32, file, block_at) read back from them."""
    spark = docs.sparkSession
    path = write_ids(docs, path or scratch(spark, "ids"), encoder, vocab_size, end_id, id_col, text_col)
    found = kept(read_ids(spark, path), "ids-read")
    write_index(found, path)
    rows = global_starts(found)
    return rows.select(F.col("doc_id").alias(id_col), "start", "n_tokens", "ids_crc32",
                       "file", "block_at")
