"""Op 4. Token ids in binary files, coded with Simple-8b.

Texts are range-partitioned by id, tokenised, and each partition becomes one file. A file
is a header, blocks, a block index, a document index and a footer, little-endian:

    header    8 bytes   magic ``TFS8B1\\0\\0``
    blocks    64-bit words; a block holds up to BLOCK ids (the last one fewer)
    index     per block: byte offset, number of words, number of ids (3 x uint64)
    documents per document: its id, position of its first token, number of tokens (3 x int64)
    footer    blocks, documents, documents without id (they come first), tokens, byte
              offset of the index (5 x uint64), magic

A 64-bit word has a selector in its top 4 bits and 60 bits of payload: selector ``k`` packs
``COUNT[k]`` values of ``WIDTH[k]`` bits, lowest first. Selector 15 is the escape: the next
word is one raw 64-bit value, for values beyond 60 bits. Blocks start on word bounds and
carry their own offsets, so a reader decodes any block alone; all words of one selector
decode in one numpy step.

Tokenising: a text splits at ASCII white space and between an ASCII letter and ASCII
punctuation, where the tokenizer splits too, whatever stands around; distinct pieces are
found by 64-bit hash in a bounded per-worker cache and only new ones reach the tokenizers
library. Texts with a special token's marks go to the library whole.

Files are written by the tasks into the folder of ``spark.checkpoint.dir`` under a name of
the attempt and renamed, so a retried task replaces its own file. Reading goes through
Spark's binaryFile source.

Defined results: a null or empty text is the end id alone; null ids sort first; rows with
equal ids sort by text hash (equal rows are interchangeable); an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as X
from ._store import shared_folder

MAGIC = b"TFS8B1\0\0"
BLOCK = 1 << 16
#: Values per word and their width for selectors 0 to 14 (fixed values of the format).
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
WIDTH = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.int64)
ESCAPE = 15
END_ID = 2
CACHE_WORDS = 1 << 20


# ---------------------------------------------------------------- Simple-8b

def encode_block(v: np.ndarray) -> np.ndarray:
    """Words of one block of unsigned integers."""
    v = np.asarray(v).astype(np.uint64)
    n = len(v)
    if n == 0:
        return np.zeros(0, np.uint64)
    top = np.uint64(1) << np.uint64(60)
    # the first selector whose values all fit: distance to the next value that is too wide
    best = np.full(n, 13, np.int64)
    at = np.arange(n, dtype=np.int32)
    for k in range(12, -1, -1):
        next_wide = np.where(v >> np.uint64(WIDTH[k]), at, np.int32(n + 64))
        next_wide = np.minimum.accumulate(next_wide[::-1])[::-1]
        fits = next_wide - at >= COUNT[k]
        if not fits.any():
            break  # narrower values in longer runs cannot fit either
        best[fits] = k
    best[v >= top] = ESCAPE
    jump = np.append(COUNT, 1)[best].astype(np.uint8).tobytes()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += jump[i]
    starts = np.array(starts, np.int64)
    sel = best[starts]
    size = np.where(sel == ESCAPE, 2, 1)
    place = np.cumsum(size) - size
    words = np.zeros(int(size.sum()), np.uint64)
    padded = np.concatenate([v, np.zeros(64, np.uint64)])
    for k in np.unique(sel):
        mine = np.flatnonzero(sel == k)
        if k == ESCAPE:
            words[place[mine]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[mine] + 1] = v[starts[mine]]
            continue
        w = np.full(len(mine), np.uint64(k) << np.uint64(60), np.uint64)
        for j in range(COUNT[k]):
            w |= padded[starts[mine] + j] << np.uint64(j * WIDTH[k])
        words[place[mine]] = w
    return words


def decode_block(words: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values of a block."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    if (sel == ESCAPE).any():  # a raw word follows each escape and may look like one
        i, flat = 0, sel.tolist()
        while i < len(flat):
            if flat[i] == ESCAPE:
                raw[i + 1] = True
                i += 1
            i += 1
    count = np.where(raw, 1, np.append(COUNT, 0)[sel])
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    out[place[raw]] = words[raw]
    for k in np.unique(sel[~raw]):
        if k == ESCAPE:
            continue
        mine = np.flatnonzero((sel == k) & ~raw)
        mask = (np.uint64(1) << np.uint64(WIDTH[k])) - np.uint64(1)
        w = words[mine]
        for j in range(COUNT[k]):
            out[place[mine] + j] = (w >> np.uint64(j * WIDTH[k])) & mask
    return out[:n]


class FileWriter:
    """Writes blocks as ids arrive; keeps one block and the two indexes in memory."""

    def __init__(self, sink):
        self.sink, self.at = sink, len(MAGIC)
        self.index, self.docs, self.rest, self.held, self.ids, self.nameless = [], [], [], 0, 0, 0
        sink.write(MAGIC)

    def _block(self, v: np.ndarray) -> None:
        words = encode_block(v).astype("<u8")
        self.index.append((self.at, len(words), len(v)))
        self.sink.write(words.tobytes())
        self.at += 8 * len(words)

    def add(self, ids: np.ndarray, lens: np.ndarray, doc_ids: pa.Array) -> None:
        """The token ids of consecutive documents."""
        names = pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)
        self.docs.append(np.stack([names, self.ids + np.cumsum(lens) - lens, lens], 1))
        self.nameless += doc_ids.null_count
        self.ids += len(ids)
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            v = np.concatenate(self.rest)
            for i in range(0, len(v) - BLOCK + 1, BLOCK):
                self._block(v[i:i + BLOCK])
            self.rest = [v[len(v) // BLOCK * BLOCK:]]
            self.held = len(self.rest[0])

    def close(self) -> None:
        if self.held:
            self._block(np.concatenate(self.rest))
        docs = np.concatenate(self.docs) if self.docs else np.zeros((0, 3))
        self.sink.write(np.array(self.index, "<u8").tobytes())
        self.sink.write(docs.astype("<i8").tobytes())
        self.sink.write(np.array([len(self.index), len(docs), self.nameless, self.ids, self.at], "<u8").tobytes() + MAGIC)


def read_file(raw: bytes):
    """(per block: offset, words, ids), (per document: id, position, tokens), documents
    without id of a file."""
    if raw[:8] != MAGIC or raw[-8:] != MAGIC:
        raise ValueError("not a token file")
    blocks, docs, nameless, _, at = np.frombuffer(raw[-48:-8], "<u8").astype(np.int64)
    index = np.frombuffer(raw, "<u8", 3 * blocks, at).reshape(-1, 3).astype(np.int64)
    table = np.frombuffer(raw, "<i8", 3 * docs, at + 24 * blocks).reshape(-1, 3)
    return index, table, int(nameless)


def documents_of(raw: bytes):
    """The ids of each document in turn, decoding one block at a time."""
    index, table, _ = read_file(raw)
    have, base, b = np.zeros(0, np.uint32), 0, 0
    for _, pos, n in table.tolist():
        while base + len(have) < pos + n:
            o, words, ids = index[b]
            more = decode_block(np.frombuffer(raw, "<u8", words, o), ids).astype(np.uint32)
            have, base = np.concatenate([have[pos - base:], more]), pos
            b += 1
        yield have[pos - base:pos - base + n]


# ---------------------------------------------------------------- tokenising

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_MADE: dict = {}


class Tokenizing:
    """Ids of whole slices of texts with a bounded cache of distinct pieces."""

    def __init__(self, path: str, cache: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tok, self.cache = Tokenizer.from_file(path), cache
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.join = next((t for t in self.special if self._joins(t)), None)
        self.reset()

    def _joins(self, mark: str) -> bool:
        """Whether ``mark`` between two pieces keeps them apart and is one id."""
        whole = self.tok.encode(f"a{mark}b", add_special_tokens=False).ids
        parts = [self.tok.encode(x, add_special_tokens=False).ids for x in ("a", "b")]
        return whole == parts[0] + [self.tok.token_to_id(mark)] + parts[1]

    def reset(self) -> None:
        self.table = X.HashTable(self.cache)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.len = np.zeros(self.cache + 1, np.int64), np.zeros(self.cache + 1, np.int32)

    def encode(self, pieces: list[str]) -> list[list[int]]:
        if self.join is None:
            return [x.ids for x in self.tok.encode_batch(pieces, add_special_tokens=False)]
        mark, out = self.tok.token_to_id(self.join), []
        for i in range(0, len(pieces), 256):
            ids = self.tok.encode(self.join.join(pieces[i:i + 256]), add_special_tokens=False).ids
            one: list[int] = []
            for x in ids:
                if x == mark:
                    out.append(one)
                    one = []
                else:
                    one.append(x)
            out.append(one)
        return out

    def _learn(self, h: np.ndarray, pieces: list[str]) -> None:
        ids = self.encode(pieces)
        lens = np.array([len(x) for x in ids], np.int64)
        n, total = self.table.n, int(lens.sum())
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used:self.used + total] = [x for one in ids for x in one]
        self.start[n:n + len(h)] = self.used + np.cumsum(lens) - lens
        self.len[n:n + len(h)] = lens
        self.used += total
        self.table.put(h, np.arange(n, n + len(h), dtype=np.int32))

    def ids(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        data, off = X.doc_bytes(texts)
        marked = np.zeros(len(off) - 1, bool)
        raw = data.tobytes()
        if any(t.encode() in raw for t in self.special):
            marked = np.array([any(t in (x or "") for t in self.special) for x in texts.to_pylist()])
        # cut between a letter and punctuation: that punctuation opens a new piece
        cut = np.zeros(len(data), bool)
        cut[1:] = _PUNCT[data[1:]] & _LETTER[data[:-1]]
        s, e, first = X.spans(data, off, ~X.SPACE[data], cut)
        h = X.span_hash(data, s, e)
        h[h == 0] = 1
        at = self.table.get(h)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, one = np.unique(h[miss], return_index=True)
            if self.table.n + len(new) > self.cache:
                self.reset()
                new, one = np.unique(h, return_index=True)
                miss = np.arange(len(h))
            if len(new) > self.cache:
                self.cache = len(new)
                self.reset()
            pieces = [raw[s[i]:e[i]].decode("utf-8", "replace") for i in miss[one]]
            self._learn(new, pieces)
            at = self.table.get(h)
        ln = self.len[at].astype(np.int64)
        total = int(ln.sum())
        begin = np.cumsum(ln) - ln
        ids = self.flat[np.repeat(self.start[at] - begin, ln) + np.arange(total)]
        per = X.per_doc(ln, first)
        if marked.any():
            parts = np.split(ids, np.cumsum(per)[:-1])
            for i in np.flatnonzero(marked):
                parts[i] = np.array(self.tok.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, per = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, per


def tokenizing(path: str) -> Tokenizing:
    """The worker's own instance (its cache lives on between tasks)."""
    if path not in _MADE:
        _MADE[path] = Tokenizing(path)
    return _MADE[path]


def with_end(ids: np.ndarray, per: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """An end id after each document."""
    out = np.full(len(ids) + len(per), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(per)), per)] = ids
    return out, per + 1


# ---------------------------------------------------------------- Spark jobs

def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 end: int = END_ID, files: int | None = None) -> DataFrame:
    """Write the files; returns one row per file: (file_no, file, n_docs, n_ids).
    ``files``: how many, else as many as shuffle partitions."""
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = d.withColumn("h", F.xxhash64("text")).repartitionByRange(n, "id", "h").sortWithinPartitions("id", "h")

    def run(batches):
        from pyspark import TaskContext
        from pyarrow import fs
        ctx, writer, n_docs = TaskContext.get(), None, 0
        store, base = fs.FileSystem.from_uri(folder)
        name = f"part-{ctx.partitionId():06d}.s8b"
        temp = f"{base}/.{name}-{ctx.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        tok = tokenizing(tokenizer)
        for batch in batches:
            for part in X.slices(batch, "text"):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(temp)
                    writer = FileWriter(sink)
                writer.add(*with_end(*tok.ids(part.column(1)), end), part.column(0))
                n_docs += part.num_rows
        if writer is None:
            return
        writer.close()
        sink.close()
        store.move(temp, f"{base}/{name}")
        yield pa.RecordBatch.from_arrays([
            pa.array([ctx.partitionId()], pa.int32()), pa.array([name]), pa.array([n_docs], pa.int64()),
            pa.array([writer.ids], pa.int64())], ["file_no", "file", "n_docs", "n_ids"])

    return d.mapInArrow(run, "file_no int, file string, n_docs bigint, n_ids bigint")


def read_tokens(spark: SparkSession, folder: str, listing: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""
    # as many rows as files: a running sum over the listing
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    start = listing.withColumn("before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.s8b").load(folder) \
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    # the listing has a short row per file, as many as the writer had partitions
    joined = raw.join(F.broadcast(start.select("file", "before")), "file").select("before", "content")

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                raw = batch.column(1)[i].as_py()
                _, table, nameless = read_file(raw)
                crc = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in documents_of(raw)]
                names = pa.array(table[:, 0], mask=np.arange(len(table)) < nameless)
                yield pa.RecordBatch.from_arrays([names, pa.array(batch.column(0)[i].as_py() + table[:, 1]), pa.array(table[:, 2]),
                                                  pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
    return joined.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **how) -> DataFrame:
    """Write ``docs`` as token files and report them as read back."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    listing_path = f"{folder}/_listing"
    write_tokens(docs, folder, tokenizer, **how).write.parquet(listing_path)
    return read_tokens(spark, folder, spark.read.parquet(listing_path))
