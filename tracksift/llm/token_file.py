"""Token ids in directly addressable codes (DAC), in binary files.

Every id is split into chunks of CHUNK_BITS; level k holds the k-th chunk of the ids that have one, a
bitmap of which go on to level k + 1, and a rank directory (ones before each RANK_EVERY bits). The i-th
id is read by following ranks from level to level: no block is decoded.

A file, little-endian: magic "DAC1"; uint32 header length; header of uint64 fields (documents, tokens,
levels, then for each level its chunks and the byte offsets of chunks, bitmap and directory); int64
document ids; uint64 token starts (documents + 1, within the file); the levels. Files hold documents in
ascending id order, and file i + 1 goes on where file i ends.

Spark's own text writer puts each file's bytes into the target folder (any Hadoop store, committed
with the task, so a lost executor leaves nothing behind); it ends each file with one newline, which
readers ignore. The binaryFile source reads them back.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracksift.llm import words as W
from tracksift.session import cut, scratch, ship

CHUNK_BITS = 8
RANK_EVERY = 512
END_ID = 2
FILE_TOKENS = 1 << 21
MAGIC = b"DAC1"


class Dac:
    """A view of one file's bytes."""

    def __init__(self, raw: bytes | np.ndarray) -> None:
        raw = np.frombuffer(raw, np.uint8) if isinstance(raw, (bytes, memoryview)) else raw
        if raw[:4].tobytes() != MAGIC:
            raise ValueError("not a DAC file")
        n = int(raw[4:8].view(np.uint32)[0])
        head = raw[8 : 8 + n].copy().view(np.uint64).astype(np.int64)
        self.documents, self.tokens, levels = (int(x) for x in head[:3])
        at = 8 + n
        self.ids = raw[at : at + 8 * self.documents].copy().view(np.int64)
        at += 8 * self.documents
        self.starts = raw[at : at + 8 * (self.documents + 1)].copy().view(np.uint64).astype(np.int64)
        self.levels = []
        for size, chunks, bits, ranks in head[3 : 3 + 4 * levels].reshape(-1, 4):
            n_rank = size // RANK_EVERY + 1
            self.levels.append((int(size), raw[chunks : chunks + size], raw[bits : bits + (size + 7) // 8], raw[ranks : ranks + 8 * n_rank].copy().view(np.uint64).astype(np.int64)))

    def get(self, i: int) -> int:
        """The i-th id of the file."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        out = 0
        for level, (_, chunks, bits, ranks) in enumerate(self.levels):
            out |= int(chunks[i]) << (CHUNK_BITS * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_EVERY
            before = np.unpackbits(bits[block * RANK_EVERY // 8 : (i >> 3) + 1], bitorder="little")[: i - block * RANK_EVERY]
            i = int(ranks[block]) + int(before.sum())
        return out

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out = np.zeros(self.tokens, np.uint32)
        at = np.arange(self.tokens)
        for level, (size, chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(CHUNK_BITS * level)
            at = at[np.unpackbits(bits, count=size, bitorder="little").astype(bool)] if size else at[:0]
        return out


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """A file's bytes, from ids (uint32, document after document)."""
    parts, sizes, rest = [], [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(CHUNK_BITS)
        go = more > 0
        ones = np.zeros(len(rest) // RANK_EVERY + 1, np.uint64)
        sums = np.add.reduceat(go, np.arange(0, len(rest), RANK_EVERY), dtype=np.uint64) if len(rest) else np.zeros(0, np.uint64)
        total = np.cumsum(sums, dtype=np.uint64)
        ones[1:] = total[: len(ones) - 1]
        parts += [(rest & np.uint32((1 << CHUNK_BITS) - 1)).astype(np.uint8).tobytes(), np.packbits(go, bitorder="little").tobytes(), ones.tobytes()]
        sizes.append(len(rest))
        rest = more[go]
        if not len(rest):
            break
    head_bytes = 8 * (3 + 4 * len(sizes))
    at = 8 + head_bytes + 8 * len(doc_ids) + 8 * (len(doc_ids) + 1)
    head, blob = [len(doc_ids), len(ids), len(sizes)], []
    for k, size in enumerate(sizes):
        head.append(size)
        for p in parts[3 * k : 3 * k + 3]:
            head.append(at)
            blob.append(p)
            at += len(p)
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)
    return b"".join([MAGIC, np.uint32(head_bytes).tobytes(), np.array(head, np.uint64).tobytes(), doc_ids.astype(np.int64).tobytes(), starts.tobytes(), *blob])


#: Classes of bytes inside a word: a letter, a digit, another printable ASCII character, anything else.
_LETTER, _DIGIT, _OTHER, _UNSURE = range(4)
_CLASS = np.full(256, _UNSURE, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123)]] = _LETTER
_CLASS[ord("'")] = _UNSURE  # may open a contraction


class WordEncoder:
    """Ids of whole texts, through a cache of the tokenizer's ids for each piece of a word.

    Fit for tokenizers that lower-case, drop white space and part words into runs of letters, single
    digits and runs of other characters: a text's ids are then its pieces' ids, one after another.
    Pieces of ASCII go to the tokenizer's model, pieces with Latin-1 letters to the whole tokenizer.
    Words with any other character, an apostrophe or a special token's text go to it whole. Each piece is
    encoded once while the cache holds it; workers keep their cache from task to task.
    """

    CACHE = 400_000
    AT_ONCE = 2048
    RECENT = 60_000
    _kept: dict[str, WordEncoder] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.known, self.recent = none, none
        self.flat, self.first, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], x: np.ndarray, slot: np.ndarray) -> None:
        keys, slots = table
        if len(keys):
            at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
            hit = keys[at] == x
            slot[hit] = slots[at[hit]]

    @staticmethod
    def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys, slots = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(keys, kind="stable")
        return keys[order], slots[order]

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        tokenize, out, rest = self.tokenizer.model.tokenize, [], []
        for i, p in enumerate(pieces):
            if p.isascii() and (p.isalnum() or b"'" not in p and p.translate(None, _PLAIN) == b"" and b"<|" not in p):
                out.append([t.id for t in tokenize(p.decode().lower())])
            else:
                out.append([])
                rest.append(i)
        if rest:
            for i, x in zip(rest, self.tokenizer.encode_batch([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
                out[i] = x.ids
        return out

    def learn(self, h: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> None:
        raw, sizes, flats = data.tobytes(), [], []
        for lo in range(0, len(h), self.AT_ONCE):  # the library's results are far larger than the ids
            part = slice(lo, lo + self.AT_ONCE)
            got = self.encode([raw[i:j] for i, j in zip(start[part].tolist(), end[part].tolist(), strict=True)])
            sizes.append(np.fromiter(map(len, got), np.int64, len(got)))
            flats.append(np.fromiter((x for ids in got for x in ids), np.uint32, int(sizes[-1].sum())))
        size, flat = np.concatenate(sizes), np.concatenate(flats)
        first = len(self.flat) + np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        slot = np.arange(len(self.first), len(self.first) + len(h))
        self.flat, self.first, self.size = np.concatenate([self.flat, flat]), np.concatenate([self.first, first]), np.concatenate([self.size, size])
        order = np.argsort(h)
        self.recent = self._merged(self.recent, (h[order], slot[order]))
        if len(self.recent[0]) > self.RECENT:
            self.known, self.recent = self._merged(self.known, self.recent), (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def __call__(self, off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block, and how many each row has."""
        start, end = pieces(off, data)
        h = W.span_hash(W.LOWER[data], start, end)
        unique, at, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.first) > self.CACHE:
            self.clear()
        slot = np.full(len(unique), -1, np.int64)
        self._find(self.known, unique, slot)
        self._find(self.recent, unique, slot)
        new = slot < 0
        if new.any():
            slot[new] = np.arange(len(self.first), len(self.first) + int(new.sum()))
            self.learn(unique[new], start[at[new]], end[at[new]], data)
        slot = slot[back]
        size = self.size[slot]
        ids = self.flat[W.ragged(self.first[slot], size)]
        total = np.concatenate([[0], np.cumsum(size)])
        return ids, np.diff(total[np.searchsorted(start, off)])


_PLAIN = bytes(range(33, 127))


def pieces(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the pieces of words: runs of letters, single digits, runs of other characters; unsure words whole."""
    start, end = W.spans(off, data)
    if not len(start):
        return start, end
    kind = _CLASS[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)  # U+00C0 to U+00FF: letters but for the multiplication and division signs
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = _LETTER
    unsure = np.concatenate([[0], np.cumsum((kind == _UNSURE) & ~W.SPACE[data])])
    pipes = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))  # as special tokens open
    whole = unsure[end] > unsure[start]
    whole[np.searchsorted(start, pipes, side="right") - 1] = True
    cut = np.zeros(len(data), bool)
    cut[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    edge = np.zeros(len(data) + 1, np.int8)
    edge[start[~whole]] += 1
    edge[end[~whole]] -= 1
    cut &= np.cumsum(edge[:-1], dtype=np.int8) > 0
    cut[start] = True
    begin = np.flatnonzero(cut)
    # a piece ends where the next begins or its word ends
    word = np.searchsorted(start, begin, side="right") - 1
    stop = np.minimum(np.append(begin[1:], len(data)), end[word])
    return begin, stop


def write(docs: DataFrame, path: str, encoder: Callable[[], Callable], id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Write docs as DAC files below path, and return the manifest: shard, first_id, n_docs, n_tokens, start.

    Rows go to files in ascending id order (equal ids by text; null ids first, held as the least long).
    Null texts are empty: the end id alone. An empty table gives no files. Files hold about file_tokens
    tokens; a longer document is whole, in one file. encoder() makes, on the worker, a function from
    offsets and bytes to ids and their counts by row.
    """
    spark = docs.sparkSession
    ship(spark)
    least = -(1 << 63)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        names: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            name, size = np.concatenate(names), np.concatenate(lengths)
            raw = encode_file(np.concatenate(ids), name, size)
            text = pa.StringArray.from_buffers(1, pa.py_buffer(np.array([0, len(raw)], np.int32)), pa.py_buffer(raw))
            for x in (ids, lengths, names):
                x.clear()
            return pa.record_batch([text], ["value"])

        for batch in batches:
            for lo, hi, off, data in W.blocks(batch.column(1)):
                flat, size = encode(off, data)
                at = np.cumsum(size)
                whole = np.insert(flat, at, end_id).astype(np.uint32)
                ids.append(whole)
                lengths.append(size + 1)
                names.append(batch.column(0).slice(lo, hi - lo).to_numpy(zero_copy_only=False))
                held += len(whole)
                if held >= file_tokens:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    ordered = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(least)).alias("id"), F.col(text_col).alias("text"))
    # as many tasks as the input has, so a task's part doesn't grow with the input
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    ordered = ordered.repartitionByRange(n, "id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(pack, "value string").write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, no, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                d = Dac(np.frombuffer(raw.as_buffer(), np.uint8))
                yield pa.record_batch([[part], [no], [int(d.ids[0])], [d.documents], [d.tokens]], names=["part", "no", "first_id", "n_docs", "n_tokens"])

    schema = "part long, no long, first_id long, n_docs long, n_tokens long"
    manifest = cut(files(spark, path).mapInArrow(heads, schema), "dac-manifest")
    # partition and file number as numbers: their order is the order of ids. Two levels: only one sum a
    # partition is ordered in one place
    earlier = (Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*earlier)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("no").rowsBetween(*earlier)), F.lit(0))
    return manifest.withColumn("inside", inside).join(parts, "part").withColumn("start", (F.col("base") + F.col("inside")).cast("long")).drop("base", "inside")


def files(spark: SparkSession, path: str) -> DataFrame:
    """part and no (the task's and its file's number, from the file's name) and content of the files below path; Spark's empty files are passed over."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 8")
    # part-<partition>-<job>-c<file>.txt
    number = lambda p: F.regexp_extract(F.element_at(F.split("path", "/"), -1), p, 1).cast("long")
    return df.select(number(r"^part-(\d+)-").alias("part"), number(r"-c(\d+)\.txt$").alias("no"), "content")


def read(spark: SparkSession, path: str) -> DataFrame:
    """part, no (see files()), doc_id, start (in the file), n_tokens, ids_crc32 of every document in the files."""
    ship(spark)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, no, raw in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), strict=True):
                d = Dac(np.frombuffer(raw.as_buffer(), np.uint8))
                flat = d.all().astype("<u4")
                crc = [zlib.crc32(flat[i:j]) for i, j in zip(d.starts[:-1], d.starts[1:], strict=True)]
                own = [pa.array(np.full(d.documents, x, np.int64)) for x in (part, no)]
                yield pa.record_batch([*own, pa.array(d.ids), pa.array(d.starts[:-1]), pa.array(np.diff(d.starts)), pa.array(crc, pa.int64())], ["part", "no", "doc_id", "start", "n_tokens", "ids_crc32"])

    return files(spark, path).mapInArrow(unpack, "part long, no long, doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> DataFrame:
    """Write docs with a word tokenizer, read the files back: doc_id, start (over all files), n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = path or scratch(spark, "dac")
    manifest = write(docs, path, lambda: WordEncoder.of(tokenizer_path))
    back = read(spark, path).join(manifest.select("part", "no", F.col("start").alias("base")), ["part", "no"])
    doc_id = F.when(F.col("doc_id") > -(1 << 63), F.col("doc_id"))
    return back.select(doc_id.alias("doc_id"), (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
