"""Byte-level BPE by a global shuffle of distinct words.

Texts are cut into pre-tokens in numpy. A block of texts becomes its distinct
words and, for each position, a word's number; only these packed columns are
shuffled. The words of all blocks meet by hash bucket, where each distinct word
is encoded once; ids go back to the blocks, and texts are put together again by
position. Decoding joins ids with the token-byte table, whose size is that of
the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from halocline.llm import text as X

#: Bytes of text in a block (a larger text comes alone), tokens in an Arrow batch of results.
BLOCK_BYTES, BATCH_TOKENS = 8 << 20, 1 << 18
#: Bytes whose pre-tokens one numpy pass finds.
PASS_BYTES = 512 << 10
#: Bytes of text for each bucket of words and each partition of blocks; the number of buckets stays below what a block can have rows for.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS, MOST_PARTITIONS = 8 << 20, 8, 1 << 15, 1 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)
_classes: list[np.ndarray] = []


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def class_table() -> np.ndarray:
    """The kind of every code point, by the tokenizer library's own character classes: what its pattern \\p{L}, \\p{N} or \\s finds."""
    if not _classes:
        every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
        single = {bytes([i]): i for i in range(256)}
        table = np.full(0x110000, OTHER, np.uint8)
        for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", SPACE)):
            found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={}).encode_ordinary(every)
            table[np.frombuffer(bytes(found).decode().encode("utf-32-le"), np.uint32)] = kind
        _classes.append(table)
    return _classes[0]


def code_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the UTF-8 sequences that start at ``at``."""
    out = data[at].astype(np.int32)
    long = np.flatnonzero(out >= 0x80)
    if len(long):
        lead, p = out[long], at[long]
        size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
        code = lead & np.array([0, 0, 0x1F, 0x0F, 0x07], np.int32)[size]
        for k in range(1, 4):
            more = size > k
            code[more] = code[more] << 6 | (data[p[more] + k] & 0x3F)
        out[long] = code
    return out


def pretoken_starts(data: np.ndarray, off: np.ndarray, kinds: np.ndarray | None = None) -> np.ndarray:
    """Byte offsets at which pre-tokens start; they tile every document of the block.

    Runs of letters, numbers, others and white space are tokens; a single space
    goes with what follows it, the last of several white spaces stands alone
    otherwise, and a lone apostrophe not after a space takes s, t, m, d, re, ve
    or ll from the letters after it.
    """
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(at):
        return at
    code = code_points(data, at)
    kind = (class_table() if kinds is None else kinds)[code]
    n = len(at)
    heads = np.searchsorted(at, off[:-1][off[:-1] < off[1:]])
    head = np.zeros(n + 1, bool)
    head[heads] = True
    head[n] = True
    run = head.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    blank = np.zeros(n + 1, bool)  # whether the character before, in the same document, is a space
    blank[1:n] = (code[:-1] == 0x20) & ~head[1:n]
    solid = np.append(kind != SPACE, False)
    start = run & ~(solid & blank)
    last = np.flatnonzero(run[1:] & ~head[1:] & (kind == SPACE))  # of a run of white space that something follows
    start[last] = True

    lone = np.flatnonzero(run[:n] & run[1:] & (code == 0x27) & ~blank[:n])
    lone = lone[(lone + 1 < n)]
    lone = lone[(kind[lone + 1] == LETTER) & ~head[lone + 1]]
    if len(lone):
        c1 = code[lone + 1]
        c2 = np.where((lone + 2 < n) & ~head[np.minimum(lone + 2, n)], code[np.minimum(lone + 2, n - 1)], 0)
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) | (c1 == ord("v"))) & (c2 == ord("e")) | (c1 == ord("l")) & (c2 == ord("l"))
        taken = lone[one | two]
        start[taken + 1] = False
        rest = taken + np.where(one, 2, 3)[one | two]
        start[rest[rest < n]] = True
    return at[start[:n]]


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


class Block:
    """The distinct words of a block, by bucket, and the numbers of its words in order."""

    def __init__(self, ids: list[pa.Array], parts: list[pa.Array], lengths: list[np.ndarray], buckets: int):
        """parts: the pre-tokens, dictionary-encoded; lengths: how many each document has."""
        self.doc_ids, self.lengths = pa.concat_arrays(ids), np.concatenate(lengths)
        coded = pa.chunked_array(parts).unify_dictionaries().combine_chunks()
        coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
        numbers = coded.indices.to_numpy(zero_copy_only=False)
        raw, edges = X.buffers(coded.dictionary)
        hashes = X.segment_hashes(raw, edges[:-1], edges[1:])
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rest = np.empty(len(order), np.int32)
        self.words, self.bucket, self.check = coded.dictionary.take(pa.array(order)), bucket[order], int(np.bitwise_xor.reduce(hashes)) if len(hashes) else 0
        # positions hold frequency ranks (small numbers compress well), ``places`` their words by bucket
        often = np.argsort(-np.bincount(numbers, minlength=len(order)), kind="stable") if len(order) else order
        rank, place = rest, np.empty(len(order), np.int32)
        rank[often] = np.arange(len(often), dtype=np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.ranks, self.places = rank[numbers] if len(numbers) else rank, place[often]


def block_stream(batches: Iterator[pa.RecordBatch], buckets: int, most: int, kinds: np.ndarray | None = None) -> Iterator[tuple[int, Block]]:
    """(block id, block): rows in order, cut by bytes; the same rows in the same order give the same blocks."""
    ids, parts, lengths, held, number = [], [], [], 0, None
    for batch, data, off in X.blocks(batches, most=min(most, PASS_BYTES)):
        number = batch.column(2)[0].as_py() << 24 if number is None else number
        if ids and held + len(data) > most:
            yield number, Block(ids, parts, lengths, buckets)
            ids, parts, lengths, held, number = [], [], [], 0, number + 1
        starts = pretoken_starts(data, off, kinds)
        ids.append(batch.column(0))
        parts.append(_binary(data, np.append(starts, len(data))).dictionary_encode())
        lengths.append(np.diff(np.append(np.searchsorted(starts, off[:-1]), len(starts))))
        held += len(data)
    if ids:
        yield number, Block(ids, parts, lengths, buckets)
    ids = parts = lengths = batch = data = None
    X.release()


def _planes(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].T).tobytes()


def _unplanes(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 4), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
    return out.view("<u4").ravel().view(np.int32)


def _pack(*parts: bytes) -> bytes:
    sizes = np.array([len(parts), *map(len, parts)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=3).compress(sizes + b"".join(parts))


def _unpack(raw: bytes) -> list[bytes]:
    body = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(body, "<i8", 1)[0])
    ends = np.cumsum(np.append(8 * (n + 1), np.frombuffer(body, "<i8", n, 8)))
    return [body[a:b] for a, b in zip(ends[:-1], ends[1:])]


ROWS = "block long, bucket int, packed binary"
#: The bucket of the row with a block's positions; it sorts after the words.
POSITIONS = 2**31 - 1


def _row(block: int, bucket: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([packed], pa.binary())], names=["block", "bucket", "packed"])


def encode(docs: DataFrame, ranks: dict[bytes, int], doc_id: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids array<int>) of every row: what tiktoken's encode_ordinary gives for these ranks and the
    pattern that pretoken_starts() stands for.

    Null and empty texts have no ids; repeated rows are encoded alike, each for
    itself; null doc_ids stay; an empty table gives no row; other columns are
    not read; a very long text is a block of its own. ``docs`` is read three
    times (for its size, words and positions) and must give the same rows in the same
    order for each partition (a scan does; write other plans out first): if it
    doesn't, the words of a block no longer match its positions, which is
    noticed and raised.
    """
    spark = docs.sparkSession
    X.small_batches(spark)
    # spark_partition_id() counts the partitions of docs itself, also where a union makes others of a task's
    rows = docs.selectExpr(f"cast(`{doc_id}` as long) doc_id", f"`{text}` text", "cast(spark_partition_id() as long) part")
    size = docs.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    partitions = min(max(-(-size // BUCKET_BYTES), LEAST_BUCKETS), MOST_PARTITIONS)
    buckets = min(partitions, MOST_BUCKETS)
    vocabulary = spark.sparkContext.broadcast(ranks)
    kinds = spark.sparkContext.broadcast(class_table())

    def word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in block_stream(batches, buckets, block_bytes, kinds.value):
            raw, edges = X.buffers(block.words)
            cuts = np.searchsorted(block.bucket, np.arange(buckets + 1))
            for k in np.flatnonzero(np.diff(cuts)):
                low, high = cuts[k], cuts[k + 1]
                yield _row(number, int(k), _pack(np.diff(edges[low : high + 1]).astype("<u4").tobytes(), raw[edges[low] : edges[high]].tobytes()))

    def position_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, block in block_stream(batches, buckets, block_bytes, kinds.value):
            n = len(block.places)
            width = max(1, (max(n - 1, 0).bit_length() + 7) // 8)
            known = block.doc_ids.is_null().to_numpy(zero_copy_only=False)
            ids = pc.fill_null(block.doc_ids, 0).to_numpy(zero_copy_only=False)
            head = np.array([n, width, len(ids)], "<i8").tobytes() + np.array([block.check], "<u8").tobytes()
            yield _row(number, POSITIONS, _pack(head, ids.astype("<i8").tobytes(), known.tobytes(), block.lengths.astype("<i8").tobytes(), _planes(block.places, width), _planes(block.ranks, width)))

    def encode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tiktoken.Encoding("own", pat_str="(?s:.+)", mergeable_ranks=vocabulary.value, special_tokens={})
        now, cache = None, {}
        for batch in batches:
            for number, bucket, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    now, cache = bucket, {}
                sizes, raw = _unpack(packed)
                edges = np.append(0, np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)))
                listed = edges.tolist()
                got = []
                for a, b in zip(listed[:-1], listed[1:]):
                    word = raw[a:b]
                    ids = cache.get(word)
                    if ids is None:
                        ids = cache[word] = coder._encode_single_piece(word)
                    got.append(ids)
                check = int(np.bitwise_xor.reduce(X.segment_hashes(np.frombuffer(raw, np.uint8), edges[:-1], edges[1:])))
                counts = np.fromiter(map(len, got), np.int64, len(got))
                flat = np.fromiter((i for ids in got for i in ids), np.int64, int(counts.sum()))
                yield _row(number, bucket, _pack(np.array([check], "<u8").tobytes(), _planes(counts, 4), _planes(flat, 4)))
        cache = coder = got = None
        X.release()

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, flats, check = None, [], [], 0
        for batch in batches:
            for number, bucket, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if number != now:
                    now, counts, flats, check = number, [], [], 0
                if bucket != POSITIONS:
                    mark, c, f = _unpack(packed)
                    check ^= int(np.frombuffer(mark, "<u8")[0])
                    counts.append(_unplanes(c, 4))
                    flats.append(_unplanes(f, 4))
                    continue
                head, ids, known, lengths, places, ranks_ = _unpack(packed)
                n, width, _ = (int(x) for x in np.frombuffer(head, "<i8", 3))
                each = np.concatenate(counts) if counts else np.zeros(0, np.int64)
                if len(each) != n or check != int(np.frombuffer(head, "<u8", 1, 24)[0]):
                    raise RuntimeError("a block's words and positions differ: the input changed between two reads")
                flat = np.concatenate(flats) if flats else np.zeros(0, np.int32)
                words = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(each, dtype=np.int64))), pa.array(flat)).take(pa.array(_unplanes(places, width)))
                order, edges = _unplanes(ranks_, width), np.append(0, np.cumsum(np.frombuffer(lengths, "<i8")))
                keys = pa.array(np.frombuffer(ids, "<i8"), mask=np.frombuffer(known, bool))
                at = 0
                while at < len(keys):
                    to = max(at + 1, int(np.searchsorted(edges, edges[at] + BATCH_TOKENS // 2, "right")) - 1)
                    part = words.take(pa.array(order[edges[at] : edges[to]]))
                    ends = part.offsets.to_numpy()[edges[at : to + 1] - edges[at]]
                    yield pa.RecordBatch.from_arrays([keys.slice(at, to - at), pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), part.flatten())], names=["doc_id", "ids"])
                    at = to
                words = part = flat = each = order = None
        X.release()

    words = rows.mapInArrow(word_rows, ROWS).repartition(buckets, "bucket").sortWithinPartitions("bucket", "block").mapInArrow(encode_rows, ROWS)
    both = words.union(rows.mapInArrow(position_rows, ROWS))
    return both.repartition(partitions, "block").sortWithinPartitions("block", "bucket").mapInArrow(put_together, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, ids, bytes): each row's ids looked up in the token-byte table and put end to end. No ids: empty; null ids: null; an id outside the table raises."""
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    table = encoded.sparkSession.sparkContext.broadcast(tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = pa.array(table.value, pa.large_binary())
        for batch in batches:
            ids = batch.column(1)
            n = batch.num_rows
            lists = ids.cast(pa.large_list(pa.int32()))
            edges = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)))
            data, off = X.buffers(column.take(lists.flatten()))
            whole = _binary(data, off[edges]).cast(pa.binary())
            if ids.null_count:
                whole = pc.if_else(ids.is_null(), pa.scalar(None, pa.binary()), whole)
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, whole], names=["doc_id", "ids", "bytes"]) if n else batch
        column = ids = lists = data = whole = batch = None
        X.release()

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
