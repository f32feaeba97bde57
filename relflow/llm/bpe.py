"""Byte-level BPE by a global shuffle of distinct words.

1. Blocks: a task splits its texts into pre-tokens and numbers the distinct ones of a block of
   bounded bytes.  The exploded pre-tokens stay columnar: one row per block holds, per document,
   the word numbers in order of position; one row per hash bucket holds its distinct words.  The
   blocks are written to the shared folder, so a lost executor repeats no numbering that another
   task already relies on, and the documents' rows stay there while the words travel.
2. The words go to their buckets in one shuffle and are sorted there, so that all occurrences of a
   word are neighbours: each distinct word is encoded once and its ids are merged to every block
   that asked.  The sorts spill, so a bucket may hold any number of words.
3. The ids join their blocks' documents by block number.  The table is bucketed by it, so only the ids
   are shuffled; the documents are reassembled: ids of word number w at each position.
Decoding joins the ids with the token-byte table (one row per id of the fixed vocabulary, so its
broadcast is bounded by the vocabulary file) and puts the bytes end to end.

Defined results: null and empty texts have no tokens; repeated rows and ids are encoded as rows
of their own; an empty table gives none; other columns never enter.
"""

from __future__ import annotations

import base64
import hashlib
import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, small_batches, table, text_of, trimmed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 8 << 20
MOST_BUCKETS = 4_096


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _kind(path: str) -> str:
    """The numbers that hold any id; found by the driver, so that only workers that encode load the merges."""
    return "<u2" if max(load_ranks(path).values()) < 1 << 16 else "<u4"


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging: the adjacent pair of lowest rank, leftmost first, until none is in the table."""
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    if len(word) > 400:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and links, n log n for words of any length."""
    import heapq

    n = len(word)
    part: list = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i):
        j = after[i]
        if j < n and (r := ranks.get(part[i] + part[j])) is not None:
            heapq.heappush(heap, (r, i, part[i], part[j]))

    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if part[i] is not a or j >= n or part[j] is not b:
            continue
        part[i], part[j] = a + b, None
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [ranks[p] for p in part if p is not None]


#: Texts of these characters only are split by the JVM: their letters, numbers and white space are
#: the same in every Unicode version.  All others are split by the pattern as it stands.
_STABLE = r"^[\x00-\u024F]*$"
_SPACES = r"\t-\r\x20\x85\xa0"
_JAVA = rf"'s|'t|'re|'ve|'m|'ll|'d|\x20?\p{{L}}+|\x20?\p{{N}}+|\x20?[^{_SPACES}\p{{L}}\p{{N}}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers as four planes of bytes, which compress better than the numbers."""
    return np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


def _seal(*parts) -> bytes:
    raw = pickle.dumps(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unseal(data: bytes) -> tuple:
    return pickle.loads(pa.decompress(memoryview(data)[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))


_BLOCK = "block long, bucket int, words binary, docs binary"


def blocks(docs: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES, buckets: int = 64) -> DataFrame:
    """Two kinds of rows: (block, bucket, the block's distinct words of that hash bucket), and (block, -1, its
    documents, their words' numbers by position and each number's bucket).  The commonest word is number 0.
    A block is named by its task's partition and its place in there.
    """
    t = text_of(text)
    plain = t.rlike(_STABLE)
    rows = docs.select(F.col(key).alias("doc_id"), F.when(plain, F.regexp_extract_all(t, F.lit(_JAVA), F.lit(0))).alias("words"), F.when(~plain, t).alias("text"), F.octet_length(t).alias("size"))

    def run(batches):
        import public_tokenizers
        import regex
        from pyspark import TaskContext

        from relflow.llm.bpe import _block

        split = regex.compile(public_tokenizers.PATTERN).findall
        first = TaskContext.get().partitionId() << 32
        ids, held, weight, n = [], [], 0, 0
        for batch in batches:
            for lo, hi in runs_of(batch.column("size").to_numpy(zero_copy_only=False), block_bytes >> 2):
                words, others = batch.column("words").slice(lo, hi - lo), batch.column("text").slice(lo, hi - lo)
                if others.null_count < len(others):  # those the JVM left, put in their places
                    more = pa.array([split(t) for t in others.drop_null().to_pylist()], words.type)
                    left = others.is_valid().to_numpy(zero_copy_only=False)
                    words = pa.concat_arrays([words, more]).take(pa.array(np.where(left, len(words) + np.cumsum(left) - 1, np.arange(len(words)))))
                ids.append(batch.column("doc_id").slice(lo, hi - lo))
                held.append(words)
                weight += int(pc.sum(batch.column("size").slice(lo, hi - lo)).as_py() or 0)
                if weight >= block_bytes:
                    yield _block(first + n, pa.concat_arrays(ids), held, buckets)
                    ids, held, weight, n = [], [], 0, n + 1
                    pa.default_memory_pool().release_unused()
        if ids:
            yield _block(first + n, pa.concat_arrays(ids), held, buckets)

    return rows.mapInArrow(trimmed(run), _BLOCK)


def _block(block: int, ids: pa.Array, held: list[pa.Array], buckets: int) -> pa.RecordBatch:
    """The rows of one block; ``held`` are the words of its documents in order, which are used up."""
    sizes = np.concatenate([pc.list_value_length(w).to_numpy(zero_copy_only=False) for w in held]).astype("<i4")
    coded = pa.chunked_array([w.flatten() for w in held], pa.string()).combine_chunks().dictionary_encode()
    held.clear()
    places = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(-np.bincount(places, minlength=len(coded.dictionary)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    listed = coded.dictionary.take(pa.array(order)).cast(pa.string())
    del coded
    home = np.fromiter((zlib.crc32(w.as_py().encode()) % buckets for w in listed), np.int32, len(listed))
    own = _seal(ids, sizes.tobytes(), _planes(rank[places]), _planes(home))
    del places, rank
    there, starts = np.unique(np.sort(home), return_index=True)
    dealt = listed.take(pa.array(np.argsort(home, kind="stable")))
    bounds = [*starts.tolist(), len(dealt)]
    out = [None, *(_seal(*_flat(dealt.slice(at, end - at))) for at, end in zip(bounds, bounds[1:], strict=False))]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(out), block)), pa.array(np.concatenate([[-1], there]).astype(np.int32)), pa.array(out, pa.binary()), pa.array([own, *[None] * (len(out) - 1)], pa.binary())],
        names=["block", "bucket", "words", "docs"],
    )


def _flat(strings: pa.Array) -> tuple[bytes, bytes]:
    """Lengths and bytes of strings."""
    offsets = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]
    data = strings.buffers()[2]
    return _planes(np.diff(offsets)), data.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if data is not None and data.size else b""


def _strings(sizes: bytes, data: bytes) -> list[str]:
    ends = np.concatenate([[0], np.cumsum(_unplanes(sizes))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)).to_pylist()


def runs_of(sizes: np.ndarray, most: int):
    """Row ranges of about ``most`` bytes."""
    lo, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(sizes):
        yield lo, len(sizes)


class Pieces:
    """The ids of single pre-tokens: the tiktoken library's merges where it is installed, else ``merge``."""

    _kept: dict = {}

    def __init__(self, path: str):
        ranks = load_ranks(path)
        try:
            import tiktoken

            self.ids = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        except (ImportError, AttributeError):
            self.ids = lambda word: merge(word, ranks)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._kept:
            cls._kept = {path: cls(path)}
        return cls._kept[path]


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(schema))


def encode_words(asked: DataFrame, path: str) -> DataFrame:
    """block, bucket, ids of its words in order: each distinct word is encoded once for all blocks."""
    kind = _kind(path)
    width = np.dtype(kind).itemsize

    def spread(batches):
        from relflow.llm.bpe import _strings, _unseal

        for batch in batches:
            for block, bucket, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                listed = _strings(*_unseal(words))
                for at in range(0, len(listed), 20_000):
                    part = listed[at : at + 20_000]
                    n = len(part)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.full(n, bucket, np.int32)), pa.array(np.arange(at, at + n, dtype=np.int32)), pa.array(part, pa.string())], names=["block", "bucket", "place", "word"])

    def answer(batches):
        from relflow.llm.bpe import Pieces

        pieces, last, ids = Pieces.of(path), None, b""
        for batch in batches:
            out = []
            for word in batch.column(3).to_pylist():
                if word != last:
                    last, ids = word, np.array(pieces.ids(word.encode()), kind).tobytes()
                out.append(ids)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], names=["block", "bucket", "place", "ids"])

    def bundle(batches):
        from relflow.llm.bpe import _planes, _seal

        owner, held = None, []

        def sealed():
            return pa.RecordBatch.from_arrays([pa.array([owner[0]], pa.int64()), pa.array([owner[1]], pa.int32()), pa.array([_seal(_planes(np.fromiter(map(len, held), np.int64, len(held)) // width), b"".join(held))], pa.binary())], names=["block", "bucket", "ids"])

        for batch in batches:
            block, bucket, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3).to_pylist()
            starts = np.concatenate([[0], np.flatnonzero((block[1:] != block[:-1]) | (bucket[1:] != bucket[:-1])) + 1, [len(block)]])
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if lo == hi:
                    continue
                now = (int(block[lo]), int(bucket[lo]))
                if now != owner and held:
                    yield sealed()
                    held = []
                owner = now
                held += ids[lo:hi]
        if held:
            yield sealed()

    words = asked.repartition("bucket").mapInArrow(trimmed(spread), "block long, bucket int, place int, word string").sortWithinPartitions("word")
    told = words.mapInArrow(trimmed(answer), "block long, bucket int, place int, ids binary").sortWithinPartitions("block", "bucket", "place")
    return told.mapInArrow(trimmed(bundle), "block long, bucket int, ids binary")


def _answered(docs: DataFrame, key: str, text: str, path: str, block_bytes: int) -> DataFrame:
    """docs, ids: one row per block, its documents and the ids of its words."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(parts, MOST_BUCKETS)  # any number is right, as a bucket is sorted rather than held
    with small_batches(docs.sparkSession):
        written = bucketed(blocks(docs, key, text, block_bytes, buckets), "blocks", "block", parts)
    answers = encode_words(written.filter("bucket >= 0").select("block", "bucket", "words"), path)
    # one row per block, whose size bounds it; the table is laid out by block, so the documents stay where they are
    answers = answers.groupBy("block").agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "ids"))), lambda x: x["ids"]).alias("ids"))
    return written.filter("bucket < 0").select("block", "docs").join(answers.hint("shuffle_merge"), "block", "left").select("docs", "ids")


def _reassembling(path: str):
    """The function from the batches of ``_answered`` to those of doc_id, tokens."""
    kind = _kind(path)

    def run(batches):
        from relflow.llm.bpe import _unseal, reassemble

        for batch in batches:
            for docs, ids in zip(*batch.columns, strict=True):
                yield from reassemble([_unseal(x) for x in ids.as_py() or ()], *_unseal(docs.as_py()), kind)

    return run


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, tokens (array<int>): every text's ids."""
    path = path or vocabulary_path()
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("tokens", T.ArrayType(T.IntegerType()))])
    return _answered(docs, key, text, path, block_bytes).mapInArrow(trimmed(_reassembling(path)), schema)


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``decode(encode(docs), digest_only=True)`` in one Python worker a task rather than two: tokens pass between the steps in place."""
    path = path or vocabulary_path()
    spark, assemble = docs.sparkSession, _reassembling(path)
    run, schema = _decoding(token_bytes(spark, path), docs.schema[key].dataType, True)
    return _answered(docs, key, text, path, block_bytes).mapInArrow(trimmed(lambda batches: run(assemble(batches))), schema)


def reassemble(answers: list, ids: pa.Array, counts: bytes, places: bytes, home: bytes, kind: str, step_tokens: int = 400_000):
    """The documents of one block: ids of the word at each position, end to end."""
    counts, places, home = np.frombuffer(counts, "<i4"), _unplanes(places), _unplanes(home)
    dealt = np.concatenate([_unplanes(a[0]) for a in answers] or [np.zeros(0, np.int32)]).astype(np.int64)
    pool = np.frombuffer(b"".join(a[1] for a in answers), kind)
    if len(dealt) != len(home):
        raise ValueError("a block has words without an answer")
    order = np.argsort(home, kind="stable")  # the words' numbers in the order of the answers
    size, begin = np.empty_like(dealt), np.empty_like(dealt)
    size[order], begin[order] = dealt, np.cumsum(dealt) - dealt
    n = size[places]
    ends = np.concatenate([[0], np.cumsum(n)])
    doc_ends = np.concatenate([[0], np.cumsum(counts)])
    lo = 0
    while lo < len(counts):
        hi = max(lo + 1, int(np.searchsorted(doc_ends, doc_ends[lo] + step_tokens, "right")) - 1)
        p0, p1 = doc_ends[lo], doc_ends[hi]
        base = ends[p0]
        flat = np.repeat(begin[places[p0:p1]] - (ends[p0:p1] - base), n[p0:p1]) + np.arange(ends[p1] - base)
        tokens = pa.ListArray.from_arrays(pa.array((ends[doc_ends[lo : hi + 1]] - base).astype(np.int32)), pa.array(pool[flat].astype(np.int32)))
        yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), tokens], names=["doc_id", "tokens"])
        lo = hi


def token_bytes(spark: SparkSession, path: str | None = None) -> DataFrame:
    """token, bytes: the decoding table, one row per id."""
    ranks = load_ranks(path or vocabulary_path())
    return spark.createDataFrame([(i, bytearray(b)) for b, i in ranks.items()], "token int, bytes binary")


def decode(encoded: DataFrame, path: str | None = None, digest_only: bool = False, tokens: DataFrame | None = None) -> DataFrame:
    """The frame with ``decoded`` (binary) or, with ``digest_only``, the SHA-256 of ids and bytes.

    The token-byte table is broadcast, bounded by the vocabulary, and joined by id a batch of documents
    at a time, in the order of their ids.
    """
    run, schema = _decoding(token_bytes(encoded.sparkSession, path) if tokens is None else tokens, encoded.schema["doc_id"].dataType, digest_only)
    return encoded.select("doc_id", "tokens").mapInArrow(trimmed(run), schema)


def _decoding(tokens: DataFrame, kind: T.DataType, digest_only: bool):
    """The function from batches of doc_id (of ``kind``), tokens to those of ``decode``, and their schema."""
    pairs = tokens.toArrow()
    by_id = [b""] * (1 + max(pairs["token"].to_pylist(), default=-1))
    for i, b in zip(pairs["token"].to_pylist(), pairs["bytes"].to_pylist(), strict=True):
        by_id[i] = b
    sent = tokens.sparkSession.sparkContext.broadcast(by_id)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())] if digest_only else [T.StructField("decoded", T.BinaryType())]
    schema = T.StructType([T.StructField("doc_id", kind), *fields])

    def run(batches):
        column = pa.array(sent.value, pa.binary())
        for batch in batches:
            rows = []
            for tokens in batch.column(1):
                ids = tokens.values
                joined = column.take(ids)  # its value buffer is the bytes end to end
                data = joined.buffers()[2].to_pybytes() if len(ids) else b""
                rows.append((len(ids), hashlib.sha256(ids.to_numpy(zero_copy_only=False).astype("<u4").tobytes()).hexdigest(), hashlib.sha256(data).hexdigest()) if digest_only else (data,))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, f.type) for c, f in zip(cols, _arrow(schema)[1:], strict=True))], names=schema.names)

    return run, schema


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
