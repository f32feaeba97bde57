"""Best-fit packing of tokenised documents with bound-certified repacking.

1. Tokenise: each text becomes the word tokenizer's ids and id 1; documents over the length of
   a sequence are cut into full pieces and a rest.  White space separates tokens of this
   vocabulary and is dropped, so a text's ids are those of its pieces (letters, single digits,
   other signs) end to end.  A batch is lower-cased and cut by vector operations over its bytes;
   each distinct piece is encoded once per batch and kept in a bounded per-worker cache.
2. Pack: pieces are dealt by hash over packing parts of about ``PART_TOKENS`` tokens (so a part
   fits one task at any corpus size) and each part runs best-fit decreasing.
3. Certify: dual feasible functions bound each part's bin count from below.  A part whose count
   equals its bound is optimal by itself and gives up only its least filled bin; a part with a
   gap gives up every bin with room.  The documents of those bins are exchanged: dealt anew over
   at most half as many parts and packed again, until one part is left (so as many rounds as the
   number of parts has binary digits, each over what the last left loose).  ``certificate`` gives the
   bins used and the bound over all pieces.

Only the slim piece rows (no texts or ids) are shuffled.  Defined results: null and empty texts
are one piece holding id 1; repeated rows and ids are packed as rows of their own; an empty
table gives no pieces; other columns never enter.
"""

from __future__ import annotations

import bisect
import re
import zlib
from itertools import count, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, small_batches, table, text_of, trimmed

CAPACITY = 4096
END = 1
VOCABULARY = "word_bpe_49k.json"
PART_TOKENS = 4_096 * 4_096
_CACHE_ENTRIES = 200_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Runs of these characters (ASCII, Latin-1 letters) lower-case one to one, have no other normal
#: form, and fall into pieces by the vocabulary's own rule, which is fixed.
_PLAIN = re.compile("[!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


class Encoder:
    """Whole texts to ids, a batch at a time; equal to the tokenizer run on each text."""

    _kept: dict = {}

    def __init__(self, path: str, entries: int = _CACHE_ENTRIES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # the ids that end a piece
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.entries = entries
        self._keep([], np.zeros(0, np.int64), np.zeros(0, np.uint32))

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept = {path: cls(path)}
        return cls._kept[path]

    def _keep(self, names: list[str], sizes: np.ndarray, pool: np.ndarray) -> None:
        """These are the known pieces: their numbers by name, their ids end to end."""
        self.known = dict(zip(names, range(len(names)), strict=True))
        self.sizes, self.starts, self.pool = sizes, np.cumsum(sizes) - sizes, pool

    def _split(self, run: str) -> list[str]:
        if not _PLAIN.fullmatch(run) or "<|" in run and any(t in run for t in self.special):
            return [run]
        return _PIECE.findall(run.lower())

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of texts, each by itself."""
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(map(len, got), np.int64, len(got)), np.array([i for x in got for i in x], np.uint32)

    def _new(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of plain pieces: encoded with spaces between, and told apart by the ids that end a piece."""
        sizes, pool = [], []
        for at in range(0, len(pieces), 2_000):
            part = pieces[at : at + 2_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part) or ends[-1] != len(ids):
                n, ids = self._each(part)
            else:
                n = np.diff(ends, prepend=0)
            sizes.append(n)
            pool.append(ids)
        return np.concatenate(sizes), np.concatenate(pool)

    def _new_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of odd runs."""
        split = [self._split(r) for r in runs]
        own = list(dict.fromkeys(p for parts in split for p in parts))
        sizes, pool = self._each(own)
        have = dict(zip(own, np.split(pool, np.cumsum(sizes)[:-1]), strict=True))
        found = [np.concatenate([have[p] for p in parts]) for parts in split]
        return np.fromiter(map(len, found), np.int64, len(found)), np.concatenate(found)

    def _numbers(self, names: list[str], odd: np.ndarray) -> np.ndarray:
        """The numbers of different pieces and odd runs among the known ones, to which the new are added.

        Beyond ``entries`` only these ones stay known, so a batch costs no more than what it holds.
        """
        out = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        missing = out < 0
        for which, encode in ((np.flatnonzero(missing & ~odd), self._new), (np.flatnonzero(missing & odd), self._new_runs)):
            if not which.size:
                continue
            own = [names[i] for i in which.tolist()]
            sizes, ids = encode(own)
            first = len(self.sizes)
            self.known.update(zip(own, range(first, first + len(own)), strict=True))
            self.starts = np.concatenate([self.starts, self.pool.size + np.cumsum(sizes) - sizes])
            self.sizes, self.pool = np.concatenate([self.sizes, sizes]), np.concatenate([self.pool, ids])
            out[which] = np.arange(first, first + len(own))
        if len(self.known) > self.entries:
            sizes = self.sizes[out]
            self._keep(names, sizes, self.pool[_ranges(self.starts[out], sizes)])
            out = np.arange(len(names))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids end to end, offsets of the texts)."""
        coded, whole, before = _cut(texts)
        if not len(coded):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        place = coded.indices.to_numpy(zero_copy_only=False)
        odd = np.zeros(len(coded.dictionary), bool)  # no odd run is also a piece of a plain one
        odd[place[whole]] = True
        numbers = self._numbers(coded.dictionary.to_pylist(), odd)[place]
        sizes = self.sizes[numbers]
        return self.pool[_ranges(self.starts[numbers], sizes)], np.concatenate([[0], np.cumsum(sizes)])[before]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, ``sizes`` of each, end to end."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(out.size)
    return out


#: Kinds of bytes: white space, letters, digits (pieces by themselves), others, and those no plain run has.
_WHITE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[33:127] = _OTHER
_KIND[[32, *range(9, 14)]] = _WHITE
_KIND[48:58] = _DIGIT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND[65:91] = _KIND[97:123] = _LETTER


def _cut(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The pieces of all white-space runs, coded; the numbers of those that are whole odd runs; pieces before each text.

    A run is odd if it is not plain or may hold a contraction or a special token: it stays whole and as it is.
    All others are lower-cased and cut where the kind of character changes and at every digit.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(bounds[0]), int(bounds[-1])) if len(texts) else (0, 0)
    if first == last:
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[first:last]
    bounds = bounds - first
    kind, low = _KIND[data], _LOWER[data]
    lead = np.flatnonzero(data == 0xC3)  # of the letters from U+00C0 to U+00FF and two signs
    if lead.size:
        then = data[lead + 1]
        letter = (then != 0x97) & (then != 0xB7)
        lead, then = lead[letter], then[letter]
        kind[lead] = kind[lead + 1] = _LETTER
        low[lead + 1] = np.where(then < 0x9F, then + 0x20, then)
    ink = kind != _WHITE
    begin = np.zeros(data.size, bool)  # of texts
    begin[bounds[:-1][bounds[:-1] < data.size]] = True
    start = kind == _DIGIT
    start[0] = True
    start[1:] |= kind[1:] != kind[:-1]
    start |= begin
    start &= ink
    near = data[1:]
    odd = np.unique(np.concatenate([np.flatnonzero(kind == _ODD), *(i[on(near[i])] for i, on in ((np.flatnonzero(data[:-1] == 39), lambda x: _KIND[x] == _LETTER), (np.flatnonzero(data[:-1] == 60), lambda x: x == 124)))]))
    whole = odd[:0]
    if odd.size:
        opens = ink.copy()
        opens[1:] &= begin[1:] | ~ink[:-1]
        opens = np.flatnonzero(opens)
        own = np.unique(np.searchsorted(opens, odd, "right") - 1)
        # a run goes on to the next white space or text
        stop = np.flatnonzero(begin | ~ink)
        whole = opens[own]
        after = np.append(stop, data.size)[np.searchsorted(stop, whole, "right")]
        size = after - whole
        inside = _ranges(whole, size)
        start[inside] = False
        start[whole] = True
        low[inside] = data[inside]
    at = np.flatnonzero(start)
    before, whole = np.searchsorted(at, bounds), np.searchsorted(at, whole)
    del at, begin, data, kind
    low, start = low[ink], np.flatnonzero(start[ink])
    coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(np.append(start, low.size)), pa.py_buffer(low)).dictionary_encode()
    return coded, whole, before


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece."""
    path = path or vocabulary_path()
    schema = T.StructType([T.StructField("doc_id", docs.schema[key].dataType), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from relflow.llm.packing import Encoder

        encoder = Encoder.of(path)
        for batch in batches:
            rows = batch.num_rows
            owner, piece, start, length, crc = [], [], [], [], []
            for lo, hi in spans(batch.column(1)):
                ids, bounds = encoder.encode(batch.column(1).slice(lo, hi - lo))
                for i in range(lo, hi):
                    own = np.append(ids[bounds[i - lo] : bounds[i - lo + 1]], np.uint32(end)).astype("<u4")
                    for p, at in enumerate(range(0, own.size, capacity)):
                        part = own[at : at + capacity]
                        owner.append(i)
                        piece.append(p)
                        start.append(at)
                        length.append(part.size)
                        crc.append(zlib.crc32(part))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).alias("doc_id"), text_of(text).alias("text")).mapInArrow(trimmed(run), schema)


def spans(texts: pa.Array, most: int = 8 << 20):
    """Row ranges of about ``most`` bytes: what is worked on at once stays bounded by the longest text."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    lo, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield lo, i
            lo, held = i, 0
        held += int(n)
    if lo < len(sizes):
        yield lo, len(sizes)


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin, offset) of each length, and the fill of each bin."""
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(lengths.size, np.int64)
    offsets = np.empty(lengths.size, np.int64)
    fill: list[int] = []
    open_by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # ascending, the rooms that some bin has
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        at = bisect.bisect_left(rooms, n)
        if at == len(rooms):
            b = len(fill)
            fill.append(0)
            room = capacity
        else:
            room = rooms[at]
            own = open_by_room[room]
            b = own.pop()
            if not own:
                del open_by_room[room]
                rooms.pop(at)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        room -= n
        if room:
            if room not in open_by_room:
                open_by_room[room] = []
                bisect.insort(rooms, room)
            open_by_room[room].append(b)
    return bins, offsets, np.array(fill, np.int64)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The largest bound that two families of dual feasible functions give on the bins needed.

    f_k drops items of at most k, counts those over capacity - k as whole bins and the rest by
    size; u_j rounds (j + 1) x / capacity down to whole j-ths except where it is whole already.
    """
    return bound_of(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def bound_of(counts: np.ndarray, capacity: int = CAPACITY) -> int:
    """``lower_bound`` from the number of pieces of each length."""
    sizes = np.arange(capacity + 1)
    mass = np.cumsum(counts * sizes)
    many = np.cumsum(counts)
    best = -(-int(mass[-1]) // capacity)
    k = np.arange(capacity // 2 + 1)
    whole = many[-1] - many[capacity - k]
    middle = mass[capacity - k] - np.where(k > 0, mass[np.maximum(k - 1, 0)], 0)
    best = max(best, int((whole + -(-middle // capacity)).max()))
    for j in range(1, 65):
        x = (j + 1) * sizes
        u = np.where(x % capacity == 0, sizes * j, (x // capacity) * capacity)  # in j-ths of the capacity
        best = max(best, -(-int((counts * u).sum()) // (j * capacity)))
    return best


_PACKED = "doc_id {key}, piece int, start long, length long, ids_crc32 long, uid long, part long, bin long, offset long, loose boolean"


def _pack_part(df: pd.DataFrame, capacity: int) -> pd.DataFrame:
    lengths = df["length"].to_numpy()
    bins, offsets, fill = best_fit(lengths, capacity)
    loose = np.zeros(fill.size, bool)
    if fill.size > lower_bound(lengths, capacity):  # not certified: every bin with room is open to exchange
        loose = fill < capacity
    least = int(fill.argmin())
    loose[least] = fill[least] < capacity  # a certified part may still share its one slack bin with others
    return df.assign(bin=bins, offset=offsets, loose=loose[bins])


def _pack(rows: DataFrame, parts: int, key_type: str, capacity: int, salt: int) -> DataFrame:
    dealt = rows.withColumn("part", F.pmod(F.xxhash64(F.lit(salt), "uid"), F.lit(parts)).cast("long"))
    return dealt.groupBy("part").applyInPandas(lambda df: _pack_part(df, capacity), _PACKED.format(key=key_type))


def pack(found: DataFrame, capacity: int = CAPACITY, part_tokens: int = PART_TOKENS) -> DataFrame:
    """pieces -> pieces with sequence_id and offset."""
    # the number tells repeated rows apart, so that they are dealt over all parts
    with small_batches(found.sparkSession):
        found = cut(found.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    key_type = found.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    tokens = found.filter(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    full = found.filter(F.col("length") >= capacity).select(*names, F.lit(0).alias("round"), F.lit(-1).cast("long").alias("part"), F.col("uid").alias("bin"), F.lit(0).cast("long").alias("offset"))
    done = [full]
    rest = found.filter(F.col("length") < capacity)
    parts = max(1, -(-tokens // part_tokens))
    for n in count(1):
        packed = cut(_pack(rest.select(*names, "uid"), int(parts), key_type, capacity, n), "packed")
        keep = lambda df, n=n: df.select(*names, F.lit(n).alias("round"), "part", "bin", "offset")
        if parts == 1:
            done.append(keep(packed))
            break
        done.append(keep(packed.filter("not loose")))
        rest = packed.filter("loose")
        left = rest.agg(F.sum("length")).first()[0] or 0
        parts = min(max(1, -(-left // part_tokens)), parts // 2)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    # any distinct numbers: the round in the top bits, the part and the bin below
    number = F.when(F.col("round") == 0, F.col("bin")).otherwise(-(F.col("round").cast("long") * F.lit(1 << 58) + F.col("part") * F.lit(1 << 24) + F.col("bin") + 1))
    return out.select(*names, number.alias("sequence_id"), "offset")


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """bins used, the least number that any packing of all pieces needs, and the gap between them."""
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in packed.groupBy("length").count().collect():  # a row per length at most
        counts[length] = n
    bins, bound = packed.filter("offset = 0").count(), bound_of(counts, capacity)
    return {"bins": bins, "bound": bound, "gap": bins - bound}


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"))).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
