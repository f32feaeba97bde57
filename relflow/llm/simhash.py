"""SimHash fingerprints and near-duplicate classes over a byte-position inverted index.

A fingerprint is eight bytes.  Two that differ in at most ``max_bits`` = 4 bits differ in at
most four bytes, so they share at least four of the eight positional bytes: the guaranteed
minimum for count filtering.  A posting list per single (position, byte) holds 1/256 of the corpus,
and its pairs grow with the square of it, so postings are kept per three positions and their bytes:
among any four shared positions, one of 20 fixed triples is shared whole.  A posting of many
members is split again into its positional lists by one more position (exact, as a link of the
posting shares four).  Inside a list each pair's shared positional bytes are tallied, pairs under
the minimum are dropped, the rest verified by their differing bits.

Only distinct fingerprints enter the index, in one shuffle of 20 rows each; documents join again
by fingerprint.  A list is compared by vector operations and emits a spanning forest of its
verified links (at most one link less than its members), never all pairs.

Defined results: null text counts as empty; texts without words have fingerprint zero and
link like any other.  Repeated rows and ids share a fingerprint and so a class; a null doc_id is
linked but never names a class unless all of the class are null.  An empty table gives none.
``keep`` tells rows apart by id and text digest, so that of each class exactly one row stays: that
of the smallest id (null last), then of the smallest digest, then that of the first file and row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import anchored, cut, flagged, join_skewed, numbered, small_batches, table, text_of, trimmed
from .components import components

SEED = 42
MAX_BITS = 4
#: Members from which a posting is split into positional lists.
FINE = 512
_CHUNK = 1 << 16
POSITIONS = 8


def cover(positions: int = POSITIONS, shared: int = 4) -> list[tuple[int, ...]]:
    """Triples such that every ``shared``-subset of the positions contains one of them.

    Groups of positions g0, g1, g2 (sizes near a third): all triples inside a group, and two of a
    group with one of the next.  Four positions in three groups always hold such a triple.
    """
    groups = [[p for p in range(positions) if p % 3 == g] for g in range(3)]
    out = {t for g in groups for t in combinations(g, 3)}
    for g in range(3):
        out |= {tuple(sorted((*two, one))) for two in combinations(groups[g], 2) for one in groups[(g + 1) % 3]}
    triples = sorted(out)
    assert all(any(set(t) <= set(s) for t in triples) for s in combinations(range(positions), shared))
    return triples


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The 64-bit SimHash of one text."""
    from xxhash import xxh64_intdigest as h64

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    if len(words) <= shingle:
        hashes = [h64(b" ".join(words), SEED)]
        return _fold(_tally(counts, hashes), 1)
    line = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    a, b = starts[:n].tolist(), ends[shingle - 1 :].tolist()
    for at in range(0, n, _CHUNK):
        hashes = [h64(line[x:y], SEED) for x, y in zip(a[at : at + _CHUNK], b[at : at + _CHUNK], strict=True)]
        _tally(counts, hashes)
    return _fold(counts, n)


def _tally(counts: np.ndarray, hashes: list[int]) -> np.ndarray:
    raw = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    bits = np.unpackbits(raw, axis=1)
    counts += np.add.reduce(bits, axis=0, dtype=np.int64)
    return counts


def _fold(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", extra: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long; and ``extra`` columns as they are."""
    rows = docs.select(F.col(key).alias("doc_id"), text_of(text).alias("__text"), *extra)
    schema = T.StructType([rows.schema[0], T.StructField("fp", T.LongType()), *rows.schema[2:]])

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), *batch.columns[2:]], names=schema.names)

    return rows.mapInArrow(trimmed(run), schema)


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(text_of(text), 256))


def _link_block(fps: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within one posting, by breadth-first search over blocks."""
    left = fps.copy()
    a, b = [], []
    least = POSITIONS - max_bits
    while left.size:
        frontier, left = left[:1], left[1:]
        while frontier.size and left.size:
            hit = np.zeros(left.size, bool)
            source = np.zeros(left.size, np.uint64)
            for f in frontier:
                x = left ^ f
                cand = np.flatnonzero(~hit & (np.count_nonzero(x.view(np.uint8).reshape(-1, 8) == 0, axis=1) >= least))  # tally of shared positional bytes
                ok = cand[np.bitwise_count(x[cand]) <= max_bits]  # verified
                hit[ok] = True
                source[ok] = f
            a += left[hit].tolist()
            b += source[hit].tolist()
            frontier, left = left[hit], left[~hit]
    return a, b


def links(distinct: DataFrame, max_bits: int = MAX_BITS, fine: int = FINE) -> DataFrame:
    """(a, b) signed fingerprints: enough verified links to connect each class of linked fingerprints."""
    triples = cover(POSITIONS, POSITIONS - max_bits)
    assert max_bits == 4, "the cover of triples is made for four differing bits"
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF))
    keys = [sum((byte(p) * F.lit(1 << 8 * i).cast("long") for i, p in enumerate(t)), F.lit(n << 24).cast("long")) for n, t in enumerate(triples)]
    postings = distinct.select("fp", F.explode(F.array(*keys)).alias("posting"))

    def run(batches):
        for key, fps in _postings(batches):
            if fps.size > 1:
                a, b = _link_posting(fps, triples[int(key) >> 24], max_bits, fine)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(a, np.uint64).view(np.int64)), pa.array(np.array(b, np.uint64).view(np.int64))], names=["a", "b"])

    return postings.repartition("posting").sortWithinPartitions("posting", "fp").mapInArrow(trimmed(_bundled(run)), "a long, b long")


def _bundled(run, rows: int = 50_000):
    """The same batches in larger ones, as most postings give one link."""

    def out(batches):
        held, n = [], 0
        for batch in run(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    return out


def _postings(batches):
    """(key, fingerprints) of each posting of a stream sorted by key; columns fp, posting."""
    last, held = None, []
    for batch in batches:
        keys = batch.column(1).to_numpy()
        fps = batch.column(0).to_numpy().view(np.uint64)
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [keys.size]])
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if lo == hi:
                continue
            if keys[lo] != last and held:
                yield last, held[0] if len(held) == 1 else np.concatenate(held)
                held = []
            last = keys[lo]
            held.append(fps[lo:hi])
    if held:
        yield last, held[0] if len(held) == 1 else np.concatenate(held)


def _link_posting(fps: np.ndarray, triple: tuple[int, ...], max_bits: int, fine: int) -> tuple[list[int], list[int]]:
    """A spanning forest of a posting's links.  Over ``fine`` members, by its positional lists.

    A pair of the posting shares the triple, so to reach the least number of shared positions it shares
    one more: its positional lists (position and byte) hold every link, each 1/256 of the posting.
    """
    if fps.size == 2:
        x = int(fps[0] ^ fps[1])
        shared = sum((x >> 8 * p) & 0xFF == 0 for p in range(POSITIONS))
        ok = shared >= POSITIONS - max_bits and x.bit_count() <= max_bits
        return ([int(fps[0])], [int(fps[1])]) if ok else ([], [])
    if fps.size <= fine:
        return _link_block(fps, max_bits)
    a, b = [], []
    for p in range(POSITIONS):
        if p in triple:
            continue
        own = (fps >> np.uint64(8 * p)).astype(np.uint8)
        order = np.argsort(own, kind="stable")
        for part in np.split(fps[order], np.flatnonzero(np.diff(own[order])) + 1):
            x, y = _link_block(part, max_bits) if part.size > 1 else ((), ())
            a += x
            b += y
    return a, b


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable) for every row."""
    with small_batches(docs.sparkSession):
        fps = cut(fingerprints(docs, key, text), "fingerprints")
    return _with_least(fps, F.col("doc_id"), max_bits).withColumnRenamed("least", "component_id")


def _with_least(fps: DataFrame, value: Column, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``fps`` with ``least``, the smallest ``value`` of their class."""
    nodes = cut(fps.groupBy("fp").agg(F.min(value).alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    roots = components(links(nodes.select("fp"), max_bits))
    named = cut(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("w"))
    where = cut(join_skewed(named, least, ["root"], "w", named.count()).select("fp", "n", "least"), "classes")
    return join_skewed(fps, where, ["fp"], "n", fps.count())


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, that with the smallest id (null last); columns unchanged, no text shuffled."""
    own, key, text = numbered(docs, key, text)
    rows = anchored(own)
    at = (F.col("__file"), F.col("__row"))
    with small_batches(docs.sparkSession):
        fps = cut(fingerprints(rows, key, text, (_digest(text).alias("digest"), *at)), "fingerprints")
    least = _with_least(fps, F.struct(F.col("doc_id").isNull().alias("void"), "doc_id", "digest", *at))
    first = (at[0] == F.col("least.__file")) & (at[1] == F.col("least.__row"))
    return flagged(rows, least.filter(~first)).filter("not __hit").select(*own.columns).toDF(*docs.columns)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = classes(table(spark, sf_dir, "documents"))
    return c.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
