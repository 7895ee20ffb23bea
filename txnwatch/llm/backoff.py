"""Stupid-backoff language-model scores of documents, from counts over the whole corpus.

Brants et al., "Large Language Models in Machine Translation", 2007: a word after a history has
the score count(history word) / count(history) if the n-gram was seen; else ``alpha`` times that
of the history without its first word; a word alone count(word) / words. Counts leave the scored
document out, so a text is not judged by itself and backing off takes place. A word seen nowhere
else scores as if seen once in one word more than the rest of the corpus has.

Texts become chunks of at most some 24 MB with their words as numbers, which are shuffled once.
Most n-grams are in one chunk only, which then knows their counts; only the others are counted
together. To tell them, each chunk sends the leading bits of its n-grams' hashes, about a byte
each, and hears which of them other chunks have too: all that are shared and a few that just look
like it. Those are partitioned by hash, a row per chunk and bucket that is exploded behind the
exchange; there a window over each n-gram adds the total of its counts to its rows, which tells
its chunks what the others have (of all other n-grams the chunk's own count is the total). Log
scores are then summed per document. Chunks are bounded, whatever a source or a document's copies
hold of the rows; a single text longer than a chunk is a chunk of its own. N-grams are 64-bit
hashes of their words.

Scores are summed as whole millionths, so the result doesn't depend on the order of anything.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnwatch.llm.tables import buckets, word_count

CHUNK, ALPHA, UNIT = 24 << 20, 0.4, 1_000_000
STATE = "chunk long, state binary"
SKETCH = "bucket int, chunk long, cells binary"
MASK = "chunk long, bucket int, mask binary"
GRAMS = "bucket int, chunk long, grams array<long>, counts array<int>"
ANSWERS = "chunk long, bucket int, places binary, totals binary"
#: Words scored at a time, and rows packed at a time.
BLOCK = 1 << 20


def _pack(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).view(np.uint8).reshape(-1, array.itemsize).T.tobytes(), 1)


def _unpack(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zlib.decompress(raw), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_steps(array: np.ndarray) -> bytes:
    """Rising numbers by their differences, of which only the low bytes don't compress."""
    steps = np.diff(array.astype(np.uint64), prepend=np.uint64(0))
    kind = np.uint32 if not len(steps) or steps.max() < 1 << 32 else np.uint64
    planes = steps.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T
    head = np.array([len(steps), planes.shape[0]], np.int64).tobytes()
    return b"".join([head, planes[0].tobytes(), zlib.compress(planes[1:].tobytes(), 1)])


def _unpack_steps(raw: bytes) -> np.ndarray:
    n, size = np.frombuffer(raw[:16], np.int64)
    low = np.frombuffer(raw[16 : 16 + n], np.uint8)
    high = np.frombuffer(zlib.decompress(raw[16 + n :]), np.uint8).reshape(size - 1, n)
    planes = np.ascontiguousarray(np.vstack([low[None], high]).T)
    return np.cumsum(planes.view(np.uint32 if size == 4 else np.uint64).ravel(), dtype=np.uint64)


class Places(dict):
    """Words by the order in which they first came."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


def _grams(
    words: np.ndarray, owner: np.ndarray, order: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1 to ``order``: hash of the n-gram that ends at each place, and whether it lies
    within one document."""
    rolled = np.zeros(len(words), np.uint64)
    for n in range(1, order + 1):
        before = np.zeros(len(words), np.uint64)
        before[1:] = rolled[:-1]
        # hash of the history, stirred, and of the word: equal n-grams have equal hashes
        rolled = (before * np.uint64(0x9E3779B97F4A7C15) ^ (before >> np.uint64(31))) + words
        mixed = (rolled ^ rolled >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93 + 2 * n)
        inside = np.zeros(len(words), bool)
        inside[n - 1 :] = owner[n - 1 :] == owner[: len(owner) - n + 1]
        del before
        mixed ^= mixed >> np.uint64(29)
        yield mixed, inside


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[bytes]]]:
    """The partition's number, and its documents in lists of about CHUNK bytes of text."""
    ids, texts, size, part = [], [], 0, 0
    for batch in batches:
        keys, column = batch.column(0), batch.column(1)
        part = batch.column(2)[0].as_py() if batch.num_rows else part
        for i in range(batch.num_rows):
            ids.append(keys[i].as_py())
            texts.append(column[i].as_py() or b"")
            size += len(texts[-1])
            if size >= CHUNK:
                yield part, ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield part, ids, texts


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text, partition) to a row per chunk: its documents' ids, sizes and word hashes."""
    for number, (part, ids, texts) in enumerate(_chunks(batches)):
        words, places = Places(), []
        for text in texts:
            split = text.split()
            places.append(np.fromiter(map(words.__getitem__, split), np.uint32, len(split)))
        vocabulary = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        known = np.array([x is not None for x in ids])
        numbers = np.array([0 if x is None else x for x in ids], np.int64)
        sizes = np.array([len(p) for p in places], np.int64)
        packed = [_pack(b) for b in (numbers, known, sizes, vocabulary, np.concatenate(places))]
        head = np.array([len(p) for p in packed], np.int64).tobytes()
        yield pa.RecordBatch.from_arrays(
            [pa.array([part << 32 | number], pa.int64()), pa.array([b"".join([head, *packed])], pa.binary())],
            ["chunk", "state"],
        )


def _open(state: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's document ids, which of them are known, sizes in words, and word hashes."""
    cut = np.concatenate([[40], 40 + np.cumsum(np.frombuffer(state[:40], np.int64))])
    parts = [state[cut[i] : cut[i + 1]] for i in range(5)]
    hashed = _unpack(parts[3], np.uint64)[_unpack(parts[4], np.uint32)]
    known = _unpack(parts[1], np.uint8).astype(bool)
    return _unpack(parts[0], np.int64), known, _unpack(parts[2], np.int64), hashed


def _different(ordered: np.ndarray) -> np.ndarray:
    """The different ones of sorted numbers."""
    first = np.ones(len(ordered), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    return ordered[first]


def _owners(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


class Buckets:
    """N-grams of each length by the leading bits of their hashes: ``2**bits`` buckets, and within
    them cells, eight or more for each word of the corpus. Both follow the corpus' size."""

    def __init__(self, words: int):
        self.bits = max(2, (words >> 19).bit_length())
        self.cell_bits = max(16, (8 * words).bit_length(), self.bits)

    def ends(self, keys: np.ndarray) -> np.ndarray:
        """Where each bucket's n-grams begin and end in the sorted ``keys``."""
        firsts = np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        return np.concatenate([[0], np.searchsorted(keys, firsts), [len(keys)]])

    def cells(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.cell_bits)

    def slices(self, n: int, keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Number, begin and end of each bucket of n-grams of one length that isn't empty."""
        ends = self.ends(keys).tolist()
        for i, (start, end) in enumerate(zip(ends, ends[1:])):
            if end > start:
                yield n << self.bits | i, start, end


def _sketch(order: int, by: Buckets):
    """Arrow function over chunks: for each bucket the cells of the chunk's different n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, state in zip(batch["chunk"].to_pylist(), batch["state"]):
                _, _, sizes, hashed = _open(state.as_py())
                for n, (gram, inside) in enumerate(_grams(hashed, _owners(sizes), order)):
                    keys = _different(np.sort(gram[inside]))
                    cells, rows = by.cells(keys), []
                    for bucket, start, end in by.slices(n, keys):
                        rows.append((bucket, chunk, _pack_steps(cells[start:end])))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([r[0] for r in rows], pa.int32()),
                            pa.array([r[1] for r in rows], pa.int64()),
                            pa.array([r[2] for r in rows], pa.binary()),
                        ],
                        ["bucket", "chunk", "cells"],
                    )

    return run


def _common(sketches: pa.Table) -> pa.Table:
    """For each chunk, which of its n-grams in a bucket share a cell with another chunk's."""
    cells = [_unpack_steps(x.as_py()) for x in sketches["cells"]]
    every = np.sort(np.concatenate([_different(c) for c in cells]))
    both = np.append(every[1:][every[1:] == every[:-1]], np.uint64(0xFFFFFFFFFFFFFFFF))
    masks = [np.packbits(both[np.searchsorted(both, c)] == c).tobytes() for c in cells]
    return pa.table(
        {"chunk": sketches["chunk"], "bucket": sketches["bucket"], "mask": pa.array(masks, pa.binary())}
    )


def _flags(masks: dict[int, bytes], bucket: int, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(masks[bucket], np.uint8), count=size).astype(bool)


def _candidates(order: int, by: Buckets):
    """Arrow function over a chunk and its masks: for each bucket the n-grams that other chunks
    may have too, with their counts here."""

    def run(chunks: pa.Table, masks: pa.Table) -> pa.Table:
        chunk = chunks["chunk"][0].as_py()
        _, _, sizes, hashed = _open(chunks["state"][0].as_py())
        of = dict(zip(masks["bucket"].to_pylist(), masks["mask"].to_pylist()))
        buckets_, grams, counts = [], [], []
        for n, (gram, inside) in enumerate(_grams(hashed, _owners(sizes), order)):
            keys, count = np.unique(gram[inside], return_counts=True)
            for bucket, start, end in by.slices(n, keys):
                flags = _flags(of, bucket, end - start)
                if flags.any():
                    buckets_.append(bucket)
                    grams.append(keys[start:end][flags].view(np.int64))
                    counts.append(count[start:end][flags].astype(np.int32))
        cut = pa.array(np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32))
        return pa.table(
            {
                "bucket": pa.array(buckets_, pa.int32()),
                "chunk": pa.array([chunk] * len(buckets_), pa.int64()),
                "grams": pa.ListArray.from_arrays(cut, np.concatenate([np.zeros(0, np.int64), *grams])),
                "counts": pa.ListArray.from_arrays(cut, np.concatenate([np.zeros(0, np.int32), *counts])),
            }
        )

    return run


def _others(gram, inside, owner, n: int, by: Buckets, masks: dict, totals: dict) -> np.ndarray:
    """Of the n-gram that ends at each place: its count in other documents, 0 for places that
    are not inside."""
    places = np.flatnonzero(inside).astype(np.int32)
    out = np.zeros(len(gram), np.int64)
    if not len(places):
        return out
    # equal n-grams stand together, and those of a document within them
    places = places[np.argsort(gram[places], kind="stable")]
    ordered, own = gram[places], owner[places]
    first = np.ones(len(places), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    keys = ordered[first]
    del ordered
    here = np.diff(np.flatnonzero(first), append=len(places))
    total = here.copy()
    for bucket, start, end in by.slices(n, keys):
        if bucket in totals:
            at = start + np.flatnonzero(_flags(masks, bucket, end - start))
            for where, found in totals[bucket]:
                total[at[_unpack_steps(where)]] = _unpack(found, np.int64)
    out[places] = np.repeat(total, here)
    del total, here, keys
    first[1:] |= own[1:] != own[:-1]
    sizes = np.diff(np.flatnonzero(first), append=len(places))
    out[places] -= np.repeat(sizes, sizes)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, bucket, place, total) to rows of many, by chunk and bucket."""

    def rows(taken: list[pa.RecordBatch]) -> pa.RecordBatch:
        chunk, bucket, place, total = (
            np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in taken]) for i in range(4)
        )
        kinds = _different(np.sort(chunk))
        # rows come sorted by n-gram, so places rise within a chunk's bucket
        at = np.argsort(bucket.astype(np.int64) * len(kinds) + np.searchsorted(kinds, chunk), kind="stable")
        chunk, bucket, place, total = chunk[at], bucket[at], place[at], total[at]
        changes = np.flatnonzero((chunk[1:] != chunk[:-1]) | (bucket[1:] != bucket[:-1])) + 1
        starts = np.concatenate([[0], changes])
        cuts = list(zip(starts.tolist(), [*changes.tolist(), len(chunk)]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(chunk[starts]),
                pa.array(bucket[starts]),
                pa.array([_pack_steps(place[i:j]) for i, j in cuts], pa.binary()),
                pa.array([_pack(total[i:j]) for i, j in cuts], pa.binary()),
            ],
            ["chunk", "bucket", "places", "totals"],
        )

    taken, size = [], 0
    for batch in batches:
        taken.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield rows(taken)
            taken, size = [], 0
    if size:
        yield rows(taken)


def _score(order: int, alpha: float, total: int, by: Buckets):
    """Arrow function over a chunk and what was found of its n-grams: masks, and of the masked
    ones that other chunks have too their places among the masked, and totals."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        numbers, known, sizes, hashed = _open(chunks["state"][0].as_py())
        owner = _owners(sizes)
        masks, totals = {}, {}
        columns = (answers[c].to_pylist() for c in ("bucket", "mask", "places", "totals"))
        for bucket, mask, places, found in zip(*columns):
            if mask is not None:
                masks[bucket] = mask
            else:
                totals.setdefault(bucket, []).append((places, found))
        others, insides = [], []
        for n, (gram, inside) in enumerate(_grams(hashed, owner, order)):
            others.append(_others(gram, inside, owner, n, by, masks, totals))
            insides.append(inside)
        sums, missed = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for at in range(0, len(hashed), BLOCK):
            here = slice(at, at + BLOCK)
            rest = total - sizes[owner[here]]
            count = others[0][here]
            score = np.where(count > 0, count / np.maximum(rest, 1), 1 / (rest + 1.0))
            backed = (count == 0).astype(np.int64)
            for n in range(2, order + 1):
                inside, count = insides[n - 1][here], others[n - 1][here]
                history = others[n - 2][max(at - 1, 0) : at + BLOCK - 1]
                history = history if at else np.concatenate([[0], history])
                history = history[: len(count)]
                seen = inside & (count > 0)
                score = np.where(
                    seen, count / np.maximum(history, 1), np.where(inside, alpha * score, score)
                )
                backed = np.where(seen, 0, backed + inside)
            millionths = np.rint(np.log(score) * UNIT)
            sums += np.bincount(owner[here], millionths, len(sizes)).astype(np.int64)
            missed += np.bincount(owner[here], backed > 0, len(sizes)).astype(np.int64)
        return pa.table(
            {
                "doc_id": pa.array(numbers, pa.int64(), mask=~known),
                "n_words": pa.array(sizes),
                "n_backed_off": pa.array(missed),
                "millionths": pa.array(sums),
            }
        )

    return run


def masks(chunks: DataFrame, order: int, by: Buckets) -> DataFrame:
    """(chunk, bucket, mask): which of a chunk's n-grams other chunks may have too."""
    # the number of buckets follows the corpus' size, so each is a bounded group
    sketches = chunks.mapInArrow(_sketch(order, by), SKETCH)
    return sketches.groupBy("bucket").applyInArrow(_common, MASK)


def candidates(chunks: DataFrame, found: DataFrame, order: int, by: Buckets) -> DataFrame:
    """(bucket, chunk, grams, counts): a chunk's n-grams that the masks ``found`` leave, sorted."""
    return (
        chunks.groupBy("chunk")
        .cogroup(found.groupBy("chunk"))
        .applyInArrow(_candidates(order, by), GRAMS)
    )


def counted(grams: DataFrame) -> DataFrame:
    """Rows (gram, bucket, chunk, n, ...) with the n-gram's total over all chunks and the number
    of chunks that have it. Rows partitioned by bucket are counted in place."""
    same = Window.partitionBy("gram", "bucket")
    return grams.withColumns({"total": F.sum("n").over(same), "chunks": F.count("chunk").over(same)})


def scores(docs: DataFrame, order: int = 3, alpha: float = ALPHA) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_backed_off (words whose
    longest n-gram is in no other document), log_score (natural log, summed) and per_word.

    Words are runs of anything but ASCII white space, as they are. Texts that are null, empty or
    without words have 0 words, a log_score of 0 and a null per_word. Rows that repeat, and rows
    with a null or repeated doc_id, are documents of their own. Other columns are not read. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
        F.spark_partition_id().alias("part"),
    )
    words = docs.agg(F.sum(word_count(F.col("text")))).first()[0] or 0
    by, parts = Buckets(words), buckets(spark)
    # one exchange of chunks, and one of masks, serve all that reads them below
    chunks = light.mapInArrow(_states, STATE).repartition(parts, "chunk")
    found = masks(chunks, order, by).repartition(parts, "chunk")
    # partitioned once, by bucket: the counts and the lists below find their rows in place
    grams = (
        candidates(chunks, found, order, by)
        .repartition(buckets(spark, 2), "bucket")
        .select("bucket", "chunk", "counts", F.posexplode("grams").alias("place", "gram"))
        .select("bucket", "chunk", "place", "gram", F.col("counts")[F.col("place")].alias("n"))
    )
    shared = (
        counted(grams)
        .where("chunks > 1")
        .select("chunk", "bucket", "place", "total")
        .mapInArrow(_packed, ANSWERS)
    )
    none = F.lit(None).cast("binary")
    answers = found.select("*", none.alias("places"), none.alias("totals")).union(
        shared.select("chunk", "bucket", none, "places", "totals")
    )
    scored = (
        chunks.groupBy("chunk")
        .cogroup(answers.groupBy("chunk"))
        .applyInArrow(
            _score(order, alpha, words, by),
            "doc_id long, n_words long, n_backed_off long, millionths long",
        )
    )
    log_score = F.col("millionths") / F.lit(float(UNIT))
    return scored.select(
        "doc_id",
        "n_words",
        "n_backed_off",
        log_score.alias("log_score"),
        F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("per_word"),
    )
