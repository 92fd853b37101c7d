"""Removal of repeated passages by difference-cover anchors."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import spread, table
from tessera.llm.words import FIRST, SECOND, blocks
from tessera.shipping import on_workers

#: Words of a passage that counts as repeated.
WINDOW = 35

#: Perfect difference sets: modulo the period, every distance is the difference of two of the set's members.
COVERS = {1: (0,), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

#: Bytes of text that one group of documents, and one group of hashes, stands for, about.
TEXT_PER_GROUP, TEXT_PER_HASHES = 8 << 20, 12 << 20

#: Partitions of a shuffle at most; beyond them a task has several groups, one after another.
PARTITIONS = 1 << 16

#: Hashes that a task gathers before it looks for repeats among them and sends them on.
HELD = 1 << 20

#: Bytes of hashes that a task sends on at once, about.
SENT_BYTES = 1 << 20

_SENT = "bucket int, h1 binary, h2 binary, known binary, key binary, doc binary, pos binary"
_PLACES = "bucket int, key binary, doc binary, pos binary"


def cover(window: int) -> tuple[int, tuple[int, ...]]:
    """The period and the cover for windows of so many words: the longest period that leaves anchors of a third of it."""
    period = max(p for p in COVERS if p == 1 or 3 * (window - p + 1) >= window)
    return period, COVERS[period]


def _taken(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The items at some places; an array that is left out stays empty."""
    return x[at] if len(x) else x


def _runs(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, whether each (in that order) opens a run of equal hashes, and the size of its run."""
    order = np.lexsort((h2, h1)) if len(h2) else np.argsort(h1, kind="stable")
    a = h1[order]
    opens = np.ones(len(a), bool)
    opens[1:] = a[1:] != a[:-1]
    if len(h2):
        b = h2[order]
        opens[1:] |= b[1:] != b[:-1]
    run = np.cumsum(opens) - 1
    return order, opens, np.bincount(run, minlength=1)[run] if len(a) else np.empty(0, np.int64)


class _Sender:
    """Gathers hashes of places in documents; repeats among those held are settled here, so a hash goes on to its bucket
    once from each lot that was held, however often it occurs."""

    def __init__(self, hash_groups: int, text_groups: int) -> None:
        self.hash_groups, self.text_groups = hash_groups, text_groups
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, h1, h2, key, doc, pos) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        self.parts.append((h1, h2, key, doc, pos))
        self.held += len(h1)
        if self.held >= HELD:
            yield from self.send()

    def send(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        h1, h2, key, doc, pos = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order, opens, size = _runs(h1, h2)
        again = np.sort(order[size > 1])
        local = TaskContext.get().partitionId() % self.hash_groups
        rows = [(local, b"", b"", b"", *(_taken(x, again).tobytes() for x in (key, doc, pos)))] if len(again) else []
        first = np.sort(order[opens])
        known = np.zeros(len(h1), np.uint8)
        known[order[size > 1]] = 1
        to = (h1[first] % np.uint64(self.hash_groups)).astype(np.int64)
        by_group = np.argsort(to, kind="stable")
        first, to = first[by_group], to[by_group]
        groups, edges = np.unique(to, return_index=True)
        sent = 0
        for b, at in zip(groups.tolist(), np.split(first, edges[1:]), strict=True):
            place = at[known[at] == 0]
            rows.append((
                b, h1[at].tobytes(), h2[at].tobytes() if len(h2) else b"", known[at].tobytes(),
                *(_taken(x, place).tobytes() for x in (key, doc, pos)),
            ))
            sent += len(rows[-1][1])
            if sent >= SENT_BYTES:
                yield _sent_batch(rows)
                rows, sent = [], 0
        if rows:
            yield _sent_batch(rows)


def _sent_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ["bucket", "h1", "h2", "known", "key", "doc", "pos"]
    kinds = [pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _by_text_group(key: np.ndarray, doc: np.ndarray, pos: np.ndarray, text_groups: int) -> pa.Table:
    """Places, one row for each group of documents."""
    to = np.mod(key, text_groups)
    order = np.lexsort((pos, key, to))
    to, key, doc, pos = to[order], key[order], _taken(doc, order), pos[order]
    found = np.unique(to)
    edges = np.searchsorted(to, np.append(found, text_groups))
    cut = lambda x: [x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)]  # noqa: E731  (nothing of an empty array)
    return pa.table({
        "bucket": pa.array(found.astype(np.int32), pa.int32()),
        "key": pa.array(cut(key), pa.binary()), "doc": pa.array(cut(doc), pa.binary()), "pos": pa.array(cut(pos), pa.binary()),
    })


def _by_bucket(frame: DataFrame, groups: int) -> DataFrame:
    """The frame in as many partitions as there are buckets, so that a task's share doesn't grow with the table."""
    return frame.repartition(min(groups, PARTITIONS), "bucket") if groups > 1 else frame


def _repeated(sent: DataFrame, hash_groups: int, text_groups: int) -> DataFrame:
    """The places whose hash occurs at two places or more, one row for each group of documents and bucket of hashes."""

    def decide(rows: pa.Table) -> pa.Table:
        h1, h2 = _joined(rows["h1"], np.uint64), _joined(rows["h2"], np.uint32)
        known = _joined(rows["known"], np.uint8)
        place = np.full(len(h1), -1)
        again: list[np.ndarray] = []
        # places come row by row: a settled row has places alone, another one for each hash that isn't known
        counts = np.array([len(x) // 8 for x in rows["key"].to_pylist()])
        hashes = np.array([len(x) // 8 for x in rows["h1"].to_pylist()])
        key, doc, pos = (_joined(rows[x], t) for x, t in (("key", np.int64), ("doc", np.int64), ("pos", np.int32)))
        settled = np.repeat(hashes == 0, counts)
        again.append(np.flatnonzero(settled))
        place[known == 0] = np.flatnonzero(~settled)
        order, _, size = _runs(h1, h2)
        hit = place[order[size > 1]]
        again.append(hit[hit >= 0])
        at = np.concatenate(again)
        return _by_text_group(key[at], _taken(doc, at), pos[at], text_groups)

    return _by_bucket(sent, hash_groups).groupBy("bucket").applyInArrow(decide, _PLACES)


def _ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of so many items each: the row of each item, and its number in the row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _marked(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` places lie in one of the ranges start to end - 1."""
    step = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(ends, minlength=size + 1)[: size + 1]
    return np.cumsum(step)[:size] > 0


class _Places:
    """The places in the documents of one group, found by the document's key."""

    def __init__(self, rows: pa.Table, exact: bool) -> None:
        key, doc, pos = (_joined(rows[x], t) for x, t in (("key", np.int64), ("doc", np.int64), ("pos", np.int32)))
        order = np.lexsort((doc, key)) if exact else np.argsort(key, kind="stable")
        self.key, self.doc, self.pos, self.exact = key[order], doc[order] if exact else doc, pos[order], exact

    def of(self, key: int, doc: int) -> np.ndarray:
        a, b = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        if self.exact:
            a, b = a + np.searchsorted(self.doc[a:b], doc, "left"), a + np.searchsorted(self.doc[a:b], doc, "right")
        return self.pos[a:b]


def without_repeats(frame: DataFrame, id_column: str, text_column: str, window: int = WINDOW) -> DataFrame:
    """Each document with the words removed that lie in a repeated window.

    Words are runs of bytes other than space and 9 to 13. A window is ``window`` consecutive words of one document; it is
    repeated if its word sequence also starts anywhere else, in the same document too. All its occurrences go. Returns
    the id, ``n_words``, ``n_removed`` and ``kept`` (the words left, joined by one space), one row for each input row.

    Anchors of window - period + 1 words are hashed at cover positions only; two occurrences of a window share an anchor
    at the same place of the window. Anchors that occur twice extend to the windows around them, and those windows are
    compared by 96-bit hashes of their words. No pairs of documents are made: the work is linear in the words.

    A null text has no words. A null id is an id like any other; equal rows count as documents of their own, so all
    their windows are repeated. An empty table gives an empty result. Other columns are not carried.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    on_workers(frame.sparkSession)
    period, members = cover(window)
    anchor = window - period + 1
    covers = np.zeros(period, bool)
    covers[list(members)] = True

    rows = frame.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    text_groups, hash_groups = ceil(size / TEXT_PER_GROUP) or 1, ceil(size / TEXT_PER_HASHES) or 1
    key = F.xxhash64("id", "text")
    docs = rows.select(
        "id", "text", key.alias("key"), F.xxhash64("id", F.lit(1)).alias("doc"), F.pmod(key, F.lit(text_groups)).cast("int").alias("bucket")
    )

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender(hash_groups, text_groups)
        for batch in batches:
            keys = batch.column("key").to_numpy()
            for block in blocks(batch.column("text")):
                counts = np.diff(block.bounds)
                doc, place = _ranges(np.where(counts >= window, counts - anchor + 1, 0))
                chosen = covers[place % period]
                doc, place = doc[chosen], place[chosen]
                if len(doc):
                    h = FIRST.runs(block.hashes(FIRST, False), anchor)[block.bounds[doc] + place]
                    none = np.empty(0, np.uint32)
                    yield from sender.add(h, none, keys[block.first + doc], none.astype(np.int64), place.astype(np.int32))
        yield from sender.send()

    def windows(texts: pa.Table, places: pa.Table) -> pa.Table:
        sender = _Sender(hash_groups, text_groups)
        out: list[pa.RecordBatch] = []
        if places.num_rows and texts.num_rows:
            found = _Places(places, exact=False)
            held = np.isin(texts["key"].to_numpy(), found.key)
            some = texts.filter(pa.array(held)).combine_chunks()
            keys, ids = some["key"].to_numpy(), some["doc"].to_numpy()
            for block in (b for c in some["text"].chunks for b in blocks(c)):
                counts = np.diff(block.bounds)
                open_, shut, limit = [], [], []
                for i, n in enumerate(counts):
                    at = found.of(keys[block.first + i], 0)
                    base, last = block.bounds[i], n - window
                    open_.append(base + np.clip(at - (window - anchor), 0, last))
                    shut.append(base + np.minimum(at, last) + 1)
                candidate = np.flatnonzero(_marked(int(block.bounds[-1]), np.concatenate(open_), np.concatenate(shut)))
                doc = np.searchsorted(block.bounds, candidate, "right") - 1
                h1, h2 = (f.runs(block.hashes(f, False), window)[candidate] for f in (FIRST, SECOND))
                place = (candidate - block.bounds[doc]).astype(np.int32)
                out += sender.add(h1, (h2 >> np.uint64(32)).astype(np.uint32), keys[block.first + doc], ids[block.first + doc], place)
            out += sender.send()
        return pa.Table.from_batches(out) if out else _EMPTY

    def cut(texts: pa.Table, places: pa.Table) -> pa.Table:
        found = _Places(places, exact=True)
        texts = texts.combine_chunks()
        keys, ids = texts["key"].to_numpy(), texts["doc"].to_numpy()
        words, removed, kept = [], [], []
        chunks = texts["text"].chunks
        for block, shift in ((b, s) for c, s in zip(chunks, np.cumsum([0, *map(len, chunks)]), strict=False) for b in blocks(c)):
            counts = np.diff(block.bounds)
            at = [found.of(keys[shift + block.first + i], ids[shift + block.first + i]) for i in range(len(counts))]
            start = np.repeat(block.bounds[:-1], list(map(len, at))) + np.concatenate(at)
            stay = ~_marked(int(block.bounds[-1]), start, start + window)
            left = np.concatenate([[0], np.cumsum(stay)])[block.bounds]
            starts, lengths = block.starts[stay], (block.ends - block.starts)[stay]
            word, offset = _ranges(lengths)
            ends = np.cumsum(lengths + 1)
            text = np.full(int(ends[-1]) if len(ends) else 0, 0x20, np.uint8)
            text[(ends - lengths - 1)[word] + offset] = block.data[starts[word] + offset]
            edges = np.concatenate([[0], ends])[left]
            raw = text.tobytes()
            kept += [raw[a : max(a, b - 1)].decode() for a, b in zip(edges[:-1], edges[1:], strict=True)]
            words.append(counts)
            removed.append(counts - np.diff(left))
        whole = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.table({"id": texts["id"], "n_words": whole(words), "n_removed": whole(removed), "kept": pa.array(kept, pa.string())})

    kind = rows.schema["id"].dataType.simpleString()
    by_group = _by_bucket(docs, text_groups).groupBy("bucket")
    grouped = lambda places: _by_bucket(places, text_groups).groupBy("bucket")
    first = _repeated(docs.select("key", "text").mapInArrow(anchors, _SENT), hash_groups, text_groups)
    second = _repeated(by_group.cogroup(grouped(first)).applyInArrow(windows, _SENT), hash_groups, text_groups)
    done = by_group.cogroup(grouped(second)).applyInArrow(cut, f"id {kind}, n_words long, n_removed long, kept string")
    return done.withColumnRenamed("id", id_column)


_EMPTY = pa.table({"bucket": pa.array([], pa.int32()), **{x: pa.array([], pa.binary()) for x in ("h1", "h2", "known", "key", "doc", "pos")}})


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows of 35 words."""
    rows = spread(table(spark, sf_dir, "documents", "doc_id", "text"))
    return without_repeats(rows, "doc_id", "text").select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


OP10_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
words AS (SELECT r, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM texts),
runs AS (
  SELECT r, i, string_agg(w, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS s,
    count(*) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM words
), again AS (SELECT s FROM runs WHERE n = 35 GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, i + j AS i FROM runs JOIN again USING (s), range(35) t(j) WHERE n = 35),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS k, count(*) AS n FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
