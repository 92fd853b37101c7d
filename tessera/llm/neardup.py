"""Near-duplicate documents by an inverted join of MinHash signature coordinates."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, components, roots_of, spread, stars_of, table
from tessera.llm.words import FIRST, SECOND, Family, blocks, mixed

#: Words of a shingle; links need an intersection of at least PERCENT hundredths of the union (the stages' default is 80).
SHINGLE, PERCENT = 5, 80

#: Coordinates of a signature, and the probability with which a link may be lost because its sets match in too few of them.
COORDINATES, MISSED = 64, 1e-12

#: Documents of one posting list, and shingles of one group of linked documents, that a task compares at once.
LIST_ROWS, GROUP_SHINGLES = 1024, 1 << 18

#: Lists up to this length are compared together with others.
SHORT_LIST = 16

#: Lists and groups of up to so many blocks have all pairs of their blocks compared. Longer ones are dealt anew in so many
#: rounds at most, as long as each leaves at most this share of what was not joined before.
DIRECT_BLOCKS, ROUNDS, GOES_ON = 4, 4, 0.5

_SALT, _FACTOR = np.random.default_rng(7).integers(1, 1 << 63, (2, COORDINATES), dtype=np.uint64)
_FACTOR |= np.uint64(1)


def matches_for(percent: int, missed: float = MISSED) -> int:
    """The matches that a pair needs to be looked at: the most that two sets with a similarity of ``percent`` hundredths
    fall short of with no more than the given probability (30 for 85 hundredths, 26 for 80)."""
    share, below, needed = percent / 100, 0.0, 0
    while needed < COORDINATES:
        below += comb(COORDINATES, needed) * share**needed * (1 - share) ** (COORDINATES - needed)
        if below > missed:
            break
        needed += 1
    return max(1, needed)


def shingle_sets(texts: pa.Array, size: int = SHINGLE, family: Family = FIRST) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its runs of ``size`` words, A-Z taken as a-z; of the whole sequence
    where it has fewer words; nothing where it has none."""
    for block in blocks(texts):
        words = block.hashes(family, True)
        runs = family.runs(words, size)
        for a, b in zip(block.bounds[:-1], block.bounds[1:], strict=True):
            if b - a >= size:
                yield np.unique(runs[a : b - size + 1])
            elif b > a:
                yield np.array([family.whole(words[a:b])], np.uint64)
            else:
                yield np.empty(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Smallest hash of a set under each of the coordinates' functions."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 8192):
        part = shingles[i : i + 8192, None] ^ _SALT
        part *= _FACTOR
        part >>= np.uint64(32)
        np.minimum(least, part.min(axis=0), out=least)
    return least.astype(np.uint32)


def set_hash(shingles: np.ndarray) -> int:
    """64 bits that name a set. Those of two families name it by 128 bits of each shingle."""
    return int(mixed(shingles).sum(dtype=np.uint64)) - (1 << 63)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, print, n, and of a set that isn't empty its hash and signature."""
    for batch in batches:
        sizes, high, low, marks = [], [], [], []
        for s, again in zip(shingle_sets(batch.column(1)), shingle_sets(batch.column(1), family=SECOND), strict=True):
            sizes.append(len(s))
            high.append(set_hash(s) if len(s) else None)
            low.append(set_hash(again) if len(s) else None)
            marks.append(signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(marks, pa.binary())],
            names=["id", "print", "n", "high", "low", "sig"],
        )


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, and the coordinate and value of each of its coordinates as one long."""
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            part = batch.slice(start, 1024)
            values = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).astype(np.int64)
            values |= np.tile(np.arange(COORDINATES, dtype=np.int64), part.num_rows) << 32
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column(0).to_numpy(), COORDINATES)), pa.array(values)], names=["node", "post"]
            )


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal first ``keys`` columns, of rows that come sorted by them."""
    open_key, parts = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = np.stack([batch.column(i).to_numpy() for i in range(keys)], axis=1)
        edges = [0, *(np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            key = tuple(values[a].tolist())
            if key != open_key and parts:
                yield open_key, pa.Table.from_batches(parts)
                parts = []
            open_key = key
            parts.append(batch.slice(a, b - a))
    if parts:
        yield open_key, pa.Table.from_batches(parts)


def _link_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _alike(left: np.ndarray, right: np.ndarray, matches: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two lots of signatures that agree in enough coordinates."""
    found = []
    step = max(1, (1 << 21) // max(1, len(right)))
    for i in range(0, len(left), step):
        count = np.zeros((len(left[i : i + step]), len(right)), np.uint8)
        for c in range(COORDINATES):
            count += left[i : i + step, c, None] == right[None, :, c]
        x, y = np.nonzero(count >= matches)
        found.append((x + i, y))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2


def _lists(matches: int):  # noqa: ANN202
    """Of each (post, block i, block j) the pairs with enough matches; of all pairs met in a lot of lists, a star for each
    component."""

    def met(rows: pa.RecordBatch, edges: np.ndarray) -> pa.RecordBatch:
        nodes, place = np.unique(rows.column("node").to_numpy(), return_inverse=True)
        i, j, block = (rows.column(x).to_numpy() for x in ("i", "j", "block"))
        marks = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(-1, COORDINATES)
        size = np.diff(edges)
        segment = np.repeat(np.arange(len(size)), size)
        pairs = []
        short = size[segment] <= SHORT_LIST
        for shift in range(1, SHORT_LIST):  # all pairs of the short lists, by their distance
            x = np.flatnonzero(short[:-shift] & (segment[:-shift] == segment[shift:])) if shift < len(segment) else []
            if not len(x):
                break
            y = x + shift
            x = x[(i[x] == j[x]) | (block[x] != block[y])]
            y = x + shift
            enough = (marks[x] == marks[y]).sum(axis=1) >= matches
            pairs.append((place[x[enough]], place[y[enough]]))
        for k in np.flatnonzero(size > SHORT_LIST):
            own = np.arange(edges[k], edges[k + 1])
            first, second = own[block[own] == i[own]], own[block[own] == j[own]]
            x, y = _alike(marks[first], marks[second], matches)
            pairs.append((place[first[x]], place[second[y]]))
        return _link_batch(*stars_of(nodes, roots_of(len(nodes), pairs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            held = batch if held is None else pa.concat_batches([held, batch])
            keys = np.stack([held.column(k).to_numpy() for k in range(3)], axis=1)
            edges = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if len(edges):  # the last list may go on in the next batch
                yield met(held.slice(0, edges[-1]), np.concatenate([[0], edges]))
                held = held.slice(edges[-1])
        if held is not None and held.num_rows > 1:
            yield met(held, np.array([0, held.num_rows]))

    return run


def _overlaps(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sizes of the intersections of sets of the first with sets of the second lot, as (rows, columns, sizes).

    Shingles of one set alone are left out; the others become the columns of 0/1 matrices, multiplied in pieces.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    opens = np.ones(len(ranked), bool)
    opens[1:] = ranked[1:] != ranked[:-1]
    run = np.cumsum(opens) - 1
    shared = np.bincount(run)[run] > 1
    column = (np.cumsum(opens & shared) - 1)[shared]
    row = owner[order][shared]
    width = int(column.max()) + 1 if len(column) else 0
    by_row = np.argsort(row, kind="stable")
    row, column = row[by_row], column[by_row]
    edges = np.searchsorted(row, np.arange(len(sets) + 1))

    def dense(members: np.ndarray, low: int, high: int) -> np.ndarray:
        out = np.zeros((len(members), high - low), np.float32)
        for k, m in enumerate(members):
            c = column[edges[m] : edges[m + 1]]
            out[k, c[(c >= low) & (c < high)] - low] = 1.0
        return out

    for i in range(0, len(first), 512):
        a = first[i : i + 512]
        for j in range(0, len(second), 512):
            b = second[j : j + 512]
            total = np.zeros((len(a), len(b)), np.float32)
            for low in range(0, width, 8192):
                high = min(width, low + 8192)
                total += dense(a, low, high) @ dense(b, low, high).T
            yield a, b, total


def _verified(percent: int):  # noqa: ANN202
    """Of each (group, block i, block j) the links of full sets, thinned to a star for each of their components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, i, j), rows in _groups(batches, 3):
            if rows.num_rows < 2:
                continue
            rows = rows.combine_chunks()
            # other hashes than those that brought the sets together, so that no chance of the first ones links them
            sets = [s for c in rows["text"].chunks for s in shingle_sets(c, family=SECOND)]
            # a text that isn't the one that named the node (its id is there twice) is left out
            low = rows["low"].to_numpy()
            own = np.array([len(s) > 0 and set_hash(s) == low[k] for k, s in enumerate(sets)], bool)
            nodes, at = np.unique(rows["node"].to_numpy()[own], return_index=True)
            at = np.flatnonzero(own)[at]
            sets, block = [sets[k] for k in at], rows["block"].to_numpy()[at]
            if len(sets) < 2:
                continue
            sizes = np.array([len(s) for s in sets])
            pairs = []
            for a, b, common in _overlaps(sets, np.flatnonzero(block == i), np.flatnonzero(block == j)):
                union = sizes[a][:, None] + sizes[b][None, :] - common
                x, y = np.nonzero((100 * common >= percent * union) & (a[:, None] != b[None, :]))
                root = roots_of(len(nodes), [(a[x], b[y])])
                own_links = np.flatnonzero(root != np.arange(len(root)))
                pairs.append((own_links, root[own_links]))
            yield _link_batch(*stars_of(nodes, roots_of(len(nodes), pairs)))

    return run


def _dealt(rows: DataFrame, key: str, i: Column, j: Column, payload: list[str]) -> DataFrame:
    """The rows by key and pair of blocks, sorted for the comparing functions."""
    keys = [key, "i", "j"]
    dealt = rows.select(key, i.cast("int").alias("i"), j.cast("int").alias("j"), F.col("block").cast("int").alias("block"), *payload)
    return dealt.repartition(*keys).sortWithinPartitions(*keys)


def _linked(
    scratch: Scratch, rows: DataFrame, key: str, bound: int, payload: list[str],
    compare: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], sizes: DataFrame | None = None,
) -> DataFrame:
    """Components (node, component) of the links that ``compare`` finds between nodes of one key; nodes without a link are
    left out.

    ``rows`` has the key, ``node``, its ``weight``, the ``total`` weight of the key, and the payload. A key is cut into
    blocks of about ``bound`` by a hash of the node. Blocks are compared within first, which is all for most keys. A key of a
    few blocks then has all pairs of blocks compared. A larger one is dealt to other blocks and compared within them again,
    which costs no more than its rows: nodes that are alike soon form one component, and pairs inside a component need not
    be compared any more. What isn't in the key's largest component in the end is compared with everything, so no link
    between components is missed. The cost is the square of a key's size only as far as its nodes are *not* joined.
    What is joined goes on as one link for each node, to which the links of later rounds are added.
    ``sizes`` has the totals too, where ``rows`` is costly to make.
    """
    many = F.ceil(F.col("total") / bound)
    place = lambda turn: F.pmod(F.xxhash64("node", F.lit(turn)), many).alias("block")
    kept = [key, "node", "weight", "total", *(c for c in payload if c != "node")]
    pairs = lambda dealt: scratch.keep(dealt.mapInArrow(compare, "a long, b long").distinct())
    within = lambda part, turn: pairs(_dealt(part.select("*", place(turn)), key, F.col("block"), F.col("block"), payload))
    more = lambda joined, links: components(scratch, joined.toDF("a", "b").union(links), "a", "b")
    joined = components(scratch, within(rows.where("total > weight"), 0), "a", "b")
    if (rows if sizes is None else sizes).where(F.col("total") > bound).isEmpty():
        return joined
    large = scratch.keep(rows.where(F.col("total") > bound).select(*kept))
    left, turn = None, 0
    while True:
        root = joined.withColumnRenamed("component", "__root")
        named = scratch.keep(large.join(root, "node", "left").select(*kept, F.coalesce("__root", "node").alias("label")))
        parts = named.groupBy(key, "label").agg(F.sum("weight").alias("w"), F.first("total").alias("total"))
        main = parts.groupBy(key).agg(
            F.max_by("label", F.struct("w", "label")).alias("main"), F.max("w").alias("most"), F.count(F.lit(1)).alias("labels"), F.first("total").alias("all"),
        ).where("labels > 1")
        main = scratch.keep(main.select(key, "main", "most", (F.col("all") - F.col("most")).alias("rest"), (F.ceil(F.col("all") / bound) <= DIRECT_BLOCKS).alias("direct")))
        rest = main.agg(F.sum(F.when(~F.col("direct"), F.col("rest")))).first()[0] or 0
        open_ = named.join(main, key)
        if rest == 0 or turn >= ROUNDS or (left is not None and rest > GOES_ON * left):
            break
        turn, left = turn + 1, rest
        joined = more(joined, within(open_.where(~F.col("direct")).select(*kept), turn))
        scratch.drop(named)
        scratch.drop(main)
    # blocks of the rest come first, those of the largest component after them
    rests, mains = F.ceil(F.col("rest") / bound), F.ceil(F.col("most") / bound)
    of_main = F.col("label") == F.col("main")
    hashed = F.xxhash64("node", F.lit(turn))
    block = F.when(of_main, rests + F.pmod(hashed, mains)).otherwise(F.pmod(hashed, rests))
    others = F.sequence(F.lit(0).cast("long"), F.when(of_main, rests).otherwise(rests + mains) - 1)
    crossed = open_.select("*", block.alias("block"), F.explode(others).alias("other"))
    last = pairs(_dealt(crossed, key, F.least("block", "other"), F.greatest("block", "other"), payload))
    return joined if last.isEmpty() else more(joined, last)


def near_duplicates(
    frame: DataFrame, id_column: str, text_column: str, percent: int = PERCENT, matches: int | None = None, by_print: bool = False,
) -> DataFrame:
    """For each row the id, ``n_shingles``, ``component_id`` (smallest id of its group of near-duplicates) and ``kept``
    (whether the id is that).

    Documents are linked if 100 times the intersection of their shingle sets is at least ``percent`` times the union.
    Equal sets are one node, so copies cost one row each. A node's signature is posted under its coordinate-value pairs;
    pairs of one node alone are left out, a node with fewer than ``matches`` (else ``matches_for``) others has no partner. Of the rest, in the
    order of rising frequency, only the first (others - matches + 1) are merged: two nodes with enough matches meet under
    one of these. The long lists after them are skipped, and their collisions counted on the signatures of nodes that
    met. Nodes that met with enough matches form groups, inside which links are confirmed on the full sets. Lists and
    groups of any size are compared in bounded blocks (``_linked``), and only stars that span components leave a task: all
    links count, but no list of all pairs is made.

    Ids are whole numbers. A null or empty text has an empty set and no link. Rows with one id and one text share a group; a null id is larger
    than any other, and a group of null ids alone has a null component_id and is kept. An empty table gives an empty
    result. Other columns are not carried.

    With ``by_print``, rows with one id and other texts are told apart: adds ``print`` (xxhash64 of the text), and a row is
    ``kept`` if its id and print are those of its group's first row (by id, then print; a text without a word is a group of
    its own). So only rows with equal id and print are kept together.
    """
    spark = frame.sparkSession
    scratch = Scratch(spark, "neardup")
    matches = matches_for(percent) if matches is None else matches
    rows = frame.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    rows = rows.withColumn("print", F.xxhash64("text"))
    sets = scratch.keep(rows.mapInArrow(_signatures, "id long, print long, n long, high long, low long, sig binary"))
    nodes = sets.where("n > 0").groupBy("high", "low").agg(
        F.min(F.struct(F.col("id").isNull(), "id", "print")).alias("first"), F.first("sig").alias("sig"), F.first("n").alias("n")
    )
    nodes = nodes.select("high", "low", "sig", "n", F.col("first.id").alias("least"), F.col("first.print").alias("print"))
    # a node's number is its row's in the stored table, so no two nodes can share one
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))

    posts = nodes.select("node", "sig").mapInArrow(_postings, "node long, post long")
    frequency = posts.groupBy("post").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = scratch.keep(posts.join(frequency, "post"))
    by_node = Window.partitionBy("node")
    prefix = (
        shared.withColumn("others", F.count(F.lit(1)).over(by_node)).where(F.col("others") >= matches)
        .withColumn("place", F.row_number().over(by_node.orderBy("df", "post")))
        .where(F.col("place") <= F.col("others") - matches + 1)
    )
    lists = scratch.keep(prefix.select("post", "node"))
    length = lists.groupBy("post").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    merged = lists.join(length, "post").join(nodes.select("node", "sig"), "node")
    merged = merged.withColumns({"weight": F.lit(1).cast("long"), "total": F.col("m")})
    groups = scratch.keep(_linked(scratch, merged, "post", LIST_ROWS, ["node", "sig"], _lists(matches)))
    scratch.drop(shared)
    scratch.drop(lists)

    members = scratch.keep(groups.join(nodes.select("node", "least", "print", "low", "n"), "node"))
    size = members.groupBy("component").agg(F.sum("n").alias("total"))
    members = members.join(size, "component")
    members = scratch.keep(members.select("component", "node", "least", F.col("print").alias("its_print"), "low", F.col("n").alias("weight"), "total"))
    texts = rows.join(scratch.small(members), F.col("id").eqNullSafe(F.col("least")) & (F.col("print") == F.col("its_print")))
    joined = _linked(scratch, texts, "component", GROUP_SHINGLES, ["node", "low", "text"], _verified(percent), members)

    roots = nodes.join(joined, "node", "left").select(
        "high", "low", "least", "print", F.coalesce("component", "node").alias("root")
    )
    if by_print:
        first = F.min(F.struct(F.col("least").isNull(), F.col("least").alias("id"), "print")).alias("first")
        smallest = roots.groupBy("root").agg(first).select("root", F.col("first.id").alias("component_id"), F.col("first.print").alias("its_print"))
        found = roots.join(smallest, "root").select("high", "low", "component_id", "its_print")
    else:
        smallest = roots.groupBy("root").agg(F.min("least").alias("component_id"))
        found = roots.join(smallest, "root").select("high", "low", "component_id")
    out = sets.select("id", "n", "high", "low", *(["print"] if by_print else [])).join(found, ["high", "low"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    kept = F.col("id").eqNullSafe(component)
    if by_print:
        kept &= (F.col("n") == 0) | (F.col("print") == F.col("its_print"))
    return out.select(
        F.col("id").alias(id_column),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        kept.alias("kept"),
        *(["print"] if by_print else []),
    )


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of all documents that share at least 85 hundredths of their shingles."""
    return near_duplicates(spread(table(spark, sf_dir, "documents", "doc_id", "text")), "doc_id", "text", percent=85)


OP6_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), words AS (SELECT doc_id, len(ws) AS all_words, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM texts),
runs AS (
  SELECT doc_id, all_words, i, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM words
), shingles AS (SELECT DISTINCT doc_id, s FROM runs WHERE i <= greatest(all_words - 5, 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common c JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * c.n >= 85 * (a.n + b.n - c.n)
), reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT t.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(t.doc_id, coalesce(y, t.doc_id)) AS component_id,
  t.doc_id = least(t.doc_id, coalesce(y, t.doc_id)) AS kept
FROM texts t LEFT JOIN sizes s USING (doc_id) LEFT JOIN least l ON l.x = t.doc_id
"""
