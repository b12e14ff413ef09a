"""SimHash near copies of whole texts: sets of five-word shingles with a Jaccard similarity of SIMILARITY or more.

The general form of the fingerprint operator. Texts of one word sequence are one node, so exact copies cost nothing. A node's
wide fingerprint is the SimHash of its distinct shingles: SEGMENTS pieces of BITS bits that index it and CHECK_BITS more that
stay with each table entry. Multi-index hashing: a node is entered in the table of each segment under every value of the ball
of radius 1 about its own, so two nodes meet if some segment differs in two bits or fewer. Where they meet, the complete
distance over the check bits is verified (DISTANCE), and what passes is a candidate. Candidates, and what they reach through others,
are one group. In a group every node is compared with every other by the Jaccard similarity of their whole sets, computed exactly,
unless links already join the two; a link is a pair of SIMILARITY.

Texts of similarity 0.8 differ in 14 % of their bits, so a segment is within two bits with a probability of 0.3, and of 9
segments one is with 0.96; at similarity 0.9 with 0.999. A table entry meets others by chance in proportion to rows / 2**BITS;
BITS should grow with log2 of the rows (24 holds to some 10**9, 32 with twice the segments beyond).

No step makes pairs: a value passes on a forest of its candidates, and a set moves once to its group. A group of more than BLOCK nodes
is cut in blocks, and up to MEET of its nodes stand in each of them; whatever these links leave outside the group's largest part then
meets all of the group's blocks, with its own links known. So every two nodes that no links join have been compared, whatever the
group's size, and rows grow with the nodes. Values of more than MOST nodes are cut and completed in the same way.

Defined cases: null and empty texts are one node without shingles; a text of fewer words than a shingle is one shingle; extra
columns are kept; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetlens.llm.common import Listed, ascii_words, hold, materialise, slices
from meetlens.llm.graph import components

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: An entry is two numbers: segment (4 bits), its value (BITS) and the first check bits (LOW), then 64 more check bits.
SEGMENTS, BITS, LOW = 9, 24, 35
CHECK_BITS, DISTANCE = LOW + 64, 26
#: Nodes of a group that meet in one task, and shingles of them; nodes of a cut group, and of a cut value, that stand in all its blocks.
BLOCK, SHINGLES, MEET, LEADERS = 128, 1 << 22, 32, 2
#: Bytes of a shingle's hash that travel in a set.
SHIPPED = 5
#: Entries that are held before values are compared, nodes of a value that are compared at once, and of a value that needs no forest.
ROWS, MOST, FEW = 1 << 16, 1 << 20, 6
_WORDS = -(-(SEGMENTS * BITS + CHECK_BITS) // 64)
_ODD = np.random.default_rng(SEED).integers(0, 1 << 63, _WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASK = np.int64((1 << LOW) - 1)


def shingles(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    of = xxhash.xxh64_intdigest
    found = [of(b" ".join(words[i : i + shingle]), SEED) for i in range(max(1, len(words) - shingle + 1))]
    return np.unique(np.array(found, np.uint64))


def wide(found: np.ndarray) -> np.ndarray:
    """The bits of the wide fingerprint of a set of shingle hashes that is not empty: 1 where over half of the shingles have it."""
    ones = np.zeros(64 * _WORDS, np.int64)
    for i in range(0, len(found), 4096):
        h = found[i : i + 4096, None] * _ODD
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(0, dtype=np.int32)
    return 2 * ones > len(found)


def entries(bits: np.ndarray) -> tuple[list[int], int]:
    """What index the fingerprint: each segment's entry under its own value, and the 64 check bits of all of them."""
    number = lambda x: int.from_bytes(np.packbits(np.append(np.zeros(-len(x) % 8, bool), x)).tobytes(), "big")
    check = bits[SEGMENTS * BITS :]
    low, high = number(check[:LOW]), number(check[LOW:CHECK_BITS])
    own = [s << BITS + LOW | number(bits[s * BITS : (s + 1) * BITS]) << LOW | low for s in range(SEGMENTS)]
    return own, high - (1 << 64) if high >> 63 else high


def shipped(found: np.ndarray) -> bytes:
    """A set of shingle hashes as it travels: the upper SHIPPED bytes of each, in order. Of a thousand shingles two are alike in these
    forty bits once in a million sets.
    """
    kept = np.unique(found >> np.uint64(64 - 8 * SHIPPED)).astype("<u8")
    return kept.view(np.uint8).reshape(-1, 8)[:, :SHIPPED].tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // SHIPPED, 8), np.uint8)
    out[:, :SHIPPED] = np.frombuffer(raw, np.uint8).reshape(-1, SHIPPED)
    return out.view("<u8").ravel()


def spanned(n: int, meets: Callable[[np.ndarray, np.ndarray], np.ndarray], label: np.ndarray | None = None, own: np.ndarray | None = None, most: int = 1) -> np.ndarray:
    """Pairs (2 rows) that span what links nodes 0 to n - 1, found from node to node among those not reached yet.

    meets(nodes, others) is the matrix of links. Nodes of one label are joined already. Two nodes that are not own are not compared.
    most: cells of a matrix, about.
    """
    left, out = np.arange(n), [np.zeros((2, 0), np.int64)]
    while len(left) > 1:
        queue, left = left[:1], left[1:]
        if label is not None:
            same = label[left] == label[queue[0]]
            queue, left = np.append(queue, left[same]), left[~same]
        while len(queue) and len(left):
            c = max(1, most // len(left))
            now, queue = queue[:c], queue[c:]
            hit = meets(now, left)
            if own is not None:
                hit &= own[now][:, None] | own[left]
            found = hit.any(0)
            if found.any():
                out.append(np.stack([left[found], now[hit[:, found].argmax(0)]]))
                if label is not None:
                    found = np.isin(label[left], label[left[found]])
                queue, left = np.append(queue, left[found]), left[~found]
    return np.concatenate(out, axis=1)


def alike(sets: list[bytes], label: np.ndarray | None = None, own: np.ndarray | None = None) -> np.ndarray:
    """Pairs that span the sets (as shipped() gives them) of a Jaccard similarity of SIMILARITY."""
    found = [unpacked(x) for x in sets]
    size = np.array([len(x) for x in found])
    names, flat = np.unique(np.concatenate(found), return_inverse=True)
    ids = np.split(flat, np.cumsum(size)[:-1])
    mark = np.zeros(len(names), np.int32)

    def meets(now: np.ndarray, left: np.ndarray) -> np.ndarray:
        out, (u,) = np.zeros((1, len(left)), bool), now
        fits = np.flatnonzero(np.minimum(size[left], size[u]) >= SIMILARITY * np.maximum(size[left], size[u]))
        if len(fits):
            to = left[fits]
            mark[ids[u]] = 1
            both = np.add.reduceat(mark[np.concatenate([ids[v] for v in to])], np.append(0, np.cumsum(size[to])[:-1]))
            mark[ids[u]] = 0
            out[0, fits] = both / (size[u] + size[to] - both) >= SIMILARITY
        return out

    return spanned(len(sets), meets, label, own)


def nodes(rows: DataFrame) -> DataFrame:
    """The rows with __node long (a hash of the word sequence), __size (shingles), __own array<long> and __check (entries())."""
    kept = rows.columns
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("near", lambda: None)
        for batch in slices(batches):
            made = []
            for text in batch.column("text").to_pylist():
                words = ascii_words(text)
                found = shingles(words)
                own = entries(wide(found)) if len(found) else ([], 0)
                made.append((xxhash.xxh64_intdigest(b" ".join(words), SEED), len(found), *own))
            node, size, own, check = zip(*made) if made else ((), (), (), ())
            made = [np.array(node, np.uint64).view(np.int64), pa.array(size, pa.int64()), pa.array(own, pa.list_(pa.int64())), pa.array(check, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, made)], [*kept, "__node", "__size", "__own", "__check"])

    return rows.mapInArrow(run, f"{schema}, `__node` long, `__size` long, `__own` array<long>, `__check` long")


def _within(k: np.ndarray, check: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    bits = check.view(np.uint64)
    return lambda i, j: np.bitwise_count((k[i][:, None] ^ k[j]) & _MASK) + np.bitwise_count(bits[i][:, None] ^ bits[j]) <= DISTANCE


def compared(k: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Of rows sorted by value: pairs (row, earlier row) that span the candidates of each value."""
    key, n = k >> LOW, len(k)
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(starts, append=n)
    place = np.arange(n) - np.repeat(starts, sizes)
    out, at, lag = [np.zeros((2, 0), np.int64)], np.flatnonzero((place > 0) & (np.repeat(sizes, sizes) <= FEW)), 1
    while len(at):
        d = np.bitwise_count((k[at] ^ k[at - lag]) & _MASK) + np.bitwise_count((check[at] ^ check[at - lag]).view(np.uint64))
        hit = at[d <= DISTANCE]
        out.append(np.stack([hit, hit - lag]))
        lag += 1
        at = at[place[at] >= lag]
    for start, size in zip(starts[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
        a, b = spanned(size, _within(k[start : start + size], check[start : start + size]), most=ROWS)
        root = np.arange(size)
        for i, j in zip(a.tolist(), b.tolist()):  # in the order in which they were reached: j's root is known
            root[i] = root[j]
        out.append(np.stack([a, root[a]]) + start)
    return np.concatenate(out, axis=1)


def candidates(table: DataFrame) -> DataFrame:
    """key, a, b of entries (k, check, node): pairs that span the candidates of each value (key null), and the values that were cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(x: np.ndarray, cut: list[int]) -> pa.RecordBatch:
            k, check, node = x
            i, j = compared(k, check)
            found = np.unique(np.stack([np.maximum(node[i], node[j]), np.minimum(node[i], node[j])]), axis=1)
            none = np.zeros(len(cut), np.int64)
            null = np.append(np.ones(found.shape[1], bool), np.zeros(len(cut), bool))
            made = [pa.array(np.append(np.zeros(found.shape[1], np.int64), np.array(cut, np.int64)), mask=null)]
            made += [pa.array(np.append(x, none), mask=~null) for x in found]
            return pa.RecordBatch.from_arrays(made, ["key", "a", "b"])

        held, parts, waiting = np.zeros((3, 0), np.int64), [], 0
        for batch in batches:
            parts.append(np.stack([batch.column(c).to_numpy() for c in ("k", "check", "node")]))
            waiting += batch.num_rows
            if waiting >= ROWS:
                held, parts, waiting = np.concatenate([held, *parts], axis=1), [], 0
                key = held[0] >> LOW
                cut = int(np.searchsorted(key, key[-1]))  # the last value may go on
                if cut:
                    yield rows(held[:, :cut], [])
                held = held[:, cut:]
                while held.shape[1] > MOST:  # a value of very many nodes: a block at a time, its first nodes with each
                    yield rows(held[:, :MOST], [int(held[0, 0] >> LOW)])
                    held = np.concatenate([held[:, :LEADERS], held[:, MOST:]], axis=1)
        held = np.concatenate([held, *parts], axis=1)
        if held.shape[1]:
            yield rows(held, [])

    dealt = table.repartition(F.shiftright("k", LOW)).sortWithinPartitions(F.shiftright("k", LOW), "node")
    return dealt.mapInArrow(run, "key long, a long, b long")


def pieces(dealt: DataFrame, found: Callable[[pa.RecordBatch, np.ndarray | None, np.ndarray], np.ndarray]) -> DataFrame:
    """a, b: pairs of nodes that span each block (g, block) of rows with node, label (null: none yet), own and what `found` reads.

    The rows are read twice, by ranges; they should have been written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(parts: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            x = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
            label = None if x.column("label").null_count else x.column("label").to_numpy()
            i, j = found(x, label, x.column("own").to_numpy(zero_copy_only=False))
            node = x.column("node").to_numpy()
            return node[i], node[j]

        now, parts = None, []
        for batch in batches:
            out = []
            at = np.stack([batch.column(c).to_numpy() for c in ("g", "block")])
            cuts = np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if start == end:
                    continue
                if parts and now != tuple(at[:, start]):
                    out.append(rows(parts))
                    parts = []
                now = tuple(at[:, start])
                parts.append(batch.slice(start, end - start))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b"])
        if parts:
            yield pa.RecordBatch.from_arrays(list(map(pa.array, rows(parts))), ["a", "b"])

    return dealt.repartitionByRange("g", "block").sortWithinPartitions("g", "block", "node").mapInArrow(run, "a long, b long")


def sets_of(texts: DataFrame, wanted: Listed) -> DataFrame:
    """__row, shingles binary of those rows (__row, text) that may be wanted."""
    has = wanted.has()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            batch = batch.filter(pa.array(has(batch.column("place"))))
            sets = [shipped(shingles(ascii_words(t))) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(sets, pa.binary())], ["__row", "shingles"])

    return texts.select("__row", "text", wanted.place().alias("place")).mapInArrow(run, "__row struct<k:long,t:long>, shingles binary")


def in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """The rows (g, node) with the number of blocks of their group, from its n (nodes) and total (shingles), and their own block."""
    by = members.groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("total")).select("g", blocks.cast("long").alias("blocks"))
    return members.join(by, "g").withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))


def with_guests(own: DataFrame, guests: DataFrame) -> DataFrame:
    """The rows of all blocks, and the guests in each block of their group that is not their own."""
    every = guests.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).where("`to` <> block")
    columns = [c for c in own.columns if c not in ("block", "blocks")]
    return own.select(*columns, "block", F.lit(True).alias("own")).union(every.select(*columns, F.col("to").alias("block"), F.lit(False).alias("own")))


def unjoined(members: DataFrame, found: DataFrame, blocks: Column) -> DataFrame:
    """Of groups (g, node, size) that the links found so far do not join whole: all nodes by block, with what they are joined to as label,
    and those outside the group's largest part in every block.
    """
    known = members.join(components(found), "node", "left").select("g", "node", "size", F.coalesce("root", "node").alias("label"))
    known = materialise(known, "parts")
    parts = known.groupBy("g", "label").agg(F.count("*").alias("n"))
    main = parts.groupBy("g").agg(F.max(F.struct("n", "label")).alias("x"), F.count("*").alias("parts")).where("parts > 1")
    apart = materialise(in_blocks(known, blocks).join(main.select("g", F.col("x.label").alias("main")), "g"), "parts")
    return with_guests(apart.drop("main", "size"), apart.where("label <> main"))


def verified(members: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b: links that span every group (g, node, size, __row), whatever its size. sets: __row, shingles."""

    def found(x: pa.RecordBatch, label: np.ndarray | None, own: np.ndarray) -> np.ndarray:
        return alike(x.column("shingles").to_pylist(), label, own)

    def needed(nodes: int) -> Column:
        return F.greatest(F.ceil(F.col("n") / nodes), F.ceil(F.col("total") / SHINGLES))

    own = materialise(in_blocks(members, needed(BLOCK)).withColumn("label", F.lit(None).cast("long")), "blocks")
    cut = own.where("blocks > 1")
    guests = cut.groupBy("g", F.pmod(F.xxhash64("node", "g"), F.lit(MEET)).alias("of")).agg(F.min(F.struct("node", *(c for c in own.columns if c != "node"))).alias("x")).select("x.*")
    dealt = materialise(with_guests(own.drop("size"), guests).join(sets, "__row").drop("__row"), "dealt")
    links = materialise(pieces(dealt, found), "links")
    if cut.isEmpty():
        return links
    left = materialise(unjoined(cut.select("g", "node", "size"), links, needed(8 * BLOCK)), "left")
    again = dealt.where("own").join(left.select("g").distinct(), "g", "left_semi").select("node", "shingles")
    return links.union(materialise(pieces(materialise(left.join(again, "node"), "dealt"), found), "links"))


#: The two parts of __row.
ROW = ("__row.k", "__row.t")


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with __row, which only rows of one id and one text share."""
    return docs.withColumn("__row", F.struct(F.xxhash64("doc_id", "text").alias("k"), F.xxhash64("text").alias("t")))


def named(docs: DataFrame) -> DataFrame:
    """For each __row of the documents: doc_id, __n (how many rows it stands for) and what nodes() adds; no texts."""
    own = nodes(docs.select("doc_id", "text"))
    own = keyed(own).select("__row", "doc_id", "__node", "__size", "__own", "__check")
    firsts = [F.first(c).alias(c) for c in own.columns[1:]]
    return materialise(own.groupBy("__row").agg(F.count("*").alias("__n"), *firsts), "rows")


def one_each(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Of keyed rows, one of each __row that is wanted (__row, __n and more columns), with those columns but __n.

    The keys are written first: Spark then broadcasts them if they are small enough, and moves the texts to them if not.
    Repeated rows meet as partial aggregates, so that very many of them need no one task.
    """
    found = found.join(materialise(wanted, "wanted"), "__row")
    columns = [c for c in found.columns if c not in ("__row", "__n")]
    repeated = found.where("__n > 1").groupBy("__row").agg(F.first(F.struct(*(F.col(f"`{c}`") for c in columns))).alias("x"))
    return found.where("__n = 1").select(*(F.col(f"`{c}`") for c in columns)).union(repeated.select("x.*"))


def grouped(known: DataFrame) -> DataFrame:
    """node, root: the groups that candidates among the nodes (node, own, check) make; nodes without any are not listed."""
    ball = F.array(*(F.lit(x).cast("long") for x in [0, *(1 << LOW + b for b in range(BITS))]))
    every = F.flatten(F.transform("own", lambda k: F.transform(ball, lambda m: k.bitwiseXOR(m))))
    entry = known.select(F.explode(every).alias("k"), "check", "node")
    met = materialise(candidates(entry), "met")
    # a node's partners are joined through the least of them: of a dense group, few pairs are left
    partners = met.where("key IS NULL").groupBy("a").agg(F.collect_set("b").alias("b"))
    pairs = partners.select(F.explode(F.array_union(F.array("a"), "b")).alias("a"), F.array_min("b").alias("b")).where("a <> b").distinct()
    pairs = materialise(pairs, "pairs")
    cut = met.where("key IS NOT NULL").select("key").distinct()
    if not cut.isEmpty():

        def found(x: pa.RecordBatch, label: np.ndarray | None, own: np.ndarray) -> np.ndarray:
            k, check = (x.column(c).to_numpy() for c in ("k", "check"))
            return spanned(len(k), _within(k, check), label, own, ROWS)

        large = materialise(entry.withColumn("g", F.shiftright("k", LOW)).join(cut.withColumnRenamed("key", "g"), "g"), "cut")
        left = unjoined(large.select("g", "node", F.lit(1).alias("size")), pairs, F.ceil(F.col("n") / MOST))
        pairs = pairs.union(materialise(pieces(materialise(left.join(large, ["g", "node"]), "dealt"), found), "pairs"))
    return components(pairs)


def links(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """a, b: verified links among the nodes of rows (as named() gives them for docs). Sets are made of candidates only."""
    own = rows.where("__size > 0").groupBy(F.col("__node").alias("node"))
    known = own.agg(F.min("__size").alias("size"), F.min("__row").alias("__row"), F.min("__own").alias("own"), F.min("__check").alias("check"))
    known = materialise(known, "nodes")
    wanted = known.select("node", "size", "__row").join(grouped(known), "node").select("node", "size", "__row", F.col("root").alias("g"))
    wanted = materialise(wanted, "wanted")
    made = sets_of(keyed(docs.select("doc_id", "text")), Listed(wanted, ROW)).groupBy("__row").agg(F.first("shingles").alias("shingles"))
    return verified(wanted, made)


def survivors(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the smallest id, nulls last, then the smallest hash of the text.

    Rows that neither go nor are repeated stay where they are; only the others are joined.
    """
    rows = named(docs)
    root = components(links(rows, docs))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col("__row.t").alias("t"), "__row", "__n")
    least = rows.groupBy("__node").agg(F.min(order).alias("__o"))
    group = least.join(root, least["__node"] == root.node, "left").groupBy(F.coalesce("root", "__node").alias("g"))
    kept = materialise(group.agg(F.min("__o").alias("o")).select("o.__row", "o.__n"), "kept")
    doubtful = rows.select("__row", "__n").join(kept.select("__row", F.lit(True).alias("stays")), "__row", "left").where("stays IS NULL OR __n > 1")
    doubt, own = Listed(materialise(doubtful.select("__row"), "doubtful"), ROW).column(), keyed(docs)
    return own.where(~doubt).select(docs.columns).union(one_each(own.where(doubt), kept).select(docs.columns))
