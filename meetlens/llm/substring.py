"""Removal of passages that an earlier document holds, found by difference-cover anchors.

A window is WINDOW words in a row. Of the shorter anchors (WINDOW - PERIOD + 1 words) a document hashes those alone that start at a
position whose remainder by PERIOD is in the cover. Any two positions can be moved on by the same few words (under PERIOD) so that
both remainders are in the cover; so two equal windows, wherever they stand, hold equal anchors at the same place. With a period of 7
and the cover 0, 1, 3, three positions in seven are hashed.

1. Tasks take documents in chunks and deal the anchors' hashes into buckets, each hash once a chunk, packed as arrays. A bucket answers
   each chunk which of its anchors another chunk has too; those met twice inside a chunk are known there.
2. Anchors that several documents have are extended: the windows around them are hashed (96 bits), dealt into buckets in the same way, each once a
   chunk with the smallest id there. A bucket finds the smallest id of all and answers which windows an earlier document has.
3. Documents with such windows lose the words that these cover.

Documents of equal words are one document in steps 1 to 3, that with the smallest id: all windows of the others are in it.
No step pairs documents, so passages that many documents share cost each of them its own windows. A frequent anchor or window is one
entry a chunk in its bucket, however many documents hold it.

Defined cases: null and empty texts, and texts shorter than a window, keep all their words; a null id has no order: its document
keeps all its words and takes none from others; equal ids are not smaller than one another, and repeated rows are each returned, with the
same result; very long texts are read whole, in pieces; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlens.llm.common import hold, materialise, slices

WINDOW, PERIOD = 13, 7
#: Difference covers by period: every remainder is the difference of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Bytes of text that are hashed at one time, and of a chunk's texts; bytes of entries in a bucket, about; fewest buckets.
PIECE, CHUNK, BUCKET, LEAST_BUCKETS = 1 << 20, 1 << 23, 1 << 25, 512
#: Most documents of a chunk, and the number in place of a document's for anchors that several documents of the chunk have.
MOST_DOCS, ANY = 60_000, 0xFFFF
#: Bits of the map of wanted rows at most, and its pages.
MOST_BITS, PAGES = 1 << 28, 64

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_SPACES = re.compile(rb"[ \t-\r]")
#: Odd multipliers: of letters in a word, of words in an anchor or window, and of words in the second hash of a window.
_LETTER, _WORD, _CHECK = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xA0761D6478BD642F
_TABLES: list[np.ndarray] = []


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables() -> list[np.ndarray]:
    """A number for each byte, and the powers of the letters' multiplier and of its inverse up to a piece."""
    if not _TABLES:
        powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(PIECE, m, np.uint64)]), dtype=np.uint64) for m in (_LETTER, pow(_LETTER, -1, 1 << 64))]
        _TABLES.extend([_mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_LETTER)), *powers])
    return _TABLES


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces of about PIECE bytes that end at white space; a longer word is a piece of its own."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end > at and not _SPACE[text[end - 1]]:
            back = text[max(at, end - 4096) : end]
            k = max(back.rfind(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
            end = end - len(back) + k + 1
        if end == at:
            found = _SPACES.search(text, at + PIECE)
            end = found.end() if found else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _hash_piece(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word."""
    byte, powers, inverse = _tables()
    b = np.frombuffer(raw, np.uint8)
    solid = np.zeros(len(b) + 2, np.int8)
    solid[1:-1] = ~_SPACE[b]
    edge = np.diff(solid)
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if len(b) > PIECE:  # one word that is longer
        total = 0
        for k in range(0, len(b), PIECE):
            part = b[k : k + PIECE][~_SPACE[b[k : k + PIECE]]]
            lead = k - int(starts[0])
            total += pow(_LETTER, max(lead, 0), 1 << 64) * int((byte[part] * powers[: len(part)]).sum(dtype=np.uint64))
        return _mixed(np.array([total & (1 << 64) - 1], np.uint64)), starts
    along = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(byte[b] * powers[: len(b)], out=along[1:])
    return _mixed((along[ends] - along[starts]) * inverse[starts]), starts


def hash_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The words' 64-bit hashes of all texts, one after another, and how many each text has. Short texts are hashed together."""
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(texts), np.int64)
    first, held = 0, 0

    def flush(end: int) -> None:
        if end > first:
            found, starts = _hash_piece(b"\n".join(texts[first:end]))
            offsets = np.cumsum([0, *(len(x) + 1 for x in texts[first:end])])
            counts[first:end] = np.diff(np.searchsorted(starts, offsets))
            hashes.append(found)

    for i, text in enumerate(texts):
        if held + len(text) + 1 > PIECE:
            flush(i)
            first, held = i, 0
        if len(text) >= PIECE:
            for piece in pieces(text):
                hashes.append(_hash_piece(piece)[0])
                counts[i] += len(hashes[-1])
            first = i + 1
        else:
            held += len(text) + 1
    flush(len(texts))
    return np.concatenate([*hashes, np.empty(0, np.uint64)]), counts


def rolled(h: np.ndarray, k: int, multiplier: int) -> np.ndarray:
    """The polynomial hash of each k neighbours; shorter by k - 1."""
    if len(h) < k:
        return np.empty(0, np.uint64)
    n, done, found, power = len(h) - k + 1, 0, np.zeros(len(h) - k + 1, np.uint64), h
    for bit in range(k.bit_length()):  # sums of 1, 2, 4, ... neighbours; k is put together from them
        if k >> bit & 1:
            found += power[done : done + n] * np.uint64(pow(multiplier, done, 1 << 64))
            done += 1 << bit
        if done < k:
            step = 1 << bit
            power = power[:-step] + power[step:] * np.uint64(pow(multiplier, step, 1 << 64))
    return found


class Words:
    """The hashed words of several texts; doc: the text of each word, at: its place in it."""

    def __init__(self, texts: list[bytes], window: int, period: int) -> None:
        self.h, self.n = hash_words(texts)
        self.window, self.period = window, period
        self.doc = np.repeat(np.arange(len(texts)), self.n)
        self.at = np.arange(len(self.h)) - np.repeat(np.cumsum(self.n) - self.n, self.n)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of the anchors at cover positions, of texts that have a window."""
        k = self.window - self.period + 1
        found = rolled(self.h, k, _WORD)
        fits = (self.at[: len(found)] + k <= self.n[self.doc[: len(found)]]) & (self.n[self.doc[: len(found)]] >= self.window)
        covered = np.zeros(self.period, bool)
        covered[list(COVERS[self.period])] = True
        where = np.nonzero(fits & covered[self.at[: len(found)] % self.period])[0]
        return where, found[where]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the window at each word, and whether it lies in one text."""
        found = rolled(self.h, self.window, _WORD)
        return found, self.at[: len(found)] + self.window <= self.n[self.doc[: len(found)]]

    def checks(self) -> np.ndarray:
        return (rolled(_mixed(self.h + np.uint64(_CHECK)), self.window, _CHECK) >> np.uint64(32)).astype(np.uint32)


def _of_doc(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes told apart by document."""
    return hashes + _mixed(doc.astype(np.uint64) + np.uint64(_CHECK))


def _kept(text: bytes, keep: np.ndarray | None) -> tuple[str, int]:
    """SHA-256 (hex) of the kept words joined by single spaces, and how many words the text has."""
    sha, n, begun = hashlib.sha256(), 0, False
    for piece in pieces(text):
        words = piece.split()
        chosen = words if keep is None else list(compress(words, keep[n : n + len(words)].tolist()))
        n += len(words)
        if chosen:
            sha.update((b" " if begun else b"") + b" ".join(chosen))
            begun = True
    return sha.hexdigest(), n


#: What moves between steps. An own row (doc_id, text_hash, n_words, sha, held: hashes that the chunk knows about it) stands at idx in its
#: chunk. Other rows carry entries of one bucket and chunk: hashes (64 bits), checks (32 bits), ids, and whose they are (idx, 16 bits).
ROW = "bucket int, own boolean, chunk long, idx int, doc_id long, text_hash long, n_words long, sha string, held binary, hashes binary, checks binary, ids binary, whose binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("own", pa.bool_()), ("chunk", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string())] + [(c, pa.binary()) for c in ("held", "hashes", "checks", "ids", "whose")])


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


def _dealt(chunk: int, buckets: int, own: list[dict], hashes: np.ndarray, whose: np.ndarray, checks: np.ndarray | None = None, ids: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """A chunk's own rows and its entries by bucket (the hash's upper bits)."""
    bucket = (hashes >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64) if buckets > 1 else np.zeros(len(hashes), np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [{"bucket": (chunk * 0x9E3779B1 + i) % buckets, "own": True, "chunk": chunk, "idx": i, **x} for i, x in enumerate(own)]
    for b in np.nonzero(np.diff(ends))[0].tolist():
        at = order[ends[b] : ends[b + 1]]
        row = {"bucket": b, "own": False, "chunk": chunk, "hashes": hashes[at].tobytes(), "whose": whose[at].astype(np.uint16).tobytes()}
        if checks is not None:
            row |= {"checks": checks[at].tobytes(), "ids": ids[at].tobytes()}
        rows.append(row)
    for i in range(0, len(rows), 2000):
        yield _rows(rows[i : i + 2000])


def _chunks(batches: Iterator[pa.RecordBatch], size: int):
    """(chunk number, rows as dicts) of about size bytes of text each."""
    held: list[dict] = []
    now, n, task = 0, 0, TaskContext.get().partitionId() << 24
    for batch in slices(batches):
        for row in batch.to_pylist():
            row["raw"] = row["raw"] or b""
            held.append(row)
            now += len(row["raw"])
            if now >= size or len(held) >= MOST_DOCS:
                yield task + n, held
                held, now, n = [], 0, n + 1
    if held:
        yield task + n, held


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equal neighbours start in sorted arrays, and their end."""
    n = len(keys[0])
    new = np.ones(n, bool)
    for i, key in enumerate(keys):
        new[1:] = (key[1:] != key[:-1]) if i == 0 else new[1:] | (key[1:] != key[:-1])
    return np.append(np.nonzero(new)[0], n)


def _split(hashes: np.ndarray, doc: np.ndarray, docs: int) -> list[bytes]:
    """The hashes of each document, as bytes."""
    order = np.argsort(doc, kind="stable")
    cuts, hashes = np.searchsorted(doc[order], np.arange(docs + 1)), hashes[order]
    return [hashes[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def anchor_entries(docs: DataFrame, window: int, period: int, buckets: int) -> DataFrame:
    """Own rows of all documents, and each chunk's anchors by bucket; those of several documents of the chunk are held already.

    docs: doc_id, text_hash, raw. Of equal texts in a chunk that with the smallest id takes part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("substring", _TABLES.clear)
        for chunk, rows in _chunks(batches, CHUNK):
            best: dict[str, int] = {}
            for i, row in enumerate(rows):
                row["sha"], row["n_words"] = _kept(row["raw"], None)
                if row["doc_id"] is not None and row["n_words"] >= window and (row["sha"] not in best or row["doc_id"] < rows[best[row["sha"]]]["doc_id"]):
                    best[row["sha"]] = i
            index = np.array(list(best.values()), np.int64)
            words = Words([rows[i]["raw"] for i in best.values()], window, period)
            where, hashes = words.anchors()
            doc = words.doc[where]
            order = np.lexsort((doc, hashes))
            starts = _groups(hashes[order], doc[order])[:-1]  # each anchor once a document
            h, d = hashes[order][starts], doc[order][starts]
            cuts = _groups(h)
            several, first = np.diff(cuts) > 1, cuts[:-1]
            for i, known in zip(index.tolist(), _split(h[np.repeat(several, np.diff(cuts))], d[np.repeat(several, np.diff(cuts))], len(index))):
                rows[i]["held"] = known
            whose = np.where(several, ANY, index[d[first]]) if len(index) else np.empty(0, np.int64)
            yield from _dealt(chunk, buckets, [{k: v for k, v in row.items() if k != "raw"} for row in rows], h[first], whose)

    return docs.mapInArrow(run, ROW)


def window_entries(texts: DataFrame, window: int, period: int, buckets: int) -> DataFrame:
    """Own rows of the given documents, and each chunk's windows around shared anchors by bucket, with the smallest id there; the
    windows of its other documents are held. texts: doc_id, text_hash, raw, marks (their shared anchors).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("substring", _TABLES.clear)
        for chunk, rows in _chunks(batches, CHUNK):
            words = Words([row["raw"] for row in rows], window, period)
            where, hashes = words.anchors()
            marks = [np.frombuffer(row["marks"], np.uint64) for row in rows]
            marked = _of_doc(np.concatenate(marks), np.repeat(np.arange(len(rows)), [len(m) for m in marks]))
            where = where[np.isin(_of_doc(hashes, words.doc[where]), marked)]
            h, fits = words.windows()
            near = np.zeros(len(h), bool)
            for back in range(period):
                at = where - back
                near[at[(at >= 0) & (at < len(h))]] = True
            at = np.nonzero(near & fits)[0]
            h, check, doc = h[at], words.checks()[at], words.doc[at]
            ids = np.array([row["doc_id"] for row in rows], np.int64)
            order = np.lexsort((doc, ids[doc], check, h))
            starts = _groups(h[order], check[order], doc[order])[:-1]  # each window once a document
            h, check, doc = h[order][starts], check[order][starts], doc[order][starts]
            cuts = _groups(h, check)
            least = np.repeat(ids[doc[cuts[:-1]]], np.diff(cuts))
            later = ids[doc] > least
            for row, known in zip(rows, _split(h[later], doc[later], len(rows))):
                row["held"] = known
            now = np.nonzero(~later)[0]
            now = now[np.argsort(doc[now], kind="stable")]  # by document: its id repeats, which packs well
            yield from _dealt(chunk, buckets, [{k: row[k] for k in ("doc_id", "text_hash", "held")} for row in rows], h[now], doc[now], check[now], ids[doc[now]])

    return texts.mapInArrow(run, ROW)


def answers(entries: DataFrame) -> DataFrame:
    """Own rows as they are, and for each bucket and chunk the entries that others have too: by an equal hash in another chunk, or, where
    entries have ids, by an equal hash and check with a smaller id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("substring", _TABLES.clear)
        held: list[dict] = []

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = [len(row["whose"]) // 2 for row in held]
            hashes = np.frombuffer(b"".join(row["hashes"] for row in held), np.uint64)
            whose = np.frombuffer(b"".join(row["whose"] for row in held), np.uint16)
            if held[0]["ids"] is None:
                order = np.argsort(hashes, kind="stable")
                cuts = _groups(hashes[order])
                met = np.diff(cuts) > 1
                met |= np.bitwise_or.reduceat(whose[order] == ANY, cuts[:-1])
                hit = np.empty(len(hashes), bool)
                hit[order] = np.repeat(met, np.diff(cuts))
                hit &= whose != ANY
            else:
                checks, ids = np.frombuffer(b"".join(row["checks"] for row in held), np.uint32), np.frombuffer(b"".join(row["ids"] for row in held), np.int64)
                order = np.lexsort((ids, checks, hashes))
                cuts = _groups(hashes[order], checks[order])
                hit = np.empty(len(hashes), bool)
                hit[order] = ids[order] > np.repeat(ids[order][cuts[:-1]], np.diff(cuts))
            ends, out = np.cumsum(lengths).tolist(), []
            for row, a, b in zip(held, [0, *ends], ends):
                if hit[a:b].any():
                    out.append({"own": False, "chunk": row["chunk"], "hashes": hashes[a:b][hit[a:b]].tobytes(), "whose": whose[a:b][hit[a:b]].tobytes()})
            held.clear()
            if out:
                yield _rows(out)

        for batch in batches:
            own = np.asarray(batch.column("own").to_numpy(zero_copy_only=False), bool)
            if own.any():
                yield batch.filter(pa.array(own))
            for row in batch.filter(pa.array(~own)).select(["bucket", "chunk", "hashes", "checks", "ids", "whose"]).to_pylist():
                if held and held[-1]["bucket"] != row["bucket"]:
                    yield from flush()
                held.append(row)
        if held:
            yield from flush()

    return entries.repartition("bucket").sortWithinPartitions("bucket", "own").mapInArrow(run, ROW)


def by_document(answered: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_words, sha, marks binary: each own row with all hashes that were held or answered; no mark is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, hashes, whose = None, np.empty(0, np.uint64), np.empty(0, np.uint16)
        parts: list[tuple[bytes, bytes]] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["chunk"] != chunk:
                    chunk, parts, whose = row["chunk"], [], None
                if not row["own"]:
                    parts.append((row["hashes"], row["whose"]))
                    continue
                if whose is None:
                    whose = np.frombuffer(b"".join(w for _, w in parts), np.uint16)
                    order = np.argsort(whose, kind="stable")
                    hashes, whose = np.frombuffer(b"".join(h for h, _ in parts), np.uint64)[order], whose[order]
                a, b = np.searchsorted(whose, [row["idx"], row["idx"] + 1]).tolist()
                marks = (row["held"] or b"") + hashes[a:b].tobytes()
                out.append({k: row[k] for k in ("doc_id", "text_hash", "n_words", "sha")} | {"marks": marks or None})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA_MARKS)

    rows = answered.select("chunk", "own", "idx", "doc_id", "text_hash", "n_words", "sha", "held", "hashes", "whose")
    return rows.repartition("chunk").sortWithinPartitions("chunk", "own").mapInArrow(run, MARKS)


def only(raw: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of raw that may be wanted (doc_id, text_hash), so that a join moves few other texts.

    A bitmap of the wanted rows' hashes, eight bits a row and MOST_BITS at most, is made by pages on the executors and broadcast: 32 MB
    however many rows there are. Rows let through by chance go in the join; where nearly all bits are set it lets all through.
    """
    spark, key = raw.sparkSession, F.xxhash64("doc_id", "text_hash")
    n = wanted.count()
    bits = min(MOST_BITS, 1 << max(16, (8 * n).bit_length()))
    page = bits // PAGES

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, np.zeros(0, bool)
        for batch in batches:
            places = np.asarray(batch.column("place"))
            for part in np.split(places, np.nonzero(np.diff(places // page))[0] + 1):
                if len(part):
                    if now != part[0] // page:
                        if now is not None:
                            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()])], ["page", "bits"])
                        now, held = int(part[0] // page), np.zeros(page, bool)
                    held[part % page] = True
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([np.packbits(held, bitorder="little").tobytes()])], ["page", "bits"])

    places = wanted.select(F.pmod(key, F.lit(bits)).alias("place"))
    pages = places.repartition(F.floor(F.col("place") / page)).sortWithinPartitions("place").mapInArrow(fill, "page long, bits binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    for row in pages.toLocalIterator():
        bitmap[row.page * page // 8 : (row.page + 1) * page // 8] = np.frombuffer(row.bits, np.uint8)
    known = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = np.asarray(batch.column("place"))
            yield batch.filter(pa.array(known.value[place // 8] >> (place % 8).astype(np.uint8) & 1 == 1))

    keyed = raw.where("doc_id IS NOT NULL").withColumn("place", F.pmod(key, F.lit(bits)))
    return keyed.mapInArrow(run, keyed.schema).drop("place")


MARKS = "doc_id long, text_hash long, n_words long, sha string, marks binary"
_SCHEMA_MARKS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("marks", pa.binary())])


def cut(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, text_hash, n_removed long, kept_sha256 string, spans array of (start, end): the words that go, end excluded.

    texts: doc_id, text_hash, raw, marks (the windows that go).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("substring", _TABLES.clear)
        for _, rows in _chunks(batches, CHUNK):
            words = Words([row["raw"] for row in rows], window, PERIOD)
            h, fits = words.windows()
            marks = [np.frombuffer(row["marks"], np.uint64) for row in rows]
            marked = _of_doc(np.concatenate(marks), np.repeat(np.arange(len(rows)), [len(m) for m in marks]))
            at = np.nonzero(fits & np.isin(_of_doc(h, words.doc[: len(h)]), marked))[0]
            depth = np.zeros(len(words.h) + 1, np.int64)
            np.add.at(depth, at, 1)
            np.add.at(depth, at + window, -1)
            keep = np.cumsum(depth)[:-1] == 0
            out, begin = [], 0
            for row, n in zip(rows, words.n.tolist()):
                own, begin = keep[begin : begin + n], begin + n
                edge = np.flatnonzero(np.diff(np.concatenate([[True], own, [True]])))
                spans = [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]
                out.append({"doc_id": row["doc_id"], "text_hash": row["text_hash"], "n_removed": int(n - own.sum()), "kept_sha256": _kept(row["raw"], own)[0], "spans": spans})
            yield pa.RecordBatch.from_pylist(out, schema=_SCHEMA_CUT)

    return texts.mapInArrow(run, CUT)


CUT = "doc_id long, text_hash long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
_SCHEMA_CUT = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _buckets(docs: DataFrame) -> int:
    """So many that a bucket of anchors has BUCKET bytes: three in seven words, of six letters or so, are entries of ten bytes."""
    size = docs.agg(F.sum(F.octet_length("raw")).alias("n")).first().n or 0
    return 1 << max(LEAST_BUCKETS.bit_length() - 1, (size // BUCKET).bit_length())


def dedupe(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, buckets: int | None = None) -> DataFrame:
    """doc_id, n_words, n_removed long, kept_sha256 string, spans: the passages each document loses to earlier ones.

    period: a key of COVERS below window. buckets: a power of two; by default of the texts' size.
    """
    if period not in COVERS or not period < window:
        raise ValueError(f"period must be one of {sorted(COVERS)} and below the window")
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("raw"))
    buckets = buckets or _buckets(raw)
    own = materialise(by_document(materialise(answers(anchor_entries(raw, window, period, buckets)), "anchors")), "documents")
    known = own.where("doc_id IS NOT NULL")
    first = known.groupBy("sha").agg(F.min("doc_id").alias("doc_id"))
    wanted = known.where("marks IS NOT NULL").join(first, ["sha", "doc_id"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    wanted = materialise(wanted.select("doc_id", "text_hash", "marks"), "wanted")
    among = materialise(only(raw, wanted).join(wanted, ["doc_id", "text_hash"]).transform(window_entries, window, period, buckets).transform(answers), "windows")
    gone = by_document(among).where("marks IS NOT NULL").dropDuplicates(["doc_id", "text_hash"])
    gone = materialise(gone.select("doc_id", "text_hash", "marks"), "gone")
    changed = materialise(cut(only(raw, gone).join(gone, ["doc_id", "text_hash"]), window), "cut").dropDuplicates(["doc_id", "text_hash"])
    copy = F.col("first").isNull() & (F.col("n_words") >= window)
    named = known.join(first.withColumn("first", F.lit(True)), ["sha", "doc_id"], "left").join(changed, ["doc_id", "text_hash"], "left")
    nothing, all_of_it = F.array().cast("array<struct<start:long,end:long>>"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    found = named.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(copy, all_of_it).otherwise(F.coalesce("spans", nothing)).alias("spans"),
    )
    unnamed = own.where("doc_id IS NULL").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha").alias("kept_sha256"), nothing.alias("spans"))
    return found.union(unnamed)
