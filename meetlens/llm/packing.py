"""Lexical retrieval packing: windows filled with BM25 neighbours of a seed document.

Four steps. Texts become token ids, written once to the shared folder. Document frequencies, document count and mean
length are summed over all documents; their size is bounded by the vocabulary, so they are broadcast. Documents are then
dealt by content: by their two strongest terms (BM25 impact among terms that other documents have), in ranges, so a term of
very many documents is split by the second term and then by the text's hash, and neighbours from anywhere in the table come
to stand side by side. Each partition is cut into shards of bounded tokens; a shard's inverted index scores all terms of the
document that opens a window, returns its best unused neighbours, and they fill the window in that order. A document that does
not fit is cut, and its rest opens the next window, so only the end of a shard is left over; that is laid into sequences whose
lengths are descending powers of two, which need no padding.

Defined cases: null and empty texts hold only the end id; repeated rows are packed each for itself; a null id is kept; an
empty table gives no rows; extra columns are ignored. Shards depend on the token table, which is written once, and on its
order by content, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetlens.llm.common import columns, hold, materialise, slices

WINDOW, END_ID, SHARD_TOKENS, SHARD_DOCS, K1, B = 4096, 2, 2_000_000, 1 << 15, 1.2, 0.75
#: A term that one document in so many of a shard has is held as a row over all of the shard's documents, in so many bytes of rows.
DENSE, DENSE_BYTES = 8, 1 << 25
#: Units that a worker remembers.
CACHE = 1_000_000


class Units:
    """Ids of the units that a worker has met, in a few arrays: 30 bytes a unit or so, where a dictionary of strings takes 200.

    A unit is known by two sums of its bytes modulo 2**64, each byte times a random number that its place has. Two different units
    share both sums with a chance under 2**-110. Units of over LONG bytes are found anew each time.
    """

    LONG = 64

    def __init__(self, kind: str):
        self.factors = np.random.default_rng().integers(0, 1 << 64, (2, self.LONG), np.uint64)
        self.first, self.second = np.zeros((2, 0), np.uint64)  # the sums, by the first one
        self.places = np.zeros(0, np.int64)  # where in ids, how many: two numbers of 32 bits as one
        self.ids, self.used = np.zeros(1 << 16, kind), 0

    def full(self) -> bool:
        return len(self.first) > CACHE or self.used > 8 * CACHE

    def sums(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both sums of each unit, and whether it is short enough to be kept."""
        stops = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1]
        raw = np.frombuffer(units.buffers()[2] or b"", np.uint8)[stops[0] : stops[-1]].astype(np.uint64) + np.uint64(1)
        stops = stops - stops[0]
        sizes = np.diff(stops)
        place = np.minimum(np.arange(len(raw), dtype=np.int32) - np.repeat(stops[:-1], sizes), self.LONG - 1)
        first, second = (np.diff(np.append(np.uint64(0), np.cumsum(raw * x[place]))[stops]) for x in self.factors)
        return first, second, sizes <= self.LONG

    def append(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The places of units whose ids follow each other."""
        start, self.used = self.used, self.used + len(ids)
        if self.used > len(self.ids):
            self.ids = np.append(self.ids[:start], np.zeros(self.used + self.used // 4 - start, self.ids.dtype))
        self.ids[start : self.used] = ids
        return np.stack([start + np.cumsum(sizes) - sizes, sizes], axis=1).astype(np.int32)

    def find(self, units: pa.Array, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The place of each of the units, which differ; learn: the ids of units, one after the other, and each one's number of ids."""
        if not len(units):
            return np.zeros((0, 2), np.int32)
        first, second, short = self.sums(units)
        out, known = np.zeros((len(units), 2), np.int32), np.zeros(len(units), bool)
        if len(self.first):
            order = np.argsort(first)
            at = np.empty(len(units), np.int64)
            at[order] = np.minimum(np.searchsorted(self.first, first[order]), len(self.first) - 1)
            known = short & (self.first[at] == first) & (self.second[at] == second)
            out[known] = self.places[at[known]].view(np.int32).reshape(-1, 2)
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = self.append(*learn(units.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist()))
            new = new[short[new]]
            new = new[np.argsort(first[new])]
            at = np.searchsorted(self.first, first[new]) + np.arange(len(new))
            old = np.ones(len(self.first) + len(new), bool)
            old[at] = False
            self.first, self.second, self.places = (_merged(old, at, *x) for x in ((self.first, first[new]), (self.second, second[new]), (self.places, out[new].view(np.int64)[:, 0])))
        return out


def _merged(old: np.ndarray, at: np.ndarray, before: np.ndarray, new: np.ndarray) -> np.ndarray:
    out = np.empty(len(old), before.dtype)
    out[old], out[at] = before, new
    return out


def laid(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ids that start there, one after the other, and where each ends."""
    ends = np.cumsum(sizes, dtype=np.int32)
    return ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)], ends


class WordEncoder:
    """Ids of whole texts, by a tokenizer that lower-cases, drops white space and merges inside its pre-tokens.

    Such a tokenizer gives a text the ids of its white-space-separated chunks, one after the other, so each distinct unit is
    encoded once and remembered, and Arrow and numpy split the texts and lay out the ids. A chunk that is a word of Latin
    letters, perhaps with one mark of punctuation behind, is two units: the lower-cased word and the mark. New words go
    through the file's merges many to a line, without the steps that change nothing in a lower-case word, and are told apart
    by their last token, which bears the end of a word. Any other chunk is a unit that the whole tokenizer encodes.
    """

    LINE, WORD, MARKS = 256, r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}]+[.,;:!?]?$", ".,;:!?"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        parts |= {"normalizer": None, "post_processor": None, "added_tokens": []}
        parts["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *(x for x in parts["pre_tokenizer"]["pretokenizers"] if x["type"] == "ByteLevel")]}
        self.merges = Tokenizer.from_str(json.dumps(parts))
        vocabulary = self.plain.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.kind = _kind(self.size)
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.units = Units(self.kind)

    def _wholly(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [x.ids for x in self.plain.encode_batch_fast(new, add_special_tokens=False)]
        return np.array([i for x in found for i in x], self.kind), np.fromiter(map(len, found), np.int64, len(found))

    def _mixed(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that are not a word with one mark; an ASCII word before any run of punctuation is two units still."""
        parts = {}
        for i, c in enumerate(new):
            word = c.rstrip(punctuation)
            if len(word) < len(c) and word.isascii() and word.isalpha():
                parts[i] = word.lower(), c[len(word) :]
        places, units, parted = np.zeros((len(new), 2, 2), np.int32), self.units, list(parts)
        for k, learn in enumerate((self._words, self._wholly)):
            coded = pa.array([x[k] for x in parts.values()], pa.string()).dictionary_encode()
            places[parted, k] = units.find(coded.dictionary, learn)[coded.indices.to_numpy()]
        used, others = units.used, [i for i in range(len(new)) if i not in parts]
        places[others, 0] = units.append(*self._wholly([new[i] for i in others]))
        ids, _ = laid(units.ids, *places.reshape(-1, 2).T)
        units.used = used  # find() appends them again, with the parted ones
        return ids, places[:, :, 1].sum(1)

    def _words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines, out = [new[i : i + self.LINE] for i in range(0, len(new), self.LINE)], []
        for line, found in zip(lines, self.merges.encode_batch_fast([" ".join(x) for x in lines], add_special_tokens=False)):
            ids = np.array(found.ids, self.kind)
            sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            out.append((ids, sizes) if len(sizes) == len(line) else self._wholly(line))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; null is empty."""
        if self.units.full():
            self.units = Units(self.kind)
        lists = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        coded = lists.flatten().dictionary_encode()
        chunks, at = coded.dictionary, coded.indices.to_numpy()
        if not len(at):
            return [np.zeros(0, self.kind)] * len(texts)
        easy = pc.match_substring_regex(chunks, self.WORD)
        is_easy = easy.to_numpy(zero_copy_only=False)
        simple = chunks.filter(easy)
        words = pc.utf8_lower(pc.ascii_rtrim(simple, self.MARKS)).dictionary_encode()
        marks = self.units.find(pa.array(list(self.MARKS)), self._wholly)
        places = np.zeros((len(chunks), 2, 2), np.int32)
        places[is_easy, 0] = self.units.find(words.dictionary, self._words)[words.indices.to_numpy()]
        places[~is_easy, 0] = self.units.find(chunks.filter(pc.invert(easy)), self._mixed)
        for mark, place in zip(self.MARKS, marks):
            places[np.flatnonzero(is_easy)[pc.ends_with(simple, mark).to_numpy(zero_copy_only=False)], 1] = place
        own, ends = laid(self.units.ids, *places.reshape(-1, 2).T)
        ends = np.append(np.int32(0), ends[1::2])  # both units of a chunk stand together now
        flat, ends = laid(own, ends[at], np.diff(ends)[at])
        stops = np.append(0, ends)[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        return [flat[a:b] for a, b in zip(stops, stops[1:])]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """A worker builds the encoder of a file once."""
    hold("packing", _ENCODERS.clear)
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 16 or 32 bits): each text's ids, then end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = _kind(max(enc.size, end_id + 1))
        end = np.array([end_id], kind).tobytes()
        for batch in slices(batches, 2000):
            found = enc.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x.astype(kind, copy=False).tobytes() + end for x in found], pa.binary())], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def _kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def statistics(tokens: DataFrame, size: int) -> tuple[np.ndarray, int, float]:
    """Document frequency of each id, documents and mean length, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, df, docs, total = _kind(size), np.zeros(size, np.int64), 0, 0
        first, order = np.zeros(size, np.int64), np.arange(1 << 16)
        for batch in slices(batches):
            for (raw,) in zip(*columns(batch, "ids")):
                ids = np.frombuffer(raw, kind)
                if len(ids) > len(order):
                    order = np.arange(2 * len(ids))
                at = order[: len(ids)]
                first[ids] = at
                df[ids[first[ids] == at]] += 1  # each id once: where it was written last
                docs, total = docs + 1, total + len(ids)
        used = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, [-1, -2])), pa.array(np.append(df[used], [docs, total]))], ["term", "n"])

    found = tokens.select("ids").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, at = np.zeros(size, np.int64), {r.term: r.n for r in found}
    docs, total = at.pop(-1, 0), at.pop(-2, 0)
    for term, n in at.items():
        df[term] = n
    return df, docs, total / max(docs, 1)


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids in order, and how often each is there; numbers of 16 bits are sorted by radix."""
    own = np.sort(ids, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    return own[first], np.diff(first, append=len(own))


def impacts(counts: np.ndarray, idf: np.ndarray, length, mean: float) -> np.ndarray:
    """BM25 impacts of terms that a document of this length has so many times."""
    return idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / max(mean, 1)))


def strongest(docs: list[np.ndarray], force: np.ndarray, mean: float, most: int = 2) -> np.ndarray:
    """The `most` terms of highest impact of each document (rows), ties to the smaller id, -1: none; force: each term's, zero if no term counts.

    Documents of ids of one kind, none of them empty, are sorted as one array of document and id.
    """
    lengths = np.array([len(d) for d in docs])
    ids = np.concatenate(docs)
    bits, kind = 8 * ids.itemsize, f"<u{2 * ids.itemsize}"
    own = np.sort(np.repeat(np.arange(len(docs)).astype(kind), lengths) << np.array(bits, kind) | ids)
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    counts, own = np.diff(first, append=len(own)), own[first]
    terms, doc = (own & np.array((1 << bits) - 1, kind)).astype(np.int64), (own >> np.array(bits, kind)).astype(np.int64)
    now, starts = impacts(counts, force[terms], lengths[doc], mean), np.searchsorted(doc, np.arange(len(docs)))
    out = []
    for _ in range(most):
        best = np.maximum.reduceat(now, starts)
        at = np.flatnonzero(now == best[doc])
        at = at[np.searchsorted(doc[at], np.arange(len(docs)))]
        out.append(np.where(best > 0, terms[at], -1))
        now[at] = 0
    return np.stack(out, axis=1)


def routed(tokens: DataFrame, kind: str, shared) -> DataFrame:
    """The tokens with first, second (strongest terms that another document has, -1: none) and tie (a hash of the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("routing", lambda: None)  # the encoder goes
        idf, mean, several = shared.value
        common = np.where(several, idf, 0)
        for batch in slices(batches):
            if batch.num_rows:
                raw = batch.column("ids").to_pylist()
                first, second = strongest([np.frombuffer(x, kind) for x in raw], common, mean).T
                made = [pa.array(x, pa.int64()) for x in (first, second, list(map(zlib.crc32, raw)))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], ["doc_id", "ids", "first", "second", "tie"])

    return tokens.mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, ids binary, first long, second long, tie long")


class Shard:
    """Inverted index over a bounded set of documents, with the impacts of BM25 laid into the postings."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        terms, counts = [], []
        for d in docs:
            t, n = counted(d)
            terms.append(t)
            counts.append(n.astype(np.float32))
        sizes = np.array([len(t) for t in terms], np.int64)
        self.starts = np.append(0, np.cumsum(sizes))
        self.term = np.concatenate(terms) if docs else np.zeros(0, np.uint16)
        force = np.concatenate(counts) if docs else np.zeros(0, np.float32)
        del terms, counts
        owner = np.repeat(np.arange(len(docs), dtype=np.int32), sizes)
        for i, d in enumerate(docs):  # in place, a document at a time
            at = slice(self.starts[i], self.starts[i + 1])
            force[at] = impacts(force[at], idf[self.term[at]], np.float32(len(d)), mean)
        order = np.argsort(self.term, kind="stable")
        self.bounds = np.searchsorted(self.term[order], np.arange(len(idf) + 1)).astype(np.int32)
        self.posting_doc, self.posting_impact = owner[order], force[order]
        del owner, force, order
        self.free, self.n = np.ones(len(docs), bool), len(docs)
        often = np.flatnonzero(np.diff(self.bounds) * DENSE > self.n)
        if len(often) * self.n * 4 > DENSE_BYTES:  # the most frequent terms save most
            often = np.sort(often[np.argsort(-np.diff(self.bounds)[often], kind="stable")][: DENSE_BYTES // (4 * self.n)])
        self.row, self.rows = np.full(len(idf), -1, np.int32), np.zeros((len(often), self.n), np.float32)
        self.row[often] = np.arange(len(often))
        for k, t in enumerate(often):
            at = slice(self.bounds[t], self.bounds[t + 1])
            self.rows[k, self.posting_doc[at]] = self.posting_impact[at]

    def scores(self, seed: int) -> np.ndarray:
        """Of every document for all terms of the seed."""
        own = self.term[self.starts[seed] : self.starts[seed + 1]].astype(np.int64)
        row = self.row[own]
        out = self.rows[row[row >= 0]].sum(0) if (row >= 0).any() else np.zeros(self.n, np.float32)
        few = own[row < 0]
        sizes = self.bounds[few + 1] - self.bounds[few]
        at = np.repeat(self.bounds[few] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return out + np.bincount(self.posting_doc[at], self.posting_impact[at], self.n)

    def neighbours(self, seed: int, wanted: int = 64) -> list[int]:
        """The `wanted` best unused documents that share a term with the seed, best first; ties to the earlier document."""
        scores = self.scores(seed) * self.free
        top = np.argpartition(-scores, wanted)[:wanted] if self.n > wanted else np.arange(self.n)
        top = top[scores[top] > 0]
        return top[np.lexsort((top, -scores[top]))].tolist()


def fill(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length): every id in exactly one piece, each sequence full but for powers of two."""
    shard, sequences, current, room, following = Shard(docs, idf, mean), [], [], window, 0
    near: list[int] = []
    seed = None
    while True:
        while near and not shard.free[near[0]]:
            near.pop(0)
        if not near and seed is not None and current:
            near = shard.neighbours(seed)
        if near:
            doc = near.pop(0)
        else:
            while following < shard.n and not shard.free[following]:
                following += 1
            if following == shard.n:
                break
            doc = following
        shard.free[doc] = False
        if seed is None or not current:
            seed, near = doc, []
        start, rest = 0, len(docs[doc])
        while rest:
            take = min(rest, room)
            current.append((doc, start, take))
            start, rest, room = start + take, rest - take, room - take
            if not room:
                sequences.append(current)
                current, room, near = [], window, []
                seed = doc if rest else None
    pieces = current
    while pieces:  # what is left: descending powers of two
        left = sum(p[2] for p in pieces)
        size, own = 1 << (left.bit_length() - 1), []
        while size:
            doc, start, length = pieces.pop(0)
            take = min(length, size)
            own.append((doc, start, take))
            size -= take
            if take < length:
                pieces.insert(0, (doc, start + take, length - take))
        sequences.append(own)
    return sequences


PIECES = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    size = max(encoder(tokenizer).size, end_id + 1)
    tokens = materialise(tokenize(docs, tokenizer, end_id), "tokens")
    df, n, mean = statistics(tokens, size)
    shared = tokens.sparkSession.sparkContext.broadcast((np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32), mean, df > 1))
    order = ("first", "second", "tie", "doc_id")
    dealt = routed(tokens, _kind(size), shared).repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("shards", lambda: None)
        (idf, mean, _), kind = shared.value, _kind(size)
        part, number = TaskContext.get().partitionId() << 40, 0

        def packed() -> pa.RecordBatch:
            rows = []
            for k, pieces in enumerate(fill(shard, idf, mean, window)):
                at = 0
                for doc, start, length in pieces:
                    crc = zlib.crc32(shard[doc][start : start + length].astype("<u4").tobytes())
                    rows.append((ids[doc], start, length, crc, len(shard[doc]), part + (number << 20) + k, at))
                    at += length
            made = [pa.array(x, pa.int64()) for x in list(zip(*rows))[1:]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind_of_id), *made], ["doc_id", *(x.split()[0] for x in PIECES.split(", "))])

        ids, shard, held, kind_of_id = [], [], 0, None
        for batch in slices(batches):
            kind_of_id = batch.schema.field("doc_id").type
            for doc_id, raw in zip(*columns(batch, "doc_id", "ids")):
                ids.append(doc_id)
                shard.append(np.frombuffer(raw, kind))
                held += len(shard[-1])
                if held >= shard_tokens or len(ids) >= SHARD_DOCS:
                    yield packed()
                    ids, shard, held, number = [], [], 0, number + 1
        if ids:
            yield packed()

    return dealt.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECES}")
