"""Byte-level BPE encoding and decoding by a local rank file.

Long texts are first cut at safe boundaries: before a single space that stands between two non-space characters. No match
of the pre-token pattern contains such a space but at its start, so the pieces' ids are the text's ids. Long runs of white
space are taken out before the pattern sees them (its look-ahead would overflow the library's stack): such a run is one match,
without its last character if a non-space character follows it.

Defined cases: null and empty texts have no ids; ids of rows with a null id or repeated rows are given for each row;
decoding returns raw bytes, which need not be UTF-8; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from meetlens.llm.common import hold, slices

#: Characters of a text above which it is cut, and about which pieces are that long.
PIECE = 1 << 15
_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: White space as the pattern has it (Unicode's property), in runs that are taken out.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{256,}")


class BytePairs:
    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes = {i: b for b, i in ranks.items()}
        self.names = [str(i) for i in range(max(ranks.values()) + 1)]

    def encode(self, text: str | None) -> list[int]:
        """Ids as of one call for the whole text; special tokens are ordinary text."""
        if not text:
            return []
        out, at = [], 0
        for run in _RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            for piece in pieces(text[at : run.start()]):
                out += self.encoding.encode_ordinary(piece)
            out += self.encoding._encode_single_piece(text[run.start() : end])
            at = end
        for piece in pieces(text[at:]):
            out += self.encoding.encode_ordinary(piece)
        return out

    def decode(self, ids: list[int]) -> bytes:
        """Raw bytes; KeyError for an id that the ranks do not have."""
        of = self.bytes
        return b"".join([of[i] for i in ids])


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


_CODECS: dict[tuple[str, str], BytePairs] = {}


def codec(path: str, pattern: str) -> BytePairs:
    hold("byte pairs", _CODECS.clear)
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = BytePairs(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(tokens: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, bytes binary; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([own.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {tokens.schema['doc_id'].dataType.simpleString()}, bytes binary")


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: both ways in one pass, so the ids of no text leave the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks, pattern)
        names = own.names
        for batch in slices(batches, 256):
            n, ids_hash, text_hash = [], [], []
            for text in batch.column("text").to_pylist():
                ids = own.encode(text)
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(" ".join([names[i] for i in ids]).encode()).hexdigest())
                text_hash.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash)], ["doc_id", *(x.split()[0] for x in DIGEST.split(", "))])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {DIGEST}")
