import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from meetlens.llm import packing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


LIBRARY = Tokenizer.from_file(TOKENIZER)


def plain(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check(pieces, docs):
    """Each id in exactly one piece, sequences gapless and full but for powers of two."""
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(plain(r.text))
    total = {}
    for r in pieces:
        own = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        assert own and r.length > 0
        assert any(zlib.crc32(np.array(x[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for x in own)
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == {k: sum(map(len, v)) for k, v in ids.items()}
    for seq in {r.sequence_id for r in pieces}:
        own = sorted((r.offset, r.length) for r in pieces if r.sequence_id == seq)
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        size = sum(n for _, n in own)
        assert size == packing.WINDOW or size & (size - 1) == 0


def test_pieces(spark, awkward, empty):
    check(packing.pack(awkward, TOKENIZER).collect(), awkward)
    assert packing.pack(empty, TOKENIZER).collect() == []


def test_driver_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check(packing.pack(docs, TOKENIZER, shard_tokens=50_000).collect(), docs)


def test_encoder_equals_the_tokenizer():
    odd = ["", "  ", "Ελλάς ΣΟΦΟΣ.", "İI", "a\x1cb c", "a\x85b", "don't I'll 's", "<|endoftext|> a", "hello <|endoftext|>", "<|startoftext|>hi", "x<|endoftext|><|startoftext|>Y.", "<|EndOfText|>", "12 345abc6", "ﬁ ǅ ẞ", "''s ''", None, "word, WORD; word!!! _a_ a_", "été É x́", "a\x00b"]
    for text, found in zip(odd, packing.encoder(TOKENIZER).encode(pa.array(odd))):
        assert [*found.tolist(), packing.END_ID] == plain(text), text


def test_neighbours_equal_brute_force():
    """All terms of the seed count, be they frequent (dense rows) or rare (postings)."""
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, rng.integers(3, 300), rng.integers(5, 40)).astype(np.uint16) for _ in range(90)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=300)
    idf, mean = np.log1p((90 - df + 0.5) / (df + 0.5)).astype(np.float32), float(np.mean([len(d) for d in docs]))
    shard = packing.Shard(docs, idf, mean)
    assert 0 < len(shard.rows) < 300
    shard.free[[0, 7]] = False

    def impact(d, t):
        tf = int((docs[d] == t).sum())
        return idf[t] * tf * (packing.K1 + 1) / (tf + packing.K1 * (1 - packing.B + packing.B * len(docs[d]) / mean)) if tf else 0.0

    for seed in range(12):
        want = {d: sum(impact(d, t) for t in set(docs[seed].tolist())) for d in range(90) if shard.free[d]}
        found = shard.neighbours(seed)
        assert 0 not in found and 7 not in found
        assert np.allclose([want[d] for d in found], sorted((x for x in want.values() if x > 0), reverse=True)[: len(found)], rtol=1e-3)


def test_neighbours_from_anywhere_meet(spark):
    """Documents of a subject that are dealt over all files share sequences, though a shard holds a tenth of them."""
    rng = np.random.default_rng(0)
    known = sorted(t[:-4] for t in packing.encoder(TOKENIZER).plain.get_vocab() if t.endswith("</w>") and t[:-4].isalpha() and t.isascii() and len(t) > 9)
    vocabulary, rows = rng.permutation(known), []
    for i in range(600):
        subject = i % 30
        words = list(vocabulary[12 * subject : 12 * subject + 12][rng.integers(0, 12, 20)]) + list(vocabulary[rng.integers(400, 3000, 20)])
        rows.append((i, " ".join(rng.permutation(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(12, "doc_id")
    pieces = packing.pack(docs, TOKENIZER, window=512, shard_tokens=20_000).collect()
    of = {}
    for r in pieces:
        of.setdefault(r.sequence_id, set()).add(r.doc_id)
    pairs = [(a % 30, b % 30) for own in of.values() for a in own for b in own if a < b]
    assert np.mean([a == b for a, b in pairs]) > 0.3  # 0.03 by chance


def test_strongest_terms_of_many_documents_at_once():
    """Against each document alone, with ties and documents whose terms do not count."""
    rng = np.random.default_rng(3)
    for kind in ("<u2", "<u4"):
        force = np.where(rng.random(300) < 0.7, rng.integers(1, 4, 300), 0).astype(np.float32)
        docs = [rng.integers(0, 300, n).astype(kind) for n in rng.integers(1, 60, 200)] + [np.flatnonzero(force == 0)[:5].astype(kind)]
        want = []
        for d in docs:
            terms, counts = packing.counted(d)
            by = sorted((-f, t) for f, t in zip(packing.impacts(counts, force[terms], len(d), 40.5).tolist(), terms.tolist()) if f > 0)
            want.append(([t for _, t in by] + [-1, -1])[:2])
        assert packing.strongest(docs, force, 40.5).tolist() == want


def test_a_worker_remembers_what_it_has_met(monkeypatch):
    """Words of many batches are merged once; before, all were forgotten after 250,000."""
    enc, learned = packing.WordEncoder(TOKENIZER), []
    words = enc._words
    monkeypatch.setattr(enc, "_words", lambda new: learned.extend(new) or words(new))
    letters = np.random.default_rng(5).integers(ord("a"), ord("z") + 1, (300_000, 9), np.uint8).tobytes().decode()
    texts = [" ".join(letters[i : i + 9] for i in range(at, at + 900_000, 9)) for at in range(0, 2_700_000, 900_000)]
    first = enc.encode(pa.array(texts[:1]))[0]
    for text in texts[1:]:
        enc.encode(pa.array([text]))
    learned.clear()
    assert np.array_equal(enc.encode(pa.array(texts[:1]))[0], first)
    assert learned == []


def test_remembered_units_are_the_tokenizers(monkeypatch):
    """Again and again, with slices, chunks too long to keep, units that share a sum, and a memory that is full after each batch."""
    odd = ["", " \t", "Ab ab, ab!!! ab", "a" * 64 + " " + "a" * 65 + "?", "x" * 300 + "=" * 80, "1234 ab's ab1 Ångström. ÅNGSTRÖM", None, "word" + "?!" * 40, "ab\x00 ab", "  İx b"]
    for kept, factor in ((1 << 20, 1), (1 << 20, 0), (5, 1)):
        monkeypatch.setattr(packing, "CACHE", kept)
        enc = packing.WordEncoder(TOKENIZER)
        enc.units.factors[0] *= np.uint64(factor)
        for at in (0, 3, 0, 5):
            for text, found in zip(odd[at:], enc.encode(pa.array(odd).slice(at))):
                assert [*found.tolist(), packing.END_ID] == plain(text), text
