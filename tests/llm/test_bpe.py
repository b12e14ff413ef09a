import hashlib
import unicodedata  # noqa: F401  texts below hold composed and decomposed letters

import public_tokenizers
import regex

from meetlens.llm import bpe

SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"  # the property, which \\s of this library exceeds
ARGS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def brute(text):
    """Merges of each match by rank, pair by pair."""
    ranks = {b: i for i, b in bpe.codec(*ARGS).bytes.items()}
    out = []
    for m in regex.findall(regex.sub(r"\\s", SPACE, ARGS[1].replace(r"[^\s", r"[^" + SPACE[1:-1])).replace(r"\S", f"[^{SPACE[1:-1]}]"), text or ""):
        parts = [bytes([b]) for b in m.encode()]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 30), i))
            if parts[best] + parts[best + 1] not in ranks:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        out += [ranks[p] for p in parts]
    return out


def test_equals_brute_force(awkward, empty):
    texts = {(r.doc_id, r.text) for r in awkward.collect() if len(r.text or "") < 10_000}
    found = {r.doc_id: r.ids for r in bpe.encode(awkward, *ARGS).collect()}
    for i, text in texts:
        assert found[i] == brute(text)
    assert bpe.encode(empty, *ARGS).collect() == []


def test_round_trip(awkward):
    rows = bpe.round_trip(awkward, *ARGS).collect()
    want = sorted((hashlib.sha256((r.text or "").encode()).hexdigest(), r.doc_id) for r in awkward.collect() if r.doc_id)
    assert sorted((r.decoded_sha256, r.doc_id) for r in rows if r.doc_id) == want
    ids = bpe.encode(awkward, *ARGS)
    assert sorted(hashlib.sha256(r.bytes).hexdigest() for r in bpe.decode(ids, *ARGS).collect()) == sorted(r.decoded_sha256 for r in rows)


def test_cuts_change_nothing():
    text = "one two  three\n four 'll 1 2 …  x" * 50 + " " * 30 + "end of it"
    whole = bpe.codec(*ARGS).encoding.encode_ordinary(text)
    for size in (1, 7, 64):
        found = [p for p in bpe.pieces(text, size)]
        assert "".join(found) == text
        assert [i for p in found for i in bpe.codec(*ARGS).encoding.encode_ordinary(p)] == whole


def test_special_tokens_are_text():
    assert bpe.codec(*ARGS).decode(bpe.codec(*ARGS).encode("<|endoftext|>")) == b"<|endoftext|>"


def test_long_runs():
    for space in (" ", "\n", "\t \n", "\u2003", "\x1c"):
        for n in (255, 256, 257, 700):
            run = (space * n)[:n]
            for text in (run, f"a{run}", f"{run}b", f"a{run}b c", f"a {run} !{run}1"):
                assert bpe.codec(*ARGS).encode(text) == brute(text), (space, n)
    for text in (" " * 1_000_000 + "x", "x" * 300_000, "!" * 300_000, "7" * 300_000, "\n " * 200_000):
        own = bpe.codec(*ARGS)
        assert own.decode(own.encode(text)) == text.encode()
