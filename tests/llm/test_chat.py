import random

from meetlens.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def quote(text, n=1):
    return "\n".join(">" * n + " " + x for x in text.split("\n"))


def links(spark, rows, schema=SCHEMA):
    return {(r.conv_id, r.turn, r.level): (r.to_conv, r.to_turn, r.n_lines) for r in chat.link(spark.createDataFrame(rows, schema)).collect()}


def test_whole_passage_names_its_message(spark):
    """Every line was written before, but one message holds the whole passage."""
    rows = [(1, 0, "u", "alpha\nbeta"), (1, 1, "u", "gamma\ndelta"), (1, 2, "u", "alpha\ndelta"), (1, 3, "u", "> alpha\n> delta\nmine"), (1, 4, "u", quote("alpha\nbeta"))]
    assert links(spark, rows) == {(1, 3, 1): (1, 2, 2), (1, 4, 1): (1, 0, 2)}


def test_the_latest_of_equal_originals(spark):
    rows = [(1, 0, "u", "yes"), (1, 1, "u", "a question"), (1, 2, "u", "yes"), (1, 3, "u", "> Yes \nthanks"), (1, 4, "u", "yes"), (2, 9, "u", "> yes"), (0, 9, "u", "> yes\nno")]
    assert links(spark, rows) == {(1, 3, 1): (1, 2, 1), (2, 9, 1): (1, 4, 1), (0, 9, 1): (1, 4, 1)}


def test_cut_and_mixed_passages(spark):
    """The longest run of lines counts before the number of lines, which counts before the latest."""
    rows = [
        (1, 0, "u", "a\nb\nc\nd\ne\nf"),
        (1, 1, "u", "b\nx\nc\nx\nd"),
        (1, 2, "u", "d\nq"),
        (1, 3, "u", quote("b\nc\nd")),
        (1, 4, "u", quote("zzz\nd")),
        (1, 5, "u", quote("a\nb") + "\n\nreply between\n" + quote("c\nd\ne\nf")),
        (1, 6, "u", "> nothing that anyone wrote"),
    ]
    assert links(spark, rows) == {(1, 3, 1): (1, 0, 2), (1, 4, 1): (1, 2, 1), (1, 5, 1): (1, 0, 6)}


def test_conversations_named_by_text(spark):
    rows = [("x", 0, "u", "hello there"), ("y", 1, "u", "> hello there\nhi"), ("x", 1, "u", "> hello there\nme too"), ("z", 2, "u", "> hi")]
    schema = SCHEMA.replace("conv_id long", "conv_id string")
    assert links(spark, rows, schema) == {("y", 1, 1): ("x", 0, 1), ("x", 1, 1): ("x", 0, 1), ("z", 2, 1): ("y", 1, 1)}
    found = {(r.conv_id, r.turn): (r.root_conv, r.root_turn, r.depth) for r in chat.conversations(spark.createDataFrame(rows, schema)).collect()}
    assert found["z", 2] == ("x", 0, 2)


def test_very_long_text(spark):
    body = "\n".join(f"line {i % 7000} of a very long message that goes on" for i in range(12_000))
    rows = [(1, 0, "u", body), (1, 1, "u", "short"), (1, 2, "u", quote(body)), (1, 3, "u", quote(body[: len(body) // 2]))]
    found = links(spark, rows)
    assert found[1, 2, 1] == (1, 0, 12_000) and found[1, 3, 1][:2] == (1, 0)


def brute(rows):
    """The same look-ups one message at a time."""

    def parse(text):
        out = {}
        for line in (text or "").split("\n"):
            marks = 0
            while line.lstrip().startswith(">"):
                line, marks = line.lstrip()[1:], marks + 1
            norm = " ".join(line.split()).lower()
            if norm:
                out.setdefault(marks, []).append(norm)
        return out

    def grams(ls):
        return {(True, tuple(ls))} | {(False, tuple(ls[i : i + n])) for n in chat.RUNS for i in range(len(ls) - n + 1)}

    own = [(c, t, grams(parse(text).get(0, []))) for c, t, _, text in rows]
    found = {}
    for c, t, _, text in rows:
        for lv, ls in parse(text).items():
            if not lv:
                continue
            votes = {}
            for whole, g in grams(ls):
                have = [(tt, cc) for cc, tt, o in own if (whole, g) in o and g]
                here = [(tt, cc) for tt, cc in have if cc == c and tt < t]
                there = [(tt, cc) for tt, cc in have if (tt, cc) < (t, c)]
                at = max(here, default=None) or max(there, default=None)
                if at and (here or at[1] != c):
                    v = votes.setdefault(at, [False, 0, 0])
                    votes[at] = [v[0] or whole, max(v[1], len(g)), v[2] + (not whole and len(g) == 1)]
            if votes:
                at = max(votes, key=lambda x: (*votes[x], x[1] == c, x[0], x[1]))
                w, n, k = votes[at]
                found[c, t, lv] = (at[1], at[0], n if w else max(n, k))
    return found


def test_by_brute_force(spark):
    rng, words, rows = random.Random(8), ["ja", "nein", "so", "well", "ok then", "no"], []
    for c in range(6):
        for t in range(12):
            own = "\n".join(rng.choices(words, k=rng.randrange(4)))
            if t and rng.random() < 0.8:
                source = rng.choice(rows)[3] if rng.random() < 0.3 else rows[-1][3]
                part = source.split("\n")[rng.randrange(2) :]
                own += "\n" + quote("\n".join(part)) if rng.random() < 0.8 else ""
            rows.append((c, t, "u", own))
    assert links(spark, rows) == brute(rows)
