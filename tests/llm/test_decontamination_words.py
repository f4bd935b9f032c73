"""Words that are read without a lookup mean what the lookup says; texts read together mean what each says alone."""

import numpy as np
import pyarrow as pa

from tessera.llm import decontaminate as d

ODD = [
    "Alice", "alice", "ALICE", "(Alice)", "seven", "Seven!", "SEVEN", "kg", "KG.", "Kg?", "s", "half", "minutes;", "end.", "end.)", "end.\"')]", "end.»", "end…", "(end", "((end", "[end].",
    "end!!!!", "end!!!!!", "of%%%", "the&&&&&&", "`tick", "tick`", "a-b", "don't", "_x_", "5", "5.", "5kg", "5kg.", "$5", "$five", "50%", "1,000", "+", "--", "...", "?!", "\"", "|", "é", "Ñandu", "für", "K", "Kg",
    "İx", "x" * 64, "x" * 65, "X" * 63 + ".", "y" * 200, "x\0y", "\0", "A", "z", "abcdefgh", "abcdefghi", "Abcdefghijklmnop", "abcdefghijklmnopq", "#", "w.w", "Mr.", "“Bob”", "'Bob'", "bob:", "二", "a b", "Dozen,", "dollars", "FEET",
]


def texts(seed: int, n: int = 300) -> list[str]:
    rng = np.random.default_rng(seed)
    marks, letters = list(d._MARKS + "`7é"), list("abcdefgzAKZ")
    word = lambda: "".join(rng.choice(marks, rng.integers(3))) + "".join(rng.choice(letters, rng.integers(12))) + "".join(rng.choice(marks, rng.integers(7)))
    blank = list(" \t\n\x0b\x0c\r")
    return ["".join(x + rng.choice(blank) for x in (rng.choice(ODD) if rng.random() < 0.6 else word() for _ in range(rng.integers(0, 25)))) for _ in range(n)]


def test_letters_are_read_as_the_lookup_reads_them():
    words = sorted({w for seed in (1, 2) for t in texts(seed) for w in t.encode().split()} | {w.encode() for w in ODD})
    w = d._Words()
    ids = [w[x] for x in words]
    text = b"\n".join(words) + b"\n" * 16
    data = np.frombuffer(text, dtype=np.uint8)
    begin, stop = d.W.word_spans(data)
    assert [text[a:b] for a, b in zip(begin, stop)] == words
    hashes, kind, slow = d.Canonical._letters(data, begin, stop)
    fast = np.setdiff1d(np.arange(len(words)), slow)
    assert {b"Alice", b"SEVEN", b"KG.", b"end.)", b"end!!!!", b"of%%%", b"x" * 64} <= {words[i] for i in fast}
    for i in fast:
        assert (int(hashes[i]), int(kind[i])) == (w.hashes[ids[i]], w.kinds[ids[i]]), words[i]


def test_plain_words_are_not_looked_up():
    c = d.Canonical()
    c.read([" ".join("w" + "".join(chr(97 + int(x)) for x in str(i)) for i in range(5000)).encode() for _ in range(3)])
    assert len(c.words) == 0


def test_texts_read_together_as_each_alone():
    some = texts(3) + ["", "   ", "-- ..", "5", "kg of it", "Bob"]
    items = pa.record_batch({"item_id": pa.array(range(len(some))), "text": pa.array(some)})
    known = np.sort(np.unique(np.concatenate([np.array(b["hash"]) for b in d._item_windows(iter([items]))]).view(np.uint64)))

    class Thin:
        value = known[::3]

    for thin in (None, Thin):
        find = d._found_windows([5, 2, 1], thin)
        rows = lambda *batches: sorted(map(repr, (r for b in find(iter(batches)) for r in b.to_pylist())))
        one = lambda i: pa.record_batch({"doc_id": pa.array([i]), "text": pa.array([some[i]])})
        whole = pa.record_batch({"doc_id": pa.array(range(len(some))), "text": pa.array(some)})
        assert len(rows(whole)) > 100 and rows(whole) == sorted(r for i in range(len(some)) for r in rows(one(i)))
    nothing = pa.record_batch({"doc_id": pa.array([None, 1, 2], pa.int64()), "text": pa.array(["a b c d e", None, ""])})
    assert list(d._found_windows([5, 1], None)(iter([nothing]))) == []
