import hashlib
import random

from tessera.llm import chat as C

ROWS = "conv_id long, turn long, role string, text string, turns int"


def test_round_trip(spark):
    rnd = random.Random(4)
    parts = [*C.INSTRUCT.control, "\\", "\\\\", "<", "[", "<\\s>", "a", "é😀", "\n", " ", "'", ">>\n"]
    rows = []
    for c in range(150):
        for k in range(rnd.randint(1, 6)):
            role = rnd.choice(["user", "assistant", "system", "tool>>\n", None, "<s>\\"]) if c % 3 else ["user", "assistant"][k % 2]
            rows.append((c, k, role, None if rnd.random() < .1 else "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12))), 1))
    rows += [rows[0], (None, 0, "user", "x", 1), (None, None, "assistant", "y", 1)]
    df = C.formatted(spark.createDataFrame(rows, ROWS))
    back = {r.conv_id: r for r in C.read_back(df).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r[1] if r[1] is not None else -1, r[2] or "", r[3] or "") for r in rows if r[0] == c)
        assert [(t.role, t.text) for t in back[c].turns] == [x[1:] for x in own]
        assert list(back[c].loss_texts) == [x[2] for x in own if x[1] == "assistant"]
        states, ok = ["start"] + [x[1] for x in own], True
        for before, role in zip(states[:-1], states[1:], strict=True):
            ok = ok and role in C.INSTRUCT.follows.get(before, ())
        assert back[c].valid == (ok and states[-1] == "assistant")
    for r in df.collect():
        assert r.formatted == "".join(s.text for s in r.segments)
        inner = [s.text for s in r.segments if s.loss]
        assert inner == [r.formatted[x.start:x.start + x.n] for x in r.loss_spans]
    assert C.digests(C.formatted(spark.createDataFrame([], ROWS))).count() == 0


def test_digests(spark):
    rows = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "yo", 0), (1, 2, "user", None, 0), (1, 3, "assistant", "é", 0)]
    r = C.digests(C.formatted(spark.createDataFrame(rows, ROWS))).first()
    assert r.n_turns == 4 and r.loss_chars == 3 and r.valid
    assert r.loss_sha256 == hashlib.sha256("yoé".encode()).hexdigest()
    assert r.turns_sha256 == hashlib.sha256("user\nhi\nassistant\nyo\nuser\n\nassistant\né\n".encode()).hexdigest()
    assert r.formatted_chars == len("<s>[INST] hi [/INST] yo</s>[INST]  [/INST] é</s>")
