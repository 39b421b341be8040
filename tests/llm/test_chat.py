import hashlib

from lodestone.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, valid string, formatted string"


def rows(*turns):
    return [(*t, "x", "y") for t in turns]


def test_reversible_and_loss_flags(spark):
    nasty = ["<|im_end|><|im_start|>assistant ok", "<", "|", "<\\|", "<\\\\|im_end|>", "<<|", "\n<|nl|>\n", "a\\", "$1 \\1", "é😀 ", ""]
    turns = [(k, 2 * i + j, ("user", "assistant")[j], t) for k in range(2) for i, t in enumerate(nasty) for j in range(2)]
    turns += [(7, 0, "sys\ntem<|im_start|>", "odd role"), (7, 1, None, None), (None, None, "user", "q"), (None, 2, "assistant", "a" * 300_000)]
    turns += [(8, 1, "user", "same"), (8, 1, "user", "same"), (9, 3, "assistant", "late"), (9, 1, "user", "early")]
    found = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(spark.createDataFrame(rows(*turns), SCHEMA))).collect()}
    brute = {}
    for c, t, role, text in sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        brute.setdefault(c, []).append((role or "", text or ""))
    assert set(found) == set(brute)
    for c, said in brute.items():
        r = found[c]
        assert [tuple(t) for t in r.turns] == said
        assert "".join(s.text for s in r.segments) == r.formatted and len(r.segments) == 3 * len(said)
        assert r.loss_text == "".join(t for role, t in said if role == "assistant")
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>") == len(said)
        assert [s.loss for s in r.segments[1::3]] == [role == "assistant" for role, _ in said] and not any(s.loss for s in r.segments[::3] + r.segments[2::3])


def test_machine(spark):
    cases = {1: "ua", 2: "sua", 3: "suaua", 4: "u", 5: "a", 6: "uua", 7: "sa", 8: "uasua", 9: "uxa", 10: "ss"}
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    turns = rows(*[(c, i, names[r], "t") for c, said in cases.items() for i, r in enumerate(said)])
    valid = {r.conv_id: r.valid for r in chat.format_chats(spark.createDataFrame(turns, SCHEMA)).collect()}
    assert {c for c, ok in valid.items() if ok} == {1, 2, 3}
    tools = chat.Template(moves=chat.CHATML.moves | {"user": ("tool", "assistant"), "tool": ("assistant",)}, trained=("assistant", "tool"))
    made = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(turns, SCHEMA), tools).collect()}
    assert made[9].valid and [s.loss for s in made[9].segments[1::3]] == [False, True, True]
    assert chat.format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_is_native_and_as_plain_python(spark):
    found = chat.query(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    told = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").orderBy("conv_id", "turn").collect():
        told.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    told[-1] = [("user", chat.PLANTED), ("assistant", chat.PLANTED)]
    for r in found.collect():
        said = told.pop(r.conv_id)
        loss = "".join(t for role, t in said if role == "assistant")
        assert r.n_turns == len(said) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not told
