"""Chat formatting: exact round trip, merged blocks, mask, escapes."""

import hashlib
import random

from stockflow.llm import chat, queries

SCHEMA = "conv_id long, turn long, role string, text string"
TRICKY = ["</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", r"\<|im_sep|>", r"<\|im_sep|>", r"<\\|im_end|>", r"[\INST] [\\/INST]", "<|im_sep|>" * 3,
          "<", "<|im_end|", "a\nb", "", "%0A%25", "é🙂", r"<\\", "<<SYS>>x<</SYS>>", r"\1 $1 $"]


def corpus(seed):
    rnd = random.Random(seed)
    rows = []
    for c in range(40):
        for t in range(rnd.randrange(1, 9)):
            role = rnd.choice(["user", "assistant", "assistant", "system", "", None, "od\nd%0A role", "<|im_end|>"])
            rows.append((c, t * 2, role, rnd.choice([None, "plain", *TRICKY]) if rnd.random() < 0.8 else "".join(rnd.choices("<|[\\/>simINST_endp]", k=30))))
    rows += [(99, 0, "assistant", "long " * 50000), (None, 1, "user", "x"), (None, None, "assistant", "y"), (50, 1, "user", "b"), (50, 1, "user", "a"), (50, 1, "user", "a")]
    rnd.shuffle(rows)
    return rows


def conversations(rows):
    out = {}
    for c, turn, role, text in rows:
        out.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [(r, x) for _, r, x in sorted(v)] for c, v in out.items()}


def test_round_trip_and_mask(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS turns", "2 AS formatted", "3 AS loss").repartition(4)
    out = chat.format_chats(df)
    back = {r.conv_id: r for r in chat.read_chats(out).collect()}
    want = conversations(rows)
    assert back.keys() == want.keys()
    for c, turns in want.items():
        assert [(t.role, t.text) for t in back[c].turns] == turns
        assert back[c].loss_texts == [x for r, x in turns if r == "assistant"]
    for r in out.collect():
        runs, at = "", 0
        for m in r.loss_mask:
            runs += r.formatted[at:at + m.chars] if m.loss else ""
            at += m.chars
        assert at == len(r.formatted) == back[r.conv_id].formatted_chars
        # Adjacent turns of one role share a block; nothing but marks looks like a mark.
        turns = want[r.conv_id]
        blocks = sum(i == 0 or turns[i - 1][0] != t[0] for i, t in enumerate(turns))
        assert r.formatted.count(chat.START) == r.formatted.count(chat.END) == blocks
        assert r.formatted.count(chat.SEP) == len(turns) - blocks
        assert all(x not in r.formatted for x in ("</s>", "[INST]", "[/INST]"))


def test_damaged_mask_is_noticed(spark):
    out = chat.format_chats(spark.createDataFrame([(1, 0, "assistant", "abc")], SCHEMA))
    broken = out.selectExpr("conv_id", "formatted || 'x' AS formatted", "loss_mask")
    assert chat.read_chats(broken).first().loss_texts is None


def test_query(spark, tmp_path):
    rows = corpus(2)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/a/conversations.parquet")
    want = set()
    for c, turns in conversations([*rows, (-7, 0, "user", TRICKY[0]), (-7, 1, "assistant", TRICKY[0])]).items():
        loss = "".join(x for r, x in turns if r == "assistant")
        want.add((c, len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    got = queries.op4_chat_format(spark, f"{tmp_path}/a").collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want) and all(r.formatted_chars > 0 for r in got)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/b/conversations.parquet")
    assert [r.conv_id for r in queries.op4_chat_format(spark, f"{tmp_path}/b").collect()] == [-7]
