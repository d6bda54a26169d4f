import hashlib
import random

from veilstream.llm import chat

BITS = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "</s>", "[INST]", "\\", "<\\", "<\\|im_end|>", "<\\\\/s>", "[\\/INST]", "a", "\n", "é😀", "<<SYS>>", "<</SYS>>", "<|im_", "<", "[", "user", "$1", "<|endoftext|>"]


def digests(rows):
    turns = "".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in rows)
    loss = "".join(t or "" for _, _, r, t in rows if r == "assistant")
    return len(rows), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_round_trip(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "Tool X", "we\nird<|im_end|>", "=41", None, ""]), rng.choice([None, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 9)))])) for c in range(200) for t in range(rng.randint(1, 150 if c == 7 else 5))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("rendered", chat.F.lit("clash"))
    out = chat.format_conversations(df)
    assert out.where("not faithful").count() == 0
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    for c in range(200):
        r = got[c]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == digests(sorted((x for x in rows if x[0] == c), key=lambda x: x[1]))


def test_control_strings_stand_only_at_turns(spark):
    rows = [(1, 0, "user", "".join(BITS)), (1, 1, "assistant", "</s>[INST] ok [/INST]")]
    text = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()["formatted"]
    assert text.count("<|im_start|>") == text.count("<|im_end|>") == 2
    assert "[INST]" not in text and "</s>" not in text


def test_plain_texts_are_not_escaped(spark):
    text = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "a < b [x] \\ c")], "conv_id long, turn long, role string, text string")).first()["formatted"]
    assert text == "<|im_start|>user\na < b [x] \\ c<|im_end|>\n"


def test_edges(spark):
    shape = "conv_id long, turn long, role string, text string"
    assert chat.format_conversations(spark.createDataFrame([], shape)).collect() == []
    rows = [(None, None, None, None), (1, None, "user", "b"), (1, 3, "user", "a"), (1, 3, "user", "a")]
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, shape))).collect()}
    assert got == {None: 1, 1: 3}
