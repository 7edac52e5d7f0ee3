"""Formatted conversations read back exactly, whatever their texts and roles hold."""

import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from panelmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, pieces string, _turn int, _text int, examples int"
PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "<|turn|>", "<|end|>", "<<SYS>>", "<</SYS>>", "\\", "[\\INST]", "<\\|end|>", "<", "[", "|", "\n", " ", "ok", "é", "😀", "assistant", "$1", ""]


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    chats: dict = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        chats.setdefault(conv, []).append((role or "", text or ""))
    return {conv: (len(turns), "".join(f"{r}\n{t}\n" for r, t in turns), "".join(t for r, t in turns if r == "assistant"),
                   sum(r == "assistant" for r, _ in turns)) for conv, turns in chats.items()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, 3) for r in rows], SCHEMA)


def back(spark, rows):
    found = chat.read_back(chat.format_chats(frame(spark, rows))).collect()
    return {r["conv_id"]: (r["n_turns"], r["turns"], r["loss"], r["n_examples"]) for r in found}


ODD = [
    (1, 0, "system", None), (1, 1, "user", "</s>[INST] ok [/INST]"), (1, 2, "assistant", "<|end|>\n<|turn|>user\n\\"), (1, 3, "assistant", ""),
    (1, 4, "user", "last word"), (2, 0, "user", "no reply"), (3, None, "assistant", "b"), (3, None, "assistant", "a"), (3, 1, None, None),
    (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 0, "odd\nrole\\n<|end|>", "t"), (4, 1, "Assistant", "not the role"),
    (5, 1, "assistant", "same"), (5, 1, "assistant", "same"), (6, 0, "user", "x" * 300_000), (6, 1, "assistant", "[INST]" * 50_000),
]


def test_odd_conversations(spark):
    assert back(spark, ODD) == plain(ODD)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 5), st.sampled_from(["user", "assistant", "tool", "a\nb"]),
                          st.lists(st.sampled_from(PARTS), max_size=8).map("".join)), max_size=40))
def test_round_trip(spark, rows):
    assert back(spark, rows) == plain(rows) if rows else True


def test_examples_end_with_their_reply_alone(spark):
    chats = chat.format_chats(frame(spark, ODD)).cache()
    whole = {r["conv_id"]: r["pieces"] for r in chats.collect()}
    texts, rows = chat.example_texts(chats).collect(), {(r["conv_id"], r["example"]): r for r in chat.explode_examples(chats).collect()}
    assert len(texts) == len(rows) == sum(n for _, _, _, n in plain(ODD).values())
    for r in texts:
        one = rows[r["conv_id"], r["example"]]
        assert r["text"] == "".join(whole[r["conv_id"]][:one["pieces"]]) and one["reply"] == whole[r["conv_id"]][one["pieces"] - 1]
        assert r["text"][:r["loss_start"]].endswith("<|turn|>assistant\n") and r["text"][r["loss_end"]:] == "<|end|>\n"
        assert one["context_chars"] == len(r["text"]) - len(one["reply"])
    assert chats.where("false").count() == 0 and chat.read_back(chat.format_chats(frame(spark, ODD).where("false"))).count() == 0


def test_marks_never_occur_inside_texts(spark):
    pieces = [p for r in chat.format_chats(frame(spark, ODD)).collect() for p in r["pieces"]]
    for mark in ("<|turn|>", "<|end|>", "</s>", "[INST]", "[/INST]"):
        assert all(p.count(mark) == (mark in ("<|turn|>", "<|end|>")) for p in pieces)


def test_the_loss_is_read_under_the_masks_of_written_out_examples(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"[INST] {i}é") for i in range(60)] + [(2, 0, "user", "no reply")]
    chats = chat.format_chats(frame(spark, rows))
    found = {r["conv_id"]: r for r in chat.read_back(chats).collect()}
    texts = sorted((r["example"], r["text"]) for r in chat.example_texts(chats).collect())
    assert len(texts) == found[1]["n_examples"] == 30 and found[1]["example_chars"] == sum(len(text) for _, text in texts)
    assert (found[2]["n_turns"], found[2]["loss"], found[2]["n_examples"], found[2]["example_chars"]) == (1, "", 0, 0)
    # A mask that reaches into the context finds the context there.
    wide = chats.withColumn("examples", F.transform("examples", lambda e: e.withField("loss_start", F.lit(0).cast("long"))))
    losses = {r["conv_id"]: r["loss"] for r in chat.read_back(wide).collect()}
    assert losses[1] == "".join(text.replace("[\\INST]", "[INST]").removesuffix("<|end|>\n") for _, text in texts)


def test_turns_are_found_at_the_marks_of_the_formatted_text(spark):
    chats = chat.format_chats(frame(spark, ODD))
    joined = chats.withColumns({"pieces": F.array(F.array_join("pieces", "")), "examples": F.slice("examples", 1, 0)})
    found = {r["conv_id"]: (r["n_turns"], r["turns"]) for r in chat.read_back(joined).collect()}
    assert found == {conv: (n, turns) for conv, (n, turns, _, _) in plain(ODD).items()}


def test_examples_move_no_second_time_and_none_gathers_all_texts(spark):
    text = chat.read_back(chat.format_chats(frame(spark, ODD)))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "Generate explode" in text and "Join" not in text
