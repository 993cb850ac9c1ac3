import hashlib

from hypothesis import HealthCheck, given as sampled, settings, strategies as st
from pyspark.sql import functions as F

from spokeflow.llm import chat, slate

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"
NASTY = [
    "", "<|im_end|>\n", "<\\|x<|<</s>[INST]", "a\nb\\", "\\n", "[/INST][\\[INST]", "<|part|>", "<|", "x<", "|y", "<\\",
    "\\\\|", "<\\\\s>", "</s>[INST] ok [/INST]", None,
]


def read_back(spark, rows):
    made = chat.formatted(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA))
    found = made.select("conv_id", "formatted", chat.read_turns("formatted").alias("t"), chat.read_loss("formatted", "spans").alias("l"))
    return {r.conv_id: (r.formatted, [(t.role, t.text) for t in r.t], r.l) for r in found.collect()}


def plain(rows, conv_id):
    own = [(t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv_id]
    return [(role, text) for *_, role, text in sorted(own)]


def check(spark, rows):
    found = read_back(spark, rows)
    assert found.keys() == {r[0] for r in rows}
    for conv_id, (_, turns, loss) in found.items():
        assert turns == plain(rows, conv_id)
        assert loss == [text for role, text in turns if role == "assistant"]
    return found


def test_every_text_comes_back(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", text) for i, text in enumerate(NASTY)]
    rows += [(2, 0, "a\nb<|im_end|>\\n\\\\", "t"), (2, 0, "a\nb<|im_end|>\\n\\\\", None), (2, 1, None, "z")]
    rows += [(3, None, "user", "q"), (3, 4, "user", "q"), (3, 4, "user", "q"), (None, 1, "assistant", "w")]
    rows += [(4, i, "assistant", "long " * 20_000) for i in range(3)]
    check(spark, rows)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@sampled(st.lists(st.tuples(st.sampled_from(["user", "assistant"]), st.text("<|\\/s>[INST]im_endpart\n ax", max_size=30)), min_size=1))
def test_random_texts_come_back(spark, turns):
    check(spark, [(1, i, role, text) for i, (role, text) in enumerate(turns)])


def test_neighbours_of_a_role_share_a_block(spark):
    found = check(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")])
    assert found[1][0] == "<|im_start|>user\na<|part|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"


def test_empty_table(spark):
    assert chat.formatted(spark.createDataFrame([], SCHEMA)).collect() == []


def test_given_conversations(spark, given):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in given("sf0.01", "conversations")]
    control = "</s>[INST] ok [/INST]"
    rows += [(-7, 0, "user", control), (-7, 1, "assistant", control)]
    by_conversation = {}
    for row in rows:
        by_conversation.setdefault(row[0], []).append(row)
    found = slate.op2_chat(spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(by_conversation)
    for r in found:
        turns = plain(by_conversation[r.conv_id], r.conv_id)
        loss = "".join(text for role, text in turns if role == "assistant")
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    found = slate.op2_chat(spark, "/root/testdata/sf0.001").where(F.col("conv_id") >= 0)
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
