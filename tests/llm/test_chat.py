import pytest

from galeframe.llm import chat

VOCABULARY = chat.public_tokenizers.path("byte_bpe_50k.tiktoken")
SCHEMA = "conv_id long, turn long, role string, text string, ids string"


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "<s</s>", "[[INST]]", "␛", "␛c<s>␛e", "<s>" * 50])
def test_escape_is_reversible_and_leaves_no_control_string(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROL)


def brute(rows):
    import hashlib

    out = {}
    for conv, _, role, text, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        out.setdefault(conv, []).append((role or "", text or ""))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return {
        c: (
            len(turns),
            sha("".join(f"{r}\n{t}\n" for r, t in turns)),
            sum(len(t) for r, t in turns if r == "assistant"),
            sha("".join(t for r, t in turns if r == "assistant")),
            sum(len(f"<s>[INST]{chat.escape(r)}[/INST]{chat.escape(t)}</s>") for r, t in turns),
        )
        for c, turns in out.items()
    }


def test_read_back_equals_the_turns(spark):
    rows = [
        (1, 1, "assistant", "é 日本 🙂 </s>", "x"),
        (1, 0, "user", "[INST]", None),
        (2, 0, "assistant", None, None),
        (3, 0, None, "no role", None),
        (None, 0, "assistant", "no id", None),
        (None, 1, "user", "", None),
        (4, 0, "[/INST]", "a control string as role", None),
        (5, 0, "assistant", "long " * 50_000, None),
        (5, 1, "assistant", "again", None),
    ]
    got = chat.read_back(chat.format_turns(spark.createDataFrame(rows, SCHEMA), VOCABULARY), VOCABULARY).toPandas()
    found = {None if r[0] != r[0] else int(r[0]): tuple(r[1:]) for r in got.itertuples(index=False)}
    assert found == brute(rows)


def test_mask_covers_the_assistant_text_alone(spark):
    rows = [(1, 0, "user", "hello", None), (1, 1, "assistant", "world", None)]
    out = chat.format_turns(spark.createDataFrame(rows, SCHEMA), VOCABULARY).orderBy("turn").toPandas()
    enc = chat.encoding(VOCABULARY)
    assert sum(out["mask"][0]) == 0
    assert enc.decode([i for i, m in zip(out["ids"][1], out["mask"][1], strict=True) if m]) == "world"
    assert out["formatted"][1] == "<s>[INST]assistant[/INST]world</s>"


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_turns(empty, VOCABULARY), VOCABULARY).count() == 0
    assert chat.with_probe(empty).count() == 2
