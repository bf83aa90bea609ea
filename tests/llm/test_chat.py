import hashlib
import random

import pytest

from lexistrata.llm.chat import RewritesHistory, Spans, escape, format_turns, read_back, turn_template, unescape
from lexistrata.llm.queries import ODD_TEXT, op5_chat


def test_escape_is_reversible_and_leaves_no_control_string():
    rnd = random.Random(1)
    parts = ["\\", "-", "<turn>", "</turn>", "### Assistant:", "### Role:", "#", "##", "<", "turn>", "a", "\n", "é", ""]
    for _ in range(3000):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 12)))
        e = escape(t)
        assert unescape(e) == t
        assert not any(c in e for c in ("<turn>", "</turn>", "### Assistant:", "### Role:"))


@pytest.mark.parametrize("n", [1, 5, 70])
def test_spans_are_those_of_the_whole_output(n):
    turns = [("user" if i % 2 else "assistant", f"text {i} </turn>" * (i % 3)) for i in range(n)]
    spans = Spans(turn_template, window=4)
    whole, at = turn_template(turns), 0
    for role, text in turns:
        own, start, end = spans.add(role, text)
        assert whole[at : at + len(own)] == own and unescape(own[start:end]) == text
        at += len(own)
    assert at == len(whole)


def rewriting(turns):
    return "".join(f"[{r}:{t if i == len(turns) - 1 else '...'}]" for i, (r, t) in enumerate(turns))


def counting(turns):
    return f"{len(turns)} turns:" + "".join(t for _, t in turns)


def far_back(turns):
    return "".join(f"<{t}|{turns[0][1] if i > 5 else ''}>" for i, (_, t) in enumerate(turns))


@pytest.mark.parametrize("template", [rewriting, counting, far_back])
def test_rewritten_history_is_detected(template):
    spans = Spans(template, window=4)
    with pytest.raises(RewritesHistory):
        for i in range(40):
            spans.add("user", f"t{i}")


def digests(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_edges(spark):
    rows = [(1, 1, "assistant", ODD_TEXT), (1, 0, "user", "hi"), (2, None, "user", None), (2, 0, None, "x"), (None, 0, "assistant", "n"), (3, 0, "assistant", "z" * 200_000), (3, 0, "assistant", "a"), (3, 0, "assistant", "a")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, seq string")
    out = {r.conv_id: tuple(r)[1:5] for r in read_back(format_turns(df)).collect()}
    assert out == {1: digests([("user", "hi"), ("assistant", ODD_TEXT)]), 2: digests([("user", ""), ("", "x")]), None: digests([("assistant", "n")]), 3: digests([("assistant", "a")] * 2 + [("assistant", "z" * 200_000)])}
    assert read_back(format_turns(df.limit(0))).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    convs = {-7: [("user", ODD_TEXT), ("assistant", ODD_TEXT)]}
    for r in sorted(spark.read.parquet(f"{d}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        convs.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    out = op5_chat(spark, d).collect()
    assert {r.conv_id: tuple(r)[1:5] for r in out} == {c: digests(t) for c, t in convs.items()}
    assert all(r.formatted_chars == len(turn_template(convs[r.conv_id])) for r in out)


def late(turns):
    return "".join(f"<{t}>" for _, t in (turns if len(turns) <= 40 else [("", "..."), *turns[-39:]]))


def test_late_rewriting_is_detected():
    spans = Spans(late)
    for i in range(40):
        spans.add("user", f"t{i}")
    with pytest.raises(RewritesHistory):
        spans.add("user", "t40")


def numbering(turns):
    return "".join(f"{i}: {r}: {t}\n" for i, (r, t) in enumerate(turns))


def alternating(turns):
    roles = [r for r, _ in turns if r != "system"]
    if any(r != ("assistant" if i % 2 else "user") for i, r in enumerate(roles)):
        raise ValueError("roles must alternate, from user on")
    return "".join(f"[{r}] {t}\n" for r, t in turns)


@pytest.mark.parametrize("template", [numbering, alternating])
def test_templates_that_keep_history_work_at_every_length(template):
    turns = [("system", "s"), *(("assistant" if i % 2 else "user", f"t{i}") for i in range(99))]
    spans = Spans(template)
    assert "".join(spans.add(*t)[0] for t in turns) == template(turns)
    spans.close()


def test_wrong_declaration_is_detected(spark):
    def claims(turns):
        return turn_template(turns if len(turns) <= 40 else turns[-39:])

    df = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(50)], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="RewritesHistory"):
        format_turns(df, claims, window=4).collect()
    assert format_turns(df).count() == 50
