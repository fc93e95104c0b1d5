import random

import pytest
from panelspark.llm import chat
from pyspark.sql import functions as F

HARD = ["", "a", "&", "<", "&lt;", "&amp;lt;", "</turn>\n", "<part/>", '<turn role="user">\n', "<image/>", "\\### Assistant: </turn> ok", '"', "\n", "😀é", "&quot;", None]


def conversations():
    rnd = random.Random(8)
    rows = []
    for c in range(40):
        for t in range(rnd.randint(1, 6)):
            parts = []
            for _ in range(rnd.randint(0, 4)):
                kind = rnd.choice(["text", "text", "image", "audio", "document", None, "other"])
                parts.append((kind, "".join(rnd.choice(HARD) or "" for _ in range(rnd.randint(0, 5))) or rnd.choice([None, ""]), f"ref{rnd.randint(0, 9)}", rnd.choice([None, 1, 3])))
            rows.append((c, t, rnd.choice(["user", "assistant", "system", 'odd"<&>', None]), parts or None))
    rows += [(None, 0, "user", [("text", "x", None, None)]), (100, None, "assistant", [("text", "b", None, None)]), (100, None, "assistant", [("text", "b", None, None)]), (100, 1, "assistant", [("text", "a" * 50_000, None, None)])]
    return rows


def test_round_trip(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0))
        is_text = lambda p: p[0] not in chat.ATTACHMENTS
        want = [(x[2] or "", [("text", p[1] or "") if is_text(p) else (p[0], None) for p in x[3] or [("text", "", None, None)]]) for x in own]
        assert [(t.role, [tuple(p) for p in t.parts]) for t in r.turns] == want
        assert r.loss_texts == [p[1] for x in own if x[2] == "assistant" for p in x[3] or [] if is_text(p) and p[1]]
        attached = [(k, p[0], p[2], chat.TOKENS_OF_UNIT[p[0]] * (1 if p[3] is None else p[3])) for k, x in enumerate(own) for p in x[3] or [] if not is_text(p)]
        assert [tuple(a) for a in r.attachments] == attached and r.attachment_tokens == sum(a[3] for a in attached)
        assert sum(x.length for x in r.loss_runs) == len(r.formatted)
        at, under = 0, []
        for x in r.loss_runs:
            under += [r.formatted[at : at + x.length]] * x.loss
            at += x.length
        assert [u.replace("&lt;", "<").replace("&amp;", "&") for u in under] == r.loss_texts


def test_a_mask_that_does_not_fit_fails(spark):
    df = spark.createDataFrame([(1, 0, "assistant", [("text", "abc", None, None)])], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    broken = chat.format_chats(df).withColumn("formatted", F.concat("formatted", F.lit("x")))
    with pytest.raises(Exception, match="not a formatted conversation"):
        chat.read_chats(broken).collect()


def test_empty_table(spark):
    assert chat.read_chats(chat.format_chats(spark.createDataFrame([], f"conv_id long, turn long, role string, parts {chat.PARTS}"))).collect() == []
