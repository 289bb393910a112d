import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from alertloom.session import scratch_path
from llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, chars int, valid string, segments int"


def digests(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(3)
    path = scratch_path(spark, "chat")
    chat.write_chat(df, path)
    found = chat.conversation_digests(chat.read_chat(spark, path)).collect()
    order = spark.read.parquet(f"{path}/conversations").collect()
    return {r.conv_id: r[1:] for r in found}, {r.conv_id: r for r in order}, spark.read.parquet(f"{path}/turns")


def brute(rows):
    def rank(r):
        return r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""

    out = {}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=rank)]
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (whole, learned)]
        valid = re.fullmatch("s?(ua)+", "".join({"system": "s", "user": "u", "assistant": "a"}.get(r, "x") for r, _ in turns))
        out[conv] = (len(turns), sha[0], len(learned), sha[1], bool(valid))
    return out


def random_rows(seed, n=150):
    rng = random.Random(seed)
    parts = [*chat.INSTRUCTIONS.controls, "\\", "\\\\", "<", "[", "/", "s>", "INST]", " ", "\n", "ok", "é", "𝄞", "$0", "\x00"]
    roles = ["user", "assistant", "system", "tool", "[TEXT] ", " [/ROLE]\\", "", None]
    rows = []
    for _ in range(n):
        text = rng.choice([None, "", "".join(rng.choice(parts) for _ in range(rng.randint(1, 12)))])
        rows.append((rng.choice([None, *range(12)]), rng.choice([None, 0, 1, 2, 3]), rng.choice(roles), text))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_round_trip_equals_brute_force(spark, seed):
    rows = random_rows(seed)
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")] + rows[:20]
    found, order, _ = digests(spark, rows)
    want = brute(rows)
    assert {c: (*f[:4], order[c].valid) for c, f in found.items()} == want


def test_no_text_holds_a_control_string(spark):
    _, _, turns = digests(spark, random_rows(3))
    bodies = turns.select(F.explode(F.slice("segments", 2, 1)).alias("s")).select("s.text").collect()
    assert bodies and not any(c in b.text for b in bodies for c in chat.INSTRUCTIONS.controls)


def test_conversation_reads_back_from_one_text(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("system", "a<"), ("user", "<s>\\"), ("tool", "[TEXT]"), ("assistant", " </s> ")])]
    _, _, turns = digests(spark, rows)
    text = "".join(s.text for r in turns.orderBy("turn").collect() for s in r.segments)
    assert list(chat.INSTRUCTIONS.read(text)) == [(r, t) for _, _, r, t in rows]


def test_order_names_the_first_break(spark):
    rows = [(1, 0, "user", ""), (1, 1, "user", ""), (1, 2, "assistant", ""), (2, 0, "system", ""), (3, 0, "user", ""), (3, 5, "assistant", "")]
    _, order, _ = digests(spark, rows)
    assert {c: (r.state, r.first_break, r.valid) for c, r in order.items()} == {
        1: ("broken", 1, False), 2: ("primed", None, False), 3: ("answered", None, True),
    }


def test_empty_and_very_long(spark):
    assert digests(spark, [])[0] == {}
    rows = [(7, i, ("user", "assistant")[i % 2], "word <s> " * 40000 if i == 3 else "x") for i in range(3000)]
    found, order, _ = digests(spark, rows)
    assert {c: (*f[:4], order[c].valid) for c, f in found.items()} == brute(rows)


def test_template_must_be_readable():
    good = chat.INSTRUCTIONS
    for turns, controls in (
        ({"user": chat.Turn("[INST", "] end </s>")}, ("</s>", "T]")),
        ({"user": chat.Turn("<s>", "no end")}, ("<s>",)),
        ({"user": chat.Turn("<s>", "</s>"), "tool": chat.Turn("<s>x", "</s>")}, ("<s>", "</s>")),
        ({"user": chat.Turn("<s>", "</s>")}, ("\\s",)),
    ):
        with pytest.raises(ValueError):
            chat.Template(turns, good.other, good.named, controls, good.moves, good.start, good.accepting)
