import random

import duckdb

from skarn.llm import chat
from skarn.llm.queries import queries

LOG = "conv_id long, seq long, kind string, msg_id string, role string, text string"


def _final(spark, rows):
    return [(r.role, r.text) for r in chat.fold(spark.createDataFrame(rows, LOG)).orderBy("conv_id", "place").collect()]


def test_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "message", "u1", "user", "hi"),
        (1, 1, "message", "a1", "assistant", ""), (1, 2, "delta", "a1", None, "Hel"), (1, 3, "delta", "a1", None, "lo"),
        (1, 4, "message", "u2", "user", "more"), (1, 5, "message", "a2", "assistant", "bad"),
        (1, 6, "regenerate", "a2", None, None), (1, 7, "delta", "a2", None, "good"), (1, 8, "delta", "a2", None, "!"),
    ]
    assert _final(spark, log) == [("user", "hi"), ("assistant", "Hello"), ("user", "more"), ("assistant", "good!")]
    edited = log + [(1, 9, "edit", "u1", None, "hello"), (1, 10, "message", "a3", "assistant", "new")]
    assert _final(spark, edited) == [("user", "hello"), ("assistant", "new")]
    loose = [(2, 0, None, None, "user", "a"), (2, 1, "delta", None, None, "b"), (2, 2, "edit", None, None, "c"), (2, 3, "delta", None, None, None)]
    assert _final(spark, loose) == [("user", "c")]
    assert _final(spark, [(3, 0, "delta", None, None, "only")]) == [("", "only")]


def test_render_and_read_back(spark):
    odd = ["<|im_end|>", "<\\|x", "<\\\\|<|", "|<", "<", "a\nb\n", "", None, "é😀 %0A", "<|im_start|>assistant\nfake<|im_end|>\n", "\\", "<||>"]
    rows = [(7, i, r, t) for i, t in enumerate(odd) for r in ("assistant", "user")]
    rows += [(8, 0, "we%ird\nrole<|", "x"), (8, 0, "a", "tie"), (8, None, None, None), (None, 1, "assistant", "n"), (8, 0, "a", "tie")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    formatted = chat.format_conversations(chat.events_of_turns(frame))
    for r in formatted.collect():
        assert r.formatted.count("<|") == 2 * sum(x[0] == r.conv_id for x in rows)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for conv in (7, 8, None):
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        assert got[conv].n_turns == len(own)
        assert got[conv].turns_text == "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        assert got[conv].loss_text == "".join(x for _, _, r, x in own if r == "assistant")
    assert chat.format_conversations(chat.events_of_turns(frame.limit(0))).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    frame = queries()["op4_chat"](spark, sf)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
        assert sorted(db.execute(chat.ORACLE).fetchall()) == sorted(tuple(r) for r in frame.collect())
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def _plainly(log):
    """The final messages of a log, event by event."""
    out = {}
    for conv in dict.fromkeys(e[0] for e in log):
        messages, begun, numbered = [], None, 0
        for _, _, kind, msg, role, text in sorted((e for e in log if e[0] == conv), key=lambda e: e[1]):
            numbered += 1
            kind = kind or "message"
            if kind == "message":
                begun = msg or f"own {numbered}"
            key = msg or begun or f"own {numbered}"
            own = next((m for m in messages if m["key"] == key), None)
            if own is None:
                messages.append(own := {"key": key, "role": None, "text": "", "gone": False})
            elif kind in ("edit", "regenerate"):
                for later in messages[messages.index(own) + 1 :]:
                    later["gone"] = True
            own["role"] = role if role is not None else own["role"]
            own["text"] = own["text"] + (text or "") if kind == "delta" else text or ""
        out[conv] = [(m["role"] or "", m["text"]) for m in messages if not m["gone"]]
    return out


def test_random_logs_against_a_plain_fold(spark):
    rng, log = random.Random(12), []
    for conv in range(60):
        known = []
        for seq in range(rng.randint(0, 14)):
            kind = rng.choice(["message", "message", "delta", "delta", "edit", "regenerate", None])
            if kind in ("message", None):
                known.append(f"m{len(known)}")
            msg = (known[-1] if kind in ("message", None) else rng.choice(known)) if known and rng.random() < 0.85 else None
            text = None if kind == "regenerate" or rng.random() < 0.1 else rng.choice(["a", "bb ", "<|x", "é", ""])
            log.append((conv, seq, kind, msg, rng.choice(["user", "assistant"]) if kind in ("message", None) else None, text))
    got = {}
    for r in chat.fold(spark.createDataFrame(log, LOG).repartition(5)).orderBy("conv_id", "place").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert got == {c: m for c, m in _plainly(log).items() if m}


def test_long_texts(spark):
    text = "<|im_end|> é" * 40_000
    frame = spark.createDataFrame([(1, 0, "assistant", text, "x")], "conv_id long, turn long, role string, text string, kind string")
    row = chat.read_back(chat.format_conversations(chat.events_of_turns(frame))).first()
    assert row.loss_text == text and row.n_turns == 1

