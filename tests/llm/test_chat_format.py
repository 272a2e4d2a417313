from collections import defaultdict
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st

from bytestrata.llm import chat_format as c
from bytestrata.llm.queries import TRAP, op10_chat_format

TEXT = st.lists(st.sampled_from([*"ab\\<>/:é🙂\n", "</turn>", "<turn:user>", "<image:0>"]), max_size=30).map("".join)
PARTS = st.lists(st.one_of(TEXT.map(lambda t: {"type": "text", "text": t}), st.sampled_from([{"type": "image", "ref": "i.png", "width": 60, "height": 28}, {"type": "audio", "ref": "a.wav", "seconds": 2.0}, {"type": "document", "ref": "d.pdf", "pages": 3}])), max_size=5)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a>b\\<"]), PARTS), max_size=6))
def test_round_trip(turns):
    made = c.format_turns(turns)
    assert [(r, t) for r, t, _ in c.read_back(made.text)] == [(r, "".join(p.get("text", "") for p in ps)) for r, ps in turns]
    kinds = [k for _, _, found in c.read_back(made.text) for k, _ in found]
    assert kinds == [p["type"] for _, ps in turns for p in ps if p["type"] != "text"] == [a[0] for a in made.attachments]
    assert all(made.text.startswith(f"<{a[0]}:{k}>", a[2]) for k, a in enumerate(made.attachments))
    assert "".join(c.unescape(made.text[a:b]) for a, b in made.loss) == "".join(p.get("text", "") for r, ps in turns if r == "assistant" for p in ps)
    assert made.expanded_tokens == sum({"image": 3, "audio": 50, "document": 768}.get(p["type"], 0) for _, ps in turns for p in ps)


def _brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said, learnt = "".join(f"{r}\n{t}\n" for *_, r, t in turns), "".join(t for *_, r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha256(said.encode()).hexdigest(), len(learnt), sha256(learnt.encode()).hexdigest())
    return out


def test_query_on_real_conversations(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{d}/conversations.parquet").collect()]
    got = {r.conv_id: tuple(r)[1:5] for r in op10_chat_format(spark, d).collect()}
    assert got == _brute([*rows, (-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)])


def test_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, None, "assistant", "late"), (1, 1, None, "x</turn>"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a"), (None, 0, "user", "n"), (2, 0, "assistant", "y" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS parts", "3 AS turns")
    assert {r.conv_id: tuple(r)[1:5] for r in c.digests(c.format_chats(df)).collect()} == _brute(rows)
    assert c.digests(c.format_chats(df.limit(0))).count() == 0


def test_parts_column(spark):
    part = {"type": "image", "text": None, "ref": "r", "width": 28, "height": 28, "seconds": None, "pages": None}
    df = spark.createDataFrame([(1, 0, "user", [part, None]), (1, 1, "user", None)], f"conv_id long, turn long, role string, content array<{c.PART}>")
    row = c.format_chats(df, parts_col="content").first()
    assert row.formatted == "<turn:user><image:0></turn><turn:user></turn>" and row.attachments[0].ref == "r" and row.expanded_tokens == 1


def test_unknown_parts_are_kept(spark):
    none = dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages"))
    video = none | {"type": "video", "ref": "v.mp4", "seconds": 2.0, "width": 28, "height": 56}
    odd = none | {"type": "</turn>", "ref": "<", "text": "said <so>"}
    bare = none | {"type": None, "text": "plain"}
    df = spark.createDataFrame([(1, 0, "user", [video, odd]), (1, 1, "assistant", [bare, odd])], f"conv_id long, turn long, role string, content array<{c.PART}>")
    row = c.format_chats(df, parts_col="content").first()
    assert c.read_back(row.formatted) == [("user", "said <so>", [("part", 0), ("part", 1)]), ("assistant", "plainsaid <so>", [("part", 2)])]
    assert [(a.kind, a.ref, a.tokens) for a in row.attachments] == [("video", "v.mp4", 100), ("</turn>", "<", 1), ("</turn>", "<", 1)] and row.expanded_tokens == 102
    assert "".join(c.unescape(row.formatted[s.start : s.end]) for s in row.loss) == "plainsaid <so>"


def test_table_of_all_parts(spark):
    """Every kind of part in the order that it stands in, over many conversations."""
    kinds = [{"type": "text", "text": "look <here>"}, {"type": "image", "ref": "i", "width": 57, "height": 28}, {"type": "audio", "ref": "a", "seconds": 0.01}, {"type": "document", "ref": "d", "pages": 2}]
    full = [dict.fromkeys(("text", "ref", "width", "height", "seconds", "pages")) | k for k in kinds]
    rows = [(n, t, "user" if t % 2 == 0 else "assistant", [full[(n + t + k) % 4] for k in range(n % 5)]) for n in range(40) for t in range(3)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{c.PART}>").repartition(7)
    tokens = {"text": 0, "image": 3, "audio": 1, "document": 512}
    for r in c.format_chats(df, parts_col="content").collect():
        parts = [p for x in rows if x[0] == r.conv_id for p in x[3]]
        assert [(a.kind, a.ref) for a in r.attachments] == [(p["type"], p["ref"]) for p in parts if p["type"] != "text"]
        assert r.expanded_tokens == sum(tokens[p["type"]] for p in parts) and all(r.formatted[a.place :].startswith(f"<{a.kind}:{k}>") for k, a in enumerate(r.attachments))
