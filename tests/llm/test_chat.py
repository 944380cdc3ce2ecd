import collections

from inkspan.llm import chat


def brute(rows):
    """Every rendering as one string, and what is learned of it."""
    out = {}
    convs = collections.defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, (r or "").encode(), (x or "").encode(), t, r or "", x or ""))
    esc = lambda s: s.replace("<|", "<\\|").replace("|>", "|\\>")
    for c, turns in convs.items():
        turns.sort(key=lambda t: t[:4])
        for me in {t[5] for t in turns} - {"system"}:
            text, learned = "", []
            for *_, role, x in turns:
                if role == me:
                    text += "<|assistant|>\n"
                    learned.append(esc(x) + "<|end|>")
                else:
                    text += "<|system|>\n" if role == "system" else f"<|user name={esc(role)}|>\n"
                text += esc(x) + "<|end|>\n"
            out[c, me] = (text, learned)
    return out


def check(spark, rows):
    turns = spark.createDataFrame([(*r, "z", 5) for r in rows], "conv_id long, turn long, role string, text string, part string, seq int")
    got = collections.defaultdict(list)
    for r in chat.rotate(turns).collect():
        got[r.conv_id, r.perspective].append(r)
    want = brute(rows)
    assert got.keys() == want.keys()
    for k, part in got.items():
        part.sort(key=lambda r: r.seq)
        text = "".join(r.rendered for r in part)
        assert [r.seq for r in part] == list(range(len(part)))
        assert text == want[k][0]
        assert all(text[r.start : r.end] == r.rendered for r in part)
        assert [text[r.loss_start : r.loss_end] for r in part if r["mask"]] == want[k][1]
        assert all((r["mask"] == 1) == (r.role == "assistant") for r in part)


def test_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "RANGE_ROWS", 40)
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_one_long_conversation(spark, monkeypatch):
    """Many speakers, more turns than a range holds, and turns that tie."""
    monkeypatch.setattr(chat, "RANGE_ROWS", 7)
    rows = [(1, i // 3, f"s{i * i % 5}" if i % 9 else "system", f"é text {i % 4}") for i in range(120)]
    check(spark, rows + [(2, 0, "a", "x"), (2, 0, "a", "x"), (2, 0, "b", "<|end|> |>")])


def test_edges(spark):
    check(spark, [(None, None, None, None), (None, 1, "u", "t"), (3, 0, "system", "only"), (4, 0, "a<|b", ""), (4, 0, "c", "w" * 300_000)])
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
