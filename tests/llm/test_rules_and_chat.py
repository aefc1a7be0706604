import hashlib
import json
import random
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import chat_format as chat
from quillgraph.llm import quality_rules as rules
from quillgraph.llm.shared import shared_folder

from .helpers import HARD, WORD, by, docs


def repeats(words, n):
    seen, twice, later = Counter(), set(), set()
    count = Counter(tuple(words[k:k + n]) for k in range(len(words) - n + 1))
    for k in range(len(words) - n + 1):
        w = tuple(words[k:k + n])
        if count[w] > 1:
            twice |= set(range(k, k + n))
        if seen[w]:
            later |= set(range(k, k + n))
        seen[w] += 1
    return twice, later


def brute(text, limits):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, WORD.findall(line)))
            seen.add(line)
    r = len(repeats(words, 3)[0])
    failed = len(words) < 50 or 100 * r > 50 * len(words)
    short = len(words) < limits.short
    good = dup_chars <= (limits.short_lines if short else limits.lines) * chars
    for n, most in (limits.short_ngrams if short else limits.ngrams).items():
        good &= sum(len(words[k]) for k in repeats(words, n)[1]) / max(chars, 1) <= most
    return {
        "n_words": len(words), "word_chars": chars, "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": dup,
        "n_repeat_words": r, "base_failed": failed, "kept": good and not failed,
    }


def same(got, texts):
    for k, text in texts.items():
        row = {c: v for c, v in got[k].items() if c not in ("doc_id", "repeat_share", "line_repeat_share")}
        assert row == brute(text, rules.Limits()), k


def test_op9(spark, sf):
    same(by(rules.op9_quality_rules(spark, sf)), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_op9_hard_cases(spark):
    random.seed(4)
    texts = HARD + ["".join(random.choices(["a", "b ", " c", "\n", "ß ", "\x0b"], k=random.randint(0, 400))) for _ in range(60)]
    same(by(rules.quality_rules(docs(spark, texts, extra=True))), dict(enumerate(texts)))
    assert rules.quality_rules(docs(spark, [])).count() == 0


def test_op9_limits_by_length(spark):
    """A line that comes again is nothing in a short text; the same share of a long one is rejected."""
    def text(n):
        lines = [" ".join(f"{k}.{j}" for j in range(12)) for k in range(n // 12)]
        return "\n".join(lines + lines[: max(1, len(lines) // 6)])

    texts = [text(72), text(180), text(240), text(2400), "\n".join(text(2400).split("\n")[:205])]
    got = by(rules.quality_rules(docs(spark, texts)))
    assert [got[k]["n_words"] < 200 for k in range(5)] == [True, False, False, False, False]
    assert [got[k]["kept"] for k in range(5)] == [True, False, False, False, True]
    same(got, dict(enumerate(texts)))


def test_op9_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = by(rules.op9_quality_rules(spark, sf))
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [got[r.doc_id] for r in labels if r.quality == 1]
    assert sum(r["kept"] or r["base_failed"] for r in good) > 0.95 * len(good)


CONTROL = st.text(st.sampled_from(["\\", "<", ">", "/", "s", "[", "]", "INST", "SYS", "ROLE", "</s>", "[INST]", "a", "é", "\n"]), max_size=12)
PIECES = st.lists(st.sampled_from(["\\", "<", ">", "/", "s", "[", "]", "INST", "SYS", "ROLE", "</s>", "[INST]", "<<SYS>>", "a", "é", "\n"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "</s>"]), PIECES), max_size=5))
def test_template_round_trip(turns):
    out = [chat.turn_text(r, t) for r, t in turns]
    assert list(chat.turns_of("".join(o[0] for o in out))) == turns
    for (role, text), (written, a, b) in zip(turns, out):
        assert chat.unescape(written[a:b]) == (text if role == "assistant" else "")
        assert not any(c in chat.escape(text) for c in chat.CONTROL)


def digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        out[conv] = {
            "conv_id": conv, "n_turns": len(turns), "turns_sha256": hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest(),
            "loss_chars": len(loss), "loss_sha256": hashlib.sha256(loss.encode()).hexdigest(),
        }
    return out


def without_size(got):
    return {k: {c: v for c, v in r.items() if c != "formatted_chars"} for k, r in got.items()}


def test_op10(spark, sf):
    said = "</s>[INST] ok [/INST]"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = by(chat.op10_chat_format(spark, sf), "conv_id")
    assert without_size(got) == digests([*rows, (-1, 0, "user", said), (-1, 1, "assistant", said)])
    assert all(r["formatted_chars"] >= r["loss_chars"] for r in got.values())


def test_layouts_meet(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"}, {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": "", "output": "a"}, {"system": "", "instruction": "q", "output": "a"},
        {"data": {"question": "q", "answer": "a"}},
    ]
    df = spark.createDataFrame([(k, 0, json.dumps(r)) for k, r in enumerate(records)] + [(98, 0, '{"odd": 1}'), (99, 0, None)], "conv_id long, turn long, record string")
    got = {}
    for r in chat.canonical_turns(df).orderBy("conv_id", "turn", "part").collect():
        got.setdefault(r.conv_id, []).append((r.role, r.text))
    assert all(got[k] == [("user", "q"), ("assistant", "a")] for k in range(len(records)))
    assert got[98] == [(None, '{"odd": 1}')] and got[99] == [(None, "")]


def test_parts_nulls_and_ties(spark, monkeypatch):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, 0, "assistant", "a"), (2, 1, "tool", "</s>"), *[(3, k, "assistant", "long text " * 9000) for k in range(40)]]
    turns = spark.createDataFrame([(c, t, 0, r, x, 5) for c, t, r, x in rows], "conv_id long, turn long, part long, role string, text string, Part long")
    folder = shared_folder(spark, "chat-test")
    chat.write_formatted(turns, folder)
    assert spark.read.parquet(folder).where("conv_id = 3").count() > 1
    want = digests([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    assert without_size(by(chat.read_digests(spark, folder), "conv_id")) == want
    empty = shared_folder(spark, "chat-test")
    chat.write_formatted(turns.where("false"), empty)
    assert chat.read_digests(spark, empty).count() == 0
