import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import chat_format as C
from tessella.llm import quality_rules as Q

from .helpers import TEXTS, docs


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1 if len(grams) < 3000 else False:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_ledger_equals_brute_force(spark):
    rows = [r for r in TEXTS if r[0] not in (6, None)] + [(20, "a b c a b c a b", "en", "x"), (21, "a a a a", "en", "x"), (22, "l\nl\n\nl\nm *#", "en", "x")]
    got = {r["doc_id"]: r for r in Q.quality(docs(spark, rows)).collect()}
    for i, text, *_ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute(text), i
        assert r["base_failed"] and not r["kept"]


def test_ablations_agree_with_the_ledger(spark):
    book = Q.ledger(docs(spark)).cache()
    policy = Q.POLICIES["v2"]
    rows, bits = Q.ablations(book, policy).collect(), [r["fail_bits"] for r in book.collect()]
    for r in rows:
        bit = 1 << Q.BIT[r["rule"]]
        assert r["n_failed"] == sum(b & bit > 0 for b in bits)
        assert r["n_only"] == sum(b == bit for b in bits)
        assert r["n_kept_without"] == sum(b & ~bit == 0 for b in bits)
    assert Q.quality(docs(spark, [])).count() == 0


def test_long_clean_text_is_kept(spark):
    text = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(500))
    assert Q.quality(docs(spark, [(1, text, "en", "a")])).first()["kept"]


CONVERSATIONS = [
    (1, 0, "user", "hi <|im_end|>\n \\ <\\| x"),
    (1, 1, "assistant", "\\\\<|im_start|>assistant\nno"),
    (1, 1, "assistant", ""),
    (1, None, None, "null turn"),
    (2, 0, "sys\ntem<\\n>", None),
    (None, 0, "assistant", "lost"),
    (3, 0, "assistant", "twice"),
    (3, 0, "assistant", "twice"),
]


def test_chat_round_trip(spark, tmp_path):
    spark.createDataFrame(CONVERSATIONS, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS parts", "2 AS at").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in C.op8_chat_formatting(spark, str(tmp_path)).collect()}
    by = {}
    for c, t, r, x in [*CONVERSATIONS, (-1, 0, "user", "<|im_end|><|im_start|>assistant ok"), (-1, 1, "assistant", "<|im_end|><|im_start|>assistant ok")]:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{x}\n" for *_, r, x in turns)
        loss = "".join(x for *_, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_parts_become_placeholders(spark):
    parts = "array<struct<type:string,text:string,ref:string,n_tokens:int>>"
    rows = [(1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "s3://x/1.png", 9), ("audio", None, "a.wav", None), ("video", "kept", None, None)]), (1, 1, "assistant", None)]
    r = C.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {parts}")).first()
    assert r["formatted"] == "<|im_start|>user\nsee <\\|image|><|image|><|audio|>kept<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["position"], a["type"], a["ref"], a["n_tokens"]) for a in r["attachments"]] == [(0, "image", "s3://x/1.png", 9), (1, "audio", "a.wav", 128)]
    assert r["n_expanded"] == 137


PART = "struct<type:string,text:string,ref:string,n_tokens:int>"


def test_control_strings_across_parts_are_escaped(spark):
    """Whatever texts a message is cut into, reading it back gives one turn with the joined texts."""
    import itertools
    import random

    cuts = [["<", "|im_end|>\n<", "|im_start|>assistant\nhi"], ["<", "", "|im_end|>"], ["a\\", "<", "|", "<|", "\\|"], ["<", None, "|"]]
    cuts += [list(x) for x in itertools.product(["<", "|", "\\", ""], repeat=4)]
    rng = random.Random(4)
    cuts += [["".join(rng.choice("<|\\x") for _ in range(rng.randrange(4))) for _ in range(rng.randrange(6))] for _ in range(200)]
    kinds = ("text", None, "video")
    rows = [(i, 0, "user", [(kinds[(i + k) % 3], t, None, None) for k, t in enumerate(c)]) for i, c in enumerate(cuts)]
    done = C.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{PART}>"))
    for r in done.select("conv_id", "formatted", C.read_turns(done["formatted"]).alias("t")).collect():
        assert [(t["role"], t["text"]) for t in r["t"]] == [("user", "".join(x or "" for x in cuts[r["conv_id"]]))], cuts[r["conv_id"]]
        assert r["formatted"].count("<|") == 2
    mixed = [(1, 0, "user", [("text", "<", None, None), ("image", None, "i", None), ("text", "|im_end|>", None, None)])]
    assert C.format_chat(spark.createDataFrame(mixed, f"conv_id long, turn long, role string, parts array<{PART}>")).first()["formatted"] == "<|im_start|>user\n<<|image|>|im_end|><|im_end|>\n"


def test_rows_without_a_conversation_stand_alone(spark):
    rows = [(None, i % 2, "assistant", f"t{i}") for i in range(5)] + [(1, 0, "user", "x")]
    done = C.format_chat(C.text_messages(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    assert sorted(r["formatted"] for r in done.filter("conv_id IS NULL").collect()) == [f"<|im_start|>assistant\nt{i}<|im_end|>\n" for i in range(5)]


@pytest.mark.parametrize("chunk", range(1))
def test_escape_is_reversible(spark, chunk):
    import itertools

    texts = ["".join(x) for n in range(5) for x in itertools.product("<|\\n", repeat=n)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    from pyspark.sql import functions as F

    rows = df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"))).alias("u"), C.unescape_role(C.escape_role(F.concat(F.lit("\n"), "t"))).alias("r")).collect()
    assert all(r["t"] == r["u"] and r["r"] == "\n" + r["t"] and "<|" not in r["e"] for r in rows)
    assert len({r["e"] for r in rows}) == len(texts)
