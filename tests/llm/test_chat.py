"""Reply trees and the reversible template."""

import hashlib
import random

import duckdb

from tideline.llm import chat
from tideline.llm.queries import ORACLES, QUERIES

NODES = "tree long, node long, parent long, role string, text string, score double"


def test_template_is_reversible_and_safe():
    rng = random.Random(8)
    pieces = [*chat.CONTROL, "\\", "<", "]", "[", " ", "a", "\n", "é", "\\s>", "<\\s>"]
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "", "a]b", "x\\"]), "".join(rng.choice(pieces) for _ in range(rng.randint(0, 12)))) for _ in range(rng.randint(0, 6))]
        text, spans = chat.format_turns(turns)
        assert chat.read_turns(text) == turns
        assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        assert text.count("<s>") == text.count("</s>") == len(turns)


def test_branches_are_enumerated_and_ranked(spark):
    nodes = [(1, 0, None, "user", "q", 1.0), (1, 1, 0, "assistant", "bad", 0.0), (1, 2, 0, "assistant", "good", 3.0), (1, 3, 2, "user", "more", 2.0), (1, 4, 3, "assistant", None, None), (1, 5, 2, None, "end", 9.0)]
    nodes += [(2, 0, 77, "user", "orphan", 0.0), (2, 0, 77, "user", "orphan", 0.0), (3, 1, None, "user", "one", 0.0), (3, 2, None, "user", "two", 0.0)]
    df = spark.createDataFrame([(*n, "x") for n in nodes], NODES + ", formatted string")
    best = {r["tree"]: r for r in chat.format_trees(df).collect()}
    assert chat.read_turns(best[1]["formatted"]) == [("user", "q"), ("assistant", "good"), ("", "end")]
    assert best[1]["leaf"] == 5 and best[2]["n_turns"] == 1 and best[3]["leaf"] == 1
    every = [(r["tree"], r["leaf"], r["n_turns"]) for r in chat.format_trees(df, branches=10).collect()]
    assert sorted(every) == [(1, 1, 2), (1, 4, 4), (1, 5, 3), (2, 0, 1), (3, 1, 1), (3, 2, 1)]
    assert chat.format_trees(df.where("false")).count() == 0


def test_deep_chain_and_null_conversation(spark):
    rows = [(None, t, "user" if t % 2 else "assistant", f"t{t}") for t in range(70)] + [(4, None, None, None)]
    told = {r["conv_id"]: r for r in chat.digests(chat.format_trees(chat.reply_chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert told[None]["n_turns"] == 70 and told[None]["loss_chars"] == sum(len(f"t{t}") for t in range(0, 70, 2))
    assert told[4]["n_turns"] == 1 and told[4]["loss_chars"] == 0


def test_query_equals_its_sql(spark):
    data = "/root/testdata/sf0.001"
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{data}/conversations.parquet'")
    df = QUERIES["op9_chat_format"](spark, data)
    want = duckdb.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLES['op9_chat_format']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_repeated_turns_are_each_kept(spark):
    """Rows that repeat a (conv_id, turn), alike or not, are turns of their own, in the order of role and text."""
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (2, None, "user", "first"), (2, 0, "assistant", "second")]
    digests = {r["conv_id"]: r for r in chat.digests(chat.format_trees(chat.reply_chain(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    whole = "user\na\nuser\nb\nassistant\nx\nassistant\nx\n"
    assert digests[1]["n_turns"] == 4 and digests[1]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest() and digests[1]["loss_chars"] == 2
    assert digests[2]["turns_sha256"] == hashlib.sha256(b"user\nfirst\nassistant\nsecond\n").hexdigest()
