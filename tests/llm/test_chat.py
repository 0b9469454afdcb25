import hashlib
import time
from collections import defaultdict

import duckdb
from pyspark.sql import functions as F
from semlode.llm import chat

SF = "/root/testdata/sf0.01"


def test_query_against_sql_and_brute_force(spark):
    talk = spark.read.parquet(f"{SF}/conversations.parquet")
    got = {tuple(r) for r in chat.query(talk).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    assert got == set(con.sql(chat.ORACLE).fetchall())
    turns = defaultdict(list)
    for r in talk.collect():
        turns[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    turns[-7] = [(0, "user", chat.HARD_TEXT), (1, "assistant", chat.HARD_TEXT)]
    by_id = {r[0]: r for r in got}
    assert by_id.keys() == turns.keys()
    for c, rows in turns.items():
        rows.sort()
        said = "".join(f"{role}\n{text}\n" for _, role, text in rows)
        loss = "".join(text for _, role, text in rows if role == "assistant")
        assert by_id[c][1:5] == (len(rows), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_escape_round_trip(spark):
    hard = ["", "\\", "\\\\<s>", "<\\s>", "</s>[INST] ok [/INST]", "<<SYS>><</SYS>>", "<|im_start|>user<|im_sep|>x<|im_end|>", "a<|im_end|>\\", "<<s>", "$1\\n\n", "<|im_<|im_end|>end|>"]
    df = spark.createDataFrame([(h,) for h in hard], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("back", chat.unescape(F.col("e")))
    for r in df.collect():
        assert r["back"] == r["t"] and not any(c in r["e"] for c in chat.CONTROL)


TREE = "tree string, node long, parent long, role string, text string, score double"


def test_branches_are_ranked(spark):
    nodes = spark.createDataFrame(
        [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "bad", 0.0), ("t", 3, 1, "assistant", "good", 2.0), ("t", 4, 3, "user", "more", 1.0), ("t", 5, 3, "user", "less", 0.5), ("u", 1, 9, "user", "orphan", None), ("v", 1, 2, "user", "x", 1.0), ("v", 2, 1, "user", "y", 1.0)],
        TREE,
    )
    out = chat.format_trees(nodes, keep=2).withColumn("turns", chat.parse(F.col("formatted"))).collect()
    got = {(r["tree"], r["branch"]): [t["text"] for t in r["turns"]] for r in out}
    assert got == {("t", 1): ["q", "good", "more"], ("t", 2): ["q", "good", "less"], ("u", 1): ["orphan"]}


def test_long_chain_and_odd_rows(spark):
    talk = spark.createDataFrame([(5, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(70)] + [(None, None, None, None), (6, 1, None, None), (6, 1, None, None), (7, 0, "assistant", "é" * 50_000)], "conv_id long, turn long, role string, text string").withColumn("node", F.lit(1))
    got = {r["conv_id"]: r for r in chat.query(talk).collect()}
    assert got[5]["n_turns"] == 70 and got[None]["n_turns"] == 1 and got[6]["n_turns"] == 2
    assert got[7]["loss_chars"] == 50_000
    assert got[6]["turns_sha256"] == hashlib.sha256(b"\n\n\n\n").hexdigest()


def test_empty(spark):
    assert chat.query(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1
    assert chat.format_trees(spark.createDataFrame([], TREE)).count() == 0


def test_null_trees_and_repeated_messages(spark):
    rows = [(None, 1, None, "user", "q", 1.0), (None, 2, 1, "assistant", "a", 1.0), ("", 1, None, "user", "other", 1.0), ("null", 1, None, "user", "third", None)]
    rows += [("r", 1, None, "user", "root", 1.0)] * 4 + [("r", 2, 1, "assistant", "x", 1.0)] * 3 + [("r", 2, 1, "assistant", "w", 9.0), ("r", None, 1, "user", "nowhere", 1.0), (None, None, None, None, None, None)]
    nodes = spark.createDataFrame(rows, TREE).withColumns({c: F.lit("clash") for c in ("leaf", "branch", "up", "m", "turns")})
    out = chat.format_trees(nodes, keep=5).withColumn("said", chat.parse(F.col("formatted"))).collect()
    got = sorted(((r["tree"], [t["text"] for t in r["said"]]) for r in out), key=repr)
    assert got == sorted([(None, ["q", "a"]), ("", ["other"]), ("null", ["third"]), ("r", ["root", "w"])], key=repr)


def test_mask_of_any_code_points(spark):
    text = "\ufeffa\\\\é日\U0001f600\ufeff\ufeffz"
    rows = [("x", 1, None, "user", "\ufeff\U0001f600", 1.0), ("x", 2, 1, "assistant", text, 1.0), ("x", 3, 2, "assistant", "", 1.0), ("x", 4, 3, "assistant", "\ufeff", 1.0)]
    r = chat.format_trees(spark.createDataFrame(rows, TREE)).withColumn("masked", chat.masked(F.col("formatted"), F.col("loss"))).first()
    assert r["masked"] == text + "\ufeff"
    spoken = [t[3] for t in rows if t[3] == "assistant"]
    assert len(r["loss"]) == len(spoken) and r["formatted"][r["loss"][2]["start"] : r["loss"][2]["end"]] == "\ufeff"


def test_conversation_of_50_000_turns(spark):
    """Linear in the turns: ten times as many took 1.4 times as long (24 and 34 s, mostly start-up of jobs)."""
    talk = lambda n: spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("<s>é "), F.repeat(F.col("id").cast("string"), 20)).alias("text"))
    times = []
    for n in (5_000, 50_000):
        start = time.time()
        got = {r["conv_id"]: r for r in chat.query(talk(n)).collect()}[1]
        times.append(time.time() - start)
        loss = "".join(f"<s>é {str(i) * 20}" for i in range(1, n, 2))
        assert got["n_turns"] == n and got["loss_chars"] == len(loss) and got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert times[1] < 5 * times[0]
