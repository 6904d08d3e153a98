from __future__ import annotations

from gapweave.llm import quotes

COLUMNS = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "Hello all.\nHow do I sort a list? Please help."),
    (1, 1, "assistant", "On Monday the user wrote:\n> Hello all.\n> How do I sort a list? Please help.\n\nUse sorted(). It is stable."),
    (1, 2, "user", "Unrelated question here."),
    (1, 3, "user", "> > How do I sort a list?\n> Use sorted().  It is\n> stable.\nThanks a lot!"),
    (1, 4, "assistant", ">Unrelated question HERE.\nAnswer"),
    (1, 5, "user", None),
    (1, 6, "user", "> Unrelated question here.\n> Answer\nSee > 3"),
    (1, 0, "user", "Hello all.\nHow do I sort a list? Please help."),
    (2, 0, "user", "> How do I sort a list? Please help.\nA new one"),
    (2, 1, "user", ""),
    (None, 0, "user", "first"),
    (None, 1, "user", "> first\nsecond"),
    (3, None, None, "no turn"),
    (3, 1, "x", "> no turn\nyes"),
]


def threads(spark, rows):
    table = spark.createDataFrame(rows, COLUMNS)
    from pyspark.sql import functions as F

    table = table.withColumn("body", F.lit("x")).withColumn("id", F.lit(1)).withColumn("depth", F.lit("d"))
    got = quotes.conversations(table).collect()
    turn = {r.id: r.turn for r in got}
    return got, {(r.conv_id, r.turn): (turn.get(r.parent) if r.parent else None, r.depth, r.position, r.body) for r in got}


def test_threads(spark):
    got, by = threads(spark, ROWS)
    assert len(got) == len(ROWS) - 1
    assert by[1, 1] == (0, 1, 1, "Use sorted(). It is stable.")
    assert by[1, 3] == (1, 2, 2, "Thanks a lot!")
    assert by[1, 4] == (2, 1, 4, "Answer")
    assert by[1, 5] == (None, 0, 6, "")
    assert by[1, 6] == (2, 1, 5, "See > 3")  # more letters of turn 2 than of turn 4
    assert by[2, 0] == (None, 0, 0, "A new one")  # its original is in another conversation
    assert by[None, 1] == (0, 1, 1, "second")
    assert by[3, 1] == (None, 1, 1, "yes") and by[3, None][1] == 0
    assert all(">" not in r.body.split("\n")[0][:1] for r in got)


def test_long_chains_and_many_replies_to_one(spark, monkeypatch):
    monkeypatch.setattr(quotes, "SLICE", 7)
    chain = [(1, i, "u", (f"> message number {i - 1}\n" if i else "") + f"message number {i}") for i in range(40)]
    star = [(2, i, "u", ("> the start of it\n" if i else "") + ("the start of it" if not i else f"reply {i}")) for i in range(60)]
    got, by = threads(spark, chain + star)
    assert all(by[1, i][:3] == (i - 1 if i else None, i, i) for i in range(40))
    assert all(by[2, i][:3] == (0 if i else None, min(i, 1), i) for i in range(60))


def test_nested_levels():
    body, passages = quotes.parse("a\n> b\n>> c\n>> d\n>\n> e\n>e2\nf")
    assert body == "a\nf" and passages == [(1, ["b"]), (2, ["c", "d"]), (1, ["e", "e2"])]


def test_common_passage_is_linked_once(spark):
    rows = [(1, i, "u", "thanks") for i in range(50)] + [(1, 50 + i, "u", f"> thanks\n{i}") for i in range(50)]
    links = quotes.quotation_links(quotes.messages(spark.createDataFrame(rows, COLUMNS)))
    assert links.count() == 50


def test_no_rows_and_very_long_text(spark):
    assert threads(spark, [])[0] == []
    long = "word " * 100_000
    _, by = threads(spark, [(1, 0, "u", long), (1, 1, "u", "> " + long + "\nok")])
    assert by[1, 1][0] == 0


def test_whole_table(spark, folder):
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    got = quotes.op6(spark, folder)
    assert got.count() == table.select("conv_id", "turn", "role", "text").distinct().count()
    assert got.groupBy("conv_id").agg({"position": "max", "turn": "count"}).filter("`max(position)` + 1 <> `count(turn)`").count() == 0
