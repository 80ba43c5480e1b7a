"""Repeated runs of lines and sentences that are short on their own."""

from terrafold.llm import substring_dedup

VERSE = [f"line {k} of verse" for k in range(15)] + ["end"]


def test_repeated_verse_goes_entirely(spark):
    verse = "\n".join(VERSE)
    told = " ".join(f"{x}." for x in ("He came home", "She saw him", "They sat down", "Nobody said much"))
    rows = [
        (1, f"before it\n{verse}\nafter that"),
        (2, f"something else\n{verse}\nother words"),
        (3, f"Own start. {told} Own end."),
        (4, f"Different. {told} Closing words."),
        (5, "a b\n" * 12),
        (6, "before it\nyes\nend"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    gone = substring_dedup.repeated_units(df, runs=True)
    kept = {r["doc_id"]: r["text"].split() for r in substring_dedup.remove_units(df, gone).collect()}
    assert kept[2] == "something else other words".split()
    assert kept[4] == "Different. Closing words.".split()
    assert all(kept[i] == dict(rows)[i].split() for i in (1, 3, 6))
    assert kept[5] == ["a", "b"] * 4
    assert substring_dedup.repeated_units(df).filter("doc = 2").count() == 0


def test_passages_that_cut_units(spark):
    """A passage of 50 words that begins and ends within sentences goes with its whole sentences, a sentence alone stays."""
    words = [f"w{i}" for i in range(1, 51)]
    passage = " ".join(w + "." if i % 12 == 9 else w for i, w in enumerate(words))
    alone = "one sentence of eight words stands in both."
    rows = [
        (1, f"Own start of the first {passage} and its own end. Other words here. {alone}"),
        (2, f"Another start of a second one {passage} with other words after it. Nothing else now. {alone}"),
        (3, f"Short. {alone} Own."),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    units = lambda **x: substring_dedup.repeated_units(df, runs=True, run_words=40, **x)
    assert units().count() == 0
    gone = units(ends=True).collect()
    assert {r["doc"] for r in gone} == {2} and {r["run_words"] for r in gone} == {36}
    kept = {r["doc_id"]: r["text"] for r in substring_dedup.remove_units(df, units(ends=True)).collect()}
    assert "w11 " not in kept[2] and "w46." not in kept[2] and alone in kept[2] and kept[1] == rows[0][1] and kept[3] == rows[2][1]
