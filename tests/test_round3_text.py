"""Texts on which queries and their SQL once parted."""

from pyspark.sql import functions as F

from millrace.functions import prompts, scalars


def test_cut_references_stay(spark):
    texts = ["a&amp</title>", "&amp;lt; &#38;#60; &copy;", "&#128;&#xD800;&#00065;&#99999999;&bogus; &;", "none", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.t for r in df.select("i", scalars.clean_html(F.col("t")).alias("t")).orderBy("i").collect()] == ["a&amp", "&lt; &#60; ©", "€�A�&bogus; &;", "none", None]


def test_white_space_is_no_part_of_forty_characters(spark):
    texts = ["Prompt: " + "x" * 39, "Prompt: " + "x" * 40, "Prompt: " + "x" * 1999 + " y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r.t for r in df.select("i", scalars.prompt_of_page(F.col("t")).alias("t")).orderBy("i").collect()] == [texts[0], "x" * 40, "x" * 1999]


def test_a_number_in_front_makes_no_json(spark):
    chunk = lambda kind, body: len(body).to_bytes(4, "big") + kind + body + b"\0\0\0\0"
    text = "4754543480058766 words that follow a number, forty and more characters"
    png = prompts.PNG_SIGNATURE + chunk(b"iTXt", b"parameters\0\0\0\0\0" + text.encode()) + chunk(b"IEND", b"")
    assert spark.createDataFrame([(bytearray(png),)], "content binary").select(prompts.png_text_prompt(F.col("content"))).first()[0] == text


def test_json_is_judged_whole(spark):
    texts = {'{"a": 1} ': True, "1": True, "1 x": False, "1, 2": False, '1, "b": 2': False, "1],[2": False, "1}": False, "": False}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.o for r in df.select("t", prompts.is_json(F.col("t")).alias("o")).collect()} == texts


def test_a_listing_needs_no_python_workers(spark, capsys):
    from millrace.sources import feeds

    feeds.reddit_listing(spark.createDataFrame([("{}",)], "value string")).explain()
    assert "Python" not in capsys.readouterr().out
