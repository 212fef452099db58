"""What a language's dictionary holds."""

from fathomry.llm import language_id


def test_all_slices_are_learned_in_any_script(spark):
    rows = [(i, lang, "".join(chr(start + (i * 7 + j * j) % 26) for j in range(400))) for start, lang in ((97, "xx"), (0x430, "yy")) for i in range(200)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert [[len(s) for s in model[k].decode().split("\n")] for k in ("xx", "yy")] == [[300] * 200] * 2
