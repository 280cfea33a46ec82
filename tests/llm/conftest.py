import pytest

#: Columns that clash with names inside the operators or in their results.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, f string, fingerprint string, score string, n_lines string, at string, part string, y string, drop_id string, component_id string, toxic string, ids string"
EXTRA = ["x"] * 12
LONG = "lorem Ipsum dolor sit amet consectetur " * 20000
LINE = "This is a repeated line of more than forty characters in all."
SPECIAL = "a <|endoftext|> b\x00c   é 𝒳 \r\n\t end"


def rows():
    out = [(None, None), (None, "text without id"), (0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (4, "one"), (5, LONG), (6, LONG + "x"), (7, SPECIAL)]
    out += [(10 + i, f"{LINE}\nown line number {i} which is long enough to be a key, too {i}\n{LINE.upper()}  ") for i in range(6)]
    out += [(20, "the quick brown fox jumps over the lazy dog again and again"), (21, "The quick  brown fox\njumps over the LAZY dog again and again")]
    return out


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame([(d, t, None, "s", len(t) if t else None, *EXTRA) for d, t in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
