"""Where callers plug in their own functions: token counters, checkers, summarisers, stages, lexicons, data sources."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Stage = Callable[[DataFrame], DataFrame]


class TokenCounterUnavailable(ValueError):
    """No token counter is set; tokens are counted, never guessed from characters."""


_COUNTERS: dict[str, Callable[[pd.Series], pd.Series]] = {"whitespace": lambda s: s.str.split().str.len()}


def register_counter(name: str, count: Callable[[pd.Series], pd.Series]) -> None:
    """``count``: texts -> numbers of tokens, a batch at a time."""
    _COUNTERS[name] = count


def tokens(text: Column, counter: str | None) -> Column:
    """Tokens of a text by a registered counter; white-space words stay in the JVM."""
    if counter not in _COUNTERS:
        raise TokenCounterUnavailable(f"no token counter named {counter!r}")
    if counter == "whitespace":
        return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")
    count = _COUNTERS[counter]

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return count(s.fillna("")).astype("int64")

    return run(text)


def truncated(text: Column, most: int) -> Column:
    """The first ``most`` white-space words of a text, joined by single spaces."""
    return F.array_join(F.slice(F.filter(F.split(text, r"\s+"), lambda w: w != ""), 1, most), " ")


def summarised(docs: DataFrame, provider: Callable[[str, int], list[tuple[int, int]]], top_k: int) -> DataFrame:
    """doc_id, start, end, status of the spans that a provider picks; a span outside of the text is a row of status 'error'."""
    if top_k < 1:
        raise ValueError("top_k must be at least 1")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in it:
            out = []
            for d, t in zip(df["doc_id"], df["text"].fillna(""), strict=True):
                out += [(d, a, b, "ok" if 0 <= a < b <= len(t) else "error") for a, b in provider(t, top_k)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "status"])

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, start long, end long, status string")


def enriched(rows: DataFrame, provider: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Rows as a provider makes them of each batch."""
    return rows.mapInPandas(lambda it: map(provider, it), schema)


def checked(claims: DataFrame, support: Callable[[pd.Series, pd.Series], pd.Series]) -> DataFrame:
    """doc_id, supported_ratio, undetermined of claims (doc_id, claim, evidence) by a checker that says true, false or null.

    The ratio is over what the checker could determine; 0 where that is nothing.
    """

    @F.pandas_udf("boolean")
    def run(c: pd.Series, e: pd.Series) -> pd.Series:
        return support(c, e)

    judged = claims.withColumn("v", run("claim", "evidence"))
    return judged.groupBy("doc_id").agg(F.round(F.coalesce(F.avg(F.col("v").cast("int")), F.lit(0.0)), 6).alias("supported_ratio"), F.count_if(F.col("v").isNull()).alias("undetermined"))


def staged(df: DataFrame, stages: list[tuple[str, Stage]], report: Callable[[DataFrame], Column]) -> tuple[DataFrame, DataFrame]:
    """What a chain of stages gives, and a report: stage, n, measure of each one's result, in one job each."""
    spark, out = df.sparkSession, None
    for i, (name, stage) in enumerate(stages):
        df = df.transform(stage)
        row = df.agg(F.count("*").alias("n"), report(df).alias("measure")).select(F.lit(i).cast("long").alias("place"), F.lit(name).alias("stage"), "n", "measure")
        out = row if out is None else out.union(row)
    return df, out if out is not None else spark.createDataFrame([], "place long, stage string, n long, measure double")


def lexicon_hits(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Words (doc_id, term) that a lexicon (term, category, polarity) has, with its columns; joined on the term, any size."""
    return words.join(lexicon, "term")


def longest_matches(text: Column, lexicon: list[str]) -> Column:
    """Entries of a bounded lexicon in the text, the longest at each place, none overlapping another."""
    entries = sorted({w.lower() for w in lexicon if w}, key=lambda w: (-len(w), w))
    quoted = "|".join("".join("\\" + c if not c.isalnum() and c != " " else c for c in w) for w in entries)
    return F.regexp_extract_all(F.lower(text), F.lit(f"({quoted})"), 1)


#: Entries of a dictionary that are sent to the executors at most.
DICTIONARY = 1_000_000


def dictionary_matches(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """id, entry, start, end of the entries in texts (id, text): from the left, at each place the longest, none overlapping another.

    ``dictionary``: entry, and priority if there (an entry of a lower one gives way to any of a higher one that it overlaps). Case of A-Z
    does not count. All entries are looked for in one pass (Aho-Corasick), however many they are; a dictionary of more than
    DICTIONARY entries is an error. Null texts and entries match nothing.
    """
    priority = F.col("priority").cast("long") if "priority" in dictionary.columns else F.lit(0).cast("long")
    own = dictionary.where("entry <> ''").groupBy(F.translate("entry", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("entry")).agg(F.max(priority).alias("priority"))
    if (n := own.limit(DICTIONARY + 1).count()) > DICTIONARY:
        raise ValueError(f"a dictionary of more than {DICTIONARY} entries")
    sent = texts.sparkSession.sparkContext.broadcast([tuple(r) for r in own.toLocalIterator()] if n else [])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for entry, p in sent.value:
            automaton.add_word(entry, (p, len(entry), entry))
        if sent.value:
            automaton.make_automaton()
        for df in it:
            out = []
            for i, t in zip(df["id"], df["text"].fillna(""), strict=True):
                low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
                found = sorted((-p, end + 1 - size, -size, entry) for end, (p, size, entry) in automaton.iter(low)) if sent.value else []
                kept: list[tuple[int, int, str]] = []
                for _, group in itertools.groupby(found, key=lambda f: f[0]):  # the highest priority first
                    taken, free = sorted(kept), 0
                    for _, start, size, entry in group:
                        end = start - size
                        k = bisect.bisect_right(taken, (start, end, entry))
                        if start >= free and (not k or taken[k - 1][1] <= start) and (k == len(taken) or taken[k][0] >= end):
                            kept.append((start, end, entry))
                            free = end
                out += [(i, e, a, b) for a, b, e in sorted(kept)]
            yield pd.DataFrame(out, columns=["id", "entry", "start", "end"])

    kind = dict(texts.dtypes)["id"]
    return texts.select("id", "text").mapInPandas(run, f"id {kind}, entry string, start long, end long")


def rounded(x: Column, digits: int) -> Column:
    """A double rounded half to even by its exact binary value, as Python does; the JVM's bround() takes the shortest decimal for it."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: round(v, digits), na_action="ignore")

    return run(x)


class _Lines(DataSourceReader):
    def __init__(self, options: dict):
        self.texts = options.get("texts", "").split("\x1e")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(len(self.texts))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for n, line in enumerate(self.texts[partition.value].split("\n")):
            yield partition.value, n, line


class LinesSource(DataSource):
    """A Python data source of block rows, one partition a text: the shape of a parser that is plugged in."""

    @classmethod
    def name(cls) -> str:
        return "evidex_lines"

    def schema(self) -> str:
        return "doc int, pos int, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Lines(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LinesSource)
