"""Views of tables as corpora, and generated ones of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import draw


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a table of one row group would be the
    work of one. Tables that are scanned in enough parts are left as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spread(df.select(*columns) if columns else df.select("doc_id", "text", "lang"))


def words_of(text: Column) -> Column:
    """The words between spaces and newlines; none of null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \n]+"), lambda w: w != "")


def tokens(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, pos (from 0), word."""
    return df.select(*keys, F.posexplode(words_of(F.col(text_col))).alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


def lines(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, ln (from 0), text: the lines, without spaces; empty ones are left out."""
    one = df.select(*keys, F.posexplode(F.split(text_col, "\n")).alias("ln", "text"))
    return one.select(*keys, F.col("ln").cast("long").alias("ln"), F.replace(F.col("text"), F.lit(" "), F.lit("")).alias("text")).where("text <> ''")


def shape_tag(word: Column) -> Column:
    """A tag that the word's form gives, as the tables have none."""
    first = F.substring(word, 1, 1)
    return F.when(F.right(word, F.lit(1)).isin(".", ","), "PUNCT").when(first != F.lower(first), "CAP").when(F.char_length(word) <= 3, "FUNC").otherwise("WORD")


def tagged(df: DataFrame, words_col: str = "words") -> DataFrame:
    """df with tokens: (word, tag) with the words' shape tags."""
    return df.withColumn("tokens", F.transform(words_col, lambda w: F.struct(w.alias("word"), shape_tag(w).alias("tag"))))


def generated_vocabulary(spark: SparkSession, size: int, shortest: int = 2, longest: int = 8, seed: int = 0) -> DataFrame:
    """(word_id, word): words of random lower-case letters."""
    letters = F.transform(F.sequence(F.lit(1), F.lit(shortest) + F.floor(draw(seed, F.col("id"), F.lit("n")) * (longest - shortest + 1)).cast("int")), lambda i: F.char(F.lit(97) + F.floor(draw(seed, F.col("id"), i) * 26)))
    return spark.range(size).select(F.col("id").alias("word_id"), F.array_join(letters, "").alias("word"))


def generated_sentences(spark: SparkSession, vocabulary: DataFrame, n_words: int, sentences: int, shortest: int = 5, longest: int = 20, seed: int = 0) -> DataFrame:
    """(sent_id, words, text): words drawn from a vocabulary of n_words, and their concatenation. Both sides of
    the join grow with the corpus, so neither is broadcast, however small Spark takes them to be."""
    size = F.lit(shortest) + F.floor(draw(seed, F.col("id"), F.lit("n")) * (longest - shortest + 1)).cast("int")
    places = spark.range(sentences).select(F.col("id").alias("sent_id"), F.explode(F.sequence(F.lit(1), size)).alias("pos"), "id")
    chosen = places.withColumn("word_id", F.floor(draw(seed, F.col("id"), F.col("pos"), F.lit("w")) * n_words)).join(vocabulary.hint("merge"), "word_id")
    words = F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])
    return chosen.groupBy("sent_id").agg(words.alias("words")).withColumn("text", F.array_join("words", ""))


def generated_tagged(spark: SparkSession, patterns: list[list[str]], words: dict[str, list[str]], sentences: int, seed: int = 0) -> DataFrame:
    """(sent_id, tokens): each sentence follows a pattern of tags, with a word of each tag."""
    book = F.create_map(*[x for t, ws in words.items() for x in (F.lit(t), F.array(*map(F.lit, ws)))])
    form = F.get(F.array(*[F.array(*map(F.lit, p)) for p in patterns]), F.floor(draw(seed, F.col("id"), F.lit("p")) * len(patterns)).cast("int"))
    one = spark.range(sentences).select(F.col("id").alias("sent_id"), form.alias("form"))
    pick = lambda t, i: F.get(book[t], F.floor(draw(seed, F.col("sent_id"), i) * F.size(book[t])).cast("int"))
    return one.select("sent_id", F.transform("form", lambda t, i: F.struct(pick(t, i).alias("word"), t.alias("tag"))).alias("tokens"))


def slash_tagged(spark: SparkSession, path: str, separator: str = "/") -> DataFrame:
    """(file, line, tokens) of text files with a sentence a line and tokens as word/tag, apart by white space; the last
    separator parts them, and fields after the tag follow `separator` too if a token ends with it (word/tag/more/).
    A token without a tag has a null one; empty lines are left out. Lines are numbered in order, not in sequence."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.filter(F.split(F.trim("value"), r"\s+"), lambda t: t != "").alias("raw")).where(F.size("raw") > 0)
    sep = F.lit(separator)

    def token(t: Column) -> Column:
        n = F.char_length(t) - F.char_length(F.substring_index(t, separator, -1))
        plain = F.struct(F.when(n > 0, F.substr(t, F.lit(1), n - len(separator))).otherwise(t).alias("word"), F.when(n > 0, F.substring_index(t, separator, -1)).alias("tag"))
        fields = F.split_part(t, sep, F.lit(1)), F.split_part(t, sep, F.lit(2))
        return F.when(F.endswith(t, sep) & (F.char_length(t) > len(separator)), F.struct(fields[0].alias("word"), fields[1].alias("tag"))).otherwise(plain)

    return rows.select("file", "line", F.transform("raw", token).alias("tokens"))


def usable(df: DataFrame, least: int = 3, tokens_col: str = "tokens") -> DataFrame:
    """Sentences of at least `least` tokens that have a tag, without those that have none."""
    kept = F.filter(tokens_col, lambda t: t["tag"].isNotNull() & (t["tag"] != ""))
    return df.withColumn(tokens_col, kept).where(F.size(tokens_col) >= least)


def split(df: DataFrame, order: str, share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(first, rest) by order: the place that parts them is a quantile, so nothing is sorted whole."""
    at = df.agg(F.percentile(order, F.lit(share))).first()[0]
    if at is None:
        return df, df
    return df.where(F.col(order) < at), df.where(F.col(order) >= at)
