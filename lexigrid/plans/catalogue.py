"""One query per operator over whole tables, in long form, with DuckDB SQL for each that SQL can express."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.columns import prefixes, random_words, round3
from ..operators.segment import LongestMatch, LongestMatchModel
from ..operators.sequences import SequenceSet
from ..operators.tagging import PerceptronTagger, PerceptronTaggerModel, contexts, feature_columns, scoring, tag_counts, tag_dictionary
from ..sources.corpus import documents, generated_sentences, generated_tagged, generated_vocabulary, lines, split, spread, tagged, tokens, usable, words_of

LONGEST = 6
#: Of the generated tagged corpus.
PATTERNS = [["DET", "NOUN", "VERB"], ["NOUN", "VERB", "DET", "ADJ", "NOUN"], ["VERB"]]
WORDS = {"DET": ["a", "the"], "NOUN": ["cat", "dog", "run"], "VERB": ["run", "sees"], "ADJ": ["big"]}


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations' turns as sentences of words."""
    df = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text"))
    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), words_of(F.col("text")).alias("words"))


def _members(spark: SparkSession, sf_dir: str) -> SequenceSet:
    return SequenceSet.of(tokens(documents(spark, sf_dir), ["doc_id"]), "word")


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(_benchmark(spark, sf_dir), ["item_id"])


def trie_vocab(spark, sf_dir):
    return _members(spark, sf_dir).members.withColumnRenamed("seq", "word")


def trie_len(spark, sf_dir):
    return _members(spark, sf_dir).members.agg(F.count(F.lit(1)).alias("members"))


def trie_insert_flags(spark, sf_dir):
    return SequenceSet.empty(spark).insert_flags_within(documents(spark, sf_dir).select("doc_id", words_of(F.col("text")).alias("words")), "doc_id", "words", "pos", "word")


def trie_nodes(spark, sf_dir):
    return _members(spark, sf_dir).prefix_table()


def trie_contains(spark, sf_dir):
    return _members(spark, sf_dir).contains(_probes(spark, sf_dir), "word")


def trie_has_prefix(spark, sf_dir):
    """Of every prefix of each word, itself included, and of the word with one more character."""
    starts = F.concat(prefixes(F.col("word")), F.array(F.concat("word", F.lit("~"))))
    probes = _probes(spark, sf_dir).select("item_id", "pos", F.posexplode(starts).alias("k", "probe")).withColumn("k", F.col("k").cast("long"))
    return _members(spark, sf_dir).has_prefix(probes, "probe")


def trie_clear(spark, sf_dir):
    """The set, the cleared one, and the cleared one with the benchmark's words: whether empty, and how many members."""
    full = _members(spark, sf_dir)
    bare = full.clear()
    again = bare.insert(_probes(spark, sf_dir), "word")
    rows = [(name, s.members.agg((F.count(F.lit(1)) == 0).alias("is_empty"), F.count(F.lit(1)).alias("members"))) for name, s in (("full", full), ("cleared", bare), ("refilled", again))]
    return reduce(DataFrame.unionByName, (df.select(F.lit(name).alias("state"), "is_empty", "members") for name, df in rows))


def trie_longest_match(spark, sf_dir):
    return _members(spark, sf_dir).longest_match(_probes(spark, sf_dir), LONGEST, "word").withColumn("match_len", F.col("match_len").cast("long"))


def trie_tokens_longest_match(spark, sf_dir):
    """Members are the lines of the documents as sequences of words, whole, and the pairs and triples of words that
    begin them; probes the turns, whole."""
    docs = documents(spark, sf_dir)
    seqs = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(words_of(F.col("line")).alias("w")).where(F.size("w") >= 2)
    members = SequenceSet.of(seqs.select(F.explode(F.array("w", F.slice("w", 1, 2), F.slice("w", 1, 3))).alias("seq")), "seq")
    turns = _turns(spark, sf_dir)
    return members.longest_match(turns, 1 << 30, "words").select("conv_id", "turn", F.col("match_len").cast("long").alias("match_len"))


def _model(spark, sf_dir, longest=LONGEST, strategy="auto") -> LongestMatchModel:
    sents = documents(spark, sf_dir).select(words_of(F.col("text")).alias("words"))
    return LongestMatch(maxWordLength=longest, strategy=strategy).fit(sents)


def _segmented(spark, sf_dir, model: LongestMatchModel) -> DataFrame:
    cut = model.transform(lines(documents(spark, sf_dir), ["doc_id"]))
    return cut.select("doc_id", "ln", F.posexplode("words").alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


def lsm_vocab(spark, sf_dir):
    return _model(spark, sf_dir).vocabulary


def lsm_segment(spark, sf_dir):
    return _segmented(spark, sf_dir, _model(spark, sf_dir))


def lsm_segment_max3(spark, sf_dir):
    return _segmented(spark, sf_dir, _model(spark, sf_dir, 3))


def lsm_untrained(spark, sf_dir):
    return _segmented(spark, sf_dir, LongestMatchModel(SequenceSet.empty(spark).members.withColumnRenamed("seq", "word"), LONGEST))


def lsm_word_freq(spark, sf_dir):
    return lsm_segment(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def lsm_single_char_rate(spark, sf_dir):
    n = lsm_segment(spark, sf_dir).groupBy("doc_id").agg(F.count_if(F.char_length("word") == 1).alias("singles"), F.count(F.lit(1)).alias("n"))
    return n.select("doc_id", "singles", "n", F.round(F.col("singles") / F.col("n"), 6).alias("rate"))


def _random(spark, sf_dir, prob):
    cut = lines(documents(spark, sf_dir), ["doc_id"]).withColumn("words", random_words(F.col("text"), prob, 7, F.col("doc_id"), F.col("ln")))
    return cut.select("doc_id", "ln", F.posexplode("words").alias("pos", "word")).withColumn("pos", F.col("pos").cast("long"))


def rand_prob0(spark, sf_dir):
    return _random(spark, sf_dir, 0.0)


def rand_seeded(spark, sf_dir):
    return _random(spark, sf_dir, 0.25)


def pos_context(spark, sf_dir):
    return contexts(_turns(spark, sf_dir), "words", ["conv_id", "turn"])


def _gold_rows(spark, sf_dir) -> DataFrame:
    """conv_id, turn, pos, gold, features: each token's features with the given earlier tags."""
    rows = contexts(tagged(_turns(spark, sf_dir)).withColumn("tags", F.transform("tokens", lambda t: t["tag"])), "words", ["conv_id", "turn", "tags"])
    p = F.col("pos").cast("int")
    prev = F.when(p == 0, F.lit("-START-")).otherwise(F.get("tags", p - 1))
    prev2 = F.when(p == 0, F.lit("-START2-")).when(p == 1, F.lit("-START-")).otherwise(F.get("tags", p - 2))
    rows = rows.withColumn("prev", prev).withColumn("prev2", prev2).withColumn("gold", F.get("tags", p))
    return rows.select("conv_id", "turn", "pos", "gold", F.array(*feature_columns("prev", "prev2")).alias("features"))


def _gold(spark, sf_dir) -> DataFrame:
    """conv_id, turn, pos, gold, slot, feature: the same, a row for each feature."""
    rows = _gold_rows(spark, sf_dir)
    return rows.select("conv_id", "turn", "pos", "gold", F.posexplode("features").alias("slot", "feature")).withColumn("slot", F.col("slot").cast("long"))


def pos_features(spark, sf_dir):
    return _gold(spark, sf_dir).drop("gold")


def pos_tag_counts(spark, sf_dir):
    rows = documents(spark, sf_dir).where("lang is not null").select(F.transform(words_of(F.col("text")), lambda w: F.struct(w.alias("word"), F.col("lang").alias("tag"))).alias("tokens"))
    return tag_counts(rows)


def pos_tagdict(spark, sf_dir):
    return tag_dictionary(pos_tag_counts(spark, sf_dir), 10, 0.95)


def pos_classes(spark, sf_dir):
    return pos_tag_counts(spark, sf_dir).select(F.col("tag").alias("class")).distinct()


def _counted(spark, sf_dir) -> DataFrame:
    """(feature, class, weight): how often they occur together; whole numbers, so sums are exact."""
    return _gold(spark, sf_dir).groupBy("feature", F.col("gold").alias("class")).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def pos_score(spark, sf_dir):
    """The weights are one row per character or tag and class: a size that the text doesn't set. They are broadcast,
    and tokens are scored where they are."""
    best = scoring(spark.sparkContext.broadcast(_weights(spark, sf_dir)))
    return _gold_rows(spark, sf_dir).select("conv_id", "turn", "pos", best("features").alias("b")).select("conv_id", "turn", "pos", "b.tag", "b.score")


def _weights(spark, sf_dir) -> dict[str, dict[str, float]]:
    weights: dict[str, dict[str, float]] = {}
    for r in _counted(spark, sf_dir).collect():
        weights.setdefault(r.feature, {})[r["class"]] = r.weight
    return weights


def _count_model(spark, sf_dir) -> PerceptronTaggerModel:
    weights = _weights(spark, sf_dir)
    rows = tagged(_turns(spark, sf_dir))
    words = {r.word: r.tag for r in tag_dictionary(tag_counts(rows), 20, 0.97).collect()}
    return PerceptronTaggerModel(weights, words, {c for own in weights.values() for c in own})


def _tags(df: DataFrame) -> DataFrame:
    return df.select("conv_id", "turn", F.posexplode("tags").alias("pos", "tag"), "words").select("conv_id", "turn", F.col("pos").cast("long").alias("pos"), F.get("words", F.col("pos")).alias("word"), "tag")


def pos_tag(spark, sf_dir):
    return _tags(_count_model(spark, sf_dir).transform(_turns(spark, sf_dir)))


def pos_update_count(spark, sf_dir):
    """Instances that training counts: words outside the dictionary, once a pass."""
    rows = tagged(_turns(spark, sf_dir))
    known = tag_dictionary(tag_counts(rows), 20, 0.97).select("word")
    return rows.select(F.explode("words").alias("word")).join(known, "word", "left_anti").agg((F.count(F.lit(1)) * 5).alias("instances"))


def pos_average(spark, sf_dir):
    """Averaging applied to given rows of total, time stamp, weight and instances."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    i = F.lit(1_000_000)
    mean = round3((F.col("l_extendedprice") + (i - F.col("l_partkey")) * F.col("l_quantity")) / i)
    return rows.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("long").alias("l_linenumber"), mean.alias("weight")).where("weight <> 0")


def pos_train(spark, sf_dir):
    """The exact trainer's weights after one pass, in long form."""
    rows = tagged(_turns(spark, sf_dir)).withColumn("sent_id", F.col("conv_id") * 1_000_000 + F.col("turn"))
    model = PerceptronTagger(frequencyThreshold=20, ambiguityThreshold=0.97, nIter=1).fit(rows)
    return model.weights_df(spark).select("feature", F.explode_outer("weights").alias("class", "weight"))


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and Spark is one process, the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def pos_save_load(spark, sf_dir):
    """pos_tag by a model that went through JSON and Parquet."""
    root = shared_dir(spark)
    model = PerceptronTaggerModel.from_json(_count_model(spark, sf_dir).to_json())
    at = f"{root}/lexigrid/model-{uuid.uuid4().hex}"
    model.save_parquet(spark, at)
    return _tags(PerceptronTaggerModel.load_parquet(spark, at).transform(_turns(spark, sf_dir)))


def trie_prefix_counts(spark, sf_dir):
    """How many members each prefix has."""
    return _members(spark, sf_dir).members.select(F.explode(prefixes(F.col("seq"))).alias("prefix")).groupBy("prefix").agg(F.count(F.lit(1)).alias("members"))


def gen_vocabulary(spark, sf_dir):
    """A generated vocabulary of as many words as there are documents."""
    return generated_vocabulary(spark, documents(spark, sf_dir).count(), 2, 8, 3)


def gen_sentences(spark, sf_dir):
    """Generated sentences, as many as documents, with their words in one string."""
    n = documents(spark, sf_dir).count()
    return generated_sentences(spark, generated_vocabulary(spark, n, 2, 8, 3), n, n, 5, 20, 3).select("sent_id", "text", F.size("words").cast("long").alias("n_words"))


def gen_tagged(spark, sf_dir):
    """Generated tagged sentences in long form."""
    out = generated_tagged(spark, PATTERNS, WORDS, documents(spark, sf_dir).count(), 3)
    return out.select("sent_id", F.posexplode("tokens").alias("pos", "t")).select("sent_id", F.col("pos").cast("long").alias("pos"), "t.word", "t.tag")


def corpus_split(spark, sf_dir):
    """The tagged turns of at least 3 usable tokens, parted four to one by conversation."""
    one = usable(tagged(_turns(spark, sf_dir)), 3)
    first, rest = split(one, "conv_id", 0.8)
    parts = [df.select("conv_id", "turn", F.size("tokens").cast("long").alias("n"), F.lit(name).alias("part")) for name, df in (("train", first), ("test", rest))]
    return parts[0].unionByName(parts[1])


def sql_segment_longest(spark, sf_dir):
    """lsm_segment in SQL."""
    sql.register_segmenter(spark, _model(spark, sf_dir))
    lines(documents(spark, sf_dir), ["doc_id"]).createOrReplaceTempView("lexigrid_lines")
    return spark.sql("SELECT doc_id, ln, CAST(w.pos AS BIGINT) AS pos, w.word FROM (SELECT doc_id, ln, segment_longest(text) AS words FROM lexigrid_lines) LATERAL VIEW posexplode(words) w AS pos, word")


def sql_segment_rows(spark, sf_dir):
    """lsm_segment by the table function."""
    sql.register_segmenter(spark, _model(spark, sf_dir))
    lines(documents(spark, sf_dir), ["doc_id"]).createOrReplaceTempView("lexigrid_rows")
    return spark.sql("SELECT doc_id, ln, r.pos, r.word FROM lexigrid_rows, LATERAL segment_rows(text) r")


def sql_segment_random(spark, sf_dir):
    """Random boundaries in SQL, with the key doc_id."""
    sql.register_random(spark, 0.25, 7)
    documents(spark, sf_dir).createOrReplaceTempView("lexigrid_docs")
    return spark.sql("SELECT doc_id, CAST(w.pos AS BIGINT) AS pos, w.word FROM (SELECT doc_id, segment_random(doc_id, text) AS words FROM lexigrid_docs) LATERAL VIEW posexplode(words) w AS pos, word")


def sql_pos_tag(spark, sf_dir):
    """pos_tag in SQL."""
    sql.register_tagger(spark, _count_model(spark, sf_dir))
    _turns(spark, sf_dir).createOrReplaceTempView("lexigrid_turns")
    return _tags(spark.sql("SELECT conv_id, turn, words, pos_tag(words) AS tags FROM lexigrid_turns"))


QUERIES = {
    f.__name__: f
    for f in (
        trie_vocab, trie_len, trie_insert_flags, trie_nodes, trie_contains, trie_has_prefix, trie_longest_match, trie_tokens_longest_match, trie_prefix_counts, trie_clear,
        lsm_vocab, lsm_segment, lsm_segment_max3, lsm_untrained, lsm_word_freq, lsm_single_char_rate, rand_prob0, rand_seeded,
        pos_context, pos_features, pos_tag_counts, pos_tagdict, pos_classes, pos_score, pos_tag, pos_update_count, pos_average, pos_train, pos_save_load,
        gen_vocabulary, gen_sentences, gen_tagged, corpus_split, sql_segment_longest, sql_segment_rows, sql_segment_random, sql_pos_tag,
    )
}

# ---- SQL ----


def _tokens_sql(table: str, keys: str) -> str:
    return f"SELECT {keys}, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS word FROM (SELECT {keys}, regexp_extract_all(coalesce(text, ''), '[^ \\n]+') AS l FROM {table})"


_WORDS = f"t AS ({_tokens_sql('documents', 'doc_id')}), m AS (SELECT DISTINCT word FROM t)"
_PROBE = f"p AS ({_tokens_sql('benchmark', 'item_id')})"
_LINES = r"""
s AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS ln, replace(unnest(l), ' ', '') AS text
      FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
l AS (SELECT * FROM s WHERE text <> '')"""


def _segment_sql(longest: int, select: str, vocabulary: bool = True) -> str:
    known = f"SELECT DISTINCT word FROM t WHERE length(word) BETWEEN 2 AND {longest}" if vocabulary else "SELECT '' AS word WHERE false"
    return f"""
WITH RECURSIVE {_WORDS}, {_LINES},
v AS ({known}),
x AS MATERIALIZED (SELECT DISTINCT text FROM l),
c AS (SELECT text, p, k FROM (SELECT text, unnest(range(1, length(text) + 1)) AS p FROM x), range(2, {longest + 1}) r(k)
      WHERE p + k - 1 <= length(text) AND substring(text, p, k) IN (SELECT word FROM v)),
n AS (SELECT text, p, max(k) AS k FROM c GROUP BY ALL),
a AS (SELECT g.text, g.p, coalesce(n.k, 1) AS k FROM (SELECT text, unnest(range(1, length(text) + 1)) AS p FROM x) g LEFT JOIN n ON n.text = g.text AND n.p = g.p),
w(text, p, k, pos) AS (
  SELECT text, p, k, CAST(0 AS BIGINT) FROM a WHERE p = 1
  UNION ALL
  SELECT a.text, a.p, a.k, w.pos + 1 FROM w JOIN a ON a.text = w.text AND a.p = w.p + w.k),
o AS (SELECT l.doc_id, l.ln, w.pos, substring(w.text, w.p, w.k) AS word FROM l JOIN w USING (text))
{select}"""


_ALL = "SELECT doc_id, ln, pos, word FROM o"


def _random_sql(prob: float) -> str:
    return f"""
WITH {_LINES},
d AS (SELECT doc_id, ln, text, list_filter(range(1, length(text)), lambda p: CAST('0x' || substring(md5('7|' || doc_id || '|' || ln || '|' || (p // 4)), 8 * (p % 4) + 1, 8) AS BIGINT) / 4294967296.0 < {prob}) AS c FROM l),
e AS (SELECT doc_id, ln, text, list_concat([0], c) AS a, list_concat(c, [length(text)]) AS b FROM d)
SELECT doc_id, ln, generate_subscripts(a, 1) - 1 AS pos, substring(text, unnest(a) + 1, unnest(b) - unnest(a)) AS word FROM e"""


_TURNS = r"""
t AS (SELECT conv_id, turn, w FROM (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, regexp_extract_all(coalesce(text, ''), '[^ \n]+') AS w FROM conversations)),
k AS (SELECT conv_id, turn, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word, len(w) AS n FROM t),
x AS MATERIALIZED (SELECT conv_id, turn, pos, word,
        CASE WHEN pos = 0 THEN '-START2-' WHEN pos = 1 THEN '-START-' ELSE lag(word, 2) OVER s END AS before2,
        CASE WHEN pos = 0 THEN '-START-' ELSE lag(word) OVER s END AS before,
        coalesce(lead(word) OVER s, '-END-') AS after, coalesce(lead(word, 2) OVER s, '-END2-') AS after2,
        CASE WHEN right(word, 1) IN ('.', ',') THEN 'PUNCT' WHEN left(word, 1) <> lower(left(word, 1)) THEN 'CAP' WHEN length(word) <= 3 THEN 'FUNC' ELSE 'WORD' END AS gold
      FROM k WINDOW s AS (PARTITION BY conv_id, turn ORDER BY pos)),
y AS (SELECT *, CASE WHEN pos = 0 THEN '-START-' ELSE lag(gold) OVER s END AS prev,
        CASE WHEN pos = 0 THEN '-START2-' WHEN pos = 1 THEN '-START-' ELSE lag(gold, 2) OVER s END AS prev2
      FROM x WINDOW s AS (PARTITION BY conv_id, turn ORDER BY pos)),
z AS (SELECT conv_id, turn, pos, gold, ['bias', 'i word''s first char ' || left(word, 1), 'i word''s final char ' || right(word, 1),
        'i-1 word''s first char ' || left(before, 1), 'i-1 word''s final char ' || right(before, 1), 'i-1 tag ' || prev,
        'i-2 word''s first char ' || left(before2, 1), 'i-2 word''s final char ' || right(before2, 1), 'i-2 tag ' || prev2,
        'i+1 word''s first char ' || left(after, 1), 'i+1 word''s final char ' || right(after, 1),
        'i+2 word''s first char ' || left(after2, 1), 'i+2 word''s final char ' || right(after2, 1)] AS f FROM y),
g AS MATERIALIZED (SELECT conv_id, turn, pos, gold, generate_subscripts(f, 1) - 1 AS slot, unnest(f) AS feature FROM z),
m AS MATERIALIZED (SELECT feature, gold AS class, CAST(count(*) AS DOUBLE) AS weight FROM g GROUP BY ALL),
u AS (SELECT word, gold AS tag, count(*) AS n FROM x GROUP BY ALL),
q AS MATERIALIZED (SELECT word, arg_max(tag, (n, tag)) AS tag FROM u GROUP BY word HAVING sum(n) >= 20 AND max(n) / sum(n) >= 0.97)"""

_POS_TAG = f"""
WITH RECURSIVE {_TURNS},
st AS MATERIALIZED (SELECT g.conv_id, g.turn, g.pos, c.class, coalesce(sum(m.weight), 0) AS score
       FROM g CROSS JOIN (SELECT DISTINCT class FROM m) c LEFT JOIN m ON m.feature = g.feature AND m.class = c.class
       WHERE g.slot NOT IN (5, 8) GROUP BY ALL),
r(conv_id, turn, pos, tag, prev) AS (
  SELECT conv_id, turn, CAST(-1 AS BIGINT), '-START-', '-START2-' FROM t WHERE len(w) > 0
  UNION ALL
  SELECT r.conv_id, r.turn, r.pos + 1,
    coalesce(any_value(q.tag), arg_max(st.class, (st.score + coalesce(m1.weight, 0) + coalesce(m2.weight, 0), st.class))), any_value(r.tag)
  FROM r JOIN st ON st.conv_id = r.conv_id AND st.turn = r.turn AND st.pos = r.pos + 1
  JOIN x ON x.conv_id = r.conv_id AND x.turn = r.turn AND x.pos = r.pos + 1
  LEFT JOIN q ON q.word = x.word
  LEFT JOIN m m1 ON m1.feature = 'i-1 tag ' || r.tag AND m1.class = st.class
  LEFT JOIN m m2 ON m2.feature = 'i-2 tag ' || r.prev AND m2.class = st.class
  GROUP BY r.conv_id, r.turn, r.pos)
SELECT r.conv_id, r.turn, r.pos, x.word, r.tag FROM r JOIN x USING (conv_id, turn, pos)"""

_COUNTS = rf"c AS (SELECT word, lang AS tag, count(*) AS n FROM ({_tokens_sql('documents', 'lang')}) WHERE lang IS NOT NULL GROUP BY ALL)"



def _draw(key: str) -> str:
    """columns.draw() with seed 3."""
    return f"(CAST('0x' || left(md5('3|' || {key}), 8) AS BIGINT) / 4294967296.0)"


_GENERATED = f"""n AS (SELECT unnest(range(0, (SELECT count(*) FROM documents))) AS i),
v AS (SELECT i AS word_id, array_to_string(list_transform(range(1, 3 + CAST(floor({_draw("i || '|n'")} * 7) AS BIGINT)), lambda j: chr(CAST(97 + floor({_draw("i || '|' || j")} * 26) AS INT))), '') AS word FROM n)"""

ORACLE_SQL = {
    "trie_vocab": f"WITH {_WORDS} SELECT word FROM m",
    "trie_len": f"WITH {_WORDS} SELECT count(*) AS members FROM m",
    "trie_insert_flags": f"WITH {_WORDS} SELECT doc_id, pos, word, row_number() OVER (PARTITION BY word ORDER BY doc_id, pos) = 1 AS is_new FROM t",
    "trie_nodes": f"""WITH {_WORDS}, e AS (SELECT word, unnest(range(0, length(word) + 1)) AS k FROM m)
SELECT left(word, k) AS prefix, bool_or(k = length(word)) AS is_terminal, count(DISTINCT CASE WHEN k < length(word) THEN substring(word, k + 1, 1) END) AS num_children FROM e GROUP BY 1""",
    "trie_contains": f"WITH {_WORDS}, {_PROBE} SELECT item_id, pos, word, word IN (SELECT word FROM m) AS is_member FROM p",
    "trie_has_prefix": f"WITH {_WORDS}, {_PROBE}, h AS MATERIALIZED (SELECT DISTINCT left(word, k) AS start FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM m)), q AS (SELECT item_id, pos, k - 1 AS k, CASE WHEN k > length(word) THEN word || '~' ELSE left(word, k) END AS probe FROM (SELECT *, unnest(range(1, length(word) + 2)) AS k FROM p)) SELECT item_id, pos, k, probe, probe IN (SELECT start FROM h) AS has_prefix FROM q",
    "trie_longest_match": f"""WITH {_WORDS}, {_PROBE}
SELECT item_id, pos, p.word, CAST(coalesce((SELECT max(k) FROM range(1, {LONGEST + 1}) r(k) WHERE k <= length(p.word) AND left(p.word, k) IN (SELECT word FROM m)), 0) AS BIGINT) AS match_len FROM p""",
    "trie_tokens_longest_match": r"""WITH h AS MATERIALIZED (SELECT DISTINCT regexp_extract_all(unnest(string_split(text, chr(10))), '[^ \n]+') AS w FROM documents),
m AS MATERIALIZED (SELECT w AS seq FROM h WHERE len(w) >= 2 UNION SELECT w[1:2] FROM h WHERE len(w) >= 2 UNION SELECT w[1:3] FROM h WHERE len(w) >= 2),
t AS MATERIALIZED (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, regexp_extract_all(coalesce(text, ''), '[^ \n]+') AS w FROM conversations),
s AS (SELECT conv_id, turn, k, w[1:k] AS seq FROM (SELECT *, unnest(range(2, len(w) + 1)) AS k FROM t)),
b AS (SELECT conv_id, turn, max(k) AS k FROM s SEMI JOIN m USING (seq) GROUP BY ALL)
SELECT conv_id, turn, CAST(coalesce(k, 0) AS BIGINT) AS match_len FROM t LEFT JOIN b USING (conv_id, turn)""",
    "trie_prefix_counts": f"WITH {_WORDS} SELECT left(word, k) AS prefix, count(*) AS members FROM (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM m) GROUP BY 1",
    "trie_clear": f"WITH {_WORDS}, {_PROBE} SELECT 'full' AS state, count(*) = 0 AS is_empty, count(*) AS members FROM m UNION ALL SELECT 'cleared', true, 0 UNION ALL SELECT 'refilled', count(*) = 0, count(DISTINCT word) FROM p",
    "lsm_vocab": f"WITH {_WORDS} SELECT word FROM m WHERE length(word) > 1",
    "lsm_segment": _segment_sql(LONGEST, _ALL),
    "lsm_segment_max3": _segment_sql(3, _ALL),
    "lsm_untrained": rf"WITH {_LINES} SELECT doc_id, ln, generate_subscripts(c, 1) - 1 AS pos, unnest(c) AS word FROM (SELECT doc_id, ln, string_split(text, '') AS c FROM l)",
    "lsm_word_freq": _segment_sql(LONGEST, "SELECT word, count(*) AS n FROM o GROUP BY 1"),
    "lsm_single_char_rate": _segment_sql(LONGEST, "SELECT doc_id, count(*) FILTER (length(word) = 1) AS singles, count(*) AS n, round(count(*) FILTER (length(word) = 1) / count(*), 6) AS rate FROM o GROUP BY 1"),
    "rand_prob0": _random_sql(0.0),
    "rand_seeded": _random_sql(0.25),
    "pos_context": f"WITH {_TURNS} SELECT conv_id, turn, pos, word, before2, before, after, after2 FROM x",
    "pos_features": f"WITH {_TURNS} SELECT conv_id, turn, pos, slot, feature FROM g",
    "pos_tag_counts": f"WITH {_COUNTS} SELECT word, tag, n FROM c",
    "pos_tagdict": f"WITH {_COUNTS} SELECT word, arg_max(tag, (n, tag)) AS tag FROM c GROUP BY word HAVING sum(n) >= 10 AND max(n) / sum(n) >= 0.95",
    "pos_classes": f"WITH {_COUNTS} SELECT DISTINCT tag AS class FROM c",
    "pos_score": f"""WITH {_TURNS}, o AS (SELECT conv_id, turn, pos, class, sum(weight) AS score FROM g JOIN m USING (feature) GROUP BY ALL)
SELECT conv_id, turn, pos, arg_max(class, (score, class)) AS tag, max(score) AS score FROM o GROUP BY ALL""",
    "pos_tag": _POS_TAG,
    "pos_update_count": f"WITH {_TURNS} SELECT count(*) * 5 AS instances FROM x WHERE word NOT IN (SELECT word FROM q)",
    "pos_average": "SELECT * FROM (SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round((l_extendedprice + (1000000 - l_partkey) * l_quantity) / 1000000 * 1000) / 1000 AS weight FROM lineitem) WHERE weight <> 0",
    "pos_save_load": _POS_TAG,
    "gen_vocabulary": f"WITH {_GENERATED} SELECT word_id, word FROM v",
    "gen_sentences": f"""WITH {_GENERATED},
s AS (SELECT i, unnest(range(1, 6 + CAST(floor({_draw("i || '|n'")} * 16) AS BIGINT))) AS pos FROM n),
w AS (SELECT s.i, pos, v.word FROM s JOIN v ON v.word_id = CAST(floor({_draw("i || '|' || pos || '|w'")} * (SELECT count(*) FROM n)) AS BIGINT))
SELECT i AS sent_id, string_agg(word, '' ORDER BY pos) AS text, count(*) AS n_words FROM w GROUP BY 1""",
    "gen_tagged": f"""WITH {_GENERATED},
f AS (SELECT i, {PATTERNS}[1 + CAST(floor({_draw("i || '|p'")} * {len(PATTERNS)}) AS BIGINT)] AS f FROM n),
t AS (SELECT i, generate_subscripts(f, 1) - 1 AS pos, unnest(f) AS tag FROM f),
b AS (SELECT t.*, CASE tag {" ".join(f"WHEN '{t}' THEN {w}" for t, w in WORDS.items())} END AS ws FROM t)
SELECT i AS sent_id, pos, ws[1 + CAST(floor({_draw("i || '|' || pos")} * len(ws)) AS BIGINT)] AS word, tag FROM b""",
    "corpus_split": f"""WITH {_TURNS}, o AS (SELECT conv_id, turn, count(*) AS n FROM k GROUP BY ALL HAVING count(*) >= 3), e AS (SELECT quantile_cont(conv_id, 0.8) AS edge FROM o)
SELECT conv_id, turn, n, CASE WHEN conv_id < edge THEN 'train' ELSE 'test' END AS part FROM o, e""",
    "sql_segment_longest": _segment_sql(LONGEST, _ALL),
    "sql_segment_rows": _segment_sql(LONGEST, _ALL),
    "sql_segment_random": """
WITH l AS (SELECT doc_id, text FROM documents WHERE text <> ''),
d AS (SELECT doc_id, text, list_filter(range(1, length(text)), lambda p: CAST('0x' || substring(md5('7|' || doc_id || '|' || (p // 4)), 8 * (p % 4) + 1, 8) AS BIGINT) / 4294967296.0 < 0.25) AS c FROM l),
e AS (SELECT doc_id, text, list_concat([0], c) AS a, list_concat(c, [length(text)]) AS b FROM d)
SELECT doc_id, generate_subscripts(a, 1) - 1 AS pos, substring(text, unnest(a) + 1, unnest(b) - unnest(a)) AS word FROM e""",
    "sql_pos_tag": _POS_TAG,
}
