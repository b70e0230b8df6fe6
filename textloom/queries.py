"""The queries over the operators, and the same in DuckDB SQL. Arrays are joined to text, counts are bigint, doubles come from whole
numbers or are rounded, so that both sides can be compared by value."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.channel import Channel
from textloom.functions.text import MARKUP_LITERALS, MARKUP_PATTERNS, preprocess, strip_markup
from textloom.functions.unicode import unicode_sentences as cut_unicode
from textloom.operators import corpus, expansion, metrics, pareto, relations, scans
from textloom.operators.expansion import SHIPPED, ExpansionParams
from textloom.operators.positional import PositionalIndex
from textloom.plans import swarm, training
from textloom.session import materialize, once, scratch, ship
from textloom.sources import inputs, runs
from textloom.sources.xml_splits import read_xml_splits

Query = Callable[[SparkSession, str], DataFrame]

SEEDS = ("oren", "schtz", "threat", "thonnd", "heenwh")
TERMS = ("the", "of", "Frankfurt", "oren", "Quezon City", "threat", "oren")
PAIRS = (("the", "of"), ("of", "the"), ("the", "and"), ("and", "the"), ("the", "to"))
DEMO = ExpansionParams(50.0, 0.0, -1.0, 0.0, 10.0, 1.0, -2.0, 0.0)
BOUNDS6 = [(-100.0, 100.0), (-100.0, 100.0), (-1000.0, 1000.0)] * 2

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql:
            SQL[name] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sents(spark, d):
    """The words of a folder's sentences, cut and written once in an application; all queries plan on these, as on a stored index."""
    return once(spark, "sentences", f"{d}/documents.parquet", lambda: corpus.sentences(corpus.marked(_table(spark, d, "documents").select("doc_id", "text"))).drop("sent"))


def _toks(spark, d):
    return corpus.tokens(_sents(spark, d))


def _posts(spark, d):
    """Postings are counted in the rows of the stored sentences whenever they are read; they take more room than these."""
    return corpus.sentence_postings(_sents(spark, d))


def _df(spark, d):
    return once(spark, "df", f"{d}/documents.parquet", lambda: corpus.doc_freq(_posts(spark, d)))


def build_index(spark: SparkSession, d: str) -> None:
    """What the queries plan on, made now if it isn't there."""
    _df(spark, d)
    _positional(spark, d)


def _words(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string")


# ------------------------------------------------------------------------------------------------ segmentation and index
BASE = r"""
WITH s0 AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[.!?]+[ \t\n\f\r]+|\n+'), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS ss FROM documents),
s AS (SELECT doc_id, unnest(range(len(ss))) AS spos, unnest(ss) AS sent FROM s0),
w0 AS (SELECT doc_id, spos, sent, regexp_extract_all(sent, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]', 0) AS words FROM s),
t AS (SELECT doc_id, spos, unnest(range(len(words))) AS pos, unnest(words) AS word FROM w0),
p AS MATERIALIZED (SELECT doc_id, spos, word, count(*) AS tf, min(pos) AS first_pos FROM t GROUP BY ALL),
df AS MATERIALIZED (SELECT word, count(*) AS df FROM p GROUP BY word)
"""


def _list(words) -> str:
    return "(VALUES " + ", ".join(f"('{w}')" for w in words) + ") v(word)"


@query("doc_sentences", BASE + "SELECT doc_id, spos::BIGINT AS spos, sent FROM s")
def doc_sentences(spark, d):
    return corpus.sentences(_table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.col("spos").cast("long").alias("spos"), "sent")


@query("doc_tokens", BASE + "SELECT doc_id, spos::BIGINT AS spos, pos::BIGINT AS pos, word FROM t")
def doc_tokens(spark, d):
    return _toks(spark, d).select("doc_id", F.col("spos").cast("long").alias("spos"), F.col("pos").cast("long").alias("pos"), "word")


@query("token_counts", BASE + "SELECT word, count(*) AS n FROM t GROUP BY word")
def token_counts(spark, d):
    return _toks(spark, d).groupBy("word").agg(F.count("*").alias("n"))


@query("vocab_first_seen", BASE + ", f AS (SELECT word, min((doc_id, spos, pos)) AS m FROM t GROUP BY word) SELECT row_number() OVER (ORDER BY m) - 1 AS word_id, word FROM f")
def vocab_first_seen(spark, d):
    return corpus.vocabulary(_toks(spark, d)).select(F.col("word_id").cast("long").alias("word_id"), "word")


@query("postings_tf", BASE + "SELECT doc_id, spos::BIGINT AS spos, word, tf FROM p")
def postings_tf(spark, d):
    return _posts(spark, d).select("doc_id", F.col("spos").cast("long").alias("spos"), "word", "tf")


@query("doc_freq", BASE + "SELECT word, df FROM df")
def doc_freq(spark, d):
    return _df(spark, d)


@query("corpus_counts", BASE + "SELECT (SELECT count(*) FROM s) AS n_sentences, count(DISTINCT word) AS n_words, count(*) AS n_postings FROM p")
def corpus_counts(spark, d):
    sents = _sents(spark, d)
    return corpus.corpus_counts(sents, corpus.sentence_postings(sents))


@query("sentence_decode", BASE + "SELECT doc_id, spos::BIGINT AS spos, string_agg(word, ' ' ORDER BY pos) AS sentence FROM t GROUP BY ALL")
def sentence_decode(spark, d):
    return corpus.decode(_toks(spark, d)).select("doc_id", F.col("spos").cast("long").alias("spos"), "sentence")


@query("soundness_antijoin", BASE + "SELECT (SELECT count(DISTINCT word) FROM t) AS n_vocab, (SELECT count(*) FROM (SELECT DISTINCT word FROM t) v ANTI JOIN p USING (word)) AS n_unsound")
def soundness_antijoin(spark, d):
    toks = _toks(spark, d)
    vocab = toks.select("word").distinct()
    bad = corpus.unsound(vocab, _posts(spark, d)).agg(F.count("*").alias("n_unsound")).withColumn("k", F.lit(1))
    return vocab.agg(F.count("*").alias("n_vocab")).withColumn("k", F.lit(1)).join(bad, "k").drop("k")


@query("doc_limit_compat", "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 9")
def doc_limit_compat(spark, d):
    return corpus.limited(_table(spark, d, "documents").select("doc_id"), 10, compat_limit=True)


@query("word_postings", BASE + "SELECT doc_id, spos::BIGINT AS spos FROM p WHERE word = 'oren'")
def word_postings(spark, d):
    return _posts(spark, d).where(F.col("word") == SEEDS[0]).select("doc_id", F.col("spos").cast("long").alias("spos"))


def _sql_markup(column: str) -> str:
    out = column
    for old, new in MARKUP_LITERALS:
        out = f"replace({out}, '{old.replace(chr(39), chr(39) * 2)}', '{new}')"
    for pattern, new in MARKUP_PATTERNS:
        pattern = pattern.replace("(?md)", "(?m)").replace("(?d)", "").replace("'", "''")
        out = f"regexp_replace({out}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return out


@query("saved_index_words", BASE + ", f AS (SELECT word, min((doc_id, spos, pos)) AS m FROM t GROUP BY word), v AS (SELECT row_number() OVER (ORDER BY m) - 1 AS word_id, word FROM f) SELECT word_id, word, df FROM v JOIN df USING (word)")
def saved_index_words(spark, d):
    """Dictionary and frequencies from an index saved in buckets by word; neither the count nor the join shuffles."""
    folder = scratch(spark, "index")
    sents = _sents(spark, d)
    corpus.Corpus(sents.limit(0), corpus.tokens(sents.limit(0)), _posts(spark, d), corpus.vocabulary(_toks(spark, d))).save(folder, corpus.buckets_for(spark, sents.agg(F.sum(F.size("words"))).first()[0] or 0))
    saved = corpus.Corpus.load(spark, folder)
    return saved.vocab.join(saved.df, "word").select(F.col("word_id").cast("long").alias("word_id"), "word", "df")


@query("strip_markup_pages", f"SELECT page_id, {_sql_markup('html')} AS text FROM pages")
def strip_markup_pages(spark, d):
    return _table(spark, d, "pages").select("page_id", strip_markup(F.col("html")).alias("text"))


@query("word_coverage", BASE + f"SELECT word, count(*) AS n FROM {_list(TERMS)} SEMI JOIN df USING (word) GROUP BY word")
def word_coverage(spark, d):
    return corpus.lookup(_words(spark, TERMS), _toks(spark, d).select("word").distinct()).groupBy("word").agg(F.count("*").alias("n"))


@query("missing_words", BASE + f"SELECT word FROM {_list(TERMS)} ANTI JOIN df USING (word)")
def missing_words(spark, d):
    return corpus.missing(_words(spark, TERMS), _toks(spark, d).select("word").distinct())


_FIRST_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[^a-z]+'), lambda x: x <> '')[1:3]"


@query("set_request_words", f"SELECT doc_id, unnest({_FIRST_WORDS}) AS word FROM documents")
def set_request_words(spark, d):
    """A request of the first words of each text, as JSON, and its words."""
    words = F.slice(F.filter(F.split(F.coalesce("text", F.lit("")), "[^a-z]+"), lambda x: x != ""), 1, 3)
    requests = _table(spark, d, "documents").select("doc_id", F.to_json(F.struct(words.alias("set"))).alias("value"))
    return inputs.set_request(requests, "value", "doc_id")


# ----------------------------------------------------------------------------------------------------------- expansion
COMMON_SEEDS = ("from", "with", "this", "that", "for")


def _hop_sql(name: str, sources: str, a: float, b: float, g: float) -> str:
    """n by the number of sources in each sentence, k by the distinct pairs of word and source."""
    return f""", {name}_src AS MATERIALIZED (SELECT doc_id, spos, word FROM p SEMI JOIN (SELECT DISTINCT word FROM {sources}) q USING (word)),
{name}_n AS (SELECT o.word, sum(o.tf * m.c)::BIGINT AS n FROM p o JOIN (SELECT doc_id, spos, count(*) AS c FROM {name}_src GROUP BY ALL) m ON o.doc_id = m.doc_id AND o.spos = m.spos GROUP BY o.word),
{name}_k AS (SELECT word, count(*) AS k FROM (SELECT DISTINCT o.word, x.word AS source FROM {name}_src x JOIN p o ON o.doc_id = x.doc_id AND o.spos = x.spos) GROUP BY word),
{name} AS MATERIALIZED (SELECT c.word, df, k, n, df * {g} + k * {a} + n * {b} AS fitness FROM {name}_n c JOIN {name}_k USING (word) JOIN df ON c.word = df.word)"""


def _expand_sql(m: ExpansionParams, select: str, seeds=SEEDS) -> str:
    one = _hop_sql("h1", _list(seeds), m.a1, m.b1, m.g1)
    two = _hop_sql("h2", f"(SELECT word FROM h1 WHERE fitness >= {m.t1})", m.a2, m.b2, m.g2)
    return BASE + one + two + " " + select


@query("cooc_word", BASE + "SELECT o.word, sum(o.tf)::BIGINT AS n FROM p o SEMI JOIN (SELECT doc_id, spos FROM p WHERE word = 'oren') x ON o.doc_id = x.doc_id AND o.spos = x.spos GROUP BY o.word")
def cooc_word(spark, d):
    return expansion.cooccurrences_for_word(_posts(spark, d), SEEDS[0])


@query("expand_hop1", _expand_sql(DEMO, "SELECT word, df, k, n, fitness::DOUBLE AS fitness FROM h1"))
def expand_hop1(spark, d):
    return expansion.hop(_sents(spark, d), _df(spark, d), _words(spark, SEEDS), DEMO.a1, DEMO.b1, DEMO.g1)


@query("expand_hop1_survivors", _expand_sql(DEMO, "SELECT word, df, k, n, fitness::DOUBLE AS fitness FROM h1 WHERE fitness >= 0"))
def expand_hop1_survivors(spark, d):
    return expansion.survivors(expand_hop1(spark, d), DEMO.t1)


def _expand(spark, d, m: ExpansionParams, seeds=SEEDS) -> DataFrame:
    return expansion.expand_concept(_sents(spark, d), _words(spark, seeds), m, _df(spark, d))


@query("expand_hop2", _expand_sql(DEMO, "SELECT word, df, k, n, fitness::DOUBLE AS fitness FROM h2"))
def expand_hop2(spark, d):
    return expansion.hop(_sents(spark, d), _df(spark, d), expand_hop1_survivors(spark, d).select("word"), DEMO.a2, DEMO.b2, DEMO.g2)


@query("expand_result", _expand_sql(DEMO, f"SELECT word, df, k, n, fitness::DOUBLE AS fitness FROM h2 WHERE fitness >= {DEMO.t2}"))
def expand_result(spark, d):
    return _expand(spark, d, DEMO)


@query("expand_default_params", _expand_sql(ExpansionParams(), "SELECT word FROM h2 WHERE fitness >= 100", COMMON_SEEDS))
def expand_default_params(spark, d):
    return _expand(spark, d, ExpansionParams(), COMMON_SEEDS).select("word")


@query("expand_config_params", _expand_sql(SHIPPED, "SELECT word FROM h2 WHERE fitness >= 0"))
def expand_config_params(spark, d):
    return _expand(spark, d, SHIPPED).select("word")


REFERENCE = (*SEEDS, "the", "of", "stering", "eaument", "nothere")
_PR = ", r AS (SELECT DISTINCT word FROM h2 WHERE fitness >= 0), g AS (SELECT DISTINCT word FROM " + _list(REFERENCE) + "), c AS (SELECT (SELECT count(*) FROM r) AS n_ret, (SELECT count(*) FROM g) AS n_ref, (SELECT count(*) FROM r SEMI JOIN g USING (word)) AS tp), q AS (SELECT *, CASE WHEN n_ret = 0 THEN 0 ELSE tp / n_ret END::DOUBLE AS precision, CASE WHEN n_ret = 0 THEN 0 ELSE tp / n_ref END::DOUBLE AS recall FROM c)"


def _pr(spark, d):
    return metrics.precision_recall(_expand(spark, d, DEMO).select("word"), _words(spark, REFERENCE))


@query("precision_recall", _expand_sql(DEMO, "SELECT 1") .removesuffix(" SELECT 1") + _PR + " SELECT n_ret, n_ref, tp, precision, recall FROM q")
def precision_recall(spark, d):
    return _pr(spark, d)


@query("f1_score", _expand_sql(DEMO, "SELECT 1").removesuffix(" SELECT 1") + _PR + " SELECT round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 9) AS f1 FROM q")
def f1_score(spark, d):
    return metrics.f1(_pr(spark, d), nan_as_zero=True).select(F.round("f1", 9).alias("f1"))


# ----------------------------------------------------------------------------------------------------------- relations
RELATIONS = (
    BASE
    + ", sp AS (SELECT * FROM (VALUES "
    + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(PAIRS))
    + """) v(pair_idx, w1, w2)),
l AS (SELECT doc_id, spos, word, max(pos) AS last FROM t WHERE word IN (SELECT w1 FROM sp UNION SELECT w2 FROM sp) GROUP BY ALL),
m AS (SELECT pair_idx, sp.w1, sp.w2, a.doc_id, a.spos, a.last AS p1, b.last AS p2 FROM sp JOIN l a ON a.word = sp.w1 JOIN l b ON b.word = sp.w2 AND a.doc_id = b.doc_id AND a.spos = b.spos),
pt AS (SELECT pair_idx, m.doc_id, m.spos, words[least(p1, p2)] AS prefix, words[least(p1, p2) + 2 : greatest(p1, p2)] AS infix, words[greatest(p1, p2) + 2] AS suffix, p1 < p2 AS forward FROM m JOIN w0 ON m.doc_id = w0.doc_id AND m.spos = w0.spos),
px AS (SELECT pair_idx, doc_id, spos, CASE WHEN prefix = '' THEN NULL ELSE prefix END AS prefix, infix, suffix, forward FROM pt),
ps AS (SELECT infix, len(infix) AS l, count(DISTINCT pair_idx) AS k, count(*) AS n, CASE WHEN count(DISTINCT coalesce(prefix, chr(1))) = 1 THEN min(prefix) END AS prefix, CASE WHEN count(DISTINCT coalesce(suffix, chr(1))) = 1 THEN min(suffix) END AS suffix, arg_min(forward, (pair_idx, doc_id, spos)) AS forward FROM px GROUP BY infix),
pf AS (SELECT *, (CASE WHEN l <= 1 OR l >= 5 THEN -40 ELSE 0 END + 10 * k - 2 * n)::BIGINT AS fitness FROM ps),
pg AS (SELECT * FROM pf WHERE fitness >= 12),
fm AS (SELECT pg.infix, pg.forward, p.doc_id, p.spos, p.first_pos, w0.words FROM pg JOIN p ON p.word = pg.infix[1] JOIN w0 ON w0.doc_id = p.doc_id AND w0.spos = p.spos WHERE len(pg.infix) > 0 AND w0.words[p.first_pos + 1 : p.first_pos + len(pg.infix)] = pg.infix),
fx AS (SELECT infix, forward, doc_id, spos, CASE WHEN first_pos = 0 THEN NULL ELSE words[first_pos] END AS lw, CASE WHEN words[first_pos + len(infix) + 1] = 'the' THEN words[first_pos + len(infix) + 2] ELSE words[first_pos + len(infix) + 1] END AS rw FROM fm),
fp AS (SELECT infix, doc_id, spos, CASE WHEN forward THEN lw ELSE rw END AS w1, CASE WHEN forward THEN rw ELSE lw END AS w2 FROM fx WHERE lw IS NOT NULL AND rw IS NOT NULL),
fs AS (SELECT w1, w2, count(DISTINCT infix) AS patterns, (10 * count(DISTINCT infix))::BIGINT AS fitness FROM fp GROUP BY ALL)
"""
)


def _found(spark, d):
    return relations.sentences_of_pairs(_sents(spark, d), relations.seed_pairs(spark, list(PAIRS)))


def _patterns(spark, d):
    return relations.patterns_of_pairs(_sents(spark, d), relations.seed_pairs(spark, list(PAIRS)))


def _scored(spark, d):
    return relations.score_patterns(_patterns(spark, d))


def _matches(spark, d):
    return relations.pattern_matches(_sents(spark, d), relations.pattern_survivors(_scored(spark, d)))


def _pairs(spark, d):
    sents = _sents(spark, d)
    return relations.score_pairs(_matches(spark, d), _df(spark, d), sents.count())


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("infix", F.array_join("infix", " "))


@query("relation_pair_sentences", RELATIONS + "SELECT pair_idx, w1, w2, doc_id, spos::BIGINT AS spos, p1::BIGINT AS p1, p2::BIGINT AS p2 FROM m")
def relation_pair_sentences(spark, d):
    return _found(spark, d).select("pair_idx", "w1", "w2", "doc_id", *[F.col(c).cast("long").alias(c) for c in ("spos", "p1", "p2")])


@query("relation_patterns", RELATIONS + "SELECT pair_idx, doc_id, spos::BIGINT AS spos, prefix, array_to_string(infix, ' ') AS infix, suffix, forward FROM px")
def relation_patterns(spark, d):
    return _flat(_patterns(spark, d)).withColumn("spos", F.col("spos").cast("long"))


@query("relation_pattern_scores", RELATIONS + "SELECT array_to_string(infix, ' ') AS infix, k, n, prefix, suffix, forward, fitness FROM pf")
def relation_pattern_scores(spark, d):
    return _flat(_scored(spark, d))


@query("relation_pattern_survivors", RELATIONS + "SELECT array_to_string(infix, ' ') AS infix, k, n, fitness FROM pg")
def relation_pattern_survivors(spark, d):
    return _flat(relations.pattern_survivors(_scored(spark, d))).select("infix", "k", "n", "fitness")


@query("relation_pattern_matches", RELATIONS + "SELECT array_to_string(infix, ' ') AS infix, doc_id, spos::BIGINT AS spos, w1, w2 FROM fp")
def relation_pattern_matches(spark, d):
    return _flat(_matches(spark, d)).withColumn("spos", F.col("spos").cast("long"))


def _numbered_patterns(spark, d):
    good = relations.pattern_survivors(_scored(spark, d)).where(F.size("infix") > 1)
    return materialize(good.select(F.monotonically_increasing_id().alias("id"), F.col("infix").alias("words")), "numbered")


def _for_index(spark, d, patterns):
    """Whether the index answers: few patterns, and documents that are one row each, as it takes each row's sentences for others."""
    return patterns.count() <= scans.FEW and _sents(spark, d).where(~F.col(corpus.ALONE)).isEmpty()


def _positional(spark, d):
    return PositionalIndex(once(spark, "positional", f"{d}/documents.parquet", lambda: PositionalIndex.build(_sents(spark, d)).blocks))


@query("pattern_places", RELATIONS + """, w1p AS (SELECT pg.infix, t.doc_id, t.spos, t.pos FROM pg JOIN t ON t.word = pg.infix[1] WHERE len(pg.infix) > 1)
SELECT array_to_string(infix, ' ') AS phrase, w1p.doc_id, w1p.spos::BIGINT AS spos, w1p.pos::BIGINT AS pos FROM w1p JOIN w0 ON w0.doc_id = w1p.doc_id AND w0.spos = w1p.spos WHERE words[pos + 1 : pos + len(infix)] = infix""")
def pattern_places(spark, d):
    """All places of the surviving patterns of two words or more, from the positional index or, where they are many, in one scan."""
    patterns = _numbered_patterns(spark, d)
    if not _for_index(spark, d, patterns):
        return scans.phrase_places(_sents(spark, d), patterns)
    found = _positional(spark, d).phrases(patterns)
    return found.join(patterns, "id").select(F.array_join("words", " ").alias("phrase"), "doc_id", "spos", "pos")


@query("pattern_sentences", RELATIONS + """, w2p AS (SELECT infix, unnest(list_distinct(infix)) AS word FROM pg WHERE len(infix) > 1), w3p AS (SELECT infix, doc_id, spos, count(*) AS c FROM w2p JOIN p USING (word) GROUP BY ALL)
SELECT array_to_string(infix, ' ') AS phrase, count(*) AS n FROM w3p WHERE c = len(list_distinct(infix)) GROUP BY infix""")
def pattern_sentences(spark, d):
    """How many sentences hold all words of each surviving pattern of two words or more, as for pattern_places."""
    patterns = _numbered_patterns(spark, d)
    counts = _positional(spark, d).sentence_counts(patterns) if _for_index(spark, d, patterns) else scans.sentence_counts(_sents(spark, d), patterns)
    return counts.join(patterns, "id").select(F.array_join("words", " ").alias("phrase"), "n")


@query("relation_pair_scores", RELATIONS + "SELECT w1, w2, patterns, fitness FROM fs")
def relation_pair_scores(spark, d):
    return _pairs(spark, d)


@query("relation_pair_survivors", RELATIONS + "SELECT w1, w2, patterns, fitness FROM fs WHERE fitness >= 20")
def relation_pair_survivors(spark, d):
    return relations.pair_survivors(_pairs(spark, d))


@query("relation_pairs_grouped", RELATIONS + "SELECT w1, string_agg(w2, ' ' ORDER BY fitness DESC, w2) AS w2s FROM fs WHERE fitness >= 20 GROUP BY w1")
def relation_pairs_grouped(spark, d):
    return relations.grouped(relations.pair_survivors(_pairs(spark, d))).select("w1", F.array_join("w2s", " ").alias("w2s"))


@query("relation_pairs_ranked", RELATIONS + "SELECT w1, w2, fitness, row_number() OVER (ORDER BY fitness DESC, w1, w2) AS rank FROM fs")
def relation_pairs_ranked(spark, d):
    """All scored pairs with their rank, without a sort in one task."""
    return relations.ranked(_pairs(spark, d)).select("w1", "w2", "fitness", "rank")


@query("relation_progress", RELATIONS + """SELECT 'pattern_count' AS counter, (SELECT count(*) FROM px) AS n UNION ALL SELECT 'patterns', (SELECT count(*) FROM pf) UNION ALL SELECT 'surviving_patterns', (SELECT count(*) FROM pg)
UNION ALL SELECT 'wpair_count', (SELECT count(*) FROM fp) UNION ALL SELECT 'pairs', (SELECT count(*) FROM fs) UNION ALL SELECT 'surviving_pairs', (SELECT count(*) FROM fs WHERE fitness >= 20)""")
def relation_progress(spark, d):
    """What a whole run tells its channel: the counters that are observed while it works."""
    lines: list[str] = []
    relations.relate(_sents(spark, d), _toks(spark, d), _posts(spark, d), relations.seed_pairs(spark, list(PAIRS)), Channel(lines.append))
    told = [int(n) for line in lines for n in re.findall(r" (\d+)", line)]
    return spark.createDataFrame(list(zip(("pattern_count", "patterns", "surviving_patterns", "wpair_count", "pairs", "surviving_pairs"), told, strict=True)), "counter string, n long")


@query("relation_counters", RELATIONS + "SELECT (SELECT count(*) FROM px) AS pattern_count, (SELECT count(*) FROM fp) AS wpair_count")
def relation_counters(spark, d):
    one = F.lit(1).alias("k")
    a = _patterns(spark, d).agg(F.count("*").alias("pattern_count")).select("*", one)
    return a.join(_matches(spark, d).agg(F.count("*").alias("wpair_count")).select("*", one), "k").drop("k")


# ------------------------------------------------------------------------------------------------------- fronts and swarms
POINTS = "WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS f1, embedding[2]::DOUBLE AS f2, embedding[3]::DOUBLE AS f3 FROM embeddings)"
_DOM3 = "y.f1 >= x.f1 AND y.f2 >= x.f2 AND y.f3 >= x.f3 AND (y.f1 > x.f1 OR y.f2 > x.f2 OR y.f3 > x.f3)"
FRONT3 = POINTS + f", fr AS (SELECT * FROM e x WHERE NOT EXISTS (SELECT 1 FROM e y WHERE {_DOM3}))"
CROWD = (
    FRONT3
    + ", cr AS (SELECT *, "
    + " OR ".join(f"lag(f{i}) OVER (ORDER BY f{i}, vec_id) IS NULL OR lead(f{i}) OVER (ORDER BY f{i}, vec_id) IS NULL" for i in (1, 2, 3))
    + " AS ends, "
    + " + ".join(f"coalesce((lead(f{i}) OVER (ORDER BY f{i}, vec_id) - lag(f{i}) OVER (ORDER BY f{i}, vec_id)) / 2.0, 0)" for i in (1, 2, 3))
    + " AS gap FROM fr), cd AS (SELECT vec_id, CASE WHEN ends THEN 1.7976931348623157e308 ELSE gap END AS distance FROM cr)"
)


def _points(spark, d):
    return _table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", i).cast("double").alias(f"f{i + 1}") for i in range(3)])


@query("pareto_front_2d", "SELECT p_partkey, p_size::DOUBLE AS f1, p_retailprice AS f2 FROM part x WHERE NOT EXISTS (SELECT 1 FROM part y WHERE y.p_size >= x.p_size AND y.p_retailprice >= x.p_retailprice AND (y.p_size > x.p_size OR y.p_retailprice > x.p_retailprice))")
def pareto_front_2d(spark, d):
    part = _table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("f1"), F.col("p_retailprice").alias("f2"))
    return pareto.pareto_front(part, ["f1", "f2"], [True, True])


@query("pareto_front_minmax", "SELECT p_partkey, p_size::DOUBLE AS f1, p_retailprice AS f2 FROM part x WHERE NOT EXISTS (SELECT 1 FROM part y WHERE y.p_size >= x.p_size AND y.p_retailprice <= x.p_retailprice AND (y.p_size > x.p_size OR y.p_retailprice < x.p_retailprice))")
def pareto_front_minmax(spark, d):
    part = _table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("f1"), F.col("p_retailprice").alias("f2"))
    return pareto.pareto_front(part, ["f1", "f2"], [True, False])


def _front3(spark, d):
    return pareto.pareto_front(_points(spark, d), ["f1", "f2", "f3"], [True] * 3)


@query("pareto_front_3d", FRONT3 + " SELECT vec_id, f1, f2, f3 FROM fr")
def pareto_front_3d(spark, d):
    return _front3(spark, d)


_DOM6 = " AND ".join(f"y.embedding[{i}] >= x.embedding[{i}]" for i in range(1, 7)) + " AND (" + " OR ".join(f"y.embedding[{i}] > x.embedding[{i}]" for i in range(1, 7)) + ")"


@query("pareto_front_6d", f"SELECT vec_id FROM embeddings x WHERE NOT EXISTS (SELECT 1 FROM embeddings y WHERE {_DOM6})")
def pareto_front_6d(spark, d):
    """Six objectives: most rows are in the front."""
    rows = _table(spark, d, "embeddings").select("vec_id", *[F.get("embedding", i).cast("double").alias(f"f{i}") for i in range(6)])
    return pareto.pareto_front(rows, [f"f{i}" for i in range(6)], [True] * 6).select("vec_id")


@query("archive_update", POINTS + f", a AS (SELECT * FROM e x WHERE vec_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM e y WHERE y.vec_id % 2 = 0 AND {_DOM3})), u AS (SELECT * FROM a UNION ALL SELECT * FROM e WHERE (vec_id % 2 = 0) IS NOT TRUE) SELECT * FROM u x WHERE NOT EXISTS (SELECT 1 FROM u y WHERE {_DOM3})")
def archive_update(spark, d):
    """The archive is the front of the even ids; all other rows are the new points."""
    e = _points(spark, d)
    old = pareto.pareto_front(e.where("vec_id % 2 = 0"), ["f1", "f2", "f3"], [True] * 3)
    new = e.where(~F.coalesce(F.col("vec_id") % 2 == 0, F.lit(False)))
    return pareto.pareto_front(old.unionByName(new), ["f1", "f2", "f3"], [True] * 3)


def _crowded(spark, d):
    return pareto.crowding_distance(_front3(spark, d), ["f1", "f2", "f3"], [(-1.0, 1.0)] * 3, "vec_id")


@query("crowding_distance", CROWD + " SELECT vec_id, distance > 1e300 AS is_end, CASE WHEN distance < 1e300 THEN round(distance, 9) END AS gap FROM cd")
def crowding_distance(spark, d):
    return _crowded(spark, d).select("vec_id", (F.col("distance") > 1e300).alias("is_end"), F.when(F.col("distance") < 1e300, F.round("distance", 9)).alias("gap"))


@query("leader_rank_weights", CROWD + ", rk AS (SELECT vec_id, row_number() OVER (ORDER BY distance, vec_id) AS rank, count(*) OVER () AS n FROM cd) SELECT vec_id, rank, round(rank * 2.0::DOUBLE / (n * (n + 1)), 12) AS weight FROM rk")
def leader_rank_weights(spark, d):
    return pareto.leader_weights(_crowded(spark, d), "vec_id").select("vec_id", F.col("rank").cast("long").alias("rank"), F.round("weight", 12).alias("weight"))


SWARM = """WITH q AS (SELECT vec_id AS particle, list_transform(range(1, 7), lambda i: embedding[i]::DOUBLE * 100) AS pos, list_transform(range(7, 13), lambda i: embedding[i]::DOUBLE) AS vel, list_transform(range(13, 19), lambda i: embedding[i]::DOUBLE * 100) AS pbest,
CASE WHEN vec_id % 7 = 0 THEN 'NaN'::DOUBLE ELSE (vec_id * 37 % 101) / 100.0::DOUBLE END AS fitness, (vec_id * 53 % 101) / 100.0::DOUBLE AS pbest_fitness FROM embeddings)"""
LEADER = ", ld AS (SELECT coalesce(arg_max(particle, (fitness, particle)), 0) AS leader FROM q WHERE NOT isnan(fitness))"


def _swarm(spark, d):
    part = lambda a, k: F.transform(F.slice("embedding", a, 6), lambda x: x.cast("double") * k)
    i = F.col("vec_id")
    return _table(spark, d, "embeddings").select(i.alias("particle"), part(1, 100.0).alias("pos"), part(7, 1.0).alias("vel"), part(13, 100.0).alias("pbest"), F.when(i % 7 == 0, float("nan")).otherwise((i * 37 % 101) / F.lit(100.0)).alias("fitness"), ((i * 53 % 101) / F.lit(100.0)).alias("pbest_fitness"))


def _show(c: str):
    return F.array_join(F.transform(c, lambda x: F.round(x * 1000000).cast("long").cast("string")), " ").alias(c)


def _show_sql(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda x: round(x * 1000000)::BIGINT::VARCHAR), ' ') AS {c}"


@query("pso_personal_best", SWARM + f", b AS (SELECT particle, CASE WHEN NOT isnan(fitness) AND fitness >= pbest_fitness THEN pos ELSE pbest END AS pbest, CASE WHEN NOT isnan(fitness) AND fitness >= pbest_fitness THEN fitness ELSE pbest_fitness END AS pbest_fitness FROM q) SELECT particle, {_show_sql('pbest')}, pbest_fitness FROM b")
def pso_personal_best(spark, d):
    return swarm.personal_best(_swarm(spark, d)).select("particle", _show("pbest"), "pbest_fitness")


@query("pso_leader", SWARM + LEADER + " SELECT leader FROM ld")
def pso_leader(spark, d):
    return swarm.leader(_swarm(spark, d))


_R = lambda k: f"((particle * {k} + (i - 1) * 11) % 97) / 97.0::DOUBLE"
_LO = "CASE WHEN i IN (3, 6) THEN -1000.0 ELSE -100.0 END"
MOVE = (
    SWARM + LEADER + ", lp AS (SELECT pos AS lpos FROM q JOIN ld ON particle = leader), "
    f"v AS (SELECT particle, pos, list_transform(range(1, 7), lambda i: 0.02::DOUBLE * vel[i] + 0.2::DOUBLE * ({_R(13)}) * (pbest[i] - pos[i]) + 0.2::DOUBLE * ({_R(29)}) * (lpos[i] - pos[i])) AS vel FROM q CROSS JOIN lp), "
    f"mv AS (SELECT particle, vel, list_transform(range(1, 7), lambda i: greatest({_LO}, least(-({_LO}), pos[i] + vel[i]))) AS pos FROM v)"
)


@query("pso_move_step", MOVE + f" SELECT particle, {_show_sql('vel')}, {_show_sql('pos')} FROM mv")
def pso_move_step(spark, d):
    rows = _swarm(spark, d)
    best = swarm.leader(rows)
    lpos = rows.join(F.broadcast(best), F.col("particle") == F.col("leader")).select(F.col("pos").alias("lpos"))
    r = lambda k: F.array(*[((F.col("particle") * k + i * 11) % 97) / F.lit(97.0) for i in range(6)])
    return swarm.move(rows, lpos, swarm.Coefficients(), BOUNDS6, r(13), r(29)).select("particle", _show("vel"), _show("pos"))


@query("mopso_personal_best", "WITH q AS (SELECT vec_id AS particle, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS d FROM embeddings) SELECT particle, NOT (c >= a AND d >= b AND (c > a OR d > b)) AS moved FROM q")
def mopso_personal_best(spark, d):
    f = lambda i: F.get("embedding", i).cast("double")
    rows = _table(spark, d, "embeddings").select(F.col("vec_id").alias("particle"), F.array(F.lit(1.0)).alias("pos"), F.array(F.lit(0.0)).alias("pbest"), F.array(f(0), f(1)).alias("fitness"), F.array(f(2), f(3)).alias("pbest_fitness"))
    return swarm.personal_best_pareto(rows, [True, True]).select("particle", (F.get("pbest", 0) == 1.0).alias("moved"))


@query("pso_train_smoke")
def pso_train_smoke(spark, d):
    out = training.train_pso(spark, _sents(spark, d), _words(spark, SEEDS[:2]), _words(spark, REFERENCE), training.TrainingOptions(particles=4, iterations=2))
    return runs.from_log(out.log, spark, 0, 0)


@query("mopso_train_smoke")
def mopso_train_smoke(spark, d):
    out = training.train_mopso(spark, _sents(spark, d), _words(spark, SEEDS[:2]), _words(spark, REFERENCE), training.TrainingOptions(particles=4, iterations=2))
    return runs.from_log(out.log, spark, 0, 0)


@query("vector_to_params", "SELECT vec_id, embedding[1]::DOUBLE AS a1, embedding[2]::DOUBLE AS b1, embedding[3]::DOUBLE AS g1, embedding[4]::DOUBLE AS a2, embedding[5]::DOUBLE AS b2, embedding[6]::DOUBLE AS g2, 0.5::DOUBLE AS t FROM embeddings")
def vector_to_params(spark, d):
    v = F.transform(F.slice("embedding", 1, 6), lambda x: x.cast("double"))
    p = expansion.params_column(v, 0.5)
    return _table(spark, d, "embeddings").select("vec_id", p.alias("p")).select("vec_id", *[f"p.{n}" for n in ("a1", "b1", "g1", "a2", "b2", "g2")], F.col("p.t2").alias("t"))


@query("seed_sample", BASE + "SELECT word FROM df ORDER BY md5(word || '#3'), word LIMIT 8")
def seed_sample(spark, d):
    return training.sample_seeds(_df(spark, d), 8, 3)


@query("pso_scores", BASE + _hop_sql("h1", _list(SEEDS[:2]), 50.0, 0.0, -1.0) + _hop_sql("h2", "(SELECT word FROM h1 WHERE fitness >= 0)", 10.0, 1.0, -2.0) + _PR + " SELECT 0::BIGINT AS particle, precision, recall FROM q")
def pso_scores(spark, d):
    """What training measures for one particle, as expand_concept and precision_recall do."""
    fitness = training.ExpansionFitness(_sents(spark, d), _words(spark, SEEDS[:2]), _words(spark, REFERENCE))
    particles = spark.createDataFrame([(0, DEMO.to_vector())], "particle long, pos array<double>")
    return fitness(particles).select("particle", "precision", "recall")


# --------------------------------------------------------------------------------------------------------------- sources
@query("xml_tag_texts", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def xml_tag_texts(spark, d):
    """Each text in an element of its own, escaped, with a comment, an empty element and other elements around it, and read back."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    content = F.concat(F.lit('<page><title>no</title><text/><!-- <text>no</text> --><text a="1">'), escaped, F.lit("</text></page>"))
    files = _table(spark, d, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("path"), F.encode(content, "UTF-8").alias("content"))
    return inputs.parse_xml(files, "text").select(F.col("path").cast("long").alias("doc_id"), "text")


@query("xml_split_texts", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def xml_split_texts(spark, d):
    """All texts as elements of large files, with elements in comments and sections between them, read in ranges of 64 kB."""
    escaped = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit('<page><!-- <text>no</text> --><text n="a>b">'), F.col("doc_id").cast("string"), F.lit(":"), escaped, F.lit("</text><![CDATA[<text>no]]></page>"))
    folder = scratch(spark, "xml")
    _table(spark, d, "documents").where("text is not null").select(page).write.text(folder)
    parts = F.split(F.col("text"), ":", 2)
    return read_xml_splits(spark, folder, "text", 1 << 16).select(parts[0].cast("long").alias("doc_id"), parts[1].alias("text"))


@query("xml_doc_numbers", "SELECT (row_number() OVER (ORDER BY doc_id::VARCHAR, i) - 1)::BIGINT AS doc_id, 'text ' || doc_id || ' ' || i AS text FROM documents, range(2) r(i)")
def xml_doc_numbers(spark, d):
    """Two elements a file; documents are numbered by path and place."""
    element = lambda i: F.concat(F.lit("<text>text "), F.col("doc_id").cast("string"), F.lit(f" {i}</text>"))
    files = _table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode(F.concat(element(0), element(1)), "UTF-8").alias("content"))
    return inputs.numbered(inputs.parse_xml(files, "text"))


@query("word_file_lines", "WITH l AS (SELECT doc_id, string_split_regex(text, '\r?\n') AS w FROM documents WHERE text IS NOT NULL), e AS (SELECT doc_id, unnest(range(len(w)))::INT AS place, unnest(w) AS word FROM l) SELECT * FROM e WHERE word <> ''")
def word_file_lines(spark, d):
    """Each text as a file of terms, one a line."""
    return inputs.word_lines(_table(spark, d, "documents").where("text is not null").withColumnRenamed("text", "value"), "doc_id")


@query("pairs_request_rows", "SELECT o_orderkey, 0 AS pair_idx, o_orderstatus AS w1, o_orderpriority AS w2 FROM orders UNION ALL SELECT o_orderkey, 1, o_orderpriority, 'x' || o_custkey FROM orders")
def pairs_request_rows(spark, d):
    """A request of two pairs from each order, as JSON, and its rows."""
    pairs = F.array(F.array("o_orderstatus", "o_orderpriority"), F.array(F.col("o_orderpriority"), F.concat(F.lit("x"), F.col("o_custkey").cast("string"))))
    requests = _table(spark, d, "orders").select("o_orderkey", F.to_json(F.struct(pairs.alias("pairs"))).alias("value"))
    return inputs.pair_requests(requests, "value", "o_orderkey")


@query("preprocessed_pages", f"SELECT page_id, {_sql_markup('html')} AS stripped, html AS unknown FROM pages")
def preprocessed_pages(spark, d):
    return _table(spark, d, "pages").select("page_id", preprocess(F.col("html"), "wikitext::strip_markup").alias("stripped"), preprocess(F.col("html"), "no::such").alias("unknown"))


@query("unicode_profile_counts", r"SELECT doc_id, length(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}]', '', 'g'))::BIGINT AS n_letters FROM documents")
def unicode_profile_counts(spark, d):
    """Segmentation by Unicode boundaries loses no letter or digit."""
    flat = F.array_join(F.flatten(F.transform(cut_unicode("text"), lambda s: s["words"])), "")
    return _table(spark, d, "documents").select("doc_id", F.length(F.regexp_replace(flat, r"[^\p{L}\p{N}]", "")).cast("long").alias("n_letters"))


#: The sentence rules over runs of a text: terminators with closers and spaces, separators, and what is between. Whether a sentence ends
#: behind a run follows from its neighbours.
_UNICODE_SQL = r"""
WITH u0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[.!?][")(}\]\[{\p{Pi}\p{Pf}'']*[ \t\x0b\x0c\p{Zs}]*|\r\n|[\n\r\x{85}\x{2028}\x{2029}]|[^.!?\n\r\x{85}\x{2028}\x{2029}]+') AS rs FROM documents),
u1 AS (SELECT doc_id, unnest(range(len(rs))) AS i, unnest(rs) AS r FROM u0),
u2 AS (SELECT *, lag(r) OVER w AS b, lead(r) OVER w AS a FROM u1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
u3 AS (SELECT doc_id, i, r, CASE
  WHEN a IS NULL OR regexp_matches(r, '^[\n\r\x{85}\x{2028}\x{2029}]') THEN true
  WHEN NOT regexp_matches(r, '^[.!?]') OR regexp_matches(a, '^[.!?\n\r\x{85}\x{2028}\x{2029},:-]') THEN false
  WHEN r[1] <> '.' THEN true
  WHEN length(r) = 1 AND (regexp_matches(a, '^\p{Nd}') OR (regexp_matches(coalesce(b, ''), '[\p{Lu}\p{Ll}]$') AND regexp_matches(a, '^\p{Lu}'))) THEN false
  ELSE NOT regexp_matches(a, '^[^\p{L}]*\p{Ll}') END AS ends FROM u2),
u4 AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s, coalesce(sum(length(r)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begin FROM u3),
u5 AS (SELECT doc_id, s, min(begin)::BIGINT AS start, string_agg(r, '' ORDER BY i) AS sent FROM u4 GROUP BY doc_id, s),
us AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS spos, start, sent FROM u5 WHERE regexp_matches(sent, '[\p{L}\p{N}]'))
"""
_PIECES_SQL = r"\r\n|[\n\r]|[ ]+|_*(?:\p{L}(?:[.:''·]\p{L})*|\p{Nd}(?:[.,;'']\p{Nd})*)+(?:_+(?:\p{L}(?:[.:''·]\p{L})*|\p{Nd}(?:[.,;'']\p{Nd})*)+)*_*|_+|."


def _unicode(spark, d):
    return corpus.sentences(_table(spark, d, "documents").select("doc_id", "text"), profile="unicode")


@query("unicode_sentences", _UNICODE_SQL + "SELECT * FROM us")
def unicode_sentences(spark, d):
    """Sentences by the Unicode rules, with where they begin."""
    return _unicode(spark, d).select("doc_id", F.col("spos").cast("long").alias("spos"), F.col("start").cast("long").alias("start"), "sent")


@query("unicode_tokens", _UNICODE_SQL + f", uw AS (SELECT doc_id, spos, list_filter(regexp_extract_all(sent, '{_PIECES_SQL}'), lambda w: w <> ' ') AS ws FROM us) SELECT doc_id, spos, unnest(range(len(ws)))::BIGINT AS pos, unnest(ws) AS word FROM uw")
def unicode_tokens(spark, d):
    """Pieces between the Unicode word boundaries of each sentence, but single spaces."""
    return corpus.tokens(_unicode(spark, d)).select("doc_id", F.col("spos").cast("long").alias("spos"), F.col("pos").cast("long").alias("pos"), "word")


# ------------------------------------------------------------------------------------------------------------- run store
DAT = """WITH dat AS (SELECT (CASE o_orderkey % 8 WHEN 0 THEN 10 WHEN 1 THEN 11 WHEN 2 THEN 12 WHEN 3 THEN 2 WHEN 4 THEN 14 WHEN 5 THEN 15 WHEN 6 THEN 16 ELSE 99 END)::INT AS batch_id, (o_orderkey // 8 % 5)::INT AS irun, (o_orderkey // 40 % 11)::INT AS icycle, (o_orderkey // 440)::INT AS iparticle,
CASE WHEN o_custkey % 10 = 0 THEN 0.0 ELSE (o_orderkey * 31 % 1009) / 1024.0 END::DOUBLE AS fitness FROM orders)"""
BATCH = "bt AS (SELECT * FROM (VALUES " + ", ".join(f"({b[0]}, {b[4]})" for b in runs.BATCHES) + ") v(batch_id, ncorpus))"


def _dat(spark, d, raw: bool = False):
    k = F.col("o_orderkey")
    ids = F.get(F.array(*[F.lit(i) for i in (10, 11, 12, 2, 14, 15, 16, 99)]), (k % 8).cast("int"))
    fitness = F.when(F.col("o_custkey") % 10 == 0, float("nan")).otherwise((k * 31 % 1009) / F.lit(1024.0))
    whole = lambda n, m: (F.floor(k / n) % m if m else F.floor(k / n)).cast("int")
    pos = [((k * (i + 1)) % 201 - 100).cast("double").alias(f"pos{i}") for i in range(1, 7)]
    return _table(spark, d, "orders").select(ids.alias("batch_id"), whole(8, 5).alias("irun"), whole(40, 11).alias("icycle"), whole(440, 0).alias("iparticle"), *pos, (fitness if raw else runs.nan_to_zero(fitness)).alias("fitness"), F.lit(0.5).alias("precision"), F.lit(0.25).alias("recall"))


@query("run_avg_by_cycle", DAT + " SELECT icycle, round(avg(fitness), 9) AS avg_fitness FROM dat GROUP BY icycle")
def run_avg_by_cycle(spark, d):
    return runs.avg_by_cycle(_dat(spark, d)).select("icycle", F.round("avg_fitness", 9).alias("avg_fitness"))


@query("run_max_by_run", DAT + " SELECT irun, max(fitness) AS max_fitness FROM dat WHERE icycle = 10 GROUP BY irun")
def run_max_by_run(spark, d):
    return runs.max_by_run(_dat(spark, d), 10)


@query("run_left_join_batch", DAT + ", " + BATCH + " SELECT dat.batch_id, max(ncorpus) AS ncorpus, arg_max(irun, (fitness, irun)) AS irun, max(fitness) AS max_fitness FROM dat LEFT JOIN bt ON dat.batch_id = bt.batch_id WHERE dat.batch_id IN (10, 11, 12, 2, 14, 15, 16, 17, 99) AND icycle = 10 GROUP BY dat.batch_id")
def run_left_join_batch(spark, d):
    return runs.best_by_batch(_dat(spark, d), runs.batches(spark), [10, 11, 12, 2, 14, 15, 16, 17, 99], 10)


@query("run_histogram", DAT + " SELECT floor(fitness / 0.0625) * 0.0625 + 0.03125 AS bin, round(count(*) / (SELECT count(*) FROM dat)::DOUBLE, 9) AS share FROM dat GROUP BY ALL".replace("GROUP BY ALL", "GROUP BY 1"))
def run_histogram(spark, d):
    return runs.histogram(_dat(spark, d), width=0.0625).select("bin", F.round("share", 9).alias("share"))


@query("run_winner_last_block", DAT + ", l AS (SELECT *, max(icycle) OVER (PARTITION BY irun) AS m FROM dat), b AS (SELECT irun, max((fitness, iparticle)) AS x FROM l WHERE icycle = m GROUP BY irun) SELECT irun, x[2] AS iparticle, x[1] AS fitness FROM b")
def run_winner_last_block(spark, d):
    return runs.winner(_dat(spark, d)).select("irun", "iparticle", "fitness")


@query("run_nan_to_zero", DAT + " SELECT count(*) FILTER (WHERE fitness = 0) AS n_zero, count(*) AS n FROM dat")
def run_nan_to_zero(spark, d):
    return _dat(spark, d, raw=True).select(runs.nan_to_zero(F.col("fitness")).alias("f")).agg(F.count_if(F.col("f") == 0).alias("n_zero"), F.count("*").alias("n"))


@query("run_log_reshape", "SELECT (o_orderkey // 50)::INT AS icycle, (o_orderkey % 50)::INT AS iparticle, (o_orderkey % 7)::DOUBLE AS fitness, (o_orderkey % 3)::DOUBLE AS precision, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1.5 END::DOUBLE AS recall FROM orders")
def run_log_reshape(spark, d):
    k = F.col("o_orderkey")
    text = F.array(*[F.lit("0")] * 6, (k % 7).cast("string"), *[F.lit("1")] * 13, (k % 3).cast("string"), F.when(k % 5 == 0, "NaN").otherwise("1.5"))
    return runs.reshape_log(_table(spark, d, "orders").select((k + 1).alias("nr"), text.alias("f")), 50).select("icycle", "iparticle", "fitness", "precision", "recall")


@query("run_positions", DAT + " SELECT icycle, iparticle, fitness FROM dat WHERE batch_id = 10 AND irun = 0 AND icycle IN (0, 5, 10)")
def run_positions(spark, d):
    rows = _dat(spark, d)
    return rows.where((F.col("batch_id") == 10) & (F.col("irun") == 0) & F.col("icycle").isin(0, 5, 10)).select("icycle", "iparticle", "fitness")


@query("run_batches", DAT + ", bb AS (SELECT * FROM (VALUES " + ", ".join(str(b) for b in runs.BATCHES) + ") v(batch_id, tpso, tfitness, tcorpus, ncorpus, nparticles, ncycles, nseed, tseed, nruns)) SELECT bb.*, count(dat.batch_id) AS n FROM bb LEFT JOIN dat ON bb.batch_id = dat.batch_id GROUP BY ALL")
def run_batches(spark, d):
    """The experiments on record, each with its rows in the store."""
    counts = _dat(spark, d).groupBy("batch_id").agg(F.count("*").alias("n"))
    return runs.batches(spark).join(counts, "batch_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


_POS = ", ".join(f"((o_orderkey * {i + 1}) % 201 - 100)::DOUBLE AS pos{i}" for i in range(1, 7))
WHOLE_DAT = DAT.replace("o_orderkey // 440)::INT AS iparticle,", f"o_orderkey // 440)::INT AS iparticle, {_POS}, 0.5::DOUBLE AS precision, 0.25::DOUBLE AS recall,")
_SIX = ", ".join(runs.POSITIONS)
#: By statement of the store: its parameters, and the same in DuckDB.
_ASKED = {
    "average_by_cycle": ({"batch": 2}, "SELECT icycle, round(avg(fitness), 9) AS avg_fitness FROM dat WHERE batch_id = 2 GROUP BY icycle"),
    "best_by_run": ({"batch": 2, "cycle": 10}, "SELECT irun, max(fitness) AS max_fitness FROM dat WHERE batch_id = 2 AND icycle = 10 GROUP BY irun"),
    "best_by_corpus": ({"batches": [10, 11, 12, 2, 14, 15, 16, 17, 99], "cycle": 10}, "SELECT dat.batch_id, max(ncorpus) AS ncorpus, arg_max(irun, (fitness, irun)) AS irun, max(fitness) AS max_fitness FROM dat LEFT JOIN bt ON dat.batch_id = bt.batch_id WHERE dat.batch_id IN (10, 11, 12, 2, 14, 15, 16, 17, 99) AND icycle = 10 GROUP BY dat.batch_id"),
    "places_in_cycle": ({"batch": 2, "run": 1, "cycle": 3}, f"SELECT iparticle, {_SIX} FROM dat WHERE batch_id = 2 AND irun = 1 AND icycle = 3"),
    "path_of_particle": ({"batch": 2, "run": 1, "particle": 1}, f"SELECT icycle, {_SIX} FROM dat WHERE batch_id = 2 AND irun = 1 AND iparticle = 1"),
    "places_in_run": ({"batch": 2, "run": 1}, f"SELECT icycle, iparticle, {_SIX} FROM dat WHERE batch_id = 2 AND irun = 1"),
    "front_of_cycle": ({"batch": 2, "cycle": 10}, "SELECT precision, recall FROM dat WHERE batch_id = 2 AND icycle = 10"),
    "shares": ({"batch": 2, "cycle": 10, "width": 0.0625}, "SELECT floor(fitness / 0.0625::DOUBLE) * 0.0625::DOUBLE + 0.03125 AS bin, round(count(*) / (SELECT count(*) FROM dat WHERE batch_id = 2 AND icycle = 10)::DOUBLE, 9) AS share FROM dat WHERE batch_id = 2 AND icycle = 10 GROUP BY 1"),
}


def _asked(name: str):
    parameters, sql = _ASKED[name]

    @query(f"ask_{name}", WHOLE_DAT + ", " + BATCH + " " + sql)
    def ask(spark, d):
        runs.open_store(spark, _dat(spark, d))
        rows = runs.ask(spark, name, **parameters)
        runs.close_store(spark)
        return rows.withColumns({c: F.round(c, 9) for c in ("avg_fitness", "share") if c in rows.columns})


for _name in _ASKED:
    _asked(_name)


@query("run_log_blocks", "WITH r AS (SELECT (o_custkey % 4)::INT AS run, o_orderkey // 50 AS c, o_orderkey AS k FROM orders), n AS (SELECT *, dense_rank() OVER (PARTITION BY run ORDER BY c) - 1 AS icycle, row_number() OVER (PARTITION BY run, c ORDER BY k) - 1 AS iparticle FROM r) SELECT run, icycle::INT AS icycle, iparticle::INT AS iparticle, (k % 7)::DOUBLE AS fitness, (k % 3)::DOUBLE AS precision, CASE WHEN k % 5 = 0 THEN 0 ELSE 1.5 END::DOUBLE AS recall FROM n")
def run_log_blocks(spark, d):
    """Logs of four runs as text with cycles of any length, read in blocks."""
    k = F.col("o_orderkey")
    line = F.array_join(F.array(*[F.lit("0")] * 6, (k % 7).cast("string"), *[F.lit("1")] * 13, (k % 3).cast("string"), F.when(k % 5 == 0, "NaN").otherwise("1.5")), "\t")
    rows = _table(spark, d, "orders").select((F.col("o_custkey") % 4).cast("int").alias("run"), F.floor(k / 50).alias("cycle"), k.alias("k"), line.alias("line"))
    cycles = rows.groupBy("run", "cycle").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("lines"))  # a cycle is a swarm
    folder = scratch(spark, "logs")
    blocks = cycles.repartition("run").sortWithinPartitions("run", "cycle").select("run", F.concat("lines", F.lit("\n\n")).alias("value"))
    blocks.write.partitionBy("run").text(folder)
    return runs.read_log_blocks(spark, folder).select(F.regexp_extract("file", r"run=(\d+)", 1).cast("int").alias("run"), "icycle", "iparticle", "fitness", "precision", "recall")


@query("run_summary", DAT + " SELECT count(fitness) AS records, round(avg(fitness), 9) AS mean, round(stddev_pop(fitness), 9) AS std, min(fitness) AS least, max(fitness) AS most, round(quantile_cont(fitness, 0.25), 9) AS lower, round(quantile_cont(fitness, 0.5), 9) AS middle, round(quantile_cont(fitness, 0.75), 9) AS upper FROM dat")
def run_summary(spark, d):
    rounded = [F.round(c, 9).alias(c) for c in ("mean", "std", "lower", "middle", "upper")]
    return runs.summary(_dat(spark, d)).select("records", "least", "most", *rounded)


@query("run_blocks", DAT + " SELECT irun, count(DISTINCT icycle) AS blocks, count(*) AS records FROM dat GROUP BY irun")
def run_blocks(spark, d):
    return runs.blocks(_dat(spark, d))


@query("run_repeated_keys", DAT + " SELECT batch_id, count(*) AS n FROM dat GROUP BY batch_id HAVING count(*) > 1")
def run_repeated_keys(spark, d):
    return runs.repeated_keys(_dat(spark, d).select("batch_id"))


@query("run_null_rows", "SELECT * FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '5-LOW') AS priority FROM orders) WHERE status IS NULL OR priority IS NULL")
def run_null_rows(spark, d):
    """Rows that a store without nulls refuses."""
    return runs.null_rows(_table(spark, d, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority")))


@query("run_final_front", DAT + " SELECT fitness FROM dat WHERE batch_id = 10 AND icycle = (SELECT max(icycle) FROM dat WHERE batch_id = 10)")
def run_final_front(spark, d):
    return runs.final_front(_dat(spark, d), 10, ["fitness"])


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
