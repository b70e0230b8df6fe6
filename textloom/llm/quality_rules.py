"""Quality rules by distribution divergence, in DataFrame functions alone.

Each whole text yields two histograms: of its characters by class, and of its words by groups of common words. They are compared
with the reference of the document's language, the sums of the same histograms over all documents of that language, by the
Jensen-Shannon distance. The reference of all documents counts too, and the nearer of the two decides, as a text may be in another
language than its row says. Texts under a minimum length aren't compared, as their histograms say little. Plain counts (words,
symbols, repeated lines and repeated word triples) come beside.

One pass reads the texts; counts and histograms are stored, summed by language, and joined back. All work on a text happens
within its row, so neither a hot source nor a group of copies gathers anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, materialize, table

WHITE = r"[\x20\x09-\x0D]"
LEAST_WORDS = 50
MOST_CHAR_DISTANCE = 0.28
MOST_WORD_DISTANCE = 0.3
LEAST_DOCUMENTS = 20  # of a language; below, all documents are the reference
LEAST_CHARS = 200
#: Common words of four languages, in groups of articles and pronouns, prepositions, and verbs and connectives.
COMMON = (
    ("the", "a", "an", "this", "that", "it", "he"),
    ("of", "to", "in", "for", "on", "with", "by", "at", "from"),
    ("and", "or", "is", "are", "was", "be", "as"),
    ("der", "die", "das", "den", "dem", "ein", "eine", "sie"),
    ("von", "zu", "mit", "auf", "für", "im", "bei"),
    ("und", "ist", "nicht", "auch", "als", "oder"),
    ("le", "la", "les", "un", "une", "des", "du", "il", "elle"),
    ("de", "dans", "pour", "par", "sur", "au", "avec", "en"),
    ("et", "est", "que", "qui", "ou", "pas"),
    ("el", "los", "las", "una", "del", "su"),
    ("por", "con", "para", "al"),
    ("y", "es", "se", "no", "como"),
)
ALL_COMMON = sorted({w for group in COMMON for w in group})


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WHITE + "+"), lambda w: w != "")


def _member(group: tuple[str, ...]):
    return lambda w: w.isin(list(group))


def _repeat_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text holds twice or more. Windows are compared by 64-bit hashes; the
    sort is skipped where no two are equal."""

    def from_hashes(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), let(ordered, from_ordered)).otherwise(F.lit(0))

    def from_ordered(s: Column) -> Column:
        same = F.zip_with(s, F.slice(s, 2, F.size(s)), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
        either = let(same, lambda e: F.zip_with(e, F.concat(F.array(F.lit(False)), e), lambda x, y: F.coalesce(x, F.lit(False)) | y))
        places = F.zip_with(s, either, lambda a, hit: F.when(hit, a["i"]))
        return let(F.sort_array(F.filter(places, lambda p: p.isNotNull())), covered)

    def covered(places: Column) -> Column:
        steps = F.zip_with(places, F.slice(places, 2, F.size(places)), lambda p, q: F.least(F.lit(3), F.coalesce(q - p, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda total, n: total + n)

    def from_words(w: Column) -> Column:
        hashes = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) > 3, let(F.slice(hashes, 1, F.greatest(F.size(w) - 2, F.lit(1))), from_hashes)).otherwise(F.lit(0))

    return let(words, from_words).cast("long")


def measure(docs: DataFrame, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """The columns `keep` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the internal columns __lang, __chars
    and __common. A null text counts as empty: all counts are 0."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{lang}`").cast("string").alias("__lang"), body.alias("__text"))
    rows = rows.withColumn("__words", _words(F.col("__text")))
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counts = {
        "n_words": F.size("__words").cast("long"),
        "word_chars": (F.length(t) - F.regexp_count(t, F.lit(WHITE))).cast("long"),
        "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": _repeat_words(F.col("__words")),
        "__upper": F.regexp_count(t, F.lit("[A-Z]")).cast("long"),
        "__digit": F.regexp_count(t, F.lit("[0-9]")).cast("long"),
        "__mark": F.regexp_count(t, F.lit(r"[.,;:!?'\"()\-]")).cast("long"),
        "__high": F.regexp_count(t, F.lit(r"[^\x00-\x7F]")).cast("long"),
        "__common": let(
            F.filter("__words", lambda w: w.isin(ALL_COMMON)),
            lambda some: F.array(*[F.size(F.filter(some, _member(group))).cast("long") for group in COMMON]),
        ),
    }
    rows = rows.select(*[F.col(f"`{c}`") for c in keep], "__lang", *[c.alias(n) for n, c in counts.items()])
    rest = F.col("word_chars") - F.col("__upper") - F.col("__digit") - F.col("__mark") - F.col("__high") - F.col("n_symbols")
    chars = F.array("__upper", "__digit", "__mark", "__high", "n_symbols", rest)
    other = F.greatest(F.col("n_words") - F.aggregate("__common", F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0))
    return rows.select(*[F.col(f"`{c}`") for c in keep], "__lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("__chars"), F.concat("__common", F.array(other)).alias("__common"))


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("double"), lambda s, x: s + x)
    return let(total, lambda n: F.transform(counts, lambda x: F.when(n > 0, x / n).otherwise(F.lit(0.0))))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence to base 2 of two histograms of counts, from 0 to 1."""

    def part(a: Column, b: Column) -> Column:
        m = (a + b) / 2
        one = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (one(a) + one(b)) / 2

    terms = F.zip_with(_shares(p), _shares(q), part)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def references(measured: DataFrame) -> DataFrame:
    """A row for each language of LEAST_DOCUMENTS or more (__ref_lang) and one for all documents (__ref_lang null, __all true):
    sums of the histograms. A language is a group of sums, so a hot one costs no more than another."""
    sums = [F.sum(F.get(F.col(c), i)).alias(f"{c}{i}") for c, n in (("__chars", 6), ("__common", len(COMMON) + 1)) for i in range(n)]
    grouped = measured.rollup("__lang").agg(F.grouping("__lang").alias("__all"), F.count("*").alias("__n"), *sums)
    arrays = [F.array(*[F.col(f"{c}{i}") for i in range(n)]).alias(f"__ref{c}") for c, n in (("__chars", 6), ("__common", len(COMMON) + 1))]
    return grouped.select(F.col("__lang").alias("__ref_lang"), (F.col("__all") == 1).alias("__all"), "__n", *arrays)


def judge(measured: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep`, the five counts, base_failed, kept, char_distance and word_distance (rounded; null where the text is
    under the minimum length). Rows without a language, or of a rare one, are compared with the reference of all documents."""
    refs = materialize(references(measured), "references")
    own = refs.where(~F.col("__all") & F.col("__ref_lang").isNotNull() & (F.col("__n") >= LEAST_DOCUMENTS)).select("__ref_lang", "__ref__chars", "__ref__common")
    every = refs.where("__all").select(F.lit(1).alias("__one"), F.col("__ref__chars").alias("__any_chars"), F.col("__ref__common").alias("__any_common"))  # one row
    rows = measured.join(own, F.col("__lang") == F.col("__ref_lang"), "left").withColumn("__one", F.lit(1)).join(F.broadcast(every), "__one", "left")
    n = F.col("n_words")
    base_failed = (n < 50) | (100 * F.col("n_repeat_words") > 50 * n)
    long_enough = (n >= LEAST_WORDS) & (F.col("word_chars") >= LEAST_CHARS)
    nearer = lambda own_, ref, any_: F.least(js_distance(F.col(own_), F.coalesce(ref, any_)), js_distance(F.col(own_), any_))
    distance = lambda own_, ref, any_: F.when(long_enough, F.round(nearer(own_, ref, any_), 4))
    rows = rows.withColumns({"base_failed": base_failed, "char_distance": distance("__chars", F.col("__ref__chars"), F.col("__any_chars")), "word_distance": distance("__common", F.col("__ref__common"), F.col("__any_common"))})
    far = F.coalesce((F.col("char_distance") > MOST_CHAR_DISTANCE) | (F.col("word_distance") > MOST_WORD_DISTANCE), F.lit(False))
    return rows.select(*[F.col(f"`{c}`") for c in keep], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "char_distance", "word_distance")


def check_rules(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Quality verdicts for every row of docs; see judge()."""
    return judge(materialize(measure(docs, keep), "counts"), keep)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check_rules(table(spark, sf_dir, "documents"), ["doc_id"])


def _sql(source: str = "documents", tail: str | None = None) -> str:
    """The same in DuckDB SQL over `source`; `tail` ends the statement, by default the query's own columns."""
    white = r"[\x20\x09-\x0D]"
    lists = ", ".join(f"len(list_filter(words, lambda w: w IN ({', '.join(repr(w) for w in g)})))" for g in COMMON)
    count = lambda pattern: f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"
    sums = lambda c, n: "[" + ", ".join(f"sum({c}[{i}])::DOUBLE" for i in range(1, n + 1)) + "]"
    share = lambda c: f"list_transform({c}, lambda x: CASE WHEN list_sum({c}) > 0 THEN x / list_sum({c})::DOUBLE ELSE 0 END)"
    term = "(CASE WHEN z[1] > 0 THEN z[1] * log2(z[1] / ((z[1] + z[2]) / 2)) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(z[2] / ((z[1] + z[2]) / 2)) ELSE 0 END) / 2"
    js = lambda p, q: f"sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda z: {term})), 0))"
    k = len(COMMON) + 1
    tail = tail or "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance FROM judged"
    return rf"""
WITH q_docs AS (SELECT row_number() OVER () AS rid, *, coalesce(text, '') AS t FROM {source}),
q_words AS (SELECT *, list_filter(regexp_split_to_array(t, '{white}+'), lambda w: w <> '') AS words,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM q_docs),
q_each AS (SELECT rid, generate_subscripts(words, 1) AS i, unnest(words) AS w FROM q_words),
q_three AS (SELECT rid, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM q_each WINDOW o AS (PARTITION BY rid ORDER BY i)),
q_hit AS (SELECT rid, i, w2 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w1, w2) > 1 AS hit FROM q_three),
q_cover AS (SELECT rid, hit OR coalesce(lag(hit, 1) OVER o, false) OR coalesce(lag(hit, 2) OVER o, false) AS c FROM q_hit WINDOW o AS (PARTITION BY rid ORDER BY i)),
q_repeat AS (SELECT rid, count(*) FILTER (WHERE c) AS n FROM q_cover GROUP BY rid),
q_counts AS (SELECT q_words.* EXCLUDE (lines), len(words)::BIGINT AS n_words, (length(t) - ({count(white)}))::BIGINT AS word_chars,
  ({count('[#*$%&|<>]')})::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  {count('[A-Z]')} AS up, {count('[0-9]')} AS dg, {count(r"[.,;:!?''" + chr(34) + r"()\-]")} AS mk, {count(r'[^\x00-\x7F]')} AS hi, [{lists}] AS cmn
  FROM q_words LEFT JOIN q_repeat USING (rid)),
q_hist AS (SELECT * EXCLUDE (t, words, up, dg, mk, hi, cmn), [up, dg, mk, hi, n_symbols, word_chars - up - dg - mk - hi - n_symbols] AS ch,
  list_append(cmn, greatest(n_words - list_sum(cmn), 0)::BIGINT) AS co FROM q_counts),
q_refs AS (SELECT lang AS ref_lang, {sums('ch', 6)} AS rc, {sums('co', k)} AS ro FROM q_hist WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= {LEAST_DOCUMENTS}),
q_any AS (SELECT {sums('ch', 6)} AS ac, {sums('co', k)} AS ao FROM q_hist),
q_far AS (SELECT q_hist.*, {share('ch')} AS p, {share('coalesce(rc, ac)')} AS q, {share('co')} AS pw, {share('coalesce(ro, ao)')} AS qw, {share('ac')} AS qa, {share('ao')} AS qo
  FROM q_hist LEFT JOIN q_refs ON lang = ref_lang CROSS JOIN q_any),
q_dist AS (SELECT * EXCLUDE (p, q, pw, qw, qa, qo, ch, co), n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  CASE WHEN n_words >= {LEAST_WORDS} AND word_chars >= {LEAST_CHARS} THEN round(least({js('p', 'q')}, {js('p', 'qa')}), 4) END AS char_distance,
  CASE WHEN n_words >= {LEAST_WORDS} AND word_chars >= {LEAST_CHARS} THEN round(least({js('pw', 'qw')}, {js('pw', 'qo')}), 4) END AS word_distance FROM q_far),
judged AS (SELECT *, NOT base_failed AND NOT coalesce(char_distance > {MOST_CHAR_DISTANCE} OR word_distance > {MOST_WORD_DISTANCE}, false) AS kept FROM q_dist)
{tail}"""


ORACLE_SQL = _sql()
