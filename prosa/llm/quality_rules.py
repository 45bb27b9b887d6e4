"""Quality rules and distribution divergence. Built-in functions only, one pass and one small aggregate.

A document's histogram of character classes and that of its language's common words are compared with
the mean histograms of all documents of that language by Jensen-Shannon distance (base 2, 0 to 1).
Languages outside ``COMMON`` share one reference, so the references are at most ``len(COMMON) + 1``
rows. Below ``MIN_WORDS`` words a text is too short for either distance, below ``MIN_COMMON`` for that of words.

Nulls and edges: a null text counts as empty; a null language is an unknown one. Very long texts are handled
whole. Repeated rows each get a row. Extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosa.llm.common import GAP, settle, words_of

#: Frequent function words, fixed values.
COMMON = {
    "en": ("the", "of", "and", "to", "a", "in", "is", "that", "it", "for"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "que"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del"),
}
#: Character classes, disjoint, each counted in what the ones before it have left: white space second, symbols sixth.
CLASSES = (r"[a-z]+", GAP, r"[A-Z]+", r"[0-9]+", r"[.,;:!?'\"()-]+", r"[#*$%&|<>]+", r"[^\x00-\x7F]+")
N_WORDS = len(COMMON["en"])
MIN_WORDS = 50
#: Largest distances of an ordinary document, and the words from which the word distance counts.
MAX_CHAR, MAX_WORD, MIN_COMMON = 0.32, 0.28, 150
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once per row, also inside functions over arrays."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the array.

    Without two equal window hashes there is no repeat. Otherwise the windows that can repeat (all, where
    many hashes do) are sorted as text with their place behind a tab, which no word holds; equal ones are neighbours.
    """
    places = F.sequence(F.lit(0), F.size(words) - 3)
    hashes = F.transform(places, lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def of_sorted(s: Column) -> Column:
        pairs = F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(
            F.substring_index(a, "\t", 1) == F.substring_index(b, "\t", 1),
            F.array(F.substring_index(a, "\t", -1).cast("int"), F.substring_index(b, "\t", -1).cast("int"))))
        starts = F.array_distinct(F.flatten(F.filter(pairs, lambda p: p.isNotNull())))
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    def tagged(i: Column) -> Column:
        return F.concat(F.get(words, i), F.lit(" "), F.get(words, i + 1), F.lit(" "), F.get(words, i + 2), F.lit("\t"), i.cast("string"))

    def compare(h: Column) -> Column:
        twice = let(F.sort_array(h), lambda s: F.array_distinct(F.array_compact(
            F.zip_with(s, F.slice(s, F.lit(2), F.size(s)), lambda a, b: F.when(a == b, a)))))
        some = let(twice, lambda t: F.filter(places, lambda i: (F.size(t) > 64) | F.array_contains(t, F.get(h, i))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(some, tagged)), of_sorted))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(hashes, compare)).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, the base counts, ``chars`` and ``common``: counts by class and by common word."""
    text = F.coalesce(F.col("text"), F.lit(""))
    known = F.when(F.col("lang").isin(*COMMON), F.col("lang")).otherwise("")
    lists = reduce(lambda rest, kind: F.when(F.col("lang") == kind, F.array(*map(F.lit, COMMON[kind]))).otherwise(rest),
                   COMMON, F.array(*[F.lit("\n") for _ in range(N_WORDS)]))
    rows = docs.select("doc_id", known.alias("lang"), text.alias("text")).withColumn("words", words_of(F.col("text")))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def left(s: Column, rest) -> Column:
        """Array of the length of ``s`` after each class has been taken away."""
        if not rest:
            return F.array(F.length(s))
        return F.concat(F.array(F.length(s)), let(F.regexp_replace(s, rest[0], ""), lambda x: left(x, rest[1:])))

    def hits(own: Column) -> Column:
        found = F.filter("words", lambda x: F.array_contains(own, x))
        return let(found, lambda f: F.transform(own, lambda w: F.size(F.filter(f, lambda x: x == w))))

    return rows.select(
        "doc_id", "lang", F.size("words").cast("long").alias("n_words"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        left(F.col("text"), CLASSES).alias("left"), let(lists, hits).alias("common"))


def shares(rows: DataFrame) -> DataFrame:
    """Replace the counts by shares: ``p_char`` of 8 classes, ``p_word`` of the common words and the rest."""
    n = len(CLASSES)
    length = F.greatest(F.get("left", F.lit(0)), F.lit(1)).cast("double")
    chars = [(F.get("left", F.lit(i)) - F.get("left", F.lit(i + 1))) / length for i in range(n)] + [F.get("left", F.lit(n)) / length]
    total = F.greatest("n_words", F.lit(1)).cast("double")
    words = [F.get("common", F.lit(i)) / total for i in range(N_WORDS)]
    rest = (F.col("n_words") - reduce(lambda a, b: a + b, [F.get("common", F.lit(i)) for i in range(N_WORDS)])) / total
    blanks, symbols = [F.get("left", F.lit(i)) - F.get("left", F.lit(i + 1)) for i in (1, 5)]
    rows = rows.withColumns({"word_chars": (F.get("left", F.lit(0)) - blanks).cast("long"), "n_symbols": symbols.cast("long")})
    return rows.select("doc_id", "lang", *BASE, F.array(*chars).alias("p_char"), F.array(*words, rest).alias("p_word"))


def divergence(p: Column, q: Column, n: int) -> Column:
    """Jensen-Shannon distance, base 2."""
    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(a * 2.0 / (a + b))).otherwise(0.0)

    terms = [part(F.get(p, F.lit(i)), F.get(q, F.lit(i))) + part(F.get(q, F.lit(i)), F.get(p, F.lit(i))) for i in range(n)]
    return F.sqrt(F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, terms) / 2.0))


def quality_rules(docs: DataFrame, max_char: float = MAX_CHAR, max_word: float = MAX_WORD) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, char_distance and word_distance of every document."""
    rows = settle(shares(measures(docs)))
    nc, nw = len(CLASSES) + 1, N_WORDS + 1
    mean = rows.where(F.col("n_words") >= MIN_WORDS).groupBy("lang").agg(
        *[F.avg(F.get("p_char", F.lit(i))).alias(f"c{i}") for i in range(nc)],
        *[F.avg(F.get("p_word", F.lit(i))).alias(f"w{i}") for i in range(nw)])
    reference = mean.agg(F.map_from_entries(F.collect_list(F.struct(
        "lang", F.struct(F.array(*[f"c{i}" for i in range(nc)]).alias("c"), F.array(*[f"w{i}" for i in range(nw)]).alias("w"))))).alias("m"))
    judged = rows.withColumn("r", F.element_at(reference.scalar(), F.col("lang")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    long_enough = F.col("n_words") >= MIN_WORDS
    judged = judged.withColumn("char_distance", F.when(long_enough, divergence(F.col("p_char"), F.col("r.c"), nc)))
    judged = judged.withColumn("word_distance", F.when(F.col("n_words") >= MIN_COMMON, divergence(F.col("p_word"), F.col("r.w"), nw)))
    fits = F.coalesce(F.col("char_distance") <= max_char, F.lit(True)) & F.coalesce(F.col("word_distance") <= max_word, F.lit(True))
    return judged.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & fits).alias("kept"), "char_distance", "word_distance")


def sql() -> str:
    """The same in SQL, for the engine the query is checked with."""
    def text(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    nc, nw = len(CLASSES) + 1, N_WORDS + 1
    left, stages = "text", ["length(text)"]
    for c in CLASSES:
        left = f"regexp_replace({left}, {text(c)}, '', 'g')"
        stages.append(f"length({left})")
    common = []
    for i in range(N_WORDS):
        word = "CASE lang " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in COMMON.items()) + " ELSE chr(10) END"
        common.append(f"len(list_filter(words, lambda x: x = {word}))")
    chars = [f"(l[{i + 1}] - l[{i + 2}])::DOUBLE / greatest(l[1], 1)" for i in range(nc - 1)] + [f"l[{nc}]::DOUBLE / greatest(l[1], 1)"]
    shares_ = [f"c[{i + 1}]::DOUBLE / greatest(n_words, 1)" for i in range(N_WORDS)] + ["(n_words - list_sum(c))::DOUBLE / greatest(n_words, 1)"]

    def distance(p: str, q: str, n: int) -> str:
        def part(a, b):
            return f"CASE WHEN {a} > 0 THEN {a} * log2({a} * 2.0 / ({a} + {b})) ELSE 0.0 END"
        return "sqrt(greatest(0.0, (" + " + ".join(
            f"{part(f'{p}[{i}]', f'{q}{i}')} + {part(f'{q}{i}', f'{p}[{i}]')}" for i in range(1, n + 1)) + ") / 2.0))"

    means = ", ".join([f"avg(pc[{i}]) AS c{i}" for i in range(1, nc + 1)] + [f"avg(pw[{i}]) AS w{i}" for i in range(1, nw + 1)])
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, CASE WHEN lang IN ({', '.join(map(text, COMMON))}) THEN lang ELSE '' END AS lang,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
p AS (SELECT rid, count(DISTINCT i + o)::BIGINT AS n FROM (SELECT g.rid, i, unnest([0, 1, 2]) AS o FROM g
    JOIN (SELECT rid, g FROM g GROUP BY rid, g HAVING count(*) > 1) r ON g.rid = r.rid AND g.g = r.g) GROUP BY rid),
m AS (SELECT d.rid, doc_id, lang, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words, [{', '.join(stages)}] AS l, [{', '.join(common)}] AS c FROM d LEFT JOIN p ON d.rid = p.rid),
s AS (SELECT *, [{', '.join(chars)}] AS pc, [{', '.join(shares_)}] AS pw FROM m),
r AS (SELECT lang, {means} FROM s WHERE n_words >= {MIN_WORDS} GROUP BY lang),
j AS (SELECT s.*, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words >= {MIN_WORDS} THEN {distance('pc', 'c_', nc)} END AS dc, CASE WHEN n_words >= {MIN_COMMON} THEN {distance('pw', 'w_', nw)} END AS dw
  FROM s LEFT JOIN (SELECT lang AS rl, {', '.join([f'c{i} AS c_{i}' for i in range(1, nc + 1)] + [f'w{i} AS w_{i}' for i in range(1, nw + 1)])} FROM r) ON lang = rl)
SELECT doc_id, {', '.join(BASE)}, base_failed, NOT base_failed AND coalesce(dc <= {MAX_CHAR}, true) AND coalesce(dw <= {MAX_WORD}, true) AS kept FROM j
"""
