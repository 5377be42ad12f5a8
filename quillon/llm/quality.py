"""Quality rules, native: clean line by line, then reject documents that are bad as a whole or lost too much text.

Everything is DataFrame expressions in the document's own row: no shuffle and no Python, whatever the input's size.

A line (split at \\n, holding a word) fails by the first of these that holds:
  navigation   at least 3 of its words are bare separators (| > · » / - •) and they are at least a fifth of its words;
  symbols      `[#*$%&|<>]` are at least a tenth of its word characters;
  shouting     at least 3 words end in !! or more, and those are at least half of its words;
  boilerplate  its lower-cased text is a known notice in one of four languages (BOILERPLATE), at whatever place;
  repetition   it has at least 10 words, of which fewer than a fifth are distinct;
  punctuation  it has at least 10 words and not one of the marks of its script (MARKS). A mark at the line's end is not asked for: prose that
               is wrapped has few.
A document is rejected if it has under 20 words, if more than 30 % of its words stand in repeated 8-word windows (these two:
base_failed), or if its failed lines hold more than half of its word characters.

Cases: a null or empty text has no words, all counts 0, base_failed, not kept. Long texts are handled whole. Repeated rows are
judged alike, each on its own. Other columns, null ids and clashing names do not matter: the rules read one text column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import SPACE, table, words

#: Fixed notices that carry no content, as patterns on a lower-cased line: English, German, French, Spanish.
_NOTICES = (
    r"all rights reserved|privacy policy|terms of (use|service)|cookie (policy|settings)|accept (all )?cookies|skip to (main )?content|subscribe to our newsletter|back to top|share this( page| article)?",
    r"alle rechte vorbehalten|datenschutz(erklärung|bestimmungen|richtlinie)?|impressum|nutzungsbedingungen|cookie-(richtlinie|einstellungen)|(alle )?cookies akzeptieren|zum (haupt)?inhalt springen|(unseren )?newsletter abonnieren|nach oben|(diese )?seite teilen",
    r"tous droits réservés|politique de confidentialité|conditions (générales )?d\W?utilisation|mentions légales|(politique de|gérer les) cookies|accepter (tous )?les cookies|aller au contenu( principal)?|(abonnez|inscrivez)-vous à notre (newsletter|lettre d\W?information)|(retour en )?haut de page|partager cet(te)? (page|article)",
    r"todos los derechos reservados|política de (privacidad|cookies)|(términos|condiciones) de uso|aviso legal|aceptar (todas las )?cookies|(ir|saltar) al contenido( principal)?|suscríbete a nuestro boletín|volver arriba|compartir (esta página|este artículo)",
)
BOILERPLATE = r"^\W*(" + "|".join(_NOTICES) + r")\W*$"
#: Marks within or at the end of sentences, by script: Latin, East Asian, Arabic, Indic, Armenian, Ethiopic.
MARKS = "[.!?:;,…。！？：；，、؟؛،۔।॥։՝።፣፤]"
SYMBOLS = r"[#*$%&|<>]"
WORD = r"[^\x20\x09-\x0D]"
#: Shortest line to which the repetition and punctuation rules apply, in words.
LONG_LINE = 10
#: Share of word characters that may go with failed lines, in per cent.
MOST_LOST = 50


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def joined_length(parts: Column) -> Column:
    return F.length(F.array_join(parts, ""))


def line_fails(line: Column) -> Column:
    """Whether a line that has a word fails."""

    def rules(w: Column) -> Column:
        n = F.size(w)
        bars = F.size(F.filter(w, lambda x: x.isin("|", ">", "·", "»", "/", "-", "•")))
        shouts = F.size(F.filter(w, lambda x: x.endswith("!!")))
        chars = joined_length(w)
        symbols = F.length(line) - F.length(F.regexp_replace(line, SYMBOLS, ""))
        return (
            ((bars >= 3) & (bars * 5 >= n))
            | (symbols * 10 >= chars)
            | ((shouts >= 3) & (shouts * 2 >= n))
            | ((n <= LONG_LINE) & F.lower(line).rlike(BOILERPLATE))
            | ((n >= LONG_LINE) & (F.size(F.array_distinct(w)) * 5 < n))
            | ((n >= LONG_LINE) & ~line.rlike(MARKS))
        )

    return let(words(line), rules)


def text_lines(text: Column) -> Column:
    """The lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))


def repeated_words(w: Column, size: int = 8) -> Column:
    """How many words stand in windows of `size` words that the array holds twice or more."""
    n = F.size(w)
    starts = F.sequence(F.lit(1), n - (size - 1))
    # Equal windows have equal hashes, so that without a repeated hash nothing repeats; else the windows themselves decide.
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size)))
    no_repeat = let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, size), " ").alias("k"), i.alias("i"))))

    def covered(s: Column) -> Column:
        m = F.size(s)
        key = lambda j: F.element_at(s, j)["k"]
        at = F.filter(
            F.transform(
                F.sequence(F.lit(1), m),
                lambda j: F.when(((j > 1) & (key(F.greatest(j - 1, F.lit(1))) == key(j))) | ((j < m) & (key(F.least(j + 1, m)) == key(j))), F.element_at(s, j)["i"]).otherwise(F.lit(0)),
            ),
            lambda i: i > 0,
        )
        # In order of place, each window adds what the one before it has not covered.
        return let(
            F.sort_array(at),
            lambda p: F.aggregate(
                p,
                F.struct(F.lit(0).alias("total"), F.lit(-size).alias("last")),
                lambda a, i: F.struct((a["total"] + F.least(F.lit(size), i - a["last"])).alias("total"), i.alias("last")),
                lambda a: a["total"],
            ),
        )

    return F.when(n <= size, F.lit(0)).when(no_repeat, F.lit(0)).otherwise(let(windows, covered))


def _judged(text: Column, fields) -> Column:
    """fields(words, lines with a word, words in repeated windows, base_failed) of a text, each computed once."""

    def by_words(w: Column) -> Column:
        def by_lines(lines: Column) -> Column:
            return let(repeated_words(w), lambda r: fields(w, lines, r, (F.size(w) < 20) | (r * 100 > F.size(w) * 30)))

        return let(text_lines(text), by_lines)

    return let(words(text), by_words)


def _enough(good: Column, w: Column) -> Column:
    """Whether the good lines hold enough of the text's word characters."""
    return joined_length(F.flatten(F.transform(good, words))) * 100 >= joined_length(w) * (100 - MOST_LOST)


def quality_columns(text: Column) -> Column:
    """Struct of the base measures and the verdict."""

    def fields(w: Column, lines: Column, repeated: Column, base_failed: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            joined_length(w).cast("long").alias("word_chars"),
            F.coalesce(F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")), F.lit(0)).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated.cast("long").alias("n_repeat_words"),
            base_failed.alias("base_failed"),
            F.when(base_failed, F.lit(False)).otherwise(let(F.filter(lines, lambda x: ~line_fails(x)), lambda g: _enough(g, w))).alias("kept"),
        )

    return _judged(text, fields)


def measure(docs: DataFrame, text: str = "text", into: str = "quality") -> DataFrame:
    """Adds the struct column `into`: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept. A column of that name is replaced."""
    return docs.withColumn(into, quality_columns(F.col(text)))


def cleaned(text: Column) -> Column:
    """The text without its failed lines, or null if it is rejected; lines without a word stay. Each line is judged once."""

    def fields(w: Column, lines: Column, repeated: Column, base_failed: Column) -> Column:
        judged = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), F.when(~x.rlike(WORD), 0).when(line_fails(x), 2).otherwise(1).alias("is")))
        pick = lambda j, test: F.transform(F.filter(j, lambda x: test(x["is"])), lambda x: x["line"])
        left = lambda j: F.when(_enough(pick(j, lambda k: k == 1), w), F.array_join(pick(j, lambda k: k < 2), "\n"))
        return F.when(base_failed, F.lit(None)).otherwise(let(judged, left))

    return _judged(text, fields)


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with failed lines removed from their text; same columns.

    The cleaned text is exploded from an array of one or none: a filter on it would compute it again.
    """
    own = docs.select(F.struct("*").alias("row"), F.explode(F.filter(F.array(cleaned(F.col("text"))), lambda x: x.isNotNull())).alias("text"))
    of = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return own.select(*[of.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return measure(docs).select("doc_id", "quality.*")


ORACLE_SQL = {
    "op9_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT rid, i, array_to_string(list_slice(w, i, i + 7), ' ') AS k
        FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, gap)) AS r FROM (SELECT rid, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -100) AS gap FROM twice) GROUP BY rid),
ln AS (SELECT rid, j, line, list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
       FROM (SELECT rid, unnest(lines) AS line, unnest(range(len(lines))) AS j FROM w)),
judged AS (SELECT rid, len(array_to_string(lw, '')) AS chars,
       (len(list_filter(lw, lambda x: x IN ('|', '>', '·', '»', '/', '-', '•'))) >= 3 AND len(list_filter(lw, lambda x: x IN ('|', '>', '·', '»', '/', '-', '•'))) * 5 >= len(lw))
    OR len(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) * 10 >= len(array_to_string(lw, ''))
    OR (len(list_filter(lw, lambda x: x LIKE '%!!')) >= 3 AND len(list_filter(lw, lambda x: x LIKE '%!!')) * 2 >= len(lw))
    OR (len(lw) <= 10 AND regexp_matches(lower(line), '@BOILERPLATE'))
    OR (len(lw) >= 10 AND len(list_distinct(lw)) * 5 < len(lw))
    OR (len(lw) >= 10 AND NOT regexp_matches(line, '@MARKS')) AS fails FROM ln),
good AS (SELECT rid, sum(chars) AS chars FROM judged WHERE NOT fails GROUP BY rid),
m AS (SELECT doc_id, len(w) AS n_words, len(array_to_string(w, '')) AS word_chars, len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r, 0)::BIGINT AS n_repeat_words, coalesce(good.chars, 0) AS good
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN good USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words,
       n_words < 20 OR n_repeat_words * 100 > n_words * 30 AS base_failed,
       NOT (n_words < 20 OR n_repeat_words * 100 > n_words * 30) AND good * 100 >= word_chars * 50 AS kept
FROM m
""".replace("@BOILERPLATE", BOILERPLATE).replace("@MARKS", MARKS)
}
