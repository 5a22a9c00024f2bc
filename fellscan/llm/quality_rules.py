"""Line-first cleaning: rules judge each line, failing lines go, documents that lose too much text go.

Only DataFrame functions. Every step works on the arrays of one row, so there is no shuffle at all and a hot source costs
nothing extra. A line fails when

* ``symbols``: it holds more than 0.3 characters of ``#*$%&|<>`` per word,
* ``navigation``: it has three or more words and a fifth of them or more are ``|``, ``>``, ``»`` or ``•`` alone,
* ``shouting``: three tenths of its words or more end in ``!!``, and it has three or more,
* ``punctuation``: it has under 12 words and none of ``.!?:;…`` in it,
* ``boilerplate``: it has up to 30 words and one of the notices in BOILERPLATE.

A document is rejected when the lines that stay hold less than half of its word characters, or by the base rules.

Null text counts as empty: no words, so base_failed. Lines are what ``\\n`` separates; a line without a word neither
fails nor counts. Repeated rows give repeated results, an empty table an empty result; columns beside doc_id and text are
not read (``clean_documents`` keeps them as they are).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
BOILERPLATE = r"(?i)all rights reserved|privacy policy|terms of (use|service)|cookie|javascript|subscribe to|click here|licensed under|released under the|powered by"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MAX_SYMBOLS_PER_WORD, NAVIGATION_SHARE, SHOUTING_SHARE, SHORT_LINE, NOTICE_WORDS, MIN_KEPT_SHARE = 0.3, 0.2, 0.3, 12, 30, 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def line_failures(words: Column, line: Column) -> Column:
    """Name of the first rule a line fails, null if it passes or has no word. Cheap searches stand before counts."""
    n = F.size(words)
    share = lambda test: F.size(F.filter(words, test))
    holds = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(line, m))
    symbols = F.char_length(F.regexp_replace(line, r"[^#*$%&|<>]+", ""))
    return (
        F.when(n == 0, F.lit(None).cast("string"))
        .when(holds("#*$%&|<>") & (symbols > MAX_SYMBOLS_PER_WORD * n), "symbols")
        .when((n >= 3) & holds("|>»•") & (share(lambda w: w.isin("|", ">", "»", "•")) >= NAVIGATION_SHARE * n), "navigation")
        .when((n >= 3) & F.contains(line, F.lit("!!")) & (share(lambda w: w.endswith("!!")) >= SHOUTING_SHARE * n), "shouting")
        .when((n < SHORT_LINE) & ~line.rlike(r"[.!?:;…]"), "punctuation")
        .when((n <= NOTICE_WORDS) & line.rlike(BOILERPLATE), "boilerplate")
    )


def _let(value: Column, body) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _beside_equal(sorted_values: Column, key) -> Column:
    """Those elements of a sorted array that have the key of a neighbour."""
    same = lambda j, x: F.coalesce(key(F.get(sorted_values, j)) == key(x), F.lit(False))
    return F.filter(sorted_values, lambda x, j: same(j - 1, x) | same(j + 1, x))


def repeated_words(words: Column) -> Column:
    """How many words lie in 3-word windows that occur twice or more.

    Windows with all different hashes are all different, which settles most documents. In the others, sorting numbers
    made of 44 bits of hash and the place finds the windows that may have an equal one (all windows, where a text has
    more than 2^20); only those are sorted as strings, and equal neighbours are the answer. A sum over the places then
    adds what each window covers beyond the one before.
    """
    n = F.size(words)
    starts = F.sequence(F.lit(0), n - 3)
    hash_at = lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    packed = F.sort_array(F.transform(starts, lambda i: F.shiftleft(hash_at(i), 20).bitwiseOR(i.cast("long"))))
    maybe = _let(packed, lambda a: F.transform(_beside_equal(a, lambda x: F.shiftright(x, 20)), lambda x: x.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")))
    candidates = F.when(n > 1 << 20, starts).otherwise(maybe)
    windows = F.array_sort(F.transform(candidates, lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i"))))
    places = _let(windows, lambda a: F.sort_array(F.transform(_beside_equal(a, lambda x: x["w"]), lambda x: x["i"])))
    covered = _let(places, lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(3), x - F.coalesce(F.get(p, j - 1), F.lit(-3)))), F.lit(0), lambda a, x: a + x))
    all_differ = F.size(F.array_distinct(F.transform(starts, hash_at))) == n - 2
    return F.when(n < 4, 0).when(all_differ, 0).otherwise(covered).cast("long")


def _measured(docs: DataFrame, cleaned: bool) -> DataFrame:
    parts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    lines = F.transform(F.split("t", "\n"), lambda line: F.struct(line.alias("line"), words_of(line).alias("words")))
    parts = parts.select("doc_id", "t", lines.alias("all_lines"))
    parts = parts.select("doc_id", "t", "all_lines", F.filter("all_lines", lambda x: F.size(x["words"]) > 0).alias("lines"), F.flatten(F.col("all_lines")["words"]).alias("words"))
    judged = parts.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct(F.col("lines")["line"]))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.transform("all_lines", lambda x: F.struct(x["line"].alias("line"), F.char_length(F.array_join(x["words"], "")).alias("chars"), line_failures(x["words"], x["line"]).alias("rule"))).alias("verdicts"),
    )
    stays = F.filter("verdicts", lambda v: v["rule"].isNull())
    out = judged.withColumn("kept_chars", F.aggregate(stays, F.lit(0).cast("long"), lambda a, v: a + v["chars"]))
    out = out.withColumn("n_failed_lines", F.size(F.filter("verdicts", lambda v: v["rule"].isNotNull())).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("kept_chars") >= MIN_KEPT_SHARE * F.col("word_chars")))
    if cleaned:
        out = out.withColumn("cleaned", F.array_join(F.transform(stays, lambda v: v["line"]), "\n"))
    # generated rows are worked out once: a caller's filter on them is not rewritten into the expressions above
    out = out.drop("verdicts")
    return out.select(F.explode(F.array(F.struct(*out.columns))).alias("row")).select("row.*")


def measure(docs: DataFrame) -> DataFrame:
    """One row per document: the base measures, what the line rules found, and the verdict."""
    return _measured(docs, cleaned=False)


def clean_documents(docs: DataFrame) -> DataFrame:
    """Documents that pass, with their columns, failing lines removed from ``text``.

    The verdict is computed beside each row, not joined back, so repeated ids and clashing column names do no harm.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    carried = docs.select(F.struct(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)]).alias("doc_id"), "text")
    kept = _measured(carried, cleaned=True).where("kept")
    return kept.select(*[(F.col("cleaned") if c == "text" else F.col("doc_id")[n]).alias(c) for c, n in zip(docs.columns, names)])
