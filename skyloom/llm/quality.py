"""Quality rules by distribution divergence, in DataFrame operations only.

Base rules count words, symbols, repeated lines and repeated 5-word windows of the whole text. Documents that
pass them are compared with their language: the histogram of their character classes and that of the language's
common words are held against those of all the language's documents by the Jensen-Shannon distance (base 2,
0 to 1). Texts below a least length are too small a sample and pass.

Defined results: a null text has no words. A document whose language is null, empty or has too few words in the whole
corpus to tell is compared by its characters with all documents together, and not by common words, which differ
from language to language. Repeated rows each count. Windows are compared by
64-bit hashes of their words, within one document. A null id is a row like any other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# Fixed values of the contract: what parts words, symbols, and the two base rules.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]+"
LEAST_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Common words of a language: its most frequent ones of at most this many characters, as they stand between white space.
COMMON_WORDS, COMMON_LETTERS = 24, 5
#: Least words for the comparison of characters and of common words; greatest distances that pass.
CHAR_GUARD, WORD_GUARD = 30, 100
CHAR_DISTANCE, WORD_DISTANCE = 0.35, 0.4
#: A language needs this many words in the corpus for a reference of its own.
REFERENCE_WORDS = 2_000
#: Name of the reference of all documents together.
EVERY = ""
#: Character classes by their patterns. Lower-case and other letters, symbols, white space and the rest follow from counts.
LETTERS, UPPER, DIGITS, STOPS = r"[\p{IsAlphabetic}]+", r"[\p{Lu}\p{Lt}]+", r"[0-9]+", r"[.,;:!?'\"()-]+"


def _windows(h: Column) -> Column:
    """The hashes of all 5-word windows of an array of word hashes."""
    return F.transform(F.slice(h, 1, F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, WINDOW))))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once: an expression named in a lambda would be worked out for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _covered(windows: Column) -> Column:
    """Places in order of windows that occur twice or more. Equal windows stand side by side once sorted."""
    def repeated(ordered):
        same = lambda k: F.coalesce(F.get(ordered, k)["h"], F.lit(None))
        marked = F.transform(ordered, lambda x, k: F.when((same(k + 1) == x["h"]) | ((k > 0) & (same(F.greatest(k - 1, F.lit(0))) == x["h"])), x["i"]))
        return F.sort_array(F.array_compact(marked))

    return _bound(F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), repeated)


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The contract's counts, with ``_text``, ``_words`` and the words joined as ``_joined`` still there."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"), *keep)
    out = out.withColumn("_words", F.array_remove(F.split("_text", SPACE), "")).withColumn("_joined", F.array_join("_words", ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines).withColumn("_w", _bound(F.transform("_words", lambda w: F.xxhash64(w)), _windows))
    # Few documents repeat a window; only those are sorted.
    out = out.withColumn("_at", F.when(F.size(F.array_distinct("_w")) < F.size("_w"), _covered(F.col("_w"))).otherwise(F.array().cast("array<int>")))
    runs = F.transform("_at", lambda a, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_at", k + 1) - a, F.lit(WINDOW))))
    counted = {
        "n_words": F.size("_words"), "word_chars": F.length("_joined"),
        "n_symbols": F.length("_text") - F.length(F.regexp_replace("_text", SYMBOLS, "")),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")), "n_repeat_words": F.aggregate(runs, F.lit(0), lambda a, b: a + b),
    }
    out = out.select("doc_id", "_text", "_words", "_joined", *keep, *(c.cast("long").alias(k) for k, c in counted.items()))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def class_counts() -> Column:
    """Characters by class: upper-case and other letters, digits, stops, symbols, others, white space."""
    left = lambda pattern: F.length("_joined") - F.length(F.regexp_replace("_joined", pattern, ""))
    counts = F.struct(left(LETTERS).alias("a"), left(UPPER).alias("u"), left(DIGITS).alias("d"), left(STOPS).alias("s"), F.col("n_symbols").cast("int").alias("y"), F.length("_joined").alias("n"), F.length("_text").alias("t"))
    return _bound(counts, lambda c: F.array(c["u"], c["a"] - c["u"], c["d"], c["s"], c["y"], F.greatest(F.lit(0), c["n"] - c["a"] - c["d"] - c["s"] - c["y"]), c["t"] - c["n"]))


def common_words(docs: DataFrame, lang: str = "_lang", text: str = "_text") -> dict[str, list[str]]:
    """Each language's most frequent short words, counted over whole texts."""
    short = docs.where(F.col(lang) != EVERY).select(F.col(lang).alias("lang"), F.explode(F.filter(F.split(F.col(text), SPACE), lambda w: (F.length(w) <= COMMON_LETTERS) & (w != ""))).alias("word"))
    counts = short.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    first = counts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("k") <= COMMON_WORDS)
    out: dict[str, list[str]] = {}
    for r in first.orderBy("lang", "k").collect():
        out.setdefault(r.lang, []).append(r.word)
    return out


def _distance(counts: Column, ref: Column) -> Column:
    """Jensen-Shannon distance of counts to a reference's shares."""
    def part(p, q):
        m = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)

    def distance(total):
        summed = F.aggregate(F.zip_with(counts, ref, lambda c, q: part(c / total, q)), F.lit(0).cast("double"), lambda a, b: a + b)
        return F.when(total > 0, F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), summed / 2)))).otherwise(0.0)

    return _bound(F.aggregate(counts, F.lit(0).cast("double"), lambda a, b: a + b), distance)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Counts of each document and its two histograms, written once: what follows reads no text again."""
    named = docs.withColumn("_lang", F.coalesce(F.col(lang_col).cast("string"), F.lit(EVERY)))
    words = common_words(named, text=text_col)
    listed = sorted({w for ws in words.values() for w in ws})
    spark = docs.sparkSession
    # A row for each language: as many as there are languages.
    lists = spark.createDataFrame(sorted(words.items()) or [(EVERY, [])], "_lang string, _common array<string>")
    out = base_counts(named, id_col, text_col, ("_lang",)).join(F.broadcast(lists), "_lang", "left").withColumn("_common", F.coalesce("_common", F.array().cast("array<string>")))
    out = out.withColumn("_hits", F.concat(F.lit(" "), F.array_join(F.filter("_words", lambda w: w.isin(listed)), "  "), F.lit(" ")))
    hits = F.transform("_common", lambda w: F.expr("0") + F.try_divide(F.octet_length("_hits") - F.octet_length(F.replace(F.col("_hits"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit(""))), F.octet_length(w) + 2))
    out = out.withColumn("words", F.transform(hits, lambda x: x.cast("double")))
    out = out.withColumn("words", F.concat("words", F.array(F.col("n_words") - F.aggregate("words", F.lit(0.0), lambda a, b: a + b))))
    keep = ["doc_id", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "words"]
    return stored(out.select(*keep, F.transform(class_counts(), lambda x: x.cast("double")).alias("chars")), "quality")


def references(counted: DataFrame) -> DataFrame:
    """For each language the shares of its classes and common words over all its documents."""
    def shares(name):
        long = counted.select("_lang", F.posexplode(name).alias("k", "n")).groupBy("_lang", "k").agg(F.sum("n").alias("n"))
        return long.groupBy("_lang").agg(F.sum("n").alias(f"{name}_total"), F.transform(F.sort_array(F.collect_list(F.struct("k", "n"))), lambda x: x["n"]).alias(name))

    return shares("words").join(shares("chars"), "_lang")


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``doc_id``, the contract's counts, ``base_failed``, ``kept`` and the two distances."""
    counted = features(docs, id_col, text_col, lang_col)
    refs = {r["_lang"]: r for r in references(counted).collect()}  # a row a language
    # Characters add up over languages; the common words of all documents together are not those of a language.
    whole = [sum(x) for x in zip(*(r["chars"] for r in refs.values()), strict=True)]
    rows = []
    for lang, r in refs.items():
        own = lang != EVERY and r["words_total"] >= REFERENCE_WORDS
        chars = r["chars"] if own else whole
        rows.append((lang, [x / max(1.0, sum(chars)) for x in chars], [x / max(1.0, r["words_total"]) for x in r["words"]], own))
    table = docs.sparkSession.createDataFrame(rows or [(EVERY, [], [], False)], "_lang string, _rc array<double>, _rw array<double>, _own boolean")
    out = counted.join(F.broadcast(table), "_lang", "left").withColumns({
        "char_distance": F.when(F.col("n_words") >= CHAR_GUARD, _distance(F.col("chars"), F.col("_rc"))),
        "word_distance": F.when((F.col("n_words") >= WORD_GUARD) & F.col("_own"), _distance(F.col("words"), F.col("_rw"))),
    })
    passed = (F.coalesce("char_distance", F.lit(0.0)) <= CHAR_DISTANCE) & (F.coalesce("word_distance", F.lit(0.0)) <= WORD_DISTANCE)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & passed).alias("kept"), "char_distance", "word_distance")
