"""Text as column expressions: words, keyword tokens, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values. Words are runs of Latin letters and digits, runs of the Arabic blocks, and single CJK characters.
WORDS = "[A-Za-z0-9'’\\-]+|[؀-ۿݐ-ݿ]+|[一-鿿]"
#: Keyword tokens.
TOKEN = "[\\p{L}\\p{N}_؀-ۿ]+"
#: Fixed values of the spelling fold: from, to; the last three are deleted.
FOLD_FROM, FOLD_TO = "يىكۀ‌‏‎ـ", "ییکه "
DIACRITICS, PUNCTUATION = "[ً-ْٰ]", "[،؍؛؞؟٪-٭۔۝]"
NOT_ASCII = "[^\\x00-\\x7F]"
NOT_WORD = "[^\\p{L}\\p{N}_؀-ۿ]+"
#: Words that carry no intent.
STOPWORDS = ("و", "در", "به", "از", "با", "برای", "را", "که", "این", "آن", "است", "های", "ها", "the", "a", "an", "of", "for", "and", "in", "on", "to")
#: Keyword tokens that carry no topic.
TOKEN_STOPWORDS = (
    "و", "در", "به", "از", "که", "را", "با", "برای", "این", "آن", "است", "می", "یک", "تا", "بر", "هم", "یا", "چه", "های", "ها", "شده", "کرد", "کردن",
    "the", "a", "an", "of", "for", "to", "in", "on", "and", "or", "is", "are", "with", "how", "what", "why", "best", "vs",
)


def clean_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0))


def content_hash(text: Column) -> Column:
    return F.sha1(F.trim(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_]+", " ")))


def nfkc_casefold(text: Column) -> Column:
    """Compatibility composition and case folding by an Arrow UDF; Spark has neither built in."""

    @F.pandas_udf("string")
    def folded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import unicodedata

        for batch in batches:
            yield batch.map(lambda t: unicodedata.normalize("NFKC", t).casefold(), na_action="ignore")

    return folded(text)


def fold(text: Column) -> Column:
    """One spelling for each word: Arabic and Persian letters folded, no diacritics, punctuation and other signs as spaces."""
    folded = F.regexp_replace(F.regexp_replace(F.translate(text, FOLD_FROM, FOLD_TO), DIACRITICS, ""), PUNCTUATION, " ")
    return F.trim(F.regexp_replace(folded, NOT_WORD, " "))


def normalise(text: Column, compose: bool = False) -> Column:
    """Folded and in lower case; with ``compose`` also NFKC and casefold, by an Arrow UDF."""
    text = F.coalesce(text, F.lit(""))
    return fold(nfkc_casefold(text)) if compose else F.lower(fold(text))


def words(text: Column, compose: bool = False) -> Column:
    """Normalised words without stopwords, in order, repeats kept."""
    return F.filter(F.split(normalise(text, compose), " +"), _is_word)


def with_words(df: DataFrame, text: Column, name: str, distinct: bool = False, kept: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``kept``) with the normalised words of ``text`` (with ``distinct`` each once), NFKC and casefold applied, without a text going through Python.

    Words of ASCII need neither. Of all others each distinct spelling is folded once and joined back, in place. A table
    whose texts are ASCII has no such spellings, and nothing is shuffled but its few rows that have any.
    """
    plain = f"_{name}_plain"
    rows = df.withColumn(plain, F.split(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\u00A0\u2000-\u200A\u3000]+", " ")), " "))
    if distinct:
        rows = rows.withColumn(plain, F.array_distinct(plain))
    if kept is not None:
        rows = rows.select(*kept, plain)
    rows = rows.withColumn("_row", F.monotonically_increasing_id()).checkpoint()  # the number has to stay the same when rows are read again
    odd = F.exists(plain, lambda w: w.rlike(NOT_ASCII))
    native = rows.filter(~odd).withColumn(name, F.filter(F.flatten(F.transform(plain, lambda w: F.split(normalise(w), " +"))), _is_word)).drop(plain, "_row")
    spelled = rows.filter(odd).select("_row", F.posexplode(plain).alias("_at", "_raw"))
    folded = spelled.filter(F.col("_raw").rlike(NOT_ASCII)).select("_raw").distinct().withColumn("_words", F.split(normalise(F.col("_raw"), True), " +"))
    each = spelled.join(folded, "_raw", "left").select("_row", "_at", F.coalesce("_words", F.split(normalise(F.col("_raw")), " +")).alias("_words"))
    again = each.groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_words"))), lambda x: x["_words"]).alias("_all"))
    out = native.unionByName(rows.filter(odd).join(again, "_row").withColumn(name, F.filter(F.flatten("_all"), _is_word)).drop(plain, "_row", "_all"))
    return out.withColumn(name, F.array_distinct(name)) if distinct else out


def _is_word(word: Column) -> Column:
    return (word != "") & ~word.isin(*STOPWORDS)


def tokens_of(keyword: Column) -> Column:
    found = F.regexp_extract_all(F.lower(keyword), F.lit(TOKEN), F.lit(0))
    return F.filter(found, lambda t: ~t.isin(*TOKEN_STOPWORDS) & (F.length(t) > 1))


def word_count(keyword: Column) -> Column:
    return F.regexp_count(keyword, F.lit(TOKEN))


def number(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def uuid5(namespace: str, name: Column) -> Column:
    """A version 5 UUID of a name; ``namespace`` is a UUID."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
