"""The text profile: twenty features of a document as columns.

Character classes are counted by generated code in the JVM; what walks over tokens, words or lines comes from the counts of one Arrow function
each, and the compression ratio from another, all in one pass of the text to Python. Only what the named features need is computed.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gatehouse.functions import counts
from gatehouse.functions import lexicon as X


def share(part: Column, whole: Column) -> Column:
    """part / whole as double; 0 where whole is 0."""
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    return F.floor((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle))


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def strip(x: Column) -> Column:
    return F.regexp_replace(x, f"^{X.SPACE}+|{X.SPACE}+$", "")


def split(df: DataFrame, text: str = "text") -> DataFrame:
    """df with tokens, words and lines of a text column; null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({text: t, "tokens": F.regexp_extract_all(t, F.lit(X.TOKEN), F.lit(0)), "words": F.regexp_extract_all(F.lower(t), F.lit(X.WORD), F.lit(0)), "lines": F.split(t, "\n", -1)})


@F.pandas_udf(DoubleType())
def gzip_ratio(text: pd.Series) -> pd.Series:
    """Deflated bytes (level 6, without header and trailer) per UTF-8 byte; 0 for an empty text."""

    def one(t: str | None) -> float:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if not raw:
            return 0.0
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        return len(c.compress(raw) + c.flush()) / len(raw)

    return text.map(one)


#: The counts that a feature is made from: in the column _<name> once counted() has run.
COUNTED = {
    "words": ("token_length", "mean_word_length", "type_token_ratio", "bigram_repetition", "stopword_fraction", "symbol_word_ratio", "mojibake_fraction"),
    "pairs": ("top_ngram_fraction",),
    "lines": ("dup_line_fraction", "bullet_line_fraction", "ellipsis_line_fraction", "short_line_fraction", "mean_line_length"),
}


def counted(df: DataFrame, names: Sequence[str], text: str = "text") -> DataFrame:
    """df with null text as empty and the structs of counts that the named features need."""
    df = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    return df.withColumns({f"_{k}": getattr(counts, k)(F.col(text)) for k, made in COUNTED.items() if set(made) & set(names)})


def expressions(text: str = "text") -> dict[str, Column]:
    """Feature name -> column, over the columns of counted()."""
    t, w, p, n = F.col(text), F.col("_words"), F.col("_pairs"), F.col("_lines")
    chars = F.length(t)
    ascii = F.octet_length(t) == chars  # most texts, which have none of what the last two patterns look for
    alpha = chars - F.length(F.regexp_replace(t, r"\p{L}+", ""))  # runs, since letters are most of a text
    return {
        "char_length": chars.cast("double"),
        "token_length": w["tokens"].cast("double"),
        "mean_word_length": share(w["word_chars"], w["words"]),
        "gzip_ratio": gzip_ratio(t),
        "type_token_ratio": share(w["distinct"], w["tokens"]),
        "bigram_repetition": F.when(w["tokens"] >= 2, share(w["repeats"], w["tokens"] - 1)).otherwise(0.0),
        "top_ngram_fraction": share(p["top"] * 2, p["tokens"]),
        "dup_line_fraction": share(n["full"] - n["distinct"], n["full"]),
        "stopword_fraction": share(w["stop"], w["words"]),
        "alpha_fraction": share(alpha, chars),
        "digit_fraction": share(count(t, r"\p{Nd}"), chars),
        "punct_fraction": share(count(t, r"[^\p{L}\p{N}\p{IsWhite_Space}\x1c-\x1f]"), chars),
        "uppercase_fraction": share(count(t, r"\p{Lu}"), alpha),
        "non_ascii_fraction": share(F.when(ascii, 0).otherwise(count(t, r"[^\x00-\x7F]")), chars),
        "symbol_word_ratio": share(occurrences(t, "#") + occurrences(t, "...") + occurrences(t, "…"), w["words"]),
        "bullet_line_fraction": share(n["bullets"], n["lines"]),
        "ellipsis_line_fraction": share(n["ellipses"], n["lines"]),
        "short_line_fraction": share(n["short"], n["lines"]),
        "mean_line_length": share(chars - (n["lines"] - 1), n["lines"]),
        "mojibake_fraction": share(F.when(ascii, 0).otherwise(count(t, "|".join(X.MOJIBAKE_SIGNS))), F.greatest(w["words"], F.lit(1))),
    }


def features(df: DataFrame, names: Sequence[str] = X.FEATURES, text: str = "text") -> DataFrame:
    """df with the named feature columns added."""
    made = expressions(text)
    return counted(df, names, text).withColumns({n: made[n] for n in names}).drop(*[f"_{k}" for k in COUNTED])
