"""Text helpers for the tokenizer (F1): lower-case, accent folding, words of
two or more letters/digits, stop words removed, then unigrams + bigrams.

All steps are JVM-side: SQL string functions plus Spark ML's
``StopWordsRemover`` (hash-set lookup) and ``NGram``.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.ml import PipelineModel
from pyspark.ml.feature import NGram, SQLTransformer, StopWordsRemover
from pyspark.sql import DataFrame

from .. import constants as K

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


@lru_cache(maxsize=1)
def accent_table() -> tuple[str, str]:
    """(from, to) for ``translate``, over all of Unicode: a character whose
    compatibility decomposition without combining marks is one other character maps to
    it; combining marks have no partner and are removed.  Built from the
    Unicode database, not typed in.  Characters that decompose to several (ligatures) stay."""
    src, dst, gone = [], [], []
    for cp in range(0x80, sys.maxunicode + 1):
        if 0xAC00 <= cp < 0xD7A4 or 0xD800 <= cp < 0xE000:      # Hangul syllables decompose to several; surrogates
            continue
        ch = chr(cp)
        if unicodedata.combining(ch):
            gone.append(ch)
            continue
        if not unicodedata.decomposition(ch):
            continue
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch and base.isalnum():
            src.append(ch)
            dst.append(base.lower())
    return "".join(src + gone), "".join(dst)


def tokenizer(text_col: str, out: str = "terms", stop_words=None, ngram: bool = True) -> PipelineModel:
    """A fitted-free pipeline: text -> ``out`` array of unigrams (+ bigrams)."""
    stop = list(K.ENGLISH_STOP_WORDS if stop_words is None else stop_words)
    src, dst = accent_table()
    pattern = TOKEN_PATTERN.replace("\\", "\\\\")
    split = SQLTransformer(statement=(
        f"SELECT *, regexp_extract_all(translate(lower(coalesce(`{text_col}`, '')), '{src}', '{dst}'), "
        f"'{pattern}', 0) AS __words FROM __THIS__"))
    remover = StopWordsRemover(inputCol="__words", outputCol="__tokens", stopWords=stop, caseSensitive=True)
    stages = [split, remover]
    if ngram:
        stages.append(NGram(n=2, inputCol="__tokens", outputCol="__bigrams"))
        joiner = f"concat(__tokens, __bigrams)"
    else:
        joiner = "__tokens"
    stages.append(SQLTransformer(statement=(
        f"SELECT * EXCEPT (__words, __tokens{', __bigrams' if ngram else ''}), {joiner} AS `{out}` FROM __THIS__")))
    return PipelineModel(stages=stages)


def tokenize(df: DataFrame, text_col: str, out: str = "terms", stop_words=None, ngram: bool = True) -> DataFrame:
    return tokenizer(text_col, out, stop_words, ngram).transform(df)
