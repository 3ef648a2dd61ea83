"""Analysis of text: tokens, cleaning, highlighting, stemming."""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestar.functions.common import NO_STRINGS, let, literal, literals
from lodestar.functions.porter import porter_stem

# One word character, and a token (words joined by an inner apostrophe or full stop).
WORD = r"[\p{L}\p{M}\p{N}_]"
JOINER = r"['’.]"
TOKEN = rf"{WORD}+(?:{JOINER}{WORD}+)*"
# The 33 English stopwords of the standard analyzer.
STOPWORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their "
    "then there these they this to was will with"
).split()
# The ASCII punctuation characters.
PUNCTUATION_RE = r"""[!"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~]"""


def analyse(text: str) -> str:
    """Lower-cased word tokens of ``text`` without stopwords; null text gives no tokens."""
    tokens = f"regexp_extract_all(lower({text}), {literal(TOKEN)}, 0)"
    return f"coalesce(filter({tokens}, tok -> tok NOT IN ({literals(STOPWORDS)})), {NO_STRINGS})"


def long_stopwords() -> list[str]:
    """The long English stopword list used for text cleaning."""
    return StopWordsRemover.loadDefaultStopWords("english")


def clean_tokens(text: str, stopwords: list[str]) -> str:
    """Lower-case, drop punctuation and apostrophes, split on blanks, drop stopwords."""
    bare = f"regexp_replace(lower({text}), {literal(PUNCTUATION_RE)}, '')"
    return f"filter(split({bare}, {literal(chr(92) + 's+')}), tok -> tok <> '' AND tok NOT IN ({literals(stopwords)}))"


# Distinct words of a batch that are Python strings at a time.
VOCABULARY = 1 << 16
# A worker remembers the stems of frequent words from batch to batch.
stem_of = lru_cache(1 << 17)(porter_stem)


def _stem_each(token: pd.Series) -> pd.Series:
    return token.map(stem_of, na_action="ignore")


def _stem_arrays(tokens: pa.Array) -> pa.Array:
    """The tokens stay in Arrow's buffers; only the distinct ones become Python strings, some at a time. No array gives an empty one."""
    coded = tokens.flatten().dictionary_encode()
    words = coded.dictionary
    stems = [pa.array(map(stem_of, words.slice(at, VOCABULARY).to_pylist()), words.type) for at in range(0, len(words), VOCABULARY)]
    stemmed = pa.concat_arrays([*stems, pa.nulls(0, words.type)]).take(coded.indices)
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0).cast(pa.int32()))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), stemmed)


@F.arrow_udf(T.ArrayType(T.StringType()))
def stem_tokens(tokens: pa.Array) -> pa.Array:
    """Stem arrays of tokens; each Arrow batch stems its own distinct words once."""
    return _stem_arrays(tokens)


@F.pandas_udf(T.StringType())
def stem(token: pd.Series) -> pd.Series:
    """Stem one token per row; meant for a table of distinct words."""
    return _stem_each(token)


def clean_text(text: str, stemmed: bool = True) -> Column:
    """Cleaned text, joined by blanks."""
    tokens = F.expr(clean_tokens(text, long_stopwords()))
    return F.array_join(stem_tokens(tokens) if stemmed else tokens, " ")


def highlight_pattern(tokens: str) -> str:
    """A regular expression that matches any of the analysed ``tokens`` as a whole token."""
    escaped = f"transform(array_distinct({tokens}), tok -> replace(tok, '.', {literal(chr(92) + '.')}))"
    before = literal(rf"(?iu)(?<!{WORD})(?<!{WORD}{JOINER})(")
    after = literal(rf")(?!{WORD})(?!{JOINER}{WORD})")
    return f"CASE WHEN size({tokens}) > 0 THEN concat({before}, array_join({escaped}, '|'), {after}) END"


def highlight(text: str, tokens: str) -> str:
    """Put ``<em>`` around every token of ``text`` that the query also has."""
    marked = let("pattern_", highlight_pattern(tokens), f"regexp_replace({text}, pattern_, '<em>$1</em>')")
    return f"coalesce({marked}, {text})"
