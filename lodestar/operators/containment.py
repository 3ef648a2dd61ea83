"""Which texts of a vocabulary hold which pieces, by an equi-join on runs of characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions.common import let

#: Characters of a piece that find the words it may stand in.
N_CHARS = 3


def holding(vocabulary: DataFrame, pieces: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """``(*within, word, piece)``: the words of ``vocabulary(*within, word)`` that hold each of ``pieces(*within, piece)``.

    Both tables are distinct. Columns ``within`` must be equal besides. An empty piece is held by no word. A word is taken
    apart once, so a very long one costs no more than its characters.
    """
    found = None
    for n in range(1, N_CHARS + 1):
        gram = f"transform(sequence(1, size(cs) - {n - 1}), i -> array_join(slice(cs, i, {n}), ''))"
        grams = vocabulary.filter(f"char_length(word) >= {n}").selectExpr(*within, "word", f"explode(array_distinct({let('cs', chars('word'), gram)})) AS gram")
        own = pieces.filter(f"char_length(piece) {'>=' if n == N_CHARS else '='} {n}").selectExpr(*within, "piece", f"substring(piece, 1, {n}) AS gram")
        part = grams.join(own, [*within, "gram"]).filter(F.contains("word", "piece")).select(*within, "word", "piece")
        found = part if found is None else found.unionByName(part)
    return found


def chars(text: str) -> str:
    """The characters of a text, without the empty one that a split may leave at the end."""
    return f"filter(split({text}, ''), c -> c <> '')"
