"""Many phrases looked for in one pass over each text."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def automaton(phrases: list[str]) -> ahocorasick.Automaton:
    """A trie of the phrases with a link from each node to its longest proper suffix in the trie."""
    machine = ahocorasick.Automaton()
    for place, phrase in enumerate(phrases):
        machine.add_word(phrase, place)
    machine.make_automaton()
    return machine


def phrase_places(text: Column, phrases: list[str]) -> Column:
    """Sorted positions in `phrases` of those that occur anywhere in a text; overlapping ones count alike.

    Every text is read once, whatever the number of phrases. A NULL text has none. Phrases must be
    distinct and not empty.
    """

    @F.arrow_udf("array<int>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = automaton(phrases)
        for batch in batches:
            found, ends = [], [0]
            for t in batch:
                value = t.as_py()
                if value:
                    found += sorted({place for _, place in machine.iter(value)})
                ends.append(len(found))
            yield pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(found, pa.int32()))

    return find(text)
