"""Which of many keywords a text contains, found once per text and kept as small numbers.

Two engines give the same answer, and the caller names the one; the default needs nothing beyond Spark.  ``jvm`` tests every keyword by substring search inside Spark.
``automaton`` reads each text once for all keywords, in Arrow batches; on 10,000 documents (25 MB,
8 cores) 400 keywords took 0.5 s against 3.0 s, 60 keywords 0.6 s against 1.0 s.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from vocspark.functions.common import let
from vocspark.taxonomy import Taxonomy, constant


class KeywordIndex:
    """Numbers for the distinct lower-case keywords of a taxonomy and its text rules."""

    def __init__(self, words: Sequence[str]):
        self.number: dict[str, int] = {}
        for w in words:
            self.number.setdefault(w.lower(), len(self.number))

    @classmethod
    def of(cls, tax: Taxonomy) -> KeywordIndex:
        lists = [g.keywords for g in (*tax.subcategories, *tax.impact_types, *tax.domains, *tax.legacy_categories)]
        lists += [tax.audiences.get(a, ()) for a in ("Developer", "Customer", "ISV")]
        lists += [tax.rules.portal_terms, tax.rules.partner_terms, tax.rules.saas_terms]
        return cls([w for words in lists for w in words])

    def numbers(self, words: Sequence[str]) -> list[int]:
        return [self.number[w.lower()] for w in words]

    def hits(self, lowered: Column, engine: str = "jvm") -> Column:
        """Numbers of the keywords contained in a lower-case text; ``automaton`` needs pyahocorasick on the executors."""
        if engine not in ("jvm", "automaton"):
            raise ValueError(f"unknown engine {engine}")
        if engine == "automaton":
            return self._by_automaton(lowered)
        table = constant([{"word": w, "n": n} for w, n in self.number.items()])
        return let(lowered, lambda t: F.transform(
            F.filter(table, lambda k: F.contains(t, k["word"])), lambda k: k["n"]))

    def _by_automaton(self, lowered: Column) -> Column:
        words = dict(self.number)

        @F.pandas_udf("array<int>")
        def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            import ahocorasick  # where the task runs, not where the plan is made
            machine = ahocorasick.Automaton()
            for word, n in words.items():
                machine.add_word(word, n)
            machine.make_automaton()
            for texts in batches:
                yield texts.map(lambda t: sorted({n for _, n in machine.iter(t)}))

        return find(lowered)


def among(hits: Column, numbers: Sequence[int]) -> Column:
    """How many of the given keyword numbers were hit."""
    return F.size(F.array_intersect(constant(list(numbers) or [-1]), hits))
