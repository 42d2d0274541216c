"""Many terms looked for in many texts at once: an automaton of all terms passes each text once, however many terms there are.

The terms go to the workers as one broadcast whose characters are bounded. With more terms than the bound allows, they are
parted by a hash and each part has a broadcast and a pass over the texts of its own; the driver holds one part at a time.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import bounded_batches, staged

#: Characters of the terms in one automaton (some hundred bytes each there), and finds that leave a task at once.
TERM_CHARS, SENT_ROWS = 1 << 20, 1 << 16
#: The automata that a worker keeps for its later tasks.
MADE: dict = {}


def automaton(name: str, terms: list[str]):
    """The automaton of `terms`, made once in a worker."""
    import ahocorasick

    if name not in MADE:
        while len(MADE) >= 2:
            MADE.pop(next(iter(MADE)))
        made = ahocorasick.Automaton()
        for i, term in enumerate(terms):
            made.add_word(term, (i, len(term)))
        made.make_automaton()
        MADE[name] = made
    return MADE[name]


def finds(texts: DataFrame, text: str, terms: DataFrame) -> DataFrame:
    """The columns of `texts` but `text`, with `term` and `place`: each of the `terms` (term) that the text holds and the
    character, from 1, where it first does. Equality is that of characters; an empty or null term or text finds nothing.
    """
    spark = texts.sparkSession
    bounded_batches(spark)
    terms = staged(terms.select("term").where("term <> ''").distinct())
    total = terms.agg(F.sum(F.length("term")).alias("n")).first()["n"] or 0
    parts = max(1, math.ceil(total / (TERM_CHARS * 0.8)) if total > TERM_CHARS else 1)
    keep = [c for c in texts.columns if c != text]
    kinds = ", ".join(f"`{c}` {t}" for c, t in texts.dtypes if c != text)
    texts = texts.where(F.length(text) > 0)
    out = None
    for part in range(parts):
        some = terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part) if parts > 1 else terms
        one = pass_over(texts, text, keep, kinds, sorted(r["term"] for r in some.collect()))
        out = one if out is None else out.unionByName(one)
    return out


def pass_over(texts: DataFrame, text: str, keep: list[str], kinds: str, terms: list[str]) -> DataFrame:
    """One automaton's finds; `terms` are within the bound."""
    held, name = texts.sparkSession.sparkContext.broadcast(terms), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = held.value
        if not words:
            return
        made = automaton(name, words)

        def out(batch: pa.RecordBatch, rows: list[int], found: list[int], places: list[int]) -> pa.RecordBatch:
            columns = [batch.column(c).take(pa.array(rows, pa.int32())) for c in keep]
            return pa.RecordBatch.from_arrays([*columns, pa.array([words[i] for i in found], pa.string()), pa.array(places, pa.int32())], names=[*keep, "term", "place"])

        for batch in batches:
            rows, found, places = [], [], []
            for row, value in enumerate(batch.column(text)):
                seen = {}
                for end, (i, size) in made.iter(value.as_py()):
                    if i not in seen:
                        seen[i] = end - size + 2
                rows += [row] * len(seen)
                found += seen
                places += seen.values()
                if len(rows) >= SENT_ROWS:
                    yield out(batch, rows, found, places)
                    rows, found, places = [], [], []
            if rows:
                yield out(batch, rows, found, places)

    return texts.mapInArrow(run, f"{kinds}, term string, place int")
