"""Many patterns in many texts, in one pass over each text.

The distinct patterns of a table (say, the skills of all postings) become Aho-Corasick automata in
blocks of checked size, which are sent to the tasks.  A text is read once per block, however many
patterns there are and however many records ask for them, and what it holds is a short list beside
it.  A pair of records then looks a word up in that list instead of searching the text again.
"""

from functools import reduce
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of patterns in one automaton; its nodes take some sixty times as much in a task.
BLOCK_BYTES = 1 << 20


class Automaton:
    """All patterns of a block at once."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.patterns, self.machine = patterns, ahocorasick.Automaton()
        for k, pattern in enumerate(patterns):
            self.machine.add_word(pattern, k)
        self.machine.make_automaton()

    def held(self, text: str) -> list[int]:
        """Places of the patterns that the text holds, in order."""
        return sorted({k for _, k in self.machine.iter(text)})

    def counted(self, text: str) -> list[tuple[str, int]]:
        """Patterns with the number of their occurrences, those left out that overlap one of the same pattern."""
        last, count = {}, {}
        for end, k in self.machine.iter(text):
            if end - len(self.patterns[k]) >= last.get(k, -1):
                last[k], count[k] = end, count.get(k, 0) + 1
        return [(self.patterns[k], count[k]) for k in sorted(count)]


def distinct_patterns(rows: DataFrame, *columns: str) -> DataFrame:
    """Lower-case distinct words of array columns, without null and empty ones."""
    each = rows.select(F.explode(F.concat(*[F.coalesce(F.col(c), F.array().cast("array<string>")) for c in columns])).alias("pattern"))
    return each.select(F.lower("pattern").alias("pattern")).where("pattern <> ''").distinct()


class Patterns:
    """The patterns of a one-column frame in blocks, to be looked for in columns of texts.

    Blocks are cut by a hash of the pattern when all together are larger than ``block_bytes``; one block
    is on the driver at a time.  A null pattern and an empty one are in no block.
    """

    def __init__(self, patterns: DataFrame, block_bytes: int = BLOCK_BYTES):
        self.context = patterns.sparkSession.sparkContext
        known = patterns.select(F.col(patterns.columns[0]).alias("pattern")).where("pattern <> ''").distinct()
        size = known.agg(F.sum(F.octet_length("pattern"))).first()[0] or 0
        number = ceil(size / block_bytes)
        block = F.pmod(F.xxhash64("pattern"), F.lit(max(1, number)))
        self.blocks = [
            self.context.broadcast([r[0] for r in known.where(block == k).orderBy("pattern").collect()]) for k in range(number)]

    def _reader(self, sent, kind: str, read):
        ready: list[Automaton] = []

        def run(texts: pa.Array) -> pa.Array:
            if not ready:
                ready.append(Automaton(sent.value))
            return pa.array([read(ready[0], x) for x in texts.to_pylist()], to_arrow[kind])

        return F.arrow_udf(run, kind)

    def _first_codes(self) -> list[int]:
        return [sum(len(b.value) for b in self.blocks[:k]) for k in range(len(self.blocks))]

    def held(self, texts: Column) -> Column:
        """For an array of texts the codes of the patterns that each one holds, one string a text; null where there is none."""
        kind = "array<string>"

        def reader(sent, first):
            def read(machine, row):
                return None if row is None else [
                    None if t is None else "".join(f",{first + k}," for k in machine.held(t)) for t in row]
            return self._reader(sent, kind, read)

        found = [reader(*x)(texts) for x in zip(self.blocks, self._first_codes())]
        none = F.transform(texts, lambda t: F.when(t.isNotNull(), F.lit("")))
        return reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.concat(x, y)), found or [none])

    def coded(self, words: Column) -> Column:
        """Words with the codes to look for in hits, ``array<struct<name, code>>``, whatever their case.

        The empty word has the empty code, which all hits hold, and null has none.
        """
        kind = "array<string>"

        def reader(sent, first):
            ready: list[dict[str, str]] = []

            def run(rows: pa.Array) -> pa.Array:
                if not ready:
                    ready.append({p: f",{first + k}," for k, p in enumerate(sent.value)} | {"": ""})
                return pa.array([None if r is None else [ready[0].get(w) for w in r] for r in rows.to_pylist()], to_arrow[kind])

            return F.arrow_udf(run, kind)

        low = F.transform(words, F.lower)
        found = [reader(*x)(low) for x in zip(self.blocks, self._first_codes())]
        none = F.transform(low, lambda w: F.when(w == "", ""))
        codes = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), found or [none])
        return F.zip_with(words, codes, lambda w, c: F.struct(w.alias("name"), c.alias("code")))

    def counted(self, text: Column) -> Column:
        """The patterns of one text with their numbers of occurrences, ``array<struct<pattern, n>>``."""
        kind = "array<struct<pattern: string, n: bigint>>"

        def read(machine, text):
            return [{"pattern": p, "n": n} for p, n in machine.counted(text or "")]

        found = [self._reader(sent, kind, read)(text) for sent in self.blocks]
        return F.concat(*found) if found else F.array().cast(kind)


to_arrow = {
    "array<string>": pa.list_(pa.string()),
    "array<struct<pattern: string, n: bigint>>": pa.list_(pa.struct([("pattern", pa.string()), ("n", pa.int64())])),
}


def hit_table(rows: DataFrame, keys: list[str], text: str, patterns: Patterns) -> DataFrame:
    """One row per record and pattern in its text: keys, ``pattern`` and the number ``n`` of occurrences."""
    return rows.select(*keys, F.inline(patterns.counted(F.col(text))))
