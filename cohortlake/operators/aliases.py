"""Whole-word matches of many aliases at once, by one automaton over all of them."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import plain_text


class Automaton:
    """Aliases as sequences of words: a trie whose nodes fall back to the longest
    other beginning that the words read so far end with. A text is read once,
    whatever the number of aliases, and aliases that overlap are all found."""

    def __init__(self, aliases: Sequence[tuple[str, int]]):
        self.next: list[dict[str, int]] = [{}]
        self.found: list[set[int]] = [set()]
        for alias, name in aliases:
            node = 0
            for word in alias.split():
                if word not in self.next[node]:
                    self.next[node][word] = len(self.next)
                    self.next.append({})
                    self.found.append(set())
                node = self.next[node][word]
            if node:
                self.found[node].add(name)
        self.back = [0] * len(self.next)
        queue = deque(self.next[0].values())
        while queue:
            node = queue.popleft()
            for word, child in self.next[node].items():
                fall = self.back[node]
                while fall and word not in self.next[fall]:
                    fall = self.back[fall]
                self.back[child] = self.next[fall].get(word, 0)
                self.found[child] |= self.found[self.back[child]]
                queue.append(child)

    def names(self, words: Sequence[str]) -> set[int]:
        node, out = 0, set()
        for word in words:
            while node and word not in self.next[node]:
                node = self.back[node]
            node = self.next[node].get(word, 0)
            out |= self.found[node]
        return out


def match_aliases(df: DataFrame, text: str, groups: Sequence[tuple[str, Sequence[str]]], out: str = "matches") -> DataFrame:
    """``df`` with a column ``out`` (array of string): the groups of which an alias stands in
    the text as whole words, in the groups' order. groups: (name, aliases), a bounded contract.

    Texts and aliases are compared as plain lower-case words; aliases without words
    match nothing; null texts match nothing. An alias of several groups matches all.
    """
    spark = df.sparkSession
    asked = [(i, a) for i, (_, aliases) in enumerate(groups) for a in aliases]
    plain = spark.createDataFrame(asked, "i int, alias string").select("i", plain_text(F.col("alias"))).collect() if asked else []
    automaton = Automaton([(alias, i) for i, alias in plain])
    names = [n for n, _ in groups]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [[names[i] for i in sorted(automaton.names(t.split()))] for t in batch.column("plain").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.list_(pa.string()))], [*batch.schema.names[:-1], "found"])

    columns = [f"c{i}" for i in range(len(df.columns))]  # names of the caller can't clash with ours
    kinds = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(columns, df.schema.fields))
    named = df.toDF(*columns).withColumn("plain", plain_text(F.col(columns[df.columns.index(text)])))
    return named.mapInArrow(run, f"{kinds}, found array<string>").toDF(*df.columns, out)
