"""Whole sentences in Arrow batches: what is inherently per sentence runs on the columns of many sentences at once.

Rows meet by sentence, in one shuffle at most (none where they are dealt by it), and sorted within a task; a function gets tables of some ten thousand
rows, of whole sentences. Nothing is gone through row by row. Memory is that of one table, or of the longest sentence.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dendrium.operators.staging import dropped, staged

#: Rows that a table of sentences has at least, if there are so many, and those of a batch that goes back.
ROWS, BACK = 50_000, 20_000
#: What a word's place is above all others.
FAR = np.iinfo(np.int64).max


def by_sentence(rows: DataFrame, run: Callable, schema, order: tuple[str, ...] = ("nid",), keys: tuple[str, ...] = ("corpus", "sentno"), least: int = ROWS) -> DataFrame:
    """run(table, sent) over all rows: tables of whole sentences, of `least` rows if there are so many, sorted by `order` within each; sent numbers them from 0. Sentences are what
    has the same keys, nulls too. run gives a table with the columns of schema; its ValueErrors are raised by made()."""
    starts = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts):
            table = pa.Table.from_batches(parts).combine_chunks()
            sent = np.cumsum(table["_starts"].to_numpy()) - 1
            yield from run(table.drop_columns("_starts"), sent).combine_chunks().to_batches(BACK)

        held, n = [], 0
        for batch in batches:
            at = np.flatnonzero(batch.column("_starts").to_numpy(zero_copy_only=False))
            if len(at) and n + at[-1] >= least:
                yield from done([*held, batch.slice(0, at[-1])])
                held, n, batch = [], 0, batch.slice(at[-1])
            held.append(batch)
            n += batch.num_rows
        if n:
            yield from done(held)

    return rows.withColumn("_starts", starts).mapInArrow(each, schema)


def made(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """df staged; a ValueError that a task raised is raised here. `tables` are dropped in any case."""
    try:
        return staged(df)
    except Exception as e:
        if found := re.search(r"ValueError: (a node [^\n]*)", str(e)):
            raise ValueError(found[1]) from None
        raise
    finally:
        dropped(*tables)


def ints(column: pa.ChunkedArray, none: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column, `none` for nulls, and where there is one."""
    there = column.is_valid().to_numpy()
    return column.fill_null(none).to_numpy().astype(np.int64), there


def flags(column: pa.ChunkedArray) -> np.ndarray:
    """The truths of a column; nulls are false."""
    return column.fill_null(False).to_numpy().astype(bool)


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """The same number for the same values, -1 for nulls."""
    found = column.combine_chunks().dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.fill_null(-1).to_numpy().astype(np.int64)


def with_nulls(values: np.ndarray, there: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values, mask=~there).cast(kind)


def replaced(table: pa.Table, **columns) -> pa.Table:
    for name, value in columns.items():
        table = table.set_column(table.schema.get_field_index(name), name, value)
    return table


class Places:
    """Rows by sentence and number: where the row with a number is."""

    def __init__(self, sent: np.ndarray, number: np.ndarray):
        """Sorted by sentence and number."""
        self.numbers, rank = np.unique(number, return_inverse=True)
        self.keys = sent * len(self.numbers) + rank

    def at(self, sent: np.ndarray, number: np.ndarray, there: np.ndarray | None = None) -> np.ndarray:
        """The row with the number in the sentence, -1 if there is none."""
        if not len(self.keys):
            return np.full(len(sent), -1)
        rank = np.minimum(np.searchsorted(self.numbers, number), len(self.numbers) - 1)
        wanted = sent * len(self.numbers) + rank
        row = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        hit = (self.numbers[rank] == number) & (self.keys[row] == wanted)
        return np.where(hit if there is None else hit & there, row, -1)


class Trees:
    """The nodes of whole sentences: a table with nid, parent, pos, sorted by nid within sentences; up, the row of a node's parent
    (-1 if it has none there), pos and whether it is over a word."""

    def __init__(self, table: pa.Table, sent: np.ndarray):
        self.table, self.sent = table, sent
        self.nid, _ = ints(table["nid"])
        self.places = Places(sent, self.nid)
        self.up = self.places.at(sent, *ints(table["parent"]))
        self.pos, self.over_word = ints(table["pos"], -1)

    def kept(self, keep: np.ndarray) -> Trees:
        return Trees(self.table.filter(pa.array(keep)), self.sent[keep])


def ends(up: np.ndarray, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """How many rows are above each, and the least value of it and all rows below it: pointers are doubled. Parents in a circle raise ValueError."""
    to, steps = up.copy(), (up >= 0).astype(np.int64)
    least = None if least is None else least.copy()
    for _ in range(len(up).bit_length() + 1):
        live = np.flatnonzero(to >= 0)
        if not len(live):
            return steps, least
        t = to[live]
        if least is not None:
            np.minimum.at(least, t, least[live])
        steps[live] += steps[t]
        to[live] = to[t]
    raise ValueError("a node is above itself")


def places_in(groups: np.ndarray) -> np.ndarray:
    """The place, from 0, of each row among the rows of its group; the groups' rows stand together."""
    if not len(groups):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


def numbered(t: Trees, up: np.ndarray) -> Trees:
    """The trees with these parents: nodes over no word are gone; parent, side, depth and pos are made anew."""
    depth, first = ends(up, np.where(t.over_word, t.pos, FAR))
    keep = first < FAR
    below = np.flatnonzero(keep & (up >= 0))
    below = below[np.lexsort((below, first[below], up[below]))]
    side = np.zeros(len(up), np.int64)
    side[below] = places_in(up[below]) + 1
    words = np.flatnonzero(t.over_word)
    words = words[np.lexsort((t.pos[words], t.sent[words]))]
    # Words with the same place count as the last of them.
    last = np.searchsorted(words_key := dense(t.sent[words], t.pos[words]), words_key, "right")
    pos = t.pos.copy()
    pos[words] = last - np.searchsorted(t.sent[words], t.sent[words])
    has = up >= 0
    new = {"side": with_nulls(side, has, pa.int32()), "depth": pa.array(depth, pa.int32()), "pos": with_nulls(pos, t.over_word, pa.int32())}
    new["parent"] = with_nulls(np.where(has, t.nid[up], 0), has, t.table.schema.field("parent").type)
    out = Trees.__new__(Trees)
    out.table, out.sent, out.nid = replaced(t.table, **new).filter(pa.array(keep)), t.sent[keep], t.nid[keep]
    out.places, out.pos, out.over_word = Places(out.sent, out.nid), pos[keep], t.over_word[keep]
    row = np.cumsum(keep) - 1
    out.up = np.where(has, row[up], -1)[keep]
    return out


def dense(*sorted_keys: np.ndarray) -> np.ndarray:
    """Numbers, ascending, of the different rows of keys that are sorted."""
    new = np.zeros(len(sorted_keys[0]), bool)
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def head_words(t: Trees, head: np.ndarray, has_head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the word that each node's head's head and so on is over, and whether there is one. head: the row of a node's head, -1 if it is not there."""
    to = np.where(has_head, head, -1)
    end = np.flatnonzero(~has_head)
    root = np.where(has_head, -1, np.arange(len(to)))
    for _ in range(len(to).bit_length() + 1):
        live = np.flatnonzero(to >= 0)
        if not len(live):
            break
        root_n, to_n = root[to[live]], to[to[live]]
        root[live], to[live] = root_n, np.where(root_n >= 0, -1, to_n)
    root[end] = end
    there = (root >= 0) & t.over_word[root]
    return np.where(there, t.pos[root], -1), there
