"""Packing of token sequences by dominance reduction, then best fit.

Documents become token ids with an end mark, longer ones are cut into pieces of the capacity.  How
many sequences there are and what they hold depends on nothing but how often each length occurs,
at most ``capacity`` numbers.  On these numbers

* the reduction of Martello and Toth fixes sets of up to three lengths that provably dominate every
  other set with their first length, as often as both conditions and counts allow, and
* best fit takes what is left, longest first, whole groups of equally filled sequences at a time.

The outcome is a plan of ranges: the pieces of a length, numbered, go to these sequences.  A group's
free space at least halves whenever a length enters it, so the plan has a bounded number of rows
whatever the number of documents, and pieces find their place in it by a join with their number.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_limits, materialize, narrow, table

CAPACITY = 2048
#: The mark after each document.
END = 0
VOCABULARY = "word_bpe_49k.json"
#: Words, and characters of words, whose ids a worker keeps.
WORDS = 600_000
CHARACTERS = 1 << 24


def tokenizer_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds:
    """Token ids of whole texts through those of their words.

    The vocabulary's rules drop white space and join nothing across it, nor a letter or digit of Latin-1 with
    one of some marks after it, so that a text's ids are those of its parts in order.  Each
    different part is encoded once while it is kept; the ids of all kept ones stand in one array.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # What the rules before the model make of single letters; words of these need no more rules.
        first = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.letters = {ord(c): first(c)[0][0] for c in map(chr, range(256)) if c.isalpha() and c == c.lower() and c not in "ªµº"}
        self.plain = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        self.clear()

    def clear(self) -> None:
        self.kept: dict[str, int] = {}
        self.characters = 0
        self.stop = np.zeros(1, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def _encode(self, words: list[str]) -> list[list[int]]:
        tokenize, letters = self.tokenizer.model.tokenize, self.letters
        plain = list(map(self.plain, words))
        odd = self.tokenizer.encode_batch([w for w, p in zip(words, plain) if not p], add_special_tokens=False)
        odd = iter(odd)
        return [[t.id for t in tokenize(w.lower().translate(letters))] if p else next(odd).ids for w, p in zip(words, plain)]

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The place of every word among the kept ones."""
        kept = self.kept
        at = list(map(kept.get, words))
        new = [w for w, i in zip(words, at) if i is None]
        if not new:
            return np.array(at, dtype=np.int64)
        self.characters += sum(map(len, new))
        if kept and (len(kept) + len(new) > WORDS or self.characters > CHARACTERS):
            self.clear()
            return self._numbers(words)
        ids = self._encode(new)
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.stop = np.concatenate((self.stop, self.stop[-1] + np.cumsum(size)))
        self.flat = np.concatenate((self.flat, np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(size.sum()))))
        kept.update(zip(new, range(len(kept), len(kept) + len(new))))
        return np.array(list(map(kept.__getitem__, words)), dtype=np.int64)

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by ``end``, and where each text's ids stop."""
        apart = pc.replace_substring_regex(pc.fill_null(texts, ""), pattern='([A-Za-z0-9À-ÖØ-öø-ÿ])([,.;:!?()"])', replacement="\\1 \\2")
        lists = pc.ascii_split_whitespace(apart)
        words = lists.flatten().dictionary_encode()
        per = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        number = self._numbers(words.dictionary.to_pylist())
        flat, start = self.flat, self.stop[number]
        length = self.stop[number + 1] - start
        word = words.indices.to_numpy(zero_copy_only=False)
        size = length[word]
        stop = np.cumsum(size)
        ids = flat[np.arange(stop[-1] if len(stop) else 0) + np.repeat(start[word] - stop + size, size)]
        tokens = np.concatenate(([0], stop))[np.concatenate(([0], np.cumsum(per)))]
        each_doc = np.diff(tokens)
        out = np.full(len(ids) + len(per), end, dtype=np.int32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(per)), each_doc)] = ids
        return out, np.cumsum(each_doc + 1)


#: What a worker keeps from task to task, by the vocabulary's path.
_encoders: dict[str, WordIds] = {}


def _pieces(path: str, capacity: int, end: int):
    """The pieces of a task's documents.  ``nth`` numbers those of one length within the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = _encoders.get(path) or _encoders.setdefault(path, WordIds(path)), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, stop = encode(batch.column(1), end)
            size = np.diff(np.concatenate(([0], stop)))
            n = -(-size // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[doc] - start, capacity)
            begin = (stop - size)[doc] + start
            by_length = np.argsort(length, kind="stable")
            ordered = length[by_length]
            first = np.searchsorted(ordered, ordered)
            nth = np.empty(len(length), dtype=np.int64)
            nth[by_length] = np.arange(len(length)) - first + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[b : b + k].tobytes()) for b, k in zip(begin, length)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate((begin, [len(ids)])), pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc)),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    lists,
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(doc), task), pa.int32()),
                    pa.array(nth),
                ],
                names=["doc_id", "piece", "start", "length", "ids", "ids_crc32", "task", "nth"],
            )

    return run


class _Plan:
    """Rows (length, lo, n, per, sequence, at): pieces lo .. lo + n - 1 of a length, ``per`` a
    sequence from ``sequence`` on, side by side from ``at`` on."""

    def __init__(self, counts: np.ndarray) -> None:
        self.left = [int(c) for c in counts]
        self.taken = [0] * len(self.left)
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = 0

    def put(self, length: int, per: int, bins: int, sequence: int, at: int) -> None:
        n = per * bins
        self.rows.append((length, self.taken[length], n, per, sequence, at))
        self.taken[length] += n
        self.left[length] -= n

    def fix(self, lengths: list[int], bins: int) -> None:
        """``bins`` sequences of these lengths."""
        at = 0
        for length in dict.fromkeys(lengths):
            per = lengths.count(length)
            self.put(length, per, bins, self.sequences, at)
            at += per * length
        self.sequences += bins


def _reaches(left: list[int], low: int, high: int) -> bool:
    """Whether some of the lengths that are left add up to more than ``low`` and at most ``high``."""
    mask, sums, wanted = (1 << (high + 1)) - 1, 1, ((1 << (high + 1)) - 1) >> (low + 1) << (low + 1)
    for length in range(1, high + 1):
        count, step = min(left[length], high // length), 1
        while count > 0:
            step = min(step, count)
            sums |= sums << (step * length) & mask
            count, step = count - step, step * 2
        if sums & wanted:
            return True
    return False


def _dominating(left: list[int], j: int, capacity: int) -> list[int] | None:
    """A set with ``j`` that dominates every other feasible set with it, or None if none of at
    most three lengths is known to.  ``left`` counts the lengths besides one ``j``."""
    room = capacity - j
    fits = [k for k in range(room, 0, -1) if left[k] > 0]
    if not fits:
        return [j]
    k = fits[0]
    # Whatever else fits beside j fits in the place of k, unless it adds up to more.
    if k == room or not _reaches(left, k, room):
        return [j, k]
    least = [x for x in reversed(fits) for _ in range(min(left[x], 3))][:3]
    if len(least) == 3 and sum(least) <= room:
        return None
    # At most two more fit: k and its largest partner, unless two others can't take their places.
    left[k] -= 1
    b = next((x for x in range(min(room - k, k), 0, -1) if left[x] > 0), None)
    left[k] += 1
    if b is None:
        return None
    for y in fits:
        if b < y < k:
            for x in fits:
                if x < k and y <= x and (x != y or left[x] > 1) and k < x + y <= room:
                    return None
    return [j, k, b]


def reduce_by_dominance(plan: _Plan, capacity: int) -> None:
    """Fix sets that no packing need do without, from the longest length on."""
    for j in range(capacity, 0, -1):
        while plan.left[j] > 0:
            plan.left[j] -= 1
            found = _dominating(plan.left, j, capacity)
            plan.left[j] += 1
            if found is None:
                break
            # What is taken away offers no new alternative: the set holds while it is there.
            plan.fix(found, min(plan.left[x] // found.count(x) for x in set(found)))


def best_fit(plan: _Plan, capacity: int) -> None:
    """What is left, longest first, each into the fullest sequence that has room.

    ``free[r]`` has the groups (first sequence, number) with r tokens free.
    """
    free: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        room = length
        while plan.left[length] > 0:
            while room < capacity and not free[room]:
                room += 1
            per = room // length
            if free[room]:
                first, bins = free[room].pop()
            else:
                first, bins = plan.sequences, -(-plan.left[length] // per)
                plan.sequences += bins
            full = min(bins, plan.left[length] // per)
            if full:
                plan.put(length, per, full, first, capacity - room)
                free[room - per * length].append((first, full))
            rest = plan.left[length]
            if full < bins and rest:
                plan.put(length, rest, 1, first + full, capacity - room)
                free[room - rest * length].append((first + full, 1))
                full += 1
            if full < bins:
                free[room].append((first + full, bins - full))


def plan_of(counts: np.ndarray, capacity: int = CAPACITY) -> _Plan:
    """The plan for ``counts[length]`` pieces of every length up to ``capacity``."""
    plan = _Plan(counts)
    reduce_by_dominance(plan, capacity)
    best_fit(plan, capacity)
    return plan


def tokenized(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, name: str = "pieces") -> DataFrame:
    """The stored pieces (doc_id, piece, start, length, ids, ids_crc32, task, nth) of ``docs``."""
    arrow_limits(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids array<int>, ids_crc32 long, task int, nth long"
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(given.mapInArrow(_pieces(path or tokenizer_path(), capacity, end), schema), name)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, name: str = "packing") -> DataFrame:
    """(doc_id, piece, start, length, ids, ids_crc32, sequence_id, offset) of every piece.

    A null or empty text is its end mark alone.  Only documents longer than ``capacity`` are cut.
    Null and repeated doc_ids are documents like any other; pieces of one length are
    interchangeable.  Other columns are ignored; an empty table gives an empty result.  The driver
    gets one count a length, every executor the plan.
    """
    spark = docs.sparkSession
    pieces = tokenized(docs, path, capacity, end, f"{name}-pieces")
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for row in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():
        counts[row["length"]] = row["n"]
    rows = plan_of(counts, capacity).rows
    plan = spark.createDataFrame(rows, "length long, lo long, n long, per long, first long, at long")

    # The number of a piece among those of its length: those of the tasks before, then its own.
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("m"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    per_task = per_task.select("length", "task", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"))
    per_task = materialize(per_task, f"{name}-tasks")
    placed = pieces.join(narrow(per_task), ["length", "task"]).withColumn("number", F.col("before") + F.col("nth"))
    placed = placed.join(F.broadcast(plan), "length").filter("number >= lo and number < lo + n")
    return placed.select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids",
        "ids_crc32",
        F.expr("first + (number - lo) div per").alias("sequence_id"),
        F.expr("at + (number - lo) % per * length").alias("offset"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences, at most a capacity of ids each."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts")
    rows = packed.groupBy("sequence_id").agg(parts)
    return rows.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"), F.col("parts.doc_id").alias("doc_ids"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every piece of every document goes."""
    return pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
