"""Packing of tokenised documents into sequences by a histogram of lengths.

Documents are cut into pieces of at most one sequence. Only the number of pieces of each
length is needed to plan the packs: lengths are placed longest first, always into the
shortest packs that have room, as patterns with a count. The plan is then joined back to
the pieces by their rank among those of equal length.
"""

import json
import os
import re
import zlib
from collections import defaultdict
from itertools import chain
from unicodedata import normalize

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from annalist.llm.common import once_per_process, record_batch, small_batches
from annalist.operators.lineage import Scratch

#: pieces of one length that are ranked in one task
RANKED_TOGETHER = 100_000
#: runs kept in a worker's cache (about 200 bytes each), and the longest one that is kept
CACHE_WORDS, CACHE_LENGTH = 400_000, 48
#: Fixed value: what the tokenizer's last token of a word ends with
WORD_END = "</w>"
#: marks that are neither letters, numbers nor apostrophes and combine with no character
MARKS = b".,!?;:#$%&*|()-"


class WordIds:
    """Ids of runs of bytes between white space, as little-endian 32-bit integers.

    The tokenizer lower-cases, drops white space and merges within its own words. None of
    these holds white space or both letters and marks, so a text's ids are those of its
    runs, and a run's those of its letters and of the marks after them. Words of letters
    alone are encoded many at a time; tokens that end a word tell them apart. Special tokens
    are found in the text as it is, before all that, and stand between two texts.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        added = [t for t in json.loads(definition)["added_tokens"] if t["special"]]
        # keys that begin with a blank are no runs
        self.special = {b" " + t["content"].encode(): np.array([t["id"]], "<u4").tobytes() for t in added}
        self.marked = re.compile("(" + "|".join(re.escape(t["content"]) for t in added) + ")") if added else None
        self.known: dict[bytes, bytes] = dict(self.special)
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # texts are cut at them; a run that is one when lower-cased is ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def runs(self, text: str) -> list[bytes]:
        parts = self.marked.split(text) if self.marked else [text]
        if len(parts) == 1:
            return text.encode().lower().split()
        return list(chain.from_iterable([b" " + p.encode()] if i % 2 else p.encode().lower().split() for i, p in enumerate(parts)))

    def of_texts(self, texts: list[str], end: int) -> list[np.ndarray]:
        split = [self.runs(t) for t in texts]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
            known.update(self.special)
        new = set(chain.from_iterable(split)).difference(known)
        parts = self.learn(new)
        last = np.array([end], "<u4").tobytes()
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)) + last, "<u4") for words in split]
        for word in new | parts:
            if len(word) > CACHE_LENGTH:
                del known[word]
        return out

    def learn(self, runs) -> set:
        """Caches runs; returns the letters and marks that they were cut into, which are cached too."""
        known, apart, letters, joined = self.known, set(), set(), []
        for run in runs:
            stem = run.rstrip(MARKS)
            # normal form and lower case may turn a letter into a letter and a combining mark
            if not stem.isalpha() and not normalize("NFC", stem.decode()).lower().isalpha():
                apart.add(run)
                continue
            letters.add(stem)
            if len(stem) < len(run):
                tail = run[len(stem) :]
                apart.add(tail)
                joined.append((run, stem, tail))
        self.encode_apart(apart.difference(known))
        self.encode_together(list(letters.difference(known)))
        for run, stem, tail in joined:
            known[run] = known[stem] + known[tail]
        return letters | apart

    def encode_apart(self, runs) -> None:
        runs = list(runs)
        found = self.tokenizer.encode_batch_fast([r.decode() for r in runs], add_special_tokens=False)
        self.known.update((r, np.array(e.ids, "<u4").tobytes()) for r, e in zip(runs, found))

    def encode_together(self, words: list[bytes]) -> None:
        if not words:
            return
        (found,) = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(found.ids, "<u4")
        stops = (4 * (np.flatnonzero(self.ends_word[ids]) + 1)).tolist()
        if len(stops) != len(words):
            self.encode_apart(words)
            return
        data = ids.tobytes()
        self.known.update((w, data[a:b]) for w, a, b in zip(words, [0, *stops], stops))


def pieces(docs: DataFrame, tokenizer_path: str, size: int = 2048, end: int = 1, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """``key, start, length, ids_crc32, doc_tokens`` (and ``ids``) of every piece.

    A document's ids are its whole text's, then ``end``; NULL and empty texts have ``end``
    alone. It is cut after every ``size`` ids. Other columns are not read.
    """
    with open(tokenizer_path, encoding="utf-8") as file:  # under 2 MB, of fixed size
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    source = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    names = ["start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    schema = pa.schema([(n, pa.list_(pa.int32()) if n == "ids" else pa.int64()) for n in names])

    def run(batches):
        words = once_per_process(f"packing words {zlib.crc32(shared.value.encode())}", lambda: WordIds(shared.value))
        for batch in small_batches(batches):
            which, rows = [], []
            for i, ids in enumerate(words.of_texts(batch.column(1).to_pylist(), end)):
                for start in range(0, len(ids), size):
                    piece = ids[start : start + size]
                    which.append(i)
                    rows.append((start, len(piece), zlib.crc32(piece.tobytes()), len(ids), *[piece.astype(np.int32)] * with_ids))
            made = record_batch(schema, *zip(*rows))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), *made.columns], names=["_key", *names])

    kinds = ", ".join(f"{n} {'array<int>' if n == 'ids' else 'bigint'}" for n in names)
    found = source.mapInArrow(run, f"_key {source.schema['_key'].dataType.simpleString()}, {kinds}")
    return found.withColumnRenamed("_key", key)


def plan_packs(counts: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (how often, lengths) by shortest pack first over a histogram of lengths.

    ``room`` holds the open patterns by free space. Each step either uses a length or a
    pattern up, so there are never more open patterns than lengths.
    """
    room: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)
    done = []

    def put(often, pattern, free):
        (room[free] if free else done).append((often, pattern))

    for length in sorted(counts, reverse=True):
        left, free = counts[length], size
        while left:
            while free >= length and not room.get(free):
                free -= 1
            if free < length:
                put(left, (length,), size - length)
                break
            often, pattern = room[free].pop()
            used = min(often, left)
            if often > used:
                room[free].append((often - used, pattern))
            put(used, (*pattern, length), free - length)
            left -= used
    return [*done, *(p for free in sorted(room) for p in room[free])]


def _slots(patterns):
    """Per length and rank: the first sequence and the offset of each run of equal places."""
    rows, taken, sequence = [], defaultdict(int), 0
    for often, pattern in patterns:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += often
            offset += length
        sequence += often
    rows.sort()
    return tuple(np.array(column, np.int64) for column in zip(*rows)) if rows else tuple(np.zeros((4, 0), np.int64))


def pack(found: DataFrame, size: int = 2048, key: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces with ``key, start, length``.

    ``found`` is read three times and should be a written table. The driver gets one count
    for each length, at most ``size`` numbers, and sends out the plan, which they bound.
    Pieces of one length are ranked in groups of bounded size, so a crowded length is
    spread over tasks. An empty table stays empty.
    """
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    lengths, ranks, sequences, offsets = _slots(plan_packs(counts, size))
    groups = F.create_map(*[F.lit(int(x)) for n, c in counts.items() for x in (n, -(-c // RANKED_TOGETHER))]) if counts else F.create_map(F.lit(0), F.lit(1))
    group = F.pmod(F.xxhash64(key, "start", "ids_crc32"), F.element_at(groups, F.col("length").cast("int"))).alias("_group")
    grouped = found.select("*", group)
    sums = grouped.groupBy("length", "_group").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("length", "_group").orderBy(key, "start", "ids_crc32")
    ranked = grouped.withColumn("_rank", F.row_number().over(inside).cast("bigint")).join(bases, ["length", "_group"])
    ranked = ranked.select(*found.columns, (F.col("_base") + F.col("_rank") - 1).alias("_rank"))
    # a piece's place is the last run of its length that starts at its rank or before
    places = lengths * (1 << 44) + ranks

    def run(batches):
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(places, batch.column("length").to_numpy() * (1 << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequences[at] + rank - ranks[at]), pa.array(offsets[at])],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return ranked.mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, scratch: Scratch, tokenizer_path: str, size: int = 2048, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``pieces`` of all documents with their ``sequence_id`` and ``offset``; tokenised once."""
    return pack(scratch.keep(pieces(docs, tokenizer_path, size, end, key, text)), size, key)
