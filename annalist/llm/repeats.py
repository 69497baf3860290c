"""Exact repeats across a corpus by prefix-free parsing.

A rolling hash of 16 bytes triggers phrase ends: of every so many neighbouring positions
(``spread``) the one with the smallest hash is a trigger. Which trigger a window of ``length`` bytes gets
depends on the window's own bytes alone, so equal windows have equal triggers and equal
phrases around them, wherever they stand. That makes each phrase with the bytes its windows
reach a word of a dictionary, and the corpus a parse over these words.

The order of the corpus' suffixes is needed only where it brings equal windows together.
Windows of one trigger share the bytes of its *core*, so it is built core by core:

* a trigger whose core occurs once has no repeated window;
* a dictionary word that occurs twice in the parse repeats all its windows;
* words that occur once beside others of the same core are sorted, core by core: by what
  follows the trigger, and by what precedes it, read backwards. Both orders combine into the
  classes of equal windows (``repeated_windows``).

Cores and words are grouped by digests; no suffix array is built and the sequence of phrases is
never formed, as order beyond a core brings no equal windows together.

Highly repetitive text thus costs one dictionary word per different phrase.

Windows are strings of ``length`` bytes, or the shortest strings that hold a number of words
or of bytes (``Passages``). Which bytes such a string has is seen from its own bytes too, so
the same holds for them.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annalist.llm.common import once_per_process, record_batch, small_batches
from annalist.operators.lineage import Scratch

GRAM = 16
#: windows of a text whose triggers are found at once
PART = 1 << 20
#: up to this many different words of a core are compared in one task; of more crowded cores
#: the windows are dealt to buckets of about as many words' windows
TOGETHER = 1024

TRIGGERS = pa.schema([("core", pa.int64()), ("word", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("place", pa.int32()), ("size", pa.int32())])
#: bytes between words, those of bytes.split(), and a place past the end of any text
SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
FAR = 1 << 40


def _constants():
    random = np.random.default_rng(10)
    return random.integers(0, 2**64, 256, np.uint64), random.integers(0, 2**63, 4, np.uint64) * np.uint64(2) + np.uint64(1)


def _gram_hashes(data: np.ndarray, values: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Hash of the 16 bytes from every position, by doubling."""
    h, width = values[data], 1
    for factor in factors:
        h = h[:-width] * factor + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    return h


def spread(length: int) -> int:
    """Positions among which one is a trigger, for windows of a length."""
    return min(128, length // 2)


def triggers(data: np.ndarray, length: int):
    """Each trigger's place, and the first and last window that it stands for.

    Long texts are worked on in parts of ``PART`` windows, in bounded memory.
    """
    last = len(data) - length
    wide, none = spread(length), np.zeros(0, np.int64)
    places, lows = [none], [none]
    for start in range(0, last + 1, PART):
        stop = min(last + 1, start + PART)
        # the bytes that the part's windows look at for their triggers
        place, low = _part_triggers(data[start : stop - 1 + wide + GRAM - 1], stop - start, wide)
        place, low = place + start, low + start
        if len(places[-1]) and places[-1][-1] == place[0]:
            place, low = place[1:], low[1:]
        if len(low):
            places.append(place)
            lows.append(low)
    place, low = np.concatenate(places), np.concatenate(lows)
    return place, low, np.append(low[1:], last + 1)[: len(low)] - 1


def _part_triggers(data: np.ndarray, windows: int, wide: int):
    place = _places(data, windows, wide)
    low = np.flatnonzero(np.diff(place, prepend=-1))
    return place[low], low


def _places(data: np.ndarray, windows: int, wide: int) -> np.ndarray:
    """The trigger's place of every window."""
    values, factors = once_per_process("repeats constants", _constants)
    with np.errstate(over="ignore"):
        h = _gram_hashes(data, values, factors)
    # the leftmost of equal hashes is the smallest key
    keys = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= wide:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    if width < wide:
        keys = np.minimum(keys[: width - wide], keys[wide - width :])
    return (keys[:windows] & np.uint64(0xFFFFFFFF)).astype(np.int64)


class Strings:
    """Windows of ``length`` bytes."""

    def __init__(self, length: int):
        self.length = length

    def parse(self, data: np.ndarray):
        """Of each part of a text: the size of cores, and triggers' places, first and last windows and the ends of these."""
        place, low, high = triggers(data, self.length)
        yield self.length - spread(self.length) + 1, place, low, high, high + self.length

    def windows(self, data: bytes, count: int):
        """Hashes, starts and stops of the windows from the first ``count`` bytes."""
        starts = np.arange(count)
        return _hashes(data, starts, starts + self.length), starts, starts + self.length

    def repeated(self, words):
        """(word, start, stop) of the bytes of repeated windows among words with one core."""
        for i, first, last in repeated_windows(words, self.length):
            yield i, first, last + self.length


class Passages:
    """Windows that hold ``words`` words, or ``size`` bytes if these are fewer.

    From every byte the shortest such string, and the longer ones that hold no further word:
    all strings that hold enough and do not without their first or last byte, or stop within
    a word or the blanks after it. What repeated strings of enough words or bytes cover is
    what repeated windows cover. None has fewer than ``length`` bytes. Those of twice as many
    have triggers of their own, further apart; equal windows have equally many.
    """

    def __init__(self, length: int, words: int, size: int):
        if not length <= min(2 * words - 1, size):
            raise ValueError(f"passages of {words} words or {size} bytes can have fewer than {length} bytes")
        self.length, self.words, self.size = length, words, size

    def stops(self, data: np.ndarray, count: int):
        """Ends of the shortest and the longest window from each of the first bytes; past the data if there is none."""
        space = SPACE[data]
        begins = ~space
        begins[1:] &= space[:-1]
        reach = np.append(np.flatnonzero(begins) + 1, np.full(self.words + 1, FAR))
        by_words = np.append(reach[np.cumsum(begins) - ~space + (self.words - 1)], FAR)
        by_size = np.arange(self.size, self.size + count)
        first = np.minimum(by_words[:count], by_size)
        last = np.minimum(np.maximum(first, by_words[1 : count + 1] - 1), by_size)
        return first, np.minimum(last, len(data))

    def parse(self, data: np.ndarray):
        end = len(data) - self.length + 1
        for start in range(0, end, PART):
            count = min(PART, end - start)
            near = data[start : start + count + self.size]
            first, last = self.stops(near, count)
            sizes = np.where(first <= len(near), first - np.arange(count), 0)
            for least, most in ((self.length, 2 * self.length), (2 * self.length, self.size + 1)):
                where = np.flatnonzero((sizes >= least) & (sizes < most))
                if not len(where):
                    continue
                wide, windows = spread(least), int(where[-1]) + 1
                place = _places(near[: windows - 1 + wide + GRAM - 1], windows, wide)[where]
                edges = np.flatnonzero(np.append(True, (np.diff(place) != 0) | (np.diff(where) > 1)))
                low, high = where[edges], where[np.append(edges[1:], len(where)) - 1]
                yield least - wide + 1, place[edges] + start, low + start, high + start, last[high] + start

    def windows(self, data: bytes, count: int):
        return self._windows(data, *self.stops(np.frombuffer(data, np.uint8), count), 0, count, len(data))

    def _windows(self, data, first, last, low, high, limit):
        """Windows from bytes ``low`` to ``high`` that end by ``limit``, ordered by start and stop."""
        first = first[low:high]
        count = np.minimum(last[low:high], limit) - first + 1
        starts = np.repeat(np.arange(low, high), count)
        stops = np.repeat(first - np.cumsum(count) + count, count) + np.arange(len(starts))
        return _hashes(data, starts, stops), starts, stops

    def repeated(self, words):
        near = []
        rights, lefts = _longest([w[at:] for w, at, _ in words]), _longest([w[:at][::-1] for w, at, _ in words])
        for i, ((data, at, n), right, left) in enumerate(zip(words, rights, lefts)):
            if left + right < self.length:
                continue
            first, last = self.stops(np.frombuffer(data, np.uint8), n)
            low, high = max(0, at - left), int(np.searchsorted(first, at + right, "right"))
            if len(words) == 2:  # the other word has windows for these
                _, other, others = words[1 - i]
                low, high = max(low, at - other), min(high, at - other + others)
                if low < high:
                    yield i, low, int(min(last[high - 1], at + right))
            elif low < high:
                near.append((i, *self._windows(data, first, last, low, high, at + right)))
        if near:
            _, kind, count = np.unique(np.concatenate([x[1] for x in near]), return_inverse=True, return_counts=True)
            hits = np.split(count[kind] > 1, np.cumsum([len(x[1]) for x in near])[:-1])
            for (i, _, starts, stops), hit in zip(near, hits):
                edges = np.flatnonzero(np.diff(hit, prepend=False, append=False))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    yield i, int(starts[a]), int(stops[b - 1])


def _parse(texts: DataFrame, kind) -> DataFrame:
    """``core, word, text_id, doc, low, high, place, size`` for every trigger of ``texts (doc, text_id, text)``.

    ``place`` is the trigger's distance from the first window that it stands for, ``size`` that
    of the word's end from the start of the last.
    """
    least = kind.length
    digest = xxhash.xxh3_64_intdigest
    half = 1 << 63

    def run(batches):
        for batch in small_batches(batches):
            rows, cores, words, lows, highs, places, sizes = [], [], [], [], [], [], []
            for i, value in enumerate(batch.column(2)):
                data = value.as_buffer() if value.is_valid else None
                if data is None or len(data) < least:
                    continue
                data = data.to_pybytes()
                for core_size, place, low, high, stop in kind.parse(np.frombuffer(data, np.uint8)):
                    rows.append(np.full(len(low), i))
                    lows.append(low)
                    highs.append(high)
                    places.append(place - low)
                    sizes.append(stop - high)
                    for t, a, b in zip(place.tolist(), low.tolist(), stop.tolist()):
                        cores.append(digest(data[t : t + core_size]) - half)
                        words.append(digest(data[a:b], t - a) - half)
            if rows:
                which = pa.array(np.concatenate(rows))
                made = record_batch(TRIGGERS, cores, words, *[np.concatenate(c).astype(np.int32) for c in (lows, highs, places, sizes)])
                yield pa.RecordBatch.from_arrays(
                    [*made.columns[:2], batch.column(1).take(which), batch.column(0).take(which), *made.columns[2:]],
                    names=["core", "word", "text_id", "doc", "low", "high", "place", "size"],
                )

    doc = texts.schema["doc"].dataType.simpleString()
    return texts.mapInArrow(run, f"core bigint, word bigint, text_id bigint, doc {doc}, low int, high int, place int, size int")


def _cut_words():
    """Bytes of the dictionary words that a text stands for."""
    names = ["core", "text_id", "low", "high", "place", "occurrences", "variants", "bytes"]

    def run(batches):
        for batch in small_batches(batches):
            out = [[] for _ in names]
            for text_id, text, words in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                data = text.as_buffer().to_pybytes()
                for w in words:
                    row = (w["core"], text_id, w["low"], w["high"], w["place"], w["occurrences"], w["variants"], data[w["low"] : w["high"] + w["size"]])
                    for column, value in zip(out, row):
                        column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    return run


def _hashes(data: bytes, starts, stops) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.array([digest(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist())], np.uint64)


def _neighbours(parts: list[bytes]):
    """The order of byte strings, and the longest common prefix of each with the one before it."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    common = []
    for i, j in zip(order, order[1:]):
        size = min(len(parts[i]), len(parts[j]))
        differ = np.frombuffer(parts[i], np.uint8, size) != np.frombuffer(parts[j], np.uint8, size)
        common.append(int(differ.argmax()) if differ.any() else size)
    return order, np.array(common, np.int64)


def _longest(parts: list[bytes]) -> list[int]:
    """The longest prefix of each byte string that another one has too."""
    order, common = _neighbours(parts)
    out = np.zeros(len(parts), np.int64)
    out[order] = np.maximum(np.append(0, common), np.append(common, 0))
    return out.tolist()


def _classes(order, common, sizes):
    """Class of every string among those with equal first bytes, for each size: (strings, sizes)."""
    apart = np.zeros((len(order), len(sizes)), np.int64)
    np.cumsum(common[:, None] < sizes, axis=0, out=apart[1:])
    out = np.empty_like(apart)
    out[order] = apart
    return out


def repeated_windows(words, length: int):
    """Which windows of words with one core are repeated: (word, first, last) for runs of windows.

    ``words`` holds (bytes, place of the trigger, number of windows). A window ``o`` bytes before
    the trigger is the last ``o`` bytes before it and ``length - o`` from it on. The parts from
    the trigger on are sorted into the order of the parse's suffixes, those before it, read
    backwards, into the order of the dictionary's; common prefixes of neighbours in both
    orders combine to the classes of equal windows.
    """
    after, before = [w[at:] for w, at, _ in words], [w[:at][::-1] for w, at, _ in words]
    if len(words) == 2:
        (_, (right,)), (_, (left,)) = _neighbours(after), _neighbours(before)
        # o <= left and length - o <= right; both words have windows for these
        low, high = max(0, length - right), left
        for i, (_, at, n) in enumerate(words):
            first, last = max(0, at - high), min(n - 1, at - low)
            if first <= last:
                yield i, first, last
        return
    places = np.array([at for _, at, _ in words])
    counts = np.array([n for _, _, n in words])
    offsets = np.arange(places.max() + 1)
    pair = _classes(*_neighbours(after), length - offsets) * len(words) + _classes(*_neighbours(before), offsets)
    start = places[:, None] - offsets  # the window's number in its word
    valid = (start >= 0) & (start < counts[:, None])
    which, column = np.nonzero(valid)
    _, kind, count = np.unique(column * len(words) ** 2 + pair[which, column], return_inverse=True, return_counts=True)
    hit = count[kind] > 1
    which, number = which[hit], start[which[hit], column[hit]]
    order = np.lexsort((number, which))
    which, number = which[order], number[order]
    if len(which):
        edges = np.flatnonzero(np.append(True, (np.diff(which) != 0) | (np.diff(number) > 1)))
        ends = np.append(edges[1:], len(which)) - 1
        yield from zip(which[edges].tolist(), number[edges].tolist(), number[ends].tolist())


def _compare_words(kind):
    """Repeated windows of words that occur once, from rows sorted by core."""

    def settle(rows, out):
        if len(rows) > 1:
            for i, start, stop in kind.repeated([(w, at, high - low + 1) for _, low, high, at, _, w in rows]):
                text_id, low, _, _, occurrences, _ = rows[i]
                if occurrences == 1:
                    out.append((text_id, low + start, low + stop))

    def made(out):
        return record_batch(SPANS, *([c for c in zip(*out)] or [[], [], []]))

    def run(batches):
        core, rows, out = None, [], []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("core", "text_id", "low", "high", "place", "occurrences", "bytes")]
            for key, *row in zip(*columns):
                if key != core:
                    settle(rows, out)
                    core, rows = key, []
                rows.append(row)
            yield made(out)
            out = []
        settle(rows, out)
        yield made(out)

    return run


SPANS = pa.schema([("text_id", pa.int64()), ("start", pa.int32()), ("stop", pa.int32())])


DEALT = pa.schema([("core", pa.int64()), ("bucket", pa.int64()), ("hashes", pa.binary()), ("text_ids", pa.binary()), ("starts", pa.binary()), ("stops", pa.binary()), ("asks", pa.binary())])
#: bucket of windows that are known to be repeated
SETTLED = -1
#: windows that a task gathers before it hands them on
GATHERED = 200_000


def _packed(core, bucket, hashes, texts, starts, stops, asks):
    """One row for each (core, bucket) of arrays sorted by them."""
    edges = np.flatnonzero(np.append(True, (np.diff(core) != 0) | (np.diff(bucket) != 0)))
    cuts = list(zip(edges.tolist(), [*edges[1:].tolist(), len(core)]))
    binary = [[x[i:j].tobytes() for i, j in cuts] for x in (hashes, texts, starts, stops, asks)]
    return record_batch(DEALT, core[edges], bucket[edges], *binary)


def _deal_windows(kind):
    """Windows of the words of crowded cores, dealt to buckets by their hash.

    Equal windows meet within the task first: they are settled, and one of them stands for
    all from there on. A window that most texts share thus goes on once for each task.
    """

    def hand_on(words):
        count = [len(w[5]) for w in words]
        core, text, low, once, buckets = (np.repeat(np.array(c, np.int64), count) for c in zip(*[w[:5] for w in words]))
        hashes = np.concatenate([w[5] for w in words])
        start, stop = ((low + np.concatenate([w[i] for w in words])).astype(np.int32) for i in (6, 7))
        asks = once.astype(bool)
        bucket = (hashes % buckets.astype(np.uint64)).astype(np.int64)
        order = np.lexsort((hashes, bucket, core))
        core, bucket, hashes, text, start, stop, asks = (x[order] for x in (core, bucket, hashes, text, start, stop, asks))
        same = (np.diff(core) == 0) & (np.diff(hashes) == 0)
        again = np.append(False, same)
        equal = again | np.append(same, False)
        if (known := equal & asks).any():
            yield _packed(core[known], np.full(known.sum(), SETTLED), hashes[known], text[known], start[known], stop[known], asks[known])
        asks = asks & ~equal
        first = ~again
        yield _packed(*(x[first] for x in (core, bucket, hashes, text, start, stop, asks)))

    def run(batches):
        words, gathered = [], 0
        for batch in small_batches(batches):
            columns = [batch.column(n).to_pylist() for n in ("core", "text_id", "low", "high", "occurrences", "variants", "bytes")]
            for core, text_id, low, high, occurrences, variants, data in zip(*columns):
                windows = kind.windows(data, high - low + 1)
                words.append((core, text_id, low, occurrences == 1, -(-variants // TOGETHER), *windows))
                gathered += len(windows[0])
            if gathered >= GATHERED:
                yield from hand_on(words)
                words, gathered = [], 0
        if words:
            yield from hand_on(words)

    return run


def _spans_of(text, start, stop):
    """Rows of runs of overlapping windows of one text, in which no window holds another's start and stop."""
    order = np.lexsort((stop, start, text))
    text, start, stop = text[order], start[order], stop[order]
    edges = np.flatnonzero(np.append(True, (np.diff(text) != 0) | (start[1:] > stop[:-1])))
    return record_batch(SPANS, text[edges], start[edges], stop[np.append(edges[1:], len(text)) - 1])


def _arrays(batch):
    kinds = (("hashes", np.uint64), ("text_ids", np.int64), ("starts", np.int32), ("stops", np.int32), ("asks", bool))
    return [[np.frombuffer(x, kind) for x in batch.column(name).to_pylist()] for name, kind in kinds]


def _settled_spans(batches):
    for batch in small_batches(batches):
        _, texts, starts, stops, _ = _arrays(batch)
        yield _spans_of(*map(np.concatenate, (texts, starts, stops)))


def _compare_windows(batches):
    """Repeated windows among those that ask, from rows sorted by core and bucket."""

    def settle(rows):
        hashes, texts, starts, stops, asks = (np.concatenate(c) for c in zip(*rows))
        found, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = asks & (count[which] > 1)
        if hit.any():
            yield _spans_of(texts[hit], starts[hit], stops[hit])

    key, rows = None, []
    for batch in batches:
        arrays = _arrays(batch)
        for here, *row in zip(zip(batch.column("core").to_pylist(), batch.column("bucket").to_pylist()), *arrays):
            if here != key:
                if rows:
                    yield from settle(rows)
                key, rows = here, []
            rows.append(row)
    if rows:
        yield from settle(rows)


KEPT = pa.schema([("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("kept", pa.binary())])


def covered(spans) -> list[tuple[int, int]]:
    """Maximal runs of bytes that spans cover."""
    runs = []
    for start, stop in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], stop)
        else:
            runs.append([start, stop])
    return [tuple(r) for r in runs]


def whole_characters(data: bytes, spans) -> list[tuple[int, int]]:
    """The spans without UTF-8 characters that they hold only in part."""
    out = []
    for start, stop in spans:
        while start < stop and data[start] & 0xC0 == 0x80:
            start += 1
        while stop > start and stop < len(data) and data[stop] & 0xC0 == 0x80:
            stop -= 1
        if start < stop:
            out.append((start, stop))
    return out


def _remove(characters: bool):
    def run(batches):
        for batch in small_batches(batches):
            spans, kept = [], []
            for text, ranges in zip(batch.column("text"), batch.column("ranges").to_pylist()):
                data = text.as_buffer().to_pybytes()
                runs = covered((r["start"], r["stop"]) for r in ranges or [])
                if characters:
                    runs = whole_characters(data, runs)
                spans.append([{"start": a, "stop": b} for a, b in runs])
                edges = [0, *(x for run in runs for x in run), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])))
            made = record_batch(KEPT, spans, kept)
            size = pa.array([len(t.as_buffer()) for t in batch.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("row"), size, *made.columns], names=["doc", "row", "n_bytes", "spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = 400, key: str = "doc_id", text: str = "text", characters: bool = False, least_words: int = 0, least_bytes: int = 400, carry=()) -> DataFrame:
    """``key, n_bytes, spans (start, stop), kept`` and a struct ``row`` of the columns ``carry`` for every row of ``docs``.

    ``spans`` are the maximal runs of bytes covered by a ``length``-byte string that also
    starts anywhere else in the column, in the same text too, and ``kept`` the other bytes.
    Matches lie within one text. With ``least_words``, such a string has so many words, those
    cut by its ends included, or ``least_bytes`` bytes, and ``length`` is a length that none
    undercuts, at most ``2 * least_words - 1``. Each string counts by itself, whatever stands
    beside it. ``characters`` shrinks spans to whole UTF-8 characters.
    NULL texts count as empty; texts under ``length`` bytes keep all. Repeated rows are
    copies of each other, whatever their keys, so long ones lose everything. Keys may be
    NULL or repeated; other columns are not read. ``length`` is at least 64.

    Words of a core are compared in one task up to ``TOGETHER``; beyond that their windows are
    dealt to buckets by hash, after equal ones have met within each task. Texts are known by
    their 64-bit hash and shuffled twice, to cut words and to remove what is repeated. Copies
    are combined before shuffles.
    """
    if length < 4 * GRAM:
        raise ValueError(f"length must be at least {4 * GRAM}")
    kind = Passages(length, least_words, least_bytes) if least_words else Strings(length)
    value = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*carry) if carry else F.lit(0)
    texts = docs.select(F.col(key).alias("doc"), F.xxhash64(value).alias("text_id"), value.alias("text"), row.alias("row"))
    parsed = scratch.keep(_parse(texts.select("doc", "text_id", "text"), kind))
    # written, so that the join below can split a core that many texts share
    cores = scratch.keep(parsed.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("core"))
    shared = scratch.keep(parsed.join(cores, "core"))
    scratch.drop(parsed)

    first = F.min(F.struct("text_id", "doc", "low", "high", "place", "size")).alias("first")
    dictionary = scratch.keep(shared.groupBy("core", "word").agg(F.count(F.lit(1)).alias("occurrences"), first))
    often = dictionary.filter("occurrences > 1").select("core", "word")
    whole = scratch.keep(shared.join(often, ["core", "word"]).select("text_id", F.col("low").alias("start"), (F.col("high") + F.col("size")).alias("stop")).distinct())
    scratch.drop(shared)
    variants = dictionary.groupBy("core").agg(F.count(F.lit(1)).alias("variants")).filter("variants > 1")
    open_words = dictionary.join(variants, "core").select("first.*", F.struct("core", "first.low", "first.high", "first.place", "first.size", "occurrences", "variants").alias("entry"))
    open_words = open_words.groupBy("text_id", "doc").agg(F.collect_list("entry").alias("words"))
    open_words = scratch.keep(open_words.withColumnRenamed("doc", "_doc"))

    dealt = texts.join(open_words, "text_id").filter(F.col("doc").eqNullSafe(F.col("_doc")))
    schema = "core bigint, text_id bigint, low int, high int, place int, occurrences bigint, variants bigint, bytes binary"
    words = scratch.keep(dealt.select("text_id", "text", "words").mapInArrow(_cut_words(), schema))
    few = words.filter(F.col("variants") <= TOGETHER).repartition("core").sortWithinPartitions("core")
    span = "text_id bigint, start int, stop int"
    found = few.mapInArrow(_compare_words(kind), span)
    dealt = "core bigint, bucket bigint, hashes binary, text_ids binary, starts binary, stops binary, asks binary"
    many = scratch.keep(words.filter(F.col("variants") > TOGETHER).mapInArrow(_deal_windows(kind), dealt))
    settled = many.filter(F.col("bucket") == SETTLED).mapInArrow(_settled_spans, span)
    met = many.filter(F.col("bucket") != SETTLED).repartition("core", "bucket").sortWithinPartitions("core", "bucket")
    spans = whole.unionByName(found).unionByName(settled).unionByName(met.mapInArrow(_compare_windows, span))
    ranges = spans.groupBy("text_id").agg(F.collect_set(F.struct("start", "stop")).alias("ranges"))
    kinds = texts.schema
    out = texts.join(ranges, "text_id", "left").select("doc", "text_id", "text", "row", "ranges").mapInArrow(
        _remove(characters),
        f"doc {kinds['doc'].dataType.simpleString()}, row {kinds['row'].dataType.simpleString()}, "
        "n_bytes bigint, spans array<struct<start: bigint, stop: bigint>>, kept binary",
    )
    return out.select(F.col("doc").alias(key), "n_bytes", "spans", "kept", *(["row"] if carry else []))
